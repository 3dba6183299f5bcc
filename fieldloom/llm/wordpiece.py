"""Token counts of texts by a linear longest-match automaton.

Greedy word pieces take the longest vocabulary entry at each place. A trie of the vocabulary, with a second root
for pieces inside a word, gets failure links: where a node has no edge for the next byte, the link leads to the
node that stands for what is left after the longest pieces are taken off, and a precomputed number says how many
those are (Song et al., 2021). Each byte moves ahead once, so a word takes time linear in its length, and no
piece is ever built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small
from .words import texts_of

_NONE = -1
#: Words whose counts a task remembers; it starts anew beyond that.
REMEMBERED = 300_000


def read_pieces(path: str) -> tuple[list[str], list[str]]:
    """(first, inner) pieces of a SentencePiece model's vocabulary: those that begin a word, and the others."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = [model.id_to_piece(i) for i in plain]
    mark = "▁"
    return [p[1:] for p in pieces if p[0] == mark and mark not in p[1:] and len(p) > 1], [p for p in pieces if mark not in p]


class Automaton:
    """Counts of pieces of words; ``first`` pieces begin a word, ``inner`` ones go on."""

    def __init__(self, first: Iterable[str], inner: Iterable[str]) -> None:
        self.go: dict[int, int] = {}
        ends, nodes = set(), 2
        for root, pieces in ((0, first), (1, inner)):
            for piece in pieces:
                at = root
                for byte in piece.encode():
                    if (to := self.go.get(at << 8 | byte)) is None:
                        to = self.go[at << 8 | byte] = nodes
                        nodes += 1
                    at = to
                if at != root:
                    ends.add(at)
        self.fail, self.popped = [_NONE] * nodes, [0] * nodes
        below: dict[int, list[tuple[int, int]]] = {}
        for edge, to in self.go.items():
            below.setdefault(edge >> 8, []).append((edge & 255, to))
        todo = deque([0, 1])
        while todo:
            node = todo.popleft()
            for byte, to in below.get(node, ()):
                if to in ends:
                    self.fail[to], self.popped[to] = 1, 1
                else:
                    back, count = self.fail[node], self.popped[node]
                    while back != _NONE and (back << 8 | byte) not in self.go:
                        back, count = self.fail[back], count + self.popped[back]
                    if back != _NONE:
                        self.fail[to], self.popped[to] = self.go[back << 8 | byte], count
                todo.append(to)

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 if it can't be cut into pieces, or is empty."""
        go, fail, popped, node, out = self.go, self.fail, self.popped, 0, 0
        for byte in word:
            while (to := go.get(node << 8 | byte)) is None:
                if fail[node] == _NONE:
                    return 0
                out += popped[node]
                node = fail[node]
            node = to
        while node > 1:
            if fail[node] == _NONE:
                return 0
            out += popped[node]
            node = fail[node]
        return out


class _Memory(dict):
    """Counts of words; an unknown word counts one, and one more in the high half."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = self.automaton.count(word) or (1 << 32 | 1)
        return out


def token_counts(docs: DataFrame, first: list[str], inner: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_tokens, n_unknown) for each row of ``docs``.

    Words are runs of other than ASCII spaces. A word that can't be cut into pieces is one unknown token. A null
    text is empty and has none; a null key is passed on; an empty table gives no rows; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(Automaton(first, inner))
        get = memory.__getitem__
        for batch in small(batches):
            words, sums = [], []
            for t in texts_of(batch.column(1)):
                found = t.split()
                words.append(len(found))
                sums.append(sum(map(get, found)))
            both = np.array(sums, np.int64)
            cols = [batch.column(0), pa.array(words, pa.int64()), pa.array(both & 0xFFFFFFFF), pa.array(both >> 32)]
            yield pa.RecordBatch.from_arrays(cols, ["__key", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, f"__key {rows.schema[0].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("__key", key)
