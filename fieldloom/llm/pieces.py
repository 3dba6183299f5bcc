"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text is cut before each run of spaces; no piece goes across such a cut. Units of equal byte length advance
together: for each end and piece length, hashes of the substrings probe the sorted keys of the pieces, and a
maximum over the lengths keeps the best score and its length as backpointer. A character without a piece is
spelled in bytes. Scores are the vocabulary's own, whatever they mean there (log probabilities, or merge ranks of a byte-pair
vocabulary): the search finds the cut with the greatest sum; ties go to the longer last piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small
from .words import Index, texts_of

_UNIT = re.compile(rb" *[^ ]+| +")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: How much an unknown character scores below the worst piece.
UNKNOWN = 10.0
#: Units whose pieces a task remembers; it starts anew beyond that.
REMEMBERED = 600_000
#: Bytes of units of one length that advance together.
TOGETHER = 1 << 18


@dataclass
class Vocabulary:
    """pieces: of each id, the bytes it stands for (a space for the mark), or None; byte: id of each byte."""

    pieces: list[bytes | None]
    scores: list[float]
    byte: list[int]


def read_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, byte = [], [], [-1] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte[int(piece[1:-1], 16)] = i
        plain = not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        pieces.append(piece.replace("▁", " ").encode() if plain else None)
        scores.append(model.get_score(i))
    return Vocabulary(pieces, scores, byte)


class Codec:
    def __init__(self, vocabulary: Vocabulary) -> None:
        ids = [i for i, p in enumerate(vocabulary.pieces) if p]
        if any(re.search(rb"[^ ] ", vocabulary.pieces[i]) for i in ids):
            raise ValueError("a piece has a space after another character")
        if min(vocabulary.byte) < 0:
            raise ValueError("the vocabulary has no piece for some byte")
        keys = np.array([self._hash(vocabulary.pieces[i]) for i in ids], np.uint64)
        order = np.argsort(keys)
        self.index = Index(keys[order])
        self.id = np.array(ids)[order]
        self.score = np.array(vocabulary.scores)[self.id]
        self.longest = max(len(vocabulary.pieces[i]) for i in ids)
        self.unknown = float(self.score.min()) - UNKNOWN
        self.byte = np.array(vocabulary.byte)
        self.bytes = [p if p is not None else b"" for p in vocabulary.pieces]
        for value, i in enumerate(vocabulary.byte):
            self.bytes[i] = bytes([value])
        self.known: dict[bytes, tuple[int, ...]] = {}

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _units(self, units: list[bytes]) -> list[tuple[int, ...]]:
        """Pieces of units of one length."""
        n, size = len(units), len(units[0])
        data = np.frombuffer(b"".join(units), np.uint8).reshape(n, size)
        prefix = np.zeros((size + 1, n), np.uint64)
        for i in range(size):
            prefix[i + 1] = prefix[i] * _BASE + data[:, i] + np.uint64(1)
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(self.longest, _BASE)])
        lead = (data & 0xC0) != 0x80
        wide = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((size + 1, n), np.int32)
        piece = np.full((size + 1, n), -1, np.int32)
        single = np.zeros((size, n), bool)
        for end in range(1, size + 1):
            m = np.arange(min(self.longest, end), 0, -1)
            starts = end - m
            place = self.index.find((prefix[end] - prefix[starts] * power[m][:, None]).ravel()).reshape(len(m), n)
            hit = place > 0
            score = np.where(hit, best[starts] + self.score[np.maximum(place, 1) - 1], -np.inf)
            top = np.argmax(score, axis=0)
            cols = np.arange(n)
            best[end], back[end] = score[top, cols], m[top]
            piece[end] = np.where(hit[top, cols], self.id[np.maximum(place[top, cols], 1) - 1], -1)
            for k, length in enumerate(m[-4:], max(0, len(m) - 4)):
                start = end - length
                char = lead[:, start] & (wide[:, start] == length)
                single[start] |= char & hit[k]
                alone = char & ~hit[k]
                better = alone & (best[start] + self.unknown > best[end])
                best[end] = np.where(better, best[start] + self.unknown, best[end])
                back[end] = np.where(better, length, back[end])
                piece[end] = np.where(better, -1, piece[end])
        out: list[list[int]] = [[] for _ in units]
        at = np.full(n, size)
        while (live := np.flatnonzero(at > 0)).size:
            step, ids = back[at[live], live], piece[at[live], live]
            for u, e, s, p in zip(live.tolist(), at[live].tolist(), step.tolist(), ids.tolist(), strict=True):
                if p >= 0:
                    out[u].append(p)
                else:
                    out[u].extend(self.byte[data[u, e - s : e][::-1]].tolist())
            at[live] -= step
        return [tuple(x[::-1]) for x in out]

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        """Ids of each text's pieces; a text without characters has none."""
        cut = [_UNIT.findall(b" " + t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new: dict[int, list[bytes]] = {}
        for u in set(chain.from_iterable(cut)) - self.known.keys():
            new.setdefault(len(u), []).append(u)
        for size, units in new.items():
            step = max(1, TOGETHER // (size * min(size, self.longest)))
            for i in range(0, len(units), step):
                self.known.update(zip(units[i : i + step], self._units(units[i : i + step]), strict=True))
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, units))) for units in cut]

    def decode(self, ids: list[int]) -> bytes:
        """The text of ``ids``: without the space put before it."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:]


def _parts(texts: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > most:
            yield part
            part, size = [], 0
    yield part


def encoded(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pieces) for each row of ``docs``: the ids of its text. A null text is empty and has no pieces; a
    null key is passed on; an empty table gives no rows; other columns are ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in small(batches):
            ids = [x for part in _parts(texts_of(batch.column(1))) for x in codec.encode(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["__key", "pieces"])

    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, f"__key {rows.schema[0].dataType.simpleString()}, pieces array<int>").withColumnRenamed("__key", key)


def decoded(pieces: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", ids: str = "pieces") -> DataFrame:
    """(key, text) for each row of ``pieces``; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in small(batches):
            texts = [codec.decode(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["__key", "text"])

    rows = pieces.select(F.col(key).alias("__key"), F.col(ids).alias("__ids"))
    return rows.mapInArrow(run, f"__key {rows.schema[0].dataType.simpleString()}, text string").withColumnRenamed("__key", key)


def round_trips(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pieces, n_pieces, pieces_crc32, n_bytes, exact) for each row of ``docs``.

    pieces: the ids, as in ``encoded``; pieces_crc32: of these as 32-bit little-endian integers; exact: decoding gives the
    text's bytes. Nulls as in ``encoded``; repeated rows each have their row.
    """
    names = ["__key", "pieces", "n_pieces", "pieces_crc32", "n_bytes", "exact"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in small(batches):
            texts, held, exact = texts_of(batch.column(1)), [], []
            for part in _parts(texts):
                for t, ids in zip(part, codec.encode(part), strict=True):
                    held.append(np.array(ids, "<i4"))
                    exact.append(codec.decode(ids) == t)
            n, crc = [len(x) for x in held], [zlib.crc32(x.tobytes()) for x in held]
            pieces = pa.ListArray.from_arrays(np.cumsum([0, *n], dtype=np.int32), np.concatenate([np.zeros(0, "<i4"), *held]))
            cols = [batch.column(0), pieces, pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(exact)]
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"__key {kind}, pieces array<int>, n_pieces long, pieces_crc32 long, n_bytes long, exact boolean").withColumnRenamed("__key", key)
