import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb
from tokenizers import Tokenizer, models, pre_tokenizers

from fieldloom.llm import pieces, wordpiece

PATH = "/opt/tokenizers/piece_bpe_32k.model"
WORDS = ["the", "lowercase", "Straße", "coração", "naïve", "x1", "日本語", "▁", "a\x00b", "😀", "zzzzzzzzzzzz", "é", "\n", "\t", "I'm", "3.14", "ÃÃ"]


def texts(n=200, seed=1):
    r = random.Random(seed)
    out = ["", " ", "  a", "a ", "a  b   c", "\n", "x" * 300, "日" * 50]
    return out + ["".join(r.choice(WORDS) + r.choice(["", " ", " ", "  ", "\n"]) for _ in range(r.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.read_vocabulary(PATH)


def test_encoding_is_never_worse_than_the_library_s_unigram_search(vocabulary):
    proto = pb.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    codec = pieces.Codec(vocabulary)
    r = random.Random(2)
    given = [t for t in texts() if "▁" not in t] + [" ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 12))) for _ in range(30)) for _ in range(100)]
    scores = lambda ids: sum(library.get_score(i) for i in ids)
    for t, ids in zip(given, codec.encode([t.encode() for t in given]), strict=True):
        theirs = library.encode(t)
        # the library adds in single precision, where one piece or byte of a score of -1e9 hides the others
        plain = all(library.get_score(i) > -1e6 and not library.is_byte(i) for i in [*ids, *theirs])
        assert ids == theirs or library.decode(ids) == library.decode(theirs) and (not plain or scores(ids) >= scores(theirs))


def test_best_score_by_brute_force(vocabulary):
    codec = pieces.Codec(vocabulary)
    table = {p: (s, i) for i, (p, s) in enumerate(zip(vocabulary.pieces, vocabulary.scores)) if p}

    def best(unit):
        top = {0: 0.0}
        chars = [len(c.encode()) for c in unit.decode()]
        ends = [sum(chars[:k]) for k in range(len(chars) + 1)]
        for j, e in enumerate(ends[1:], 1):
            options = []
            for k in range(max(0, j - 50), j):
                part = unit[ends[k] : e]
                if part in table:
                    options.append(top[ends[k]] + table[part][0])
                elif k == j - 1:
                    options.append(top[ends[k]] + codec.unknown)
            top[e] = max(options)
        return top[len(unit)]

    def price(ids):
        out, i = 0.0, 0
        while i < len(ids):
            if vocabulary.pieces[ids[i]] is None:
                lead = codec.bytes[ids[i]][0]
                i += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                out += codec.unknown
            else:
                out, i = out + vocabulary.scores[ids[i]], i + 1
        return out

    for w in WORDS + ["  the", "   ", "x" * 40]:
        unit = (" " + w).encode()
        (ids,) = codec._units([unit])
        assert price(list(ids)) == best(unit)


def test_round_trip_tables(spark, vocabulary):
    rows = list(enumerate(texts(50))) + [(None, "a"), (7, None), (7, "a"), (7, "a")]
    docs = spark.createDataFrame([(i, t, [1]) for i, t in rows], "doc_id long, text string, pieces array<int>")
    back = pieces.decoded(pieces.encoded(docs, vocabulary), vocabulary)
    assert sorted(((r[0] is None, r[0] or 0, r[1]) for r in back.collect())) == sorted((i is None, i or 0, t or "") for i, t in rows)
    trips = pieces.round_trips(docs, vocabulary).collect()
    assert all(r.exact and len(r.pieces) == r.n_pieces for r in trips)
    assert sorted(str(r.pieces) for r in trips) == sorted(str(r.pieces) for r in pieces.encoded(docs, vocabulary).collect())
    assert pieces.round_trips(docs.limit(0), vocabulary).collect() == []
    assert pieces.encoded(docs.limit(0), vocabulary).collect() == []


def test_token_counts_equal_the_library_s_word_pieces(spark):
    first, inner = wordpiece.read_pieces(PATH)
    names = {"[UNK]": 0}
    for p in [*first, *("##" + p for p in inner)]:
        names.setdefault(p, len(names))
    library = Tokenizer(models.WordPiece(names, unk_token="[UNK]", max_input_chars_per_word=10**6))
    automaton = wordpiece.Automaton(first, inner)
    r = random.Random(3)
    words = [w for t in texts(100, 5) for w in t.split()] + ["".join(r.choice("aeinrst") for _ in range(r.randint(1, 30))) for _ in range(500)]
    for w in words:
        found = library.model.tokenize(w)
        want = 0 if [t.value for t in found] == ["[UNK]"] else len(found)
        assert automaton.count(w.encode()) == want, w
    docs = spark.createDataFrame([(1, "the cat"), (2, None), (None, "▁▁ the"), (1, "the cat"), (3, "w" * 5000)], "doc_id long, text string").withColumnRenamed("text", "text")
    got = {(r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in wordpiece.token_counts(docs, first, inner).collect()}
    assert (1, 2, 2, 0) in got and (2, 0, 0, 0) in got and (None, 2, 2, 1) in got
    assert wordpiece.token_counts(docs.limit(0), first, inner).collect() == []


def test_small_vocabularies_against_greedy_search():
    r = random.Random(0)
    for _ in range(300):
        first = {"".join(r.choice("ab") for _ in range(r.randint(1, 4))) for _ in range(4)}
        inner = {"".join(r.choice("ab") for _ in range(r.randint(1, 4))) for _ in range(4)}
        automaton = wordpiece.Automaton(first, inner)
        for _ in range(20):
            w = "".join(r.choice("ab") for _ in range(r.randint(1, 9)))
            at, n, known = 0, 0, first
            while at < len(w):
                size = max((k for k in range(1, len(w) - at + 1) if w[at : at + k] in known), default=0)
                if not size:
                    n = 0
                    break
                at, n, known = at + size, n + 1, inner
            assert automaton.count(w.encode()) == n
