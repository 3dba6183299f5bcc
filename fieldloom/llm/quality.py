"""Quality rules for documents, in DataFrame functions alone.

The base rules look at one text. The cross-document rule hashes each normalised line, counts the distinct texts
of its host that hold it, removes lines above a limit, and rejects documents that lose most of their words. Texts are
parsed once; what they leave is written, and all that follows works on hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Verdicts that are broadcast, at most (of some 100 bytes each, and lists of a text's own lines); copies of more of them.
FEW, PARTS = 50_000, 16
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words of a text; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """The \\n-split lines of a text that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)


def repeated_words(hashes: Column, window: int = 5) -> Column:
    """How many words stand in a window that the text holds twice or more, the first included.

    hashes: of the words, in order. Windows count as equal if their 64-bit hashes are. Sorted with their places,
    equal windows are neighbours; the places that repeat, in order again, each add what the next leaves uncovered.
    """

    def covered(places: Column) -> Column:
        each = F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - p, F.lit(window))))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    def repeating(ranked: Column) -> Column:
        place = F.transform(ranked, lambda x, k: F.when((x["h"] == F.get(ranked, k - 1)["h"]) | (x["h"] == F.get(ranked, k + 1)["h"]), x["i"]))
        return F.array_sort(F.filter(place, lambda p: p.isNotNull()))

    def of(found: Column) -> Column:
        ranked = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(_let(ranked, lambda r: _let(repeating(r), covered)))

    n = F.size(hashes) - (window - 1)
    rows = F.arrays_zip(*(F.slice(hashes, k + 1, F.greatest(n, F.lit(0))).alias(f"w{k}") for k in range(window)))
    return F.when(n < 2, F.lit(0)).otherwise(_let(F.transform(rows, lambda x: F.xxhash64(x)), of))


def base_rules(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words and __base_failed."""
    of = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__hashes", F.transform(words_of(of), lambda w: F.xxhash64(w)))
    out = out.withColumns({
        "__n_words": F.size("__hashes").cast("long"),
        "__word_chars": F.length(F.translate(of, SPACES, "")).cast("long"),
        "__n_symbols": (F.length(of) - F.length(F.translate(of, SYMBOLS, ""))).cast("long"),
        "__n_dup_lines": _let(lines_of(of), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "__n_repeat_words": repeated_words(F.col("__hashes")).cast("long"),
    }).drop("__hashes")
    return out.withColumn("__base_failed", (F.col("__n_words") < 10) | (100 * F.col("__n_repeat_words") > 20 * F.col("__n_words")))


def normal_line(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(line), _SPACE, " "))


def _keys(text: str, host: str) -> dict[str, Column]:
    return {"__host": F.xxhash64(host), "__text": F.conv(F.substring(F.md5(F.coalesce(F.col(text), F.lit(""))), 1, 15), 16, 10).cast("long")}


def _lines(text: str) -> Column:
    """Distinct normalised lines of a text: (hash, words)."""
    words = lambda x: F.size(F.split(F.trim(F.translate(x, SPACES, " " * 6)), " +"))
    return F.transform(F.array_distinct(F.transform(lines_of(F.col(text)), normal_line)), lambda x: F.struct(F.xxhash64(x).alias("line"), words(x).alias("n")))


def _spread(rows: DataFrame, verdicts: DataFrame, on: list[str], how: str) -> DataFrame:
    """``rows`` joined to ``verdicts``, of which each key has one row at most. A key may hold any share of ``rows``: a
    few verdicts are broadcast once they are counted, more of them are dealt out in ``PARTS`` copies."""
    if verdicts.count() <= FEW:
        return rows.join(F.broadcast(verdicts), on, how)
    dealt = verdicts.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    mine = rows.withColumn("__part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    return mine.join(dealt, [*on, "__part"], how).drop("__part")


def line_losses(texts: DataFrame, least_texts: int, share: float, min_left: float, min_words: int) -> DataFrame:
    """(__host, __text, __gone, __lost, __depleted) of the texts that lose a line; texts: (__host, __text, __lines), one row each.

    A line goes if over ``least_texts`` texts of its host, and over ``share`` of them, hold it; the text whose hash is smallest
    keeps it. __gone: hashes of the lines; __lost: their words.
    """
    held = texts.select("__host", "__text", F.explode("__lines").alias("l")).select("__host", "__text", F.col("l.line").alias("__line"), F.col("l.n").alias("__n"))
    counts = held.groupBy("__host", "__line").agg(F.count("*").alias("__texts"), F.min("__text").alias("__owner")).where(F.col("__texts") > least_texts)
    hosts = texts.groupBy("__host").agg(F.count("*").alias("__all"))
    common = written(counts.join(hosts, "__host").where(F.col("__texts") > F.lit(share) * F.col("__all")).select("__host", "__line", "__owner"), "quality-common")
    lost = _spread(held, common, ["__host", "__line"], "inner").where("__text <> __owner")
    lost = lost.groupBy("__host", "__text").agg(F.collect_set("__line").alias("__gone"), F.sum("__n").alias("__lost"))
    total = texts.select("__host", "__text", F.aggregate("__lines", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("__total"))
    left = F.col("__total") - F.col("__lost")
    return lost.join(total, ["__host", "__text"]).select("__host", "__text", "__gone", "__lost", ((left < F.lit(min_left) * F.col("__total")) | (left < min_words)).alias("__depleted"))


def _judged(docs: DataFrame, key: Column, text: str, host: str, least_texts: int, share: float, min_left: float, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(rows, losses): each row's base rules and keys, from one reading of the texts, and ``line_losses`` of all texts."""
    rows = base_rules(docs.select(key.alias("__key"), F.col(text).alias("__body"), F.col(host).alias("__from")), "__body")
    rows = written(rows.withColumns(_keys("__body", "__from")).withColumn("__lines", _lines("__body")).drop("__body", "__from"), "quality-rows")
    texts = written(rows.where(F.size("__lines") > 0).groupBy("__host", "__text").agg(F.any_value("__lines").alias("__lines")), "quality-texts")
    return rows, written(line_losses(texts, least_texts, share, min_left, min_words), "quality-losses")


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", least_texts: int = 5, share: float = 0.01, min_left: float = 0.3, min_words: int = 10) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_lost, n_words_lost) for
    each row of ``docs``.

    Lines are compared trimmed, lower-cased, with single spaces; lines without a word don't count. A line is removed if over
    ``least_texts`` distinct texts of its host, and over ``share`` of the host's distinct texts, hold it. This departs from
    removing it everywhere: the holder whose hash is smallest keeps it, so that of a group of near copies one stays whole. A document
    that loses a line is depleted if under ``min_left`` of the words of its distinct lines are left, or under ``min_words``
    words. Equal rows share a verdict. A null text is empty, so it fails the base rules; null hosts are one host; a null key
    is passed on; an empty table gives no rows; other columns are ignored.
    """
    rows, losses = _judged(docs, F.col(key), text, host, least_texts, share, min_left, min_words)
    out = _spread(rows.drop("__lines"), losses.select("__host", "__text", F.size("__gone").cast("long").alias("__n_gone"), F.col("__lost").cast("long").alias("__lost"), "__depleted"), ["__host", "__text"], "left")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    kept = ~F.col("__base_failed") & ~F.coalesce("__depleted", F.lit(False))
    none = F.lit(0).cast("long")
    return out.select(F.col("__key").alias(key), *(F.col(f"__{n}").alias(n) for n in names), kept.alias("kept"), F.coalesce("__n_gone", none).alias("n_lines_lost"), F.coalesce("__lost", none).alias("n_words_lost"))


def kept_documents(docs: DataFrame, text: str = "text", host: str = "source", least_texts: int = 5, share: float = 0.01, min_left: float = 0.3, min_words: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, that ``quality`` keeps, without the lines that it removes.

    A text that loses no line stays as it is, byte for byte; of others the lines left are joined again, those without a word
    included. Null, empty and equal texts, null hosts, an empty table: as in ``quality``; no row is kept without a text.
    """
    rows, losses = _judged(docs, F.lit(None).cast("int"), text, host, least_texts, share, min_left, min_words)
    failed = rows.where("__base_failed").select("__host", "__text").distinct().withColumn("__failed", F.lit(True))
    verdicts = written(losses.select("__host", "__text", "__gone", "__depleted").join(failed, ["__host", "__text"], "full"), "quality-verdicts")
    whole = docs.select(F.struct("*").alias("row"), F.col(text).alias("__body"), F.col(host).alias("__from"))
    whole = whole.select("row", "__body", *(c.alias(k) for k, c in _keys("__body", "__from").items()))
    good = _spread(whole, verdicts, ["__host", "__text"], "left").where("not coalesce(__failed, false) and not coalesce(__depleted, false)")
    left = F.filter(F.split("__body", "\n"), lambda x: (F.length(F.translate(x, SPACES, "")) == 0) | ~F.array_contains("__gone", F.xxhash64(normal_line(x))))
    body = F.when(F.col("__gone").isNull(), F.col("__body")).otherwise(F.array_join(left, "\n"))
    return good.select(*((body if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns))
