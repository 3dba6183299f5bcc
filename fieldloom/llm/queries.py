"""The queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, knlm, mtree, packing, pieces, quality, sharding, simhash, toxicity, wordpiece


#: A public vocabulary; pieces that begin a word have a mark before them.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=8)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), bits=3, shingle=3)


def op3_wordpiece(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"), *wordpiece.read_pieces(vocabulary))


def op4_sentencepiece(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return pieces.round_trips(_table(spark, sf_dir, "documents"), pieces.read_vocabulary(vocabulary))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learned(docs, _table(spark, sf_dir, "labels"), every=5), every=5)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), lengths=(512, 1024, 2048, 4096))


def op7_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_products(_table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op9_knlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knlm.cross_scored(_table(spark, sf_dir, "documents"), order=2, every=10)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    said = F.when(F.col("role") == "assistant", F.length("text")).otherwise(0).cast("double")
    messages = chat.replies(given.unionByName(more).withColumn("score", said), score="score")
    made = chat.chats(messages, "tree", "node", "parent", "role", "text", score="score", best=1)
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform("spans", lambda s: chat.unescape(F.substring(F.col("formatted"), s["begin"] + 1, s["length"])))
    back = made.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", F.array_join(loss, ""))
    return back.select(
        F.col("tree.id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_simhash": op2_simhash,
    "op3_wordpiece": op3_wordpiece,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_mtree": op7_mtree,
    "op8_quality": op8_quality,
    "op9_knlm": op9_knlm,
    "op10_chat": op10_chat,
}

_WS = r"[\x20\x09-\x0D]+"


def _escaped(text: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return reduce(lambda t, c: f"replace({t}, {quote(c)}, {quote(c[0] + chr(92) + c[1:])})", chat.CONTROL, f"replace({text}, '\\', '\\\\')")


ORACLES: dict[str, str] = {
    "op7_mtree": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
""",
    "op8_quality": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '{_WS}'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS ls
  FROM d
), win AS (
  SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), twice AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), rep AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid
), base AS (
  SELECT w.*, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST('0x' || substr(md5(t), 1, 15) AS BIGINT) AS tid
  FROM w LEFT JOIN rep USING (rid)
), line AS (
  SELECT DISTINCT host, tid, l FROM (
    SELECT host, tid, lower(regexp_replace(trim(unnest(ls), ' '), '{_WS}', ' ', 'g')) AS l FROM base)
), sized AS (
  SELECT host, tid, l, len(list_filter(string_split(l, ' '), lambda x: x <> '')) AS n FROM line
), hosts AS (
  SELECT host, count(DISTINCT tid) AS n_texts FROM sized GROUP BY host
), common AS (
  SELECT host, l, min(tid) AS owner FROM sized JOIN hosts USING (host) GROUP BY host, l, n_texts HAVING count(*) > 5 AND count(*) > CAST(0.01 AS DOUBLE) * n_texts
), lost AS (
  SELECT host, tid, count(*) FILTER (owner <> tid) AS n_lines, coalesce(sum(n) FILTER (owner <> tid), 0) AS n_lost, sum(n) AS total
  FROM sized LEFT JOIN common USING (host, l) GROUP BY host, tid
), gone AS (
  SELECT host, tid, n_lines, n_lost, total - n_lost < CAST(0.3 AS DOUBLE) * total OR total - n_lost < 10 AS depleted FROM lost WHERE n_lost > 0
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT coalesce(depleted, false) AS kept,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines_lost, CAST(coalesce(n_lost, 0) AS BIGINT) AS n_words_lost
FROM base LEFT JOIN gone USING (host, tid)
""",
    "op10_chat": rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum({len(chat.TURN) + len(chat.TEXT) + len(chat.END)} + length({_escaped('role')}) + length({_escaped('text')})) AS n
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars
FROM g
""",
}
