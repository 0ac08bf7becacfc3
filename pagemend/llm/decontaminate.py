"""Benchmark decontamination by winnowing, with DataFrame operations only.

Every run of ``K`` words is hashed; of each ``WINDOW - K + 1`` neighbouring hashes the smallest is a fingerprint.  Two texts
that share a window of ``WINDOW`` words share all hashes inside it and so its smallest one: no shared span of that length is
missed.  Test-side fingerprints are joined to the training side's; each hit is then extended to its whole window and compared
word by word, so no hash collision counts.  Items of fewer words than a window are one window of their own length, hashed whole.

A training text is identified by (id, hash of the text): repeated rows give one result row, null ids are kept.  Null and empty
texts have no words.  Items with a null id count as hits and are left out of item lists.  Overlapping hits count each word once.

The only things broadcast are benchmark windows and ids of hit documents, their bytes summed up first; above ``BROADCAST_BYTES`` the joins shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_BYTES, identity, settle, small, table

#: Words of a window.
WINDOW = 10
#: Words of a hashed run.
K = 5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z only; an empty array for null."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(low, _BETWEEN), "")


def grams(words: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words, in order; empty if there are fewer words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def winnow(words: Column, window: int = WINDOW, k: int = K) -> Column:
    """For each window of words the smallest hash of its runs of ``k``: element ``a`` belongs to the window that starts at word ``a``."""
    span = window - k + 1
    return let(
        grams(words, k),
        lambda h: F.when(F.size(h) >= span, F.transform(F.sequence(F.lit(1), F.size(h) - (span - 1)), lambda i: F.array_min(F.slice(h, i, span)))).otherwise(F.array().cast("array<bigint>")),
    )


def marks(words: Column, length: int, window: int, k: int) -> Column:
    return winnow(words, window, k) if length == window else grams(words, length)


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int, k: int) -> DataFrame:
    """(item_id, length, mark, said): every window of every item, ``said`` being its words joined by a space."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    items = items.withColumn("length", F.least(F.size("w"), F.lit(window)))

    def windows(w, length):
        starts = F.sequence(F.lit(1), F.size(w) - (length - 1))
        return F.arrays_zip(marks(w, length, window, k).alias("mark"), F.transform(starts, lambda i: F.array_join(F.slice(w, i, length), " ")).alias("said"))

    every = reduce(lambda rest, n: rest.when(F.col("length") == n, windows(F.col("w"), n)), range(2, window + 1), F.when(F.col("length") == 1, windows(F.col("w"), 1)))
    return items.select("item_id", "length", F.explode(every).alias("x")).select("item_id", "length", F.col("x.mark").alias("mark"), F.col("x.said").alias("said")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(doc_id, text_hash, n_words, n_hit, items array<string>)``: one row per distinct (id, text), hit or not."""
    items = settle(item_windows(benchmark, item_id, item_text, window, k))
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # at most `window` numbers
    source = docs.select(F.col(doc_id).alias("doc_id"), *identity(doc_id, doc_text), F.col(doc_text).alias("text"))

    # 1. fingerprints of all texts against those of all items
    wanted = small(settle(items.select("length", "mark").distinct()), broadcast_bytes)
    prints_of = lambda n: F.transform(F.array_distinct(marks(F.col("w"), n, window, k)), lambda m: F.struct(F.lit(n).alias("length"), m.alias("mark")))
    prints = F.concat(*map(prints_of, lengths)) if lengths else F.array().cast("array<struct<length:int,mark:bigint>>")
    split = source.select("doc_id", "key", "text_hash", F.explode(F.array(words_of(F.col("text")))).alias("w"))
    printed = split.select("doc_id", "key", "text_hash", F.size("w").cast("long").alias("n_words"), F.explode_outer(prints).alias("p"))
    met = printed.join(wanted.withColumn("met", F.lit(1)), (F.col("p.length") == F.col("length")) & (F.col("p.mark") == F.col("mark")), "left")
    every = settle(met.groupBy("key", "text_hash").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count("met").alias("met")))

    # 2. the texts that met one: extend each hit to its window and compare the words
    hit = small(settle(every.where("met > 0").select("key", "text_hash")), broadcast_bytes)
    near = source.join(hit, ["key", "text_hash"], "left_semi").dropDuplicates(["key", "text_hash"]) if lengths else source.limit(0)
    near = near.select("key", "text_hash", F.explode(F.array(words_of(F.col("text")))).alias("w"))

    def spots(n):
        return F.when(
            F.size("w") >= n,
            F.transform(marks(F.col("w"), n, window, k), lambda m, i: F.struct(F.lit(n).alias("length"), m.alias("mark"), i.cast("long").alias("at"), F.array_join(F.slice(F.col("w"), i + 1, n), " ").alias("said"))),
        ).otherwise(F.array().cast("array<struct<length:int,mark:bigint,at:bigint,said:string>>"))

    every_spot = F.concat(*[spots(n) for n in lengths]) if lengths else F.array().cast("array<struct<length:int,mark:bigint,at:bigint,said:string>>")
    spot = near.select("key", "text_hash", F.explode(every_spot).alias("s")).select("key", "text_hash", "s.*")
    texts = small(settle(items.select("length", "mark", "said").distinct()), broadcast_bytes)
    shared = settle(spot.join(texts, ["length", "mark", "said"], "left_semi"))

    order = W.partitionBy("key", "text_hash").orderBy("at", "length")
    before = F.max(F.col("at") + F.col("length")).over(order.rowsBetween(W.unboundedPreceding, -1))
    covered = shared.select("key", "text_hash", F.greatest(F.lit(0), F.col("at") + F.col("length") - F.greatest("at", F.coalesce(before, F.lit(0)))).alias("new"))
    hits = covered.groupBy("key", "text_hash").agg(F.sum("new").alias("n_hit"))
    whose = shared.select("key", "text_hash", "length", "mark", "said").distinct().join(small(items, broadcast_bytes), ["length", "mark", "said"]).select("key", "text_hash", "item_id").distinct()
    lists = whose.groupBy("key", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = every.join(hits, ["key", "text_hash"], "left").join(lists, ["key", "text_hash"], "left")
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a window of a benchmark item; all columns stay."""
    found = settle(contamination(docs, benchmark).where("n_hit > 0").select(*identity("doc_id", "text")[:1], "text_hash"))
    bad = small(found.select(F.col("key").alias("__key"), F.col("text_hash").alias("__hash")))
    key, text_hash = identity("doc_id", "text")
    return docs.join(bad, (key == F.col("__key")) & (text_hash == F.col("__hash")), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of all documents against all benchmark items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark)
  WHERE len(w) > 0
), bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS said FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)
), dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS said FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)
), h AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, said)
), c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
