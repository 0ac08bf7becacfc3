"""Contiguous balanced shards from global byte-size prefix sums.

Rows are range-partitioned by (hash of the text, hash of the id, id), so equal texts lie together and even a text that a third
of the rows share is spread over many partitions.  Per-partition totals give each partition its offset; a running sum inside
each partition gives every row its place on one line of bytes, which is cut at equal targets.  A cut that would fall inside a
group of equal texts moves to the group's nearer edge, unless the group is larger than the largest row and than 1/32 of a
shard; then the group is split, since keeping it would unbalance the shards.

Null texts count no bytes besides the fixed part and have crc 0; an empty table gives no rows; repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

SHARDS = 40
ROW_BYTES = 16


def place(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """Every row with its size and its first byte ``at`` and row number ``nth`` on the global line."""
    text = F.col(text_col)
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + row_bytes).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.lit(1), F.col(id_col)).alias("spread"),
    )
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(parts, "h", "spread", "doc_id").sortWithinPartitions("h", "spread", "doc_id")
    rows = settle(rows.withColumn("part", F.spark_partition_id()))  # range bounds are sampled: fix the partitions before counting them
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("part").collect()  # one row a partition
    offsets, bytes_so_far, rows_so_far = {}, 0, 0
    for part, size, n in totals:
        offsets[part] = (bytes_so_far, rows_so_far)
        bytes_so_far, rows_so_far = bytes_so_far + size, rows_so_far + n

    def run(batches):
        import pyarrow as pa

        at = nth = None
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("size").to_numpy()
            if at is None:
                at, nth = offsets[batch.column("part")[0].as_py()]
            ends = size.cumsum() + at
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "size", "text_crc32", "h")), pa.array(ends - size, pa.int64()), pa.array(range(nth, nth + len(size)), pa.int64())],
                names=["doc_id", "size", "text_crc32", "h", "at", "nth"],
            )
            at, nth = int(ends[-1]), nth + len(size)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, size long, text_crc32 long, h long, at long, nth long")


def shard(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES, keep_share: int = 32) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` of every row; slots count from 0 in each shard without gaps."""
    placed = settle(place(df, id_col, text_col, row_bytes))
    end, largest = placed.agg(F.max(F.col("at") + F.col("size")), F.max("size")).first()
    if end is None:
        return placed.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    cuts = [end * k // shards for k in range(1, shards)]
    # the row under each cut: shards - 1 rows at most
    under = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: (F.col("at") < c) & (c < F.col("at") + F.col("size")))) > 0 if cuts else F.lit(False)
    edge = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("at") == c)) > 0 if cuts else F.lit(False)
    groups = [r[0] for r in placed.where(under | edge).select("h").distinct().collect()]
    spans = [tuple(r) for r in placed.where(F.col("h").isin(groups)).groupBy("h").agg(F.min("at"), F.max(F.col("at") + F.col("size"))).select("min(at)", "max((at + size))").collect()] if groups else []
    most = max(largest, end // shards // keep_share)
    moved = []
    for cut in cuts:
        lo, hi = next(((a, b) for a, b in spans if a < cut < b), (cut, cut))
        moved.append(cut if hi - lo > most else lo if cut - lo <= hi - cut else hi)
    moved.sort()
    # a row belongs to the shard in which its middle lies
    middle = F.col("at") + (F.col("size") / 2).cast("long")
    number = F.size(F.filter(F.array(*map(F.lit, moved)), lambda c: c <= middle)) if moved else F.lit(0)
    dealt = placed.withColumn("shard", number.cast("int"))
    first = {r[0]: r[1] for r in dealt.groupBy("shard").agg(F.min("nth")).collect()}  # one row a shard
    begins = F.create_map(*[F.lit(x) for k, v in sorted(first.items()) for x in (k, v)])
    return dealt.select("doc_id", "size", "text_crc32", "shard", (F.col("nth") - begins[F.col("shard")]).cast("long").alias("slot"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``bytes``."""
    dealt = shard(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
