"""Replies that arrive over time: a stream of reply files is gated micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gate
from ..schemas import REPLY
from ..sources import json_files


def read_replies(spark: SparkSession, folder: str, files_at_once: int = 16) -> DataFrame:
    return spark.readStream.schema(REPLY).option("maxFilesPerTrigger", files_at_once).json(folder)


def gate_stream(replies: DataFrame, items: DataFrame, out: str, checkpoint: str, min_confidence: float = 0.97):
    """Starts a query that appends gated items to Parquet.  A batch is written under its own number, so a retried batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        ops = json_files.reply_items(json_files.extract_json(batch, "reply"))
        done = gate.apply_ops(items.join(ops, "item_id"), min_confidence)
        done.select("item_id", "current", "corrected", "audit", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return replies.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
