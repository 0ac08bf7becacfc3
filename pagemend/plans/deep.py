"""The correction run: queue, batches, replies, gate, patched text.  Nothing is patched unless every batch was answered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CALLS_AT_ONCE, ITEMS_AT_ONCE, MOST_OPS, SURE
from ..operators import gate, patch, queue
from ..sources import json_files, marker_text
from .stages import stage


@dataclass
class DeepRun:
    admitted: DataFrame
    items: DataFrame
    gated: DataFrame
    patched: DataFrame
    calls: int

    def audit(self) -> DataFrame:
        changed = F.col("corrected") != F.col("current")
        return self.gated.select("item_id", "page", "side", "current", "corrected", F.col("audit").alias("ops"), changed.alias("applied_line"), F.when(changed, "applied").otherwise("no_change").alias("txt_gate"))

    def summary(self) -> DataFrame:
        """One row of counts."""
        skipped = self.admitted.agg(F.count_if(F.col("disposition").isin(*queue.SKIPPED)).alias("skipped_items"))
        audit = self.audit()
        applied = audit.agg(F.count("*").alias("queue_items"), F.count_if("applied_line").alias("applied_lines"), F.coalesce(F.sum(F.when(F.col("applied_line"), F.size(F.filter("ops", lambda o: o["applied"])))), F.lit(0)).alias("applied_ops"))
        lines = self.patched.agg(F.coalesce(F.sum("patched"), F.lit(0)).alias("patched_lines"), F.coalesce(F.sum("missed"), F.lit(0)).alias("missed_lines"))
        return skipped.crossJoin(applied).crossJoin(lines).withColumn("ai_calls", F.lit(self.calls))


def run_deep(provider, audit: DataFrame, texts: DataFrame, at_once: int = ITEMS_AT_ONCE, calls_at_once: int = CALLS_AT_ONCE, sure: float = SURE, most_ops: int = MOST_OPS) -> DeepRun:
    """``audit`` has book, item_id, page, side, reasons, before, after, edits and candidates; ``texts`` has book, text.

    Batches are numbered within a book, so a prompt and its reply meet by (book, batch_no), and an item by (book, item_id).
    """
    side = ["book", "page", "side"]
    pages = marker_text.page_lines(texts)
    admitted = stage(queue.admit(audit, pages, side))
    items = stage(queue.batches(queue.queue(admitted, pages, side), at_once, ["book"], ["item_id"]))
    asked = queue.prompts(items, ["book"], "item_id").repartition(calls_at_once)  # as many calls at once as partitions
    replies = stage(json_files.extract_json(provider.reply(asked), "reply"))
    calls = replies.count()
    if failed := replies.where("json is null").count():
        raise RuntimeError(f"{failed} of {calls} batches were not answered; nothing was written")
    ops = json_files.reply_items(replies, by=("book",))
    none = F.expr("cast(array() as array<struct<kind:string,old:string,new:string,confidence:string>>)")
    gated = stage(gate.apply_ops(items.join(ops, ["book", "item_id"], "left").withColumn("ops", F.coalesce("ops", none)), sure, most_ops))
    changes = patch.replacements(gated.where("corrected <> current"), "book", "item_id")
    return DeepRun(admitted, items, gated, patch.patch(texts, changes, "book"), calls)
