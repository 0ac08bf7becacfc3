"""Corrections put back into the text of a book."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def replacements(changed: DataFrame, book: str, order: str) -> DataFrame:
    """``(book, place, old, new)``: of several corrections of one target the last counts, at the place of the first."""
    return changed.groupBy(book, F.col("output_line").alias("old")).agg(F.min(order).alias("place"), F.max_by("corrected", order).alias("new"))


def patch(texts: DataFrame, changes: DataFrame, book: str) -> DataFrame:
    """``(book, text, patched, missed)``: corrections applied in order, each only where its target occurs once by then.

    A book's text is one value; the fold over its corrections stays inside one expression, and books are independent.
    """
    plan = changes.groupBy(book).agg(F.array_sort(F.collect_list(F.struct("place", "old", "new"))).alias("plan"))
    rows = texts.join(plan, book, "left")
    start = F.struct(F.col("text").alias("text"), F.lit(0).cast("long").alias("patched"), F.lit(0).cast("long").alias("missed"))

    def step(state, change):
        hit = F.struct(T.replace_once(state["text"], change["old"], change["new"]).alias("text"), (state["patched"] + 1).alias("patched"), state["missed"].alias("missed"))
        miss = F.struct(state["text"].alias("text"), state["patched"].alias("patched"), (state["missed"] + 1).alias("missed"))
        return F.when(T.spelled_once(state["text"], change["old"]), hit).otherwise(miss)

    done = T.pinned(rows, "done", F.when(F.col("plan").isNull(), start).otherwise(F.aggregate(F.coalesce("plan", F.array().cast(plan.schema["plan"].dataType)), start, step)))
    return done.select(book, "done.*")
