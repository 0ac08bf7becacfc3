"""Audits and the list of what a person should look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded


def alternatives(candidates: DataFrame, key: str = "line_id", most: int = 4) -> DataFrame:
    """The ``most`` candidates of highest confidence of each line; ties stay in candidate order."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("down"), "cand_order", "text", "conf")))
    return candidates.groupBy(key).agg(F.transform(F.slice(ranked, 1, most), lambda c: F.struct(c["text"].alias("text"), rounded(c["conf"], 1).alias("conf"))).alias("alts"))


def own_alternatives(candidates: Column, most: int = 4) -> Column:
    """The same of an array of candidates, in the row."""
    ranked = F.array_sort(F.transform(candidates, lambda c, n: F.struct((-c["conf"]).alias("down"), n.alias("cand_order"), c["text"].alias("text"), c["conf"].alias("conf"))))
    return F.transform(F.slice(ranked, 1, most), lambda c: F.struct(c["text"].alias("text"), rounded(c["conf"], 1).alias("conf")))


def review_lines(lines: DataFrame, candidates: DataFrame | None = None, key: str = "line_id", low: float = 82.0) -> DataFrame:
    """Lines of low confidence, and suspects without an edit, with their best alternatives: of ``candidates``, else of their own arrays."""
    asked = lines.where((F.col("conf") < low) | ((F.size("reasons") > 0) & (F.size("edits") == 0)))
    with_alts = asked.withColumn("alts", own_alternatives(F.col("whole_candidates"))) if candidates is None else asked.join(alternatives(candidates, key), key, "left")
    return with_alts.withColumns({"action": F.lit("review"), "alts": F.coalesce("alts", F.expr("cast(array() as array<struct<text:string,conf:double>>)")), "conf": rounded(F.col("conf"), 2)})


def review_sides(sides: DataFrame) -> DataFrame:
    """Sides that stayed collapsed after the retry."""
    return sides.where("catastrophic").withColumns({"action": F.lit("review_whole_side"), "reason": F.lit("whole_side_catastrophe_after_fallback")})


def audit(lines: DataFrame, readings: DataFrame | None = None, key: str = "line_id") -> DataFrame:
    """Suspect lines as they were (the chosen reading's aligned row of ``readings``, else of their own arrays, else the final text) and as they are."""
    if readings is None:
        was = F.get(F.filter("whole_candidates", lambda c: c["source"] == F.col("selected_pass")), F.lit(0))["text"]
        return lines.where(F.size("reasons") > 0).select(key, "reasons", F.coalesce(was, F.col("text")).alias("before"), F.col("text").alias("after"), "edits")
    before = readings.select(key, F.col("source").alias("selected_pass"), F.col("text").alias("was")).dropDuplicates([key, "selected_pass"])
    return lines.where(F.size("reasons") > 0).join(before, [key, "selected_pass"], "left").select(key, "reasons", F.coalesce("was", "text").alias("before"), F.col("text").alias("after"), "edits")
