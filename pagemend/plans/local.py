"""The whole local run as one chain of tables: readings, health, retry, choice, repair, cleanup, text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import HealthThresholds
from ..operators import align, cleanup, health, lines, refine, review
from .stages import stage

SIDE = ["book", "page", "side"]


@dataclass
class LocalRun:
    """Tables of a run, written at the boundaries of stages, since engines are behind them."""

    evidence: DataFrame
    before: DataFrame
    after: DataFrame
    refined: DataFrame
    candidates: DataFrame
    readings: DataFrame
    judged: DataFrame
    headers: DataFrame
    paragraphs: DataFrame
    texts: DataFrame

    def again(self) -> DataFrame:
        """The second readings of single lines as arrays: (line_id, line_candidates)."""
        return align.gather(self.candidates.where("cand_order >= 1000"), "line", "line_candidates")

    def health_audit(self) -> DataFrame:
        return health.rescues(self.before, self.after, SIDE)

    def refine_audit(self) -> DataFrame:
        return review.audit(self.refined, self.readings)

    def review(self) -> DataFrame:
        return review.review_lines(self.refined, self.candidates)

    def side_review(self) -> DataFrame:
        return review.review_sides(self.after)

    def cleanup_audit(self) -> DataFrame:
        return cleanup.drops(self.judged, SIDE)

    def summary(self) -> DataFrame:
        """One row of counts."""
        sides = self.health_audit().agg(F.count("*").alias("sides_in"), F.count_if("fallback_used").alias("fallback_triggered"), F.count_if("rescued").alias("fallback_rescued"), F.count_if("catastrophic").alias("fallback_unresolved"))
        out = self.paragraphs.select(*SIDE).distinct().agg(F.count("*").alias("sides_out"))
        edits = self.refined.agg(F.count_if(F.size("reasons") > 0).alias("refine_items"), F.coalesce(F.sum(F.size("edits")), F.lit(0)).alias("edits"))
        flags = self.review().agg(F.count("*").alias("line_flags"))
        dropped = self.judged.agg(F.count_if(F.col("reason").isNotNull()).alias("drops"))
        heads = self.headers.agg(F.count("*").alias("repeated_headers"))
        row = sides
        for other in (out, edits, flags, dropped, heads):  # single rows
            row = row.crossJoin(other)
        return row.withColumn("review_flags", F.col("line_flags") + F.col("fallback_unresolved")).drop("line_flags")


def run_local(provider, sides: DataFrame, lexicon: DataFrame, thresholds: HealthThresholds = HealthThresholds(), similarity=None) -> LocalRun:
    """``sides`` has book, page, side.  Engines are asked for collapsed sides and suspect lines only."""
    base = stage(provider.read_sides(sides, SIDE))
    facts = health.lexicon_facts(lexicon)
    has_words = facts[0]

    def report(evidence):
        return health.side_health(health.pass_health(evidence, lexicon, SIDE, facts), health.cross_similarity(evidence, SIDE, similarity), sides, SIDE, thresholds)

    before = stage(report(base))
    evidence = stage(base.unionByName(provider.read_fallback(before.where("catastrophic"), SIDE)))
    after = stage(report(evidence))
    chosen = after.where("best_source is not null").select(*SIDE, F.col("best_source").alias("source"), "catastrophic")
    anchor = lines.anchors(evidence.join(chosen, [*SIDE, "source"])).withColumnRenamed("source", "selected_pass")
    anchor = stage(anchor.withColumn("line_id", F.concat_ws("/", "book", "line_id")))
    readings = stage(align.align(anchor, evidence, SIDE))
    whole = align.gather(readings, "whole", "whole_candidates")
    empty = F.expr("cast(array() as array<struct<source:string,kind:string,text:string,conf:double,scale:double,psm:int>>)")
    held = anchor.join(whole, "line_id", "left").withColumn("whole_candidates", F.coalesce("whole_candidates", empty))
    flagged = refine.suspect_reasons(held, lexicon if has_words else None)
    suspects = stage(flagged.withColumn("reasons", F.when(F.col("catastrophic"), F.array_append("reasons", F.lit("whole_side_catastrophe"))).otherwise(F.col("reasons"))))
    asked = stage(suspects.where("size(reasons) > 0 and not catastrophic"))
    again = stage(provider.read_lines(asked))
    ordered = stage(readings.withColumn("cand_order", F.col("pass_order")).unionByName(again.withColumn("cand_order", F.col("pass_order") + 1000)))
    mine = ordered.join(asked.select("line_id"), "line_id", "left_semi")
    repaired = refine.refine(asked, refine.token_votes(asked, mine), lexicon if has_words else None)
    still = suspects.join(asked.select("line_id"), "line_id", "left_anti").withColumn("edits", F.expr("cast(array() as array<struct<action:string,old:string,new:string,reason:string,sources:array<string>>>)"))
    refined = stage(repaired.unionByName(still))
    numbered = cleanup.numbered(refined, SIDE)
    headers = stage(cleanup.repeated_headers(numbered, chosen, "book"))
    judged = stage(cleanup.dispositions(numbered, headers, "book"))
    pars = stage(cleanup.paragraphs(judged.where("reason is null"), SIDE))
    texts = cleanup.book_texts(cleanup.side_texts(pars, SIDE, cleanup.side_tag(F.col("page"), F.col("side"))), "book", ["page", "side"])
    return LocalRun(evidence, before, after, refined, ordered, readings, judged, headers, pars, texts)
