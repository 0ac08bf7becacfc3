"""Suspicion, votes and consensus repair of single lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import EDIT


def suspect_reasons(lines: DataFrame, lexicon: DataFrame | None, key: str = "line_id") -> DataFrame:
    """``lines`` (with an array ``whole_candidates``) plus ``reasons``: why a line deserves a second look, in fixed order.

    The lexicon is met by a join of the distinct odd tokens; without one there is no dictionary reason.
    """
    lines = T.pinned(lines, "__spelled", spelled())
    checks = [
        F.when(F.col("__spelled.exact") > 1, F.lit("whole_pass_disagreement")), F.when(F.col("__spelled.plain") < F.col("__spelled.exact"), F.lit("diacritic_disagreement")),
        F.when(F.col("conf") < 82, F.lit("low_word_conf")), F.when(T.garbage_score(F.col("text")) >= 4, F.lit("glyph_garbage")),
    ]
    if lexicon is None:
        return lines.withColumn("reasons", F.array_compact(F.array(*checks))).drop("__spelled")
    marked = unknown_tokens(lines, lexicon, key)
    odd = F.when(F.col("odd").isNotNull(), F.concat(F.lit("non_dictionary:"), F.array_join(F.slice("odd", 1, 4), ",")))
    return lines.join(marked, key, "left").withColumn("reasons", F.array_compact(F.array(*checks, odd))).drop("odd", "__spelled")


def unknown_tokens(lines: DataFrame, lexicon: DataFrame, key: str = "line_id") -> DataFrame:
    """``(key, odd)``: cores of three and more characters without a digit that the lexicon lacks, in order, repeats kept."""
    cores = lines.select(key, F.posexplode(F.transform(T.tokens(F.col("text")), T.token_core)).alias("at", "core"))
    cores = cores.where((F.length("core") >= 3) & ~F.col("core").rlike(r"\p{Nd}"))
    missing = cores.join(lexicon.select(F.col("word").alias("core")), "core", "left_anti")
    return missing.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "core"))), lambda x: x["core"]).alias("odd"))


def spelled() -> Column:
    """How many distinct spellings the candidates have, with and without diacritics; equal texts are folded once."""
    said = F.array_distinct(F.filter(F.transform("whole_candidates", lambda c: c["text"]), lambda t: t != ""))
    folded = T.let(F.array_distinct(F.transform(said, T.fold)), lambda e: F.struct(F.size(e).alias("exact"), F.size(F.array_distinct(F.transform(e, lambda t: T.fold(T.strip_accents(t))))).alias("plain")))
    return folded


def spellings(lines: DataFrame, key: str = "line_id") -> DataFrame:
    """Distinct spellings of a line's candidates, with and without diacritics."""
    return T.pinned(lines, "__spelled", spelled()).select(key, F.col("__spelled.exact").alias("exact"), F.col("__spelled.plain").alias("plain"))


def aligned_tokens(current: Column, candidate: Column) -> Column:
    """Pairs (old, new) of differing tokens at the same place, ``at``; none if the counts differ, and no work for equal texts."""

    def pairs(t):
        zipped = F.transform(F.arrays_zip(t["old"].alias("old"), t["new"].alias("new")), lambda p, at: F.struct(p["old"].alias("old"), p["new"].alias("new"), at.alias("at")))
        return F.when(F.size(t["old"]) == F.size(t["new"]), F.filter(zipped, lambda p: p["old"] != p["new"]))

    return F.when(current != candidate, T.let(F.struct(T.tokens(current).alias("old"), T.tokens(candidate).alias("new")), pairs))


def token_votes(lines: DataFrame, candidates: DataFrame, key: str = "line_id", trust: float = 85.0) -> DataFrame:
    """``(key, old, new, votes, sources, first)``: how often candidates spell a token otherwise.

    Each occurrence votes.  A spelling of another shape counts only from candidates of confidence ``trust`` or more.
    ``candidates`` has ``cand_order`` (whole before line, in pass order), ``source``, ``text``, ``conf``.
    """
    both = candidates.where("text <> ''").select(key, "cand_order", "source", "conf", F.col("text").alias("cand")).join(lines.select(key, F.col("text").alias("current")), key)
    pairs = both.select(key, "cand_order", "source", "conf", F.explode(aligned_tokens(F.col("current"), F.col("cand"))).alias("p")).select(key, "cand_order", "source", "conf", "p.*")
    return counted(pairs, key, trust)


def own_votes(lines: DataFrame, key: str = "line_id", trust: float = 85.0, others: Column | None = None) -> DataFrame:
    """``token_votes`` of the lines' own ``whole_candidates`` (of ``others``, if given): nothing is joined, only differing tokens leave the row."""
    held = F.transform("whole_candidates" if others is None else others, lambda c, n: F.struct(n.alias("cand_order"), c["source"].alias("source"), c["conf"].alias("conf"), c["text"].alias("text")))
    each = lines.select(key, F.col("text").alias("current"), F.explode(F.filter(held, lambda c: (c["text"] != "") & (c["text"] != F.col("text")))).alias("c"))
    pairs = each.select(key, "c.cand_order", "c.source", "c.conf", F.explode(aligned_tokens(F.col("current"), F.col("c.text"))).alias("p")).select(key, "cand_order", "source", "conf", "p.*")
    return counted(pairs, key, trust)


def counted(pairs: DataFrame, key: str, trust: float) -> DataFrame:
    cores = pairs.withColumns({"a": T.token_core(F.col("old")), "b": T.token_core(F.col("new"))})
    valid = cores.where((F.col("a") != "") & (F.col("b") != "") & ((F.col("conf") >= trust) | (T.strip_accents(F.col("a")) == T.strip_accents(F.col("b")))))
    return valid.groupBy(key, "old", "new").agg(F.count("*").alias("votes"), F.array_sort(F.collect_set("source")).alias("sources"), F.min(F.struct("cand_order", "at")).alias("first"))


def shape_votes(lines: DataFrame, key: str = "line_id") -> DataFrame:
    """Votes of the lines' own candidates between spellings of one shape, whatever the candidate's confidence."""
    each = lines.select(key, F.col("text").alias("current"), F.explode(F.filter(F.transform("whole_candidates", lambda c: c["text"]), lambda t: t != F.col("text"))).alias("cand"))
    pairs = each.select(key, F.explode(aligned_tokens(F.col("current"), F.col("cand"))).alias("p")).select(key, "p.old", "p.new")
    cores = pairs.withColumns({"a": T.token_core(F.col("old")), "b": T.token_core(F.col("new"))})
    return cores.where((F.col("a") != "") & (F.col("b") != "") & (T.strip_accents(F.col("a")) == T.strip_accents(F.col("b")))).groupBy(key, "old", "new").agg(F.count("*").alias("votes"))


def decide(votes: DataFrame, lexicon: DataFrame | None, at_least: int = 3, margin: int = 4) -> DataFrame:
    """Votes with the ``reason`` that allows the repair; others go."""
    rows = votes.where(F.col("votes") >= at_least).withColumns({"old_core": T.token_core(F.col("old")), "new_core": T.token_core(F.col("new"))})
    if lexicon is not None:
        known = lambda c: lexicon.select(F.col("word").alias(c), F.lit(True).alias(f"{c}_known"))
        rows = rows.join(known("old_core"), "old_core", "left").join(known("new_core"), "new_core", "left")
        repaired = F.col("old_core_known").isNull() & F.col("new_core_known")
    else:
        repaired = F.lit(False)
    enough = F.col("votes") >= margin
    reason = (
        F.when(repaired, F.lit("invalid_to_valid_visual_consensus"))
        .when(T.diacritic_only(F.col("old_core"), F.col("new_core")) & enough, F.lit("valid_diacritic_visual_margin"))
        .when((F.lower("old") != F.lower("new")) & (F.col("old_core") == F.col("new_core")) & enough, F.lit("case_visual_consensus"))
    )
    return rows.withColumn("reason", reason).where("reason is not null").select(*votes.columns, "reason")


def refine(lines: DataFrame, votes: DataFrame, lexicon: DataFrame | None, key: str = "line_id") -> DataFrame:
    """``lines`` with repaired ``text`` and the ``edits`` made, in order of votes (ties: first seen).

    Each repair applies to the text that earlier ones left, and only if its old token occurs there exactly once.
    """
    decided = decide(votes, lexicon)
    plan = decided.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("rank"), "first", "old", "new", "reason", "sources"))).alias("plan"))
    start = F.struct(F.col("text").alias("text"), F.array().cast(f"array<{EDIT}>").alias("edits"))

    def step(state, vote):
        edit = F.struct(F.lit("replace_token").alias("action"), vote["old"].alias("old"), vote["new"].alias("new"), vote["reason"].alias("reason"), vote["sources"].alias("sources")).cast(EDIT)
        changed = F.struct(T.replace_once(state["text"], vote["old"], vote["new"]).alias("text"), F.concat(state["edits"], F.array(edit)).alias("edits"))
        return F.when(T.spelled_once(state["text"], vote["old"]), changed).otherwise(state)

    done = T.pinned(lines.join(plan, key, "left"), "done", F.aggregate(F.coalesce("plan", F.expr("cast(array() as array<struct<rank:bigint,first:struct<cand_order:int,at:int>,old:string,new:string,reason:string,sources:array<string>>>)")), start, step))
    return done.withColumns({"text": F.col("done.text"), "edits": F.col("done.edits")}).drop("plan", "done")
