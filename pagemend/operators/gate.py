"""The gate of proposed operations: what evidence each needs, and a fold that applies those that pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

RECORD = (
    "struct<kind:string,old:string,new:string,confidence:double,gate:string,applied:boolean,"
    "evidence:struct<old_votes:int,new_votes:int,candidate_count:int,shape_preserving:boolean,segmented:boolean>,required_confidence:double>"
)
NO_RECORDS = f"cast(array() as array<{RECORD}>)"


def cores(text: Column) -> Column:
    return F.filter(F.transform(T.tokens(text), T.token_core), lambda t: t != "")


def holds(candidate: Column, wanted: Column) -> Column:
    """Whether the words of ``wanted`` occur in a row in those of ``candidate`` (both arrays of cores)."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(candidate) - F.size(wanted) + 1))
    return (F.size(wanted) > 0) & (F.size(wanted) <= F.size(candidate)) & F.exists(starts, lambda i: F.slice(candidate, i, F.size(wanted)) == wanted)


def votes(candidates: Column, value: Column) -> Column:
    """Candidates (arrays of cores) that show the value."""
    return T.let(cores(value), lambda wanted: F.size(F.filter(candidates, lambda c: holds(c, wanted))))


def required(base: float, new_votes: Column, same_shape: Column) -> Column:
    """The confidence an operation needs; null if nothing could support it.  All numbers are doubles."""
    d = lambda x: F.lit(float(x))
    eased = lambda floor, step: (lambda t: F.when(same_shape, F.greatest(d(0.90), t - d(0.02))).otherwise(t))(F.greatest(d(floor), d(base) - d(step)))
    return F.when(new_votes >= 2, eased(0.90, 0.05)).when(new_votes == 1, eased(0.92, 0.02)).when(same_shape, F.greatest(d(base), d(0.98)))


def has_space(text: Column) -> Column:
    return text.rlike(f"[{T.SPACE}]")


def occurrences(text: Column, token: Column) -> Column:
    return F.regexp_count(text, T.bounded(token))


def swap(text: Column, old: Column, new: Column) -> Column:
    """Splices ``new`` over the bounded occurrence of ``old``."""
    at = F.regexp_instr(text, T.bounded(old))
    return F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))


def apply_ops(items: DataFrame, min_confidence: float = 0.97, most: int = 3) -> DataFrame:
    """``items`` (current, candidates array<string>, ops array<struct<kind, old, new, confidence string>>) with ``corrected`` and ``audit``.

    The first ``most`` operations are taken in order, each on the text the earlier ones left; evidence is always that of the
    original candidates.  A null operation is recorded as an empty token.
    """
    seen = T.pinned(items, "__cores", F.transform("candidates", cores))
    start = F.struct(F.col("current").alias("text"), F.expr(NO_RECORDS).alias("audit"))

    def read(op):
        old, new = F.coalesce(op["old"], F.lit("")), F.coalesce(op["new"], F.lit(""))
        declared = T.fold(T.strip(F.coalesce(op["kind"], F.lit(""))))
        kind = F.when(declared.isin("replace", "segment"), declared).when(has_space(new), F.lit("segment")).otherwise(F.lit("replace"))
        return F.struct(old.alias("old"), new.alias("new"), kind.alias("kind"), F.coalesce(op["confidence"].try_cast("double"), F.lit(0.0)).alias("confidence"), T.tokens(new).alias("parts"))

    def weigh(state, o):
        """What speaks against the operation before any evidence, and the evidence."""
        splits = F.size(o["parts"]).between(2, 3) & F.forall(o["parts"], lambda p: T.token_core(p) != "")
        early = (
            F.when((o["old"] == "") | (o["new"] == ""), F.lit("empty_token"))
            .when(has_space(o["old"]), F.lit("old_must_be_one_token"))
            .when(o["old"] == o["new"], F.lit("same_value"))
            .when((o["kind"] == "replace") & has_space(o["new"]), F.lit("replace_new_must_be_one_token"))
            .when((o["kind"] == "segment") & ~splits, F.lit("invalid_segmentation"))
            .when(occurrences(state["text"], o["old"]) != 1, F.lit("old_not_unique_token_in_current"))
        )
        same_shape = T.let(F.struct(T.shape(o["old"]).alias("a"), T.shape(o["new"]).alias("b")), lambda s: (s["a"] != "") & (s["a"] == s["b"]))
        proof = F.struct(votes(F.col("__cores"), o["old"]).alias("old_votes"), votes(F.col("__cores"), o["new"]).alias("new_votes"), same_shape.alias("same_shape"))
        # evidence is gathered only for what nothing else speaks against
        return T.let(early, lambda e: T.let(F.when(e.isNull(), proof), lambda p: F.struct(e.alias("early"), p["old_votes"].alias("old_votes"), p["new_votes"].alias("new_votes"), p["same_shape"].alias("same_shape"))))

    def judge(o, e):
        needs = required(min_confidence, e["new_votes"], e["same_shape"])
        late = (
            F.when((o["kind"] == "segment") & (e["new_votes"] == 0) & ~e["same_shape"], F.lit("segmentation_without_visual_or_shape_support"))
            .when(needs.isNull(), F.lit("unsupported_new"))
            .when(o["confidence"] < needs, F.lit("insufficient_confidence_for_evidence"))
        )
        passed = F.when(o["kind"] == "segment", F.when(e["new_votes"] > 0, F.lit("segmentation_evidence")).otherwise(F.lit("segmentation_shape"))).otherwise(F.when(e["new_votes"] > 0, F.lit("ocr_evidence")).otherwise(F.lit("shape_preserving")))
        return F.struct(F.coalesce(e["early"], late, passed).alias("gate"), (e["early"].isNull() & late.isNull()).alias("applied"), needs.alias("needs"))

    def write(state, o, e, v):
        profile = F.struct(e["old_votes"].alias("old_votes"), e["new_votes"].alias("new_votes"), F.size(F.col("__cores")).alias("candidate_count"), e["same_shape"].alias("shape_preserving"), (F.size(o["parts"]) > 1).alias("segmented"))
        record = F.struct(
            o["kind"].alias("kind"), o["old"].alias("old"), o["new"].alias("new"), o["confidence"].alias("confidence"), v["gate"].alias("gate"), v["applied"].alias("applied"),
            F.when(e["early"].isNull(), profile).alias("evidence"), F.when(e["early"].isNull(), v["needs"]).alias("required_confidence"),
        ).cast(RECORD)
        return F.struct(F.when(v["applied"], swap(state["text"], o["old"], o["new"])).otherwise(state["text"]).alias("text"), F.concat(state["audit"], F.array(record)).alias("audit"))

    def step(state, op):
        return T.let(read(op), lambda o: T.let(weigh(state, o), lambda e: T.let(judge(o, e), lambda v: write(state, o, e, v))))

    done = T.pinned(seen, "__done", F.aggregate(F.slice("ops", 1, most), start, step))
    return done.withColumns({"corrected": F.col("__done.text"), "audit": F.col("__done.audit")}).drop("__done", "__cores")
