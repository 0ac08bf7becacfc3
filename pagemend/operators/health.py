"""Health of each reading, agreement between readings, collapse of a side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import HealthThresholds
from ..functions import text as T
from ..functions.numbers import rounded
from ..functions.similarity import median_ratios


def reading_texts(evidence: DataFrame, side: list[str]) -> DataFrame:
    """The text of each reading: its non-blank rows in order, one a line, with count and sum of known confidences.

    Rows are dealt by side, so whatever is grouped or joined by side afterwards meets without another exchange.
    """
    rows = evidence.select(*side, "source", "pass_order", "row_no", "text", "conf").repartition(*side).withColumn("said", ~T.blank(F.col("text")))
    return rows.groupBy(*side, "source", "pass_order").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("said"), F.struct("row_no", "text")))), lambda r: r["text"]), "\n").alias("text"),
        F.sum(F.when(F.col("said") & (F.col("conf") >= 0), F.col("conf"))).alias("conf_sum"),
        F.count(F.when(F.col("said") & (F.col("conf") >= 0), F.col("conf"))).alias("conf_n"),
    )


#: Bytes up to which a lexicon is broadcast; a larger one is met by a join of distinct words.
LEXICON_BYTES = 32 << 20


def lexicon_facts(lexicon: DataFrame) -> tuple[bool, bool]:
    """Whether there are words (that decides which measures exist), and whether they are few enough to broadcast; one job."""
    n, held = lexicon.agg(F.count("*"), F.sum(F.octet_length("word") + 16)).first()
    return n > 0, (held or 0) <= LEXICON_BYTES


def pass_health(evidence: DataFrame, lexicon: DataFrame, side: list[str], facts: tuple[bool, bool] | None = None) -> DataFrame:
    """Counts, ratios and score of every reading.

    A broadcast lexicon marks each word where it stands; the counts then need no exchange of words.  A larger lexicon joins the
    few distinct cores of each reading, so a frequent word costs one row a reading.
    """
    has_words, few = facts or lexicon_facts(lexicon)
    text, key = F.col("text"), [*side, "source", "pass_order"]
    measured = [F.length(text).alias("length"), F.length(T.strip(text)).alias("chars"), T.visible(text).alias("visible"), T.garbage(text).alias("weird"), T.letters(text).alias("letters")]
    rows = reading_texts(evidence, side).select(*key, "conf_sum", "conf_n", *measured, T.words(text).alias("found"))
    key = [*key, "conf_sum", "conf_n", "length", "chars", "visible", "weird", "letters"]
    words = rows.select(*key, F.explode_outer("found").alias("word")).select(*key, "word", T.token_core(F.col("word")).alias("core"))
    words = words.select(*key, F.length("core").alias("n"), F.when((F.length("core") >= 3) & ~F.col("word").rlike(r"\p{Nd}"), F.col("core")).alias("core"))
    known = lexicon.select(F.col("word").alias("core"), F.lit(1).alias("known"))
    if few:
        met = words.select(*key, "core", F.col("n").isNotNull().cast("int").alias("times"), (F.col("n") <= 2).cast("int").alias("short")).join(F.broadcast(known), "core", "left")
    else:
        met = words.groupBy(*key, "core").agg(F.count("n").alias("times"), F.count_if(F.col("n") <= 2).alias("short")).join(known, "core", "left")
    total = lambda column, name: F.coalesce(F.sum(column), F.lit(0)).alias(name)
    tallies = met.groupBy(*key).agg(total("times", "words"), total("short", "short"), total(F.when(F.col("core").isNotNull(), F.col("times")), "eligible"), total(F.when(F.col("known") == 1, F.col("times")), "hits"))
    return tallies.select(*side, "source", "pass_order", *health_columns(has_words))


def health_columns(has_lexicon: bool) -> list[Column]:
    """Rounded measures and score from the integer counts of a reading."""
    per = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    conf = F.when(F.col("conf_n") > 0, F.col("conf_sum") / F.col("conf_n")).otherwise(F.lit(0.0))
    known = F.when((F.col("eligible") > 0) & F.lit(has_lexicon), F.col("hits") / F.nullif(F.col("eligible"), F.lit(0)))
    d = lambda x: F.lit(float(x))
    score = conf * d(0.55) + per("letters", "visible") * d(25) - per("weird", "visible") * d(120) - per("short", "words") * d(12) + F.coalesce(known * d(20), d(0)) + F.least(F.col("length"), F.lit(1600)) / d(1600) * d(5)
    return [
        rounded(score, 4).alias("score"), F.col("chars").cast("long").alias("chars"), F.col("words").cast("long").alias("words"), rounded(conf, 4).alias("average_confidence"),
        rounded(per("weird", "visible"), 5).alias("garbage_ratio"), rounded(per("short", "words"), 5).alias("short_word_ratio"), rounded(known, 5).alias("dictionary_ratio"),
    ]


def best_pass(health: DataFrame, side: list[str]) -> DataFrame:
    """The reading with the highest score, the first in pass order among equals."""
    best = F.max_by(F.struct("source", "pass_order", "score", "chars", "words", "average_confidence", "garbage_ratio", "short_word_ratio", "dictionary_ratio"), F.struct("score", -F.col("pass_order"))).alias("best")
    return health.groupBy(*side).agg(best).select(*side, "best.*")


def cross_similarity(evidence: DataFrame, side: list[str], similarity=None) -> DataFrame:
    """Median similarity of all pairs of non-empty readings of a side; 1 for fewer than two.

    A side's readings (nine at most) are one array, whose pairs are formed in the row, in pass order.  Without a ``similarity`` it is
    the matching-blocks ratio: texts go to Python once each, and only if the pairs of equal texts do not decide the median alone.
    """
    plain = T.squeezed(T.fold(T.strip_accents(F.col("text"))))
    held = reading_texts(evidence, side).select(*side, "pass_order", plain.alias("plain")).groupBy(*side).agg(F.array_sort(F.collect_list(F.when(F.col("plain") != "", F.struct("pass_order", "plain")))).alias("said"))
    if similarity is None:
        texts = T.pinned(held.select(*side, F.transform("said", lambda r: r["plain"]).alias("said")), "texts", F.array_distinct("said"))
        places = T.pinned(texts, "places", F.transform("said", lambda t: F.array_position(F.col("texts"), t)))
        pairs_of = lambda n: n * (n - 1) / 2
        equal = F.aggregate(F.transform("texts", lambda _, i: F.size(F.filter("places", lambda p: p == i + 1))), F.lit(0.0), lambda total, n: total + pairs_of(n))
        asked = T.pinned(places.select(*side, "texts", "places", pairs_of(F.size("places")).alias("n")), "asked", F.when(equal < F.floor(F.col("n") / 2) + 1, F.col("texts")))
        ratios = asked.select(*side, "n", median_ratios(F.when(F.col("n") > 0, F.col("asked")), "places").alias("ratio"))
        return ratios.select(*side, F.coalesce("ratio", F.lit(1.0)).alias("similarity"))
    twos = F.flatten(F.transform("said", lambda a, i: F.transform(F.slice("said", i + 2, F.size("said")), lambda b: F.struct(a["plain"].alias("left"), b["plain"].alias("right")))))
    pairs = held.select(*side, F.explode_outer(twos).alias("p"))
    return pairs.select(*side, similarity(F.col("p.left"), F.col("p.right")).alias("ratio")).groupBy(*side).agg(F.coalesce(F.median("ratio"), F.lit(1.0)).alias("similarity"))


REASONS = ("symbol_soup", "fragmented_words", "lexicon_collapse", "cross_pass_instability", "low_side_confidence")


def collapse_reasons(t: HealthThresholds) -> Column:
    """Names of the thresholds that the best reading of a substantial side misses."""
    enough = (F.col("chars") >= t.min_chars) & (F.col("words") >= t.min_words)
    tests = (
        F.col("garbage_ratio") > t.max_garbage_ratio, F.col("short_word_ratio") > t.max_short_word_ratio, F.coalesce(F.col("dictionary_ratio") < t.min_dictionary_ratio, F.lit(False)),
        F.col("similarity") < t.min_cross_pass_similarity, F.col("average_confidence") < t.min_average_confidence,
    )
    return F.array_compact(F.array(*[F.when(enough & test, F.lit(name)) for name, test in zip(REASONS, tests, strict=True)]))


def collapsed(reasons: Column) -> Column:
    has = lambda name: F.array_contains(reasons, name)
    unsteady = has("cross_pass_instability")
    return (has("symbol_soup") & (has("lexicon_collapse") | unsteady | has("fragmented_words"))) | (unsteady & (has("lexicon_collapse") | has("low_side_confidence"))) | (F.size(reasons) >= 3)


def side_health(health: DataFrame, similarity: DataFrame, sides: DataFrame, side: list[str], thresholds: HealthThresholds = HealthThresholds()) -> DataFrame:
    """Report of every side: collapse, best reading, similarity, reasons and its readings in pass order.

    A side without any reading is collapsed for want of evidence.
    """
    best = best_pass(health, side).join(similarity, side)
    passes = health.groupBy(*side).agg(F.array_sort(F.collect_list(F.struct("pass_order", "source", "score", "chars", "words", "average_confidence", "garbage_ratio", "short_word_ratio", "dictionary_ratio"))).alias("passes"))
    judged = best.select(*side, F.col("source").alias("best_source"), "similarity", collapse_reasons(thresholds).alias("reasons")).withColumn("catastrophic", collapsed(F.col("reasons")))
    whole = sides.select(*side).join(judged, side, "left").join(passes, side, "left")
    none = F.col("best_source").isNull()
    return whole.select(
        *side, F.when(none, F.lit(True)).otherwise(F.col("catastrophic")).alias("catastrophic"), "best_source", F.when(none, F.lit(0.0)).otherwise(rounded(F.col("similarity"), 4)).alias("cross_pass_similarity"),
        F.when(none, F.array(F.lit("no_ocr_evidence"))).otherwise(F.col("reasons")).alias("reasons"), "passes",
    )


def side_score(evidence: DataFrame, side: list[str]) -> DataFrame:
    """A plain score of a reading: mean confidence of its non-blank rows, a bonus for length, minus the garbage score."""
    rows = evidence.groupBy(*side, "source").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "text"))), lambda r: r["text"]), "\n").alias("text"),
        F.avg(F.when(~T.blank(F.col("text")), F.col("conf"))).alias("conf"),
    )
    return rows.select(*side, "source", (F.coalesce("conf", F.lit(0.0)) + F.least(F.length(T.strip(F.col("text"))), F.lit(1800)) / F.lit(1800.0) * F.lit(5.0) - T.garbage_score(F.col("text"))).alias("side_score"))


def rescues(before: DataFrame, after: DataFrame, side: list[str]) -> DataFrame:
    """Whether each side was retried and rescued."""
    later = after.select(*side, F.col("catastrophic").alias("still"))
    return before.select(*side, F.col("catastrophic").alias("fallback_used")).join(later, side).select(*side, "fallback_used", (F.col("fallback_used") & ~F.col("still")).alias("rescued"), F.col("still").alias("catastrophic"))
