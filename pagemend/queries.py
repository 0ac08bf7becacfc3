"""One query for each operator over the document tables; ``oracles.py`` states the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from . import oracles
from .config import LINE_PASSES, WHOLE_PASSES
from .functions import numbers
from .functions import text as T
from .operators import align, cleanup, gate, health, lines, patch, queue, refine, review
from .plans.providers import pass_table
from .plans.stages import stage
from .sinks import epub
from .sources import json_files, lexicon, marker_text, tsv

DOC = ["doc_id"]


def pass_health(spark: SparkSession, d: str) -> DataFrame:
    return health.pass_health(A.evidence(spark, d), A.lexicon(spark, d), DOC)


def pass_health_no_lexicon(spark, d):
    return health.pass_health(A.evidence(spark, d), A.lexicon(spark, d).limit(0), DOC)


def best_pass(spark, d):
    return health.best_pass(pass_health(spark, d), DOC).select("doc_id", "source", "score")


def chosen_pass_counts(spark, d):
    return best_pass(spark, d).groupBy("source").agg(F.count("*").alias("sides"))


def length_ratio(left, right):
    """A similarity that SQL has too: shorter length over longer."""
    return F.least(F.length(left), F.length(right)) / F.greatest(F.length(left), F.length(right))


def _reports(spark, d, evidence, similarity=length_ratio, sides=None):
    sides = A.table(spark, d, "documents").select("doc_id") if sides is None else sides
    return health.side_health(health.pass_health(evidence, A.lexicon(spark, d), DOC), health.cross_similarity(evidence, DOC, similarity), sides, DOC)


def side_health(spark, d):
    return _reports(spark, d, A.evidence(spark, d)).select("doc_id", "catastrophic", "best_source", "cross_pass_similarity", F.array_join("reasons", ",").alias("reasons"))


def rescue_counts(spark, d):
    """Sides judged by three readings, then by all five."""
    first = A.evidence(spark, d).where("pass_order >= 3")
    rows = health.rescues(_reports(spark, d, first), _reports(spark, d, A.evidence(spark, d)), DOC)
    return rows.agg(F.count("*").alias("sides"), F.count_if("fallback_used").alias("triggered"), F.count_if("rescued").alias("rescued"), F.count_if("catastrophic").alias("unresolved"))


def cross_pass_similarity(spark, d):
    return health.cross_similarity(A.evidence(spark, d), DOC)


def side_scores(spark, d):
    return health.side_score(A.evidence(spark, d), DOC)


def _noisy(spark, d):
    return _reports(spark, d, A.noisy_evidence(spark, d))


def collapsed_sides(spark, d):
    """Sides that a second way of reading is asked for."""
    return _noisy(spark, d).where("catastrophic").select("doc_id", "best_source", F.array_join("reasons", ",").alias("reasons"))


def _collapsed(spark, d):
    """The ids of collapsed sides, judged once for all that is asked of them."""
    return stage(_noisy(spark, d).where("catastrophic").select("doc_id"))


def _union(spark, d, collapsed):
    """Evidence of all sides with second readings of the collapsed ones."""
    again = A.evidence(spark, d).where("pass_order >= 3").withColumns({"source": F.concat(F.lit("fallback_"), "source"), "pass_order": F.col("pass_order") + 5})
    return A.noisy_evidence(spark, d).unionByName(again.join(collapsed, "doc_id", "left_semi"))


def evidence_union(spark, d):
    return _union(spark, d, collapsed_sides(spark, d).select("doc_id")).groupBy("doc_id", "source").agg(F.count("*").alias("lines"), F.sum("conf").alias("conf_sum"))


def rescued_sides(spark, d):
    """Every side that was collapsed, and whether its second readings rescued it; only these sides are judged again."""
    held = _collapsed(spark, d)
    after = _reports(spark, d, _union(spark, d, held).join(held, "doc_id", "left_semi"), sides=held)
    return health.rescues(held.withColumn("catastrophic", F.lit(True)), after, DOC).select("doc_id", "rescued", "catastrophic")


def side_reviews(spark, d):
    return review.review_sides(_noisy(spark, d)).select("doc_id", "action", "reason", F.col("best_source").alias("selected_pass"))


def _asked(spark, d, collapsed):
    """Suspect lines of sides that are not collapsed."""
    held = refine.suspect_reasons(A.consensus_lines(spark, d), None).where("size(reasons) > 0")
    return held.join(collapsed, "doc_id", "left_anti")


def asked_lines(spark, d):
    return _asked(spark, d, collapsed_sides(spark, d).select("doc_id")).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("row_no").alias("rows_sum"))


def merged_lines(spark, d):
    """Asked lines repaired by their readings, among the others, which have no votes and so stay as they are."""
    asked = _asked(spark, d, _collapsed(spark, d))
    return refine.refine(A.consensus_lines(spark, d), refine.own_votes(asked), None).select("doc_id", "line_id", "text", F.size("edits").cast("long").alias("n_edits"))


def report_json(spark, d):
    """Reports as the JSON of an audit, read back by path."""
    rows = _noisy(spark, d).select("doc_id", F.to_json(F.struct("catastrophic", "best_source", "cross_pass_similarity", "reasons", "passes"), {"ignoreNullFields": "false"}).alias("j"))
    at = lambda path, kind: F.get_json_object("j", path).cast(kind)
    return rows.select("doc_id", at("$.catastrophic", "boolean").alias("catastrophic"), at("$.best_source", "string").alias("best_source"), at("$.cross_pass_similarity", "double").alias("similarity"), at("$.passes[0].source", "string").alias("first_source"), at("$.passes[4].words", "long").alias("last_words"), F.size(F.from_json(F.get_json_object("j", "$.reasons"), "array<string>")).cast("long").alias("n_reasons"))


def average_confidences(spark, d):
    """Mean confidence of each reading's rows that say something."""
    return health.reading_texts(A.noisy_evidence(spark, d), DOC).select("doc_id", "source", numbers.rounded(F.when(F.col("conf_n") > 0, F.col("conf_sum") / F.col("conf_n")).otherwise(F.lit(0.0)), 4).alias("average_confidence"))


def tsv_words(spark, d):
    """Words read back from an engine's TSV texts."""
    words = tsv.parse_words(A.tsv_texts(spark, d), DOC)
    return words.groupBy("doc_id", "block", "line").agg(F.count("*").alias("words"), F.sum(F.col("left").cast("long")).alias("left_sum"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]), " ")).alias("text_md5"))


def lexicon_words(spark, d):
    rows = A.table(spark, d, "benchmark").select(F.explode(F.split("text", r"\s")).alias("w"))
    return lexicon.words_from(rows, F.col("w"))


def reply_ops(spark, d):
    """Operations found in noisy replies, by book and item."""
    found = json_files.reply_items(json_files.extract_json(A.replies(spark, d), "reply"), by=("book",))
    first = F.get("ops", F.lit(0))
    return found.select("book", "item_id", F.size("ops").cast("long").alias("n_ops"), first["old"].alias("old"), first["new"].alias("new"), F.get("ops", F.lit(1))["old"].isNull().alias("second_is_none"))


def queue_with_replies(spark, d):
    """The queue with what was answered about its lines; lines without an answer stay."""
    items = queue.queue(_admitted(spark, d), A.page_arrays(spark, d), DOC).select("doc_id", "row_no", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("row_no").cast("string")).alias("item_id"))
    ops = json_files.reply_items(json_files.extract_json(A.replies(spark, d).where("doc_id % 3 <> 0"), "reply"))
    return items.join(ops, "item_id", "left").select("doc_id", "row_no", F.size(F.coalesce("ops", F.array())).cast("long").alias("n_ops"))


def garbage_scores(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.garbage_score(F.col("text")).alias("garbage_score"), T.garbage(F.col("text")).cast("long").alias("weird"), T.visible(F.col("text")).cast("long").alias("visible"))


def token_forms(spark, d):
    """Distinct tokens with core, shape and lexical form."""
    tokens = A.lines(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("times"))
    return tokens.select("token", "times", T.token_core(F.col("token")).alias("core"), T.shape(F.col("token")).alias("shape"), T.lexical(F.col("token")).alias("lexical"), T.diacritic_only(F.col("token"), T.strip_accents(F.col("token"))).alias("accented"))


def words_to_lines(spark, d):
    return lines.words_to_lines(A.word_rows(spark, d), DOC, 2.5).select("doc_id", F.col("row_no").cast("long").alias("row_no"), "text", F.bround("conf", 6).alias("conf"), "x", "y", "w", "h")


def words_to_readings(spark, d):
    return lines.words_to_readings(A.word_rows(spark, d), ["doc_id", "line"]).select("doc_id", "line", "text", F.bround("conf", 6).alias("conf"))


def anchor_lines(spark, d):
    rows = A.furniture_lines(spark, d).withColumns({"page": (F.col("doc_id") % 900).cast("int"), "side": F.when(F.col("doc_id") % 2 == 0, "L").otherwise("R"), "row_no": F.col("row_no") + 1})
    return lines.anchors(rows).select("doc_id", "line_id", "text", "conf")


def crop_boxes(spark, d):
    rows = A.lines(spark, d)
    width, height = F.lit(900) + F.col("doc_id") % 100, F.lit(1400) + F.col("doc_id") % 50
    return rows.select("doc_id", "row_no", *[c.cast("long").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), lines.crop_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), width, height), strict=True)])


def side_jobs(spark, d):
    """How many sides each recognition process would read: sides by passes, chunked in books."""
    sides = A.table(spark, d, "documents").select(A.book(), "doc_id")
    jobs = lines.jobs(sides, pass_table(spark, WHOLE_PASSES).select("name", "pass_order"), 2, ["book"], ["doc_id"])
    return jobs.groupBy("book", "chunk", "name").agg(F.count("*").alias("sides"), F.min("doc_id").alias("first_doc"))


def line_jobs(spark, d):
    suspects = refine.suspect_reasons(A.held_lines(spark, d), None).where("size(reasons) > 0").select("book", "doc_id", "row_no")
    jobs = lines.jobs(suspects, pass_table(spark, LINE_PASSES).select("name", "pass_order"), 28, ["book"], ["doc_id", "row_no"])
    return jobs.groupBy("book", "name").agg(F.count("*").alias("lines"), F.count_distinct("chunk").alias("processes"))


def aligned_candidates(spark, d):
    held = A.held_lines(spark, d).withColumnRenamed("row_no", "at")
    return align.align(held, A.evidence(spark, d), DOC)


def spellings(spark, d):
    return refine.spellings(A.held_lines(spark, d))


def suspect_reasons(spark, d):
    return refine.suspect_reasons(A.held_lines(spark, d), A.lexicon(spark, d)).select("line_id", F.array_join("reasons", "|").alias("reasons"))


def token_votes(spark, d):
    held = A.held_lines(spark, d)
    return refine.own_votes(held, others=F.filter("whole_candidates", lambda c: c["source"] != "p0")).select("line_id", "old", "new", "votes", F.array_join("sources", ",").alias("sources"))


def shape_votes(spark, d):
    return refine.shape_votes(A.held_lines(spark, d))


def _refined(spark, d):
    held = A.consensus_lines(spark, d)
    return refine.refine(held, refine.own_votes(held), None)


def refined_lines(spark, d):
    return _refined(spark, d).select("line_id", "text", F.size("edits").cast("long").alias("n_edits"))


def refined_with_lexicon(spark, d):
    """Repairs of misread words that a word list lacks into words that it holds."""
    held = A.damaged_lines(spark, d)
    done = refine.refine(held, refine.own_votes(held), A.word_list(spark, d))
    return done.select("line_id", "text", F.size("edits").cast("long").alias("n_edits"), F.array_join(F.transform("edits", lambda e: e["reason"]), ",").alias("reasons"))


def review_items(spark, d):
    held = refine.suspect_reasons(A.held_lines(spark, d), None).withColumn("edits", F.array().cast("array<string>"))
    found = review.review_lines(held)
    return found.select("line_id", "conf", F.array_join(F.transform("alts", lambda a: a["text"]), "|").alias("alts"), F.size("alts").cast("long").alias("n_alts"))


def refine_audit(spark, d):
    held = refine.suspect_reasons(_refined(spark, d), None).withColumn("selected_pass", F.lit("q1"))
    return review.audit(held).select("line_id", "before", "after", F.size("edits").cast("long").alias("n_edits"))


def _furniture(spark, d):
    return cleanup.numbered(A.furniture_lines(spark, d), ["book", "doc_id"])


def repeated_headers(spark, d):
    sides = A.table(spark, d, "documents").select(A.book(), "doc_id")
    return cleanup.repeated_headers(_furniture(spark, d), sides, "book")


def cleanup_drops(spark, d):
    judged = cleanup.dispositions(_furniture(spark, d), repeated_headers(spark, d), "book")
    return cleanup.drops(judged, DOC)


def cleanup_reason_counts(spark, d):
    return cleanup_drops(spark, d).groupBy("reason").agg(F.count("*").alias("lines"))


def paragraphs(spark, d):
    return cleanup.paragraphs(A.lines(spark, d), DOC)


def cleaned_text(spark, d):
    tag = F.concat(F.lit("PDF"), F.col("doc_id").cast("string"))
    return cleanup.side_texts(paragraphs(spark, d), DOC, tag).select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


def book_texts(spark, d):
    books = A.table(spark, d, "documents").select("doc_id", A.book())
    sides = cleanup.side_texts(paragraphs(spark, d), DOC, F.concat(F.lit("PDF"), F.col("doc_id").cast("string"))).join(books, "doc_id")
    return cleanup.book_texts(sides, "book", DOC).select("book", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


def marker_sides(spark, d):
    out = marker_text.sides(A.marked_texts(spark, d))
    return out.select(F.col("book").alias("doc_id"), "ord", "page", "side", F.size("paragraphs").cast("long").alias("n_paragraphs"), F.md5(F.array_join("paragraphs", "|")).alias("paragraphs_md5"))


def marker_lines(spark, d):
    out = marker_text.page_lines(A.marked_texts(spark, d))
    return out.select(F.col("book").alias("doc_id"), "page", "side", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "|")).alias("lines_md5"))


def _admitted(spark, d):
    return queue.admit(A.audit_rows(spark, d), A.page_arrays(spark, d), DOC)


def queue_dispositions(spark, d):
    return _admitted(spark, d).select("doc_id", "row_no", "disposition")


def deep_queue(spark, d):
    out = queue.queue(_admitted(spark, d), A.page_arrays(spark, d), DOC)
    return out.select("doc_id", "row_no", "current", "output_line", F.md5("context").alias("context_md5"), F.array_join("candidates", "|").alias("candidates"))


def queue_context(spark, d):
    docs = A.page_arrays(spark, d)
    target = F.coalesce(F.get("lines", F.lit(1)), F.lit("no such line"))
    return docs.select("doc_id", F.md5(queue.context_of(F.col("lines"), target)).alias("context_md5"), F.length(queue.context_of(F.col("lines"), target)).cast("long").alias("n_chars"))


def micro_batches(spark, d):
    talks = A.table(spark, d, "conversations").withColumn("lane", F.expr("conv_id div 64"))
    return queue.batches(talks, 6, ["lane"], ["conv_id", "turn"]).select("conv_id", "turn", "lane", "batch_no")


def prompt_batches(spark, d):
    items = queue.queue(_admitted(spark, d), A.page_arrays(spark, d), DOC).withColumn("item_id", F.format_string("%012d-%06d", "doc_id", "row_no"))
    made = queue.prompts(queue.batches(items, 6, DOC, ["item_id"]), DOC, "item_id")
    return made.select("doc_id", "batch_no", F.startswith("prompt", F.lit(queue.INSTRUCTION)).alias("instructed"), F.size(F.from_json(F.substring_index("prompt", "INPUT:\n", -1), "array<struct<id:string>>")).cast("long").alias("items"))


def gate_required_confidence(spark, d):
    """The table of thresholds for vote counts and shapes."""
    rows = spark.range(12).select((F.col("id") % 4).cast("int").alias("new_votes"), (F.col("id") >= 4).cast("int").alias("k"), (F.col("id") % 8 >= 4).alias("same_shape"), F.when(F.col("id") >= 8, 0.91).otherwise(0.97).alias("base"))
    needs = F.when(F.col("base") == 0.97, gate.required(0.97, F.col("new_votes"), F.col("same_shape"))).otherwise(gate.required(0.91, F.col("new_votes"), F.col("same_shape")))
    return rows.select("new_votes", "same_shape", "base", F.bround(needs, 6).alias("required"))


def gate_apply(spark, d):
    done = gate.apply_ops(A.op_items(spark, d))
    return done.select("doc_id", "row_no", "corrected", F.array_join(F.transform("audit", lambda a: a["gate"]), ",").alias("gates"))


def patched_text(spark, d):
    first = A.lines(spark, d).select("doc_id", F.col("row_no").alias("place"), F.regexp_extract("text", r"[\p{L}]+", 0).alias("output_line")).where("output_line <> ''").withColumn("corrected", F.concat("output_line", F.lit("+")))
    changes = patch.replacements(first, "doc_id", "place")
    texts = A.table(spark, d, "documents").select("doc_id", "text")
    return patch.patch(texts, changes, "doc_id").select("doc_id", F.md5("text").alias("text_md5"), "patched", "missed")


def xhtml_escape(spark, d):
    return A.table(spark, d, "pages").select("page_id", F.md5(T.escape_xml(F.col("html"))).alias("html_md5"), T.safe_name(F.col("url")).alias("name"))


def xhtml_pages(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.select("doc_id", epub.page(F.concat(F.lit("PDF"), F.col("doc_id").cast("string")), F.split("text", "\n")).alias("x")).select("doc_id", F.length("x").cast("long").alias("n_chars"), F.md5("x").alias("xhtml_md5"))


def epub_books(spark, d):
    """Every book made, taken apart again: its pages in reading order and the digest of all their XHTML."""
    docs = A.table(spark, d, "documents").select(A.book(), "doc_id", F.split("text", "\n").alias("paragraphs"))
    made = epub.books(docs, "book", "doc_id", F.concat(F.lit("PDF"), F.col("doc_id").cast("string")), F.col("paragraphs"))
    read = F.udf(epub.read_pages, "array<string>", useArrow=True)
    return made.select("book", "pages", read("epub").alias("x")).select("book", "pages", F.size("x").alias("read"), F.md5(F.array_join("x", "")).alias("xhtml_md5"))


def _replies(spark, d):
    events = A.table(spark, d, "events")
    noisy = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("\x1b[32mok\x1b[0m ```json\n"), F.col("props"), F.lit("\n``` done"))).otherwise(F.concat(F.lit("note [x "), F.col("props"), F.lit(" tail")))
    return events.select("event_id", noisy.alias("reply"))


def extract_json(spark, d):
    return json_files.extract_json(_replies(spark, d), "reply").select("event_id", F.get_json_object("json", "$.k").alias("k"))


def fenced_json(spark, d):
    return _replies(spark, d).select("event_id", json_files.fenced(F.col("reply")).alias("json"))


def clean_confidences(spark, d):
    return A.word_rows(spark, d).groupBy("doc_id").agg(F.sum(T.confidence(F.col("conf"))).alias("conf_sum"), F.count_if(T.confidence(F.col("conf")) >= 0).alias("known"))


def run_summary(spark, d):
    sides = A.table(spark, d, "documents").agg(F.count("*").alias("sides_in"))
    out = paragraphs(spark, d).agg(F.count_distinct("doc_id").alias("sides_out"), F.count("*").alias("paragraphs"))
    drops = cleanup_drops(spark, d).agg(F.count("*").alias("cleanup_drops"))
    heads = repeated_headers(spark, d).agg(F.count("*").alias("repeated_headers"))
    edits = refined_lines(spark, d).agg(F.sum("n_edits").alias("edits"))
    flags = review_items(spark, d).agg(F.count("*").alias("review_flags"))
    row = sides
    for other in (out, drops, heads, edits, flags):  # single rows
        row = row.crossJoin(other)
    return row


NAMES = (
    "collapsed_sides evidence_union rescued_sides side_reviews asked_lines merged_lines report_json average_confidences tsv_words lexicon_words reply_ops queue_with_replies "
    "pass_health pass_health_no_lexicon best_pass chosen_pass_counts side_health rescue_counts cross_pass_similarity side_scores garbage_scores token_forms words_to_lines words_to_readings anchor_lines crop_boxes side_jobs line_jobs "
    "aligned_candidates spellings suspect_reasons token_votes shape_votes refined_lines refined_with_lexicon review_items refine_audit repeated_headers cleanup_drops cleanup_reason_counts paragraphs cleaned_text book_texts marker_sides marker_lines "
    "queue_dispositions deep_queue queue_context micro_batches prompt_batches gate_required_confidence gate_apply patched_text xhtml_escape xhtml_pages epub_books extract_json fenced_json clean_confidences run_summary"
).split()


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracles.SQL.items() if name in NAMES}
