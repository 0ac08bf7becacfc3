"""Command line: a local run over a book or over stored evidence, or a correction run over its output."""

from __future__ import annotations

import argparse
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from .plans.deep import run_deep
from .plans.local import run_local
from .plans.providers import EngineProvider, TableProvider, find_program, installed_languages, model_command, require_languages
from .plans.stages import stage
from .sinks import epub, files
from .sinks.logs import RunLog
from .sources import lexicon, marker_text, pdf


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagemend", description="Reads and repairs scanned books.")
    p.add_argument("source", type=Path, help="scanned book; its name gives the names of outputs")
    pages = p.add_argument_group("pages")
    pages.add_argument("--start", type=int, default=61)
    pages.add_argument("--end", type=int, default=100)
    p.add_argument("--output", help="folder of the outputs; beside the book by default")
    local = p.add_argument_group("local run")
    local.add_argument("--tesseract", help="the recognition program; else TESSERACT_CMD or the one on the path")
    local.add_argument("--workers", type=int, help="recognition processes at once; by default one a core")
    local.add_argument("--batch-sides", type=int, default=C.SIDES_AT_ONCE, help="sides that one process reads")
    local.add_argument("--evidence", help="Parquet table of readings, instead of a recognition program")
    local.add_argument("--fallback", help="Parquet table of readings of collapsed sides")
    local.add_argument("--line-evidence", help="Parquet table of readings of single lines")
    local.add_argument("--lexicon", help="text file of words; by default those of the program's language data")
    deep = p.add_argument_group("correction run")
    deep.add_argument("--deep-only", action="store_true", help="correct an earlier local run's output")
    deep.add_argument("--replies", help="Parquet table (batch_no, reply) of model replies, instead of a program")
    deep.add_argument("--model", help="model that the reply program is asked for")
    deep.add_argument("--reply-program", help="the program that answers prompts; else REPLY_PROGRAM or opencode on the path")
    deep.add_argument("--ai-batch-size", type=int, default=C.ITEMS_AT_ONCE)
    deep.add_argument("--ai-workers", type=int, default=C.CALLS_AT_ONCE)
    deep.add_argument("--min-apply-confidence", type=float, default=C.SURE)
    return p


def write_book(spark: SparkSession, title: str, text: str, paths: dict[str, str]) -> None:
    """The text of one book and its e-book."""
    sides = marker_text.sides(spark.createDataFrame([(title, text)], "book string, text string"))
    made = epub.books(sides, "book", "ord", F.format_string("PDF%03d-%s", "page", "side"), F.col("paragraphs")).first()
    files.put(spark, paths["text"], text)
    files.put(spark, paths["book"], bytes(made["epub"]) if made else epub.assemble(title, []))


def words_of(spark: SparkSession, args) -> DataFrame:
    """The given word list, else that of the program's language data, else none."""
    if args.lexicon or args.evidence:
        return lexicon.read_lexicon(spark, args.lexicon) if args.lexicon else spark.createDataFrame([], "word string")
    tools, data = [shutil.which(x) for x in ("combine_tessdata", "dawg2wordlist")], Path(os.environ.get("TESSDATA_PREFIX", "."), "vie.traineddata")
    return lexicon.compiled_lexicon(spark, str(data), *tools) if all(tools) and data.exists() else spark.createDataFrame([], "word string")


def local_run(spark: SparkSession, args, book: str, folder: str, log) -> None:
    paths = C.outputs(C.LOCAL_OUTPUTS, book, folder)
    read = lambda path: spark.read.parquet(path).withColumn("book", F.lit(book)) if path else None
    if args.evidence:
        whole = read(args.evidence).where(F.col("page").between(args.start, args.end))
        provider, sides = TableProvider(whole, read(args.fallback), read(args.line_evidence)), whole.select("book", "page", "side").distinct()
    else:
        program = find_program(args.tesseract, "TESSERACT_CMD", ("tesseract",))
        require_languages(installed_languages(program))
        images = stage(pdf.sides(spark, str(args.source), args.start, args.end).withColumn("book", F.lit(book)))
        provider, sides = EngineProvider(images, program, args.batch_sides, workers=args.workers), images.select("book", "page", "side")
    run = run_local(provider, sides, words_of(spark, args))
    text = run.texts.first()
    write_book(spark, book, text["text"] if text else "", paths)
    for what, df in (("health", run.health_audit()), ("refined", run.refine_audit()), ("review", run.review().drop("whole_candidates")), ("dropped", run.cleanup_audit())):
        files.put(spark, paths[what], files.as_json(df))
    lines = run.refined.select("book", F.col("line_id").alias("item_id"), "page", "side", "reasons", F.col("text").alias("before"), F.col("text").alias("after"), "edits", "whole_candidates")
    again = run.again()
    none = F.slice("whole_candidates", 1, 0)
    lines.join(again, F.col("item_id") == F.col("line_id"), "left").withColumn("line_candidates", F.coalesce("line_candidates", none)).drop("line_id").write.mode("overwrite").parquet(paths["queue"])
    files.put(spark, paths["summary"], files.as_json(run.summary(), whole=True))
    log(f"{book}: local run written to {folder}")


def deep_run(spark: SparkSession, args, book: str, folder: str, log) -> None:
    local, paths = C.outputs(C.LOCAL_OUTPUTS, book, folder), C.outputs(C.DEEP_OUTPUTS, book, folder)
    texts = spark.createDataFrame([(book, files.get(spark, local["text"]))], "book string, text string")
    if args.replies or not (args.model or args.reply_program):
        provider = TableProvider(None, replies=spark.read.parquet(args.replies).withColumn("book", F.lit(book)) if args.replies else None)
    else:
        provider = EngineProvider(None, "", command=model_command(find_program(args.reply_program, "REPLY_PROGRAM", ("opencode",)), args.model))
    run = run_deep(provider, spark.read.parquet(local["queue"]), texts, args.ai_batch_size, args.ai_workers, args.min_apply_confidence)
    write_book(spark, f"{book} corrected", run.patched.first()["text"], paths)
    files.put(spark, paths["audit"], files.as_json(run.audit()))
    files.put(spark, paths["summary"], files.as_json(run.summary(), whole=True))
    log(f"{book}: {run.calls} prompts answered, corrections written to {folder}")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("pagemend").getOrCreate()
    book = f"{args.source.stem}_{args.start}_{args.end}"
    folder = args.output or str(args.source.parent / f"{args.source.stem}_pages_{args.start}_{args.end}")
    with RunLog(Path(folder) / ("deep.log" if args.deep_only else "local.log")) as log:
        (deep_run if args.deep_only else local_run)(spark, args, book, folder, log)
    return 0
