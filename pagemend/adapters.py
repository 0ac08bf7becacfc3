"""Recognition evidence made from the document tables by fixed formulas, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T

#: The characters of category Zs.
BLANKS = " \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def book() -> Column:
    """The book of a document: fifty neighbouring documents are its sides, so a book stays a book however large the corpus is."""
    return F.concat(F.lit("b"), F.expr("doc_id div 50").cast("string")).alias("book")


def spread(df: DataFrame, least: int = 1 << 18) -> DataFrame:
    """A table of fewer partitions than cores dealt out evenly, ``least`` bytes of file and more to each; others stay as they are.

    A small file is one row group, and so one task, however many partitions are planned for it.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if parts >= cores:
        return df
    wanted = min(cores, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // least)
    return df.repartition(wanted) if wanted > 1 else df


def trimmed(text: Column) -> Column:
    """Text without blanks at either end, of any width, as SQL's ``trim`` has it."""
    return F.btrim(text, F.lit(BLANKS))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document with a box and a confidence: (book, doc_id, row_no, text, conf, x, y, w, h)."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(book(), "doc_id", F.posexplode(F.split("text", "\n")).alias("row_no", "raw"))
    i = F.col("row_no")
    return rows.select(
        "book", "doc_id", "row_no", trimmed(F.col("raw")).alias("text"), (60 + (F.col("doc_id") * 31 + i * 17) % 41).cast("double").alias("conf"),
        F.lit(0).alias("x"), (24 * i + 20 * F.floor(i / 5)).cast("int").alias("y"), (10 * F.length(trimmed(F.col("raw")))).alias("w"), (20 + i % 3).alias("h"),
    )


def readings(row: DataFrame) -> list:
    """Five readings of a line as (source, text) columns."""
    text, doc, i = F.col("text"), F.col("doc_id"), F.col("row_no")
    return [
        ("p0", text), ("p1", T.strip_accents(text)), ("p2", F.lower(text)),
        ("p3", F.when((doc + i) % 7 == 0, F.replace(text, F.lit("e"), F.lit("c"))).otherwise(text)), ("p4", F.when(doc % 11 == 0, F.concat(text, F.lit(" ###"))).otherwise(text)),
    ]


def candidates_of(rows: DataFrame, named: list, kind: str = "whole"):
    """An array of candidate structs in pass order."""
    one = lambda n, source, text: F.struct(F.lit(source).alias("source"), F.lit(kind).alias("kind"), text.alias("text"), (F.col("conf") - 2 * n).alias("conf"), F.lit(None).cast("double").alias("scale"), F.lit(None).cast("int").alias("psm"))
    return F.array(*[one(n, source, text) for n, (source, text) in enumerate(named)])


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, doc_id, source, pass_order, row_no, text, conf, ...): five readings of every document."""
    rows = lines(spark, sf_dir)
    packed = rows.withColumn("c", F.explode(F.arrays_zip(candidates_of(rows, readings(rows)).alias("c"), F.sequence(F.lit(0), F.lit(4)).alias("o"))))
    return packed.select("book", "doc_id", F.col("c.c.source").alias("source"), F.col("c.o").alias("pass_order"), "row_no", F.col("c.c.text").alias("text"), F.col("c.c.conf").alias("conf"), "x", "y", "w", "h")


def held_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the other readings of the same place as candidates, keyed by ``line_id``."""
    rows = lines(spark, sf_dir)
    return rows.withColumns({"line_id": F.concat_ws("-", F.col("doc_id").cast("string"), F.col("row_no").cast("string")), "whole_candidates": candidates_of(rows, readings(rows))})


def consensus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose anchor lost its accents where the document id divides by 3, while four readings kept them."""
    rows = lines(spark, sf_dir)
    anchor = F.when(F.col("doc_id") % 3 == 0, T.strip_accents(F.col("text"))).otherwise(F.col("text"))
    named = [(f"q{n}", F.col("text")) for n in range(1, 5)] + [("q5", anchor)]
    out = rows.withColumns({"line_id": F.concat_ws("-", F.col("doc_id").cast("string"), F.col("row_no").cast("string")), "whole_candidates": candidates_of(rows, named)})
    return out.withColumn("text", anchor)


def damaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which every fourth was misread in the anchor and one more reading, while three readings are right."""
    rows = lines(spark, sf_dir)
    anchor = F.when((F.col("doc_id") + F.col("row_no")) % 4 == 0, F.replace("text", F.lit("e"), F.lit("c"))).otherwise(F.col("text"))
    named = [(f"q{n}", F.col("text")) for n in range(1, 4)] + [(f"q{n}", anchor) for n in (4, 5)]
    out = rows.withColumns({"line_id": F.concat_ws("-", F.col("doc_id").cast("string"), F.col("row_no").cast("string")), "whole_candidates": candidates_of(rows, named)})
    return out.withColumn("text", anchor)


def word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every second document."""
    said = lines(spark, sf_dir).where("doc_id % 2 = 0").select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return said.select(T.token_core(F.col("token")).alias("word")).where("word <> ''").distinct()


def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with page furniture: a page number at the end; ornaments and an empty line in some documents."""
    docs = table(spark, sf_dir, "documents")
    extra = F.concat(
        F.split("text", "\n"),
        F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("***"), F.lit("**"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")),
        F.array((F.col("doc_id") % 500).cast("string")),
    )
    rows = docs.select(book(), "doc_id", F.posexplode(extra).alias("row_no", "text"))
    return rows.withColumn("conf", (60 + (F.col("doc_id") * 31 + F.col("row_no") * 17) % 41).cast("double"))


def word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every line with boxes and confidences as an engine prints them, some unreadable."""
    rows = lines(spark, sf_dir).select("doc_id", "row_no", F.posexplode(F.split("text", " ")).alias("k", "text"))
    doc, i, k = F.col("doc_id"), F.col("row_no"), F.col("k")
    conf = F.when((doc + k) % 13 == 0, "x").when((doc + i + k) % 7 == 0, "-1").otherwise((50 + (doc + i * 3 + k * 5) % 50).cast("string"))
    return rows.select(
        "doc_id", F.lit(0).alias("image"), F.floor(i / 10).cast("int").alias("block"), F.lit(1).alias("par"), i.alias("line"), k.cast("long").alias("word_no"),
        (k * 37 % 900).alias("left"), (i * 24 + k % 3).alias("top"), (F.length("text") * 10).alias("width"), (20 + k % 4).alias("height"), conf.alias("conf"), "text",
    )


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("word"))
    return words.select(T.fold(F.col("word")).alias("word")).distinct()


def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a text of two marked sides after a preface."""
    docs = table(spark, sf_dir, "documents")
    tag = lambda side: F.concat(F.lit("===== PDF"), (100 + F.col("doc_id") % 900).cast("string"), F.lit(f"-{side} ====="))
    text = F.concat(F.lit("preface\n"), tag("L"), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\n\n  "), tag("R"), F.lit(" \n\n"), F.substring_index("text", "\n", 1), F.lit("\n"))
    return docs.select(F.col("doc_id").alias("book"), text.alias("text"))


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspect lines as a queue meets them: some edited, some with a dash in front, some that the page does not hold."""
    from .operators import refine

    held = refine.suspect_reasons(held_lines(spark, sf_dir), None)
    doc, i = F.col("doc_id"), F.col("row_no")
    current = F.when((doc + i) % 17 == 0, F.concat("text", F.lit("zz"))).when((doc + i) % 5 == 0, F.concat(F.lit("— "), F.col("text"))).when((doc + i) % 19 == 0, F.lit(" ")).otherwise(F.col("text"))
    reasons = F.when((doc + i) % 23 == 0, F.array(F.lit("whole_side_catastrophe"))).otherwise(F.col("reasons"))
    none = F.array().cast("array<string>")
    return held.select("doc_id", "row_no", reasons.alias("reasons"), current.alias("before"), current.alias("after"), F.when((doc + i) % 29 == 0, F.array(F.lit("edit"))).otherwise(none).alias("edits"), "whole_candidates", F.slice("whole_candidates", 1, 2).alias("line_candidates"))


def page_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines that are not empty."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.filter(F.transform(F.split("text", "\n"), trimmed), lambda x: x != "").alias("lines"))


def op_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with three proposed operations on its first three words and two other readings."""
    rows = lines(spark, sf_dir)
    w = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    word = lambda n: F.coalesce(F.get(w, F.lit(n)), F.lit(""))
    sure = (F.lit(0.9) + (F.col("doc_id") * 7 + F.col("row_no")) % 11 / F.lit(100.0)).cast("string")
    op = lambda kind, old, new: F.struct(F.lit(kind).alias("kind"), old.alias("old"), new.alias("new"), sure.alias("confidence"))
    third = word(2)
    ops = F.array(op("replace", word(0), F.replace(word(0), F.lit("e"), F.lit("c"))), op("", word(1), T.strip_accents(word(1))), op("segment", third, F.concat(F.substring(third, 1, 2), F.lit(" "), F.substring(third, F.lit(3), F.length(third)))))
    return rows.select("doc_id", "row_no", F.col("text").alias("current"), F.array(T.strip_accents(F.col("text")), F.replace("text", F.lit("e"), F.lit("c"))).alias("candidates"), ops.alias("ops"))


def noisy_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``evidence`` in which recognition failed on every thirteenth document: letters read as signs, with little confidence."""
    failed = F.col("doc_id") % 13 == 0
    rows = evidence(spark, sf_dir)
    return rows.withColumns({"text": F.when(failed, F.translate("text", "aeinrst", "~#|{}^@")).otherwise(F.col("text")), "conf": F.when(failed, F.col("conf") - 40).otherwise(F.col("conf"))})


def tsv_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an engine would print for each document: one TSV text with a header line and a row a word."""
    rows = word_rows(spark, sf_dir)
    cells = [F.lit("5"), F.lit("1"), F.col("block"), F.col("par"), F.col("line"), F.col("word_no"), F.col("left"), F.col("top"), F.col("width"), F.col("height"), F.col("conf"), F.col("text")]
    line = F.array_join(F.array(*[c.cast("string") for c in cells]), "\t")
    head = "level page_num block_num par_num line_num word_num left top width height conf text".replace(" ", "\t")
    packed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "word_no", line.alias("cells")))).alias("rows"))
    return packed.select("doc_id", F.concat(F.lit(head + "\n"), F.array_join(F.transform("rows", lambda r: r["cells"]), "\r\n")).alias("tsv"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply for every three lines of a document: an operation on the first word of each, one that is no object, and an item without an id."""
    rows = lines(spark, sf_dir).select("book", "doc_id", "row_no", F.regexp_extract("text", r"[\p{L}]+", 0).alias("word"))
    op = F.to_json(F.struct(F.lit("replace").alias("kind"), F.col("word").alias("old"), F.concat("word", F.lit("+")).alias("new"), F.lit(0.99).alias("confidence")))
    item = F.concat(F.lit('{"id":"'), F.col("doc_id").cast("string"), F.lit("-"), F.col("row_no").cast("string"), F.lit('","ops":['), op, F.lit(',"none"]}'))
    batch = F.floor(F.col("row_no") / 3).cast("long")
    packed = rows.groupBy("book", "doc_id", batch.alias("batch_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", item.alias("item")))), lambda x: x["item"]), ",").alias("items"))
    return packed.select("book", "doc_id", "batch_no", F.concat(F.lit("Here you are: "), F.lit('{"items":['), F.col("items"), F.lit(',{"ops":[]}]} as you asked')).alias("reply"))
