"""Texts whose sides are divided by marker lines.  Page numbers of three digits and more are recognised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T

# Fixed value: the marker line.
MARKER = r"^===== PDF([0-9]{3,})-([LR]) =====$"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(book, text)``, a row for each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("book"), F.col("value").alias("text"))


def _lines(texts: DataFrame, book: str) -> DataFrame:
    """Lines with their marker's page and side and the running number of markers; lines before the first marker are number 0."""
    lines = texts.select(book, F.posexplode(T.split_lines(F.col("text"))).alias("at", "line"))
    bare = T.strip(F.col("line"))
    marked = lines.withColumns({"bare": bare, "is_marker": bare.rlike(MARKER)})
    return marked.withColumn("nth", F.sum(F.col("is_marker").cast("int")).over(W.partitionBy(book).orderBy("at").rowsBetween(W.unboundedPreceding, 0)))


def sides(texts: DataFrame, book: str = "book") -> DataFrame:
    """``(book, ord, page, side, paragraphs)``: a row for each marker, also repeated ones, in order; paragraphs are parted by empty lines."""
    lines = _lines(texts, book).where("nth > 0")
    page = F.max(F.when(F.col("is_marker"), F.regexp_extract("bare", MARKER, 1).cast("int"))).alias("page")
    side = F.max(F.when(F.col("is_marker"), F.regexp_extract("bare", MARKER, 2))).alias("side")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_marker"), F.struct("at", "line")))), lambda x: x["line"]), "\n")
    packed = lines.groupBy(book, "nth").agg(page, side, body.alias("body"))
    return packed.select(book, F.col("nth").cast("long").alias("ord"), "page", "side", F.filter(F.transform(F.split("body", "\n\n"), T.strip), lambda p: p != "").alias("paragraphs"))


def page_lines(texts: DataFrame, book: str = "book") -> DataFrame:
    """``(book, page, side, lines)``: the non-empty stripped lines of each side; repeated markers of one side are one."""
    lines = _lines(texts, book)
    order = W.partitionBy(book).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    last = lambda group: F.last(F.when(F.col("is_marker"), F.regexp_extract("bare", MARKER, group)), ignorenulls=True).over(order)
    held = lines.withColumns({"page": last(1).cast("int"), "side": last(2)}).where("not is_marker and bare <> '' and page is not null")
    return held.groupBy(book, "page", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bare"))), lambda x: x["bare"]).alias("lines"))
