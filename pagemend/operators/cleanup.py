"""Page furniture, paragraphs, and the text of a side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..functions.numbers import rounded


def numbered(lines: DataFrame, side: list[str]) -> DataFrame:
    """Lines with their place ``idx`` from the top of the side and the side's line count ``n``, both before any drop."""
    order = W.partitionBy(*side).orderBy("row_no")
    return lines.withColumns({"idx": F.row_number().over(order) - 1, "n": F.count("*").over(W.partitionBy(*side))})


def repeated_headers(lines: DataFrame, sides: DataFrame, book: str, share: float = 0.08, least: int = 3) -> DataFrame:
    """``(book, key, times)``: keys of 8 to 90 characters among the first three lines of many sides of a book.

    A key repeated within a side counts each time; sides without lines count in the number of sides.
    """
    top = lines.where("idx < 3").select(book, T.header_key(F.col("text")).alias("key")).where(F.length("key").between(8, 90))
    counts = top.groupBy(book, "key").agg(F.count("*").alias("times"))
    sizes = sides.groupBy(book).agg(F.count("*").alias("n_sides"))
    return counts.join(sizes, book).where(F.col("times") >= F.greatest(F.lit(least), F.floor(F.col("n_sides") * F.lit(share)))).select(book, "key", "times")


def dispositions(lines: DataFrame, headers: DataFrame, book: str) -> DataFrame:
    """Numbered lines with ``reason``: why a line is dropped, null if it stays; the first reason that holds counts."""
    said = T.strip(F.col("text"))
    marked = lines.withColumn("said", said).withColumn("key", T.header_key(said)).join(headers.select(book, "key", F.lit(True).alias("repeated")), [book, "key"], "left")
    edge = (F.col("idx") <= 2) | (F.col("idx") >= F.col("n") - 3)
    reason = (
        F.when(F.col("said") == "", F.lit("empty"))
        .when(F.col("said").rlike(T.PAGE_NUMBER) & edge, F.lit("page_number"))
        .when(F.col("repeated") & (F.col("idx") <= 3), F.lit("repeated_header"))
        .when((F.length("said") <= 2) & ~F.col("said").rlike(r"^[\p{L}\p{N}]+$"), F.lit("ornament"))
    )
    return marked.withColumn("reason", reason).drop("key", "repeated", "said")


def drops(judged: DataFrame, side: list[str]) -> DataFrame:
    """The audit of dropped lines."""
    return judged.where("reason is not null").select(*side, F.lit("drop").alias("action"), "reason", T.strip(F.col("text")).alias("text"), rounded(F.col("conf"), 1).alias("conf"))


def paragraphs(lines: DataFrame, side: list[str]) -> DataFrame:
    """``(side, par, text)``: lines joined to paragraphs by vertical gaps and by short unpunctuated predecessors.

    A gap of more than 0.95 of the side's upper-median line height starts a paragraph; so does a line after one of fewer than
    65 characters that does not end in ``. , ; :``.
    """
    order = W.partitionBy(*side).orderBy("row_no")
    tall = lines.groupBy(*side).agg(F.array_sort(F.collect_list(F.greatest(F.lit(1), F.col("h")))).alias("hs")).select(*side, F.element_at("hs", (F.size("hs") / 2).cast("int") + 1).alias("mid"))
    said = T.strip(F.col("text"))
    seen = lines.select(*side, "row_no", "y", said.alias("said"), F.lag("y").over(order).alias("py"), F.lag("h").over(order).alias("ph"), F.lag(said).over(order).alias("before"))
    gap = F.col("y") - (F.col("py") + F.col("ph")) > F.col("mid") * F.lit(0.95)
    heading = (F.length("before") < 65) & ~F.col("before").rlike("[.,;:]$")
    marked = seen.join(tall, side).withColumn("fresh", F.when(F.col("before").isNotNull() & (gap | heading), 1).otherwise(0))
    numbered_ = marked.withColumn("par", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    joined = numbered_.groupBy(*side, "par").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "said"))), lambda r: r["said"]), " ").alias("text"))
    return joined.select(*side, F.col("par").cast("long").alias("par"), T.strip(F.col("text")).alias("text")).where("text <> ''")


def side_tag(page: Column, side: Column) -> Column:
    return F.format_string("PDF%03d-%s", page, side)


def side_texts(pars: DataFrame, side: list[str], tag: Column) -> DataFrame:
    """``(side, text)``: marker and paragraphs of each side that has any; sides without paragraphs are left out."""
    body = pars.groupBy(*side).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("par", "text"))), lambda p: p["text"]), "\n\n").alias("body"))
    return body.select(*side, F.concat(F.lit("===== "), tag, F.lit(" =====\n\n"), F.col("body")).alias("text"))


def book_texts(texts: DataFrame, book: str, order: list[str]) -> DataFrame:
    """One text for each book: its sides in order, three line ends between them, one at the end.  A book is one value by nature."""
    packed = texts.groupBy(book).agg(F.array_sort(F.collect_list(F.struct(*order, F.rtrim(F.col("text")).alias("text")))).alias("sides"))
    return packed.select(book, F.concat(F.array_join(F.transform("sides", lambda s: s["text"]), "\n\n\n"), F.lit("\n")).alias("text"))
