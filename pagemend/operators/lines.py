"""Words to lines, crops to readings, rows to anchor lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T


def words_to_lines(words: DataFrame, by: list[str], scale: Column | float = 1.0) -> DataFrame:
    """One row per (``by``, image, block, par, line): words joined in order, mean of confidences from 0, enclosing box.

    A word whose confidence or box cannot be read still gives its text; boxes after an unreadable confidence are not read.
    Lines without a box are dropped.  Coordinates are divided by the scale and truncated; ``row_no`` counts lines of an image
    from the top, then from the left, then by first word.
    """
    keys = [*by, "image", "block", "par", "line"]
    number = lambda c: F.col(c).cast("string").try_cast("int")
    conf = F.coalesce(F.when(F.col("conf").isNull() | (F.col("conf").cast("string") == ""), F.lit("-1")).otherwise(F.col("conf").cast("string")).try_cast("double"))
    said = T.strip(F.col("text"))
    boxed = conf.isNotNull() & number("left").isNotNull() & number("top").isNotNull() & number("width").isNotNull() & number("height").isNotNull()
    rows = words.where(said != "").select(
        *keys, "word_no", said.alias("text"), F.when(conf >= 0, conf).alias("conf"),
        *[F.when(boxed, number(c)).alias(c) for c in ("left", "top")],
        F.when(boxed, number("left") + number("width")).alias("right"), F.when(boxed, number("top") + number("height")).alias("bottom"),
    )
    lines = rows.groupBy(*keys).agg(
        F.min("word_no").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]), " ").alias("text"),
        F.coalesce(F.avg("conf"), F.lit(0.0)).alias("conf"),
        F.min("left").alias("x0"), F.min("top").alias("y0"), F.max("right").alias("x1"), F.max("bottom").alias("y1"),
    ).where("x0 is not null")
    scale = F.lit(scale) if isinstance(scale, float) else scale
    cut = lambda c: (c / scale).cast("int")
    boxes = lines.select(*keys, "first", "text", "conf", cut(F.col("x0")).alias("x"), cut(F.col("y0")).alias("y"), cut(F.col("x1") - F.col("x0")).alias("w"), cut(F.col("y1") - F.col("y0")).alias("h"))
    order = W.partitionBy(*by, "image").orderBy("y", "x", "first")
    return boxes.withColumn("row_no", F.row_number().over(order)).drop("first")


def words_to_readings(words: DataFrame, by: list[str]) -> DataFrame:
    """One reading per cropped line: all its words joined, mean of confidences from 0."""
    said = T.strip(F.col("text"))
    conf = F.coalesce(F.col("conf").cast("string").try_cast("double"), F.when(F.coalesce(F.col("conf").cast("string"), F.lit("")) == "", F.lit(-1.0)))
    rows = words.where(said != "").select(*by, "word_no", said.alias("text"), conf.alias("conf")).where("conf is not null")
    return rows.groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]), " ").alias("text"),
        F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), F.lit(0.0)).alias("conf"),
    )


def line_id(page: Column, side: Column, row_no: Column) -> Column:
    return F.format_string("%03d-%s-L%03d", page, side, row_no)


def anchors(rows: DataFrame) -> DataFrame:
    """Anchor lines of the chosen pass: blank rows are skipped but counted, so ids have gaps."""
    return rows.where(~T.blank(F.col("text"))).withColumn("text", T.strip(F.col("text"))).withColumn("line_id", line_id(F.col("page"), F.col("side"), F.col("row_no")))


def crop_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """Padded box of a line inside its image: x0, y0, x1, y1."""
    pad_x, pad_y = F.greatest(F.lit(25), (width * F.lit(0.06)).cast("int")), F.greatest(F.lit(22), (height * F.lit(0.025)).cast("int"))
    return [F.greatest(F.lit(0), x - pad_x).alias("x0"), F.greatest(F.lit(0), y - pad_y).alias("y0"), F.least(width, x + w + pad_x).alias("x1"), F.least(height, y + h + pad_y).alias("y1")]


def chunked(rows: DataFrame, size: int, by: list[str], order: list[str], name: str = "chunk") -> DataFrame:
    """Numbers consecutive rows of each ``by`` group into chunks of ``size``."""
    return rows.withColumn(name, F.floor((F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1) / size).cast("long"))


def jobs(items: DataFrame, passes: DataFrame, size: int, by: list[str], order: list[str]) -> DataFrame:
    """Every item with every pass, items numbered into chunks: the unit of work of a recognition process."""
    return chunked(items, size, by, order).crossJoin(F.broadcast(passes))  # passes: a handful of constants
