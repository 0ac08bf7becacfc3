"""Recognised words from TSV files of a recognition engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TSV


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of TSV files, without quoting: a quotation mark is a character like others.  Rows without a readable place are left out."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=TSV, quote="", mode="PERMISSIVE").withColumn("file", F.input_file_name())
    return shaped(rows.withColumn("word_no", F.monotonically_increasing_id()))


def parse_words(texts: DataFrame, by: list[str], tsv_col: str = "tsv") -> DataFrame:
    """Words of TSV texts held in a column (a provider's raw output), one header line each."""
    names = [c.split()[0] for c in TSV.split(", ")]
    lines = texts.select(*by, F.posexplode(F.split(tsv_col, "\r?\n")).alias("word_no", "line")).where("word_no > 0 and line <> ''")
    cells = F.split("line", "\t")
    return shaped(lines.select(*by, "word_no", *[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)]))


def shaped(rows: DataFrame) -> DataFrame:
    place = {name: F.col(f"{name}_num").try_cast("int") for name in ("block", "par", "line")}
    page = F.when(F.coalesce(F.col("page_num"), F.lit("")) == "", F.lit(1)).otherwise(F.col("page_num").try_cast("int"))
    return rows.withColumns({"image": F.greatest(F.lit(0), page - 1), **place}).where("image is not null and block is not null and par is not null and line is not null").drop("level", "page_num", "block_num", "par_num", "line_num", "word_num")
