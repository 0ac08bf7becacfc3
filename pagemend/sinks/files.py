"""Files of a run.  Tables are written by Spark; what is one value by nature (a book, its audit) is one file on any storage that Spark knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, data: bytes | str) -> None:
    """One file with this content (text as UTF-8), in place of an earlier one; folders are made."""
    target, files = _path(spark, path)
    stream = files.create(target, True)
    try:
        stream.write(bytearray(data.encode() if isinstance(data, str) else data))
    finally:
        stream.close()


def get(spark: SparkSession, path: str) -> str:
    """The text of one file."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode()


def as_json(df: DataFrame, whole: bool = False) -> str:
    """The rows as one JSON array, or the only row as an object; Spark writes the JSON, nulls included."""
    style = {"pretty": "true", "ignoreNullFields": "false"}
    if whole:
        return df.select(F.to_json(F.struct("*"), style)).first()[0]
    return df.agg(F.to_json(F.collect_list(F.struct("*")), style)).first()[0]


def write_rows(df: DataFrame, path: str) -> None:
    """JSON lines, one file a partition, from the executors."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)
