"""Stage boundaries: what lies behind an engine, or is read more than once, is computed once and its lineage cut."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CONSTRAINTS = "spark.sql.constraintPropagation.enabled"


def shared_checkpoints(spark: SparkSession) -> str:
    """The folder of checkpoints: that of ``spark.checkpoint.dir``; one of its own only where driver and executors are one process."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="pagemend-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def stage(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, its lineage cut.

    A checkpoint would carry along what the optimizer had inferred about its rows, which grows without bound over rounds of joins;
    so that inference is off while it is made.
    """
    spark = df.sparkSession
    shared_checkpoints(spark)
    before = spark.conf.get(_CONSTRAINTS)
    spark.conf.set(_CONSTRAINTS, "false")
    try:
        out = df.checkpoint()
    finally:
        spark.conf.set(_CONSTRAINTS, before)
    for made in _MADE:
        made.append(out)
    return out


def released(spark: SparkSession) -> None:
    """Shuffle files of finished steps go now, not when the driver happens to collect its garbage.

    Spark deletes a shuffle once nothing on the driver refers to it; over many steps on small rows the heap fills so slowly that the
    files of all steps lie on the disk together.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_MADE: list[list[DataFrame]] = []


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared storage."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """What ``stage`` writes inside goes at the end: for work whose result is written as a table of its own."""
    made: list[DataFrame] = []
    _MADE.append(made)
    try:
        yield
    finally:
        _MADE[:] = [x for x in _MADE if x is not made]
        for df in made:
            file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
            if file.isDefined():
                remove(spark, file.get())
