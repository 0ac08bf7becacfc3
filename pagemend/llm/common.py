"""Shared plumbing of the corpus operators: reading tables, Arrow row mapping, shared-storage checkpoints."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..adapters import spread
from ..plans.stages import stage as settle  # noqa: F401  (for the operators)

#: Rows handled at once inside a Python worker; bounds what a batch of very long texts occupies.
ROWS_AT_ONCE = 64

#: Bytes up to which the small side of a join is broadcast.
BROADCAST_BYTES = 24 << 20

#: For ``bytes.translate``: A-Z become a-z, every other ASCII byte outside 0-9 a-z becomes a space, bytes from 0x80 stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that is a single small file is dealt out over the cores, others are read as they lie."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fold_words(text: str | None) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def map_rows(df: DataFrame, inputs: list, schema: str, setup: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """One output row per input row: ``setup()`` runs once a task and gives the function of the input columns.

    Narrow (no shuffle) and stateless, so a lost executor only repeats its own tasks.  Works on slices of an Arrow batch,
    so memory follows the longest few texts, not the batch.
    """

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        row = setup()
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                out = [row(*values) for values in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(target)], schema=target)

    return df.select(*inputs).mapInArrow(run, schema)


def identity(id_col: str, text_col: str) -> list[Column]:
    """What a text is known by: ``key``, its id as a string, null apart from any string, and ``text_hash``, a hash of the text."""
    return [F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("null")).alias("key"), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("text_hash")]


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A settled side, marked for broadcast only if its values and 16 bytes a column and row were summed up and are few enough bytes."""
    wide = [F.octet_length(c) if kind in ("string", "binary") else F.lit(0) for c, kind in df.dtypes]
    wide += [F.coalesce(F.size(c), F.lit(0)) * 16 for c, kind in df.dtypes if kind.startswith("array")]
    held = df.agg(F.sum(reduce(lambda a, b: a + F.coalesce(b, F.lit(0)), wide, F.lit(16 * len(df.columns)).cast("long")))).first()[0]
    return F.broadcast(df) if (held or 0) <= most else df
