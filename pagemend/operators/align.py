"""Alignment of each anchor line with the most similar row of every reading of its side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import folded, nearest
from ..schemas import CANDIDATE


def align(lines: DataFrame, rows: DataFrame, side: list[str], at_least: float = 0.45) -> DataFrame:
    """``(line_id, source, pass_order, text, conf)``: for each line and reading the row of highest similarity, if it reaches ``at_least``.

    A side's lines and the rows of its readings meet once, in one row; texts are folded once, readings that say the same are compared
    once, and the comparison prunes by upper bounds and is exact.  Ties go to the earlier row.
    """
    kind = dict(lines.dtypes)["line_id"]
    anchor = F.struct("line_id", F.col("text").alias("anchor"))
    reading = F.struct("pass_order", "source", "row_no", "text", "conf")
    both = lines.select(*side, anchor.alias("a")).unionByName(rows.select(*side, reading.alias("r")), allowMissingColumns=True)
    packed = both.groupBy(*side).agg(F.collect_list("a").alias("anchors"), F.array_sort(F.collect_list("r")).alias("said")).where("size(anchors) > 0 and size(said) > 0")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            anchors, said = batch.column("anchors"), batch.column("said")
            lines_at, rows_at = anchors.offsets.to_pylist(), said.offsets.to_pylist()
            ids, rows_ = anchors.values.field("line_id"), said.values
            left, right = anchors.values.field("anchor").to_pylist(), rows_.field("text").to_pylist()
            readings = list(zip(rows_.field("source").to_pylist(), rows_.field("pass_order").to_pylist(), strict=True))
            line, row = [], []
            for n in range(batch.num_rows):
                own, found = range(lines_at[n], lines_at[n + 1]), {}
                for at in range(rows_at[n], rows_at[n + 1]):
                    found.setdefault(readings[at], []).append(at)
                plain = {text: folded(text) for text in {*left[own.start : own.stop], *right[rows_at[n] : rows_at[n + 1]]}}
                asked, met = [plain[left[at]] for at in own], {}
                for places in found.values():
                    texts = tuple(plain[right[at]] for at in places)
                    if texts not in met:
                        met[texts] = nearest(asked, list(texts), at_least)
                    for at, best in zip(own, met[texts], strict=True):
                        if best is not None:
                            line.append(at)
                            row.append(places[best])
            picked = [rows_.field(c).take(pa.array(row, pa.int64())) for c in ("source", "pass_order", "text", "conf")]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(line, pa.int64())), *picked], ["line_id", "source", "pass_order", "text", "conf"])

    return packed.select("anchors", "said").mapInArrow(run, f"line_id {kind}, source string, pass_order int, text string, conf double")


def gather(readings: DataFrame, kind: str, name: str, passes: DataFrame | None = None) -> DataFrame:
    """Readings of each line as one ordered array of candidates."""
    scaled = readings.join(F.broadcast(passes.select(F.col("name").alias("source"), "scale", "psm")), "source", "left") if passes is not None else readings.withColumns({"scale": F.lit(None).cast("double"), "psm": F.lit(None).cast("int")})
    one = F.struct("source", F.lit(kind).alias("kind"), "text", "conf", "scale", "psm").cast(CANDIDATE)
    return scaled.groupBy("line_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass_order", one.alias("c")))), lambda x: x["c"]).alias(name))
