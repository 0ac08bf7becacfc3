"""Scanned books: a range of pages rendered to spreads, in parallel by page.

The renderer is a pair of functions, ``pages(path)`` and ``render(path, index, scale)`` giving a height x width x 3 BGR array.  The
default one needs PyMuPDF; tests and other formats bring their own.
"""

import os

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .images import check_range, split_spreads

_OPEN: dict = {}


def _document(path: str):
    """The book, opened once a process."""
    if path not in _OPEN:
        try:
            import pymupdf
        except ImportError as error:
            raise RuntimeError("rendering needs PyMuPDF; pass another renderer") from error
        _OPEN.clear()
        _OPEN[path] = pymupdf.open(path), pymupdf
    return _OPEN[path]


def pages(path: str) -> int:
    return len(_document(path)[0])


def render(path: str, index: int, scale: float) -> np.ndarray:
    document, library = _document(path)
    picture = document.load_page(index).get_pixmap(matrix=library.Matrix(scale, scale), alpha=False)
    return np.frombuffer(picture.samples, np.uint8).reshape(picture.height, picture.width, picture.n)[:, :, 2::-1]


def spreads(spark: SparkSession, path: str, start: int, end: int, scale: float = 2.0, renderer=(pages, render)) -> DataFrame:
    """``(page, height, width, channels, pixels)`` of pages ``start`` to ``end`` of one book, counted from 1.

    Rows carry page numbers only.  The file itself is fetched once by each executor that has a page to render, from any storage
    that Spark knows; the range is checked in a task before any page is rendered.
    """
    count, draw = renderer
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    def counted(batches):
        import pandas as pd

        for _ in batches:
            yield pd.DataFrame({"pages": [count(SparkFiles.get(name))]})

    check_range(start, end, spark.range(1, numPartitions=1).mapInPandas(counted, "pages int").first()[0])

    def run(batches):
        import pandas as pd

        for frame in batches:
            for page in frame["page"].tolist():
                image = np.ascontiguousarray(draw(SparkFiles.get(name), page - 1, scale))
                yield pd.DataFrame([(page, *image.shape, image.tobytes())], columns=["page", "height", "width", "channels", "pixels"])

    wanted = spark.range(start, end + 1, numPartitions=min(1024, end + 1 - start)).select(F.col("id").cast("int").alias("page"))
    return wanted.mapInPandas(run, "page int, height int, width int, channels int, pixels binary")


def sides(spark: SparkSession, path: str, start: int, end: int, scale: float = 2.0, renderer=(pages, render)) -> DataFrame:
    """Side images of a range of pages, left before right."""
    return split_spreads(spreads(spark, path, start, end, scale, renderer))
