"""Word lists, plain or compiled into a recognition engine's language data."""

from __future__ import annotations

import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..functions import text as T


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Distinct folded words, one a line; a missing list is an empty one, which switches dictionary measures off."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "word string")
    return words_from(lines.select(F.col("value").alias("word")), F.col("word"))


def words_from(rows: DataFrame, word: Column) -> DataFrame:
    return rows.select(T.fold(T.strip(word)).alias("word")).where("word <> ''").distinct()


def compiled_lexicon(spark: SparkSession, language_data: str, unpack: str, list_words: str, timeout: int = 30) -> DataFrame:
    """The words of one language's compiled data, by the engine's own two tools; an empty list if either cannot do it.

    ``unpack`` takes the data apart into files beside a prefix, ``list_words`` turns a word graph and its character set into lines.
    The list of one language has a fixed size, whatever the size of the corpus.
    """
    with tempfile.TemporaryDirectory() as folder:  # the driver's own scratch
        part, words = f"{folder}/part.", Path(folder) / "words"
        commands = ([unpack, "-u", language_data, part], [list_words, f"{part}lstm-unicharset", f"{part}lstm-word-dawg", str(words)])
        try:
            for command in commands:
                subprocess.run(command, check=True, capture_output=True, timeout=timeout)
            lines = words.read_text(encoding="utf-8", errors="ignore").split("\n")
        except (OSError, subprocess.SubprocessError):
            lines = []
    return words_from(spark.createDataFrame([(line,) for line in lines], "word string"), F.col("word"))
