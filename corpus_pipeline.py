"""A training-corpus pipeline: five stages, each on all that its predecessor kept, written as Parquet and read again.

language       documents whose language cannot be told (no letter, or too far from all learned languages) go
near_dedup     one document of each class of near and exact copies stays, that with the smallest id
decontaminate  documents that hold a window of a benchmark item go
redact         personal data in the texts is replaced by its kind
tokenize       each text is encoded to ids; the last stage returns (doc_id, lang, source, n_tokens, ids)

All stages but the last return the columns of documents.  Null ids are ids like others; rows of equal id and text are one from
near_dedup on, one id with two texts stays two rows.
"""

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemend.llm import bpe, decontaminate, langid, neardup, pii
from pagemend.llm.common import map_rows, table
from pagemend.plans.stages import cleared, remove, shared_checkpoints

#: No stage's model or alignment can be stated in SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = spark.sparkContext.broadcast(langid.learn(docs, usable=~langid.held_out()))

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        return pd.Series([not model.value.predict(t)[2] for t in texts], index=texts.index, dtype=bool)

    return docs.where(known(F.col("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shipped = spark.sparkContext.broadcast(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    pattern = public_tokenizers.PATTERN

    def setup():
        enc = bpe.encoder(shipped.value, pattern)

        def row(key, lang, source, text):
            ids = bpe.encode_text(enc, text)
            if enc.decode_bytes(ids) != (text or "").encode():
                raise ValueError(f"document {key} does not decode to itself")
            return key, lang, source, len(ids), ids

        return row

    kinds = dict(docs.dtypes)
    held = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "lang", "source"))
    return map_rows(docs, ["doc_id", "lang", "source", "text"], f"{held}, n_tokens long, ids array<int>", setup)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("redact", redact), ("tokenize", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared checkpoint folder, and goes when its successor is written.

    A stage's own checkpoints go with its end.
    """
    folder = f"{shared_checkpoints(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
