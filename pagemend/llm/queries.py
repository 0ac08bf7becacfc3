"""Registry of the corpus queries and of the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, htmltext, langid, licenses, neardup, pii, quality, sharding


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_licenses": licenses.op2_licenses,
        "op3_language": langid.op3_language,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_chat": chat.op5_chat,
        "op6_main_text": htmltext.op6_main_text,
        "op7_shards": sharding.op7_shards,
        "op8_pii": pii.op8_pii,
        "op9_byte_bpe": bpe.op9_byte_bpe,
        "op10_near_dedup": neardup.op10_near_dedup,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": quality.OP1_SQL, "op2_licenses": licenses.op2_sql(), "op4_decontamination": decontaminate.OP4_SQL}
