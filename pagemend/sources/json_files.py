"""Audit files and model replies."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Terminal control sequences, and a fenced block.
ANSI = "\x1b(?:[@-Z\\\\-_]|\\[[0-?]*[ -/]*[@-~])"
FENCE = r"(?is)```(?:json)?\s*([\[{].*?[\]}])\s*```"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def fenced(reply: Column) -> Column:
    """The first fenced JSON block of a noisy reply, empty if there is none."""
    return F.regexp_extract(F.regexp_replace(reply, ANSI, ""), FENCE, 1)


def first_json(reply: str | None) -> str | None:
    """The first fenced block, else the first object or array that decodes anywhere in the reply; null if none does.

    A fenced block that is no JSON is an error of the reply, not searched further.
    """
    if reply is None:
        return None
    plain = re.sub(ANSI, "", reply)
    block = re.search(FENCE, plain)
    if block:
        try:
            json.loads(block[1])
        except ValueError:
            return None
        return block[1]
    decoder = json.JSONDecoder()
    for start in (m.start() for m in re.finditer(r"[\[{]", plain)):
        try:
            _, end = decoder.raw_decode(plain, start)
        except ValueError:
            continue
        return plain[start:end]
    return None


def extract_json(df: DataFrame, column: str, name: str = "json") -> DataFrame:
    """Adds the JSON text found in a noisy column (Arrow-batched; a general scan has no built-in)."""
    find = F.udf(first_json, "string", useArrow=True)
    return df.withColumn(name, find(F.col(column)))


def reply_items(replies: DataFrame, json_col: str = "json", order: str = "batch_no", by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, item_id, ops)`` from replies ``{"items": [{"id", "ops"}]}``; of repeated ids the row of the last batch counts.

    Operations are parsed one by one, so one that is no object becomes an operation of nulls and the others stay.
    """
    parsed = replies.select(*by, order, F.posexplode(F.from_json(F.get_json_object(json_col, "$.items"), "array<string>")).alias("at", "item"))
    raw = parsed.select(*by, order, "at", F.from_json("item", "struct<id:string,ops:array<string>>").alias("x"))
    rows = raw.where("coalesce(x.id, '') <> ''").select(*by, F.col("x.id").alias("item_id"), F.struct(order, "at").alias("o"), F.transform(F.coalesce("x.ops", F.array().cast("array<string>")), lambda o: F.from_json(o, "struct<kind:string,old:string,new:string,confidence:string>")).alias("ops"))
    return rows.groupBy(*by, "item_id").agg(F.max_by("ops", "o").alias("ops"))
