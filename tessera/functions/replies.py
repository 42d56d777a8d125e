"""Answers in replies of any depth: the values of a JSON text level by level, each with its path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.cleaning import stripped
from tessera.functions.loose import whole_json
from tessera.session import written

# Keys of answers in the order they are tried.
ANSWER_KEYS = ("answer", "output", "text", "message", "result", "data")


def with_answers(df: DataFrame, reply: str, name: str = "answer") -> DataFrame:
    """df with the first answer in a reply that has some text, trimmed; empty where there is none, null for a null.

    A reply that is no JSON as a whole is its own answer. In JSON, values under the keys of answers (in their order) and in lists are looked through before those of later keys, however deep they lie; so the
    answer is the text with the least path, whose parts are places of keys and in lists. Each level is a small table of what is left to open: as many steps as the deepest reply has levels.
    """
    base = written(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("key"), F.col(reply).alias("reply")))
    kind = lambda v: F.schema_of_variant(v)
    value = whole_json(F.col("reply"))
    rows = base.select("key", F.array().cast("array<long>").alias("path"), F.to_json(value).alias("json"), kind(value).alias("kind"))
    levels = []
    while True:
        rows = written(rows.where("json is not null"))
        levels.append(rows.where("kind = 'STRING'").select("key", "path", stripped(F.try_variant_get(F.try_parse_json("json"), "$", "string")).alias("text")).where("text <> ''"))
        inner = rows.where(F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY"))
        if inner.isEmpty():
            break
        one = F.col("pos").cast("long")
        by_key = F.array_position(F.array(*map(F.lit, ANSWER_KEYS)), F.col("name"))
        inner = inner.withColumn("v", F.try_parse_json("json")).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "value"))
        at = F.when(F.col("name").isNull(), one).otherwise(by_key)
        rows = inner.withColumn("at", at).where("name is null or at > 0").select("key", F.array_append("path", F.col("at")).alias("path"), F.to_json("value").alias("json"), kind(F.col("value")).alias("kind"))
    first = reduce(DataFrame.unionByName, levels).groupBy("key").agg(F.min_by("text", "path").alias("text"))
    out = base.withColumn("plain", F.coalesce(kind(value), F.lit("VOID")) == "VOID").join(first, "key", "left")
    return out.select("row.*", F.when(F.col("plain"), stripped(F.col("reply"))).when(F.col("reply").isNotNull(), F.coalesce("text", F.lit(""))).alias(name))
