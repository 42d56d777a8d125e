"""What the training-data operators share: table access, lineage cuts and small expression helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import session

#: White space of the word contract (blank, tab, line feed, vertical tab, form feed, return).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and stored tables: that of the context, else the one the cluster names in spark.checkpoint.dir (without it, only a session on one machine has one)."""
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(session.shared_dir(spark))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later passes read it instead of running the plan again, whichever executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like cut(), as a compressed columnar table in the shared folder: for wide rows read column by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_rows(docs: DataFrame) -> Column:
    """A row of docs as one value, so that helper columns beside it clash with none of its names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def apart(df: DataFrame, key: str) -> DataFrame:
    """df, an aggregate by the whole number key, to be joined by it with rows of which one key may have very many.

    As a value of its own the key is exchanged once more before the join. Spark splits the partitions of a skewed join only if both sides
    come from an exchange, which a side straight from its aggregate does not.
    """
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long"))).hint("merge")


def words(text: Column) -> Column:
    """Array of the words of a text; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda x: x != F.lit(""))


def shuffle_partitions(df: DataFrame, least: int = 1) -> int:
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
