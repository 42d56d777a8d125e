"""Session and table helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.master(master) if master else builder
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors reach.

    Where it is unset, a session on one machine keeps what it writes beside its warehouse; on a cluster there is no folder to fall back to, and this fails.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/tessera-checkpoints").rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in a scratch folder: for what several parts of a plan read."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_parts(df: DataFrame, path: str, by: str) -> None:
    """df in folders by a column, at path/rows, with its columns in path/columns: so that it can be read where no row came out."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")
