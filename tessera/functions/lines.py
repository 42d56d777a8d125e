"""Texts as rows of lines, with what lies in code blocks marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.cleaning import stripped

KEY, AT, ROW = "__text", "__at", "__row"


def lines_of(df: DataFrame, text: Column) -> DataFrame:
    """A row for each line of a text: the row of df it comes from (as one value), a number of the text, the line's place, line, bare (without blanks around) and code.

    A line is code if it is a fence, or if the number of fences before it is odd. A null is an empty text, which has one empty line.
    """
    broken = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), broken.alias("lines"), F.monotonically_increasing_id().alias(KEY))
    rows = rows.select(ROW, KEY, F.posexplode("lines").alias(AT, "line")).withColumn("bare", stripped(F.col("line")))
    fence = F.col("bare").startswith("```")
    before = F.count_if(fence).over(Window.partitionBy(KEY).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("code", fence | (before % 2 == 1))


def runs_of(rows: DataFrame, holds: Column, name: str) -> DataFrame:
    """rows with a number for each run of neighbouring lines for which holds has one value."""
    order = Window.partitionBy(KEY).orderBy(AT)
    rows = rows.withColumn(name, F.coalesce((holds != F.lag(holds).over(order)).cast("int"), F.lit(0)))
    return rows.withColumn(name, F.sum(name).over(order))
