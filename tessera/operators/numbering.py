"""Numbering rows within groups of any size, in two passes.

The rows are sorted as a whole by group and order, which deals them to ranges, and each range is numbered for itself as it is written. The counts of
the ranges, one row for each group in each range, give what lies before a range. So a group that holds most of the rows is spread over many ranges,
and no task ever holds one as a window would.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written

_PART, _POS, _AT, _FIRST, _BEFORE = "__part", "__pos", "__at", "__first", "__before"
_WITHIN = (1 << 33) - 1
ROWS = 1 << 18


def numbered(df: DataFrame, groups: list[str], order: list[Column], name: str = "row_number", total: str | None = None, count: int | None = None) -> DataFrame:
    """df with each row's number from 1 within its group (one for all rows without groups), in the given order, as a long; total adds the group's count of rows.

    Nulls in group columns are a group of their own. Rows equal in group and order are numbered in no particular order among themselves;
    so order should end in something that tells rows apart. df is evaluated twice, once for a sample: give it stored if it costs much.

    count, the number of rows, makes ranges of about ROWS rows. Without it, Spark puts ranges together by their compressed bytes, so that a task may sort very many rows that compress well.
    """
    keys = [*[F.col(g) for g in groups], *order]
    if count is None:
        ordered = df.orderBy(*keys)
    else:
        ranges = max(1, math.ceil(count / ROWS), min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(count / 4096)))
        ordered = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    ranges = written(ordered.withColumn(_AT, at).withColumns({_PART: F.shiftright(_AT, 33), _POS: F.col(_AT).bitwiseAND(F.lit(_WITHIN))}).drop(_AT))
    counts = ranges.groupBy(_PART, *groups).agg(F.count(F.lit(1)).alias("n"), F.min(_POS).alias(_FIRST))
    earlier = Window.partitionBy(*groups).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    held = counts.withColumn(_BEFORE, F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    if total:
        held = held.withColumn(total, F.sum("n").over(Window.partitionBy(*groups)))
    same = F.col(f"r.{_PART}") == F.col(f"h.{_PART}")
    for g in groups:
        same = same & F.col(f"r.{g}").eqNullSafe(F.col(f"h.{g}"))
    number = (F.col(f"r.{_POS}") - F.col(f"h.{_FIRST}") + F.col(f"h.{_BEFORE}") + 1).cast("long")
    return ranges.alias("r").join(held.alias("h"), same).select(*[F.col(f"r.`{c}`") for c in df.columns], number.alias(name), *([F.col(f"h.{total}").cast("long").alias(total)] if total else []))
