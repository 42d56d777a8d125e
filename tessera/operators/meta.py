"""Metadata: first-wins maps, vocabulary, reference links, trees, twins, headers and layout clusters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def first_wins(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """key and the value that came first."""
    return rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def conflicts(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """key, kept and other: values that differ from the first one of their key."""
    kept = first_wins(rows, key, value, order).withColumnRenamed(value, "kept")
    return rows.join(kept, key).where(~F.col(value).eqNullSafe(F.col("kept"))).select(key, "kept", F.col(value).alias("other")).distinct()


def merged_map(existing: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Both maps; what exists wins, conflict marks where they differ."""
    a, b = existing.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    both = a.join(b, key, "full_outer")
    return both.select(key, F.coalesce("old", "new").alias(value), (F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") != F.col("new"))).alias("conflict"))


def vocabulary(existing: DataFrame, found: DataFrame) -> DataFrame:
    """word and pos: the first occurrence wins, existing ones before found ones; words of digits only go. Both have word, pos and seq."""
    rows = existing.withColumn("part", F.lit(0)).unionByName(found.withColumn("part", F.lit(1)))
    # First the least seq of each word as it stands and pos, a number that tasks keep in hash tables; the words, far fewer then, are normalised after that. A null seq comes first.
    held = rows.groupBy("word", "pos", "part", F.col("seq").isNull().alias("none")).agg(F.min("seq").alias("seq")).withColumn("word", F.lower(T.trim_u(F.col("word"))))
    # Tested within the aggregate: a filter of words would be moved to every occurrence.
    good = (F.length("word") >= 2) & ~F.col("word").rlike(r"^[0-9]+$")
    return held.groupBy("word").agg(F.min_by(F.when(good, F.struct("pos")), F.struct("part", "seq")).alias("first")).where("first is not null").select("word", "first.pos")


def twins(rows: DataFrame, stem: str, kind: str, preferred: str) -> DataFrame:
    """rows without those that have a twin of the preferred kind with the same stem."""
    have = rows.where(F.col(kind) == preferred).select(F.lower(stem).alias("_stem")).distinct()
    return rows.where(F.col(kind) != preferred).join(have, F.lower(stem) == F.col("_stem"), "left_anti").unionByName(rows.where(F.col(kind) == preferred))


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos and href of a page's links, in order."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'<a\s+href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("pos", "href"))


def hosted(rows: DataFrame, urls: DataFrame, path: str, base: str = "/download?path=") -> DataFrame:
    """rows with url: as it is if already hosted, else by file name from urls (file_name, url), else a download address."""
    name = F.lower(F.regexp_replace(F.col(path), r"^.*[/\\]", ""))
    out = rows.join(urls.select(F.lower("file_name").alias("_name"), F.col("url").alias("_url")), name == F.col("_name"), "left")
    return out.withColumn("url", F.when(F.col(path).rlike(r"^https?://"), F.col(path)).otherwise(F.coalesce("_url", F.concat(F.lit(base), F.url_encode(F.col(path)))))).drop("_name", "_url")


def numbered(rows: DataFrame, group: list[str], order: list[str], ref: str) -> DataFrame:
    """rows with n: references numbered by first appearance in their group."""
    first = rows.groupBy(*group, ref).agg(F.min(F.struct(*order)).alias("_first"))
    first = first.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy("_first"))).drop("_first")
    return rows.join(first, [*group, ref])


def tree(spark: SparkSession, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, depth and path of all nodes under roots (node), from edges (parent, child, name)."""
    edges.createOrReplaceTempView("_tree_edges")
    roots.createOrReplaceTempView("_tree_roots")
    return spark.sql("""
        WITH RECURSIVE walk(node, depth, path) AS (
          SELECT node, 0, name FROM _tree_roots
          UNION ALL
          SELECT e.child, w.depth + 1, concat(w.path, '/', e.name) FROM walk w JOIN _tree_edges e ON e.parent = w.node)
        SELECT node, depth, path FROM walk""")


def unique_headers(rows: DataFrame, group: str, order: str, header: str) -> DataFrame:
    """Headers filled from the left where empty, repeats numbered from 2."""
    w = Window.partitionBy(group).orderBy(order)
    filled = F.coalesce(F.last(F.nullif(F.trim(F.col(header)), F.lit("")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("column"))
    rows = rows.withColumn("_h", filled)
    n = F.row_number().over(Window.partitionBy(group, "_h").orderBy(order))
    return rows.withColumn(header, F.when(n == 1, F.col("_h")).otherwise(F.concat("_h", F.lit("_"), n.cast("string")))).drop("_h")


def forward_filled(rows: DataFrame, group: str, order: list[str], value: Column, name: str, include: bool = False) -> DataFrame:
    """The last value before each row (or up to it)."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include else -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def gap_clusters(rows: DataFrame, value: str, id_col: str, tolerance: float, group: list[str] | None = None) -> DataFrame:
    """rows with cluster (numbered from the largest values) and its mean: a new cluster begins where the gap to the value before is above the tolerance."""
    w = Window.partitionBy(*(group or [])).orderBy(F.desc(value), id_col)
    starts = F.coalesce(F.lag(value).over(w) - F.col(value) > tolerance, F.lit(True))
    out = rows.withColumn("_s", starts.cast("int"))
    out = out.withColumn("cluster", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")
    return out.withColumn("cluster_mean", F.round(F.avg(value).over(Window.partitionBy(*(group or []), "cluster")), 6))


def repeated_lines(lines: DataFrame, group: str, page: str, share: float = 0.35, most_chars: int = 80) -> DataFrame:
    """group, line and n_pages of short lines that stand on at least two pages and on the given share of a group's pages."""
    pages = lines.groupBy(group).agg(F.countDistinct(page).alias("pages"))
    found = lines.where(F.length("line") <= most_chars).groupBy(group, "line").agg(F.countDistinct(page).alias("n_pages"))
    return found.join(pages, group).where(F.col("n_pages") >= F.greatest(F.lit(2), F.ceil(share * F.col("pages")))).select(group, "line", "n_pages")


#: Cells of boxes have sides of powers of two, from 2 ** LEAST_LEVEL; boxes with a coordinate beyond 2 ** FAR_OUT, or none that is finite, meet all of their page.
LEAST_LEVEL, FAR_OUT, WHOLE = -20, 40, 64


def _levelled(boxes: DataFrame) -> DataFrame:
    """boxes with the corners of their hull and the level of the smallest cell that is as wide and high as they are."""
    rows = boxes.dropna(subset=["x0", "y0", "x1", "y1"]).withColumns({"_lx": F.least("x0", "x1"), "_hx": F.greatest("x0", "x1"), "_ly": F.least("y0", "y1"), "_hy": F.greatest("y0", "y1")})
    side = F.greatest(F.col("_hx") - F.col("_lx"), F.col("_hy") - F.col("_ly")).cast("double")
    far = F.greatest(*[F.abs(c) for c in ("_lx", "_hx", "_ly", "_hy")]).cast("double") <= float(2**FAR_OUT)
    return rows.withColumn("_own", F.when(far, F.greatest(F.ceil(F.log2(side)), F.lit(LEAST_LEVEL))).otherwise(WHOLE).cast("int"))


def _in_cells(rows: DataFrame, levels: list[int]) -> DataFrame:
    """A row for each cell that a box touches, at its own level (two by two, as a rule) and at each larger one that there is; with the first cell of both axes."""
    rows = rows.withColumn("_level", F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x >= F.col("_own"))))
    cell = lambda c: F.when(F.col("_level") == WHOLE, F.lit(0)).otherwise(F.floor(F.col(c) / F.pow(F.lit(2.0), "_level"))).cast("long")
    rows = rows.withColumns({"_fx": cell("_lx"), "_fy": cell("_ly"), "_tx": cell("_hx"), "_ty": cell("_hy")})
    return rows.withColumn("_x", F.explode(F.sequence("_fx", "_tx"))).withColumn("_y", F.explode(F.sequence("_fy", "_ty")))


def box_pairs(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Pairs of boxes (x0, y0, x1, y1) of the same page that meet.

    Boxes meet in cells of a grid, whose size is that of the larger of the two, instead of all of a page; a pair counts in the first cell that both touch.
    Pairs can be many times the boxes, so the cells are dealt to a set number of tasks, whatever the boxes' bytes.
    """
    spark = a.sparkSession
    a, b = _levelled(a), _levelled(b)
    levels = sorted(r["_own"] for r in a.select("_own").union(b.select("_own")).distinct().collect())  # powers of two: 62 at most
    keys = (on, "_level", "_x", "_y")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    l, r = (_in_cells(x, levels or [WHOLE]).repartition(tasks, *keys).alias(name) for x, name in ((a, "l"), (b, "r")))
    key = F.lit(True)
    for c in keys:
        key = key & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    once = (F.col("l._level") == F.greatest("l._own", "r._own")) & (F.col("l._x") == F.greatest("l._fx", "r._fx")) & (F.col("l._y") == F.greatest("l._fy", "r._fy"))
    meet = (F.col("l.x0") <= F.col("r.x1")) & (F.col("r.x0") <= F.col("l.x1")) & (F.col("l.y0") <= F.col("r.y1")) & (F.col("r.y0") <= F.col("l.y1"))
    return l.join(r, key & once & meet)


def interval_matches(points: DataFrame, spans: DataFrame, key: str, before_s: int, after_s: int) -> DataFrame:
    """point_id and span_id where a point's ts lies between ts of the span less before_s and its end plus after_s.

    Time is cut into buckets as wide as the margins, so that equal keys and buckets join by hash instead of all of a key's rows meeting.
    """
    width = max(1, before_s + after_s)
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    p = points.withColumns({"t": sec("ts")}).withColumn("bucket", F.floor(F.col("t") / width))
    s = spans.withColumns({"low": sec("start") - before_s, "high": sec("end") + after_s})
    s = s.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    return p.join(s, [key, "bucket"]).where(F.col("t").between(F.col("low"), F.col("high"))).select(key, "point_id", "span_id")


def row_leaders(elements: DataFrame, page: str, tolerance: float) -> DataFrame:
    """elements (page, top, left) with row and place in reading order: a row takes elements whose top is within the tolerance of its first one's."""

    def of_page(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["top", "left"], kind="stable").reset_index(drop=True)
        row, first, rows = -1, None, []
        for top in frame["top"]:
            if first is None or top - first > tolerance:
                row, first = row + 1, top
            rows.append(row)
        frame["row"] = rows
        frame = frame.sort_values(["row", "left"], kind="stable").reset_index(drop=True)
        frame["place"] = range(len(frame))
        return frame

    schema = elements.schema.simpleString()[7:-1] + ",row:bigint,place:bigint"
    return elements.groupBy(page).applyInPandas(of_page, schema.replace(":", " ", 0))
