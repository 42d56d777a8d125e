"""Exact top-k search by inner product with multi-resolution segment statistics.

The vectors are cut into segments. For two vectors, the means and deviations of a segment bound the part of the inner
product that lies in it from above (which bounds the distance from below): length times (mean times mean plus deviation times deviation).
A block of candidates is first bounded with 4 segments, then what may still enter a query's best k with 16, and only the
survivors are multiplied out. Results are exact, bounds carry a margin for rounding.

Queries and candidates meet in blocks of at most about a million by two million components (16,384 by 32,768 rows of 64), dealt by a hash of the
row's number: a pair of blocks is one task's work in bounded memory, and gives k rows for each of its queries at most. A second step takes the best k of those.
So each vector moves once for each block of the other side; the usable ones lie in a checkpoint, in which they are numbered.

Defined cases: a row without id is no query, but a candidate like any other, after all ids among equal scores; null vectors and vectors with a null, NaN or infinite component take no part; vectors
are compared with vectors of their length; equal scores go to the smaller id; rows are told apart by their place, so one that repeats a query's id, or its id
and vector, is a query of its own and the other's candidate; a query with fewer than k candidates gets all of them, and without any no row; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

#: Components of a block of queries and of one of rows, and rows that are bounded at a time.
QUERY_BLOCK, ROW_BLOCK, SUB_BLOCK = 1 << 20, 1 << 21, 1024
RESOLUTIONS = (4, 16)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments of each row, scaled so that the product of two rows is the bound."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1])) if x.shape[1] else []
    out = []
    for p in parts:
        own, root = x[:, p], math.sqrt(len(p))
        out += [own.mean(1) * root, own.std(1) * root]
    return np.stack(out, 1) if out else np.zeros((len(x), 1))


def best(q: np.ndarray, q_own: np.ndarray, x: np.ndarray, ids: np.ndarray, absent: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, places in x and which of them there are (rows: queries, k columns) of the k best of x for each row of q.

    x and q are whole numbers; absent marks rows without id; own are the numbers of rows, equal for a query and its own row.
    """
    order = np.lexsort((own, ids, absent))
    x, own = x[order], own[order]
    qf, xf = q.astype(float), x.astype(float)
    top = np.sqrt((qf * qf).sum(1).max(initial=0) * (xf * xf).sum(1).max(initial=0))
    exact = (qf, xf) if top < 2.0**52 else (q.astype(np.int64), x.astype(np.int64))
    margin = 1e-9 * top + 1e-6
    stats = [(statistics(qf, s), statistics(xf, s)) for s in RESOLUTIONS]
    floor = -np.inf if exact[0].dtype.kind == "f" else np.iinfo(np.int64).min
    scores = np.full((len(q), k), floor, dtype=exact[0].dtype)
    found = np.full((len(q), k), -1, dtype=np.int64)
    has = np.zeros((len(q), k), dtype=bool)
    for at in range(0, len(x), SUB_BLOCK):
        cols = np.arange(at, min(at + SUB_BLOCK, len(x)))
        rows = np.arange(len(q))
        for of_q, of_x in stats:
            least = np.where(has[rows, -1], scores[rows, -1].astype(float), -np.inf) - margin
            may = of_q[rows] @ of_x[cols].T >= least[:, None]
            rows, cols = rows[may.any(1)], cols[may.any(0)]
        if not len(rows) or not len(cols):
            continue
        got = exact[0][rows] @ exact[1][cols].T
        # Candidates come in the order of their ids, so that an equal score never displaces an earlier one.
        better = ((got > scores[rows, -1][:, None]) | ~has[rows, -1][:, None]) & (q_own[rows][:, None] != own[cols][None, :])
        for i in np.flatnonzero(better.any(1)):
            r, c = rows[i], np.flatnonzero(better[i])
            now = int(has[r].sum())
            s = np.concatenate([scores[r, :now], got[i, c]])
            n = np.concatenate([found[r, :now], order[cols[c]]])
            keep = np.argsort(-s, kind="stable")[:k]
            scores[r, : len(keep)], found[r, : len(keep)], has[r, : len(keep)] = s[keep], n[keep], True
    return np.where(has, scores, 0).astype(np.int64), found, has


def usable(vec: Column) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score from vectors (vec_id, embedding) and a condition on vec_id."""
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), vec.alias("vec")).where(usable(F.col("vec")))
    # A null would turn whole numbers into floats on their way.
    rows = cut(rows.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("absent"), F.transform("vec", lambda x: F.floor(x * scale)).alias("vec"), F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("own")))
    is_query = ~F.col("absent") & is_query
    queries = rows.where(is_query)
    n, m, width = rows.agg(F.count(F.lit(1)), F.count_if(is_query), F.max("dim")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # Few rows are dealt to more blocks than memory needs, to use all cores.
    row_blocks = max(1, math.ceil(n * max(1, width or 0) / ROW_BLOCK), min(cores, math.ceil(n / (4 * SUB_BLOCK))))
    query_blocks = max(1, math.ceil(m * max(1, width or 0) / QUERY_BLOCK))
    block = lambda seed, blocks: F.pmod(F.xxhash64(F.lit(seed), "own"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = queries.withColumn("qb", block(1, query_blocks)).withColumn("rb", every(row_blocks))
    right = rows.withColumn("rb", block(2, row_blocks)).withColumn("qb", every(query_blocks))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "own": [], "vec_id": [], "score": []}
        if len(a) and len(b):
            number = lambda f: np.vstack(f["vec"].to_numpy()).astype(np.int64) if int(f["dim"].iloc[0]) else np.zeros((len(f), 0), np.int64)
            scores, rows, has = best(number(a), a["own"].to_numpy(), number(b), b["id"].to_numpy(), b["absent"].to_numpy(), b["own"].to_numpy(), k)
            at, place = np.nonzero(has)
            rows = rows[at, place]
            ids = pd.array(b["id"].to_numpy()[rows], "Int64")
            ids[b["absent"].to_numpy()[rows]] = pd.NA
            out = {"query_id": a["id"].to_numpy()[at], "own": a["own"].to_numpy()[at], "vec_id": ids, "score": scores[at, place]}
        return pd.DataFrame(out)

    keys = ["dim", "rb", "qb"]
    some = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, own long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "own").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.r <> q.r AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
