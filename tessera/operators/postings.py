"""A stored lexical index: postings by term in blocks of descending weight, and an exact top-k search that takes blocks from the top.

Documents are dealt to shards of about two million postings as they come, and each shard's postings are sorted where they are: a term's postings of a shard lie in blocks of up to BLOCK rows, the
highest weight first. On disk blocks lie in folders by the term's hash, so that a search opens the folders of its queries' terms only, and reads the blocks of these terms. They meet again by shard, once
for all queries of a batch.

In a shard, the blocks of a query's terms are taken in descending order of their part of the score, and what is left of each term bounds what a document may still gain. Once no document
but a few can be among the best k, of this shard, the rest is skipped, and the scores of these few are completed. A query with few postings has them added up at once. So no pair of a query and a document is exchanged, but for the best k of each shard.

Scores are sums of the query's weight times the posting's, rounded before they are ranked; ties go to the smaller id. A query without known terms has no result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.retrieval import DIGITS, ranked
from tessera.session import read_parts, write_parts, written

PARTS, BLOCK, SHARD_POSTINGS = 64, 128, 1 << 21
#: Queries' weights that a batch holds; more queries make more batches.
BATCH = 1 << 18
#: Scores that differ by less can be equal when rounded.
MARGIN = 10.0**-DIGITS * 2
#: A step takes blocks down to this share of the highest part left; as many documents at most, for each of k, have their scores completed.
STEP, FEW = 0.75, 16
#: Up to this many postings for each term of a query are added up at once, which is quicker than steps.
DIRECT = 4096


def part(term: str = "term", parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def slices(batch: pa.RecordBatch, most: int, first: int | None = None) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Pieces of a batch whose second column's lists have up to most items together (the first piece up to first), but a row at least, and how many they have."""
    upto, at, room = np.cumsum(np.diff(batch.column(1).offsets.to_numpy())), 0, most if first is None else first
    while at < batch.num_rows:
        before = int(upto[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, before + room, side="right")))
        yield batch.slice(at, stop - at), int(upto[stop - 1]) - before
        at, room = stop, most


def build(entries: DataFrame, path: str, parts: int = PARTS, weigh: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> None:
    """Writes the index of entries (id, terms: hashes, ws: their weights), a row a document, to a new folder. Nothing but finished blocks is exchanged.

    weigh makes entries of a task's batches, of which the first column is id then.
    """
    kind = dict(entries.dtypes)["id"]

    def blocks(ids: list, counts: list, terms: list, ws: list, shard: int) -> pa.RecordBatch:
        counts = np.concatenate(counts)
        term, w = np.concatenate(terms), np.concatenate(ws)
        at = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((-w, term))  # stable, so that equal weights stay in the order of documents
        term, n = term[order], len(order)
        run = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        place = np.arange(n) - np.repeat(run, np.diff(np.append(run, n)))
        starts = np.flatnonzero(place % BLOCK == 0)
        offsets = pa.array(np.append(starts, n).astype(np.int32))
        held = pa.concat_arrays(ids).take(pa.array(at[order]))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (held, pa.array(w[order]))]
        return pa.RecordBatch.from_arrays([pa.array(term[starts]), pa.array(np.full(len(starts), shard, np.int64)), *lists], ["term", "shard", "ids", "ws"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, shard = ([], [], [], []), 0, TaskContext.get().partitionId() << 32
        for batch in weigh(batches) if weigh else batches:
            for piece, size in slices(batch, SHARD_POSTINGS, SHARD_POSTINGS - n):
                if n and n + size > SHARD_POSTINGS:
                    yield blocks(*held, shard)
                    held, n, shard = ([], [], [], []), 0, shard + 1
                lists = piece.column(1)
                flat = (x.flatten().to_numpy(zero_copy_only=False) for x in (lists, piece.column(2)))
                for to, x in zip(held, (piece.column(0), np.diff(lists.offsets.to_numpy()), *flat), strict=True):
                    to.append(x)
                n += size
        if n:
            yield blocks(*held, shard)

    rows = entries if weigh else entries.select("id", F.col("terms").cast("array<long>").alias("terms"), F.col("ws").cast("array<double>").alias("ws")).where(F.size("terms") > 0)
    out = rows.mapInArrow(cut, f"term long, shard long, ids array<{kind}>, ws array<double>").withColumn("part", part("term", parts))
    write_parts(out.hint("rebalance", "part").sortWithinPartitions("part", "term"), path, "part")


class Shard:
    """Some documents' postings of a batch's terms: by term in descending order, and by document."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, ws: np.ndarray, n_terms: int, n_docs: int):
        order = np.lexsort((-ws, terms))
        self.docs, self.falling, self.n_docs, self.size = docs[order], -ws[order], n_docs, len(ws)
        self.ends = np.searchsorted(terms[order], np.arange(n_terms + 1))
        by_doc = np.lexsort((terms, docs))
        self.doc_terms, self.doc_ws, self.first = terms[by_doc], ws[by_doc], np.searchsorted(docs[by_doc], np.arange(n_docs + 1))

    def complete(self, docs: np.ndarray, terms: np.ndarray, qw: np.ndarray, n_terms: int) -> np.ndarray:
        weights = np.zeros(n_terms)
        weights[terms] = qw
        lengths = self.first[docs + 1] - self.first[docs]
        starts = np.cumsum(lengths) - lengths
        at = np.arange(lengths.sum()) - np.repeat(starts - self.first[docs], lengths)
        return np.add.reduceat(weights[self.doc_terms[at]] * self.doc_ws[at], starts) if len(docs) else np.zeros(0)

    def best(self, terms: np.ndarray, qw: np.ndarray, k: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the best k, best first, and how many postings were taken."""
        held = (self.ends[terms] < self.ends[terms + 1]) & (qw > 0)
        some, w = terms[held], qw[held]
        at, end = self.ends[some].copy(), self.ends[some + 1]
        if (end - at).sum() <= DIRECT * len(some):
            entries = np.concatenate([np.arange(a, b) for a, b in zip(at, end)]) if len(some) else np.zeros(0, np.int64)
            sums = np.bincount(self.docs[entries], np.repeat(w, end - at) * -self.falling[entries], self.n_docs)
            met = np.zeros(self.n_docs, bool)
            met[self.docs[entries]] = True
            may = np.flatnonzero(met)
            if len(may) > k:
                may = may[sums[may] >= np.partition(sums[may], len(may) - k)[len(may) - k] - MARGIN]
            keep = np.lexsort((may, -np.round(sums[may], DIGITS)))[:k]
            return may[keep], sums[may[keep]], len(entries)
        sums, met, taken = np.zeros(self.n_docs), np.zeros(self.n_docs, bool), 0
        left = -w * self.falling[at] if len(some) else w
        least = -np.inf
        while (at < end).any():
            level = left.max() * STEP
            for i in np.flatnonzero((left >= level) & (at < end)):
                upto = max(at[i] + 1, at[i] + int(np.searchsorted(self.falling[at[i] : end[i]], -level / w[i], side="right")))
                sums[self.docs[at[i] : upto]] -= w[i] * self.falling[at[i] : upto]
                met[self.docs[at[i] : upto]] = True
                taken += upto - at[i]
                at[i] = upto
                left[i] = -w[i] * self.falling[upto] if upto < end[i] else 0.0
            if self.n_docs > k and np.count_nonzero(met) >= k:
                bound = left.sum()
                least = np.partition(sums, self.n_docs - k)[self.n_docs - k] - MARGIN
                if bound < least and np.count_nonzero(sums + bound >= least) <= FEW * k:
                    break
        may = np.flatnonzero(met & (sums + left.sum() >= least))
        score = self.complete(may, some, w, n_terms)
        keep = np.lexsort((may, -np.round(score, DIGITS)))[:k]
        return may[keep], score[keep], taken


def search(spark: SparkSession, path: str, query_w: DataFrame, k: int, parts: int = PARTS) -> DataFrame:
    """query_id, id, score and rank of queries (query_id, term: a hash, qw): exact, as retrieval.sparse_topk over all postings."""
    asked = written(query_w.select("query_id", "term", F.col("qw").cast("double").alias("qw"), part("term", parts).alias("part")).where("qw > 0"))
    batches = max(1, math.ceil(asked.count() / BATCH))
    out = None
    for b in range(batches):
        one = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == b)
        found = ranked(best_of_shards(spark, path, one, k).withColumn("score", F.round("score", DIGITS)), k)
        out = found if out is None else out.unionByName(found)
    return out


def opened(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The blocks of the terms of asked (term, part): of their folders, their rows."""
    folders = [r["part"] for r in asked.select("part").distinct().collect()]  # as many as the index has at most
    return read_parts(spark, path).where(F.col("part").isin(folders)).join(asked.select("part", "term").distinct(), ["part", "term"], "left_semi")


def best_of_shards(spark: SparkSession, path: str, asked: DataFrame, k: int) -> DataFrame:
    """query_id, id and score: the best k of each shard for each query of a batch, which is broadcast (BATCH weights or so)."""
    rows = asked.select("query_id", "term", "qw").toPandas()
    known = np.unique(rows["term"].to_numpy(np.int64))
    queries = [(q, np.searchsorted(known, f["term"].to_numpy(np.int64)), f["qw"].to_numpy(float)) for q, f in rows.groupby("query_id")]
    shared = spark.sparkContext.broadcast((known, queries))
    blocks = opened(spark, path, asked)
    kinds = dict(asked.dtypes)["query_id"], dict(blocks.dtypes)["ids"].removeprefix("array<").removesuffix(">")

    def of_shard(table: pa.Table) -> pa.Table:
        known, queries = shared.value
        table = table.combine_chunks()
        column = lambda name: table.column(name).combine_chunks() if table.num_rows else table.column(name)
        ids, ws = column("ids"), column("ws")
        counts = np.diff(ids.offsets.to_numpy())
        names = pc.unique(ids.flatten())
        names = names.take(pc.sort_indices(names))
        docs = pc.index_in(ids.flatten(), names).to_numpy()
        terms = np.repeat(np.searchsorted(known, column("term").to_numpy()), counts)
        shard = Shard(terms, docs, ws.flatten().to_numpy(), len(known), len(names))
        found = [(q, *shard.best(t, w, k, len(known))[:2]) for q, t, w in queries]
        asked = [q for q, d, _ in found for _ in range(len(d))]
        at = np.concatenate([d for _, d, _ in found]) if found else np.zeros(0, np.int64)
        score = np.concatenate([s for _, _, s in found]) if found else np.zeros(0)
        return pa.table({"query_id": pa.array(asked, pa.int64() if kinds[0] == "bigint" else None), "id": names.take(pa.array(at)), "score": pa.array(score)})

    return blocks.select("shard", "term", "ids", "ws").groupBy("shard").applyInArrow(of_shard, f"query_id {kinds[0]}, id {kinds[1]}, score double")
