"""Ranked lexical search, a score at a time over impact-ordered postings.

A posting's impact is its part of a document's score without the weight of the term. Documents are cut into words once: what is kept of
each is its length and the counts of those terms that some item holds. Counts over all documents give weights and impacts. Then each task takes its
documents in shards of bounded size, and turns a shard into postings by term, grouped by exact impact in descending order.

For an item, the groups of all its terms are taken in descending order of weight times impact, whole groups at a time in steps of about a quarter, and added
to its documents' sums. What is left of a term can add no more than its next group does; so the sum of these bounds what any document may still gain.
The item is done only when these bounds prove that the best k lie among a few documents (or when no group is left): a document stays out only if its sum
and the bound are together below the k-th best sum, of this shard or of the task's earlier ones. Scores of the few are completed from their own terms.
A shard gives its best k an item, of which Spark keeps the best k by task and then over all, so no pair of an item and a document moves but those.

Items are searched in blocks of at most about a quarter of a million terms (BLOCK_TERMS), whose vocabulary and weights are broadcast; more items make more
blocks, each of which reads the documents again.

Defined cases: a null, empty or wordless text is no document and, as an item, has no result; terms in all of very many documents can have weight 0 and add nothing; a document
with score 0 is no result; equal scores go to the smaller id, a null id last; rows equal in id and text are documents, or items, of their own;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, stored, table
from tessera.llm.words import cut_words, texts

K, LENGTH_SHARE = 10, 90
BLOCK_TERMS = 1 << 18
#: Postings of a shard, which a task searches at a time.
SHARD_POSTINGS = 1 << 21
#: A step takes groups down to this share of the largest one left; as many documents at most, for each of k, have their scores completed.
STEP, FEW = 0.75, 16


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """A term's share of a document's score, less its weight, from its occurrences and the document's length."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // words
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Shard:
    """Some documents: their terms in the order of documents, and the same postings by term in descending order of impact."""

    def __init__(self, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, tf: np.ndarray, vocabulary: int, documents: int, words: int):
        doc = np.repeat(np.arange(len(n)), counts)
        self.first, self.terms, self.size = np.concatenate([[0], np.cumsum(counts)]), terms, len(n)
        self.impacts = impacts(tf.astype(np.int64), n.astype(np.int64)[doc], documents, words)
        order = np.lexsort((-self.impacts, terms))
        self.by_term, self.falling = doc[order], -self.impacts[order]
        self.ends = np.searchsorted(terms[order], np.arange(vocabulary + 1))

    def complete(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of docs, each of which has a term; weights has one for each term of the vocabulary."""
        lengths = self.first[docs + 1] - self.first[docs]
        starts = np.cumsum(lengths) - lengths
        at = np.arange(lengths.sum()) - np.repeat(starts - self.first[docs], lengths)
        return np.add.reduceat(weights[self.terms[at]] * self.impacts[at], starts) if len(docs) else np.zeros(0, np.int64)

    def best(self, item_terms: np.ndarray, weights: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best for an item, best first, of those with a score above 0 and of floor at least."""
        item_terms = item_terms[(self.ends[item_terms] < self.ends[item_terms + 1]) & (weights[item_terms] > 0)]
        w, at, end = weights[item_terms], self.ends[item_terms].copy(), self.ends[item_terms + 1]
        sums = np.zeros(self.size, np.int64)
        left = -w * self.falling[at] if len(at) else w
        seen, least = 0, floor
        while left.any():
            level = max(1, int(left.max() * STEP))
            for i in np.flatnonzero(left >= level):
                # The groups whose impact times w is level or more.
                upto = at[i] + np.searchsorted(self.falling[at[i] : end[i]], -(-(-level // w[i])), side="right")
                sums[self.by_term[at[i] : upto]] -= w[i] * self.falling[at[i] : upto]
                seen += upto - at[i]
                at[i] = upto
                left[i] = -w[i] * self.falling[upto] if upto < end[i] else 0
            bound = int(left.sum())
            if bound and seen >= k and self.size > k:
                least = max(floor, int(np.partition(sums, self.size - k)[self.size - k]))
                if bound < least and np.count_nonzero(sums + bound >= least) <= FEW * k:
                    break
        may = np.flatnonzero((sums + int(left.sum()) >= least) & (sums > 0))
        score = self.complete(may, self._only(weights, item_terms)) if left.any() else sums[may]
        keep = np.flatnonzero(score >= max(floor, 1))
        keep = keep[np.lexsort((may[keep], -score[keep]))[:k]]
        return may[keep], score[keep]

    @staticmethod
    def _only(weights: np.ndarray, item_terms: np.ndarray) -> np.ndarray:
        out = np.zeros_like(weights)
        out[item_terms] = weights[item_terms]
        return out


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number of its row), item_id and its distinct terms, of items (item_id, text) with a term."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(cut_words(t))) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], ["item", "item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = cut(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))
    return rows.mapInArrow(terms, f"item long, item_id {kind}, terms array<binary>").where(F.size("terms") > 0)


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (its words), terms (numbers of the vocabulary, ascending) and tf, a row for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    size = max(1, len(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            n, keys, tf, counts = [], [], [], []
            for text in texts(batch):
                words = cut_words(text)
                n.append(len(words))
                ids, occurrences = np.unique(np.array([x for x in map(number, words) if x is not None], np.int32), return_counts=True)
                keys.append(ids)
                tf.append(occurrences.astype(np.int32))
                counts.append(len(ids))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0, np.int32))) for x in (keys, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    assert size < 1 << 31
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n long, terms array<int>, tf array<int>")


def search_block(counted: DataFrame, items: list[np.ndarray], weights: np.ndarray, documents: int, words: int, k: int) -> DataFrame:
    """at (place in items), doc_id and score: the best k of each shard for each item."""
    shared = counted.sparkSession.sparkContext.broadcast((items, weights))
    kind = counted.schema["doc_id"].dataType

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        floors: list[np.ndarray] = [np.zeros(0, np.int64) for _ in items]

        def results(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            whole = whole.take(pc.sort_indices(whole, sort_keys=[("doc_id", "ascending")], null_placement="at_end")).combine_chunks()
            column = lambda name: whole.column(name).chunk(0) if whole.column(name).num_chunks else pa.array([], whole.column(name).type)
            lists, tf = column("terms"), column("tf")
            counts = np.diff(lists.offsets.to_numpy())
            shard = Shard(column("n").to_numpy(), counts, lists.flatten().to_numpy(), tf.flatten().to_numpy(), len(weights), documents, words)
            ats, docs, scores = [], [], []
            for at, own in enumerate(items):
                doc, score = shard.best(own, weights, k, int(floors[at][-1]) if len(floors[at]) == k else 0)
                floors[at] = -np.sort(-np.concatenate([floors[at], score]))[:k]
                ats.append(np.full(len(doc), at, np.int32))
                docs.append(doc)
                scores.append(score)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ats)), column("doc_id").take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))], ["at", "doc_id", "score"])

        held, n = [], 0
        for batch in batches:
            # A batch is at most one shard: rows are few thousands, and cut where they hold too many postings.
            upto = np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + SHARD_POSTINGS - n, side="right")))
                held.append(batch.slice(start, stop - start))
                n += int(upto[stop - 1] - (upto[start - 1] if start else 0))
                start = stop
                if n >= SHARD_POSTINGS or start < batch.num_rows:
                    yield results(held)
                    held, n = [], 0
        if held:
            yield results(held)

    some = counted.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tf")
    return some.mapInArrow(search, f"at int, doc_id {kind.simpleString()}, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score: the best k of docs (doc_id, text) for each of items (item_id, text)."""
    asked = cut(item_terms(items))
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_terms))
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    out = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "terms").collect()
        vocabulary = {w: i for i, w in enumerate(sorted({bytes(w) for r in block for w in r["terms"]}))}
        own = [np.array([vocabulary[bytes(w)] for w in r["terms"]], np.int64) for r in block]
        counted = stored(term_counts(docs, vocabulary))
        documents, words = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(vocabulary), np.int64)
        for term, df in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[term] = weight(df, documents)
        found = search_block(counted, own, weights, documents, words, k)
        numbers = docs.sparkSession.createDataFrame([(i, r["item"]) for i, r in enumerate(block)], "at int, item long")
        found = found.join(F.broadcast(numbers), "at").withColumn("rank", best).where(F.col("rank") <= k)
        found = found.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
totals AS (SELECT CAST(count(*) AS BIGINT) AS all_n, CAST(sum(len(terms)) AS BIGINT) AS all_l FROM d WHERE len(terms) > 0),
tf AS (SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY term),
i AS (SELECT q, item_id, unnest(list_distinct(terms)) AS term FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS terms FROM benchmark)),
parts AS (
  SELECT q, item_id, r, doc_id, CAST(floor(1000 * ln((2 * all_n + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * all_n) // all_l))) AS part
  FROM i JOIN tf USING (term) JOIN df USING (term), totals),
scored AS (SELECT q, item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM parts GROUP BY ALL HAVING sum(part) > 0),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
