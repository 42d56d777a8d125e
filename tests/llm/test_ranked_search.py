import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """All scores of all pairs, sorted."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, c in held if c)
    length = sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        own = set(terms(text))
        scores = []
        for i, c in held:
            if c:
                m = 100 - 90 + (90 * c.total() * n) // length
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in own & c.keys())
                scores += [(i, s)] if s > 0 else []
        scores.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(item, rank, i, s) for rank, (i, s) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def found(docs, items, **more):
    return sorted(map(tuple, ranked_search.ranked(docs, items, **more).select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = [(1, "the beta ABC it's é9 the"), (2, None), (3, ""), (4, "?!"), (None, "x9 abc"), (1, "zeta"), (5, "nowhere"), (1, "zeta")]


def corpus(seed, n):
    r = random.Random(seed)
    words = ["the", "abc", "beta", "zeta", "it", "s", "é9", "x9"] + [f"w{i}" for i in range(60)]
    return [(i, " ".join(r.choices(words, [40, 20, 3, 2, 9, 9, 1, 1] + [2] * 60, k=r.choice([1, 5, 30, 300])))) for i in range(n)]


def test_equals_brute_force_on_odd_rows(spark, docs):
    items = spark.createDataFrame([(*x, "s", 1) for x in ITEMS], "item_id long, text string, doc_id string, score int")
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(corpus(1, 300) + [(7, "abc beta"), (7, "abc beta"), (None, "abc beta")], "doc_id long, text string"))
    plain = [(r["doc_id"], r["text"]) for r in more.collect()]
    more = more.withColumns({"score": F.lit("s"), "item_id": F.lit(1), "n": F.lit(0), "terms": F.lit("t")})
    assert found(more, items) == brute(plain, ITEMS)
    assert found(more, items, k=3, block_terms=4) == brute(plain, ITEMS, 3)  # several blocks


def test_many_copies_tie_to_the_smaller_id(spark):
    """A third of all documents are copies, and one word is in nearly all of them."""
    plain = [(i, "beta abc the" if i % 3 == 0 else f"the w{i}") for i in range(3000)]
    df = spark.createDataFrame(plain, "doc_id long, text string").repartition(5)
    items = [(1, "the beta abc"), (2, "the"), (3, "w100 the")]
    assert found(df, spark.createDataFrame(items, "item_id long, text string")) == brute(plain, items)


@pytest.mark.parametrize("size", [1, 50, 1 << 21])
def test_shards_of_any_size(spark, monkeypatch, size):
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", size)
    plain = corpus(5, 200)
    df = spark.createDataFrame(plain, "doc_id long, text string").coalesce(1)
    # Bound in the closure of this process only: the shards of a search are cut here.
    items = [(1, "the beta abc zeta"), (2, "w1 w2 w3 é9")]
    assert found(df, spark.createDataFrame(items, "item_id long, text string")) == brute(plain, items)


def test_bounds_end_a_search_early_and_exactly(monkeypatch):
    """Rare terms decide; the frequent one's postings are not all read, and results equal those of whole sums."""
    r = np.random.default_rng(1)
    n_docs, vocabulary = 20_000, 30
    rows = [np.unique(np.concatenate([[0], 1 + np.flatnonzero(r.random(vocabulary - 1) < 0.002)])) for _ in range(n_docs)]
    counts = np.array([len(x) for x in rows])
    shard = ranked_search.Shard(r.integers(5, 400, n_docs), counts, np.concatenate(rows).astype(np.int32), r.integers(1, 9, counts.sum()), vocabulary, n_docs, 200 * n_docs)
    weights = np.array([200] + [6000] * (vocabulary - 1))
    completed = []
    monkeypatch.setattr(ranked_search.Shard, "complete", lambda self, docs, w, f=ranked_search.Shard.complete: (completed.append(len(docs)), f(self, docs, w))[1])
    for own in ([0, 1, 2, 3, 4], [0, 5], [7], [0]):
        own = np.array(own)
        only = np.zeros_like(weights)
        only[own] = weights[own]
        whole = np.add.reduceat(only[shard.terms] * shard.impacts, shard.first[:-1])
        order = np.lexsort((np.arange(n_docs), -whole))[:10]
        docs, scores = shard.best(own, weights, 10)
        assert docs.tolist() == order.tolist() and scores.tolist() == whole[order].tolist()
        floor = int(whole[order[4]])
        docs, scores = shard.best(own, weights, 10, floor)
        assert docs.tolist() == [d for d in order.tolist() if whole[d] >= floor]
    assert completed and max(completed) <= ranked_search.FEW * 10


def test_empty_tables(spark, no_docs, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "abc")], "item_id long, text string")
    assert found(no_docs, some) == [] and found(docs, none) == [] and found(no_docs, none) == []
