import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import pivots, postings, stored_index
from tessera.operators import retrieval as R
from tessera.session import scratch, written


def sparse_rows(seed, n_docs, n_terms):
    r = random.Random(seed)
    return [(d, f"t{t}", round(r.choice([0.1, 0.5, 1.0, 1.0, 2.5]) * r.random() ** 3 + 0.01, 3)) for d in range(n_docs) for t in {int(n_terms * r.random() ** 3) for _ in range(12)}]


def as_set(df):
    return sorted((r["query_id"], r["id"], round(r["score"], 6), r["rank"]) for r in df.collect())


def entries(rows):
    """(id, term, w) as a row a document, terms hashed."""
    return rows.groupBy("id").agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "w")).alias("e")).select("id", F.transform("e", lambda x: x["t"]).alias("terms"), F.transform("e", lambda x: x["w"]).alias("ws"))


def hashed(df):
    return df.withColumn("term", F.xxhash64("term"))


@pytest.mark.parametrize("shard, block", [(50, 3), (1 << 20, 128)])
def test_stored_postings_equal_whole_sums(spark, monkeypatch, shard, block):
    """Hot and rare terms, ties, queries with fewer results than asked for, unknown terms, weights of 0, several shards and batches."""
    monkeypatch.setattr(postings, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "BATCH", 10)
    rows = spark.createDataFrame(sparse_rows(1, 900, 60), "id long, term string, w double").repartition(5)
    asked = [(q, f"t{t}", w) for q, terms in enumerate([[0], [0, 1, 2], [0, 55, 58], [59], [7, 20, 33, 41, 0], [99]]) for t, w in zip(terms, [1.5, 0.5, 3.0, 2.0, 0.1])] + [(9, "t0", 0.0)]
    query_w = hashed(spark.createDataFrame(asked, "query_id long, term string, qw double"))
    at = scratch(spark)
    postings.build(entries(rows), at, parts=4)
    for k in (3, 1000):
        want = R.sparse_topk(query_w.where("qw > 0"), hashed(rows), k)
        assert as_set(postings.search(spark, at, query_w, k, parts=4)) == as_set(want)


def test_a_search_opens_its_terms_folders_and_blocks(spark):
    rows = spark.range(3000).selectExpr("id", "array(xxhash64('hot'), xxhash64(concat('t', id % 500))) as terms", "array(1.0D / (1 + id % 1000), 2.0D) as ws")
    at = scratch(spark)
    postings.build(rows, at)
    asked = hashed(spark.createDataFrame([("hot",), ("t7",)], "term string")).withColumn("part", postings.part())
    blocks = postings.opened(spark, at, asked)
    assert "PartitionFilters: [part" in blocks._jdf.queryExecution().executedPlan().toString()
    assert blocks.agg(F.sum(F.size("ids"))).first()[0] == 3000 + 6 and blocks.agg(F.max(F.size("ids"))).first()[0] <= postings.BLOCK


def test_blocks_are_skipped_and_results_exact():
    r = np.random.default_rng(1)
    n_docs, n_terms = 20_000, 30
    terms = np.concatenate([np.zeros(n_docs, np.int64), r.integers(1, n_terms, 3000)])
    docs = np.concatenate([np.arange(n_docs), r.integers(0, n_docs, 3000)])
    keep = np.unique(terms * n_docs + docs, return_index=True)[1]
    terms, docs = terms[keep], docs[keep]
    ws = r.random(len(terms))
    shard = postings.Shard(terms, docs, ws, n_terms, n_docs)
    asked, qw = np.array([0, 3, 4, 5]), np.array([0.1, 3.0, 3.0, 3.0])
    got, score, taken = shard.best(asked, qw, 10, n_terms)
    whole = np.zeros(n_docs)
    for t, w in zip(asked, qw):
        np.add.at(whole, docs[terms == t], w * ws[terms == t])
    order = np.lexsort((np.arange(n_docs), -np.round(whole, 6)))[:10]
    assert got.tolist() == order.tolist() and np.allclose(score, whole[order]) and taken < 2000


def vectors(seed, n, spread):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(12, 16))
    x = centers[r.integers(0, 12, n)] + spread * r.normal(size=(n, 16))
    x[5] = 0.0
    x[6:60] = x[4]  # copies: ties, and a pivot chosen twice
    return [(int(i), v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("spread, cell", [(1.0, 8192), (0.05, 37)])
def test_stored_vectors_equal_all_pairs(spark, monkeypatch, spread, cell):
    monkeypatch.setattr(pivots, "CELL", cell)
    rows = spark.createDataFrame(vectors(3, 1500, spread), "id long, vec array<double>").repartition(6)
    asked = rows.where("id % 9 < 2").withColumnRenamed("id", "query_id")
    at = scratch(spark)
    pivots.build(rows, at)
    for k, own in ((1, True), (10, False)):
        found = pivots.Search(spark, at, asked, k, exclude_self=own)
        assert as_set(found.topk()) == as_set(R.dense_topk(asked, rows, k, exclude_self=own))
    opened = [r["rows"] for r in found.opened().where("query_id > 60").collect()]
    if spread < 0.1:
        assert sum(opened) / len(opened) < 1500 / 3  # of clusters, a query opens a few


def test_vectors_are_stored_as_they_come(spark):
    """Floats stay floats: doubles were twice the bytes wherever vectors and queries are written or sent."""
    rows = spark.createDataFrame(vectors(3, 40, 1.0), "id long, vec array<float>")
    at = scratch(spark)
    pivots.build(rows, at)
    found = pivots.Search(spark, at, rows.withColumnRenamed("id", "query_id"), 3)
    assert dict(found.rows.dtypes)["vec"] == dict(found.homes().dtypes)["vec"] == "array<float>"
    assert as_set(found.topk()) == as_set(R.dense_topk(rows.withColumnRenamed("id", "query_id"), rows, 3))


def test_few_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id long, vec array<double>")
    asked = rows.withColumnRenamed("id", "query_id")
    at = scratch(spark)
    pivots.build(rows, at)
    assert as_set(pivots.search(spark, at, asked, 5)) == as_set(R.dense_topk(asked, rows, 5))
    assert pivots.search(spark, at, asked.where("query_id = 9"), 5).collect() == []
    empty = scratch(spark)
    pivots.build(rows.where("id > 9"), empty)
    assert pivots.search(spark, empty, asked, 5).collect() == []
    nothing = scratch(spark)
    postings.build(spark.createDataFrame([], "id long, terms array<long>, ws array<double>"), nothing)
    assert postings.search(spark, nothing, spark.createDataFrame([(1, 5, 1.0)], "query_id long, term long, qw double"), 5).collect() == []


def test_overlapping_row_by_row(spark, monkeypatch):
    """Rows are compared as they are, repeated ids included; a table of items and documents is met in parts, items in batches; pairs are not exchanged."""
    import random

    from tessera.operators import evaluation

    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(n))
    items = [(i % 30, text(rnd.randint(1, 6))) for i in range(40)] + [(50, None), (51, "x ?")]
    docs = [(i % 90, text(rnd.randint(0, 4))) for i in range(120)] + [(95, None)]
    want = sorted((i, d) for i, t in items for d, u in docs if t and t != "x ?" and len({*t.split()} & {*(u or "").split()}) / len({*t.split()}) >= 0.45)
    given = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    found = lambda: sorted(tuple(r) for r in evaluation.overlapping(*given).collect())
    assert found() == want
    assert "Exchange" not in evaluation.overlapping(*given)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(evaluation, "BATCH", 40)
    monkeypatch.setattr(evaluation, "CELLS", 64)
    assert found() == want
    assert not evaluation.overlapping(given[0].limit(0), given[1]).collect()


def test_lexical_index_keeps_no_counted_words(spark, monkeypatch):
    """Texts are cut, counted and put in blocks by one task, a few words at a time; results equal those of an Index, and only the statistics are written beside the index. F15."""
    monkeypatch.setattr(stored_index, "SLICE", 3)
    monkeypatch.setattr(postings, "SHARD_POSTINGS", 40)
    kept = []
    monkeypatch.setattr(stored_index, "written", lambda df: kept.append(df.columns) or written(df))
    texts = [None, "", " -- ", "一二三 İs a", *(f"w{i % 7} w{i % 3} W{i % 3} v{i}" for i in range(60)), *["same text"] * 5, "w1 " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "w1 w2 same"), (2, "二三 i"), (3, "nothing known"), (4, "v5 v6 text w0")], "query_id long, query string")
    at = scratch(spark)
    stored_index.build_lexical(docs, "id", "text", at)
    got, want = stored_index.StoredIndex(docs, "id", "text", at).sparse(asked, 4), R.Index(docs, "id", "text").sparse(asked, 4)
    assert as_set(got) == as_set(want) and got.count() > 8
    assert kept == [["n", "avgdl"]]
    nothing = scratch(spark)
    stored_index.build_lexical(docs.limit(0), "id", "text", nothing)
    assert stored_index.StoredIndex(docs.limit(0), "id", "text", nothing).sparse(asked, 4).collect() == []


def test_few_postings_are_added_up_at_once():
    """As steps give them, with weights of 0 and ties; no step is taken. F15."""
    r = np.random.default_rng(2)
    n_docs, n_terms = 400, 30
    pairs = np.unique(r.integers(0, n_docs * n_terms, 3000))
    terms, docs, ws = pairs // n_docs, pairs % n_docs, r.integers(0, 4, len(pairs)) / 4
    shard = postings.Shard(terms, docs, ws, n_terms, n_docs)
    asked, qw = np.arange(0, n_terms, 3), r.random(10)
    for k in (5, 1000):
        got, score, taken = shard.best(asked, qw, k, n_terms)
        whole = np.bincount(docs, np.where(terms % 3 == 0, qw[terms // 3 % 10] * ws, 0), n_docs)
        met = np.unique(docs[terms % 3 == 0])
        order = met[np.lexsort((met, -np.round(whole[met], 6)))][:k]
        assert got.tolist() == order.tolist() and np.allclose(score, whole[order]) and taken == (terms % 3 == 0).sum()
