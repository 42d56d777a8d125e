import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import store


def rows(spark, triples):
    """(id, file_id, content) as chunks."""
    out = spark.createDataFrame([(i, f, c, k) for k, (i, f, c) in enumerate(triples)], "id string, file_id string, content string, chunk_index long")
    return out.withColumns({"vector": F.array(F.lit(1.0).cast("float")), "sparse": F.create_map(F.lit(1).cast("long"), F.lit(0.5).cast("float")), "metadata": F.lit("{}")})


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "file_id string")


def held(s, version=None):
    return sorted((r["id"], r["file_id"], r["content"]) for r in s.read(version).collect())


def files_under(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_size for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_an_upsert_of_a_file_writes_its_bucket_only(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.upsert(rows(spark, [(f"{f}-{i}", f"file{f}", "x" * 200) for f in range(40) for i in range(50)]))
    before = files_under(tmp_path)
    layers = s.state()["rows"]
    assert s.upsert(rows(spark, [("7-0", "file7", "new"), ("7-9", "file7", "new")])) == {"upserted": 2, "deleted_files": 1, "rows": 1952}
    after = files_under(tmp_path)
    assert {f: n for f, n in after.items() if f in before} == before  # nothing is overwritten or moved
    new = {f: n for f, n in after.items() if f not in before}
    assert len({f.split("bucket=")[1].split("/")[0] for f in new}) == 1 and sum(new.values()) < sum(before.values()) / 5
    now = s.state()["rows"]
    assert [b for b in now if now[b] != layers[b]] == [next(iter(new)).split("bucket=")[1].split("/")[0]]
    assert [x for x in held(s) if x[1] == "file7"] == [("7-0", "file7", "new"), ("7-9", "file7", "new")] and len(held(s)) == 1952


@pytest.mark.parametrize("step", ["_written", "_counts", "_publish", "rename"])
def test_a_crash_at_any_step_leaves_the_last_version(spark, tmp_path, monkeypatch, step):
    s = store.Store(spark, str(tmp_path / "s"))
    s.upsert(rows(spark, [("a0", "a", "old"), ("b0", "b", "old")]))
    want, version = held(s), s.versions()

    class Died(Exception):
        pass

    def dies(*a, **k):
        raise Died

    if step == "rename":
        (tmp_path / "s" / "versions" / "draft-1").write_text('{"version": 2, "ro')
    else:
        monkeypatch.setattr(store.Store, step, dies)
        with pytest.raises(Died):
            s.upsert(rows(spark, [("a0", "a", "new")]), ids(spark, "b"))
        monkeypatch.undo()
    assert held(s) == want and s.versions() == version and s.healthy()
    assert s.upsert(rows(spark, [("a0", "a", "new")]), ids(spark, "b"))["rows"] == 1 and held(s) == [("a0", "a", "new")]


def test_of_two_writers_the_second_starts_again(spark, tmp_path, monkeypatch):
    one, two = (store.Store(spark, str(tmp_path / "s")) for _ in range(2))
    one.upsert(rows(spark, [("a0", "a", "1")]))
    publish, met = store.Store._publish, []

    def late(self, state):
        if self is two and not met:
            met.append(1)
            one.upsert(rows(spark, [("b0", "b", "2")]))
        publish(self, state)

    monkeypatch.setattr(store.Store, "_publish", late)
    assert two.upsert(rows(spark, [("c0", "c", "3")]))["rows"] == 3
    assert held(one) == [("a0", "a", "1"), ("b0", "b", "2"), ("c0", "c", "3")] and one.versions() == [1, 2, 3]
    assert held(one, 1) == [("a0", "a", "1")]


def test_many_upserts_equal_a_dictionary(spark, tmp_path, monkeypatch):
    """Replacing, deleting, empty and blank batches, with compaction on the way and removal of old layers."""
    monkeypatch.setattr(store, "MOST_LAYERS", 3)
    s, r, want = store.Store(spark, str(tmp_path / "s")), random.Random(2), {}
    assert s.ensure(buckets=2, dimension=1)["created"] and not s.ensure(buckets=9)["created"] and s.read().count() == 0
    for step in range(6):
        new = [(f"{f}-{i}", f, str(step)) for f in r.sample("abcdef", r.choice([0, 1, 2])) for i in range(r.randint(1, 3))]
        gone = r.sample("abcdef", 1) + ["", "none"] if step % 3 == 2 else []
        done = s.upsert(rows(spark, new), ids(spark, *gone))
        want = {k: v for k, v in want.items() if k[1] not in gone and k[1] not in {x[1] for x in new}} | {x[:2]: x[2] for x in new}
        assert held(s) == sorted((*k, v) for k, v in want.items()) and done["rows"] == len(want) == s.describe()["rows"]
        assert all(len(x) <= 3 for kind in ("rows", "gone") for x in s.state()[kind].values())
    assert s.describe()["buckets"] == 2 and s.describe()["options"] == {"dimension": 1}
    s.compact()
    assert all(len(x) == 1 for x in s.state()["rows"].values()) and not s.state()["gone"] and held(s) == sorted((*k, v) for k, v in want.items())
    assert s.compact() == [] and s.vacuum() == []  # what is young may be another writer's
    assert s.vacuum(older_than_s=-60) and len(s.versions()) == 1 and held(s) == sorted((*k, v) for k, v in want.items())
    s.drop()
    assert held(s) == [] and s.describe()["buckets"] == 2


def test_a_log_of_changes_keeps_the_latest(spark, tmp_path):
    """Inserts, updates of single fields, a change of an unknown record, old versions, and as many rewritings as the log doubles."""
    from tessera.operators.chat_log import ChatLog

    log = ChatLog(spark, str(tmp_path / "log"), "secret")
    rows = lambda *x: spark.createDataFrame(list(x), "record_id string, question string")
    answers = lambda *x: spark.createDataFrame(list(x), "record_id string, answer string")
    got = lambda v=None: {r["record_id"]: (r["question"], r["answer"], r["user_id"]) for r in log.read(v).collect()}
    assert got() == {} and log.insert(rows(*[(f"r{i}", f" q{i} ") for i in range(20)])) == 20
    log.update(answers(("r1", "one"), ("r2", "two"), ("ghost", "boo")))
    log.update(answers(("r1", "again"), ("r2", None)))
    want = {f"r{i}": (f"q{i}", "", "anonymous") for i in range(20)} | {"r1": ("q1", "again", "anonymous"), "r2": ("q2", "two", "anonymous")}
    assert got() == want and len(log.state()["layers"]) == 2
    assert "again" not in str(spark.read.parquet(*[f"{tmp_path}/log/data/{n}" for n, _ in log.state()["layers"]]).collect())
    log.insert(rows(("r3", "new"), ("ghost", "here")))
    want |= {"r3": ("new", "", "anonymous"), "ghost": ("here", "", "anonymous")}
    assert got() == want and log.compact(whole=True) == 1 and got() == want and got(1) == {f"r{i}": (f"q{i}", "", "anonymous") for i in range(20)}
