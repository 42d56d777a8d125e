import json
import random

from tessera.sources import polling
from tessera.streaming import events as stream
from tessera.streaming import timed


def fed(spark, tmp_path, schema, batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return stream.source(spark, str(tmp_path / "in"), schema)


def run(spark, tmp_path, made):
    progress = stream.to_table(made, str(tmp_path / "out"), str(tmp_path / "state"))
    return spark.read.schema(made.schema).parquet(str(tmp_path / "out")).collect(), progress


S = 1_000_000


def test_state_of_keys_ends_with_the_watermark(spark, tmp_path):
    """Many keys, each of which comes once: what the last hour does not need is gone, and a key that comes again is kept again."""
    batches = [[(f"k{b}-{i}", (b * 7200 + 1 + i) * S, b * 1000 + i) for i in range(300)] + [("same", (b * 7200 + 400) * S, b * 1000 + 900), ("same", (b * 7200 + 500) * S, b * 1000 + 901)] for b in range(4)]
    rows, progress = run(spark, tmp_path, timed.first_seen(fed(spark, tmp_path, "key string, ts_us long, event_id long", batches), 3600))
    assert len(rows) == 4 * 301 and sorted(r["event_id"] % 1000 for r in rows if r["key"] == "same") == [900] * 4
    operator = progress["stateOperators"][0]
    assert operator["numRowsTotal"] <= 2 * 2 * 301  # a value and a timer for each key of the last slice or two, not of all four


def test_status_texts_come_from_timers(spark, tmp_path):
    r = random.Random(1)
    times = sorted(r.sample(range(0, 40_000), 120))
    events = [(r.choice("ab"), t * S // 4 + r.randrange(250_000), i, r.choice(["question", "question", "answer"])) for i, t in enumerate(times)]
    events += [("c", 10_000 * S, 998, "question"), ("d", 11_500 * S, 999, "answer")]  # never answered; and what moves the watermark on
    made = timed.status_texts(fed(spark, tmp_path, "key string, ts_us long, event_id long, kind string", [events[:50], events[50:51], events[51:]]), 4, life_s=150.0)
    rows, progress = run(spark, tmp_path, made)
    mark = (11_500 * 1000 - 600_000) * 1000
    want = []
    for key in "abcd":
        own = sorted(e for e in events if e[0] == key)
        for e, after in zip(own, [*own[1:], None]):
            if e[3] == "question":
                upto = min(e[1] + 150 * S, after[1] if after else mark)
                want += [(key, "status", k, e[1] + k * 3 * S // 2) for k in range(1, 4) if e[1] + k * 3 * S // 2 <= upto]
                want += [(key, "comfort", k, e[1] + k * 60 * S) for k in range(1, 3) if e[1] + k * 60 * S <= upto]
    assert sorted(tuple(x) for x in rows) == sorted(want) and any(x[0] == "c" for x in want)
    assert progress["stateOperators"][0]["numRowsTotal"] <= 4


def test_a_token_is_fetched_once_for_each_time_it_runs_out(spark, tmp_path):
    r = random.Random(2)
    rows = sorted((r.choice("abc"), r.randrange(0, 40_000) * S, i) for i in range(400))
    rows.sort(key=lambda x: x[1])
    made = timed.with_tokens(fed(spark, tmp_path, "key string, ts_us long, event_id long", [rows[:150], rows[150:]]), lambda key, at: (f"{key}{at}", 1000.0 if key == "a" else 100.0))
    got = {x["event_id"]: (x["token"], x["refreshed"]) for x in run(spark, tmp_path, made)[0]}
    for key in "abc":
        held, good = None, (1000 - 120 if key == "a" else 60) * S
        for _, at, i in (x for x in rows if x[0] == key):
            fresh = held is None or at >= held + good
            held = at if fresh else held
            assert got[i] == (f"{key}{held}", fresh)


def listing(path):
    def list_from(status, since_us):
        found = [json.loads(x) for x in open(path)]
        yield from sorted((x for x in found if x["status"] == status and x["started_us"] >= since_us), key=lambda x: (x["started_us"], x["id"]))

    return list_from


def test_polls_lose_and_repeat_nothing(spark, tmp_path):
    """Small batches, a restart, an execution that shows up late, one that changed its status, ties, and a batch that failed after it was planned."""
    feed = tmp_path / "feed.jsonl"
    items = [{"id": f"e{i}", "started_us": (100 + i // 3) * S, "status": ("success", "error", "running")[i % 3]} for i in range(40)]
    feed.write_text("\n".join(map(json.dumps, items)))
    poll = lambda: polling.stream(spark, listing(str(feed)), most=7, lookback_s=5.0)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream.to_table(poll(), out, state, drain=True)
    read = lambda: sorted((r["id"], r["started_us"]) for r in spark.read.parquet(out).collect())
    assert read() == sorted((x["id"], x["started_us"]) for x in items)
    more = [{"id": "late", "started_us": 110 * S, "status": "waiting"}, {**items[-1], "status": "success"}, {"id": "new", "started_us": 130 * S, "status": "error"}, {"id": "too late", "started_us": 50 * S, "status": "error"}]
    feed.write_text("\n".join(map(json.dumps, items[:-1] + more)))
    stream.to_table(poll(), out, state, drain=True)
    want = sorted([(x["id"], x["started_us"]) for x in items] + [("late", 110 * S), ("new", 130 * S)])
    assert read() == want
    feed.write_text("\n".join(map(json.dumps, more + [{"id": f"z{i}", "started_us": (140 + i) * S, "status": "error"} for i in range(20)])))
    seen = []

    def fails(batch, number):
        seen.append(sorted(r["id"] for r in batch.collect()))
        raise ValueError("lost")

    def keeps(batch, number):
        seen.append(sorted(r["id"] for r in batch.collect()))

    for sink in (fails, keeps):
        query = poll().writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state2")).start()
        try:
            query.processAllAvailable()
        except Exception:
            assert sink is fails
        finally:
            query.stop()
    assert seen[0] == seen[1] and sorted(sum(seen[1:], [])) == sorted(["late", "new", "e39", "too late"] + [f"z{i}" for i in range(20)])


def test_replay_is_the_same_batch():
    items = [{"id": str(i), "started_us": i * S, "status": "error"} for i in range(10)]
    reader = polling._Reader.__new__(polling._Reader)
    reader.list_from = lambda status, since: iter([x for x in items if x["status"] == status and x["started_us"] >= since])
    reader.statuses, reader.since, reader.lookback, reader.most = ("error",), 0, 2 * S, 4
    first, end = reader.read(reader.initialOffset())
    first = list(first)
    items.insert(3, {"id": "new", "started_us": 2 * S, "status": "error"})
    assert list(reader.readBetweenOffsets(reader.initialOffset(), end)) == first and [x[0] for x in first] == ["0", "1", "2", "3"]
    assert [x[0] for x in reader.read(end)[0]] == ["new", "4", "5", "6"]
    assert len(json.loads(end["seen"])) == 3
