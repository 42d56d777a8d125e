import random

from pyspark.sql import functions as F

from tessera.operators.numbering import numbered


def test_numbers_equal_sorted_groups(spark):
    """A group with most of the rows, a null group, lone rows and an empty table."""
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 8 + ["b", None, "c d"]), r.randint(0, 50), i) for i in range(5000)] + [("lone", 1, 5000)]
    df = spark.createDataFrame(rows, "g string, v int, id long").repartition(7)
    got = {x["id"]: (x["n"], x["all_n"]) for x in numbered(df, ["g"], [F.desc("v"), F.col("id")], "n", "all_n").collect()}
    want = {}
    for g in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))
        want |= {x[2]: (k, len(own)) for k, x in enumerate(own, 1)}
    assert got == want
    whole = {x["id"]: x["n"] for x in numbered(df, [], [F.col("id")], "n").collect()}
    assert whole == {i: i + 1 for i in range(5001)}
    assert numbered(df.where("id < 0"), ["g"], [F.col("id")]).collect() == []


def test_no_window_holds_a_group(spark):
    """The one window runs over counts of ranges, not over rows."""
    df = spark.range(20_000).select("id", F.lit("g").alias("g")).repartition(8)
    out = numbered(df, ["g"], [F.col("id")], "n")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    inside = plan[plan.index("Window") :]
    assert "Aggregate" in inside and plan.count("Window") == 1
    assert out.agg(F.max("n"), F.countDistinct("n")).first() == (20_000, 20_000)


def test_ranges_of_bounded_rows(spark, monkeypatch):
    """With a count, no range holds many more rows than ROWS, however well they compress, and numbers are the same."""
    from tessera.operators import numbering

    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.shiftright("id", 1).alias("v"))
    monkeypatch.setattr(numbering, "ROWS", 1000)
    held = []
    monkeypatch.setattr(numbering, "written", lambda x, write=numbering.written: held.append(write(x)) or held[-1])
    out = numbered(df, ["g"], [F.col("v")], "at", "n", 20_000)
    assert max(r["count"] for r in held[0].groupBy(numbering._PART).count().collect()) < 3000
    assert out.where("at <> v + 1 or n <> 10000").count() == 0 and out.count() == 20_000
