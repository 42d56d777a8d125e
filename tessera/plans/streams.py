"""Queries that run as streams, over a table's rows in the order of time, several batches each; their SQL is that of the batch form."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.catalog import query
from tessera.session import scratch, table
from tessera.sources import polling
from tessera.streaming import events as stream
from tessera.streaming import timed

#: Rows of a slice of time, which one file and one batch hold, and the least number of slices.
SLICE_ROWS, LEAST_SLICES = 250_000, 4


def in_slices(rows: DataFrame, at: str, path: str) -> None:
    """Writes rows by slices of time, one file each, in their order: as a feed leaves them."""
    n, lo, hi = rows.agg(F.count(F.lit(1)), F.min(at), F.max(at)).first()
    slices = max(LEAST_SLICES, math.ceil(n / SLICE_ROWS))
    place = F.least(F.lit(slices - 1), F.floor((F.col(at) - F.lit(lo or 0)) * slices / F.lit(max(1, (hi or 0) - (lo or 0)))))
    for i in range(slices):
        rows.where(place == i).coalesce(1).write.mode("append").parquet(path)


#: Turns of conversations as events: each conversation begins at some second of a day, and a turn comes 20 to 119 seconds times its number later.
_FEED = """feed AS (
  SELECT CAST(conv_id AS VARCHAR) AS conv, conv_id * 1000 + turn AS event_id, role, conv_id, turn,
         (1700000000 + (conv_id * 7919) % 86400 + turn * (20 + (conv_id * 31) % 100)) * 1000000 AS ts_us FROM conversations)"""


def _feed(spark, sf_dir: str) -> DataFrame:
    seconds = F.lit(1_700_000_000) + (F.col("conv_id") * 7919) % 86400 + F.col("turn") * (20 + (F.col("conv_id") * 31) % 100)
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("conv"), (F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), "role", "conv_id", "turn", (seconds * 1_000_000).cast("long").alias("ts_us"),
    )


def _streamed(spark, rows: DataFrame, schema: str, operator) -> DataFrame:
    """operator over rows as a stream, read back."""
    feed, out, state = scratch(spark), scratch(spark), scratch(spark)
    in_slices(rows, "ts_us", feed)
    made = operator(stream.source(spark, feed, schema))
    stream.to_table(made, out, state)
    return spark.read.schema(made.schema).parquet(out)


@query(
    f"""WITH RECURSIVE {_FEED},
e AS (SELECT 'k' || conv_id % 1999 AS key, ts_us, event_id, row_number() OVER (PARTITION BY conv_id % 1999 ORDER BY ts_us, event_id) AS r FROM feed),
w AS (
  SELECT key, r, ts_us + 3600000000 AS until, TRUE AS kept FROM e WHERE r = 1
  UNION ALL SELECT e.key, e.r, CASE WHEN e.ts_us >= w.until THEN e.ts_us + 3600000000 ELSE w.until END, e.ts_us >= w.until FROM w JOIN e ON e.key = w.key AND e.r = w.r + 1)
SELECT key, ts_us, event_id FROM w JOIN e USING (key, r) WHERE kept"""
)
def dedupe_stream(spark, sf_dir):
    """Turns as deliveries of 1,999 messages, again for each conversation that shares one."""
    rows = _feed(spark, sf_dir).select(F.concat(F.lit("k"), (F.col("conv_id") % 1999).cast("string")).alias("key"), "ts_us", "event_id")
    return _streamed(spark, rows, "key string, ts_us long, event_id long", stream.dedupe_with_ttl)


@query(
    f"""WITH {_FEED},
n AS (SELECT *, lead(ts_us) OVER (PARTITION BY conv ORDER BY ts_us, event_id) AS next_us FROM feed),
mark AS (SELECT (max(ts_us) // 1000 - 600000) * 1000 AS mark FROM feed),
q AS (SELECT conv AS key, ts_us, least(ts_us + 300000000, coalesce(next_us, mark)) AS upto FROM n, mark WHERE role = 'user'),
t AS (
  SELECT key, 'status' AS what, k AS number, ts_us + k * 1500000 AS at_us, upto FROM q, range(1, 5) r(k)
  UNION ALL SELECT key, 'comfort', k, ts_us + k * 60000000, upto FROM q, range(1, 6) r(k))
SELECT key, what, CAST(number AS INTEGER) AS number, at_us FROM t WHERE at_us <= upto"""
)
def status_timers(spark, sf_dir):
    """While a user's turn waits for the next one: five status texts, and a comforting line each of five minutes."""
    kind = F.when(F.col("role") == "user", "question").otherwise("answer")
    rows = _feed(spark, sf_dir).select(F.col("conv").alias("key"), "ts_us", "event_id", kind.alias("kind"))
    return _streamed(spark, rows, "key string, ts_us long, event_id long, kind string", lambda s: timed.status_texts(s, 5, life_s=300.0))


@query(
    f"""WITH RECURSIVE {_FEED},
e AS (SELECT 't' || conv_id % 499 AS key, ts_us, event_id, row_number() OVER (PARTITION BY conv_id % 499 ORDER BY ts_us, event_id) AS r FROM feed),
w AS (
  SELECT key, r, ts_us AS fetched, TRUE AS refreshed FROM e WHERE r = 1
  UNION ALL SELECT e.key, e.r, CASE WHEN e.ts_us >= w.fetched + 7080000000 THEN e.ts_us ELSE w.fetched END, e.ts_us >= w.fetched + 7080000000 FROM w JOIN e ON e.key = w.key AND e.r = w.r + 1)
SELECT key, event_id, key || '@' || fetched AS token, refreshed FROM w JOIN e USING (key, r)"""
)
def token_cache(spark, sf_dir):
    """Turns as requests of 499 tenants, whose tokens are good for two hours."""
    rows = _feed(spark, sf_dir).select(F.concat(F.lit("t"), (F.col("conv_id") % 499).cast("string")).alias("key"), "ts_us", "event_id")
    made = _streamed(spark, rows, "key string, ts_us long, event_id long", lambda s: timed.with_tokens(s, lambda key, ts_us: (f"{key}@{ts_us}", 7200.0)))
    return made.select("key", "event_id", "token", "refreshed")


def _service(uri: str):
    """The lists of a table of executions that Spark has written in the order of time, a file at a time."""

    def list_from(status: str, since_us: int):
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSelector, FileSystem

        fs, path = FileSystem.from_uri(uri)
        wanted = (ds.field("status") == status) & (ds.field("started_us") >= since_us)
        for name in sorted(f.path for f in fs.get_file_info(FileSelector(path)) if f.path.endswith(".parquet")):
            for batch in ds.dataset(name, filesystem=fs).to_batches(filter=wanted):
                yield from batch.to_pylist()

    return list_from


@query(f"WITH {_FEED} SELECT CAST(event_id AS VARCHAR) AS id, ts_us AS started_us, CASE role WHEN 'user' THEN 'success' ELSE 'error' END AS status FROM feed")
def polled_executions(spark, sf_dir):
    """Turns as executions of a workflow that is polled until nothing new is listed."""
    at, out, state = scratch(spark), scratch(spark), scratch(spark)
    status = F.when(F.col("role") == "user", "success").otherwise("error")
    _feed(spark, sf_dir).select(F.col("event_id").cast("string").alias("id"), F.col("ts_us").alias("started_us"), status.alias("status")).orderBy("started_us", "id").write.parquet(at)
    made = polling.stream(spark, _service(at if "://" in at else f"file://{at}"), most=20_000)
    stream.to_table(made.select("id", "started_us", "status"), out, state, drain=True)
    return spark.read.schema("id string, started_us long, status string").parquet(out)
