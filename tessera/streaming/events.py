"""Streaming forms of the event operators: deduplication, answer attachment and feedback with keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.streaming import timed


def source(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files: int = 1) -> DataFrame:
    """A stream of a folder's files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def dedupe_at_least_once(events: DataFrame, ts: str, key: str, ttl: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: for sources that deliver again."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def dedupe_with_ttl(events: DataFrame, ttl_s: int = DEFAULT.dedupe_ttl_s) -> DataFrame:
    """Events (key, ts_us, event_id) that come ttl or more after the last one kept of their key; state ends with the watermark."""
    return timed.first_seen(events, ttl_s)


def attach_answers(events: DataFrame) -> DataFrame:
    """key, question_seq, question and answer for each answer that closes the latest open question of its key, or none; state ends when a key is idle."""
    return timed.attach_answers(events)


def first_choices(clicks: DataFrame, ts: str, keys: list[str], choice: str, ttl: str = "30 minutes") -> DataFrame:
    """The first choice of each key, with state dropped behind the watermark."""
    return clicks.withWatermark(ts, ttl).groupBy(*keys, F.window(ts, "1 day")).agg(F.min_by(choice, ts).alias("selected"))


def windowed_counts(events: DataFrame, ts: str, width: str, by: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet", drain: bool = False) -> dict | None:
    """Runs a stream over all that is there and ends; gives the last batch's progress. drain is for sources that offer a bounded batch at a time."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    # A query takes the session's settings as it starts; timers and expiring state need this store.
    conf.set(key, ROCKS)
    try:
        writer = stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
        query = (writer if drain else writer.trigger(availableNow=True)).start()
        if drain:
            try:
                query.processAllAvailable()
            finally:
                query.stop()
        else:
            query.awaitTermination()
    finally:
        conf.set(key, before) if before else conf.unset(key)
    return query.lastProgress
