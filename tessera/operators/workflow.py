"""Workflow executions: which nodes ran, the stage they reached, summaries and progress.

executions has id and detail, an execution's JSON: workflowData.nodes (id, name), here or in data, and data.resultData.runData, the runs of each node by its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stages in their order, and after how many seconds a stage is taken for reached.
STAGES = ("understanding", "retrieving", "reranking", "generating")
OPTIMISM = ((10.0, "generating"), (5.0, "reranking"), (1.5, "retrieving"))
RUNS = "map<string,array<struct<startTime:string,executionTime:long>>>"
NODES = "array<struct<id:string,name:string>>"


def seconds(iso: Column) -> Column:
    """ISO time in seconds, UTC where it has no zone; null if it can't be read."""
    text = F.trim(iso)
    zoned = text.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$")
    return F.unix_micros(F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))) / 1e6


def stage_index(stage: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STAGES)), stage), F.lit(0)), F.lit(0)).cast("int") - 1


def recent(items: DataFrame, started_after: Column, lookback_s: float) -> DataFrame:
    """Listed executions (id, started_at and more) that began after the threshold less the lookback, each id once; those without a time stay."""
    at = seconds(F.col("started_at"))
    return items.where(at.isNull() | (at >= started_after - F.greatest(F.lit(lookback_s), F.lit(0.0)))).dropDuplicates(["id"])


def runs(executions: DataFrame) -> DataFrame:
    """id, name, started (of the node's earliest run), first_start and first_ms (of its first run) and place, a row for each node that ran."""
    data = F.from_json(F.get_json_object("detail", "$.data.resultData.runData"), RUNS)
    rows = executions.select("id", F.posexplode(F.map_entries(data)).alias("place", "e")).select("id", "place", F.col("e.key").alias("name"), F.col("e.value").alias("runs"))
    starts = F.array_min(F.filter(F.transform("runs", lambda r: seconds(r["startTime"])), lambda t: t.isNotNull()))
    first = F.try_element_at("runs", F.lit(1))
    return rows.select("id", "place", "name", starts.alias("started"), first["startTime"].alias("first_start"), first["executionTime"].alias("first_ms"))


def nodes(executions: DataFrame) -> DataFrame:
    """id, name and node_id of the workflow's nodes; of equal names the last counts."""
    found = F.coalesce(F.from_json(F.get_json_object("detail", "$.workflowData.nodes"), NODES), F.from_json(F.get_json_object("detail", "$.data.workflowData.nodes"), NODES))
    rows = executions.select("id", F.posexplode(found).alias("at", "n")).select("id", "at", F.col("n.name").alias("name"), F.col("n.id").alias("node_id"))
    return rows.where(F.coalesce("name", F.lit("")) != "").groupBy("id", "name").agg(F.max_by("node_id", "at").alias("node_id"))


def executed(executions: DataFrame) -> DataFrame:
    """runs() with node_id and at: the order of start within the execution, from 1; nodes without a start come first."""
    order = Window.partitionBy("id").orderBy(F.coalesce("started", F.lit(0.0)), "place")
    return runs(executions).join(nodes(executions), ["id", "name"], "left").withColumn("at", F.row_number().over(order))


def reached(executions: DataFrame, stages: DataFrame) -> DataFrame:
    """id and stage: the latest stage of the nodes that ran, by node id, from stages (node_id, stage); null where none is known."""
    known = executed(executions).join(F.broadcast(stages), "node_id").groupBy("id").agg(F.max_by("stage", stage_index(F.col("stage"))).alias("stage"))
    return executions.select("id").join(known, "id", "left")


def optimistic(elapsed: Column) -> Column:
    """The stage that is assumed after so many seconds; null at first."""
    out = F.when(elapsed >= OPTIMISM[0][0], OPTIMISM[0][1])
    for least, stage in OPTIMISM[1:]:
        out = out.when(elapsed >= least, stage)
    return out


def progress(polls: DataFrame, keys: list[str], elapsed: str, stage: str) -> DataFrame:
    """polls with shown: the highest stage so far, of those seen and those assumed by the time that has passed; never an earlier one again."""
    now = F.greatest(stage_index(F.col(stage)), stage_index(optimistic(F.col(elapsed))), F.lit(0))
    w = Window.partitionBy(*keys).orderBy(elapsed).rangeBetween(Window.unboundedPreceding, 0)
    return polls.withColumn("shown", F.element_at(F.array(*map(F.lit, STAGES)), F.max(now).over(w) + 1))


def summaries(executions: DataFrame) -> DataFrame:
    """id, status, started_at, stopped_at, duration_s, last_node and nodes (name, startTime, executionTime of each node's first run, in order), a row for each execution."""
    at = lambda path: F.get_json_object("detail", f"$.{path}")
    took = F.round(seconds(at("stoppedAt")) - seconds(at("startedAt")), 3)
    listed = runs(executions).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "name", F.col("first_start").alias("startTime"), F.col("first_ms").alias("executionTime_ms")))), lambda n: n.dropFields("place")).alias("nodes"))
    out = executions.select("id", at("status").alias("status"), at("startedAt").alias("started_at"), at("stoppedAt").alias("stopped_at"), took.alias("duration_s"), at("data.resultData.lastNodeExecuted").alias("last_node"))
    return out.join(listed, "id", "left")
