"""The chunk store: Parquet files in buckets by file, with delete-and-replace upserts that write what they change only.

A file's chunks lie in the bucket of its id's hash. An upsert writes one layer: the new rows, and tombstones for the files it replaces or deletes, in the
buckets of these files. A row counts unless a later layer has a tombstone for its file. Buckets with many layers are rewritten (compacted), others stay as they are.

A version (tessera.operators.versions) names the layers of each bucket: an upsert is seen entirely or not at all.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.versions import Conflict, Versions

CHUNK_SCHEMA = "id string, vector array<float>, sparse map<long,float>, content string, file_id string, chunk_index long, metadata string"


def unique_file_ids(*frames: DataFrame) -> DataFrame:
    """Distinct non-blank file ids of all frames."""
    out = frames[0].select("file_id")
    for f in frames[1:]:
        out = out.union(f.select("file_id"))
    return out.where(F.trim(F.coalesce("file_id", F.lit(""))) != "").distinct()


def delete_by_file(existing: DataFrame, ids: DataFrame) -> DataFrame:
    """existing without the rows of ids (file_id); blank ids delete nothing."""
    return existing.join(unique_file_ids(ids), "file_id", "left_anti").select(*existing.columns)


def upsert(existing: DataFrame, new: DataFrame, delete_ids: DataFrame | None = None) -> DataFrame:
    """existing with the files of new replaced and those of delete_ids removed; of equal keys in new, the last by chunk index stays."""
    gone = unique_file_ids(new, delete_ids) if delete_ids is not None else unique_file_ids(new)
    fresh = new.groupBy("id").agg(F.max_by(F.struct(*new.columns), F.struct("chunk_index", "content")).alias("r")).select("r.*")
    return delete_by_file(existing, gone).unionByName(fresh)


def get_by_ids(existing: DataFrame, ids: DataFrame) -> DataFrame:
    return existing.join(ids.select("id").distinct(), "id", "left_semi").select(*existing.columns)


def valid_rows(records: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Accepted rows in the store's schema, and rejected ones with a reason."""
    reason = (
        F.when(F.col("vector").isNull() | (F.size("vector") == 0), "empty vector")
        .when(F.size("vector") != dimension, "wrong dimension")
        .when(F.col("sparse").isNull() | (F.size(F.map_filter("sparse", lambda k, v: v > 0)) == 0), "empty sparse vector")
        .when(F.col("chunk_index").isNull(), "no chunk index")
        .when(F.trim(F.coalesce("file_id", F.lit(""))) == "", "no file id")
    )
    marked = records.withColumn("reason", reason).withColumn("sparse", F.map_filter("sparse", lambda k, v: v > 0))
    key = F.coalesce(F.col("id"), F.format_string("%s_chunk_%06d", "file_id", "chunk_index"))
    return marked.where("reason is null").withColumn("id", key).drop("reason"), marked.where("reason is not null")


#: Layers of a bucket beyond which an upsert compacts it, and a store's buckets unless it was created with others.
MOST_LAYERS, BUCKETS = 8, 64
COLUMNS = ["id", "vector", "sparse", "content", "file_id", "chunk_index", "metadata"]


class Store(Versions):
    """A versioned table at a path that any executor and the driver can reach through Spark."""

    first = {"version": 0, "buckets": BUCKETS, "options": {}, "rows": {}, "gone": {}, "counts": {}}

    # ---------------------------------------------------------------- reading
    def _live(self, state: dict, buckets: list[str]) -> DataFrame:
        """Rows of some buckets of a state with their layer's number; those whose file a later layer has replaced or deleted are out."""
        paths = lambda kind: [f"{self.path}/data/{layer}/{kind}/bucket={b}" for b in buckets for layer in state[kind].get(b, [])]
        empty = lambda schema: self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{CHUNK_SCHEMA}, seq long").parquet(*paths("rows")) if paths("rows") else empty(f"{CHUNK_SCHEMA}, seq long")
        if not paths("gone"):
            return rows
        gone = self.spark.read.schema("file_id string, seq long").parquet(*paths("gone")).groupBy("file_id").agg(F.max("seq").alias("gone"))
        return rows.join(gone, "file_id", "left").where("gone is null or seq >= gone").select(*COLUMNS, "seq")

    def read(self, version: int | None = None) -> DataFrame:
        state = self.state(version)
        return self.spark.createDataFrame([], CHUNK_SCHEMA) if state is None else self._live(state, sorted(state["rows"])).select(*COLUMNS)

    # ---------------------------------------------------------------- writing
    def _written(self, layer: str, kind: str, df: DataFrame, buckets: int) -> list[str]:
        """Writes df by bucket (a file's rows are dealt to several tasks where they are many) and gives the buckets that got rows."""
        bucket = F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int")
        df.withColumn("bucket", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{layer}/{kind}")
        return [n.removeprefix("bucket=") for n in self._names("data", layer, kind) if n.startswith("bucket=")]

    def _counts(self, state: dict, buckets: list[str]) -> dict[str, int]:
        bucket = F.pmod(F.xxhash64("file_id"), F.lit(state["buckets"])).cast("int").cast("string")
        held = {r["bucket"]: r["count"] for r in self._live(state, buckets).groupBy(bucket.alias("bucket")).count().collect()}
        return {b: held.get(b, 0) for b in buckets}

    def upsert(self, new: DataFrame, delete_ids: DataFrame | None = None) -> dict[str, int]:
        """Commits an upsert, which replaces the files of new and deletes those of delete_ids; an empty batch still deletes. Of equal keys in new, the last by chunk index stays."""

        def change(state: dict) -> dict[str, int]:
            layer, seq = uuid.uuid4().hex, state["version"] + 1
            fresh = new.select(*COLUMNS).groupBy("id").agg(F.max_by(F.struct(*COLUMNS), F.struct("chunk_index", "content")).alias("r")).select("r.*", F.lit(seq).cast("long").alias("seq"))
            rows = self._written(layer, "rows", fresh, state["buckets"])
            held = self.spark.read.schema("file_id string").parquet(f"{self.path}/data/{layer}/rows") if rows else self.spark.createDataFrame([], "file_id string")
            ids = unique_file_ids(held, delete_ids) if delete_ids is not None else unique_file_ids(held)
            gone = self._written(layer, "gone", ids.withColumn("seq", F.lit(seq).cast("long")), state["buckets"])
            deleted = self.spark.read.parquet(f"{self.path}/data/{layer}/gone").count() if gone else 0
            add = lambda kind, buckets: state[kind] | {b: [*state[kind].get(b, []), layer] for b in buckets}
            # A tombstone without rows before it says nothing.
            then = state | {"version": seq, "rows": add("rows", rows), "gone": add("gone", [b for b in gone if b in state["rows"]])}
            then["counts"] = state["counts"] | self._counts(then, sorted({*rows, *gone}))
            self._publish(then)
            return {"upserted": held.count(), "deleted_files": deleted, "rows": sum(then["counts"].values())}

        done = self._attempts(change)
        self.compact(MOST_LAYERS)
        return done

    def commit(self, rows: DataFrame) -> int:
        """Commits rows as the whole table."""

        def change(state: dict) -> int:
            layer, seq = uuid.uuid4().hex, state["version"] + 1
            buckets = self._written(layer, "rows", rows.select(*COLUMNS).withColumn("seq", F.lit(seq).cast("long")), state["buckets"])
            then = state | {"version": seq, "rows": {b: [layer] for b in buckets}, "gone": {}, "counts": {}}
            then["counts"] = self._counts(then, buckets)
            self._publish(then)
            return sum(then["counts"].values())

        return self._attempts(change)

    def compact(self, most_layers: int = 1) -> list[str]:
        """Rewrites the buckets that have more layers of rows or tombstones, and gives them."""

        def change(state: dict) -> list[str]:
            much = sorted(b for b in state["rows"] if max(len(state["rows"][b]), len(state["gone"].get(b, []))) > most_layers or (most_layers == 1 and b in state["gone"]))
            if much:
                layer, seq = uuid.uuid4().hex, state["version"] + 1
                held = self._written(layer, "rows", self._live(state, much).drop("seq").withColumn("seq", F.lit(seq).cast("long")), state["buckets"])
                keep = lambda kind: {b: x for b, x in state[kind].items() if b not in much}
                self._publish(state | {"version": seq, "rows": keep("rows") | {b: [layer] for b in held}, "gone": keep("gone")})
            return much

        return self._attempts(change)

    def vacuum(self, keep: int = 1, older_than_s: float = 3600.0) -> list[str]:
        """Removes layers that none of the last keep versions names, and the files of earlier versions. Younger layers stay: a writer may be about to commit them."""
        fs, held = self._fs(), self.versions()
        named = {layer for v in held[-keep:] for kind in ("rows", "gone") for layers in self.state(v)[kind].values() for layer in layers}
        before, out = (time.time() - older_than_s) * 1000, []
        for v in held[:-keep]:
            fs.delete(self._at("versions", f"{v:020d}.json"), False)
        for layer in self._names("data"):
            if layer not in named and fs.getFileStatus(self._at("data", layer)).getModificationTime() <= before:
                fs.delete(self._at("data", layer), True)
                out.append(layer)
        return out

    # ---------------------------------------------------------------- definition
    def ensure(self, buckets: int = BUCKETS, **options) -> dict:
        """Creates an empty store with these options where there is none; describe() with whether it was created."""
        created = self.state() is None
        if created:
            try:
                self._publish({"version": 1, "buckets": buckets, "options": options, "rows": {}, "gone": {}, "counts": {}})
            except Conflict:
                created = False
        return self.describe() | {"created": created}

    def describe(self) -> dict | None:
        """Version, buckets, options, columns and count of rows; None where there is no store. Nothing of the rows is read."""
        state = self.state()
        if state is None:
            return None
        columns = dict(self.spark.createDataFrame([], CHUNK_SCHEMA).dtypes)
        return {k: state[k] for k in ("version", "buckets", "options")} | {"columns": columns, "rows": sum(state["counts"].values())}

    def healthy(self) -> bool:
        """Whether the store can be read and has the store's columns."""
        return self.read().columns == COLUMNS

    def drop(self) -> None:
        """Commits an empty table; its options stay, and earlier versions until vacuum()."""
        self.commit(self.spark.createDataFrame([], CHUNK_SCHEMA))
