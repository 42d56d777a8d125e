"""Chat rows that change: a log of changes, of which the latest counts for each field, compacted by layers of like size.

An insert writes whole rows, an update only what it sets; both are a layer of change rows under a version. Reading takes, for each record and field, the value of the latest layer that sets it.
Layers are merged when the newer ones have grown to half of the one before, so a row is rewritten as often as the table doubles, not with each update.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.chat import decrypted, records
from tessera.operators.versions import Versions

FIELDS = ["user_id", "user_name", "session_id", "conversation_id", "create_time", "question", "answer"]
CHANGE = "record_id string, user_id string, user_name string, session_id string, conversation_id string, create_time timestamp, question string, answer string, inserted boolean, seq long"


class ChatLog(Versions):
    """A log at a path that any executor and the driver can reach through Spark; texts are encrypted with the secret."""

    first = {"version": 0, "layers": []}

    def __init__(self, spark, path: str, secret: str):
        super().__init__(spark, path)
        self.secret = secret

    def _append(self, changes: DataFrame) -> int:
        def change(state: dict) -> int:
            layer, seq = uuid.uuid4().hex, state["version"] + 1
            one = changes.withColumn("seq", F.lit(seq).cast("long"))
            # Of several changes of a record in one batch, the greatest value of a field counts.
            one = one.groupBy("record_id").agg(*[F.max(c).alias(c) for c in [*FIELDS, "inserted", "seq"]])
            one.write.parquet(f"{self.path}/data/{layer}")
            n = self.spark.read.parquet(f"{self.path}/data/{layer}").count()
            self._publish(state | {"version": seq, "layers": [*state["layers"], [layer, n]]})
            return n

        n = self._attempts(change)
        self.compact()
        return n

    def insert(self, rows: DataFrame) -> int:
        """Appends whole rows (record_id, user_id, user_name, session_id, conversation_id, question, answer). A record that is inserted again is set anew."""
        return self._append(_changes_of(rows, self.secret).withColumn("inserted", F.lit(True)))

    def update(self, rows: DataFrame) -> int:
        """Sets the fields that rows (record_id and some of question, answer, user_name) have and that are not null."""
        return self._append(_changes_of(rows, self.secret, partial=True).withColumn("inserted", F.lit(False)))

    def _changes(self, layers: list) -> DataFrame:
        paths = [f"{self.path}/data/{name}" for name, _ in layers]
        return self.spark.read.schema(CHANGE).parquet(*paths) if paths else self.spark.createDataFrame([], CHANGE)

    @staticmethod
    def _latest(changes: DataFrame) -> DataFrame:
        latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
        return changes.groupBy("record_id").agg(*map(latest, FIELDS), F.max("inserted").alias("inserted"), F.max("seq").alias("seq"))

    def read(self, version: int | None = None) -> DataFrame:
        """record_id and the fields of inserted records, as they are now (or were in a version), texts decrypted."""
        state = self.state(version) or self.first
        rows = self._latest(self._changes(state["layers"])).where("inserted")
        return rows.select("record_id", *[decrypted(F.col(c), self.secret).alias(c) if c in ("question", "answer") else F.col(c) for c in FIELDS])

    def compact(self, whole: bool = False) -> int:
        """Merges the newest layers as far as they are not small beside the one before (or all), and gives how many there are then."""

        def change(state: dict) -> int:
            layers = state["layers"]
            at = len(layers) - 1
            while at > 0 and (whole or 2 * sum(n for _, n in layers[at:]) >= layers[at - 1][1]):
                at -= 1
            if len(layers) - at > 1:
                layer = uuid.uuid4().hex
                self._latest(self._changes(layers[at:])).write.parquet(f"{self.path}/data/{layer}")
                n = self.spark.read.parquet(f"{self.path}/data/{layer}").count()
                layers = [*layers[:at], [layer, n]]
                self._publish(state | {"version": state["version"] + 1, "layers": layers})
            return len(layers)

        return self._attempts(change)


def _changes_of(rows: DataFrame, secret: str, partial: bool = False) -> DataFrame:
    """Change rows of rows: all fields as records() stores them, or (partial) only those that rows have."""
    some = [c for c in ("question", "answer", "user_name") if c in rows.columns]
    absent = {c: F.lit(None).cast("string") for c in ("user_id", "user_name", "session_id", "conversation_id", "question", "answer") if c not in rows.columns}
    full = records(rows.withColumns(absent), secret, ("record_id",))
    if not partial:
        return full
    kept = lambda c: F.nullif(F.col(c), F.lit("")) if c in some else F.lit(None).cast(full.schema[c].dataType)
    return full.select("record_id", *[kept(c).alias(c) for c in FIELDS])
