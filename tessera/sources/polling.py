"""A polled service as a stream: executions of a workflow, listed again and again, each of which comes out once.

list_from is a function of (status, since_us) that yields {"id", "started_us", ...} in the order of start time and id, from a time on, over as many pages as it takes. A poll goes through
the lists of all statuses in one order, from the last start time less an overlap on (an execution may show up late, and under another status), and takes up to `most` new ones.

The offset is the last start time taken, the ids taken from the overlap before it, and those of its own batch. So a batch that has to be
repeated has the same rows, and a stream that is started again goes on where it ended. Ids in an offset are those of the overlap and of one batch, not of all time.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: The statuses that are listed, in their order.
STATUSES = ("running", "waiting", "success", "error")
LOOKBACK_S, MOST = 30.0, 1000


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.list_from = cloudpickle.loads(base64.b64decode(options["list_from"]))
        self.statuses, self.since = json.loads(options["statuses"]), int(options["since_us"])
        self.lookback, self.most = int(float(options["lookback_s"]) * 1_000_000), int(options["most"])

    def initialOffset(self) -> dict:
        return {"at": self.since, "seen": "[]", "batch": "[]"}

    def _listed(self, at: int) -> Iterator[tuple[int, str, str, dict]]:
        one = lambda status: ((int(x["started_us"]), str(x["id"]), status, x) for x in self.list_from(status, at - self.lookback))
        return heapq.merge(*[one(s) for s in self.statuses], key=lambda x: x[:2])

    @staticmethod
    def _row(found: tuple[int, str, str, dict]) -> tuple:
        return found[1], found[0], found[2], json.dumps(found[3], ensure_ascii=False, default=str)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        seen, taken = dict(json.loads(start["seen"])), {}
        at, out = start["at"], []
        for found in self._listed(at):
            if found[1] not in seen and found[1] not in taken:
                taken[found[1]] = found[0]
                at = max(at, found[0])
                out.append(self._row(found))
                if len(out) == self.most:
                    break
        kept = [(i, t) for i, t in (seen | taken).items() if t >= at - self.lookback]
        return iter(out), ({"at": at, "seen": json.dumps(kept), "batch": json.dumps(list(taken))} if out else start)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        left = set(json.loads(end["batch"]))
        for found in self._listed(start["at"]):
            if not left:
                return
            if found[1] in left:
                left.remove(found[1])
                yield self._row(found)


class PollSource(DataSource):
    @classmethod
    def name(cls):
        return "tessera_poll"

    def schema(self):
        return "id string, started_us long, status string, item string"

    def simpleStreamReader(self, schema):
        return _Reader(self.options)


def stream(spark: SparkSession, list_from: Callable[[str, int], Iterable[dict]], since_us: int = 0, statuses: tuple[str, ...] = STATUSES, lookback_s: float = LOOKBACK_S, most: int = MOST) -> DataFrame:
    """id, started_us, status and item (JSON) of executions that began after since_us less the overlap, as a stream; a batch has at most `most`."""
    spark.dataSource.register(PollSource)
    options = {"list_from": base64.b64encode(cloudpickle.dumps(list_from)).decode(), "since_us": str(since_us), "statuses": json.dumps(statuses), "lookback_s": str(lookback_s), "most": str(most)}
    return spark.readStream.format("tessera_poll").options(**options).load()
