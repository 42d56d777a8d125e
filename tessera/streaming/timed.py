"""Keyed state that ends: deduplication with expiry, status texts from timers, and cached tokens.

Each operator keeps one small value for a key and one timer in event time. When the watermark passes the timer, what is due comes out and a value that no
later event can need is removed; so the state holds the keys of the last while only, however many there have been. Events of a key within a batch are taken in
the order of time; those behind the watermark are dropped by Spark. Results equal the batch forms, however events are cut into batches.

State lies in RocksDB; to_table() of tessera.streaming.events chooses it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tessera.config import DEFAULT

LATE = "10 minutes"
#: A status text shows for 1.5 seconds, a comforting line comes each minute, and a token is fetched again two minutes before it expires, but not within a minute.
EVERY_S, COMFORT_S, MARGIN_S, LEAST_S = 1.5, 60.0, 120, 60


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", late)


class _Keyed(StatefulProcessor):
    """One value for a key, and one timer: the time in microseconds at which due() has something to do."""

    schema = ""

    def init(self, handle) -> None:
        self.handle, self.value = handle, handle.getValueState("value", self.schema)

    def close(self) -> None:
        pass

    def held(self) -> tuple | None:
        return self.value.get() if self.value.exists() else None

    def keep(self, value: tuple | None, wake_us: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if value is None:
            self.value.clear()
        else:
            self.value.update(value)
            self.handle.registerTimer(-(-wake_us // 1000))

    @staticmethod
    def ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(list(rows)).sort_values(["ts_us", "event_id"])


class _Once(_Keyed):
    schema = "until long"

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def handleInputRows(self, key, rows, timerValues):
        held = self.held()
        until, stay = held[0] if held else None, []
        frame = self.ordered(rows)
        for i, t in enumerate(frame["ts_us"]):
            if until is None or until <= t:
                stay.append(i)
                until = int(t) + self.ttl_us
        self.keep((until,), until)
        yield frame.iloc[stay][["key", "ts_us", "event_id"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # Events from here on come after the value's end: without it they are kept just the same.
        self.keep(None, None)
        return iter([])


def first_seen(events: DataFrame, ttl_s: int = DEFAULT.dedupe_ttl_s, late: str = LATE) -> DataFrame:
    """Events (key, ts_us, event_id) that come ttl or more after the last one kept of their key; duplicates don't prolong it."""
    out = "key string, ts_us long, event_id long"
    return _timed(events.select("key", "ts_us", "event_id"), late).groupBy("key").transformWithStateInPandas(_Once(ttl_s * 1_000_000), out, "append", "EventTime")


class _Ticks(_Keyed):
    schema = "started long, status int, comfort int"

    def __init__(self, n_texts: int, every_us: int, comfort_us: int, life_us: int):
        self.n_texts, self.every, self.comfort, self.life = n_texts, every_us, comfort_us, life_us

    def next_at(self, held: tuple) -> list[tuple[int, str, int]]:
        """What comes next for an open question, by time; nothing after its life."""
        started, status, comfort = held
        both = [(started + status * self.every, "status", status)] if status < self.n_texts else []
        both.append((started + comfort * self.comfort, "comfort", comfort))
        return sorted(x for x in both if x[0] <= started + self.life)

    def due(self, held: tuple, upto: int, out: list) -> tuple | None:
        """Moves what is due up to a time to out, and gives the value after it; None where nothing can follow."""
        while (now := self.next_at(held)) and now[0][0] <= upto:
            at, what, number = now[0]
            out.append((what, number, at))
            held = (held[0], held[1] + (what == "status"), held[2] + (what == "comfort"))
        return held if now else None

    def rows(self, key, out: list) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["key", "what", "number", "at_us"])

    def save(self, held: tuple | None) -> None:
        self.keep(held, self.next_at(held)[0][0] if held else None)

    def handleInputRows(self, key, rows, timerValues):
        held, out = self.held(), []
        for e in self.ordered(rows).itertuples():
            if held:
                self.due(held, e.ts_us, out)
            held = (int(e.ts_us), 1, 1) if e.kind == "question" else None
        self.save(held)
        return self.rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held, out = self.held(), []
        if held:
            self.save(self.due(held, timerValues.getCurrentWatermarkInMs() * 1000, out))
        return self.rows(key, out)


def status_texts(events: DataFrame, n_texts: int, life_s: float = DEFAULT.feedback_window_s, every_s: float = EVERY_S, comfort_s: float = COMFORT_S, late: str = LATE) -> DataFrame:
    """key, what (status or comfort), number and at_us: the texts that show while a question of events (key, ts_us, event_id, kind: question or answer) is open.

    The next of n_texts status texts comes every 1.5 seconds, up to the last, and a comforting line each minute; both end with the next event of the key or the question's life.
    They come from timers, so those of a question that is never answered come as well.
    """
    ticks = _Ticks(n_texts, int(every_s * 1e6), int(comfort_s * 1e6), int(life_s * 1e6))
    return _timed(events.select("key", "ts_us", "event_id", "kind"), late).groupBy("key").transformWithStateInPandas(ticks, "key string, what string, number int, at_us long", "append", "EventTime")


class _Tokens(_Keyed):
    schema = "token string, until long"

    def __init__(self, fetch: Callable[[str, int], tuple[str, float]], margin_s: float, least_s: float):
        self.fetch, self.margin, self.least = fetch, margin_s, least_s

    def handleInputRows(self, key, rows, timerValues):
        held, tokens, fresh = self.held(), [], []
        frame = self.ordered(rows)
        for t in frame["ts_us"]:
            fresh.append(held is None or held[1] <= t)
            if fresh[-1]:
                token, expires_s = self.fetch(key[0], int(t))
                held = (token, int(t + max(expires_s - self.margin, self.least) * 1e6))
            tokens.append(held[0])
        self.keep(held, held[1])
        yield frame.assign(token=tokens, refreshed=fresh)[["key", "ts_us", "event_id", "token", "refreshed"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.keep(None, None)
        return iter([])


def with_tokens(requests: DataFrame, fetch: Callable[[str, int], tuple[str, float]], margin_s: float = MARGIN_S, least_s: float = LEAST_S, late: str = LATE) -> DataFrame:
    """requests (key, ts_us, event_id) with the token of their key and whether it was fetched for them.

    fetch(key, ts_us) gives a token and the seconds it is good for. A key's requests meet in one task, so however many come at once, a token is fetched once for each time it runs out; margin_s before
    that, but least_s after it was fetched at the earliest. Tokens that have run out are not kept.
    """
    out = "key string, ts_us long, event_id long, token string, refreshed boolean"
    return _timed(requests.select("key", "ts_us", "event_id"), late).groupBy("key").transformWithStateInPandas(_Tokens(fetch, margin_s, least_s), out, "append", "EventTime")


class _Answers(StatefulProcessor):
    """Open questions of a key as a stack, which the state store drops when nothing has come for a while."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.value = handle.getValueState("open", "seqs array<long>, texts array<string>", ttlDurationMs=self.idle_ms)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        seqs, texts = (list(x) for x in self.value.get()) if self.value.exists() else ([], [])
        out = []
        for e in pd.concat(list(rows)).sort_values(["seq", "kind", "text"], kind="stable").itertuples():
            if e.kind == "question":
                seqs.append(int(e.seq))
                texts.append(e.text)
            elif seqs:
                out.append((key[0], seqs.pop(), texts.pop(), e.text))
            else:
                out.append((key[0], int(e.seq), "", e.text))
        if seqs:
            self.value.update((seqs, texts))
        else:
            self.value.clear()
        yield pd.DataFrame(out, columns=["key", "question_seq", "question", "answer"])


def attach_answers(events: DataFrame, idle_s: int = 24 * 3600) -> DataFrame:
    """key, question_seq, question and answer for each answer that closes the latest open question of its key, or none.

    Open questions live for idle_s of processing time after the key's last event; a key without any has no state.
    """
    schema = "key string, question_seq long, question string, answer string"
    return events.groupBy("key").transformWithStateInPandas(_Answers(idle_s * 1000), schema, "append", "ProcessingTime")
