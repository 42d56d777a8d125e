"""Fingerprints of texts for finding passages in documents: rolling hashes, of which windows select few.

The GRAM-character runs of a text have rolling hashes, and each window of WINDOW neighbouring runs selects its least one. Two texts that share WIDTH characters share
a window, and so what it selects: a passage of that length or more is found by one of its own fingerprints among those of a document, of which there are about a fifth as many as characters.
A shorter passage is its own run. Hashes are taken with numpy a text at a time, in memory linear in the text, and only those that a bit table of the passages' lets through leave
the task: a table of fixed size, whatever the number of passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import written

GRAM, WINDOW = 16, 9
#: The shortest passage that a window always covers.
WIDTH = GRAM + WINDOW - 1
#: Bits of the table that passages' hashes are looked up in first.
TABLE = 1 << 24
_BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(text: str, k: int) -> np.ndarray:
    """Hashes of all runs of k characters."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(x) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = h * _BASE + x[j : n + j]
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xBF58476D1CE4E5B9) ^ (h >> np.uint64(29))


def windows(text: str) -> np.ndarray:
    """What each window selects; none for a text without a whole one."""
    h = rolling(text, GRAM)
    n = len(h) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    least = h[:n].copy()
    for j in range(1, WINDOW):
        np.minimum(least, h[j : n + j], out=least)
    return least


def key(passage: str) -> int:
    """The one hash by which a passage is looked for."""
    h = windows(passage)[0] if len(passage) >= WIDTH else rolling(passage, len(passage))[0]
    return int(h.view(np.int64))


def contained(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id and doc_id where a passage (item_id, p) occurs in a document (doc_id, d); both are texts that are not empty."""

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(hash=[key(p) for p in frame["p"]], length=[min(len(p), WIDTH) for p in frame["p"]])

    kinds = dict(passages.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    keys = written(passages.select("item_id", "p").mapInPandas(keyed, f"item_id {kinds[0]}, p string, hash long, length int"))
    # Both are bounded: there are less than WIDTH lengths, and the table's words are counted.
    lengths = sorted(r["length"] for r in keys.select("length").distinct().collect())
    at = F.pmod("hash", F.lit(TABLE))
    word, bit = F.shiftright(at, 6).cast("int"), F.pmod(at, F.lit(64)).cast("int")
    marks = keys.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("word").agg(F.bit_or("b").alias("bits")).toPandas()
    bits = np.zeros(TABLE // 64, np.int64)
    bits[marks["word"].to_numpy(np.int64)] = marks["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for frame in frames:
            ids, hashes = [], []
            for i, text in enumerate(frame["d"]):
                own = np.unique(np.concatenate([windows(text) if k == WIDTH else rolling(text, k) for k in lengths] or [np.zeros(0, np.uint64)]))
                place = (own.view(np.int64) % TABLE).astype(np.uint64)
                own = own[(table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
                ids.append(np.full(len(own), i))
                hashes.append(own.view(np.int64))
            at = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy()[at], "hash": np.concatenate(hashes) if hashes else np.zeros(0, np.int64)})

    met = docs.select("doc_id", "d").mapInPandas(found, f"doc_id {kinds[1]}, hash long")
    some = met.join(keys, "hash").select("doc_id", "item_id", "p").join(docs, "doc_id")
    return some.where(F.instr("d", F.col("p")) > 0).select("item_id", "doc_id").distinct()
