"""Words of Han runs by a dictionary: the best path through each run.

Entries lie in a trie, a table from beginnings to whether they end a word. A walk from the end of a run to its start keeps, for each place, the highest sum of weights with
which the rest can be cut; a character that no entry begins at stands alone, at the price of UNKNOWN. Equal sums go to the longer first word. So a custom word of a higher weight
wins over the words it is made of.

The dictionary goes to every task as a broadcast. It is checked first: more than MOST_ENTRIES entries are refused, as a larger table has to be split by what texts need.
A walk costs the run's length times the longest entry; runs that a task has met before are looked up, of which it remembers KNOWN at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.functions.text import HAN

UNKNOWN, PLAIN, CUSTOM = -30, -20, -10
MOST_ENTRIES = 2_000_000
#: Bytes of text that a task cuts at a time, and runs that it remembers.
SLICE, KNOWN = 1 << 20, 50_000


class Trie:
    """Weights of words, and how far any word goes from each beginning."""

    def __init__(self, weights: dict[str, int]):
        self.weights = weights
        self.beginnings = {w[:k] for w in weights for k in range(1, len(w) + 1)}

    def cut(self, run: str) -> list[str]:
        """The best path through a run."""
        n = len(run)
        best, step = [0] * (n + 1), [1] * n
        for at in range(n - 1, -1, -1):
            top, k = UNKNOWN + best[at + 1], 1
            for end in range(at + 1, n + 1):
                word = run[at:end]
                if word not in self.beginnings:
                    break
                weight = self.weights.get(word)
                if weight is not None and weight + best[end] >= top:
                    top, k = weight + best[end], end - at
            best[at], step[at] = top, k
        out, at = [], 0
        while at < n:
            out.append(run[at : at + step[at]])
            at += step[at]
        return out


def dictionary(words: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """word and weight of words (word), those of custom ones being higher; blank ones are left out, and of equal words the highest counts."""
    rows = words.select(F.lower(F.trim("word")).alias("word"), F.lit(PLAIN).alias("weight"))
    if custom is not None:
        rows = rows.unionByName(custom.select(F.lower(F.trim("word")).alias("word"), F.lit(CUSTOM).alias("weight")))
    return rows.where("word <> ''").groupBy("word").agg(F.max("weight").alias("weight"))


def cutter(entries: DataFrame, most: int = MOST_ENTRIES):
    """A function of a column of Han runs that gives their words as arrays, for entries (word, weight)."""
    if (n := entries.count()) > most:
        raise ValueError(f"{n} entries are too many for a broadcast dictionary of {most}")
    shared = entries.sparkSession.sparkContext.broadcast({r["word"]: r["weight"] for r in entries.toLocalIterator()})

    @F.arrow_udf(ArrayType(StringType()))
    def cut(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie, known = Trie(shared.value), {}
        for part in parts:
            yield from cut_slices(part, trie, known)

    return cut


def cut_slices(part: pa.Array, trie: Trie, known: dict[str, list[str]], most: int = SLICE, most_known: int = KNOWN) -> Iterator[pa.Array]:
    """The words of each text of part (Han runs by lines), as arrays for slices of most bytes of text or one text: a batch is never a whole in Python. known are runs with their words, most_known at most."""
    n, at = len(part), 0
    ends = np.cumsum(pc.fill_null(pc.binary_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while at < n or not n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))) if n else 0
        found, offsets = [], [0]
        for runs in part.slice(at, stop - at).to_pylist():
            for run in runs.split("\n") if runs else ():
                held = known.get(run)
                if held is None:
                    if len(known) >= most_known:
                        known.clear()
                    held = known[run] = trie.cut(run)
                found += held
            offsets.append(len(found))
        yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.string()))
        if not n:
            return
        at = stop


def words(text: Column, cut) -> Column:
    """The analyzer of the lexical index with a dictionary: runs of letters and digits, and the words of Han runs, in lower case and in their order of kind. cut is a cutter()."""
    low = F.lower(F.coalesce(text, F.lit("")))
    han = F.array_join(F.regexp_extract_all(low, F.lit(f"[{HAN}]+"), F.lit(0)), "\n")
    other = F.regexp_extract_all(low, F.lit(rf"[\p{{L}}\p{{N}}&&[^{HAN}]]+"), F.lit(0))
    return F.concat(other, cut(han))
