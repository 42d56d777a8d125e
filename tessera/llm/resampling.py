"""Importance resampling of documents towards a target distribution, in two Arrow passes.

Features are runs of one to ORDER words, hashed to 10,000 buckets by CRC-32. First pass: every task counts the features of its
texts into one vector with np.bincount, and treeReduce adds the vectors of all tasks up, so that the driver holds a few vectors of 80 KB whatever
the size of the corpus. A bucket's gain is the logarithm of its (smoothed) share of the target over its share of the corpus. Second pass: the
gains, a broadcast of 80 KB, are gathered for each feature and summed by document with np.bincount; a document's weight is the mean.

With a Gumbel variable from a hash of the id added, the highest scores are a sample without replacement in proportion to the exponential of the weights.
Scores are whole numbers of a range that their logarithms bound; so counts by score, aggregated before they move, show the lowest score that can be
drawn. Only rows from there up are sorted and numbered, by ranges: no task holds them all, and equal scores are as well spread as others.

Defined cases: a null, empty or wordless text has no features and weight 0, and is never drawn; ties go to the smaller id, a null id last (it is
hashed as empty text); rows equal in id and text have equal scores and numbers of their own, in no fixed order; an empty target or corpus counts as 0 in all buckets;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, table
from tessera.llm.words import cut_words, texts
from tessera.operators.numbering import numbered

BUCKETS, ORDER, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
#: Features whose buckets a reader holds at a time.
SLICE = 1 << 20


def buckets(text: bytes | None, order: int = ORDER) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each feature."""
    words = cut_words(text)
    runs = words if order == 1 else [b" ".join(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1)]
    return len(words), np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)) % BUCKETS


def bucket_counts(df: DataFrame, order: int = ORDER) -> np.ndarray:
    """Features in each bucket over all texts of df (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            held, n = [], 0
            for text in texts(batch):
                held.append(buckets(text, order)[1])
                n += len(held[-1])
                if n >= SLICE:
                    total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, n = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = df.select("text").mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r["counts"], np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(BUCKETS, np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of the target's share over the corpus's, floored, for each bucket."""
    all_s, all_t = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features and weight, a row for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums of whole numbers below 2 ** 53 are exact in doubles.
        gain = shared.value.astype(float)
        for batch in batches:
            n_words, n_features, sums = [], [], []
            held, first = [], 0

            def add_up():
                lengths = [len(x) for x in held]
                at = np.repeat(np.arange(len(held)), lengths)
                sums.append(np.bincount(at, weights=gain[np.concatenate(held)] if held else None, minlength=len(held)).astype(np.int64))
                n_features.extend(lengths)

            for text in texts(batch):
                n, ids = buckets(text, order)
                n_words.append(n)
                held.append(ids)
                first += len(ids)
                if first >= SLICE:
                    add_up()
                    held, first = [], 0
            if held:
                add_up()
            n_features = np.array(n_features, np.int64)
            total = np.concatenate(sums) if sums else np.zeros(0, np.int64)
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """A thousand times a Gumbel variable, floored, from a hash of the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    return F.floor(-1000 * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 32))))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, order: int = ORDER, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank, a row for each row of docs (doc_id, text); target: text."""
    gain = gains(bucket_counts(docs, order), bucket_counts(target, order))
    scored = cut(weighed(docs, gain, order).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    able = F.col("n_words") >= least_words
    by_score = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # As many rows as whole scores at most, some tens of thousands.
    counts = sorted(((r["score"], r["n"]) for r in by_score.toLocalIterator()), reverse=True)
    drawn = percent * sum(n for _, n in counts) // 100
    lowest, upto = None, 0
    for lowest, n in counts:
        upto += n
        if upto >= drawn:
            break
    columns = ["doc_id", "n_features", "weight", "score"]
    may = able & (F.col("score") >= F.lit(lowest)) if drawn else F.lit(False)
    first = numbered(scored.where(may).select(*columns), [], [F.desc("score"), F.col("doc_id").asc_nulls_last()], "rank")
    rest = scored.where(~may).select(*columns, F.lit(None).cast("long").alias("rank"))
    return first.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest)


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: CRC-32 by bytes, over distinct words: a step of the register for each of eight bits.
_STEP = "CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"

SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i AS k, i AS c, 0 AS n FROM range(256) t(i) UNION ALL SELECT k, {_STEP}, n + 1 FROM bits WHERE n < 8),
steps AS (SELECT list(c ORDER BY k) AS step FROM bits WHERE n = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
vocabulary AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
hashed AS (
  SELECT word,
         xor(4294967295, list_reduce(list_transform(range(1, CAST(len(h) // 2 + 1 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT)),
                                     lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295)) % 10000 AS bucket
  FROM vocabulary, steps),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM dw) AS all_s, (SELECT CAST(count(*) AS DOUBLE) FROM bw) AS all_t),
gain AS (
  SELECT s.bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (all_s + 10000) / ((CAST(s AS DOUBLE) + 1) * (all_t + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
sums AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(CAST(floor(CAST(total AS DOUBLE) / n) AS BIGINT), 0) AS weight,
         CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS luck
  FROM d LEFT JOIN sums USING (r)),
ranked AS (
  SELECT doc_id, n_features, weight, weight + luck AS score,
         CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + luck DESC, doc_id) END AS place,
         10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 AS drawn
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM ranked
"""
