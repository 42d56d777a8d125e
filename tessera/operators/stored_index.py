"""An Index whose arms search what lies on disk: postings in blocks, and vectors by pivots. Terms are 64-bit hashes, as in the store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Config
from tessera.functions import text as T
from tessera.operators import pivots, postings
from tessera.operators.retrieval import Index, bm25_stats, idf_terms, query_weights
from tessera.session import read_parts, written


#: Words of a slice of a batch that are counted at a time.
SLICE = 1 << 20


def counting(config: Config = DEFAULT) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes entries (id, terms, ws) of batches of (id, the hashes of a text's words, avgdl); texts without words have none."""
    k1, b, most = config.k1, config.b, SLICE

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, size in postings.slices(batch, most):
                if not size:
                    continue
                dl = np.diff(piece.column(1).offsets.to_numpy()).astype(np.int64)
                found = piece.column(1).flatten().dictionary_encode()
                n_terms = len(found.dictionary)
                # A number for each pair of a text and a term: equal ones, once sorted, are the term's occurrences.
                pairs = np.sort(np.repeat(np.arange(len(dl)), dl) * n_terms + found.indices.to_numpy())
                first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
                tf, (doc, term) = np.diff(np.append(first, size)), np.divmod(pairs[first], n_terms)
                w = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / piece.column(2).to_numpy()[doc]))
                offsets = pa.array(np.append(0, np.cumsum(np.bincount(doc)[dl[: doc[-1] + 1] > 0])).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (found.dictionary.take(pa.array(term)), pa.array(w))]
                yield pa.RecordBatch.from_arrays([piece.column(0).filter(pa.array(dl > 0)), *lists], ["id", "terms", "ws"])

    return counted


def build_lexical(docs: DataFrame, id_col: str, text_col: str, path: str, config: Config = DEFAULT) -> None:
    """Writes postings of texts, whose words are hashed where they are cut and counted by the task that makes the blocks, and the terms, whose document frequencies are the sizes of the blocks."""
    spark, rows = docs.sparkSession, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    stats = written(bm25_stats(rows, "text"))
    hashes = F.transform(T.words(F.col("text")), lambda x: F.xxhash64(x))
    postings.build(rows.join(F.broadcast(stats.select("avgdl"))).select("id", hashes.alias("words"), "avgdl"), f"{path}/postings", weigh=counting(config))
    df = read_parts(spark, f"{path}/postings").groupBy("term").agg(F.sum(F.size("ids")).alias("df"))
    idf_terms(df, stats, config).write.mode("overwrite").parquet(f"{path}/terms")


def build(rows: DataFrame, terms: DataFrame, path: str) -> None:
    """Writes the index of a store's rows (id, sparse, vector) and its terms (term: a hash, idf)."""
    postings.build(rows.select("id", F.map_keys("sparse").alias("terms"), F.map_values("sparse").alias("ws")), f"{path}/postings")
    pivots.build(rows.select("id", F.col("vector").cast("array<double>").alias("vec")), f"{path}/pivots")
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    rows.sparkSession.range(1).write.mode("overwrite").parquet(f"{path}/complete")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether an index was written to the end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/complete/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class StoredIndex(Index):
    """Index over docs whose searches open the parts that their queries need; results are those of the Index it was built from."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, path: str, *args, **kwargs):
        super().__init__(docs, id_col, text_col, *args, **kwargs)
        self.spark, self.path = docs.sparkSession, path
        self._parts["terms"] = self.spark.read.parquet(f"{path}/terms")

    def sparse(self, queries: DataFrame, k: int, drop_ratio: float = 0.0) -> DataFrame:
        return postings.search(self.spark, f"{self.path}/postings", query_weights(queries, self.terms, drop_ratio, self.analyzer), k)

    def dense(self, queries: DataFrame, k: int) -> DataFrame:
        asked = self.embed(queries.select(F.col("query_id").alias("id"), F.col("query").alias("text"))).withColumnRenamed("id", "query_id")
        return pivots.search(self.spark, f"{self.path}/pivots", asked, k)
