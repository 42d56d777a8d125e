"""A training corpus from raw documents: quality rules, near duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.

Defined cases: a null, empty or blank text and one of fewer than 20 words fails the base rules and goes in the first stage; null ids, sources and languages are values like any
other; of equal rows, as of all copies, one stays in the second stage; the mix may then take a row up to three times; ties go to the smaller id, then
to the earlier row; further columns, whatever their names, pass through all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import shared_dir
from tessera.llm.mixing import resample
from tessera.llm.ngram_join import one_of_each
from tessera.llm.packing import packed
from tessera.llm.pii import QUERY_KEY, session_key, with_pseudonyms
from tessera.llm.quality_rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies."""
    return one_of_each(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms of its format."""
    return with_pseudonyms(docs, session_key(spark, QUERY_KEY))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return resample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4,096 tokens."""
    return packed(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", deduplicate),
    ("pii", pseudonymise),
    ("mixing", mix),
    ("packing", pack),
]

#: Joins by hashes, keyed permutations and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
