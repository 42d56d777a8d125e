"""The library's front: ingest, index, search and evaluate over a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Config
from tessera.functions import text as T
from tessera.operators import chat, enrich, evaluation, items, layout, retrieval, store, stored_index
from tessera.session import written
from tessera.sources import files, office


class KnowledgeEngine:
    """Documents in, ranked chunks out. embed turns (id, text) into (id, vec); rerank turns (query_id, id, query, content) into (query_id, id, rerank_score);
    analyzer turns a column of texts into arrays of words (tessera.functions.segment has one with a dictionary).

    The store holds a chunk's vector and the weights of its terms, by 64-bit hashes; the lexical model lies beside it. Searches read these, and cut only queries into words.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config = DEFAULT, embed: Callable[[DataFrame], DataFrame] | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None, analyzer=T.words):
        self.analyzer = analyzer
        self.spark, self.config, self.path = spark, config, path.rstrip("/")
        self.store = store.Store(spark, path)
        self.embed = embed or (lambda rows: retrieval.hashed_vectors(rows, "id", "text", config.dimension))
        self.rerank = rerank or retrieval.lexical_scores

    def parse(self, path: str) -> DataFrame:
        """Items of the office documents under a folder, without references, source lines and empty sections, addresses as links; doc_id is a document's path."""
        found = office.documents(files.discover(self.spark, path))
        names = found.select("doc_id", "file_id").distinct()
        cleaned = layout.without_empty_sections(layout.without_source_links(layout.without_reference_sections(found.where("type <> 'error'"))))
        return enrich.enriched_links(cleaned).join(names, "doc_id")

    def chunks(self, parsed: DataFrame) -> DataFrame:
        """Chunks of items that have doc_id and file_id."""
        ids = parsed.select("doc_id", "file_id").distinct()
        out = items.chunk(items.clean_items(parsed.drop("file_id"))).join(ids, "doc_id")
        return out.withColumn("id", T.chunk_id(F.col("file_id"), F.col("chunk_index")))

    def _texts(self, chunks: DataFrame) -> DataFrame:
        name = F.col("doc_id").cast("string") if "doc_id" in chunks.columns else F.lit("")
        return chunks.withColumn("text", T.embedding_text(name, F.col("path"), F.col("content")))

    def fit(self, chunks: DataFrame) -> None:
        """Learns the lexical model from chunks and from those of other files in the store, and saves it. Weights that are stored stay; ingest again what should have new ones."""
        held = store.delete_by_file(self.store.read(), chunks.select("file_id"))
        held = held.select("id", "content", F.get_json_object("metadata", "$.path").alias("path"))
        rows = self._texts(chunks.select("id", "content", "path").unionByName(held)).select("id", "text")
        index = retrieval.Index(rows, "id", "text", self.config, analyzer=self.analyzer)
        files.save_model(index.terms, index.stats, f"{self.path}/model")

    def model(self) -> tuple[DataFrame, DataFrame] | None:
        """Terms and statistics; None before the first fit."""
        try:
            return files.load_model(self.spark, f"{self.path}/model")
        except Exception as e:  # nothing is saved yet
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def ingest(self, chunks: DataFrame, refit: bool = False) -> dict[str, int]:
        """Encodes chunks (id, file_id, path, chunk_type, chunk_index, content) and replaces their files in the store. The model is learned first if there is none, or on demand.

        A chunk without words or vector is not stored; rejected counts them, and rejects() says why.
        """
        if refit or self.model() is None:
            self.fit(chunks)
        _, stats = self.model()
        rows = self._texts(chunks)
        found = retrieval.postings(rows, "id", "text", self.analyzer).groupBy("id", "dl", F.xxhash64("term").alias("term")).agg(F.sum("tf").alias("tf"))
        sparse = retrieval.bm25_weights(found, stats, self.config).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", F.col("w").cast("float")))).alias("sparse"))
        vectors = self.embed(rows.select("id", "text")).select("id", F.col("vec").cast("array<float>").alias("vector"))
        new = rows.join(vectors, "id", "left").join(sparse, "id", "left").select("id", "vector", "sparse", "content", "file_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.to_json(F.struct("path", "chunk_type")).alias("metadata"))
        # Written once: the embedder is asked once for each text.
        good, self._rejects = store.valid_rows(written(new), self.config.dimension)
        return self.store.upsert(good, chunks.select("file_id")) | {"rejected": self._rejects.count()}

    def rejects(self) -> DataFrame:
        """The chunks that the last ingestion did not store, with a reason."""
        return self._rejects

    def build_index(self) -> str:
        """Writes the search index of the store's version, from which searches open only what they need, and gives its folder."""
        at = self._index_path()
        if not stored_index.exists(self.spark, at):
            stored_index.build(self.store.read(), self._terms(), at)
        return at

    def _terms(self) -> DataFrame:
        return self.model()[0].groupBy(F.xxhash64("term").alias("term")).agg(F.max("idf").alias("idf"))

    def _index_path(self) -> str:
        return f"{self.path}/index/{(self.store.describe() or {'version': 0})['version']}"

    def index(self) -> retrieval.Index:
        """The store's index: nothing of it is computed again. Where build_index() has written one for the version, its arms search that."""
        rows, at = self.store.read(), self._index_path()
        if stored_index.exists(self.spark, at):
            return stored_index.StoredIndex(rows, "id", "content", at, self.config, self.embed, self.rerank, analyzer=self.analyzer)
        terms = self._terms()
        weights = rows.select("id", F.explode("sparse").alias("term", "w")).select("id", "term", F.col("w").cast("double").alias("w"))
        vectors = rows.select("id", F.col("vector").cast("array<double>").alias("vec"))
        return retrieval.Index(rows, "id", "content", self.config, self.embed, self.rerank, terms, weights, vectors, self.analyzer)

    def search(self, queries: DataFrame, limit: int | None = None, rerank: bool = True) -> DataFrame:
        """Ranked chunks for queries (query_id, query)."""
        return self.index().search(queries, limit, rerank=rerank)

    def evaluate(self, results: DataFrame) -> DataFrame:
        return evaluation.summary(results)

    def attach_answers(self, events: DataFrame) -> DataFrame:
        return chat.attach_answers(events)
