"""Sources and sinks of files: discovery, dispatch by suffix, item texts, chunks, embeddings, vocabularies and evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

SUFFIXES = ("docx", "pptx", "xlsx", "pdf")
#: What question sets are made from.
QUESTION_SUFFIXES = ("txt", "md", "markdown", "json", "csv", "docx", "pdf")
PARAGRAPH_LINE = r"^\[paragraph\]\s+\[[^\]]+\]\s*(.*)$"
METADATA = "file_id string, file_type string, file_name string, file_path string, path string, chunk_type string, links array<struct<index:int,link_name:string,link_path:string>>, imgs array<struct<index:int,img_name:string,img_path:string>>"
CHUNK = f"content string, metadata struct<{METADATA.replace(' string', ':string').replace(' array', ':array').replace(', ', ',')}>, chunk_index int, file_id string, vector_id string"
EMBEDDING = "content string, chunk_index long, file_id string, metadata struct<file_id:string>, embedding array<float>, bm25_embedding map<string,float>"
QUESTION = "id string, document_name string, document_path string, question string, reference_answer string, evidence string, difficulty string, question_types array<string>"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def discover(spark: SparkSession, path: str, recursive: bool = True, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, length and content of a folder's documents, by path, without lock files. Contents are only read where a plan needs them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    return files.where(suffix(F.col("path")).isin(*suffixes) & ~name.startswith("~$")).select("path", "length", "content").orderBy("path")


def without_pdf_twins(files: DataFrame) -> DataFrame:
    """files without those that lie beside a PDF with the same stem."""
    stem = F.lower(F.regexp_replace("path", r"\.[^./\\]+$", ""))
    rows = files.withColumn("_stem", stem)
    pdf = rows.where(suffix(F.col("path")) == "pdf").select("_stem").distinct()
    kept = rows.where(suffix(F.col("path")) != "pdf").join(pdf, "_stem", "left_anti").unionByName(rows.where(suffix(F.col("path")) == "pdf"))
    return kept.drop("_stem")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk files: JSON lists of objects. What is no object fails the read."""
    return spark.read.schema(CHUNK).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_chunks(chunks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    chunks.write.mode(mode).option("ignoreNullFields", True).json(path)


def read_embeddings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Embedding records in the shape of the store; multi_line: files hold one list instead of a record a line."""
    rows = spark.read.schema(EMBEDDING).option("multiLine", multi_line).json(path)
    file_id = F.coalesce("file_id", "metadata.file_id")
    sparse = F.map_from_entries(F.transform(F.map_entries(T.sparse_positive(F.col("bm25_embedding"))), lambda e: F.struct(e["key"].cast("long"), e["value"])))
    return rows.select(F.lit(None).cast("string").alias("id"), F.col("embedding").alias("vector"), sparse.alias("sparse"), "content", file_id.alias("file_id"), "chunk_index", F.to_json("metadata").alias("metadata"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """word, pos and seq from a CSV file whose header may be word or 词, and pos or 词性."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip().lower() for c in rows.columns])
    pick = lambda *names: F.coalesce(*[F.col(f"`{c}`") for c in names if c in rows.columns] or [F.lit(None)])
    out = rows.select(T.trim_u(pick("word", "词")).alias("word"), F.coalesce(F.nullif(T.trim_u(pick("pos", "词性")), F.lit("")), F.lit("nz")).alias("pos"))
    return out.where("word <> ''").withColumn("seq", F.monotonically_increasing_id())


def write_vocabulary(words: DataFrame, path: str, mode: str = "overwrite") -> None:
    words.select("word", "pos").coalesce(1).sortWithinPartitions("word").write.mode(mode).option("header", True).csv(path)


def read_questions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(QUESTION).option("multiLine", multi_line).json(path).where(T.trim_u(F.coalesce("question", F.lit(""))) != "")


def resolved(requests: DataFrame, files: DataFrame) -> DataFrame:
    """request and path: a requested document by exact path, else by path under the raw folder, else by file name, else by name in any case."""
    clean = F.regexp_replace(F.regexp_replace(F.url_decode(F.col("request")), r"\\", "/"), r"^.*data/raw/", "")
    asked = requests.withColumn("asked", F.regexp_replace(clean, "^/+", "")).where(~F.col("asked").rlike(r"(^|/)\.\.(/|$)"))
    have = files.select("path", F.regexp_replace("path", r"^.*data/raw/", "").alias("under"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    name = F.regexp_extract("asked", r"([^/]+)$", 1)
    # The last form holds for all the others too, so one equality joins them all.
    both = asked.withColumn("asked_name", name).join(have, F.lower("asked_name") == F.lower("name"))
    rank = F.when(F.col("path") == F.col("request"), 0).when(F.col("under") == F.col("asked"), 1).when(F.col("name") == F.col("asked_name"), 2).otherwise(3)
    best = F.row_number().over(Window.partitionBy("request").orderBy("rank", "path"))
    return both.withColumn("rank", rank).withColumn("at", best).where("at = 1").select("request", "path")


def question_sources(spark: SparkSession, path: str, cache: str | None = None) -> DataFrame:
    """path and length of the files that question sets are made from: seven kinds, none below the cache folder, and none that lies beside its PDF."""
    files = discover(spark, path, suffixes=QUESTION_SUFFIXES).select("path", "length")
    if cache:
        files = files.where(~F.contains("path", F.lit("/" + cache.strip("/") + "/")))
    return without_pdf_twins(files)


def page_texts(pages: DataFrame) -> DataFrame:
    """doc_id and text of a document's pages (doc_id, page, text): each below a mark with its number, blank ones left out."""
    some = pages.select("doc_id", "page", T.trim_u(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    marked = F.concat(F.lit("[page "), F.col("page").cast("string"), F.lit("]\n"), F.col("text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", marked.alias("t")))), lambda x: x["t"]), "\n\n")
    return some.groupBy("doc_id").agg(joined.alias("text"))


def vocabulary_lines(texts: DataFrame) -> DataFrame:
    """path and text of item texts (path, text) with only the paragraphs' own words, a line each."""
    found = F.transform(F.split("text", r"\r\n|\r|\n"), lambda x: T.trim_u(F.regexp_extract(T.trim_u(x), PARAGRAPH_LINE, 1)))
    return texts.select("path", F.array_join(F.filter(found, lambda x: x != ""), "\n").alias("text"))


def write_embeddings(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Embedding records: content, chunk_index, file_id, metadata, embedding and bm25_embedding of chunks with vector and sparse."""
    weights = F.map_from_entries(F.transform(F.map_entries("sparse"), lambda e: F.struct(e["key"].cast("string"), e["value"])))
    out = rows.select("content", "chunk_index", "file_id", F.struct("file_id").alias("metadata"), F.col("vector").alias("embedding"), weights.alias("bm25_embedding"))
    out.write.mode(mode).json(path)


def save_model(terms: DataFrame, stats: DataFrame, path: str) -> None:
    """A lexical model as two tables: terms (term, df, idf) and stats (n, avgdl). An empty one is refused."""
    if not (stats.first() or {"n": 0})["n"]:
        raise ValueError("no documents to learn a model from")
    terms.select("term", "df", "idf").write.mode("overwrite").parquet(f"{path}/terms")
    stats.select("n", "avgdl").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema("term string, df long, idf double").parquet(f"{path}/terms"), spark.read.schema("n long, avgdl double").parquet(f"{path}/stats")


def write_report(results: DataFrame, path: str, **sections: DataFrame) -> None:
    """A report as JSON folders: its results, and each further section, such as a summary or the runs of a probe."""
    for name, rows in {"results": results, **sections}.items():
        rows.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")


def read_report(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/{section}")


def write_questions(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_map(mapping: DataFrame, conflicts: DataFrame, path: str) -> None:
    """A map of file names (file_name, url), and its conflicts (file_name, kept, other) appended to those of earlier runs, each once."""
    mapping.select("file_name", "url").write.mode("overwrite").json(f"{path}/map")
    new = conflicts.select("file_name", "kept", "other").distinct()
    try:
        new = new.subtract(mapping.sparkSession.read.schema("file_name string, kept string, other string").json(f"{path}/conflicts"))
    except Exception as e:  # the first run
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").json(f"{path}/conflicts")


def read_conflicts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file_name string, kept string, other string").json(f"{path}/conflicts")
