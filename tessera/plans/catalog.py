"""The registered queries over the driver's tables, each with its SQL for comparison where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.functions import cleaning
from tessera.functions import text as T
from tessera.operators import chat, evaluation, items, meta, retrieval, store
from tessera.operators.numbering import numbered
from tessera.session import scratch, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def index(spark: SparkSession, sf_dir: str) -> retrieval.Index:
    return retrieval.Index(table(spark, sf_dir, "documents"), "doc_id", "text")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)", 1), "/$", "")
    kind = F.when(path.endswith(".html"), "html").otherwise("none")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace(path, r"\.html$", "").alias("stem"), kind.alias("kind"))


_WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"
_BM25 = f"""
words AS (SELECT doc_id AS id, unnest({_WORDS.format('text')}) AS term FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM words GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len({_WORDS.format('text')})) AS avgdl FROM documents),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, stats GROUP BY term),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN CAST(0.25 AS DOUBLE) * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
dl AS (SELECT id, sum(tf) AS dl FROM tf GROUP BY id),
weights AS (SELECT id, term, tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl)) AS w FROM tf JOIN dl USING (id), stats),
qwords AS (SELECT item_id AS query_id, unnest({_WORDS.format('text')}) AS term FROM benchmark),
qtf AS (SELECT query_id, term, count(*) AS tf FROM qwords GROUP BY ALL),
qw AS (SELECT query_id, term, tf * idf AS qw FROM qtf JOIN terms USING (term) WHERE tf * idf > 0)"""


def _sparse(qw: str = "qw") -> str:
    return f"""
sparse AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT query_id, id, round(sum(qw * w), 6) AS score FROM weights JOIN {qw} USING (term) GROUP BY ALL))"""


def _vectors(name: str, rows: str) -> str:
    return f"""
{name}_dims AS (
  SELECT id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 64 AS dim, sum(tf * CASE WHEN CAST(('0x' || substr(md5(term), 9, 1)) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v
  FROM {rows} GROUP BY ALL),
{name} AS (SELECT id, dim, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM {name}_dims QUALIFY sum(v * v) OVER (PARTITION BY id) > 0)"""


_HYBRID = f"""{_BM25},{_sparse()},{_vectors('dv', 'tf')},{_vectors('qv', '(SELECT query_id AS id, term, tf FROM qtf)')},
dense AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT q.id AS query_id, d.id, round(coalesce(s, 0) + CAST(1e-9 AS DOUBLE), 6) + 0.0 AS score
        FROM (SELECT DISTINCT id FROM qv) q CROSS JOIN (SELECT DISTINCT id FROM dv) d
        LEFT JOIN (SELECT q.id AS qid, d.id AS did, sum(q.v * d.v) AS s FROM qv q JOIN dv d USING (dim) GROUP BY ALL) p ON p.qid = q.id AND p.did = d.id)),
fused AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT query_id, id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 8) AS score
        FROM (SELECT query_id, id, rank FROM sparse WHERE rank <= 75 UNION ALL SELECT query_id, id, rank FROM dense WHERE rank <= 75) GROUP BY ALL))"""

_COSINE = """
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) + CAST(1e-9 AS DOUBLE), 6) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs)"""


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.dense_topk(rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), k, exclude_self=True)


@query(f"WITH {_COSINE} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 10)


@query(
    f"""WITH {_COSINE}, kept AS (SELECT * FROM ranked WHERE rank <= 10 AND score >= 0.2),
falls AS (SELECT *, round(lag(score) OVER (PARTITION BY query_id ORDER BY rank) - score, 8) >= 0.05 AS f FROM kept),
cuts AS (SELECT query_id, min(rank) AS cut FROM falls WHERE f GROUP BY 1)
SELECT query_id, id, score FROM falls LEFT JOIN cuts USING (query_id) WHERE cut IS NULL OR rank < cut QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5"""
)
def dense_threshold_cliff(spark, sf_dir):
    rows = retrieval.above_threshold(_dense(spark, sf_dir, 10), 0.2, "score")
    return retrieval.limited(retrieval.before_cliff(rows, 0.05, "score"), 5).select("query_id", "id", "score")


@query(
    f"""WITH words AS (SELECT DISTINCT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents),
counts AS (SELECT term, count(*) AS df FROM words GROUP BY term),
logs AS (SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS raw FROM counts)
SELECT term, df, round(CASE WHEN raw < 0 THEN CAST(0.25 AS DOUBLE) * avg(raw) OVER () ELSE raw END, 6) AS idf FROM logs"""
)
def bm25_fit_terms(spark, sf_dir):
    return index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def bm25_corpus_stats(spark, sf_dir):
    return index(spark, sf_dir).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_BM25},{_sparse()} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM sparse WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return index(spark, sf_dir).sparse(asked(spark, sf_dir), 10)


_DROP = """
cutw AS (
  SELECT query_id, term, qw FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(qw, 6), term) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM qw) WHERE place > floor(CAST(0.2 AS DOUBLE) * n))"""


@query(f"WITH {_BM25},{_DROP},{_sparse('cutw')} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM sparse WHERE rank <= 10")
def sparse_drop_ratio(spark, sf_dir):
    return index(spark, sf_dir).sparse(asked(spark, sf_dir), 10, DEFAULT.drop_ratio)


@query(f"WITH {_HYBRID} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM fused WHERE rank <= 15")
def hybrid_rrf(spark, sf_dir):
    """Lexical and dense arms of 75 for every benchmark question, fused, the best 15 of each."""
    return index(spark, sf_dir).hybrid(asked(spark, sf_dir), 75).where("rank <= 15")


_TOKENS = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]{{2,}}'))"
_RERANK = f"""{_HYBRID},
scored AS (
  SELECT f.query_id, f.id, f.score AS recall_score, f.rank AS recall_rank,
         CASE WHEN trim(coalesce(d.text, '')) = '' OR trim(coalesce(b.text, '')) = '' THEN NULL
              WHEN len({_TOKENS.format('b.text')}) > 0 AND len({_TOKENS.format('d.text')}) > 0
              THEN round(len(list_intersect({_TOKENS.format('b.text')}, {_TOKENS.format('d.text')})) / len({_TOKENS.format('b.text')}), 6) ELSE 0.0 END AS rerank_score
  FROM fused f JOIN documents d ON d.doc_id = f.id JOIN benchmark b ON b.item_id = f.query_id WHERE f.rank <= 75),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, recall_rank) AS rank FROM scored)"""


@query(f"WITH {_RERANK} SELECT query_id, id, recall_score, rerank_score, CAST(rank AS INTEGER) AS rank FROM reranked")
def rerank_attach(spark, sf_dir):
    ix, q = index(spark, sf_dir), asked(spark, sf_dir)
    recall = written(ix.hybrid(q, 75))
    pairs = retrieval.with_contents(recall, ix.docs, q)
    return retrieval.reranked(recall, retrieval.lexical_scores(pairs)).select("query_id", "id", "recall_score", "rerank_score", "rank")


@query(
    f"""WITH {_RERANK}, kept AS (SELECT * FROM reranked WHERE rerank_score >= 0.0004),
falls AS (SELECT *, round(lag(rerank_score) OVER (PARTITION BY query_id ORDER BY rank) - rerank_score, 8) >= 0.5 AS f FROM kept),
cuts AS (SELECT query_id, min(rank) AS cut FROM falls WHERE f GROUP BY 1),
last AS (SELECT * FROM falls LEFT JOIN cuts USING (query_id) WHERE cut IS NULL OR rank < cut QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 15)
SELECT l.query_id, l.id AS chunk_id, l.rerank_score AS score, d.source, CAST(length(d.text) AS INTEGER) AS n_chars FROM last l JOIN documents d ON d.doc_id = l.id"""
)
def flow_response(spark, sf_dir):
    """The whole retrieval: recall, fusion, rerank, threshold, cliff of 0.5, limit; rows by chunk id."""
    from dataclasses import replace

    docs = table(spark, sf_dir, "documents")
    ix = retrieval.Index(docs, "doc_id", "text", replace(DEFAULT, cliff_delta=0.5))
    hits = ix.search(asked(spark, sf_dir))
    shown = docs.select("doc_id", "source", F.length("text").alias("n_chars"))
    out = hits.join(shown, hits["id"] == shown["doc_id"]).select("query_id", F.col("id").alias("chunk_id"), F.col("rerank_score").alias("score"), "source", "n_chars")
    return out.orderBy("query_id", "chunk_id")


@query("SELECT doc_id, 'doc_' || substr(sha1(source), 1, 12) AS file_id, 'doc_' || substr(sha1(source), 1, 12) || '_chunk_' || lpad(CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS VARCHAR), 6, '0') AS chunk_id FROM documents")
def chunk_ids(spark, sf_dir):
    """A source as a file, whose documents are numbered without a window over the file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", T.file_id(F.col("source"), F.lit("doc")).alias("file_id"))
    return numbered(docs, ["source"], [F.col("doc_id")], "at", count=docs.count()).select("doc_id", "file_id", T.chunk_id(F.col("file_id"), F.col("at") - 1).alias("chunk_id"))


def _chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    at = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    file = T.file_id(F.col("source"), F.lit("doc"))
    return docs.select("doc_id", "source", "lang", file.alias("file_id"), at.cast("long").alias("chunk_index"), F.col("text").alias("content")).withColumn("id", T.chunk_id(F.col("file_id"), F.col("chunk_index")))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def get_by_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return store.get_by_ids(rows, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))).select(F.col("id").alias("doc_id"), "n_chars")


@query("SELECT doc_id, source FROM documents WHERE lang NOT IN (SELECT lang FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)")
def delete_by_file(spark, sf_dir):
    """Documents of all languages but the most common one, which is deleted as a file."""
    rows = table(spark, sf_dir, "documents").withColumn("file_id", F.col("lang"))
    gone = rows.groupBy("file_id").count().orderBy(F.desc("count"), "file_id").limit(1)
    return store.delete_by_file(rows, gone).select("doc_id", "source")


@query(
    """SELECT id, content FROM (SELECT CAST(doc_id AS VARCHAR) AS id, lang AS file_id, text AS content FROM documents) WHERE file_id <> 'en'
UNION ALL SELECT 'new_' || item_id AS id, text AS content FROM benchmark"""
)
def upsert_replace(spark, sf_dir):
    """The English file replaced by the benchmark's passages, in a store on disk."""
    none = {"vector": F.lit(None).cast("array<float>"), "sparse": F.lit(None).cast("map<long,float>"), "metadata": F.lit(None).cast("string")}
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("file_id"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("content"))
    new = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("new_"), F.col("item_id").cast("string")).alias("id"), F.lit("en").alias("file_id"), F.col("item_id").alias("chunk_index"), F.col("text").alias("content"))
    held = store.Store(spark, scratch(spark))
    for rows in (old, new):
        held.upsert(rows.withColumns(none))
    return held.read().select("id", "content")


@query(f"SELECT doc_id, {cleaning.sql('text', light=True)} AS text FROM documents")
def clean_text_basic(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_metadata(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {cleaning.sql('text')} AS text FROM documents")
def clean_text_full(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query("SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS question FROM benchmark")
def sanitize_questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.sanitize_question(F.col("text")).alias("question"))


_LINES = "SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS item_index, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)"


@query(f"SELECT doc_id, item_index, 'paragraph' AS type, '正文' AS style, line AS text FROM ({_LINES}) WHERE trim(line, ' ') <> ''")
def split_lines_items(spark, sf_dir):
    return items.items_from_text(table(spark, sf_dir, "documents"))


def _headed(spark, sf_dir):
    """Lines as items; a short line without an end mark inside is a heading of level 1 if it has two words or fewer, else 2."""
    rows = items.items_from_text(table(spark, sf_dir, "documents"))
    n = F.size(F.split("text", " "))
    style = F.when((n <= 2) & (F.length("text") <= 40), "heading 1").when((n <= 4) & (F.length("text") <= 60), "heading 2").otherwise(items.BODY)
    return rows.withColumn("style", style)


@query(
    f"""WITH l AS (SELECT doc_id, item_index, line, len(string_split(line, ' ')) AS n FROM ({_LINES}) WHERE trim(line, ' ') <> ''),
h AS (SELECT *, CASE WHEN n <= 2 AND length(line) <= 40 THEN 1 WHEN n <= 4 AND length(line) <= 60 THEN 2 END AS level FROM l),
s AS (SELECT *, replace(replace(trim(regexp_replace(line, '\\s+', ' ', 'g')), '/', '／'), '\\', '＼') AS seg FROM h),
w AS (
  SELECT doc_id, item_index, level,
    last_value(CASE WHEN level = 1 THEN item_index END IGNORE NULLS) OVER o AS p1, last_value(CASE WHEN level = 1 THEN seg END IGNORE NULLS) OVER o AS s1,
    last_value(CASE WHEN level = 2 THEN item_index END IGNORE NULLS) OVER o AS p2, last_value(CASE WHEN level = 2 THEN seg END IGNORE NULLS) OVER o AS s2
  FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY item_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, item_index, concat_ws('\\', s1, CASE WHEN p2 > coalesce(p1, -1) THEN s2 END) AS path FROM w"""
)
def heading_paths(spark, sf_dir):
    return items.heading_paths(_headed(spark, sf_dir)).select("doc_id", "item_index", "path")


@query(
    f"""WITH l AS (SELECT doc_id, item_index, line, len(string_split(line, ' ')) AS n FROM ({_LINES}) WHERE trim(line, ' ') <> ''),
h AS (SELECT *, CASE WHEN n <= 2 AND length(line) <= 40 THEN 1 WHEN n <= 4 AND length(line) <= 60 THEN 2 END AS level, replace(replace(trim(regexp_replace(line, '\\s+', ' ', 'g')), '/', '／'), '\\', '＼') AS seg FROM l),
w AS (
  SELECT doc_id, item_index, line, level, sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) OVER o AS segment,
    last_value(CASE WHEN level = 1 THEN item_index END IGNORE NULLS) OVER o AS p1, last_value(CASE WHEN level = 1 THEN seg END IGNORE NULLS) OVER o AS s1,
    last_value(CASE WHEN level = 2 THEN item_index END IGNORE NULLS) OVER o AS p2, last_value(CASE WHEN level = 2 THEN seg END IGNORE NULLS) OVER o AS s2
  FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY item_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, CAST(segment AS BIGINT) AS segment, min(concat_ws('\\', s1, CASE WHEN p2 > coalesce(p1, -1) THEN s2 END)) AS path, 'text' AS chunk_type, string_agg(line, chr(10) ORDER BY item_index) AS content
FROM w WHERE level IS NULL GROUP BY doc_id, segment"""
)
def segment_headings(spark, sf_dir):
    return items.segments(_headed(spark, sf_dir))


@query()
def chunk_documents(spark, sf_dir):
    return items.chunk(_headed(spark, sf_dir))


@query(
    f"""WITH RECURSIVE l AS (SELECT doc_id, item_index, line, row_number() OVER (PARTITION BY doc_id ORDER BY item_index) AS r FROM ({_LINES}) WHERE trim(line, ' ') <> ''),
w AS (
  SELECT doc_id, r, CAST(0 AS INTEGER) AS batch, CAST(length(line) AS BIGINT) AS size FROM l WHERE r = 1
  UNION ALL SELECT l.doc_id, l.r, CASE WHEN w.size + length(l.line) <= 800 THEN w.batch ELSE w.batch + 1 END, CASE WHEN w.size + length(l.line) <= 800 THEN w.size + length(l.line) ELSE length(l.line) END
  FROM w JOIN l ON l.doc_id = w.doc_id AND l.r = w.r + 1)
SELECT doc_id, item_index, line, batch FROM w JOIN l USING (doc_id, r)"""
)
def batch_rows_limit(spark, sf_dir):
    return items.batched(items.lines(table(spark, sf_dir, "documents")), 800)


@query("SELECT doc_id, CAST(length(coalesce(text, '')) AS INTEGER) AS chars, CAST(length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) AS INTEGER) AS non_space_chars, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '')) AS INTEGER) AS non_empty_lines FROM documents")
def non_space_stats(spark, sf_dir):
    return evaluation.text_stats(table(spark, sf_dir, "documents"))


@query(
    f"""WITH l AS (SELECT d.source, l.doc_id, l.line FROM ({_LINES}) l JOIN documents d USING (doc_id) WHERE trim(l.line, ' ') <> ''),
p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM l GROUP BY 1)
SELECT source, line, count(DISTINCT doc_id) AS n_pages FROM l JOIN p USING (source) WHERE length(line) <= 80 GROUP BY source, line HAVING count(DISTINCT doc_id) >= greatest(2, ceil(CAST(0.02 AS DOUBLE) * any_value(pages)))"""
)
def repeated_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return meta.repeated_lines(items.lines(docs).join(docs.select("doc_id", "source"), "doc_id"), "source", "doc_id", share=0.02)


_FILES = "SELECT page_id, url, regexp_replace(p, '\\.html$', '') AS stem, CASE WHEN p LIKE '%.html' THEN 'html' ELSE 'none' END AS kind FROM (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1), '/$', '') AS p FROM pages)"


@query(f"WITH f AS ({_FILES}) SELECT page_id, kind FROM f WHERE kind = 'html' OR NOT EXISTS (SELECT 1 FROM f g WHERE g.kind = 'html' AND lower(g.stem) = lower(f.stem))")
def dedupe_twins(spark, sf_dir):
    return meta.twins(page_files(spark, sf_dir), "stem", "kind", "html").select("page_id", "kind")


@query(
    f"""WITH t AS (SELECT item_id, {_TOKENS.format('text')} AS t FROM benchmark), d AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)
SELECT t.item_id, count(d.doc_id) AS n_hits, min(d.doc_id) AS first_doc FROM t LEFT JOIN d ON len(t.t) > 0 AND len(d.t) > 0 AND len(list_intersect(t.t, d.t)) / len(t.t) >= 0.45 GROUP BY 1"""
)
def token_overlap_recall(spark, sf_dir):
    """For each passage, the documents that hold 45 % of its tokens: by an inverted index of the passages, where the documents are."""
    return _overlapping(spark, sf_dir, False)


def _overlapping(spark, sf_dir, compat: bool):
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    hits = evaluation.overlapping(b, table(spark, sf_dir, "documents"), compat=compat).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_hits"), F.min("doc_id").alias("first_doc"))
    return b.select("item_id").distinct().join(hits, "item_id", "left").select("item_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "first_doc")


_FLAT_TOKENS = "list_distinct(regexp_extract_all(regexp_replace(lower(coalesce({0}, '')), '\\s+', '', 'g'), '[a-z0-9_]{{2,}}'))"


@query(
    f"""WITH t AS (SELECT item_id, {_FLAT_TOKENS.format('text')} AS t FROM benchmark), d AS (SELECT doc_id, {_FLAT_TOKENS.format('text')} AS t FROM documents)
SELECT t.item_id, count(d.doc_id) AS n_hits, min(d.doc_id) AS first_doc FROM t LEFT JOIN d ON len(t.t) > 0 AND len(d.t) > 0 AND len(list_intersect(t.t, d.t)) / len(t.t) >= 0.45 GROUP BY 1"""
)
def token_overlap_compat(spark, sf_dir):
    """As token_overlap_recall, by the tokens that run together once white space is gone."""
    return _overlapping(spark, sf_dir, True)


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON instr(regexp_replace(lower(d.text), '\\s+', '', 'g'), regexp_replace(lower(b.text), '\\s+', '', 'g')) > 0")
def contains_recall(spark, sf_dir):
    """Passages within documents, both without white space."""
    return evaluation.contained(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")), table(spark, sf_dir, "documents"))


@query(
    """SELECT count(*) AS n, round(avg(CAST(quality = 1 AND toxic = 0 AS INT)), 4) AS pass_rate, round(avg(CAST(quality AS DOUBLE)), 4) AS average_recall,
round(avg(CAST(quality * 5 AS DOUBLE)), 2) AS mean_readability, round(avg(CAST(5 - 5 * toxic AS DOUBLE)), 2) AS mean_correctness, round(avg(CAST(n_chars % 6 AS DOUBLE)), 2) AS mean_completeness,
round(avg(CAST(n_chars AS DOUBLE)), 2) AS mean_latency_ms, count(*) FILTER (toxic = 1) AS failed_query_count FROM labels JOIN documents USING (doc_id)"""
)
def eval_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    d = lambda x: x.cast("double")
    results = rows.select(
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("pass"), d(F.col("quality")).alias("recall"), d(F.col("quality") * 5).alias("readability"), d(5 - 5 * F.col("toxic")).alias("correctness"),
        d(F.col("n_chars") % 6).alias("completeness"), d(F.col("n_chars")).alias("latency_ms"), F.when(F.col("toxic") == 1, "toxic").alias("error"),
    )
    return evaluation.summary(results)


_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


@query(f"SELECT event_id, greatest(0.0, least(5.0, coalesce({_K}, 0.0))) AS score, greatest(0.0, least(5.0, coalesce({_K}, 0.0))) >= 4 AS pass FROM events")
def judgment_normalise(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    rows = table(spark, sf_dir, "events").select("event_id", k.alias("readability"), k.alias("correctness"), k.alias("completeness"))
    return evaluation.judged(rows).select("event_id", F.col("correctness").alias("score"), "pass")


@query(
    """WITH a AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
s AS (SELECT event_type, count(*) AS count, round(min(value), 3) AS min, round(max(value), 3) AS max, round(avg(value), 3) AS mean, round(median(value), 3) AS median, round(quantile_cont(value, 0.9), 3) AS p90,
 round(avg(value) FILTER (i <= greatest(1, n // 2)), 3) AS head_mean, round(coalesce(avg(value) FILTER (i > greatest(1, n // 2)), avg(value)), 3) AS tail_mean FROM a GROUP BY 1)
SELECT *, round(tail_mean - head_mean, 3) AS tail_minus_head FROM s"""
)
def latency_summary(spark, sf_dir):
    return evaluation.latency_summary(table(spark, sf_dir, "events"), "event_type", "value", "event_id")


@query("SELECT event_type, greatest(0.0, least(100.0, round(100 * max(value) / (SELECT max(value) FROM events), 4))) AS share FROM events GROUP BY 1")
def chart_series(spark, sf_dir):
    return evaluation.chart_series(table(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last).select("user_id", "e.*")


@query(
    """WITH RECURSIVE e AS (SELECT CAST(conv_id AS VARCHAR) AS key, turn AS seq, CASE role WHEN 'user' THEN 'question' ELSE 'answer' END AS kind, text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, CASE role WHEN 'user' THEN 'question' ELSE 'answer' END, text) AS r FROM conversations WHERE role IN ('user', 'assistant')),
w AS (
  SELECT key, r, CASE WHEN kind = 'question' THEN [r] ELSE CAST([] AS BIGINT[]) END AS stack, CAST(NULL AS BIGINT) AS closed FROM e WHERE r = 1
  UNION ALL SELECT e.key, e.r, CASE WHEN e.kind = 'question' THEN list_append(w.stack, e.r) ELSE w.stack[:len(w.stack) - 1] END, CASE WHEN e.kind = 'answer' AND len(w.stack) > 0 THEN w.stack[len(w.stack)] END
  FROM w JOIN e ON e.key = w.key AND e.r = w.r + 1)
SELECT q.key, q.seq, q.text AS question, coalesce(a.text, '') AS answer FROM e q LEFT JOIN w ON w.key = q.key AND w.closed = q.r LEFT JOIN e a ON a.key = w.key AND a.r = w.r WHERE q.kind = 'question'
UNION ALL SELECT e.key, e.seq, '', e.text FROM e JOIN w ON w.key = e.key AND w.r = e.r WHERE e.kind = 'answer' AND w.closed IS NULL"""
)
def answer_attach(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return chat.attach_answers(rows.select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "question").otherwise("answer").alias("kind"), "text"))


@query("SELECT conv_id, turn, text AS question, answer FROM (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'")
def qa_pairs(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, arg_min(event_type, (ts, event_id)) AS selected, count(*) AS n_clicks FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL")
def first_choice_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return chat.first_choices(rows, ["user_id", "day"], ["ts", "event_id"], "event_type")


@query("SELECT event_id, user_id FROM events WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) <= CAST(86400 AS BIGINT) * 1000000")
def feedback_ttl(spark, sf_dir):
    return chat.within_window(table(spark, sf_dir, "events"), "ts", 86400).select("event_id", "user_id")


@query(
    """WITH RECURSIVE e AS (SELECT user_id || ':' || event_type AS key, epoch_us(ts) AS ts_us, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
w AS (
  SELECT key, r, ts_us + 3600000000 AS until, TRUE AS kept FROM e WHERE r = 1
  UNION ALL SELECT e.key, e.r, CASE WHEN e.ts_us >= w.until THEN e.ts_us + 3600000000 ELSE w.until END, e.ts_us >= w.until FROM w JOIN e ON e.key = w.key AND e.r = w.r + 1)
SELECT key, ts_us, event_id FROM w JOIN e USING (key, r) WHERE kept"""
)
def dedupe_first_seen(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_id")
    return chat.first_seen(rows)


_STAGE = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END"


@query(f"SELECT event_id, CAST({_STAGE} AS INTEGER) AS stage, CAST(max({_STAGE}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS progress FROM events")
def progress_stage(spark, sf_dir):
    kind = F.col("event_type")
    stage = F.when(kind == "view", 1).when(kind == "click", 2).when(kind == "purchase", 3).otherwise(0)
    return chat.running_stage(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], stage).select("event_id", "stage", "progress")


@query("SELECT e.user_id, e.event_id AS point_id, p.event_id AS span_id FROM events e JOIN events p ON e.user_id = p.user_id AND e.event_type = 'error' AND p.event_type = 'purchase' AND epoch_us(e.ts) BETWEEN epoch_us(p.ts) - 3 * 1000000 AND epoch_us(p.ts) + 600 * 1000000")
def interval_match(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    points = rows.where("event_type = 'error'").select("user_id", F.col("event_id").alias("point_id"), "ts")
    spans = rows.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span_id"), F.col("ts").alias("start"), F.col("ts").alias("end"))
    return meta.interval_matches(points, spans, "user_id", 3, 600)


@query("SELECT event_id, nullif(trim(json_extract_string(props, '$.k')), '') AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.nullif(F.trim(F.get_json_object("props", "$.k")), F.lit("")).alias("k"))


_HREFS = "regexp_extract_all(coalesce(html, ''), '<a\\s+href=\"([^\"]*)\"', 1)"


@query(f"SELECT page_id, CAST(unnest(range(len(h))) AS INTEGER) AS pos, unnest(h) AS href FROM (SELECT page_id, {_HREFS} AS h FROM pages)")
def html_links(spark, sf_dir):
    return meta.links(table(spark, sf_dir, "pages"))


@query(f"SELECT page_id, href, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) AS INTEGER) AS n, count(*) AS uses FROM (SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS href FROM (SELECT page_id, {_HREFS} AS h FROM pages)) GROUP BY page_id, href")
def reference_numbers(spark, sf_dir):
    rows = meta.numbered(meta.links(table(spark, sf_dir, "pages")), ["page_id"], ["pos"], "href")
    return rows.groupBy("page_id", "href", "n").agg(F.count(F.lit(1)).alias("uses"))


@query("SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1)) AS domain FROM pages")
def link_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.url_domain(F.col("url")).alias("domain"))


@query("SELECT source, arg_min(md5(coalesce(text, '')), doc_id) AS digest FROM documents GROUP BY 1")
def first_wins_map(spark, sf_dir):
    return meta.first_wins(_digests(spark, sf_dir), "source", "digest", ["doc_id"])


def _digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query("WITH k AS (SELECT source, arg_min(md5(coalesce(text, '')), doc_id) AS kept FROM documents GROUP BY 1) SELECT DISTINCT source, kept, md5(coalesce(text, '')) AS other FROM documents JOIN k USING (source) WHERE md5(coalesce(text, '')) <> kept")
def map_conflicts(spark, sf_dir):
    return meta.conflicts(_digests(spark, sf_dir), "source", "digest", ["doc_id"])


@query(
    f"""WITH a AS (SELECT 0 AS part, item_id AS seq, unnest({_WORDS.format('text')}) AS word, 'n' AS pos FROM benchmark UNION ALL SELECT 1, doc_id, unnest({_WORDS.format('text')}), lang FROM documents)
SELECT word, arg_min(pos, (part, seq)) AS pos FROM a WHERE length(word) >= 2 AND NOT regexp_matches(word, '^[0-9]+$') GROUP BY 1"""
)
def vocab_merge(spark, sf_dir):
    old = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("word"), F.lit("n").alias("pos"), F.col("item_id").alias("seq"))
    new = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"), F.col("lang").alias("pos"), F.col("doc_id").alias("seq"))
    return meta.vocabulary(old, new)


@query(
    f"""WITH l AS (SELECT doc_id, item_index, line FROM ({_LINES})),
f AS (SELECT doc_id, item_index, coalesce(last_value(nullif(trim(line, ' '), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY item_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'column') AS h FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY item_index) AS k FROM f)
SELECT doc_id, item_index, CASE WHEN k = 1 THEN h ELSE h || '_' || k END AS header FROM n"""
)
def header_unique(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("item_index", "header"))
    return meta.unique_headers(rows, "doc_id", "item_index", "header")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM conversations")
def forward_fill(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return meta.forward_filled(rows, "conv_id", ["turn"], F.when(F.col("role") == "user", F.col("text")), "asked").select("conv_id", "turn", "asked")


@query(
    """WITH a AS (SELECT s_suppkey, s_nationkey, s_acctbal, coalesce(lag(s_acctbal) OVER w - s_acctbal > 150, TRUE) AS s FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)),
b AS (SELECT *, CAST(sum(CAST(s AS INT)) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM a)
SELECT s_suppkey, cluster, round(avg(s_acctbal) OVER (PARTITION BY s_nationkey, cluster), 6) AS cluster_mean FROM b"""
)
def gap_cluster(spark, sf_dir):
    return meta.gap_clusters(table(spark, sf_dir, "supplier"), "s_acctbal", "s_suppkey", 150, ["s_nationkey"]).select("s_suppkey", "cluster", "cluster_mean")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY 1")
def ordered_concat(spark, sf_dir):
    line = F.concat("role", F.lit(": "), "text")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("x")))), lambda e: e["x"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(parts, "\n").alias("content"))


@query("SELECT item_id, text FROM benchmark ORDER BY md5('7:' || item_id), item_id LIMIT 20")
def sample_n(spark, sf_dir):
    """A sample of 20 questions: the operator is a limit."""
    return evaluation.sample(table(spark, sf_dir, "benchmark"), "item_id", 20, 7)


@query("SELECT item_id, text FROM benchmark ORDER BY item_id OFFSET 5 LIMIT 12")
def offset_slice(spark, sf_dir):
    """Twelve questions from the sixth on: the operator is a slice."""
    return table(spark, sf_dir, "benchmark").orderBy("item_id").offset(5).limit(12)


@query(f"SELECT doc_id, CASE WHEN length(t) <= 600 THEN t ELSE substr(t, 1, 400) || '{T.OMITTED}' || right(t, 200) END AS text FROM (SELECT doc_id, trim(regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents)")
def trim_head_tail(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.trim_document(F.col("text"), 600).alias("text"))


@query("SELECT conv_id, turn, TRUE AS hidden, TRUE AS same FROM conversations")
def encrypt_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("c", chat.encrypted(F.col("text"), "secret"))
    return rows.select("conv_id", "turn", (F.col("c") != F.col("text")).alias("hidden"), (chat.decrypted(F.col("c"), "secret") == F.col("text")).alias("same"))


@query(
    """SELECT 'r' || r_regionkey AS node, CAST(0 AS INTEGER) AS depth, r_name AS path FROM region
UNION ALL SELECT 'n' || n_nationkey, 1, r_name || '/' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 's' || s_suppkey, 2, r_name || '/' || n_name || '/' || s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"""
)
def tree_walk(spark, sf_dir):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nations = table(spark, sf_dir, "nation").select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("child"), F.col("n_name").alias("name"))
    suppliers = table(spark, sf_dir, "supplier").select(key("n", "s_nationkey").alias("parent"), key("s", "s_suppkey").alias("child"), F.col("s_name").alias("name"))
    roots = table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("node"), F.col("r_name").alias("name"))
    return meta.tree(spark, nations.unionByName(suppliers), roots)


@query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def type_histogram(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH b AS (SELECT p_partkey AS id, p_size AS page, p_retailprice AS x0, p_retailprice + 5 AS x1, CAST(p_partkey % 50 AS DOUBLE) AS y0, CAST(p_partkey % 50 + 8 AS DOUBLE) AS y1 FROM part)
SELECT l.id AS a, r.id AS b FROM b l JOIN b r ON l.page = r.page AND l.id < r.id AND l.x0 <= r.x1 AND r.x0 <= l.x1 AND l.y0 <= r.y1 AND r.y0 <= l.y1"""
)
def box_intersect(spark, sf_dir):
    low = (F.col("p_partkey") % 50).cast("double")
    boxes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("page"), F.col("p_retailprice").alias("x0"), (F.col("p_retailprice") + 5).alias("x1"), low.alias("y0"), (low + 8).alias("y1"))
    return meta.box_pairs(boxes, boxes, "page").where("l.id < r.id").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


@query(
    """WITH RECURSIVE p AS (SELECT p_partkey AS id, p_brand AS slide, p_retailprice AS top, CAST(p_size AS DOUBLE) AS "left", row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_size, p_partkey) AS r FROM part),
w AS (
  SELECT slide, r, CAST(0 AS BIGINT) AS "row", top AS leader FROM p WHERE r = 1
  UNION ALL SELECT p.slide, p.r, CASE WHEN p.top - w.leader > 25 THEN w."row" + 1 ELSE w."row" END, CASE WHEN p.top - w.leader > 25 THEN p.top ELSE w.leader END FROM w JOIN p ON p.slide = w.slide AND p.r = w.r + 1)
SELECT id, slide, top, "left", "row", row_number() OVER (PARTITION BY slide ORDER BY "row", "left", r) - 1 AS place FROM w JOIN p USING (slide, r)"""
)
def reading_order(spark, sf_dir):
    """Parts as slide elements: price as top, size as left, brand as the slide."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("slide"), F.col("p_retailprice").alias("top"), F.col("p_size").cast("double").alias("left"))
    return meta.row_leaders(rows, "slide", 25.0)


from tessera.plans import indexed, more, streams  # noqa: E402, F401 - registers the further queries
