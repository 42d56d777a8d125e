"""Queries over what is stored: the chunk store through its versions, and searches that open parts of an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import segment
from tessera.operators import evaluation, layout, pivots, store, stored_index
from tessera.operators.chat_log import ChatLog
from tessera.plans.catalog import _BM25, _COSINE, SQL, _sparse, asked, query
from tessera.session import scratch, table


def _chunks(rows, id_, file_id, at, content):
    """Chunks for a store from columns of rows."""
    none = {"vector": F.lit(None).cast("array<float>"), "sparse": F.lit(None).cast("map<long,float>"), "metadata": F.lit(None).cast("string")}
    return rows.select(id_.alias("id"), file_id.alias("file_id"), at.cast("long").alias("chunk_index"), content.alias("content")).withColumns(none)


@query(
    """WITH o AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, 'file' || doc_id % 97 AS file_id, doc_id % 97 AS f, md5(coalesce(text, '')) AS content, doc_id FROM documents),
held AS (
  SELECT id, file_id, content FROM o WHERE f % 4 <> 1 AND f % 3 <> 2
  UNION ALL SELECT 'r' || id, file_id, 'replaced ' || content FROM o WHERE f % 4 <> 1 AND f % 3 = 2 AND doc_id % 2 = 0
  UNION ALL SELECT 'back ' || id, file_id, content FROM o WHERE f = 1)
SELECT id, file_id, content, CAST(9 AS INTEGER) AS versions FROM held"""
)
def store_upserts(spark, sf_dir):
    """Digests of documents as chunks of 97 files: ingested in three upserts, a third of the files replaced, a quarter deleted, one of these ingested again, then compacted; with the count of versions so far."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 97).alias("f"), F.md5(F.coalesce("text", F.lit(""))).alias("content"))
    key, file_id, at = F.col("doc_id").cast("string"), F.concat(F.lit("file"), F.col("f").cast("string")), F.col("doc_id")
    whole = _chunks(docs, key, file_id, at, F.col("content"))
    held = store.Store(spark, scratch(spark))
    held.ensure(buckets=8)
    for part in range(3):
        held.upsert(_chunks(docs.where(F.col("f") % 3 == part), key, file_id, at, F.col("content")))
    held.upsert(_chunks(docs.where("f % 3 = 2 and doc_id % 2 = 0"), F.concat(F.lit("r"), key), file_id, at, F.concat(F.lit("replaced "), "content")))
    gone = docs.where("f % 4 = 1").select(file_id.alias("file_id"))
    held.upsert(whole.limit(0), gone)
    held.upsert(whole.limit(0), gone)
    held.upsert(_chunks(docs.where("f = 1"), F.concat(F.lit("back "), key), file_id, at, F.col("content")))
    held.compact()
    return held.read().select("id", "file_id", "content", F.lit(len(held.versions())).alias("versions"))


@query(f"WITH {_BM25},{_sparse()} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM sparse WHERE rank <= 10")
def bm25_topk_stored(spark, sf_dir):
    """bm25_topk from postings on disk, of which the folders of the queries' terms are opened."""
    docs, at = table(spark, sf_dir, "documents"), scratch(spark)
    stored_index.build_lexical(docs, "doc_id", "text", at)
    return stored_index.StoredIndex(docs, "doc_id", "text", at).sparse(asked(spark, sf_dir), 10)


@query(f"WITH {_COSINE} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def dense_topk_stored(spark, sf_dir):
    """dense_topk from vectors on disk by pivots, of which those out of reach are not opened."""
    rows, at = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), scratch(spark)
    pivots.build(rows, at)
    return pivots.search(spark, at, rows.withColumnRenamed("id", "query_id"), 10, exclude_self=True)


#: Letters as 26 Han characters: texts and words of a language without blanks, made of the tables' own.
_LETTERS, _HAN = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + i) for i in range(26))


@query(
    f"""WITH RECURSIVE h AS (SELECT doc_id, row_number() OVER () AS r, translate(lower(coalesce(text, '')), '{_LETTERS}', '{_HAN}') AS t FROM documents),
vocabulary AS (SELECT DISTINCT unnest(regexp_extract_all(translate(lower(coalesce(text, '')), '{_LETTERS}', '{_HAN}'), '[{_HAN}]+')) AS word FROM benchmark),
entries AS (SELECT map(list(word), list(CASE WHEN length(word) > 4 THEN -10 ELSE -20 END)) AS m FROM vocabulary WHERE length(word) BETWEEN 2 AND 6),
runs AS (SELECT DISTINCT unnest(regexp_extract_all(t, '[{_HAN}]+')) AS run FROM h),
dp(run, i, best, words) AS (
  SELECT run, CAST(length(run) + 1 AS BIGINT), [CAST(0 AS BIGINT)], [CAST([] AS VARCHAR[])] FROM runs
  UNION ALL
  SELECT run, i - 1, list_prepend(pick.score, best), list_prepend(list_prepend(substr(run, i - 1, pick.l), words[pick.l]), words)
  FROM (
    SELECT run, i, best, words,
           list_max(list_transform(range(1, least(6, length(run) - i + 2) + 1), lambda l: CASE WHEN l = 1 OR m[substr(run, i - 1, l)] IS NOT NULL THEN {{'score': CAST(coalesce(m[substr(run, i - 1, l)], -30) + best[l] AS BIGINT), 'l': l}} END)) AS pick
    FROM dp, entries WHERE i > 1)),
cuts AS (SELECT run, words[1] AS words FROM dp WHERE i = 1),
placed AS (SELECT r, unnest(regexp_extract_all(t, '[{_HAN}]+')) AS run, unnest(range(CAST(len(regexp_extract_all(t, '[{_HAN}]+')) AS BIGINT))) AS place FROM h),
han AS (SELECT r, flatten(list(words ORDER BY place)) AS words FROM placed JOIN cuts USING (run) GROUP BY r),
done AS (SELECT doc_id, list_concat(regexp_extract_all(regexp_replace(t, '[{_HAN}]+', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+'), coalesce(words, [])) AS words FROM h LEFT JOIN han USING (r))
SELECT doc_id, len(words) AS n_words, md5(array_to_string(words, ' ')) AS digest FROM done"""
)
def segmented_words(spark, sf_dir):
    """Words of texts in Han characters by a dictionary of the benchmark's words, of which the longer ones are custom words."""
    han = lambda c: F.translate(F.lower(F.coalesce(F.col(c), F.lit(""))), _LETTERS, _HAN)
    listed = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(han("text"), F.lit(f"[{_HAN}]+"), F.lit(0))).alias("word")).distinct()
    entries = segment.dictionary(listed.where(F.length("word").between(2, 4)), listed.where(F.length("word").between(5, 6)))
    found = segment.words(han("text"), segment.cutter(entries))
    rows = table(spark, sf_dir, "documents").select("doc_id", found.alias("words"))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", " ")).alias("digest"))


@query(
    """WITH c AS (SELECT conv_id, turn, role, md5(coalesce(text, '')) AS digest FROM conversations),
q AS (SELECT conv_id, turn, digest FROM c WHERE role = 'user'),
a AS (SELECT q.conv_id, q.turn, c.digest AS answer FROM q JOIN c ON c.conv_id = q.conv_id AND c.turn = q.turn + 1 AND c.role = 'assistant')
SELECT q.conv_id || ':' || q.turn AS record_id, 'c' || q.conv_id AS session_id, q.digest AS question,
       CASE WHEN a.answer IS NULL THEN '' WHEN q.conv_id % 3 = 0 THEN 'second ' || a.answer ELSE a.answer END AS answer, CASE WHEN q.conv_id % 5 = 0 THEN 'named' END AS user_name
FROM q LEFT JOIN a ON a.conv_id = q.conv_id AND a.turn = q.turn"""
)
def chat_log(spark, sf_dir):
    """Questions inserted in two batches, answers set by updates, a third of them twice, names set by others, and compacted on the way."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    key = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string")).alias("record_id")
    asked = rows.where("role = 'user'").select(key(F.col("turn")), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), F.col("digest").alias("question"), "conv_id")
    answers = rows.where("role = 'assistant'").select(key(F.col("turn") - 1), F.col("digest").alias("answer"), "conv_id")
    log = ChatLog(spark, scratch(spark), "registered-queries")
    for part in range(2):
        log.insert(asked.where(F.col("conv_id") % 2 == part))
    log.update(answers)
    log.update(asked.where("conv_id % 5 = 0").select("record_id", F.lit("named").alias("user_name")))
    log.update(answers.where("conv_id % 3 = 0").select("record_id", F.concat(F.lit("second "), "answer").alias("answer")))
    return log.read().select("record_id", "session_id", "question", "answer", "user_name")


@query(
    """WITH i AS (
  SELECT vec_id AS image_id, vec_id % 61 AS doc_id, list_transform(embedding, lambda e: CAST(e > 0.15 AS INTEGER)) AS bits, (vec_id % 3) / 40.0 AS x, (vec_id % 2) / 10.0 AS w FROM embeddings),
pairs AS (
  SELECT a.image_id, a.doc_id, b.image_id AS other FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.image_id <> b.image_id AND abs(a.x - b.x) <= 0.04 AND abs(a.w - b.w) <= 0.06
  WHERE list_sum(list_transform(list_zip(a.bits, b.bits), lambda p: CAST(p[1] <> p[2] AS INTEGER))) <= 8)
SELECT doc_id, image_id, least(image_id, min(other)) AS first FROM pairs GROUP BY doc_id, image_id"""
)
def repeated_images(spark, sf_dir):
    """Embeddings as images: their larger components as a hash, their ids as place, size and document."""
    bits = F.array_join(F.transform("embedding", lambda e: (e > 0.15).cast("int").cast("string")), "")
    rows = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 61).alias("doc_id"), F.col("vec_id").alias("image_id"), F.lpad(F.conv(bits, 2, 16), 16, "0").alias("hash"), (F.col("vec_id") % 3 / 40.0).alias("x"), F.lit(0.0).alias("y"), (F.col("vec_id") % 2 / 10.0).alias("w"), F.lit(0.0).alias("h"),
    )
    return layout.repeated_images(rows)


@query(SQL["contains_recall"])
def contains_fingerprints(spark, sf_dir):
    """contains_recall as for more passages than one task holds: by fingerprints."""
    return evaluation.contained(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")), table(spark, sf_dir, "documents"), most_chars=0)
