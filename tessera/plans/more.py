"""Further registered queries: texts, names, events, workflows, layout, sources and sinks. Inputs are built from the driver's tables alike on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import cleaning, loose, markdown, names, references, replies
from tessera.functions import text as T
from tessera.operators import chat, enrich, evaluation, items, layout, meta, retrieval, store, webhook, workflow
from tessera.plans.catalog import _LINES, query
from tessera.session import scratch, table
from tessera.sources import files, office


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def obj(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


# ---------------------------------------------------------------- cleaning
HEAD = "​A ✅ â€™s ( "
TAIL = " ) ，x --  图片：data/processing/a b/1.PNG 同步自文档：https://a.b/c?d end\u0007 Ã\u0080 Â å\u0081 "


def dirty(text: Column) -> Column:
    return F.concat(F.lit(HEAD), F.coalesce(text, F.lit("")), F.lit(TAIL))


@query(f"SELECT doc_id, {cleaning.sql(f'(chr(8203) || {quote(HEAD[1:])} || coalesce(text, {quote(str())}) || {quote(TAIL)})')} AS text FROM documents")
def clean_dirty_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.clean_text(dirty(F.col("text"))).alias("text"))


@query(f"SELECT doc_id, {cleaning.sql(f'(chr(8203) || {quote(HEAD[1:])} || coalesce(text, {quote(str())}) || {quote(TAIL)})', light=True)} AS text FROM documents")
def clean_dirty_metadata(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.clean_metadata(dirty(F.col("text"))).alias("text"))


@query("""SELECT doc_id, '[{"' || lang || '":"' || doc_id || ',x","n":' || n_chars || ',"l":["(a)",null]}]' AS cells FROM documents""")
def clean_json_tables(spark, sf_dir):
    """Tables as JSON whose keys and texts need cleaning; a key that is empty then goes."""
    c = lambda x: F.col(x).cast("string")
    dirty_json = F.concat(F.lit('[{" '), c("lang"), F.lit(' ✅":"'), c("doc_id"), F.lit(' ,x​","n":'), c("n_chars"), F.lit(',"★":"q","l":["( a )",null]}]'))
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.clean_table(dirty_json).alias("cells"))


@query("SELECT item_id, 'say \"' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || '\" it''s / done' AS question FROM benchmark")
def sanitize_escapes(spark, sf_dir):
    text = F.concat(F.lit('﻿ say\\t\\"'), F.col("text"), F.lit("\\\"\x07 ​it\\'s\\n\\/\\r done \\f"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.sanitize_question(text).alias("question"))


@query("""SELECT doc_id, 'name ' || source || ' [["lang","n","m"],["' || lang || '",' || n_chars || ',""],["","","{""k"":1}"]]' AS text FROM documents""".replace('{""k"":1}', '{\\"k\\":1}'))
def embedding_tables(spark, sf_dir):
    """Embedding texts of chunks that are JSON tables."""
    c = lambda x: F.col(x).cast("string")
    content = F.concat(F.lit('[{"lang":"'), c("lang"), F.lit('","n":'), c("n_chars"), F.lit('},{"m":{"k":1}}]'))
    return table(spark, sf_dir, "documents").select("doc_id", T.embedding_text(F.lit("a/name.docx"), F.col("source"), content).alias("text"))


@query("SELECT page_id, 'see' || chr(10) || 'shot of ' || page_id || ' and page' AS text FROM pages")
def embedding_tags(spark, sf_dir):
    """Embedding texts of chunks with asset tags."""
    image = F.concat(F.lit('see\n<img index="1">图片： shot\n of '), F.col("page_id").cast("string"), F.lit('</img> and <a index="2">链接：page</a>'))
    return table(spark, sf_dir, "pages").select("page_id", T.embedding_text(F.lit(None).cast("string"), F.lit(" "), image).alias("text"))


# ---------------------------------------------------------------- items
@query(
    """SELECT page_id AS doc_id, 0 AS item_index, 'image' AS type, 'data/' || page_id || '.png' AS text, 'shot of ' || page_id AS description, 'data/' || page_id || '.png' AS path, NULL AS url FROM pages
UNION ALL SELECT page_id, 1, 'link', url, NULL, NULL, url FROM pages UNION ALL SELECT page_id, 2, 'paragraph', 'plain （kept）', NULL, NULL, NULL FROM pages"""
)
def asset_items(spark, sf_dir):
    """Item lines of images and links, whose descriptions stand in full-width parentheses."""
    key = F.col("page_id").cast("string")
    text = F.concat(F.lit("[image] [正文] data/"), key, F.lit(".png（shot of "), key, F.lit("）\n[link]  [链接] "), F.col("url"), F.lit("\n[paragraph] [正文] plain （kept）"))
    got = items.items_from_text(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), text.alias("text")), assets=True)
    return got.select("doc_id", "item_index", "type", "text", "description", "path", "url")


@query(
    """SELECT page_id AS doc_id, unnest([2, 3, 4, 6]) AS item_index, unnest(['link', 'paragraph', 'image', 'table']) AS type,
unnest([url, 'kept ' || page_id, '', '[{"a":"' || page_id || '"}]']) AS text FROM pages"""
)
def cleaned_items(spark, sf_dir):
    """Items with a sync note and its link, another link, an image path line, placeholders and a table."""
    key = F.col("page_id").cast("string")
    row = lambda kind, text: F.struct(F.lit(kind).alias("type"), F.lit("正文").alias("style"), text.alias("text"))
    rows = F.array(
        row("paragraph", F.lit("同步自文档：{{doc}}")), row("link", F.lit("同步自文档")), row("link", F.col("url")), row("paragraph", F.concat(F.lit("kept  "), key, F.lit(" ✅"))),
        row("image", F.lit(" ")), row("paragraph", F.lit("（ 空 ）")), row("table", F.concat(F.lit('[{"a ":" '), key, F.lit('"}]'))), row("paragraph", F.lit("图片：data/processing/x.png")),
    )
    got = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(rows).alias("item_index", "i")).select("doc_id", "item_index", "i.*")
    return items.clean_items(got).select("doc_id", "item_index", "type", "text")


@query("SELECT page_id AS chunk_id, CAST(2 AS BIGINT) AS link_index, 'l2' AS label, url AS path FROM pages")
def chunk_assets(spark, sf_dir):
    """Of three links of a document, the one whose tag the chunk holds; of equal ones the first."""
    pages = table(spark, sf_dir, "pages")
    chunks = pages.select(F.col("page_id").alias("chunk_id"), F.col("page_id").alias("doc_id"), F.lit('x <a index="2">链接：l2</a> <a index="3">链接：l2</a> <img index="1">图片：i</img>').alias("content"))
    assets = pages.select(F.col("page_id").alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("index"), F.lit(f"l{min(i, 2)}").alias("label"), F.col("url").alias("path")) for i in (1, 2, 3)])).alias("a")).select("doc_id", "a.*")
    out = enrich.with_assets(chunks, assets, "a", "links").select("chunk_id", F.explode("links").alias("l"))
    return out.select("chunk_id", F.col("l.index").alias("link_index"), "l.label", "l.path")


@query("SELECT source AS path, string_agg(lang || ' ' || doc_id, chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY 1")
def vocabulary_paragraphs(spark, sf_dir):
    """The paragraphs among item lines of several types."""
    line = F.concat(F.lit("[paragraph] [正文]  "), F.col("lang"), F.lit(" "), F.col("doc_id").cast("string"), F.lit("\n[table] [row] x\nplain\n[paragraph] [标题 1] "))
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", line.alias("x")))), lambda e: e["x"]).alias("l"))
    return files.vocabulary_lines(rows.select(F.col("source").alias("path"), F.array_join("l", "\n").alias("text")))


@query("SELECT source AS doc_id, string_agg('[page ' || doc_id || ']' || chr(10) || lang, chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents WHERE n_chars > 500 GROUP BY 1")
def page_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.when(F.col("n_chars") > 500, F.concat(F.lit(" "), F.col("lang"), F.lit("\n"))).otherwise(F.lit(" ")).alias("text"))
    return files.page_texts(rows)


@query("SELECT t, list(h ORDER BY first) AS headers FROM (SELECT s_nationkey AS t, 'h' || (s_suppkey % 7) AS h, min(s_suppkey) AS first FROM supplier GROUP BY ALL) GROUP BY t")
def table_headers(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("t"), "s_suppkey", F.create_map(F.concat(F.lit("h"), (F.col("s_suppkey") % 7).cast("string")), F.lit("v")).alias("cells"))
    return enrich.table_headers(rows, "t", "s_suppkey", "cells")


# ---------------------------------------------------------------- replies and messages
@query("SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN '' WHEN 4 THEN trim(lang || ' ' || source) ELSE trim(coalesce(text, '')) END AS answer FROM documents")
def nested_answers(spark, sf_dir):
    """Documents as replies: text deep in an object behind blank and later ones, plain, in lists, under no key of answers, and beside a longer one that comes later."""
    text, kind = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id") % 5
    inner = F.array(F.struct(F.lit(" ").alias("text"), F.lit(None).cast("string").alias("answer")), F.struct(F.lit(None).cast("string").alias("text"), F.concat(F.lit(" "), text).alias("answer")))
    reply = (
        F.when(kind == 0, obj(note=F.lit("x"), data=F.when(F.trim(text) != "", F.lit("late")).otherwise(""), result=inner))
        .when(kind == 1, F.concat(F.lit("\n"), text, F.lit("  ")))
        .when(kind == 2, F.to_json(F.array(F.array(F.struct(F.struct(text.alias("message")).alias("output"))))))
        .when(kind == 3, obj(other=text, texts=F.array(text)))
        .otherwise(obj(data=text, answer=F.concat_ws(" ", "lang", "source")))
    )
    return replies.with_answers(table(spark, sf_dir, "documents").select("doc_id", reply.alias("reply")), "reply").select("doc_id", "answer")


@query("SELECT item_id, CAST(1 AS INTEGER) AS n, CAST(item_id AS VARCHAR) AS first FROM benchmark")
def retrieved_chunks(spark, sf_dir):
    """The first list of chunks in a nested reply; what is no object is left out."""
    chunk = F.concat(F.lit('{"meta":[1],"data":{"answer":"x","contexts":["no",{"id":'), F.col("item_id").cast("string"), F.lit('}]},"chunks_later":[{"id":0}]}'))
    found = table(spark, sf_dir, "benchmark").select("item_id", loose.chunks_of(chunk).alias("c"))
    return found.select("item_id", F.size("c").alias("n"), F.get_json_object(F.col("c")[0], "$.id").alias("first"))


_ROUTES = "CASE event_type WHEN 'click' THEN 'message' WHEN 'view' THEN 'card' WHEN 'purchase' THEN 'ignored' WHEN 'error' THEN 'empty' ELSE 'challenge' END"


def _payloads(spark, sf_dir) -> DataFrame:
    rows, kind = table(spark, sf_dir, "events"), F.col("event_type")
    key = F.col("event_id").cast("string")
    content = obj(text=F.when(kind == "error", F.lit(" ")).otherwise(F.concat(F.lit(" ask "), key, F.lit(" "))))
    message = F.struct(F.when(kind != "error", key).alias("message_id"), F.lit("text").alias("message_type"), content.alias("content"))
    sender = F.struct(F.struct(F.lit("").alias("union_id"), F.col("user_id").cast("string").alias("open_id"), F.lit(" nick ").alias("nickname")).alias("sender_id"))
    action = F.when(kind == "view", F.struct(F.struct(F.lit("answer_feedback").alias("action"), key.alias("feedback_id")).alias("value")))
    event = F.struct(message.alias("message"), sender.alias("sender"), action.alias("action"))
    header = F.struct(F.when(kind == "purchase", "other").otherwise(webhook.MESSAGE).alias("event_type"), F.concat(F.lit("e"), key).alias("event_id"))
    known = kind.isin("click", "view", "purchase", "error")
    return rows.select(F.col("event_id").alias("id"), "user_id", "event_type", obj(header=header, event=event, challenge=F.when(~known, F.lit("c"))).alias("payload")).withColumnRenamed("event_type", "kind")


@query(
    f"""SELECT event_id AS id, {_ROUTES} AS route, CASE WHEN event_type = 'error' THEN 'event:e' || event_id ELSE 'message:' || event_id END AS key,
CASE WHEN event_type = 'error' THEN '' ELSE 'ask ' || event_id END AS question, CAST(user_id AS VARCHAR) AS sender, 'nick' AS sender_name, CASE WHEN event_type = 'view' THEN 'feedback' ELSE 'unsupported' END AS asked FROM events"""
)
def webhook_routes(spark, sf_dir):
    """Every event as a webhook payload: its route, key, text, sender and action."""
    out = webhook.routed(_payloads(spark, sf_dir))
    return out.select("id", "route", "key", "question", "sender", "sender_name", webhook.action_kind(F.col("action")).alias("asked"))


@query("SELECT event_id, event_type = 'click' AS transient FROM events")
def transient_answers(spark, sf_dir):
    text = F.when(F.col("event_type") == "click", F.lit("🔍 正在检索知识库...")).otherwise(F.concat(F.lit("正在检索知识库"), F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", webhook.is_transient(text).alias("transient"))


@query(f"SELECT item_id, CASE WHEN item_id % 3 = 0 THEN {quote(webhook.ASKING_GREETING)} WHEN item_id % 3 = 1 THEN {quote(webhook.GREETING)} ELSE {quote(webhook.LONG_GREETING)} END AS greeting FROM benchmark")
def greetings(spark, sf_dir):
    key = F.col("item_id")
    asked = F.when(key % 3 == 0, F.lit("如何  申请")).when(key % 3 == 1, F.lit("申请年假")).otherwise(F.rpad(F.lit("长"), 90, "文"))
    return table(spark, sf_dir, "benchmark").select("item_id", webhook.greeting(asked).alias("greeting"))


@query(
    """WITH a AS (SELECT user_id AS cancel_id, epoch(ts) AS started, epoch(ts) + value AS answered FROM events WHERE event_type = 'view' AND value IS NOT NULL),
c AS (SELECT user_id AS cancel_id, epoch(ts) AS at FROM events WHERE event_type = 'click')
SELECT cancel_id, started, answered, EXISTS (SELECT 1 FROM c WHERE c.cancel_id = a.cancel_id AND c.at >= a.started AND c.at < a.answered AND c.at - a.started <= 7200) AS suppressed FROM a"""
)
def delivered_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    answers = rows.where("event_type = 'view' and value is not null").select(F.col("user_id").alias("cancel_id"), F.col("at").alias("started"), (F.col("at") + F.col("value")).alias("answered"))
    return webhook.delivered(answers, rows.where("event_type = 'click'").select(F.col("user_id").alias("cancel_id"), "at")).select("cancel_id", "started", "answered", "suppressed")


@query(
    """WITH s AS (SELECT user_id AS feedback_id, max(epoch(ts)) AS created FROM events WHERE event_type = 'view' GROUP BY 1),
c AS (SELECT s.feedback_id, epoch(e.ts) AS clicked, CAST(event_id AS VARCHAR) AS choice FROM events e JOIN s ON s.feedback_id = e.user_id WHERE event_type = 'click' AND epoch(e.ts) >= created AND epoch(e.ts) - created <= 1800)
SELECT feedback_id, created, arg_min(choice, (clicked, choice)) AS selected FROM s LEFT JOIN c USING (feedback_id) GROUP BY 1, 2"""
)
def feedback_selections(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    states = rows.where("event_type = 'view'").select(F.col("user_id").alias("feedback_id"), F.col("at").alias("created"))
    return webhook.selections(states, rows.where("event_type = 'click'").select(F.col("user_id").alias("feedback_id"), "at", F.col("event_id").cast("string").alias("choice")))


@query("SELECT event_id, CAST(least(3, floor(value / 1.5)) AS INTEGER) AS text, CAST(greatest(0, floor(value / 60)) AS INTEGER) AS minutes FROM events WHERE value IS NOT NULL")
def status_timers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value is not null")
    zero = F.lit(0.0)
    return rows.select("event_id", webhook.rotation(zero, F.col("value"), 4).alias("text"), F.size(webhook.comfort_minutes(zero, F.col("value"))).alias("minutes"))


# ---------------------------------------------------------------- workflows
_STAGE_OF = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END"


def _executions(spark, sf_dir) -> DataFrame:
    """An execution for each event: two nodes by name, the second of which ran twice; the node's id tells the stage."""
    key, at = F.col("event_id").cast("string"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    nodes = F.array(F.struct(F.lit("n0").alias("id"), F.lit("start").alias("name")), F.struct(F.concat(F.lit("s-"), F.col("event_type")).alias("id"), F.lit("work").alias("name")))
    run = lambda t, ms: F.struct(t.alias("startTime"), F.lit(ms).alias("executionTime"))
    data = F.struct(F.struct(F.struct(F.array(run(F.lit("1970-01-01T00:00:10Z"), 7), run(F.lit("1970-01-01T00:00:05Z"), 8)).alias("work"), F.array(run(F.lit("1970-01-01T00:00:01"), 5)).alias("start")).alias("runData"), F.lit("work").alias("lastNodeExecuted")).alias("resultData"))
    detail = obj(status=F.lit("success"), startedAt=at, stoppedAt=at, workflowData=F.struct(nodes.alias("nodes")), data=data)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), detail.alias("detail"), key.alias("key"))


@query("SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'retrieving' WHEN 'click' THEN 'reranking' WHEN 'purchase' THEN 'generating' ELSE 'understanding' END AS stage FROM events")
def node_stages(spark, sf_dir):
    pairs = [("n0", "understanding"), ("s-view", "retrieving"), ("s-click", "reranking"), ("s-purchase", "generating")]
    stages = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("node_id"), F.lit(b).alias("stage")) for a, b in pairs])).alias("p")).select("p.*")
    return workflow.reached(_executions(spark, sf_dir), stages)


@query("SELECT event_id AS id, unnest([1, 2]) AS at, unnest(['start', 'work']) AS name, unnest([1.0, 5.0])::DOUBLE AS started, unnest(['n0', 's-' || event_type]) AS node_id FROM events")
def executed_nodes(spark, sf_dir):
    return workflow.executed(_executions(spark, sf_dir)).select("id", "at", "name", "started", "node_id")


@query("SELECT event_id AS id, 'success' AS status, 0.0::DOUBLE AS duration_s, 'work' AS last_node, CAST(2 AS INTEGER) AS n_nodes, 'work' AS first_node, CAST(7 AS BIGINT) AS first_ms FROM events")
def execution_summaries(spark, sf_dir):
    out = workflow.summaries(_executions(spark, sf_dir))
    return out.select("id", "status", "duration_s", "last_node", F.size("nodes").alias("n_nodes"), F.col("nodes")[0]["name"].alias("first_node"), F.col("nodes")[0]["executionTime_ms"].alias("first_ms"))


@query(
    f"""WITH p AS (SELECT event_id, user_id, epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id) AS elapsed, {_STAGE_OF} AS seen FROM events),
m AS (SELECT *, greatest(seen, CASE WHEN elapsed >= 10 THEN 3 WHEN elapsed >= 5 THEN 2 WHEN elapsed >= 1.5 THEN 1 ELSE 0 END) AS now FROM p)
SELECT event_id, ['understanding', 'retrieving', 'reranking', 'generating'][CAST(max(now) OVER (PARTITION BY user_id ORDER BY elapsed RANGE UNBOUNDED PRECEDING) + 1 AS INTEGER)] AS shown FROM m"""
)
def progress_shown(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    kind = F.col("event_type")
    stage = F.when(kind == "view", "retrieving").when(kind == "click", "reranking").when(kind == "purchase", "generating")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (at - F.min(at).over(Window.partitionBy("user_id"))).alias("elapsed"), stage.alias("stage"))
    return workflow.progress(rows, ["user_id"], "elapsed", "stage").select("event_id", "shown")


@query("SELECT event_id AS id FROM events WHERE epoch(ts) >= (SELECT max(epoch(ts)) FROM events) - 86400")
def recent_executions(spark, sf_dir):
    """Listed executions of the last day, each listed twice."""
    rows = table(spark, sf_dir, "events")
    last = rows.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("last"))
    listed = rows.select(F.col("event_id").alias("id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("started_at"))
    return workflow.recent(listed.unionByName(listed).join(F.broadcast(last)), F.col("last"), 86400.0).select("id")


# ---------------------------------------------------------------- names
@query("SELECT doc_id, 'a_b' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.docx' WHEN 1 THEN '.xlsx' ELSE '' END AS name, doc_id % 3 <> 2 AS is_document, 'wiki' AS kind, 'T' || doc_id AS token, 'https://h.x/wiki/N' || doc_id AS view FROM documents")
def node_names(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    kind = F.when(F.col("doc_id") % 3 == 0, "docx").when(F.col("doc_id") % 3 == 1, "bitable").otherwise("folder")
    title = F.concat(F.lit(" a/:b "), key, F.when(F.col("doc_id") % 3 == 1, F.lit(".xlsx")).otherwise(F.lit(" .")))
    link = names.document_link(F.concat(F.lit("https://h.x/space/wiki/T"), key, F.lit("?a=docx/1")))
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", names.node_file_name(title, kind).alias("name"), names.is_document_node(kind).alias("is_document"), link["kind"].alias("kind"), link["token"].alias("token"), names.view_url(F.lit(" "), F.lit("https://h.x/wiki/root"), F.concat(F.lit("N"), key)).alias("view"))


@query(
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'clear_theme_pptx' WHEN 1 THEN 'common_structure_xlsx' ELSE 'common_structure_docx' END AS prefix, 'structured_docx' AS named,
CASE doc_id % 3 WHEN 2 THEN 'application/pdf' WHEN 0 THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation' ELSE 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' END AS kind,
'http://s/raw/a%20b/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.PPTX' WHEN 1 THEN '.xlsx' ELSE '.pdf' END AS url FROM documents"""
)
def object_keys(spark, sf_dir):
    name = F.concat(F.lit("a b/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".PPTX").when(F.col("doc_id") % 3 == 1, ".xlsx").otherwise(".pdf"))
    return table(spark, sf_dir, "documents").select("doc_id", names.object_prefix(name).alias("prefix"), names.object_prefix(name, F.lit(" 结构化word文档")).alias("named"), names.content_type(name).alias("kind"), names.object_url("http://s/", F.lit("raw"), name).alias("url"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'http://h/api' ELSE rtrim(url, '/') END || '/retrieval/flow' AS url FROM pages")
def retrieval_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.retrieval_url(F.when(F.col("page_id") % 2 == 0, F.lit("http://h/api/query/")).otherwise(F.col("url"))).alias("url"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE (p_size & 16) <> 0 END AS bold FROM part")
def bold_fonts(spark, sf_dir):
    font = F.when(F.col("p_partkey") % 4 == 0, "Arial Semi-Bold Roman").when(F.col("p_partkey") % 4 == 1, "Times_Roman").otherwise(F.lit("Serif"))
    return table(spark, sf_dir, "part").select("p_partkey", names.is_bold(font, F.col("p_size")).alias("bold"))


@query("SELECT page_id, page_id % 2 = 0 AS video, CASE WHEN page_id % 3 = 0 THEN 'already satisfied' WHEN page_id % 3 = 1 THEN 'a shot' ELSE url || '。' END AS described FROM pages")
def described_images(spark, sf_dir):
    path = F.when(F.col("page_id") % 2 == 0, "a/b.GIF").otherwise(F.lit("gif/b.png"))
    said = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), F.col("url"))).when(F.col("page_id") % 3 == 1, F.lit(" a shot "))
    return table(spark, sf_dir, "pages").select("page_id", names.is_video_like(path).alias("video"), enrich.described(said, F.concat(F.col("url"), F.lit("。"))).alias("described"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4
WHEN 0 THEN '1. 列1: ' || p_name || '；k: ' || p_size || chr(10) || '3. k: ' || p_type || chr(10) || 'after'
WHEN 1 THEN '| ' || p_name || ' |' || chr(10) || p_brand || '；size'
WHEN 2 THEN '**' || p_name || '**' || chr(10) || CASE WHEN p_size % 2 = 1 THEN '---' || chr(10) ELSE '' END || '▌ ' || p_type || chr(10) || '  · ' || p_brand || chr(10) || '────────' || chr(10) || '```' || chr(10) || '# ' || p_brand || chr(10) || '```'
ELSE p_name || chr(10) || '| a |' END AS card FROM part"""
)
def card_texts(spark, sf_dir):
    """Tables with and without values, headings of two depths, quotes, lists, rules, code and plain rows, all from the parts' own texts."""
    kind, lines = F.col("p_partkey") % 4, lambda *x: F.concat_ws("\n", *[F.concat(*[F.lit(y[1:]) if y[0] == "'" else F.col(y) for y in line]) for line in x])
    text = (
        F.when(kind == 0, F.regexp_replace(lines(["'|  | k |"], ["'|---|:---:|"], ["'| ", "p_name", "' | ", "p_size", "' |"], ["'|  | |"], ["'| | ", "p_type", "' |"], ["'after"]), "\n", "\r\n"))
        .when(kind == 1, lines(["'| ", "p_name", "' |"], ["'| ", "p_brand", "' | size |"], ["'| --- | --- |"], ["'| | |"]))
        .when(kind == 2, lines(["'", "hashes", "' ", "p_name"], ["'> ", "p_type"], ["'  * ", "p_brand"], ["'* * *"], ["'```"], ["'# ", "p_brand"], ["'```"], ["'"]))
        .otherwise(lines(["p_name"], ["'| a |"], ["'"]))
    )
    rows = table(spark, sf_dir, "part").withColumn("hashes", F.when(F.col("p_size") % 2 == 1, "#").otherwise("##")).select("p_partkey", text.alias("text"))
    return markdown.with_cards(rows, "text").select("p_partkey", "card")


@query(
    """WITH o AS (SELECT conv_id, turn, turn % 3 AS kind, 'f' || (conv_id * 3 + turn * turn) % 4 || '.docx' AS name FROM conversations),
refs AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, name) AS first FROM o WHERE kind <> 1),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY first) AS n FROM refs)
SELECT o.conv_id, string_agg('l' || o.turn || CASE WHEN o.kind = 1 THEN ' [see](' || o.name || ')' ELSE ' [[' || n.n || ']](' || o.name || ')' END, chr(10) ORDER BY o.turn) AS text,
       coalesce((SELECT list(name ORDER BY n) FROM (SELECT DISTINCT r.name, r.n FROM numbered r WHERE r.conv_id = o.conv_id)), []) AS refs
FROM o LEFT JOIN numbered n ON n.conv_id = o.conv_id AND n.turn = o.turn GROUP BY o.conv_id"""
)
def numbered_answers(spark, sf_dir):
    """Conversations as answers, a line for each turn: a file as a tag, as a plain link or as links to two of its passages; a section of sources at the end."""
    name = F.concat(F.lit("f"), ((F.col("conv_id") * 3 + F.col("turn") * F.col("turn")) % 4).cast("string"), F.lit(".docx"))
    kind = F.col("turn") % 3
    mark = F.when(kind == 0, F.concat(F.lit("<reference> "), name, F.lit("</reference><reference> </reference>"))).when(kind == 1, F.concat(F.lit("[see]("), name, F.lit(")"))).otherwise(F.concat(F.lit("[片段 2：name]("), name, F.lit(") [片段3:b]("), name, F.lit(' "t")')))
    line = F.struct("turn", F.concat(F.lit("l"), F.col("turn").cast("string"), F.lit(" "), mark).alias("line"))
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n"), F.lit("\n\n---\n\n**知识来源**：\n- x"))
    answers = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(text.alias("answer"))
    return references.with_references(answers, "answer").select("conv_id", "text", "refs")


_HREF = "regexp_extract_all(coalesce(html, ''), 'https?://[^\\s\"<>]+')"


@query(f"SELECT page_id, list_distinct(list_transform({_HREF}, lambda u: regexp_replace(trim(u), '[.,;:!?，。；：！？、）)\\]}}\"'']+$', ''))) AS links FROM pages".replace("list_distinct(list_transform", "list_sort(list_distinct(list_transform").replace("'[.,;:!?，。；：！？、）)\\]}\"'']+$', ''))) AS", "'[.,;:!?，。；：！？、）)\\]}\"'']+$', '')))) AS"))
def harvested_links(spark, sf_dir):
    """All addresses anywhere in a page's JSON, cleaned, each once."""
    text = F.get_json_object(obj(deep=F.struct(F.col("html").alias("h"))), "$.deep.h")
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r'https?://[^\s"<>]+'), F.lit(0)), names.clean_url)
    return table(spark, sf_dir, "pages").select("page_id", F.sort_array(F.array_distinct(found)).alias("links"))


# ---------------------------------------------------------------- layout
@query(
    """SELECT page_id AS doc_id, unnest([0, 1, 2, 3, 4, 5]) AS item_index, unnest(['paragraph', 'paragraph', 'link_ref', 'link_ref', 'image', 'paragraph']) AS type,
unnest(['site', '见 官网：{{官网网站链接}} {{' || host || ' 链接}}', '官网网站链接', host || ' 链接', 'shot', 'end']) AS text, unnest([NULL, NULL, url, url, NULL, NULL]) AS url
FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host FROM pages)""".replace("'见 官网：{{官网网站链接}}", "'官网：{{官网网站链接}}")
)
def link_items(spark, sf_dir):
    """Texts with addresses: the first is named by its label, the second by its host."""
    row = lambda kind, text: F.struct(F.lit(kind).alias("type"), F.lit("正文").alias("style"), text.alias("text"))
    rows = F.array(row("paragraph", F.lit("site")), row("paragraph", F.concat(F.lit("官网："), F.col("url"), F.lit(" "), F.col("url"))), row("image", F.lit("shot")), row("paragraph", F.lit("end ")))
    got = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(rows).alias("item_index", "i")).select("doc_id", "item_index", "i.*")
    return enrich.enriched_links(got).select("doc_id", F.col("item_index").cast("int").alias("item_index"), "type", "text", "url")


@query(
    """SELECT page_id AS doc_id, unnest([3, 4, 11]) AS item_index, CAST(unnest([1, 1, 2]) AS BIGINT) AS "group", unnest([1, 2, 1]) AS position, CAST(unnest([2, 2, 1]) AS BIGINT) AS size, 'T' AS document_title,
unnest(['h1', 'h1', 'h2 -> h3 -> h4 -> h5']) AS heading_path, unnest(['b' || page_id, 'b' || page_id, '[{"t":1}]']) AS nearest_body FROM pages"""
)
def image_contexts(spark, sf_dir):
    row = lambda kind, style, text: F.struct(F.lit(kind).alias("type"), F.lit(style).alias("style"), text.alias("text"))
    key = F.concat(F.lit(" b"), F.col("page_id").cast("string"))
    rows = F.array(row("paragraph", "标题", F.lit("T")), row("paragraph", "标题 1", F.lit("h1")), row("paragraph", "正文", key), row("image", "正文", F.lit("i")), row("image", "正文", F.lit("j")), row("table", "row", F.lit('[{"t":1}]')), *[row("paragraph", "heading 2", F.lit(f"h{k}")) for k in range(2, 6)], row("paragraph", "正文", F.lit(" ")), row("image", "正文", F.lit("k")))
    got = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(rows).alias("item_index", "i")).select("doc_id", "item_index", "i.*")
    return enrich.image_contexts(got)


@query(
    """WITH s AS (SELECT p_brand, p_partkey, p_partkey % 5 = 0 AS t, sum(CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS section FROM part)
SELECT p_partkey, CAST(section AS BIGINT) AS section, CASE WHEN t THEN NULL ELSE '第' || CAST(sum(CASE WHEN t THEN 0 ELSE 1 END) OVER (PARTITION BY p_brand, section ORDER BY p_partkey) AS BIGINT) || '页' END AS heading FROM s"""
)
def slide_pages(spark, sf_dir):
    return enrich.slide_pages(table(spark, sf_dir, "part"), "p_brand", "p_partkey", F.col("p_partkey") % 5 == 0).select("p_partkey", "section", "heading")


_ALIKE = "least(w * h, pw * ph) / greatest(w * h, pw * ph) >= 0.55 AND least(w / h, pw / ph) / greatest(w / h, pw / ph) >= 0.65"


@query(
    f"""WITH i AS (SELECT p_brand, p_partkey, CAST(p_size AS DOUBLE) AS w, CAST(1 + p_partkey % 20 AS DOUBLE) AS h, lag(CAST(p_size AS DOUBLE)) OVER o AS pw, lag(CAST(1 + p_partkey % 20 AS DOUBLE)) OVER o AS ph FROM part WINDOW o AS (PARTITION BY p_brand ORDER BY p_partkey)),
r AS (SELECT *, sum(CASE WHEN coalesce({_ALIKE}, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS run FROM i),
c AS (SELECT *, CAST((row_number() OVER (PARTITION BY p_brand, run ORDER BY p_partkey) - 1) % 2 AS INTEGER) AS col FROM r)
SELECT p_partkey, col AS "column", CAST(sum(CASE WHEN col = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS BIGINT) AS "row" FROM c"""
)
def image_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").alias("width"), (1 + F.col("p_partkey") % 20).alias("height"))
    return enrich.image_rows(rows, "p_brand", "p_partkey").select("p_partkey", "column", "row")


@query(
    """SELECT p_brand, greatest(24.0, least(list_sort(list(p_size))[CAST(floor(CAST(0.75 AS DOUBLE) * (count(*) - 1)) AS INTEGER) + 1], median(p_size) + 4))::DOUBLE AS cutoff FROM part WHERE p_size > 0 GROUP BY 1"""
)
def title_cutoffs(spark, sf_dir):
    return layout.title_cutoff(table(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("double").alias("size")), "p_brand", "size")


def _pdf_lines(spark, sf_dir) -> DataFrame:
    """Pages of lines from documents: a page for each document of a source, its lines below one another; the first line is large and centred, every seventh numbered."""
    rows = items.lines(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    first, seventh = F.col("item_index") == 0, F.col("item_index") % 7 == 3
    text = F.when(seventh, F.concat(F.lit("1. "), F.substring("line", 1, 20))).when(first, F.substring("line", 1, 25)).otherwise(F.concat(F.lit("body "), "line"))
    top = (20.0 * F.col("item_index")).cast("double")
    left = F.when(first, 250.0).otherwise(50.0)
    return rows.select(
        F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), F.col("item_index").alias("line_order"), text.alias("text"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"),
        left.alias("x0"), top.alias("y0"), F.when(first, 350.0).when(seventh, 200.0).otherwise(400.0).alias("x1"), (top + 12).alias("y1"), F.when(first, 20.0).otherwise(10.0).alias("font_size"), (first & (F.col("doc_id") % 2 == 0)).alias("bold"),
    )


@query()
def pdf_headings(spark, sf_dir):
    return layout.headings(_pdf_lines(spark, sf_dir)).select("doc_id", "page_number", "line_order", "align", "level", "style")


@query(
    f"""SELECT source AS doc_id, doc_id AS page_number, item_index AS line_order, CASE WHEN item_index = 0 THEN 'center' ELSE 'left' END AS align, item_index % 7 = 3 OR item_index = 0 AS candidate
FROM ({_LINES}) l JOIN documents USING (doc_id) WHERE trim(line, ' ') <> ''"""
)
def heading_candidates(spark, sf_dir):
    rows = layout.with_alignment(_pdf_lines(spark, sf_dir))
    return rows.select("doc_id", "page_number", "line_order", "align", layout.is_heading_candidate().alias("candidate"))


@query("SELECT l_orderkey AS doc_id, CAST(1 AS INTEGER) AS page_number, l_orderkey AS line_order, string_agg(CAST(l_partkey AS VARCHAR), '' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS text, min(l_quantity) AS x0, max(l_extendedprice) AS x1, max(l_tax) AS font_size, bool_or(l_returnflag = 'R') AS bold FROM lineitem GROUP BY 1")
def lines_of_spans(spark, sf_dir):
    """The parts of an order as spans of one line."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), F.col("l_orderkey").alias("line_order"), F.col("l_linenumber").alias("span_order"), F.col("l_partkey").cast("string").alias("text"), F.col("l_quantity").alias("x0"), F.lit(0.0).alias("y0"), F.col("l_extendedprice").alias("x1"), F.lit(1.0).alias("y1"), F.col("l_tax").alias("font_size"), (F.col("l_returnflag") == "R").alias("bold"), F.lit(1.0).alias("page_width"), F.lit(1.0).alias("page_height"))
    return layout.lines_of_spans(rows).select("doc_id", "page_number", "line_order", "text", "x0", "x1", "font_size", "bold")


# ---------------------------------------------------------------- search over Han text
HAN_NOTE = "如何申请年假和病假流程"


@query("SELECT doc_id, 11 + len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) - 1 AS n_words, TRUE AS found FROM documents")
def han_words(spark, sf_dir):
    """Words of texts with a Han run between: its ten pairs, which find a two-character word wherever it stands."""
    words = T.words(F.concat(F.coalesce("text", F.lit("")), F.lit(" " + HAN_NOTE)))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_words"), F.array_contains(words, F.lit("病假")).alias("found"))


# ---------------------------------------------------------------- sources and sinks
@query("SELECT doc_id, CAST(doc_id AS VARCHAR) AS file_id, text AS content, lang AS path FROM documents")
def chunk_files(spark, sf_dir):
    """Chunks written as files and read back."""
    at = scratch(spark)
    meta_of = F.struct(F.col("doc_id").cast("string").alias("file_id"), F.col("lang").alias("path"), F.lit("text").alias("chunk_type"))
    rows = table(spark, sf_dir, "documents").select(F.col("text").alias("content"), meta_of.alias("metadata"), F.col("doc_id").cast("int").alias("chunk_index"), F.col("doc_id").cast("string").alias("file_id"))
    files.write_chunks(rows, at)
    return spark.read.schema(files.CHUNK).json(at).select(F.col("chunk_index").cast("long").alias("doc_id"), "file_id", "content", "metadata.path")


@query("SELECT vec_id, len(embedding) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first, CAST(1 AS INTEGER) AS n_sparse FROM embeddings")
def embedding_files(spark, sf_dir):
    """Vectors written as embedding records and read back; weights of 0 are dropped."""
    at = scratch(spark)
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("content"), F.col("vec_id").alias("chunk_index"), F.lit("f").alias("file_id"), F.col("embedding").alias("vector"), F.create_map(F.lit(7), F.lit(0.5).cast("float"), F.lit(8), F.lit(0.0).cast("float")).alias("sparse"))
    files.write_embeddings(rows, at)
    got = files.read_embeddings(spark, at, multi_line=False)
    return got.select(F.col("chunk_index").alias("vec_id"), F.size("vector").cast("long").alias("n"), F.round(F.col("vector")[0].cast("double"), 6).alias("first"), F.size("sparse").alias("n_sparse"))


@query("SELECT 'w' || doc_id AS word, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'nz' END AS pos FROM documents")
def vocabulary_files(spark, sf_dir):
    at = scratch(spark)
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("word"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("pos"))
    files.write_vocabulary(rows, at)
    return files.read_vocabulary(spark, at).select("word", "pos")


@query("SELECT item_id, text AS question FROM benchmark")
def question_files(spark, sf_dir):
    at = scratch(spark)
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.lit("a").alias("reference_answer"))
    files.write_questions(rows.unionByName(rows.withColumn("question", F.lit(" "))), at)
    return files.read_questions(spark, at, multi_line=False).select(F.col("id").cast("long").alias("item_id"), "question")


@query("WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS term FROM documents) SELECT term, count(*) AS df FROM w GROUP BY 1")
def model_files(spark, sf_dir):
    """The lexical model saved and loaded."""
    at = scratch(spark)
    index = retrieval.Index(table(spark, sf_dir, "documents"), "doc_id", "text")
    files.save_model(index.terms, index.stats, at)
    return files.load_model(spark, at)[0].select("term", "df")


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY item_index) - 1 AS INTEGER) AS item_index, 'paragraph' AS type, '正文' AS style, line AS text FROM ({_LINES}) WHERE trim(line, ' ') <> ''")
def item_files(spark, sf_dir):
    """Items written as texts, a file a partition, and read back."""
    at = scratch(spark)
    made = items.items_to_text(items.items_from_text(table(spark, sf_dir, "documents")))
    made.write.parquet(at)
    return items.items_from_text(spark.read.parquet(at))


@query("SELECT source AS file_name, arg_min('u' || doc_id, doc_id) AS url FROM documents GROUP BY 1")
def map_files(spark, sf_dir):
    """A map and its conflicts written twice; conflicts stay once."""
    at = scratch(spark)
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("file_name"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), "doc_id")
    first, bad = meta.first_wins(rows, "file_name", "url", ["doc_id"]), meta.conflicts(rows, "file_name", "url", ["doc_id"])
    for _ in range(2):
        files.write_map(first, bad, at)
    if files.read_conflicts(spark, at).count() != bad.count():
        raise ValueError("conflicts were written twice")
    return spark.read.schema("file_name string, url string").json(f"{at}/map")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def report_files(spark, sf_dir):
    at = scratch(spark)
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    files.write_report(rows, at, summary=rows.agg(F.sum("n").alias("n")))
    return files.read_report(spark, at, "results", "event_type string, n long")


@query("SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'wrong dimension' WHEN vec_id % 4 = 1 THEN 'empty sparse vector' WHEN vec_id % 4 = 2 THEN 'no file id' END AS reason FROM embeddings")
def valid_records(spark, sf_dir):
    """Records for the store: accepted, or rejected with a reason."""
    k = F.col("vec_id") % 4
    rows = table(spark, sf_dir, "embeddings").select(
        F.lit(None).cast("string").alias("id"), F.when(k == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("vector"), F.create_map(F.lit(1), F.when(k == 1, -1.0).otherwise(0.5)).alias("sparse"),
        F.when(k == 2, " ").otherwise("f").alias("file_id"), F.col("vec_id").alias("chunk_index"),
    )
    good, bad = store.valid_rows(rows, 64)
    return good.select(F.col("chunk_index").alias("vec_id"), F.lit(None).cast("string").alias("reason")).unionByName(bad.select(F.col("chunk_index").alias("vec_id"), "reason"))


@query("SELECT doc_id, sum(w) AS tokens FROM (SELECT DISTINCT doc_id, 1 AS w FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) GROUP BY 1")
def filtered_out(spark, sf_dir):
    """What is listed and not chosen: a difference by key."""
    rows = table(spark, sf_dir, "labels")
    return rows.select("doc_id").distinct().join(rows.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(F.sum(F.lit(1)).alias("tokens"))


def _office(spark, sf_dir, kind: str) -> DataFrame:
    """path and content of an office document for each page."""
    from pyspark.sql.types import BinaryType

    make = F.pandas_udf(lambda x: x.map(lambda key: _bytes(kind, key)), BinaryType())
    key = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("in/"), key, F.lit("." + kind)).alias("path"), make(key).alias("content"))


def _bytes(kind: str, key: str) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    w, r = 'xmlns:w="w" xmlns:r="r"', "<Relationships>{}</Relationships>"
    parts = {
        "docx": {
            "word/styles.xml": f'<w:styles {w}><w:style w:styleId="h"><w:name w:val="heading 1"/></w:style></w:styles>',
            "word/_rels/document.xml.rels": r.format('<Relationship Id="l" Target="http://l/{}"/>'.format(key)),
            "word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="h"/></w:pPr><w:r><w:t>Title {key}</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r><w:hyperlink r:id="l"><w:r><w:t> link</w:t></w:r></w:hyperlink></w:p>'
            f'<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>{key}</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>',
        },
        "xlsx": {
            "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="s"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": r.format('<Relationship Id="s" Target="worksheets/sheet1.xml"/>'),
            "xl/worksheets/sheet1.xml": f'<worksheet><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>k</t></is></c><c r="B1" t="inlineStr"><is><t>v</t></is></c><c r="C1" t="inlineStr"><is><t>v</t></is></c></row><row r="2"><c r="A2"><v>{key}</v></c><c r="C2" t="inlineStr"><is><t>z</t></is></c></row></sheetData></worksheet>',
        },
        "pptx": {
            f"ppt/slides/slide{n}.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><p:sp><a:off x="5" y="300000"/><a:p><a:r><a:t>low {key}</a:t></a:r></a:p></p:sp><p:sp><a:off x="9" y="0"/><a:p><a:r><a:t>right</a:t></a:r></a:p></p:sp><p:sp><a:off x="1" y="10"/><a:p><a:r><a:t>left</a:t></a:r></a:p></p:sp></p:sld>'
            for n in (1, 2)
        },
    }[kind]
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


@query(
    """SELECT 'in/' || page_id || '.docx' AS path, unnest([0, 1, 2, 3]) AS item_index, unnest(['paragraph', 'paragraph', 'link', 'table']) AS type, unnest(['heading 1', '正文', '正文', 'table']) AS style,
unnest(['Title ' || page_id, 'Body link', 'link', '[{"a":"' || page_id || '","b":"x","b_2":"x"}]']) AS text, unnest([NULL, NULL, 'http://l/' || page_id, NULL]) AS url FROM pages"""
)
def docx_items(spark, sf_dir):
    return office.items(_office(spark, sf_dir, "docx")).select("path", F.col("item_index").cast("int").alias("item_index"), "type", "style", "text", "url")


@query(
    """SELECT 'in/' || page_id || '.xlsx' AS path, unnest([0, 1, 2]) AS item_index, unnest(['paragraph', 'paragraph', 'table']) AS type, unnest(['标题', '标题 2', 'row:2']) AS style, unnest([CAST(page_id AS VARCHAR), 'S', '[{"k":"' || page_id || '","v_2":"z"}]']) AS text FROM pages"""
)
def xlsx_items(spark, sf_dir):
    return office.items(_office(spark, sf_dir, "xlsx")).select("path", F.col("item_index").cast("int").alias("item_index"), "type", "style", "text")


@query("SELECT 'in/' || page_id || '.pptx' AS path, unnest([0, 1, 2, 3]) AS item_index, unnest(['第1页', 'left', 'right', 'low ' || page_id]) AS text FROM pages")
def pptx_items(spark, sf_dir):
    return office.items(_office(spark, sf_dir, "pptx")).select("path", F.col("item_index").cast("int").alias("item_index"), "text")


@query("SELECT 'data\\raw\\' || page_id || '%20x.docx' AS request, '/srv/data/raw/' || page_id || ' x.docx' AS path FROM pages UNION ALL SELECT page_id || ' X.DOCX', '/srv/data/raw/' || page_id || ' x.docx' FROM pages")
def resolved_paths(spark, sf_dir):
    """Requests by path below the raw folder, and by file name in another case; climbing paths resolve to nothing."""
    key = F.col("page_id").cast("string")
    pages = table(spark, sf_dir, "pages")
    have = pages.select(F.concat(F.lit("/srv/data/raw/"), key, F.lit(" x.docx")).alias("path"))
    asked = [F.concat(F.lit("data\\raw\\"), key, F.lit("%20x.docx")), F.concat(key, F.lit(" X.DOCX")), F.concat(F.lit("../"), key, F.lit(" x.docx"))]
    return files.resolved(pages.select(F.explode(F.array(*asked)).alias("request")), have)


@query("SELECT page_id AS doc_id, unnest([0, 5, 6]) AS item_index, unnest(['H', 'C', 'kept ' || page_id]) AS text FROM pages")
def pruned_items(spark, sf_dir):
    """Items without a section of references, a source line with its links, and headings with nothing below."""
    row = lambda style, text, kind="paragraph", url=None: F.struct(F.lit(kind).alias("type"), F.lit(style).alias("style"), text.alias("text"), (F.lit(url) if url else F.lit(None).cast("string")).alias("url"))
    key = F.col("page_id").cast("string")
    rows = F.array(
        row("标题 1", F.lit("H")), row("标题 2", F.lit("参考文献")), row("正文", F.lit("some book")), row("正文", F.lit("资料来源：see https://a.b")), row("链接", F.lit("x"), "link_ref", "https://a.b"),
        row("标题 2", F.lit("C")), row("正文", F.concat(F.lit("kept "), key)), row("标题 2", F.lit("empty")),
    )
    got = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(rows).alias("item_index", "i")).select("doc_id", "item_index", "i.*")
    out = layout.without_empty_sections(layout.without_source_links(layout.without_reference_sections(got)))
    return out.select("doc_id", "item_index", "text")


@query(
    """SELECT doc_id % 7 AS query_id, CAST(doc_id AS VARCHAR) AS chunk_id, CAST(doc_id AS INTEGER) AS chunk_index, lang AS chunk_type, '' AS file_name, 'l' AS link_name, 'http://' || source AS link_path, CAST(1 AS INTEGER) AS n_links, 'b.png' AS img_name FROM documents"""
)
def response_rows(spark, sf_dir):
    """Rows that go out: from metadata with more fields, a link without an address and an image without a name."""
    key = F.col("doc_id").cast("string")
    links = F.array(F.struct(F.lit("2").alias("index"), F.lit("l").alias("link_name"), F.concat(F.lit("http://"), "source").alias("link_path")), F.struct(F.lit("x").alias("index"), F.lit("m").alias("link_name"), F.lit(" ").alias("link_path")))
    images = F.array(F.struct(F.lit(None).cast("string").alias("img_name"), F.lit("a/b.png").alias("img_path")))
    meta_of = obj(chunk_type=F.col("lang"), secret=F.lit("x"), chunk_index=key, links=links, imgs=images)
    hits = table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("query_id"), key.alias("id"), F.lit("c").alias("content"), F.lit(None).cast("int").alias("chunk_index"), meta_of.alias("metadata"), F.lit(0.5).alias("rerank_score"))
    out = retrieval.response(hits)
    return out.select("query_id", "chunk_id", "chunk_index", "chunk_type", "file_name", F.col("links")[0]["link_name"].alias("link_name"), F.col("links")[0]["link_path"].alias("link_path"), F.size("links").alias("n_links"), F.col("imgs")[0]["img_name"].alias("img_name"))


@query(
    """WITH p AS (SELECT p_partkey, 'm' || CASE WHEN p_partkey % 5 = 0 THEN '-Qwen' ELSE '' END || p_partkey AS model, p_partkey % 3 <> 0 AS ok, p_size / 10.0::DOUBLE AS s, CAST(p_retailprice AS BIGINT) AS chars FROM part),
s AS (SELECT *, CASE WHEN ok THEN greatest(0.0::DOUBLE, 40.0::DOUBLE - 6.0::DOUBLE * s) + CASE WHEN chars <= 220 THEN 15.0::DOUBLE ELSE greatest(0.0::DOUBLE, 15.0::DOUBLE - (chars - 220) / 80.0::DOUBLE) END + 30.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM p)
SELECT model, round(score, 6) AS score FROM s WHERE ok AND model NOT LIKE '%Qwen%' ORDER BY score DESC, model LIMIT 3"""
)
def top_models(spark, sf_dir):
    """The three best of all probed models: the operator is a top three."""
    ok = F.col("p_partkey") % 3 != 0
    name = F.concat(F.lit("m"), F.when(F.col("p_partkey") % 5 == 0, "-Qwen").otherwise(""), F.col("p_partkey").cast("string"))
    rows = table(spark, sf_dir, "part").select(name.alias("model"), *[ok.alias(c) for c in ("simple_ok", "complex_ok", "json_ok", "thinking_ok", "brief_ok")], *[(F.col("p_size") / 10.0).alias(c) for c in ("simple_s", "complex_s")], *[F.round("p_retailprice").cast("long").alias(c) for c in ("simple_chars", "complex_chars")])
    return evaluation.top_models(evaluation.model_scores(rows), "score_simple").select("model", F.round("score_simple", 6).alias("score"))


@query("SELECT page_id, 'a_b.docx' AS first, 't' || page_id AS token, CAST(2 AS INTEGER) AS n FROM pages")
def embedded_files(spark, sf_dir):
    """Files that documents hold at any depth, each once."""
    held = lambda name, token: F.struct(F.struct(F.lit(name).alias("name"), token.alias("token")).alias("file"))
    key = F.concat(F.lit("t"), F.col("page_id").cast("string"))
    rows = table(spark, sf_dir, "pages").select("page_id", obj(blocks=F.array(F.struct(held(" a/ b.docx", key).alias("x")), F.struct(held("a:b.docx", key).alias("x"))), last=held("c.pdf", key)).alias("doc"))
    out = rows.select("page_id", loose.files_of("doc").alias("f"))
    return out.select("page_id", F.col("f")[0]["name"].alias("first"), F.col("f")[0]["token"].alias("token"), F.size("f").alias("n"))


@query("SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) = '' THEN '' ELSE trim(text) END AS question, '' AS answer, 'anonymous' AS user_id, CAST(conv_id AS VARCHAR) AS conversation_id FROM conversations")
def chat_records(spark, sf_dir):
    """Chat rows written encrypted, read back and decrypted."""
    at = scratch(spark)
    rows = table(spark, sf_dir, "conversations").select(F.lit(" ").alias("user_id"), F.concat_ws(":", "conv_id", "turn").alias("user_name"), F.col("conv_id").cast("string").alias("session_id"), F.lit(None).cast("string").alias("conversation_id"), F.col("text").alias("question"), F.lit(" ").alias("answer"))
    chat.insert(rows, at, "a secret")
    got = spark.read.parquet(at)
    return got.select(F.split("user_name", ":")[0].cast("long").alias("conv_id"), F.split("user_name", ":")[1].cast("long").alias("turn"), chat.decrypted(F.col("question"), "a secret").alias("question"), "answer", "user_id", "conversation_id")
