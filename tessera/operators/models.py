"""Operators that ask a model: chat, descriptions, vocabulary, judgments, questions, embeddings and reranking by a client of one's own.

A client is a factory, called once a task on the executor, whose result takes a list of messages and gives a text; an error of a call
is retried with growing pauses and then becomes a null with its reason, so one bad answer fails no job. Without a client, the fallbacks answer. How many calls run at a time is the number of partitions.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import loose
from tessera.functions.cleaning import stripped
from tessera.operators import enrich, evaluation

Client = Callable[[list[dict]], str]
MOST_WORKERS = 5


def retried(ask: Client, messages: list[dict], attempts: int = 3, pause_s: float = 2.0, sleep=time.sleep) -> tuple[str | None, str | None]:
    """The answer, or None and the last error; the n-th attempt waits n - 1 pauses before it."""
    error = None
    for n in range(attempts):
        if n:
            sleep(n * pause_s)
        try:
            return ask(messages), None
        except Exception as e:  # whatever a service raises
            error = f"{type(e).__name__}: {e}"
    return None, error


def chat(rows: DataFrame, key: str, messages: str, client: Callable[[], Client] | None, workers: int = 3, attempts: int = 3, pause_s: float = 2.0) -> DataFrame:
    """key, reply and error, a row for each row of rows; messages is a JSON list. Without a client every reply is null."""
    kind = dict(rows.dtypes)[key]
    if client is None:
        return rows.select(key, F.lit(None).cast("string").alias("reply"), F.lit("no client").alias("error"))

    def ask(frames):
        own = client()
        for frame in frames:
            got = [retried(own, json.loads(m), attempts, pause_s) for m in frame["messages"]]
            yield pd.DataFrame({"key": frame["key"], "reply": [r for r, _ in got], "error": [e for _, e in got]})

    # Keys pass Python as strings: pandas would turn a column with nulls into floats.
    asked = rows.select(F.col(key).cast("string").alias("key"), F.col(messages).alias("messages")).repartition(max(1, min(workers, MOST_WORKERS)))
    return asked.mapInPandas(ask, "key string, reply string, error string").select(F.col("key").cast(kind).alias(key), "reply", "error")


def prompt(system: str | None, user: Column) -> Column:
    """A list of messages as JSON."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    parts = [message("system", F.lit(system))] if system else []
    return F.to_json(F.array(*parts, message("user", user)))


def image_descriptions(items: DataFrame, client=None, workers: int = 3) -> DataFrame:
    """doc_id, item_index, image_type (screenshot, table or flowchart), description and table, a row for each image; the text above it where there is no answer."""
    rows = enrich.image_contexts(items).withColumn("_key", F.concat_ws(":", "doc_id", "item_index"))
    said = F.concat(F.lit("Describe the image as JSON with image_type, description and table_data. Title: "), "document_title", F.lit("\nHeadings: "), "heading_path", F.lit("\nText above: "), "nearest_body")
    replies = chat(rows.withColumn("_messages", prompt(None, said)), "_key", "_messages", client, workers)
    out = rows.join(replies, "_key", "left")
    value = loose.loose_json(F.col("reply"))
    at = lambda path: F.get_json_object(value, path)
    kind = F.coalesce(at("$.image_type"), at("$[0].image_type"))
    kind = F.when(kind.isin("table", "flowchart"), kind).otherwise("screenshot")
    text = F.coalesce(at("$.description"), at("$[0].description"), F.when(value.isNull(), stripped(F.col("reply"))))
    return out.select("doc_id", "item_index", kind.alias("image_type"), enrich.described(text, F.col("nearest_body")).alias("description"), F.when(kind == "table", F.coalesce(at("$.table_data"), at("$[0].table_data"))).alias("table"))


def link_descriptions(links: DataFrame, client=None) -> DataFrame:
    """link_id, url and description of links (link_id, url, context): the label before the colon, else the model's answer, else the host."""
    rows = links.withColumn("_label", enrich.labels("context"))
    said = F.concat(F.lit("Name this link in a few words. Context: "), F.coalesce("context", F.lit("")), F.lit("\nLink: "), "url")
    replies = chat(rows.where("_label is null").withColumn("_messages", prompt(None, said)), "link_id", "_messages", client)
    host = F.concat(F.regexp_replace(F.regexp_replace("url", r"(?i)^https?://", ""), "/.*$", ""), F.lit(" " + enrich.LINK))
    return rows.join(replies, "link_id", "left").select("link_id", "url", F.coalesce("_label", F.nullif(stripped(F.col("reply")), F.lit("")), host).alias("description"))


def vocabulary(texts: DataFrame, client) -> DataFrame:
    """word, pos and seq from replies to texts (text_id, text): a JSON list, or lines where the reply is none."""
    said = F.concat(F.lit("List domain terms as a JSON array of objects with word and pos.\n"), F.col("text"))
    replies = chat(texts.withColumn("_messages", prompt("You extract vocabulary.", said)), "text_id", "_messages", client)
    return replies.where("reply is not null").select(F.col("text_id").alias("seq"), F.explode(loose.parse_vocabulary("reply")).alias("w")).select("w.word", "w.pos", "seq")


def judgments(answers: DataFrame, client=None) -> DataFrame:
    """answers (item_id, question, reference, answer) with clamped scores, pass and reason. Without a reply: overlap with the reference, in fifths."""
    said = F.concat(F.lit("Score readability, correctness and completeness from 0 to 5 as JSON.\nQuestion: "), F.coalesce("question", F.lit("")), F.lit("\nReference: "), F.coalesce("reference", F.lit("")), F.lit("\nAnswer: "), F.coalesce("answer", F.lit("")))
    replies = chat(answers.withColumn("_messages", prompt("You judge answers.", said)), "item_id", "_messages", client)
    from tessera.functions import text as T

    value = loose.loose_json(F.col("reply"))
    near = F.round(5 * T.overlap_ratio(T.overlap_tokens(F.col("reference")), T.overlap_tokens(F.col("answer"))), 2).cast("string")
    blank = stripped(F.coalesce("answer", F.lit(""))) == ""
    scores = {k: F.coalesce(F.get_json_object(value, f"$.{k}"), F.when(blank, "0").otherwise(near if k != "readability" else F.lit("5"))) for k in evaluation.PASS}
    rows = answers.join(replies, "item_id", "left").withColumns(scores | {"pass": F.get_json_object(value, "$.pass"), "reason": F.get_json_object(value, "$.reason")})
    return evaluation.judged(rows.drop("reply", "error"))


def questions(documents: DataFrame, client) -> DataFrame:
    """Questions with answers made from documents (path, text): normalised, those without either are gone."""
    said = F.concat(F.lit("Write questions as a JSON array of objects with question and reference_answer.\n"), F.col("text"))
    replies = chat(documents.withColumn("_messages", prompt("You write test questions.", said)), "path", "_messages", client)
    made = F.from_json(loose.loose_json(F.col("reply")), "array<struct<question:string,reference_answer:string>>")
    return evaluation.qa_items(replies.select("path", F.posexplode(made).alias("index", "q")).select("path", "index", "q.*"))


def unit_vectors(rows: DataFrame, client: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 16, most_chars: int = 500) -> DataFrame:
    """id and vec of unit length from rows (id, text) by an embedding client, in batches; blank texts have none."""
    kind = dict(rows.dtypes)["id"]

    def embed(frames):
        own = client()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                got = own([t[:most_chars] for t in part["text"]])
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                yield pd.DataFrame({"id": part["id"], "vec": [[x / norm for x in v] if (norm := sum(x * x for x in v) ** 0.5) else None for v in got]})

    some = rows.select(F.col("id").cast("string").alias("id"), F.trim("text").alias("text")).where("text <> ''")
    return some.mapInPandas(embed, "id string, vec array<double>").where("vec is not null").select(F.col("id").cast(kind).alias("id"), "vec")


def rerank_scores(pairs: DataFrame, client: Callable[[], Callable[[str, list[str]], list[float]]], batch: int = 8) -> DataFrame:
    """query_id, id and rerank_score from pairs (query_id, id, query, content) by a client that scores a query's contents; blank ones are not scored."""
    kinds = dict(pairs.dtypes)

    def score(frames):
        own = client()
        for frame in frames:
            for _, group in frame.groupby("query_id", sort=False):
                for at in range(0, len(group), batch):
                    part = group.iloc[at : at + batch]
                    yield part[["query_id", "id"]].assign(rerank_score=[float(x) for x in own(part["query"].iloc[0], part["content"].tolist())])

    some = pairs.where((F.trim("query") != "") & (F.trim("content") != "")).select(F.col("query_id").cast("string").alias("query_id"), F.col("id").cast("string").alias("id"), "query", "content")
    out = some.repartition("query_id").mapInPandas(score, "query_id string, id string, rerank_score double")
    return out.select(F.col("query_id").cast(kinds["query_id"]).alias("query_id"), F.col("id").cast(kinds["id"]).alias("id"), "rerank_score")
