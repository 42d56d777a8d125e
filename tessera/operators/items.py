"""Items (parsed blocks of a document) and chunks: reading, cleaning, heading paths, segments and the chunker.

Item tables have doc_id, item_index, type, style and text, and optional url, path, description and table_name. Everything up to
segments is windows over a document's items; the merge of short chunks, a loop per document, runs by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Config
from tessera.functions import cleaning
from tessera.functions import text as T
from tessera.functions.split import looks_like_json, split

LINE = r"^\[([^\]]+)\]\s+\[([^\]]+)\]\s*(.*)$"
#: A text with its description in full-width parentheses.
DESCRIBED = r"(?s)^(.*?)（(.*)）$"
BODY = "正文"
ASSETS = ("image", "link", "link_ref")
TABLES = ("table", "image_table", "img_table")
LEVELS = range(0, 7)


def order(doc: str = "doc_id") -> Window:
    return Window.partitionBy(doc).orderBy("item_index")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_index and line of non-blank lines; indexes count all lines."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("item_index", "line"))
    return out.where(F.trim("line") != "")


def items_from_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", assets: bool = False) -> DataFrame:
    """Items from lines "[type] [style] text"; other lines are paragraphs of body text.

    assets: with description, path (of images) and url (of links), which end the line in full-width parentheses and are its text.
    """
    got = lines(docs, id_col, text_col)
    part = lambda k: F.regexp_extract("line", LINE, k)
    fits = F.col("line").rlike(LINE)
    out = got.select(
        "doc_id", "item_index", F.when(fits, part(1)).otherwise("paragraph").alias("type"), F.when(fits, part(2)).otherwise(BODY).alias("style"), F.when(fits, part(3)).otherwise(F.col("line")).alias("text")
    )
    if not assets:
        return out
    asset, said = F.col("type").isin(*ASSETS), F.col("type").isin(*ASSETS) & F.col("text").rlike(DESCRIBED)
    value = F.when(said, F.trim(F.regexp_extract("text", DESCRIBED, 1))).otherwise(F.col("text"))
    out = out.withColumn("description", F.when(said, F.nullif(F.trim(F.regexp_extract("text", DESCRIBED, 2)), F.lit("")))).withColumn("text", value)
    return out.withColumns({"path": F.when(F.col("type") == "image", F.col("text")), "url": F.when(asset & (F.col("type") != "image"), F.col("text"))})


def items_to_text(items: DataFrame) -> DataFrame:
    """doc_id and text: a line for each item, with a title line before a named table and descriptions in full-width parentheses."""
    one = F.concat(F.lit("["), "type", F.lit("] ["), "style", F.lit("] "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s*\n\s*", " "))
    if "description" in items.columns:
        one = F.concat(one, F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("（"), "description", F.lit("）"))).otherwise(""))
    if "table_name" in items.columns:
        one = F.concat(F.when(F.coalesce("table_name", F.lit("")) != "", F.concat(F.lit("[table] [表标题] "), "table_name", F.lit("\n"))).otherwise(""), one)
    rows = items.select("doc_id", "item_index", one.alias("line"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_index", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("doc_id").agg(joined.alias("text"))


def clean_items(items: DataFrame) -> DataFrame:
    """Cleaned items without sync notes and the sync link right after one, image-path lines and empty or placeholder texts (assets may be empty).

    Texts of tables are cleaned as JSON, those of images lightly, all others fully; of the further columns, paths and addresses lightly, descriptions and names fully.
    A link that is itself a sync note and follows one counts as its link and as a note.
    """
    kind, text = F.coalesce("type", F.lit("")), F.coalesce("text", F.lit(""))
    new = {"text": F.when(kind.isin(*TABLES), cleaning.clean_table(F.when(kind.isin(*TABLES), text))).when(kind == "image", cleaning.clean_metadata(text)).otherwise(cleaning.clean_text(text))}
    new |= {c: cleaning.clean_metadata(F.col(c)) for c in ("path", "url", "source") if c in items.columns}
    new |= {c: cleaning.clean_text(F.col(c)) for c in ("style", "description", "table_name") if c in items.columns}
    said = F.coalesce(F.nullif("description", F.lit("")), "text") if "description" in items.columns else F.col("text")
    rows = items.withColumns(new).withColumn("_sync", cleaning.is_sync_line(F.col("text")))
    linked = F.col("type").isin("link", "link_ref") & F.contains(said, F.lit(cleaning.SYNC_NAME)) & F.coalesce(F.lag("_sync").over(order()), F.lit(False))
    asset = F.col("type").isin(*ASSETS)
    gone = F.col("_sync") | linked | ~asset & (cleaning.is_image_path_line(F.col("text")) | cleaning.is_empty(F.col("text")))
    return rows.withColumn("_gone", F.coalesce(gone, F.lit(False))).where(~F.col("_gone")).drop("_gone", "_sync")


def table_titles(items: DataFrame) -> DataFrame:
    """items with title: that of the item right before a table."""
    is_title = (F.col("type") == "table") & (F.col("style") == "表标题")
    held = F.lag(F.when(is_title, F.col("text"))).over(order())
    return items.withColumn("title", F.when(F.col("type").startswith("table") & ~is_title, held)).where(~is_title)


def heading_paths(items: DataFrame, level: Column | None = None) -> DataFrame:
    """items with level and path: the headings above, from the outermost; a heading ends those of its level and deeper ones."""
    rows = items.withColumn("level", level if level is not None else T.heading_level(F.col("style")))
    upto = order().rowsBetween(Window.unboundedPreceding, 0)
    seen = {k: F.last(F.when(F.col("level") == k, F.struct("item_index", T.path_segment(F.col("text")).alias("s"))), ignorenulls=True).over(upto) for k in LEVELS}
    rows = rows.withColumns({f"_h{k}": v for k, v in seen.items()})
    parts = []
    for k in LEVELS:
        above = [F.coalesce(F.col(f"_h{j}.item_index"), F.lit(-1)) for j in LEVELS if j < k]
        live = F.col(f"_h{k}.item_index") > (F.greatest(*above, F.lit(-1)) if above else F.lit(-1))
        parts.append(F.when(live, F.nullif(F.col(f"_h{k}.s"), F.lit(""))))
    return rows.withColumn("path", F.concat_ws("\\", *parts)).drop(*[f"_h{k}" for k in LEVELS])


def segments(items: DataFrame) -> DataFrame:
    """doc_id, segment, path, chunk_type and content: runs of text between headings; tables and images stand alone."""
    rows = table_titles(items)
    rows = heading_paths(rows)
    alone = F.col("type").startswith("table") | (F.col("type") == "image")
    starts = F.col("level").isNotNull() | alone | F.coalesce(F.lag(alone).over(order()), F.lit(False))
    rows = rows.withColumn("segment", F.sum(starts.cast("int")).over(order().rowsBetween(Window.unboundedPreceding, 0)))
    kind = F.when(F.col("type").startswith("table"), "table").when(F.col("type") == "image", "image").otherwise("text")
    said = (
        F.when(F.col("type") == "image", T.image_tag(F.col("item_index"), F.coalesce("text", F.lit(""))))
        .when(F.col("type").isin("link", "link_ref"), T.link_tag(F.col("item_index"), F.coalesce("text", F.lit(""))))
        .otherwise(F.col("text"))
    )
    path = F.when(F.col("title").isNotNull(), F.concat_ws("\\", F.nullif("path", F.lit("")), T.path_segment(F.col("title")))).otherwise(F.col("path"))
    rows = rows.where(F.col("level").isNull()).select("doc_id", "segment", "item_index", path.alias("path"), kind.alias("chunk_type"), said.alias("said"))
    content = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_index", "said"))), lambda x: x["said"]), "\n")
    return rows.groupBy("doc_id", "segment").agg(F.min("path").alias("path"), F.min("chunk_type").alias("chunk_type"), content.alias("content")).where(T.non_space_length(F.col("content")) > 0)


def _spaceless(x: str) -> int:
    return len("".join(x.split()))


def merged(chunks: list[dict], config: Config = DEFAULT) -> list[dict]:
    """One document's chunks with short text sections folded into their parents, until nothing changes or eight rounds are over.

    All text chunks of a folded path get its last heading as their first line and move to the parent path; tables move along, and paths below lose that
    segment; neighbouring text chunks with equal paths are joined and split again. A text that looks like JSON is left alone.
    """
    joins = lambda c: c["chunk_type"] == "text" and not looks_like_json(c["content"])
    for _ in range(8):
        short = {c["path"] for c in chunks if joins(c) and "\\" in c["path"] and _spaceless(c["content"]) < config.short_chunk_chars}
        if not short:
            break
        before = [(c["path"], c["content"]) for c in chunks]
        folds = sorted(short, key=len, reverse=True)
        runs: list[list[dict]] = []
        for c in chunks:
            own = c["path"]
            fold = next((f for f in folds if own == f or own.startswith(f + "\\")), None)
            parent, _, leaf = (fold or "").rpartition("\\")
            path = own if fold is None else parent + own[len(fold) :]
            c = c | {"path": path, "content": f"{leaf}\n{c['content']}" if own == fold and joins(c) else c["content"]}
            if runs and joins(c) and joins(runs[-1][-1]) and runs[-1][-1]["path"] == path:
                runs[-1].append(c)
            else:
                runs.append([c])
        chunks = []
        for run in runs:
            if not joins(run[0]):
                chunks += run
                continue
            pieces = split("\n".join(c["content"].strip() for c in run), config)
            chunks += [run[0] | {"content": p} for p in pieces if _spaceless(p) >= config.min_chunk_chars]
        if [(c["path"], c["content"]) for c in chunks] == before:
            break
    return chunks


def chunk(items: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, chunk_index, path, chunk_type and content: pieces of at most 500 characters with ten visible ones or more, in order."""

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, rows in enumerate(batch.column(1)):
                pieces = [{"path": r["path"], "chunk_type": r["chunk_type"], "content": p} for r in rows.as_py() for p in split(r["content"], config, r["chunk_type"]) if _spaceless(p) >= config.min_chunk_chars]
                found = merged(pieces, config)
                at += [i] * len(found)
                out += [(k, c["path"], c["chunk_type"], c["content"]) for k, c in enumerate(found)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], ["doc_id", "chunk_index", "path", "chunk_type", "content"])

    kind = dict(items.dtypes)["doc_id"]
    # A document is a row: no data frame of its own.
    rows = segments(items).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("segment", "path", "chunk_type", "content"))).alias("rows"))
    return rows.mapInArrow(of_docs, f"doc_id {kind}, chunk_index long, path string, chunk_type string, content string")


def batched(rows: DataFrame, most: int) -> DataFrame:
    """doc_id, item_index, line and batch: greedy batches of lines of at most most characters; a longer line is a batch of its own.

    One pass over a document's lines notes where batches begin; the lines are then dealt by these places.
    """
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("starts"))

    def step(a: Column, x: Column) -> Column:
        n = F.length(x["line"])
        fits = (a["at"] > 0) & (a["size"] + n <= most)
        return F.struct((a["at"] + 1).alias("at"), F.when(fits, a["size"] + n).otherwise(n).alias("size"), F.when(fits, a["starts"]).otherwise(F.concat(a["starts"], F.array(a["at"] + 1))).alias("starts"))

    all_lines = F.sort_array(F.collect_list(F.struct(F.col("item_index").cast("int").alias("item_index"), "line")))
    got = rows.groupBy("doc_id").agg(all_lines.alias("ls")).withColumn("starts", F.aggregate("ls", zero, step, lambda a: a["starts"]))
    part = lambda s, k: F.slice("ls", s, F.coalesce(F.get("starts", k + 1), F.size("ls") + 1) - s)
    parts = got.select("doc_id", F.posexplode(F.transform("starts", part)).alias("batch", "part"))
    return parts.select("doc_id", "batch", F.explode("part").alias("l")).select("doc_id", "l.item_index", "l.line", "batch")
