"""What is added to items and chunks: link markers, contexts of images, page numbers of slides, assets of chunks, pairs of images.

Item tables have doc_id, item_index, type, style and text; what comes before an item is windows over its document.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tessera.functions.cleaning import stripped

# Addresses in texts, labels that name nothing, styles, and what descriptions say.
URL = re.compile(r"(?i)https?://[^\s<>()，。；;、\"'）】]+")
NO_LABELS = ("网址", "链接", "URL", "url")
MARKS = "，。；;,、 "
SITE, LINK, LINK_STYLE, BODY, NORMAL = "网站链接", "链接", "链接", "正文", "Normal"
TITLES = ("标题", "Title")
SATISFIED = "already satisfied"
NO_DESCRIPTION = "图片位于教程上下文中，暂无可用正文描述。"
ENDS = "。；;，,：:"
FOUND = ArrayType(StructType([StructField("url", StringType()), StructField("before", StringType())]))


def order(doc: str = "doc_id") -> Window:
    return Window.partitionBy(doc).orderBy("item_index")


def label(context: str) -> str | None:
    """What stands before the last colon of a text, as the name of the link behind it; a short one without marks names a site."""
    mark = "：" if "：" in context else ":"
    name, found, _ = context.rpartition(mark)
    name = name.strip()
    if not found or not name or name in NO_LABELS:
        return None
    return name + SITE if len(name) <= 20 and not set(name) & set(MARKS) else name


@F.pandas_udf(StringType())
def labels(context: pd.Series) -> pd.Series:
    return context.map(lambda c: label(c or ""))


def domain_name(url: str) -> str:
    return re.sub(r"(?i)^https?://", "", url).partition("/")[0] + " " + LINK


def marked(text: str, context: str, described: dict[str, str] | None = None) -> tuple[str, list[tuple[str, str]]]:
    """A text with {{description}} for each address, and (description, url) of each; equal descriptions are numbered from 2.

    An address is described by the label before it (or in the context, where nothing stands before it), else by described, else by its host.
    """
    out, found, used, at = [], [], set(), 0
    for m in URL.finditer(text):
        before = text[at : m.start()]
        name = label(before.strip() or context) or (described or {}).get(m[0]) or domain_name(m[0])
        unique, n = name, 2
        while unique in used:
            unique, n = f"{name} {n}", n + 1
        used.add(unique)
        found.append((unique, m[0]))
        out += [before, "{{" + unique + "}}"]
        at = m.end()
    return "".join([*out, text[at:]]).strip(), found


MARKED = StructType([StructField("text", StringType()), StructField("links", ArrayType(StructType([StructField("description", StringType()), StructField("url", StringType())])))])


@F.pandas_udf(MARKED)
def link_markers(text: pd.Series, context: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([marked(t or "", c or "") for t, c in zip(text, context)], columns=["text", "links"])


def without_urls(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?i)https?://[^\s<>()，。；;、\"'）】]+", ""))


def body_context(items: DataFrame, name: str = "context") -> DataFrame:
    """items with the nearest body text above each, without addresses; texts that are nothing but addresses are passed over."""
    own = F.when((F.col("style") == BODY) & ~F.col("type").isin("image", "table", "image_table"), F.nullif(without_urls(F.col("text")), F.lit("")))
    return items.withColumn(name, F.coalesce(F.last(own, ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, -1)), F.lit("")))


def enriched_links(items: DataFrame) -> DataFrame:
    """Items with markers for the addresses in their texts, each followed by link items (text and description are the marker's name); indexes are dense again. Images and tables stay."""
    base = body_context(items.withColumn("text", stripped(F.coalesce("text", F.lit("")))))
    plain = F.col("type").isin("image", "table", "image_table") | ~F.col("text").rlike(r"(?i)https?://")
    new = base.withColumn("m", link_markers(F.when(~plain, F.col("text")), F.when(~plain, F.col("context"))))
    text = F.when(plain, F.col("text")).otherwise(F.col("m.text"))
    own = F.struct(F.col("type"), F.col("style"), text.alias("text"), F.lit(None).cast("string").alias("url"))
    links = F.transform(F.when(plain, F.array().cast(MARKED["links"].dataType)).otherwise(F.col("m.links")), lambda x: F.struct(F.lit("link_ref").alias("type"), F.lit(LINK_STYLE).alias("style"), x["description"].alias("text"), x["url"].alias("url")))
    rows = new.select("doc_id", "item_index", F.posexplode(F.concat(F.array(own), links)).alias("part", "i"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("item_index", "part")) - 1
    return rows.select("doc_id", place.cast("long").alias("item_index"), "i.*")


def image_contexts(items: DataFrame) -> DataFrame:
    """doc_id, item_index, group (of consecutive images), position, size, document_title, heading_path (the last four headings) and nearest_body, a row for each image.

    What counts as above an image is what stands above the first of its group.
    """
    image = F.col("type") == "image"
    text = F.nullif(stripped(F.coalesce("text", F.lit(""))), F.lit(""))
    title = ~image & F.col("style").isin(*TITLES)
    upto = order().rowsBetween(Window.unboundedPreceding, 0)
    rows = items.withColumns({"_image": image, "_text": F.when(~image, text)})
    rows = rows.withColumn("_title", F.min(F.when(title & F.col("_text").isNotNull(), F.struct("item_index", "_text"))).over(upto))
    heading = ~image & (F.col("style").startswith("标题") | F.lower(F.trim("style")).startswith("heading"))
    # The first title names the document; headings, and later titles that are styled as one, are the path.
    is_part = F.col("_text").isNotNull() & heading & ~(title & (F.col("_title.item_index") == F.col("item_index")))
    is_body = F.col("_text").isNotNull() & ~heading & ~title & (F.col("style").isin(BODY, NORMAL) | F.col("type").startswith("table"))
    # The last four headings: each one carries the three before it.
    parts = rows.where(is_part).select("doc_id", "item_index", "_text")
    four = F.collect_list("_text").over(order().rowsBetween(-3, 0))
    parts = parts.select("doc_id", "item_index", F.array_join(four, " -> ").alias("_path"))
    rows = rows.withColumn("_body", F.last(F.when(is_body, F.col("_text")), ignorenulls=True).over(upto)).join(parts, ["doc_id", "item_index"], "left")
    rows = rows.withColumn("_path", F.last("_path", ignorenulls=True).over(upto))
    starts = (image & ~F.coalesce(F.lag("_image").over(order()), F.lit(False))).cast("int")
    rows = rows.withColumn("_new", starts).withColumn("group", F.sum("_new").over(upto)).where("_image")
    of_group = Window.partitionBy("doc_id", "group")
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        "doc_id", "item_index", "group", F.row_number().over(of_group.orderBy("item_index")).alias("position"), F.count(F.lit(1)).over(of_group).alias("size"),
        some("_title._text").alias("document_title"), some("_path").alias("heading_path"), some("_body").alias("nearest_body"),
    )


def described(description: Column, context: Column) -> Column:
    """An image's description: satisfied if it says that or only repeats the text above it; that text where there is none."""
    text = stripped(F.coalesce(description, F.lit("")))
    flat = lambda x: F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", ""), f"^[{ENDS}]+|[{ENDS}]+$", "")
    same = (flat(text) != "") & (flat(text) == flat(context))
    return F.when((F.lower(text) == SATISFIED) | same, SATISFIED).otherwise(F.coalesce(F.nullif(text, F.lit("")), F.nullif(context, F.lit("")), F.lit(NO_DESCRIPTION)))


def with_assets(chunks: DataFrame, assets: DataFrame, tag: str, name: str) -> DataFrame:
    """chunks (chunk_id, doc_id, content) with name: the assets (doc_id, index, label, path) whose index their tags hold, in order; of equal ones the first."""
    tags = chunks.select("chunk_id", "doc_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(rf'(?s)<{tag}\s+index="(\d+)">.*?</{tag}>'), F.lit(1)))).alias("index"))
    held = tags.withColumn("index", F.col("index").cast("long")).join(assets.withColumn("index", F.col("index").cast("long")), ["doc_id", "index"])
    first = held.groupBy("chunk_id", "label", "path").agg(F.min("index").alias("index"))
    listed = first.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("index", "label", "path"))).alias(name))
    return chunks.join(listed, "chunk_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<struct<index:bigint,label:string,path:string>>")))


def slide_pages(slides: DataFrame, key: str, slide: str, is_title: Column) -> DataFrame:
    """slides with section (title slides so far), page (within its section, from 1; null for title slides) and heading."""
    upto = Window.partitionBy(key).orderBy(slide).rowsBetween(Window.unboundedPreceding, 0)
    rows = slides.withColumn("_title", is_title.cast("int")).withColumn("section", F.sum("_title").over(upto))
    page = F.sum(1 - F.col("_title")).over(Window.partitionBy(key, "section").orderBy(slide).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("page", F.when(F.col("_title") == 0, page)).drop("_title")
    return rows.withColumn("heading", F.when(F.col("page").isNotNull(), F.format_string("第%d页", "page")))


def alike(a: Column, b: Column, area: float = 0.55, aspect: float = 0.65) -> Column:
    """Whether two images (width, height) are near in area and in shape."""
    ratio = lambda x, y: F.least(x, y) / F.greatest(x, y)
    sized = F.least(a["width"], a["height"], b["width"], b["height"]) > 0
    return F.coalesce(F.when(sized, (ratio(a["width"] * a["height"], b["width"] * b["height"]) >= area) & (ratio(a["width"] / a["height"], b["width"] / b["height"]) >= aspect)), F.lit(False))


def image_rows(images: DataFrame, key: str, order_by: str) -> DataFrame:
    """images (width, height) with row (from 0) and column (0 or 1): an image and the next one share a row if they are alike, from the first on.

    Who pairs is decided along each run of neighbours that are alike: its images pair up by twos from the run's start.
    """
    w = Window.partitionBy(key).orderBy(order_by)
    size = F.struct(F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    rows = images.withColumn("_like", F.coalesce(alike(F.lag(size).over(w), size), F.lit(False)))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum((~F.col("_like")).cast("int")).over(upto))
    place = F.row_number().over(Window.partitionBy(key, "_run").orderBy(order_by)) - 1
    rows = rows.withColumn("column", (place % 2).cast("int"))
    return rows.withColumn("row", F.sum((F.col("column") == 0).cast("int")).over(upto) - 1).drop("_like", "_run")


def table_headers(rows: DataFrame, key: str, order_by: str, cells: str) -> DataFrame:
    """key and headers: the keys of a table's row objects (a map), in the order they are first seen."""
    seen = rows.select(key, order_by, F.posexplode(F.map_keys(cells)).alias("at", "head")).groupBy(key, "head").agg(F.min(F.struct(order_by, "at")).alias("first"))
    return seen.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "head"))), lambda x: x["head"]).alias("headers"))
