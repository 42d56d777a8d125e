"""Page layout: lines of PDF pages to paragraphs and headings, and slide reading order.

pdf_lines has doc_id, page_number, line_order, text, page_width, page_height, x0, y0, x1, y1, font_size and bold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import meta
from tessera.session import written

# Numbering of headings and its levels, list marks, dates, page numbers, lines of a document's data, sizes and tolerances.
MOST_HEADING_CHARS, MOST_CENTER_CHARS, MOST_LOWEST_CHARS, MOST_LEVEL, GAP, BOOST, LARGE_FONT, LARGE_GAP, ROW_TOP = 120, 30, 15, 6, 0.4, 2.0, 4.0, 2.0, 3.0
HAN_NUMBER = "一二三四五六七八九十百千万"
MARKERS = (
    (rf"^[{HAN_NUMBER}]{{1,8}}\s*、", 1),
    (rf"^[（(]\s*[{HAN_NUMBER}]{{1,8}}\s*[）)]", 2),
    (r"^\d{1,3}(?:\.\d{1,3})+\s+", 3),
    (r"^\d{1,3}\s*[.、．]", 3),
    (r"^[（(]\s*\d{1,3}\s*[）)]", 4),
    (r"^[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]", 5),
)
NUMBERED = rf"(?i)^\s*(?:(?:\d{{1,3}}(?:\.\d{{1,3}}){{0,5}}|[{HAN_NUMBER}]{{1,8}}|[IVXLCDM]{{1,8}})\s*[.、．)]|第\s*[\d{HAN_NUMBER}]{{1,8}}\s*[章节篇部分条]|(?:part|chapter|section)\s*[\dIVXLCDM{HAN_NUMBER}]+)"
LISTED = r"^\s*(?:[-*•·●○◆◇■□▪▫▶▷◦]|[（(]?[a-zA-Z][）)])\s+"
DATED = r"^\s*\d{4}\s*[-/.年]\s*\d{1,2}\s*(?:[-/.月]\s*\d{1,2}\s*日?)?"
DATE = rf"{DATED}\s*$|^\s*\d{{1,2}}\s*[-/.]\s*\d{{1,2}}\s*[-/.]\s*\d{{2,4}}\s*$|^\s*\d{{4}}\s*年\s*\d{{1,2}}\s*月(?:\s*\d{{1,2}}\s*日)?\s*$"
PAGE_NUMBER = r"^\s*(?:第\s*)?\d{1,3}\s*(?:页)?\s*$"
CENTER_DATA = r"(?i)^\s*(?:(?:版次|版本|版本号|受控状态|发放编号|编\s*制|审\s*核|批\s*准)\s*[:：]?.*|[A-Z]/\d(?:\s*版)?|\d+(?:\.\d+)?\s*(?:天|年|月|日|分|元|%))\s*$"
SENTENCE = r"[。！？.!?]\s*$"
BODY = "正文"


def lines_of_spans(spans: DataFrame) -> DataFrame:
    """A line for each (doc_id, page_number, line_order): texts of its spans (span_order) joined, their common box, the largest font, bold if any is."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span_order", "text"))), lambda x: x["text"]), "")
    edges = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return spans.groupBy("doc_id", "page_number", "line_order").agg(text.alias("text"), *edges, F.max("font_size").alias("font_size"), F.bool_or("bold").alias("bold"), F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height")).where(T.trim_u(F.col("text")) != "")


def with_alignment(lines: DataFrame) -> DataFrame:
    """lines with align: center, right, left or other, by the page's width and the median left edge of its longer lines."""
    width = F.col("page_width")
    body = F.when((F.length("text") >= 8) & (F.col("x0") < 0.45 * width), F.col("x0"))
    left = lines.groupBy("doc_id", "page_number").agg(F.coalesce(F.median(body), F.min("x0")).alias("left_margin"))
    near = F.greatest(F.lit(8.0), 0.025 * width)
    align = (
        F.when(F.abs((F.col("x0") + F.col("x1")) / 2 - width / 2) <= F.greatest(F.lit(18.0), 0.06 * width), "center")
        .when((width - F.col("x1") <= near) | (F.col("x0") >= 0.55 * width), "right")
        .when((F.abs(F.col("x0") - F.col("left_margin")) <= near) | (F.col("x0") <= 0.18 * width), "left")
        .otherwise("other")
    )
    return lines.join(left, ["doc_id", "page_number"]).withColumn("align", align).drop("left_margin")


def without_furniture(lines: DataFrame, share: float = 0.35, most_chars: int = 80) -> DataFrame:
    """lines without page numbers and short texts that a document of two pages or more repeats on a third of its pages."""
    rows = lines.withColumn("line", T.without_space(F.coalesce("text", F.lit("")))).where(~F.coalesce("text", F.lit("")).rlike(PAGE_NUMBER))
    pages = rows.groupBy("doc_id").agg(F.countDistinct("page_number").alias("pages")).where("pages > 1")
    found = rows.where((F.length("line") <= most_chars) & (F.col("line") != "")).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).join(pages, "doc_id")
    again = found.where(F.col("n") >= F.greatest(F.lit(2), F.floor(share * F.col("pages") + 0.999))).select("doc_id", "line")
    return rows.join(again, ["doc_id", "line"], "left_anti").drop("line")


def linked(lines: DataFrame, annotations: DataFrame) -> DataFrame:
    """lines with urls of the annotations (doc_id, page_number, x0, y0, x1, y1, uri) they meet."""
    a = annotations.withColumn("page", F.concat_ws(":", "doc_id", "page_number"))
    b = lines.withColumn("page", F.concat_ws(":", "doc_id", "page_number"))
    urls = meta.box_pairs(b, a, "page").groupBy("l.page", "l.line_order").agg(F.sort_array(F.collect_set("r.uri")).alias("urls"))
    return b.join(urls, ["page", "line_order"], "left").drop("page")


def marker_level(text: Column) -> Column:
    """Level of a heading's numbering; null without one."""
    bare = T.trim_u(text)
    out = F.when(bare.rlike(MARKERS[0][0]), MARKERS[0][1])
    for pattern, level in MARKERS[1:]:
        out = out.when(bare.rlike(pattern), level)
    return out


def is_heading_candidate() -> Column:
    """Short, no list, date or right-hand text; centred ones of at most thirty characters, left ones with a number, others in bold."""
    text = T.trim_u(F.col("text"))
    place = F.when(F.col("align") == "center", F.length(T.without_space(text)) <= MOST_CENTER_CHARS).when(F.col("align") == "left", marker_level(text).isNotNull() | text.rlike(NUMBERED)).when(F.col("align") == "right", False).otherwise(F.col("bold"))
    return F.length(text).between(1, MOST_HEADING_CHARS) & ~text.rlike(LISTED) & ~text.rlike(DATE) & ~text.rlike(DATED) & F.coalesce(place, F.lit(False))


def heading_score() -> Column:
    return F.coalesce("font_size", F.lit(0.0)) + F.when(F.col("align") == "center", BOOST).otherwise(0.0) + F.when(F.col("bold"), BOOST).otherwise(0.0)


def headings(lines: DataFrame) -> DataFrame:
    """lines with level (1 to 6, null for body text) and style.

    A numbered candidate has its numbering's level, one below it if the document has a supported centred heading; others go to the nearest of the
    six highest clusters of scores. Centred candidates need support: bold type, a numbered line below, or a large font with space above. Runs of three or more
    equally numbered headings that read like a list, and long ones of the lowest level, are body text.
    """
    order = Window.partitionBy("doc_id").orderBy("page_number", "line_order")
    of_doc = Window.partitionBy("doc_id")
    length = F.length(T.without_space(F.col("text")))
    same_page = lambda f: f("page_number").over(order).eqNullSafe(F.col("page_number"))
    rows = with_alignment(lines).withColumns({"candidate": is_heading_candidate(), "marker": marker_level(F.col("text")), "score": heading_score(), "_chars": length})
    rows = rows.withColumns({"_gap": F.when(same_page(F.lag), F.col("y0") - F.lag("y1").over(order)), "_next": F.when(same_page(F.lead), F.lead("marker").over(order))})
    whole = rows.groupBy("doc_id").agg(F.median(F.when(F.col("font_size") > 0, F.col("font_size"))).alias("_font"), F.median(F.when(F.col("_gap") > 0, F.col("_gap"))).alias("_space"))
    rows = rows.join(whole, "doc_id")
    center = F.col("candidate") & (F.col("align") == "center")
    spaced = (F.col("font_size") >= F.coalesce("_font", F.lit(0.0)) + LARGE_FONT) & (F.col("_gap").isNull() | (F.col("_gap") >= F.greatest(F.col("font_size"), LARGE_GAP * F.coalesce("_space", F.lit(0.0)))))
    supported = center & ~F.col("text").rlike(CENTER_DATA) & (F.col("bold") | F.col("_next").isNotNull() | spaced)
    rows = rows.withColumn("_held", F.coalesce(supported, F.lit(False)))
    rows = rows.withColumn("_top", F.max("_held").over(of_doc))

    # Levels of what has no number, by clusters.
    free = rows.where(F.col("candidate") & F.col("marker").isNull()).withColumn("_key", F.struct("page_number", "line_order"))
    clusters = meta.gap_clusters(free, "score", "_key", GAP, ["doc_id"])
    centres = clusters.where(F.col("cluster") <= MOST_LEVEL).groupBy("doc_id", F.col("cluster").alias("_level")).agg(F.first("cluster_mean").alias("_centre"))
    scores = free.select("doc_id", "score").distinct()
    nearest = scores.join(centres, "doc_id").groupBy("doc_id", "score").agg(F.min_by("_level", F.struct(F.round(F.abs(F.col("score") - F.col("_centre")), 6), "_level")).alias("_near"))
    rows = rows.join(nearest, ["doc_id", "score"], "left")
    level = F.when(F.col("marker").isNotNull(), F.col("marker") + F.col("_top").cast("int")).when(F.col("_held"), F.lit(1)).otherwise(F.coalesce("_near", F.lit(1)))
    level = F.when(F.col("candidate") & ~(center & ~F.col("_held")), F.least(level, F.lit(MOST_LEVEL))).cast("int")
    rows = rows.withColumn("level", level)

    # Runs that are lists, then long headings of the lowest level.
    numbered = F.when(F.col("level").isNotNull() & F.col("marker").isNotNull(), F.col("level"))
    rows = rows.withColumn("_kind", numbered)
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_kind").isNotNull() & F.col("_kind").eqNullSafe(F.lag("_kind").over(order)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("doc_id", "_run")
    listed = (F.count("_kind").over(run) >= 3) & (F.min("marker").over(run) == F.max("marker").over(run)) & (F.min((F.col("_chars") > MOST_LOWEST_CHARS).cast("int")).over(run) + F.min(F.col("text").rlike(SENTENCE).cast("int")).over(run) > 0)
    rows = rows.withColumn("level", F.when(F.col("_kind").isNotNull() & listed, F.lit(None)).otherwise(F.col("level")))
    lowest = F.max("level").over(of_doc)
    rows = rows.withColumn("level", F.when((F.col("level") == lowest) & (F.col("_chars") > MOST_LOWEST_CHARS), F.lit(None)).otherwise(F.col("level")))
    style = F.when(F.col("level") == 1, "标题").when(F.col("level").isNotNull(), F.concat(F.lit("标题 "), F.col("level").cast("string"))).otherwise(BODY)
    return rows.withColumn("style", style).drop("candidate", "marker", "score", "_chars", "_gap", "_next", "_font", "_space", "_held", "_top", "_near", "_kind", "_run")


def same_row_merged(lines: DataFrame, top: float = ROW_TOP) -> DataFrame:
    """lines (with line_order) merged along the rows of their page: from left to right, those whose top is within three points of the row's first one, up to a gap of 12 points or 1.2 times the font."""

    def of_page(frame: pd.DataFrame) -> pd.DataFrame:
        rows: list[list[dict]] = []
        for line in frame.sort_values(["y0", "x0", "line_order"], kind="stable").to_dict("records"):
            if rows and line["y0"] - rows[-1][0]["y0"] <= top:
                rows[-1].append(line)
            else:
                rows.append([line])
        out: list[dict] = []
        for row in rows:
            for k, line in enumerate(sorted(row, key=lambda x: x["x0"])):
                last = out[-1] if k else None
                if last is None or line["x0"] - last["x1"] > max(12.0, 1.2 * last["font_size"]):
                    out.append(dict(line))
                    continue
                last["text"] = " ".join(f"{last['text']} {line['text']}".replace("\u00a0", " ").replace("\u3000", " ").split())
                last |= {c: min(last[c], line[c]) for c in ("x0", "y0", "line_order")} | {c: max(last[c], line[c]) for c in ("x1", "y1", "font_size")}
                last["bold"] = bool(last["bold"] or line["bold"])
        return pd.DataFrame(out, columns=list(frame.columns))

    columns = ("doc_id", "page_number", "line_order", "text", "page_width", "page_height", "x0", "y0", "x1", "y1", "font_size", "bold")
    some = lines.select(*columns)
    return some.groupBy("doc_id", "page_number").applyInPandas(of_page, some.schema)


def items_of_lines(lines: DataFrame) -> DataFrame:
    """Items of styled lines (with urls, if there are any): a paragraph for each, followed by its addresses; source names page and line."""
    urls = F.coalesce("urls", F.array().cast("array<string>")) if "urls" in lines.columns else F.array().cast("array<string>")
    inside = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)https?://[^\s<>()]+"), F.lit(0)), lambda u: F.regexp_replace(u, "[。；;，,)]+$", ""))
    links = F.filter(F.array_distinct(F.concat(inside, urls)), lambda u: T.trim_u(u) != "")
    source = F.format_string("page:%s:line:%s", F.col("page_number").cast("string"), F.col("line_order").cast("string"))
    item = lambda kind, style, text, url, source: F.struct(F.lit(kind).alias("type"), style.alias("style"), text.alias("text"), url.alias("url"), source.alias("source"))
    own = item("paragraph", F.col("style"), F.col("text"), F.lit(None).cast("string"), source)
    rest = F.transform(links, lambda u: item("link_ref", F.lit("链接"), u, u, F.concat(source, F.lit(":link"))))
    rows = lines.select("doc_id", "page_number", "line_order", F.posexplode(F.concat(F.array(own), rest)).alias("part", "i"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "line_order", "part")) - 1
    return rows.select("doc_id", place.cast("long").alias("item_index"), "i.*")


def title_cutoff(fonts: DataFrame, key: str, size: str) -> DataFrame:
    """key and cutoff: the font from which a slide of a presentation is a title: 24 at least, else the smaller of the lower third quartile and four above the median."""
    sizes = F.sort_array(F.collect_list(size))
    low = F.element_at(sizes, (F.floor(0.75 * (F.size(sizes) - 1)) + 1).cast("int"))
    return fonts.where(F.col(size) > 0).groupBy(key).agg(F.greatest(F.lit(24.0), F.least(low, F.median(size) + 4)).alias("cutoff"))


def without_empty_sections(items: DataFrame) -> DataFrame:
    """Items without headings under which nothing but headings stands, up to the next heading of their level or above."""
    order = Window.partitionBy("doc_id").orderBy("item_index")
    rows = items.withColumn("level", T.heading_level(F.col("style")))
    after = order.rowsBetween(1, Window.unboundedFollowing)
    body = F.min(F.when(F.col("level").isNull(), F.col("item_index"))).over(after)
    ends = F.lit(None).cast("long")
    for k in range(0, 10):
        end = F.min(F.when(F.col("level") <= k, F.col("item_index"))).over(after)
        ends = F.when(F.col("level") == k, end).otherwise(ends)
    rows = rows.withColumns({"_body": body, "_end": ends})
    keep = F.col("level").isNull() | (F.col("_body").isNotNull() & (F.col("_end").isNull() | (F.col("_body") < F.col("_end"))))
    return rows.where(keep).drop("_body", "_end")


# Words of headings above references, and lines that name a source.
REFERENCE_WORDS = "参考文献|引用文献|相关链接"
SOURCE_LINE = r"^(?:资料来源|数据来源|参考资料|视频来源|参考内容|出处)\s*[:：]\s*(.*)$"
URL_ONLY = r"(?i)^https?://\S+$"


def without_reference_sections(items: DataFrame) -> DataFrame:
    """Items without sections whose heading speaks of references, up to the next heading of that level or above; a short or styled text that speaks of them heads one too, of the first level."""
    upto = Window.partitionBy("doc_id").orderBy("item_index").rowsBetween(Window.unboundedPreceding, 0)
    text = T.trim_u(F.coalesce("text", F.lit("")))
    heading = T.heading_level(F.col("style"))
    named = text.rlike(REFERENCE_WORDS) & (heading.isNotNull() | (F.coalesce("style", F.lit("")) != BODY) | (F.length(text) <= 20))
    rows = items.withColumns({"_named": named, "_level": F.coalesce(heading, F.when(named, F.lit(1)))})
    gone = F.lit(False)
    for k in range(1, 10):
        last_ref = F.max(F.when((F.col("_level") == k) & F.col("_named"), F.col("item_index"))).over(upto)
        last_end = F.max(F.when((F.col("_level") <= k) & ~F.col("_named"), F.col("item_index"))).over(upto)
        gone = gone | F.coalesce(last_ref > F.coalesce(last_end, F.lit(-1)), F.lit(False))
    return rows.withColumn("_gone", gone).where(~F.col("_gone")).drop("_gone", "_named", "_level")


def without_source_links(items: DataFrame) -> DataFrame:
    """Items without lines that name a source with an address, and the items right after them that are nothing but links."""
    text = T.trim_u(F.coalesce("text", F.lit("")))
    is_source = text.rlike(SOURCE_LINE) & F.regexp_extract(text, SOURCE_LINE, 1).rlike(r"(?i)https?://\S+")
    only = text.rlike(URL_ONLY)
    if "url" in items.columns:
        only = only | (F.col("type").isin("link", "link_ref") & F.coalesce(F.trim("url").rlike(URL_ONLY), F.lit(False)))
    rows = items.withColumns({"_source": is_source, "_only": only & ~is_source})
    before = Window.partitionBy("doc_id").orderBy("item_index").rowsBetween(Window.unboundedPreceding, -1)
    # What the last item that is more than a link was.
    after = F.coalesce(F.last(F.when(~F.col("_only"), F.col("_source")), ignorenulls=True).over(before), F.lit(False))
    return rows.withColumn("_gone", F.col("_source") | F.col("_only") & after).where(~F.col("_gone")).drop("_gone", "_source", "_only")


PLACE, SIZE = 0.04, 0.06
#: Images of a document that meet as rows of a join; more meet in blocks of BLOCK, ROWS by a block at a time.
FEW_IMAGES, BLOCK, ROWS = 64, 4096, 128


def repeated_images(images: DataFrame, most_bits: int = 8) -> DataFrame:
    """doc_id, image_id and first (the smallest image it repeats or is repeated by, or itself) of images that a document repeats: hashes (16 hexadecimal digits) of at most eight bits' difference, near the same place and size.

    Images alike in all of these go on as one. The others of a document are all compared: those of a document with few as rows of a join, else in cells of two blocks, which
    take a few operations on 64-bit words for a pair and give a row for an image at most. So neither hashes with many equal bits nor a large document are more than that.
    """
    own = ["doc_id", "hash", "x", "y", "w", "h"]
    same = written(images.groupBy(*own).agg(F.min("image_id").alias("image"), F.count(F.lit(1)).alias("n")))
    sizes = same.groupBy("doc_id").agg(F.count(F.lit(1)).alias("images")).where("images > 1")
    met = same.dropna(subset=own).join(sizes, "doc_id").select("doc_id", "image", "images", F.conv("hash", 16, -10).cast("long").alias("bits"), *[F.col(c).cast("double") for c in ("x", "y", "w", "h")])
    few = met.where(F.col("images") <= FEW_IMAGES)
    l, r = few.alias("l"), few.alias("r")
    near = F.bit_count(F.col("l.bits").bitwiseXOR(F.col("r.bits"))) <= most_bits
    for c, most in (("x", PLACE), ("y", PLACE), ("w", SIZE), ("h", SIZE)):
        near = near & (F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")) <= most)
    pairs = l.join(r, (F.col("l.doc_id") == F.col("r.doc_id")) & (F.col("l.image") != F.col("r.image")) & near)
    firsts = pairs.select(F.col("l.doc_id").alias("doc_id"), F.col("l.image").alias("image"), F.col("r.image").alias("other")).unionByName(_firsts_in_cells(met.where(F.col("images") > FEW_IMAGES), most_bits))
    first = firsts.groupBy("doc_id", "image").agg(F.min("other").alias("first"))
    found = same.join(first, ["doc_id", "image"], "left").where("first is not null or n > 1").select(*own, F.least("first", "image").alias("first"))
    return images.join(found, own).select("doc_id", "image_id", "first")


def _firsts_in_cells(met: DataFrame, most_bits: int) -> DataFrame:
    """doc_id, image and other: for each cell of two blocks of a document's images, the smallest one near each."""
    blocks = F.ceil(F.col("images") / BLOCK).cast("int")
    rows = met.withColumn("block", F.pmod(F.xxhash64("image"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("doc_id", "image", "bits", "x", "y", "w", "h", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))

    def of_cell(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("image", ignore_index=True)
        low, high = (np.flatnonzero((frame["block"] == k).to_numpy()) for k in key[1:])
        ids, bits = frame["image"].to_numpy(), frame["bits"].to_numpy(np.int64).view(np.uint64)
        shape = [(frame[c].to_numpy(float), most) for c, most in (("x", PLACE), ("y", PLACE), ("w", SIZE), ("h", SIZE))]
        of, other = [], []
        # Images are in the order of ids: the first place that holds a near one is the smallest.
        for mine, all_ in ((low, high), (high, low)) if key[1] != key[2] else ((low, low),):
            for start in range(0, len(mine) if len(all_) else 0, ROWS):
                at = mine[start : start + ROWS]
                near = (np.bitwise_count(bits[at, None] ^ bits[None, all_]) <= most_bits) & (ids[at, None] != ids[None, all_])
                for v, most in shape:
                    near &= np.abs(v[at, None] - v[None, all_]) <= most
                found = near.any(1)
                of.append(ids[at[found]])
                other.append(ids[all_[near.argmax(1)[found]]])
        return pd.DataFrame({"doc_id": [key[0]] * sum(map(len, of)), "image": np.concatenate(of) if of else [], "other": np.concatenate(other) if other else []})

    doc, image = (dict(met.dtypes)[c] for c in ("doc_id", "image"))
    # Cells are work of like size, whatever their bytes.
    tasks = max(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * met.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "doc_id", "low", "high").groupBy("doc_id", "low", "high").applyInPandas(of_cell, f"doc_id {doc}, image {image}, other {image}")
