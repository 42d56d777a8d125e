"""Reference tags and links of answers as numbered references, over rows of lines and lists of matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.cleaning import stripped
from tessera.functions.lines import AT, KEY, ROW, lines_of, runs_of

# Shapes of tags, links and their destinations, labels of passages, titles of the section of sources, rules, and numbered references.
TAG = r"<reference>\s*(.*?)\s*</reference>"
LINK = r"(?<!!)\[([^\]\n]*)\]\(([^)\n]+)\)"
DESTINATION = r"^(<[^>\n]+>|\S+)\s+\"([^\"\n]*)\"\s*$"
LABEL = r"^\s*(片段\s*\d+)\s*[,，:：]\s*(.+?)\s*$"
SOURCES = r"^\s*(?:#{1,6}\s*)?(?:\*\*)?(知识来源|引用文献|参考来源)(?:\*\*)?\s*[:：]?\s*$"
RULE = r"^[-*_]\s*[-*_]\s*[-*_\s]*$"
REFERENCE = r"\[\[\d+\]\]\([^)]+\)"

_EITHER = f"{TAG}|{LINK}"


def _mark(match: Column) -> Column:
    """What a match stands for: the address it refers to, and the text that stays if it refers to nothing."""
    # Groups of a tag, of a link, and of a link's destination.
    inside, label, target = F.regexp_extract(match, f"^{TAG}$", 1), F.regexp_extract(match, f"^{LINK}$", 1), stripped(F.regexp_extract(match, f"^{LINK}$", 2))
    titled = target.rlike(DESTINATION)
    address = F.when(titled, F.regexp_extract(target, DESTINATION, 1)).otherwise(target)
    passage = label.rlike(LABEL) | (titled & F.regexp_extract(target, DESTINATION, 2).rlike(LABEL))
    is_tag = match.startswith("<reference>")
    url = F.when(is_tag, F.nullif(inside, F.lit(""))).when(passage, address)
    return F.struct(url.alias("url"), stripped(F.translate(url, "\\", "/")).alias("norm"), F.when(is_tag, F.lit("")).otherwise(match).alias("kept"), is_tag.alias("tag"))


def without_sources(rows: DataFrame) -> DataFrame:
    """Lines of texts (of lines_of) before the section of sources, without blank lines at their end and the rule there."""
    whole = Window.partitionBy(KEY)
    rows = rows.withColumn("__cut", F.min(F.when(~F.col("code") & F.col("bare").rlike(SOURCES), F.col(AT))).over(whole))
    rows = rows.withColumn("__last", F.max(F.when((F.col("bare") != "") & (F.col(AT) < F.col("__cut")), F.col(AT))).over(whole))
    ruled = F.max(F.when((F.col(AT) == F.col("__last")) & F.col("bare").rlike(RULE), F.lit(1))).over(whole)
    end = F.when(F.col("__cut").isNull(), F.lit(1 << 30)).otherwise(F.coalesce(F.col("__last") - F.coalesce(F.col("__ruled"), F.lit(0)), F.lit(-1)))
    # A text that is nothing but sources keeps an empty line.
    return rows.withColumn("__ruled", ruled).withColumn("line", F.when(F.col(AT) <= end, F.col("line")).when(F.col(AT) == 0, F.lit(""))).where("line is not null").drop("__cut", "__last", "__ruled")


def with_references(df: DataFrame, text: str, address: Callable[[Column], Column] = lambda url: url, out: str = "text", refs: str = "refs") -> DataFrame:
    """df with the text of an answer whose tags and links to passages are [[n]](address), and the addresses in the order of n, that of first appearance.

    Other links stay. A section of sources goes, code is left alone, neighbours with equal numbers become one, and neighbours stand together.
    """
    rows = without_sources(lines_of(df, F.col(text)))
    rows = runs_of(rows, F.col("code"), "__block")
    found = F.when(F.col("code"), F.array().cast("array<string>")).otherwise(F.regexp_extract_all("line", F.lit(_EITHER), F.lit(0)))
    pieces = F.when(F.col("code"), F.array("line")).otherwise(F.split("line", _EITHER, -1))
    rows = rows.withColumn("__parts", F.struct(F.col(AT), pieces.alias("pieces"), F.transform(found, _mark).alias("marks")))
    blocks = rows.groupBy(KEY, "__block", "code").agg(F.array_sort(F.collect_list("__parts")).alias("lines"), F.first(ROW).alias(ROW))
    whole = blocks.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("__block", "code", "lines"))).alias("blocks"), F.first(ROW).alias(ROW))
    # In a line, tags are numbered before links.
    tags_first = lambda marks: F.concat(F.filter(marks, lambda m: m["tag"]), F.filter(marks, lambda m: ~m["tag"]))
    urls = F.filter(F.flatten(F.transform(F.flatten(F.col("blocks.lines")), lambda x: tags_first(x["marks"]))), lambda m: m["url"].isNotNull())
    whole = whole.withColumn("urls", urls).withColumn("norms", F.array_distinct(F.transform("urls", lambda m: m["norm"])))
    # The address as it was first written, for each number.
    whole = whole.withColumn("shown", F.transform("norms", lambda n: F.element_at(F.filter("urls", lambda m: m["norm"] == n), 1)["url"]))
    number = lambda m: F.array_position("norms", m["norm"]).cast("int")
    written = lambda m: F.when(m["url"].isNull(), m["kept"]).otherwise(F.concat(F.lit("[["), number(m).cast("string"), F.lit("]]("), address(F.element_at("shown", number(m))), F.lit(")")))
    once = lambda line: F.regexp_replace(line, rf"({REFERENCE})(?:\s*\1)+", "$1")
    line = lambda x: F.array_join(F.zip_with(x["pieces"], x["marks"], lambda p, m: F.concat(p, F.coalesce(written(m), F.lit("")))), "")
    together = lambda text: F.regexp_replace(text, rf"({REFERENCE})[ \t\r\n]+(?={REFERENCE})", "$1")
    block = lambda b: F.when(b["code"], F.array_join(F.transform(b["lines"], lambda x: x["pieces"][0]), "\n")).otherwise(together(F.array_join(F.transform(b["lines"], lambda x: once(line(x))), "\n")))
    text_out = stripped(F.array_join(F.transform("blocks", block), "\n"))
    names = [F.col(f"{ROW}.`{c}`") for c in df.columns if c not in (out, refs)]
    return whole.select(*names, text_out.alias(out), F.col("norms").alias(refs))
