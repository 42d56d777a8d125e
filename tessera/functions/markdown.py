"""Markdown of answers as the simpler kind that message cards show, as a pass over rows of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.cleaning import stripped
from tessera.functions.lines import AT, KEY, ROW, lines_of, runs_of

# Shapes of a table's rows, rules, headings, lists and quotes, and what cards show for them.
BARS = r"^\|.*\|$"
SEPARATOR = r"^\|?(?:\s*:?-{3,}:?\s*\|)*\s*:?-{3,}:?\s*\|?$"
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
RULE = r"^[-*_]\s*[-*_]\s*[-*_\s]*$"
ITEM = r"^(\s*)[*+-]\s+(.+?)\s*$"
SOURCE_ITEM = r"^\*(.*来源：.*)\*\s*$"
LINE, QUOTE, DOT, COLUMN = "────────", "▌", "·", "列"


def cells(row: Column) -> Column:
    """The cells of a table's row."""
    return F.transform(F.split(F.regexp_replace(row, r"^\|+|\|+$", ""), r"\|", -1), stripped)


def named_values(head: Column, row: Column) -> Column:
    """name: value of the cells that have one; a column without a name goes by its number."""
    names = F.transform(head, lambda h, k: F.when(h == "", F.concat(F.lit(COLUMN), k + 1)).otherwise(h))
    pairs = F.zip_with(F.slice(names, 1, F.size(row)), F.slice(row, 1, F.size(head)), lambda h, v: F.when(v != "", F.concat(h, F.lit(": "), v)))
    return F.filter(pairs, lambda p: p.isNotNull())


def shown() -> Column:
    """What a card shows for a line outside tables and code: an array of lines."""
    line, bare = F.col("line"), F.col("bare")
    level, bold = F.length(F.regexp_extract(bare, HEADING, 1)), F.concat(F.lit("**"), stripped(F.regexp_extract(bare, HEADING, 2)), F.lit("**"))
    body = F.regexp_extract(line, ITEM, 2)
    source = F.regexp_extract(body, SOURCE_ITEM, 1)
    return (
        F.when(level == 1, F.array(bold, F.lit("---")))
        .when(level.between(2, 3), F.array(F.lit(""), bold))
        .when(level > 3, F.array(bold))
        .when(bare.rlike(RULE) & (F.length(F.regexp_replace(bare, " ", "")) >= 3), F.array(F.lit(LINE)))
        .when(bare.startswith(">"), F.array(F.rtrim(F.concat(F.lit(f"{QUOTE} "), stripped(F.substring(bare, 2, 1 << 30))))))
        .when(line.rlike(ITEM), F.array(F.concat(F.regexp_extract(line, ITEM, 1), F.lit(f"{DOT} "), F.when(source != "", source).otherwise(body))))
        .otherwise(F.array(line))
    )


def with_cards(df: DataFrame, text: str, name: str = "card") -> DataFrame:
    """df with the card text of a Markdown column; a blank for none.

    A run of rows with bars is a table from the first row that a rule follows. Its rows that have values become numbered lines of named values; a table without values is its headers.
    """
    order = Window.partitionBy(KEY).orderBy(AT)
    rows = lines_of(df, F.col(text))
    rows = runs_of(rows.withColumn("row", ~F.col("code") & F.col("bare").rlike(BARS) & (F.col("bare") != "|")), F.col("row"), "run")
    ruled = F.col("row") & F.lead("row", 1, False).over(order) & F.lead(F.col("bare").rlike(SEPARATOR), 1, False).over(order)
    run = Window.partitionBy(KEY, "run")
    rows = rows.withColumn("ruled", ruled).withColumn("start", F.min(F.when(F.col("ruled"), F.col(AT))).over(run))
    rows = rows.withColumn("head", cells(F.max(F.when(F.col(AT) == F.col("start"), F.col("bare"))).over(run))).withColumn("place", F.coalesce(F.col(AT) - F.col("start"), F.lit(-1)))
    rows = rows.withColumn("values", F.when(F.col("place") >= 2, named_values(F.col("head"), cells(F.col("bare")))))
    rows = rows.withColumn("filled", F.coalesce(F.max(F.size("values")).over(run) > 0, F.lit(False)))
    none = F.array().cast("array<string>")
    out = (
        F.when(F.col("code"), F.array("line"))
        .when((F.col("place") == 0) & ~F.col("filled"), F.array(F.array_join("head", "；")))
        .when((F.col("place") >= 2) & (F.size("values") > 0), F.array(F.concat((F.col("place") - 1).cast("string"), F.lit(". "), F.array_join("values", "；"))))
        .when(F.col("place") >= 0, none)
        .otherwise(shown())
    )
    whole = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(AT, out.alias("out")))), lambda x: x["out"])), "\n")
    card = rows.groupBy(KEY).agg(F.first(ROW).alias(ROW), whole.alias("card"))
    return card.select(f"{ROW}.*", F.coalesce(F.nullif(stripped(F.col("card")), F.lit("")), F.lit(" ")).alias(name))
