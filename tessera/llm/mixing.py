"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its weight's share of all words, at most three times its own size; what is above goes
to the others by weight. A source gives whole passes over its documents first (complete epochs); the rest
of its target is sampled without replacement. The key of a document is -ln(u) / weight, u a hash of its id and text
and weight its quality weight; documents are taken in the order of their keys while their prefix sum fits,
and the gap that is left is closed by the one document that fits it best, if that comes nearer.

All documents are measured once into a narrow checkpoint. The order within a source is not sorted as a
whole: 1 - exp(-key) is cut into 4,096 ranges, whose sums (at most 4,096 rows a source) show the one
range that holds the budget's end. Only that range is sorted, so a source that holds a third
of all rows gives no large group.

Defined cases: a null text has size 0 and is only taken as part of whole passes, of which it adds no word; a null source is a
source of its own, after all others; a null id is an id like any other; rows equal in id and text have one key; repeated rows are documents of their own; an
empty table gives an empty result; a corpus without words has targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, cut, table, whole_rows

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
RANGES = 4096
SEED = "mix-1"
_SCALE = 10  # a multiple of all weights, for exact comparisons


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain prose down to 0.1 for a text with a symbol for every word."""
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("double")
    return 1 - 0.9 * F.least(F.lit(1.0), symbols / F.greatest(size, F.lit(1)))


def order(doc_id: Column, text: Column, weight: Column, seed: str) -> Column:
    """1 - exp(-key): in the order of the keys, and between 0 and 1. The text counts too, so that rows without id are spread."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text))), 1, 13), 16, 10)
    return 1 - F.pow((digits.cast("double") + 0.5) / float(2**52), 1 / weight)


def targets(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, target, epochs and rest from (source, source_size): one row a source.

    Sources are capped in the order of size over weight, for as long as an even share of
    what is left reaches three times their size.
    """
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (at - 1) % len(weights) + 1).cast("long")
    first = Window.orderBy(F.col("source_size") * F.expr(f"{_SCALE} div w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    cap = MOST_EPOCHS * F.col("source_size")
    left = F.col("s") - F.coalesce(F.sum(cap).over(first), F.lit(0))
    left_w = F.col("w_all") - F.coalesce(F.sum("w").over(first), F.lit(0))
    shared = (
        sizes.withColumn("w", weight)
        .withColumns({"s": F.sum("source_size").over(whole), "w_all": F.sum("w").over(whole)})
        .withColumn("capped", left * F.col("w") >= cap * left_w)
        .withColumns({"c": F.sum(F.when(F.col("capped"), cap).otherwise(0)).over(whole), "v": F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0)).over(whole)})
    )
    target = F.when(F.col("capped"), cap.cast("double")).otherwise((F.col("w") * (F.col("s") - F.col("c"))).cast("double") / F.when(~F.col("capped"), F.col("w_all") - F.col("v")))
    return (
        shared.select("source", "source_size", target.alias("target"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    )


def mixed(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",), weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """carried, size, source_size, target, copies and taken, a row for each row of docs (doc_id, text, source)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = (
        docs.select(*[F.col(f"`{c}`").alias(f"k_{c}") for c in carried], F.col("doc_id").alias("id"), "source", text.alias("t"))
        .withColumn("size", F.regexp_count("t", F.lit(WORD)).cast("long"))
        .withColumn("p", order(F.col("id"), F.col("t"), quality_weight(F.col("t"), F.col("size")), seed))
        .withColumns({"range": F.least(F.floor(F.col("p") * RANGES), F.lit(RANGES - 1)).cast("int"), "row": F.monotonically_increasing_id()})
        .drop("t")
    )
    base = cut(base)
    by_range = cut(base.groupBy("source", "range").agg(F.sum("size").alias("n")))
    plan = targets(by_range.groupBy("source").agg(F.sum("n").alias("source_size")), weights)
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))

    # The range in which each source's budget ends, and what the ranges before it hold.
    running = F.sum("n").over(Window.partitionBy("source").orderBy("range"))
    ends = (
        by_range.withColumn("upto", running).alias("r").join(plan.alias("t"), same("r", "t")).where("upto > rest")
        .groupBy("r.source").agg(F.min(F.struct("range", (F.col("upto") - F.col("n")).alias("before"))).alias("e"))
    ).select("source", "e.range", "e.before")
    plan = cut(plan.alias("t").join(ends.alias("e"), same("t", "e"), "left").select("t.*", F.coalesce("range", F.lit(RANGES)).alias("end_range"), F.coalesce("before", F.lit(0)).alias("before")))

    rows = base.alias("d").join(plan.alias("t"), same("d", "t")).select("d.*", "t.source_size", "t.target", "t.epochs", "t.rest", "t.end_range", "t.before")
    prefix = F.sum("size").over(Window.partitionBy("source").orderBy("p", "id", "size", "row").rowsBetween(Window.unboundedPreceding, 0))
    last = rows.where(F.col("range") == F.col("end_range")).withColumn("upto", prefix + F.col("before"))
    inside = last.where(F.col("upto") <= F.col("rest")).select(F.col("row").alias("inside"))
    marked = rows.join(inside, F.col("row") == F.col("inside"), "left").withColumn("first", (F.col("range") < F.col("end_range")) | F.col("inside").isNotNull())
    marked = marked.drop("inside")

    # One more document, if it brings the source nearer to its target.
    gap = marked.groupBy("source").agg(F.sum(F.when(F.col("first"), F.col("size")).otherwise(0)).alias("sum_first"))
    off = F.abs(F.col("rest") - F.col("sum_first") - F.col("size"))
    closing = (
        marked.where(~F.col("first") & (F.col("size") > 0)).alias("d").join(gap.alias("g"), same("d", "g"))
        .where(off < F.col("rest") - F.col("sum_first"))
        .groupBy("d.source").agg(F.min(F.struct(off.alias("off"), "p", "id", "size", F.col("row").alias("closing"))).alias("c"))
        .select("c.closing")
    )
    done = marked.join(closing, F.col("row") == F.col("closing"), "left")
    copies = F.col("epochs") + F.when(F.col("first") | F.col("closing").isNotNull(), F.lit(1)).otherwise(0)
    return done.select(*[F.col(f"k_{c}").alias(c) for c in carried], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def resample(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """docs with each row as many times as the mix takes it; columns stay as they are."""
    own = docs.select("doc_id", "text", "source", F.xxhash64("text").alias("hash"))
    taken = mixed(own, ("doc_id", "source", "hash"), weights, seed).where("copies > 0")
    taken = taken.groupBy(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("hash").alias("t_hash")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    numbered = docs.select(whole_rows(docs).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("src"), F.xxhash64("text").alias("hash"))
    pair = F.col("id").eqNullSafe(F.col("t_id")) & F.col("src").eqNullSafe(F.col("t_source")) & (F.col("hash") == F.col("t_hash"))
    # Rows equal in id, source and text share what the mix takes of them.
    at = F.row_number().over(Window.partitionBy("t_id", "t_source", "t_hash").orderBy(F.lit(1)))
    lone = numbered.join(taken.where("rows = 1"), pair).select("row", "copies")
    rest = numbered.join(taken.where("rows > 1"), pair).withColumn("at", at)
    rest = rest.select("row", (F.expr("copies div rows") + F.when(F.col("at") <= F.col("copies") % F.col("rows"), 1).otherwise(0)).alias("copies"))
    out = lone.unionByName(rest).where("copies > 0")
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


SQL = r"""
WITH base AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS DOUBLE) AS symbols
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         1 - pow((CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0,
                 1 / (1 - CAST(0.9 AS DOUBLE) * least(1.0, symbols / greatest(size, 1)))) AS p
  FROM base),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM sizes),
shared AS (
  SELECT *, sum(source_size) OVER () AS s, sum(w) OVER () AS w_all,
         coalesce(sum(3 * source_size) OVER f, 0) AS c0, coalesce(sum(w) OVER f, 0) AS v0
  FROM weighed WINDOW f AS (ORDER BY source_size * (10 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, (s - c0) * w >= 3 * source_size * (w_all - v0) AS is_capped FROM shared),
totals AS (
  SELECT *, sum(CASE WHEN is_capped THEN 3 * source_size ELSE 0 END) OVER () AS c, sum(CASE WHEN is_capped THEN w ELSE 0 END) OVER () AS v FROM capped),
target AS (
  SELECT source, source_size,
         CASE WHEN is_capped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w * (s - c) AS DOUBLE) / CAST(w_all - v AS DOUBLE) END AS target FROM totals),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM target),
running AS (
  SELECT k.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.p, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source),
marked AS (SELECT *, upto <= rest AS is_first, sum(CASE WHEN upto <= rest THEN size ELSE 0 END) OVER (PARTITION BY source) AS sum_first FROM running),
closing AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY abs(rest - sum_first - size), p, doc_id, size) AS place
  FROM marked WHERE NOT is_first AND size > 0 AND abs(rest - sum_first - size) < rest - sum_first)
SELECT m.doc_id, m.size, m.source_size, m.target,
       m.epochs + CASE WHEN m.is_first OR c.place IS NOT NULL THEN 1 ELSE 0 END AS copies,
       CAST((m.epochs + CASE WHEN m.is_first OR c.place IS NOT NULL THEN 1 ELSE 0 END) * m.size AS BIGINT) AS taken
FROM marked m LEFT JOIN closing c ON c.place = 1 AND c.doc_id = m.doc_id AND c.source IS NOT DISTINCT FROM m.source
"""
