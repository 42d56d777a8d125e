"""Chat formatting with cumulative-snapshot collapse.

Logs often keep a conversation once for every turn, each time with all turns before. Every turn gets the rolling hash of its
conversation up to it. A conversation whose whole hash is also the hash of a shorter part of another one is a
snapshot of it and goes, by an anti-join; of equal conversations the one with the smallest id stays. What stays is rendered.

The hashes are two running 64-bit values over (position, role, text), 128 bits together. Only ids, roles and hashes are
exchanged to find the maximal conversations; texts move once, for those that are rendered. Very common beginnings or whole conversations
meet as partial aggregates, never as a group of rows.

Defined cases: turns are ordered by turn number, null first, then role and the text's MD5, so repeated turns keep a stable
order; a turn without conversation id is a conversation of its own; a null role is rendered as "unknown" and a null text as an empty one,
and both differ from the words; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table


def _key() -> list[Column]:
    # As JSON, which names its fields, so that an absent turn or role is none of the other.
    return [F.col("conv_id"), F.when(F.col("conv_id").isNull(), F.to_json(F.struct("turn", "role", F.sha2("text", 256).alias("text"))))]


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, lone, pos, n, h1 and h2, a row for each turn: the rolling hashes of the turns up to pos of n."""
    conv, lone = _key()
    own = lambda seed: F.xxhash64(F.lit(seed), F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())
    rows = turns.select(conv.alias("conv_id"), lone.alias("lone"), "turn", "role", F.md5("text").alias("t"), own(1).alias("t1"), own(2).alias("t2"))
    whole = Window.partitionBy("conv_id", "lone")
    order = whole.orderBy("turn", "role", "t")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # Turns without an id are apart already; equal ones among them are equal conversations of one turn.
    pos = F.when(F.col("conv_id").isNull(), F.lit(1)).otherwise(F.row_number().over(order))
    rows = rows.withColumns({"pos": pos, "n": F.when(F.col("conv_id").isNull(), F.lit(1)).otherwise(F.count(F.lit(1)).over(whole))})
    role = F.coalesce(F.col("role"), F.lit("unknown"))
    mixed = lambda seed, t: F.xxhash64(F.lit(seed), F.col("pos").cast("long"), role, F.col("role").isNull(), F.col(t))
    rows = rows.withColumns({"x1": mixed(3, "t1"), "x2": mixed(4, "t2")})
    rolling = lambda x: F.when(F.col("conv_id").isNull(), F.col(x)).otherwise(F.bit_xor(x).over(upto))
    return rows.select("conv_id", "lone", F.col("pos").cast("long").alias("pos"), F.col("n").cast("long").alias("n"), rolling("x1").alias("h1"), rolling("x2").alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, lone and n_copies of the conversations that stay."""
    seen = cut(prefixes(turns))
    parts = seen.where("pos < n").select("pos", "h1", "h2").distinct()
    whole = seen.where("pos = n").groupBy("pos", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNull().alias("absent"), "conv_id", "lone")).alias("k"), F.count(F.lit(1)).alias("n_copies"))
    return whole.join(parts, ["pos", "h1", "h2"], "left_anti").select("k.conv_id", "k.lone", "n_copies")


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (equal conversations, itself included) and text, a row for each maximal conversation."""
    conv, lone = _key()
    rows = turns.select(conv.alias("conv_id"), lone.alias("lone"), "turn", "role", "text")
    kept = maximal(turns).alias("k")
    mine = rows.alias("r").join(kept, F.col("r.conv_id").eqNullSafe(F.col("k.conv_id")) & F.col("r.lone").eqNullSafe(F.col("k.lone")))
    turn = F.struct("turn", "role", F.md5("text").alias("t"), "text")
    groups = mine.groupBy("r.conv_id", "r.lone").agg(F.sort_array(F.collect_list(turn)).alias("all"), F.max("n_copies").alias("n_copies"))
    # Equal turns without an id are one conversation of one turn.
    turns_of = F.when(F.col("lone").isNotNull(), F.slice("all", 1, 1)).otherwise(F.col("all"))
    line = lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("\n"))
    return groups.select("conv_id", F.size(turns_of).cast("long").alias("n_turns"), "n_copies", F.array_join(F.transform(turns_of, line), "").alias("text"))


def op5_chat(spark, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS line
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST)),
p AS (
  SELECT conv_id, pos, n, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM t),
parts AS (SELECT DISTINCT pos, md5(upto) AS h FROM p WHERE pos < n),
whole AS (SELECT md5(upto) AS h, n, min(conv_id) AS conv_id, min(upto) AS text, count(*) AS n_copies FROM p WHERE pos = n GROUP BY 1, 2)
SELECT conv_id, n AS n_turns, n_copies, text FROM whole w
WHERE NOT EXISTS (SELECT 1 FROM parts x WHERE x.pos = w.n AND x.h = w.h)
"""
