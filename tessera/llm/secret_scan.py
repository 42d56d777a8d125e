"""Secret scans by the frequency of ownership over the whole corpus.

One pass over the texts finds candidates: values assigned to a name such as password or token, access keys, long hexadecimal runs, and bare runs of token characters that mix
letters and digits. A candidate goes on as a 128-bit hash of its value only. Hashes are aggregated over all documents by repository and owner, before they move
and in three steps (hash, owner, repository; hash, owner; hash), so that a value in a third of all rows is no large group. A value held by WIDE_OWNERS owners or more is a
widely copied example. One held by a single owner that looks like a credential (varied()) is live-looking; others are left open. The counts
are joined back to the candidates' spans (narrow rows; a hot value's partition can be split, as both sides come from an exchange).

What the corpus adds: a bare run whose value is a candidate by name or shape anywhere else, looks like a credential and isn't widely copied, is a span of kind reuse.
Spans found by pattern stay whatever their counts say; live_spans are those, of all kinds, that are live-looking.

Defined cases: a null or empty text has no spans, and the digest of an empty text; rows equal in all columns count as documents of their own and as one repository and owner;
a null owner or repository is one of its own; a null id is passed on; spans of one kind don't overlap, those of different kinds may (a hexadecimal value that is assigned is both), but
a bare run that overlaps another span is none; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import apart, stored, table

#: Fixed values of the scan's contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16

#: Own choices: bare runs, what is stripped of a value, and what a credential looks like.
KINDS = ("assign", "access", "hex", "reuse")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
EDGE = "+/_.=-"
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your|xxxx")
LEAST_RUN, LEAST_DIFFERENT, WIDE_OWNERS = 8, 6, 3
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")

Found = list[tuple[int, int, int, str]]


def varied(value: str) -> bool:
    """Letters and digits, of several kinds, and no word for a placeholder."""
    return bool(_DIGIT.search(value) and _LETTER.search(value)) and len(set(value)) >= LEAST_DIFFERENT and not PLACEHOLDER.search(value.lower())


def by_pattern(text: str) -> Found:
    """start, kind, end and value of the spans that their shape shows, in order."""
    out = [(m.start(), 0, m.end(), m[2].strip(EDGE)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def bare(text: str, spans: Found) -> Found:
    """The same for runs apart from these spans that could be a value."""
    held: list[list[int]] = []
    for start, _, end, _ in spans:
        if held and start < held[-1][1]:
            held[-1][1] = max(held[-1][1], end)
        else:
            held.append([start, end])
    ends = [e for _, e in held]
    out = []
    for m in RUN.finditer(text):
        value = m[0].strip(EDGE)
        if len(value) < LEAST_RUN or value.isalpha() or not varied(value):
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip(EDGE))
        at = bisect_left(ends, start + 1)
        if at == len(held) or held[at][0] >= start + len(value):
            out.append((start, 3, start + len(value), value))
    return out


def joined(spans: Found) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """A row for each row of docs (doc_id, text): counts and spans by pattern, and all candidates with hashes of their values."""
    lists = {"kind": pa.int32(), "start": pa.int64(), "end": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "varied": pa.bool_()}
    fixed = ["row", "doc_id", "owner", "repository"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
            found = {k: [] for k in lists}
            for text in (x.as_py() or "" for x in batch.column(len(fixed))):
                base = by_pattern(text)
                for kind, name in enumerate(("n_assign", "n_access", "n_hex")):
                    rows[name].append(sum(1 for s in base if s[1] == kind))
                rows["spans"].append(joined(base))
                rows["base_sha256"].append(hashlib.sha256(rows["spans"][-1].encode()).hexdigest())
                every = base + bare(text, base)
                keys = [struct.unpack("<qq", hashlib.sha256(s[3].encode()).digest()[:16]) for s in every]
                columns = ([s[1] for s in every], [s[0] for s in every], [s[2] for s in every], [k[0] for k in keys], [k[1] for k in keys], [varied(s[3]) for s in every])
                for name, values in zip(found, columns):
                    found[name].append(values)
            types = [pa.int64()] * 3 + [pa.string()] * 2
            arrays = [batch.column(i) for i in range(len(fixed))] + [pa.array(v, t) for v, t in zip(rows.values(), types)] + [pa.array(found[k], pa.list_(t)) for k, t in lists.items()]
            yield pa.RecordBatch.from_arrays(arrays, [*fixed, *rows, *found])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"row long, doc_id {kind}, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, kind array<int>, start array<long>, end array<long>, k1 array<long>, k2 array<long>, varied array<boolean>"
    return rows.mapInArrow(scan, columns)


def ownership(found: DataFrame) -> DataFrame:
    """k1, k2, owners, repositories, times and named (whether it is a candidate by pattern anywhere), a row for each value."""
    one = found.groupBy("k1", "k2", "owner", "repository").agg(F.count(F.lit(1)).alias("times"), F.max(F.col("kind") < 3).alias("named"))
    one = one.groupBy("k1", "k2", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("times").alias("times"), F.max("named").alias("named"))
    return one.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("times").alias("times"), F.max("named").alias("named"))


def scanned(docs: DataFrame, owner: Column, repository: Column, wide_owners: int = WIDE_OWNERS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_reuse, n_live, n_shared and live_spans, a row for each row of docs (doc_id, text and what the owner and repository come from)."""
    rows = stored(candidates(docs, owner, repository))
    kept = ["row", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    some = F.size("kind") > 0
    found = rows.where(some).select(*kept, "owner", "repository", F.explode(F.arrays_zip("kind", "start", "end", "k1", "k2", "varied")).alias("s"))
    found = found.select(*kept, "owner", "repository", "s.*")
    counts = apart(ownership(found).where("named"), "k1")
    marked = found.drop("owner", "repository").join(counts, ["k1", "k2"], "left")
    span = F.struct("start", "kind", F.format_string("%s:%d:%d", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1), "start", "end").alias("name"))
    is_span = (F.col("kind") < 3) | (F.coalesce("named", F.lit(False)) & F.col("varied") & (F.col("owners") < wide_owners))
    live = is_span & F.col("varied") & (F.col("owners") == 1)
    listed = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, span))), lambda x: x["name"]), ",")
    judged = marked.groupBy(*kept).agg(
        listed(is_span).alias("spans"), F.count_if(is_span & (F.col("kind") == 3)).alias("n_reuse"), F.count_if(live).alias("n_live"),
        F.count_if(is_span & (F.col("owners") >= wide_owners)).alias("n_shared"), listed(live).alias("live_spans"),
    )
    none = F.lit(0).cast("long")
    plain = rows.where(~some).select(*kept, "spans", none.alias("n_reuse"), none.alias("n_live"), none.alias("n_shared"), F.lit("").alias("live_spans"))
    return judged.unionByName(plain).drop("row")


def op13_secrets(spark, sf_dir: str) -> DataFrame:
    """documents name no repositories: a source is an owner, and its documents in one language are a repository."""
    return scanned(table(spark, sf_dir, "documents"), F.col("source"), F.concat_ws("/", "source", "lang"))


_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: int, pattern: str) -> str:
    """Matches with their places: what lies between them, and they themselves, added up."""
    return f"""
  SELECT r, doc_id, owner, repository, {kind} AS kind, m,
         CAST(sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM (SELECT r, doc_id, owner, repository, unnest(string_split_regex(t, '{pattern}')) AS gap, unnest(regexp_extract_all(t, '{pattern}')) AS m,
               unnest(range(CAST(len(string_split_regex(t, '{pattern}')) AS BIGINT))) AS i FROM d)
  WINDOW w AS (PARTITION BY r ORDER BY i)"""


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS owner, concat_ws('/', source, lang) AS repository, coalesce(text, '') AS t FROM documents),
matches AS ({" UNION ALL ".join(_spans(k, p) for k, p in enumerate((_ASSIGN, "AKIA[A-Z0-9]+", "[0-9a-f]+", "[A-Za-z0-9+/_.=-]+")))}),
valued AS (
  SELECT *, CASE kind WHEN 0 THEN regexp_extract(m, '{_ASSIGN}', 2) ELSE m END AS v FROM matches
  WHERE m IS NOT NULL AND length(m) >= CASE kind WHEN 1 THEN 16 WHEN 2 THEN 32 ELSE 8 END),
spans AS (
  SELECT r, doc_id, owner, repository, kind, start, start + length(m) AS stop, trim(v, '+/_.=-') AS v FROM valued WHERE kind < 3 AND (kind > 0 OR length(v) >= 8)),
runs AS (SELECT r, doc_id, owner, repository, kind, start + length(v) - length(ltrim(v, '+/_.=-')) AS start, trim(v, '+/_.=-') AS v FROM valued WHERE kind = 3),
bare AS (
  SELECT r, doc_id, owner, repository, kind, start, start + length(v) AS stop, v FROM runs
  WHERE length(v) >= 8 AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.r = runs.r AND s.start < runs.start + length(runs.v) AND s.stop > runs.start)),
judged AS (
  SELECT *, regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(regexp_extract_all(v, '.'))) >= 6
            AND NOT regexp_matches(lower(v), 'example|sample|dummy|changeme|placeholder|your|xxxx') AS varied
  FROM (SELECT * FROM spans UNION ALL SELECT * FROM bare)),
found AS (SELECT * FROM judged WHERE kind < 3 OR varied),
counts AS (SELECT v, count(DISTINCT coalesce(owner, chr(1))) AS owners, bool_or(kind < 3) AS named FROM found GROUP BY v),
marked AS (
  SELECT f.*, c.owners, c.named, f.kind < 3 OR (c.named AND f.varied AND c.owners < 3) AS is_span,
         (f.kind < 3 OR (c.named AND c.owners < 3)) AND f.varied AND c.owners = 1 AS live,
         concat(['assign', 'access', 'hex', 'reuse'][f.kind + 1], ':', f.start, ':', f.stop) AS name
  FROM found f JOIN counts c ON c.v = f.v),
rows AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(name, ',' ORDER BY start, kind) FILTER (is_span) AS spans,
         count(*) FILTER (is_span AND kind = 3) AS n_reuse, count(*) FILTER (live) AS n_live, count(*) FILTER (is_span AND owners >= 3) AS n_shared,
         string_agg(name, ',' ORDER BY start, kind) FILTER (live) AS live_spans
  FROM marked GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_reuse, 0) AS n_reuse, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(live_spans, '') AS live_spans
FROM d LEFT JOIN rows USING (r)
"""
