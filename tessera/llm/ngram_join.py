"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles, held as 32-bit hashes (the count that a pair shares is off by one with a chance of
about |x||y| / 2 ** 32). Texts with equal sets are copies and go on as one. In each of RUNS runs a set samples tokens by a
hash, each with the chance 1 / (0.8 size), so that two sets with a similarity of 0.8 share one sampled token on average, and meets the other sets with that token in a
bucket. Buckets of more than SMALL sets are split in the same way once more. Within buckets, all pairs are compared by 64-byte min-hash
sketches, in cells of bounded size where a bucket is still large. Ten runs find a pair with a similarity of just 0.8 with a chance over 0.99, closer ones still more often.

Pairs whose sketches are anywhere near the threshold tie sets into groups (connected components). Every pair within a group is then
compared exactly on the whole sets, in cells of two blocks, which also finds links that no bucket had shown. A cell gives each of its
sets one row (how many documents it is linked with, and the smallest set of its component there), never the pairs, so a group of
thousands of near copies gives thousands of rows.

Sets lie in one table in the shared folder; only ids, sketches and sampled tokens move until the groups are known. Nothing but counts reaches the driver.

Defined cases: a text with fewer than five words has one shingle of all its words; a text without words (null, empty, blank) is linked with nothing and
is a class of its own; words are compared as they are, case included; repeated rows and ids are documents of their own that are copies;
an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import apart, cut, stored, table, whole_rows

SHINGLE = 5
#: The least similarity, as a fraction.
NUM, DEN = 4, 5
RUNS, SMALL, CELL, BLOCK, SKETCH = 10, 256, 512, 512, 64
#: Rows that a worker turns into sets before it hands them on.
SLICE = 512
#: Estimated similarity from which sketches tie two sets; four deviations below the threshold.
TIE = 0.6
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MASK = (1 << 64) - 1
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def _seeds(name: str, n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{name}:{i}") for i in range(n)], dtype=np.uint64)


class Shingler:
    """Turns texts into sets; keeps the hashes of words it has seen."""

    def __init__(self):
        self.of: dict[str, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        if len(self.of) > 250_000:
            self.of.clear()
        found, of = _WORD.findall(text or ""), self.of
        out = []
        for w in found:
            h = of.get(w)
            if h is None:
                h = of[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def set(self, text: str | None) -> np.ndarray:
        """Sorted 32-bit hashes of the shingles."""
        w = self.words(text)
        n = min(SHINGLE, len(w))
        if not n:
            return np.zeros(0, np.uint32)
        total = np.full(len(w) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k]
        return np.unique((_mix(total) >> np.uint64(32)).astype(np.uint32))


def sketch(x: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> bytes:
    least = np.full(len(factors), np.uint64(_MASK))
    for at in range(0, len(x), 4096):
        least = np.minimum(least, (x[None, at : at + 4096] * factors[:, None] + terms[:, None]).min(1))
    return (_mix(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def paths(x: np.ndarray, runs: np.ndarray) -> list[tuple[int, int | None]]:
    """The sampled tokens of a set: (bucket, bucket below it) for each path; None where a bucket samples no further token."""
    most = np.uint64(min(_MASK, int((1 << 64) * DEN / (NUM * len(x)))))
    r, j = np.nonzero(_mix(x[None, :] ^ runs[:, None]) <= most)
    first = _mix(x[j] * np.uint64(0x9E3779B97F4A7C15) + runs[r])
    if not len(first):
        return []
    i, j = np.nonzero(_mix(x[None, :] ^ first[:, None]) <= most)
    second = _mix(first[i] * np.uint64(0x9E3779B97F4A7C15) + x[j])
    out = [(int(a), int(b)) for a, b in zip(first[i].view(np.int64), second.view(np.int64))]
    return out + [(int(first[k].view(np.int64)), None) for k in np.setdiff1d(np.arange(len(first)), i)]


def sets(docs: DataFrame) -> DataFrame:
    """uid, doc_id, text_hash, digest, n, tokens, sketch and paths, a row for each row of docs: a stored table."""
    factors, terms, runs = _seeds("factor", SKETCH) | np.uint64(1), _seeds("term", SKETCH), _seeds("run", RUNS)

    def rows(frames):
        shingler = Shingler()
        names = ["doc_id", "text_hash", "digest", "n", "tokens", "sketch", "paths"]
        for frame in frames:
            for at in range(0, len(frame), SLICE):
                out, part = [], frame.iloc[at : at + SLICE]
                for doc_id, text_hash, text in zip(part["doc_id"], part["text_hash"], part["text"]):
                    s = shingler.set(text)
                    x = _mix(s.astype(np.uint64) + np.uint64(1))
                    own = (hashlib.md5(s.tobytes()).digest(), len(s), s.tobytes(), sketch(x, factors, terms), paths(x, runs)) if len(s) else (None, 0, b"", b"", [])
                    out.append((doc_id, text_hash, *own))
                yield pd.DataFrame(out, columns=names).astype({"text_hash": "int64", "n": "int32"})

    schema = "doc_id string, text_hash long, digest binary, n int, tokens binary, sketch binary, paths array<struct<k1:long,k2:long>>"
    # Ids pass Python as strings: pandas would turn a column with nulls into floats.
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInPandas(rows, schema)
    return stored(found.withColumns({"doc_id": F.col("doc_id").cast("long"), "uid": F.monotonically_increasing_id()}))


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) from edges (a, b), by alternating large and small stars.

    Minima are aggregated by node before the exchange, and joins back to the edges can be split, so a node with very many edges is no large group;
    each round is a checkpoint.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = cut(now), None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(apart(least, "a"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(apart(low, "a"), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        now = cut(small.select("e.a", "e.b").where("a != b").distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _cells(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """rows dealt to cells (ci, cj) of two blocks of their group; b is a row's own block."""
    rows = rows.withColumn("blocks", F.ceil(F.col(size) / block).cast("int")).withColumn("b", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"ci": F.least("b", "o"), "cj": F.greatest("b", "o")}).drop("o")
    return rows.repartition(key, "ci", "cj").sortWithinPartitions(key, "ci", "cj", "uid")


def _whole(frames, keys: list[str]):
    """Frames that hold whole groups, from frames sorted by keys."""
    held = None
    for frame in frames:
        frame = pd.concat([held, frame], ignore_index=True) if held is not None else frame
        if not len(frame):
            continue
        last = np.ones(len(frame), bool)
        for k in keys:
            last &= frame[k].to_numpy() == frame[k].iloc[-1]
        held = frame[last]
        if not last.all():
            yield frame[~last].reset_index(drop=True)
    if held is not None and len(held):
        yield held.reset_index(drop=True)


def _groups(frame: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    new = np.zeros(len(frame), bool)
    new[0] = True
    for k in keys:
        v = frame[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(frame)))


def _labels(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the smallest row of its component."""
    label = np.arange(len(near), dtype=np.int32)
    none = np.int32(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], none).min(1, initial=none))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def ties(leaves: DataFrame) -> DataFrame:
    """Edges (a, b) between sets of a bucket whose sketches are near, from leaves (leaf, size, uid, sketch)."""
    keys, least = ["leaf", "ci", "cj"], TIE * SKETCH

    def edges(frames):
        for frame in _whole(frames, keys):
            marks = np.frombuffer(b"".join(frame["sketch"]), dtype=np.uint8).reshape(-1, SKETCH)
            uid = frame["uid"].to_numpy()
            starts, sizes = _groups(frame, keys)
            out_a, out_b = [], []
            for s in np.unique(sizes[sizes <= 16]):
                i, j = np.triu_indices(s, 1)
                some = starts[sizes == s]
                for at in range(0, len(some), 100_000 // max(1, len(i)) + 1):
                    base = some[at : at + 100_000 // max(1, len(i)) + 1, None]
                    a, b = (base + i).ravel(), (base + j).ravel()
                    near = (marks[a] == marks[b]).sum(1) >= least
                    out_a.append(uid[a[near]])
                    out_b.append(uid[b[near]])
            for at, s in zip(starts[sizes > 16], sizes[sizes > 16]):
                own = marks[at : at + s]
                near = np.zeros((s, s), np.uint8)
                for k in range(SKETCH):
                    near += own[:, k][:, None] == own[:, k][None, :]
                label = _labels(near >= least)
                moved = label != np.arange(s)
                out_a.append(uid[at : at + s][moved])
                out_b.append(uid[at + label[moved]])
            if out_a:
                yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return _cells(leaves, "leaf", "size", CELL).select(*keys, "uid", "sketch").mapInPandas(edges, "a long, b long")


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of a shares with each of b."""
    size = np.array([len(x) for x in [*a, *b]])
    tokens, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(size)), size)
    many = np.bincount(at) > 1
    place = np.cumsum(many) - 1
    keep = many[at]
    row, col = row[keep], place[at[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(a), len(b)), np.float64)
    width = max(64, 2_000_000 // len(size))
    for low in range(0, int(many.sum()), width):
        lo, hi = np.searchsorted(col, [low, low + width])
        part = np.zeros((len(size), width), np.float32)
        part[row[lo:hi], col[lo:hi] - low] = 1
        out += part[: len(a)] @ part[len(a) :].T
    return out.astype(np.int64)


def verified(grouped: DataFrame) -> DataFrame:
    """uid, links, root and blocks, a row for each set and cell, from grouped (comp, size, uid, tokens, copies)."""
    keys = ["comp", "ci", "cj"]

    def check(frames):
        for frame in _whole(frames, keys):
            uid, copies, block = (frame[c].to_numpy() for c in ("uid", "copies", "b"))
            links, root = np.zeros(len(frame), np.int64), uid.copy()
            tokens = [np.frombuffer(x, dtype=np.uint32) for x in frame["tokens"]]
            size = np.array([len(x) for x in tokens])
            for at, s in zip(*_groups(frame, keys)):
                own = np.arange(at, at + s)
                two = frame["ci"].iloc[at] != frame["cj"].iloc[at]
                left = own[block[own] == frame["ci"].iloc[at]] if two else own
                right = own[block[own] == frame["cj"].iloc[at]] if two else own
                if not len(left) or not len(right) or s < 2:
                    continue
                both = shared([tokens[k] for k in left], [tokens[k] for k in right])
                near = both * (DEN + NUM) >= NUM * (size[left][:, None] + size[right][None, :])
                if not two:
                    np.fill_diagonal(near, False)
                full = np.zeros((s, s), bool)
                full[np.ix_(left - at, right - at)] = near
                full |= full.T
                links[own] = (full * copies[own][None, :]).sum(1)
                root[own] = uid[own[_labels(full)]]
            yield pd.DataFrame({"uid": uid, "links": links, "root": root, "blocks": frame["blocks"]})

    rows = _cells(grouped, "comp", "size", BLOCK).select(*keys, "uid", "b", "blocks", "copies", "tokens")
    return rows.mapInPandas(check, "uid long, links long, root long, blocks int")


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows of which most have no uid in ids, before they are exchanged: a bit for each of 2 ** 23 hashes of ids, a table of 131,072 rows at most, goes to every executor."""
    at = F.pmod(F.xxhash64("uid"), F.lit(1 << 23))
    word, bit = F.shiftright(at, 6).cast("int"), F.pmod(at, F.lit(64)).cast("int")
    bits = ids.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("word").agg(F.bit_or("b").alias("bits"))
    marked = rows.withColumns({"word": word, "bit": bit}).join(F.broadcast(bits), "word")
    return marked.where(F.call_function("getbit", F.col("bits"), F.col("bit")) == 1).drop("word", "bit", "bits")


def classes(docs: DataFrame) -> DataFrame:
    """uid, doc_id, text_hash, class_uid and n_links, a row for each row of docs (doc_id, text)."""
    # Joins of what grows with the input are sort-merge joins at every size, so that a small run shows what a large one moves.
    all_sets = sets(docs)
    named = all_sets.where("digest is not null").groupBy("digest").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("copies"))
    named = stored(named)
    reps = named.select(F.col("rep").alias("uid"), "copies")

    # Buckets: small ones at the first sampled token, others below it.
    nodes = all_sets.where("digest is not null").select("uid", "paths").join(reps.select("uid").hint("merge"), "uid").select("uid", F.explode("paths").alias("p")).select("uid", "p.k1", "p.k2")
    top = nodes.select("uid", "k1").distinct()
    sizes = stored(top.groupBy("k1").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    met = stored(nodes.join(sizes.hint("merge"), "k1"))
    low = met.where((F.col("size") > SMALL) & F.col("k2").isNotNull()).select("uid", F.col("k2").alias("leaf")).distinct()
    low_sizes = low.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    leaves = met.where(F.col("size") <= SMALL).select(F.col("k1").alias("leaf"), "size", "uid").distinct().unionByName(low.join(low_sizes.hint("merge"), "leaf").select("leaf", "size", "uid"))
    groups = components(ties(leaves.join(all_sets.select("uid", "sketch").hint("merge"), "uid")))

    # Exact comparison within groups.
    groups = stored(groups)
    counted = groups.join(apart(groups.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root"), "root").select(F.col("root").alias("comp"), "size", F.col("node").alias("uid")).join(reps, "uid")
    tokens = only(all_sets.select("uid", "tokens"), groups.select(F.col("node").alias("uid")))
    done = stored(verified(counted.join(tokens.hint("merge"), "uid")))
    links = done.groupBy("uid").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("blocks").alias("blocks"))
    wide = components(done.where("blocks > 1").select(F.col("uid").alias("a"), F.col("root").alias("b")))
    links = links.join(wide.withColumnRenamed("root", "wide"), links["uid"] == wide["node"], "left")
    links = links.select("uid", "links", F.when(F.col("blocks") > 1, F.coalesce("wide", "uid")).otherwise(F.col("root")).alias("class_uid"))

    per_set = named.join(links.hint("merge"), named["rep"] == links["uid"], "left").select(F.col("digest").alias("d"), F.coalesce("class_uid", "rep").alias("class_uid"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = all_sets.select("uid", "doc_id", "text_hash", "digest")
    return rows.join(per_set.hint("merge"), rows["digest"] == per_set["d"], "left").select(
        "uid", "doc_id", "text_hash", F.coalesce("class_uid", "uid").alias("class_uid"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class of linked documents) and n_links (documents with a similarity of 0.8 or more, copies included)."""
    rows = cut(classes(docs))
    first = rows.groupBy("class_uid").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(apart(first, "class_uid"), "class_uid").select("doc_id", "class_id", "class_size", "n_links")


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with the first document (by doc_id, then by place) of each class; columns stay as they are."""
    rows = classes(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "uid", "text_hash")).alias("k")
    kept = rows.groupBy("class_uid").agg(first).select(F.col("k.doc_id").alias("k_id"), F.col("k.text_hash").alias("k_hash")).distinct()
    marked = docs.select(whole_rows(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    # Rows equal in id and text are of one class, which keeps one.
    return marked.join(kept, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash"))).dropDuplicates(["id", "hash"]).select("row.*")
