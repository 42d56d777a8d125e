"""Toxicity scores by a factorization machine over hashed terms.

A text is a set of terms, hashed to 2 ** 18: its lower-cased words, their beginnings of four to eight letters (which inflected
and compound forms share), and marks for beginnings found twice and four times. The score is the logistic value of a bias, a weight
for each term and, for each pair of terms, the inner product of their two factor vectors, so that a pair can mean more
than its parts (an insult next to a group's name). All pairs cost as much as all terms: half of the squared norm of the factors' sum
less the sum of their squared norms.

The model is fitted on a bounded sample of labelled rows: the 20,000 (SAMPLE) with the smallest hash of the id among those
that may be learned from, one text for each. One task of an executor fits it; only counts of terms and the model reach the driver. The model keeps terms that four or more of them hold and whose association with the
label is beyond chance (chi-square of 10 or more), alone or in the texts that hold a term kept for itself (there beyond what the best of all
such pairs reaches by chance); others would only describe single documents. Scoring
reads every whole text once, without any exchange; the model that goes to the executors has 2 ** 18 terms at most.

Defined cases: a null or empty text has no terms and gets the bias alone; without labels to learn from every score is just below 0.5 and
no document is marked; a label whose id is absent is not used; an id with several labels is not learned from if they differ, and of several texts with one id
one is learned from; equal texts get equal scores; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

DIM = 1 << 18
SAMPLE = 20_000
FACTORS = 4
EPOCHS = 12
LEAST_DOCS = 4
LEAST_CHI_SQUARE = 10.0
BEGINNINGS = range(4, 9)
MARKS = ((1, "p"), (2, "2"), (4, "4"))
#: Words whose terms a reader keeps, and texts it reads at a time.
MOST_WORDS, SLICE = 300_000, 500
_PLAIN = zlib.crc32(b"p")
_WORD = re.compile(r"\w+")


def term(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & (DIM - 1)


def beginnings(word: str) -> list[str]:
    return [word[:k] for k in BEGINNINGS if len(word) >= k]


def terms(text: str | None) -> set[int]:
    """Hashed terms of a text."""
    counts = Counter(_WORD.findall(text.lower())) if text else {}
    starts: Counter[str] = Counter()
    for w, n in counts.items():
        for b in beginnings(w):
            starts[b] += n
    return {term("w" + w) for w in counts} | {term(mark + b) for b, n in starts.items() for least, mark in MARKS if n >= least}


class Model:
    """Weights and factors of the terms it knows; place maps a hashed term to its row."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, factor: np.ndarray, bias: float):
        self.ids, self.weight, self.factor, self.bias = ids, weight, factor, bias
        self.place = np.full(DIM, -1, dtype=np.int32)
        self.place[ids] = np.arange(len(ids))
        self.square = (factor * factor).sum(1)

    def logit_of_rows(self, at: np.ndarray) -> float:
        if not len(at):
            return float(self.bias)
        total = self.factor[at].sum(0)
        return float(self.bias + self.weight[at].sum() + 0.5 * (total @ total - self.square[at].sum()))

    def logit(self, found: set[int]) -> float:
        at = self.place[np.fromiter(found, dtype=np.int64, count=len(found))]
        return self.logit_of_rows(np.sort(at[at >= 0]))

    def score(self, text: str | None) -> float:
        return Reader(self).scores([text])[0]


class _Numbers(dict):
    """Words a reader has met, with their numbers."""

    def __init__(self, add):
        self.add = add

    def __missing__(self, word: str) -> int:
        n = self[word] = self.add(word)
        return n


class Reader:
    """Finds the rows of a model's terms in texts. What the model knows of a word is looked up once, and kept for up to MOST_WORDS words.

    A term is the CRC-32 of a mark and a word or beginning. The CRC of longer beginnings goes on from that of shorter ones, and other marks change it by a constant for each length.
    """

    def __init__(self, model: Model):
        self.model, self.place = model, model.place.tolist()
        self.shift: dict[int, tuple[int, int, int]] = {}
        self.clear()

    def clear(self) -> None:
        self.words = _Numbers(self.add)
        self.begun: dict[str, int] = {}
        # By word: its row, and where its beginnings lie in flat; by beginning: its rows for each mark.
        self.own, self.start, self.size, self.flat, self.rows = (array("i") for _ in range(5))

    def shifts(self, n: int) -> tuple[int, int, int]:
        """What the marks of words, of beginnings met twice and of those met four times change in the CRC of a plain beginning of n bytes."""
        found = self.shift.get(n)
        if found is None:
            zeros = bytes(n)
            found = self.shift[n] = tuple(zlib.crc32(m + zeros) ^ zlib.crc32(b"p" + zeros) for m in (b"w", b"2", b"4"))
        return found

    def add(self, word: str) -> int:
        place, mask = self.place, DIM - 1
        crc, n, at = _PLAIN, 0, len(self.flat)
        for k in BEGINNINGS:
            if len(word) < k:
                break
            part = (word[:k] if n == 0 else word[k - 1]).encode("utf-8", "surrogatepass")
            crc, n = zlib.crc32(part, crc), n + len(part)
            _, two, four = self.shifts(n)
            rows = place[crc & mask], place[(crc ^ two) & mask], place[(crc ^ four) & mask]
            if max(rows) >= 0:
                begun = self.begun.setdefault(word[:k], len(self.begun))
                if 3 * begun == len(self.rows):
                    self.rows.extend(rows)
                self.flat.append(begun)
        else:
            k += 1
        rest = word[k - 1 :] if n else word
        part = rest.encode("utf-8", "surrogatepass")
        crc, n = zlib.crc32(part, crc), n + len(part)
        self.own.append(place[(crc ^ self.shifts(n)[0]) & mask])
        self.start.append(at)
        self.size.append(len(self.flat) - at)
        return len(self.own) - 1

    def found(self, texts: list) -> list[np.ndarray]:
        """For each text the rows of the model's terms in it, sorted."""
        if len(self.words) > MOST_WORDS:
            self.clear()
        numbers = [array("i", map(self.words.__getitem__, _WORD.findall(t.lower()))) if t else array("i") for t in texts]
        view = lambda x: np.frombuffer(x, dtype=np.int32) if len(x) else np.zeros(0, np.int32)
        own, start, size, flat, rows = (view(x) for x in (self.own, self.start, self.size, self.flat, self.rows))
        rows = rows.reshape(-1, 3)
        out = []
        for words in map(view, numbers):
            n = size[words]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            begun, met = np.unique(flat[np.arange(total) + np.repeat(start[words] - (ends - n), n)], return_counts=True)
            at = np.concatenate([own[words], *(rows[begun[met >= least], k] for k, (least, _) in enumerate(MARKS))])
            out.append(np.unique(at[at >= 0]))
        return out

    def scores(self, texts: list) -> list[float]:
        logits = np.array([self.model.logit_of_rows(at) for at in self.found(texts)])
        return (1 / (1 + np.exp(-np.clip(logits, -30, 30)))).tolist()


def associated(df: np.ndarray, both: np.ndarray, n: int, m: int) -> np.ndarray:
    """Chi-square of each term with the label, from how many of n sets and of the m marked ones hold it; 0 for terms of fewer than LEAST_DOCS sets."""
    df, both = df.astype(float), both.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (both * (n - m - df + both) - (df - both) * (m - both)) ** 2 / (df * (n - df) * m * (n - m))
    return np.where(np.isfinite(chi) & (df >= LEAST_DOCS), chi, 0.0)


def paired(sets: list[np.ndarray], marked: np.ndarray, first: np.ndarray, size: int = DIM) -> np.ndarray:
    """Terms (below size) that are associated with the label among the sets that hold a term of first, all pairs taken together."""
    if not len(first):
        return first
    place = np.full(size, -1, dtype=np.int32)
    place[first] = np.arange(len(first))
    held = [p[p >= 0] for p in (place[x] for x in sets)]
    of, row = np.concatenate(held), np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in held])
    order = np.argsort(of, kind="stable")
    holders = np.split(row[order], np.searchsorted(of[order], np.arange(1, len(first))))

    def counted(rows: np.ndarray) -> np.ndarray:
        df = np.zeros(size, np.int32)
        for at in range(0, len(rows), 500):
            df += np.bincount(np.concatenate([sets[r] for r in rows[at : at + 500]]), minlength=size).astype(np.int32)
        return df

    best, tests = np.zeros(size), 0
    for own in holders:
        m = int(marked[own].sum())
        if 0 < m < len(own):
            df, both = counted(own), counted(own[marked[own] > 0])
            some = np.flatnonzero(df >= LEAST_DOCS)
            # Chi-square needs an expected set of each kind.
            some = some[df[some].astype(float) * min(m, len(own) - m) >= len(own)]
            best[some] = np.maximum(best[some], associated(df[some], both[some], len(own), m))
            tests += len(some)
    return np.flatnonzero(best >= max(LEAST_CHI_SQUARE, 2 * np.log(max(tests, 1))))


def fit(sets: list[np.ndarray], marked: np.ndarray, ids: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7, rate: float = 0.1, shrink: float = 2e-4) -> Model:
    """Minimises the logistic loss over terms ids by AdaGrad over batches, in the order of a fixed random generator."""
    if not len(sets) or marked.min() == marked.max():
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, factors)), -1e-6 if not len(sets) else (20.0 if marked[0] else -20.0))
    place = np.full(DIM, -1, dtype=np.int64)
    place[ids] = np.arange(len(ids))
    # The last row stands for the bias and for padding: in every set, with no factors.
    rows = [np.append(p[p >= 0], len(ids)) for p in (place[s] for s in sets)]
    rng = np.random.default_rng(seed)
    w = np.zeros(len(ids) + 1)
    v = rng.normal(0, 0.02, (len(ids) + 1, factors))
    v[-1] = 0
    gw, gv = np.full(len(w), 1e-3), np.full(v.shape, 1e-3)
    w[-1] = np.log(marked.mean() / (1 - marked.mean()))
    for _ in range(epochs):
        deal = rng.permutation(len(rows))
        for at in range(0, len(deal), 32):
            batch = deal[at : at + 32]
            own = [rows[i] for i in batch]
            size = np.array([len(x) for x in own])
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            idx = np.concatenate(own)
            vi = v[idx]
            total = np.add.reduceat(vi, starts)
            logit = np.add.reduceat(w[idx], starts) + 0.5 * ((total * total).sum(1) - np.add.reduceat((vi * vi).sum(1), starts))
            off = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - marked[batch]
            each = np.repeat(off, size) / len(batch)
            some, back = np.unique(idx, return_inverse=True)
            dw = np.bincount(back, each, len(some)) + shrink * w[some]
            pull = each[:, None] * (np.repeat(total, size, axis=0) - vi)
            dv = np.stack([np.bincount(back, pull[:, f], len(some)) for f in range(factors)], 1) + shrink * v[some]
            dv[some == len(ids)] = 0
            gw[some] += dw * dw
            gv[some] += dv * dv
            w[some] -= rate * dw / np.sqrt(gw[some])
            v[some] -= 0.2 * rate * dv / np.sqrt(gv[some])
    return Model(ids, w[:-1], v[:-1], float(w[-1]))


def fitted(sets: list[np.ndarray], marked: np.ndarray, frequent: np.ndarray, first: np.ndarray) -> Model:
    """A model from sets of terms, of which those in frequent count (both sorted); first are the terms kept for themselves."""
    place = np.full(DIM, -1, dtype=np.int32)
    place[frequent] = np.arange(len(frequent))
    sets = [p[p >= 0] for p in (place[x] for x in sets)]
    keep = np.zeros(len(frequent), bool)
    keep[place[first]] = True
    keep[paired(sets, marked, place[first], len(frequent))] = True
    return fit([frequent[x[keep[x]]] for x in sets], marked, frequent[keep])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), of which at most sample rows are read.

    The sample's sets stay on the executors, in a checkpoint. The driver gets how many sets hold each of the 2 ** 18 terms, and one task
    reads the sets without the terms that fewer than LEAST_DOCS of them hold and gives the model: a row a term.
    """
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    chosen = one.where("toxic = most").select("doc_id", (F.col("toxic") > 0).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def sets(frames):
        for frame in frames:
            got = [np.array(sorted(terms(t)), dtype="<i4").tobytes() for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "toxic": frame["toxic"], "terms": got})

    # At most sample rows of two values: small enough to be sent to every executor.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").mapInPandas(sets, "doc_id long, toxic boolean, terms binary")
    # One row an id, however often it occurs, so that the sample bounds what follows.
    seen = cut(found.groupBy("doc_id").agg(F.min(F.struct("terms", "toxic")).alias("r")).select("doc_id", "r.toxic", "r.terms"))

    def counts(frames):
        df, both = np.zeros(DIM, np.int64), np.zeros(DIM, np.int64)
        n = m = 0
        for frame in frames:
            for y, b in zip(frame["toxic"], frame["terms"]):
                df[at := np.frombuffer(b, dtype="<i4")] += 1
                n, m = n + 1, m + bool(y)
                if y:
                    both[at] += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.append(at, -1), "df": np.append(df[at], n), "both": np.append(both[at], m)})

    total = seen.mapInPandas(counts, "term int, df long, both long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("both").alias("both"))
    total = total.where((F.col("df") >= LEAST_DOCS) | (F.col("term") < 0)).toPandas()
    df, both = np.zeros(DIM + 1, np.int64), np.zeros(DIM + 1, np.int64)
    df[total["term"]], both[total["term"]] = total["df"], total["both"]
    first = np.flatnonzero(associated(df[:-1], both[:-1], df[-1], both[-1]) >= LEAST_CHI_SQUARE)
    frequent = np.flatnonzero(df[:-1] >= LEAST_DOCS)
    bits = np.packbits(df[:-1] >= LEAST_DOCS)

    def kept(frames):
        known = np.unpackbits(bits).astype(bool)
        for frame in frames:
            yield frame.assign(terms=[at[known[at]].tobytes() for at in (np.frombuffer(b, dtype="<i4") for b in frame["terms"])])

    def model(frames):
        ids, marked, own = [], [], []
        for frame in frames:
            ids += frame["doc_id"].tolist()
            marked += frame["toxic"].tolist()
            own += [np.frombuffer(b, dtype="<i4") for b in frame["terms"]]
        order = np.argsort(np.array(ids, dtype=np.int64), kind="stable")  # reruns agree
        made = fitted([own[k] for k in order], np.array(marked, dtype=float)[order], frequent, first)
        terms = np.append(made.ids, -1)
        yield pd.DataFrame({"term": terms, "weight": np.append(made.weight, made.bias), "factor": [*made.factor, np.zeros(made.factor.shape[1])]})

    # The sample is one task's work: at most sample sets.
    rows = seen.mapInPandas(kept, seen.schema).repartition(1).mapInPandas(model, "term long, weight double, factor array<double>").toPandas().sort_values("term")
    if not len(rows):  # no set, no task
        return fit([], np.zeros(0), np.zeros(0, np.int64))
    bias, rows = float(rows["weight"].iloc[0]), rows.iloc[1:]
    factor = np.vstack(rows["factor"].to_numpy()) if len(rows) else np.zeros((0, FACTORS))
    return Model(rows["term"].to_numpy(dtype=np.int64), rows["weight"].to_numpy(dtype=float), factor, bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, a row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((model.ids, model.weight, model.factor, model.bias))

    def score(frames):
        own = Reader(Model(*shared.value))
        for frame in frames:
            texts = frame["text"].tolist()
            got = [x for at in range(0, len(texts), SLICE) for x in own.scores(texts[at : at + SLICE])]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": got})

    # Ids pass Python as strings: pandas would turn a column with nulls into floats.
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(score, "doc_id string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    out = scored(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
