"""Packing by lexical retrieval.

Texts become token ids, and a sharded BM25 index over the ids serves as retriever: a seed document opens a window of
4,096 tokens, its best neighbours that are still unused and fit follow, and the best one that doesn't fit is cut to fill the
window to its end; its rest is the next seed. So all windows are full. What is left at the end of a partition is cut into sequences at powers of two, which take no
padding.

A shard is a run of about two million tokens: its index and its windows are one task's work in bounded memory, however many documents there are. Documents are
dealt to shards by their two most telling ids, so that those which share them are neighbours wherever they lay: rare ids tell more than common ones, and the
number of an id stands for how rare it is, as a vocabulary is built from the most common pairs on. Ids that very many documents have in front fill several partitions and shards. Document frequencies and the mean length are those of all documents (the
vocabulary has 49,408 ids, so they are a bounded table). Every id but the end mark counts; in a shard, the weights of the common ones are a matrix instead of postings.

The tokenizer splits a normalised text by one pattern and merges within each part, so words are encoded once per task
and looked up after that; tests hold the ids against the tokenizer's own on whole texts.

Defined cases: a null text counts as an empty one, whose ids are the end mark alone; very long texts are cut over many windows; repeated rows and ids are
documents of their own; documents without a common term follow in their order; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import gc
import itertools
import struct
import unicodedata
import zlib
from operator import attrgetter

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

WINDOW = 4096
END = 2
VOCABULARY = 1 << 16
SHARD_TOKENS = 2_000_000
#: An id in more than this share of a shard's documents has a row of the matrix: four values for each posting at most.
COMMON = 0.25
K1, B = 1.2, 0.75
#: Ids of single bytes come first in the vocabulary.
BYTES = 512
#: Words, and parts that are none, whose ids a task keeps: some 100 MB.
KNOWN_WORDS, KNOWN_MARKS = 500_000, 50_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _letters() -> dict[int, str]:
    """The letter of each byte in a byte-level vocabulary: printable bytes stand for themselves, the others for the letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    more = itertools.count(256)
    return {b: chr(b) if b in plain else chr(next(more)) for b in range(256)}


_ID = attrgetter("id")


class _Lookup(dict):
    """A bounded table that makes what it lacks."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self[key] = self.make(key)
        return found


class Encoder:
    """Ids of whole texts, as little-endian unsigned 16-bit bytes.

    No part crosses white space, so words are looked up as wholes; one that is new is split into parts (letters alone, or with one mark behind
    them, need no pattern), and a new part is merged by the vocabulary's model.
    """

    #: Fixed value: the pattern that splits a normalised text, as in the vocabulary file.
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
    #: What str.split() takes for white space and the vocabulary doesn't.
    SEPARATORS = regex.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.tokenize, self.letters = self.whole.model.tokenize, _letters()
        self.words, self.marks = _Lookup(self.of_word, KNOWN_WORDS), _Lookup(self.merged, KNOWN_MARKS)
        self.end = struct.pack("<H", END)

    def merged(self, part: str) -> bytes:
        # Latin-1 reads each byte as the letter of that number.
        found = self.tokenize(part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(found)}H", *map(_ID, found))

    def part(self, part: str) -> bytes:
        return self.words[part] if part.isalpha() else self.marks[part]

    def of_word(self, word: str) -> bytes:
        if word.isalpha():
            return self.merged(word)
        head = word[:-1]
        if head.isalpha() and word[-1].isprintable() and not word[-1].isalnum():
            return self.words[head] + self.marks[word[-1]]
        return b"".join(map(self.part, self.PARTS.findall(word)))

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes() + self.end
        plain = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if self.SEPARATORS.search(plain):
            return b"".join(map(self.part, self.PARTS.findall(plain))) + self.end
        return b"".join(map(self.words.__getitem__, plain.split())) + self.end


def telling() -> np.ndarray:
    """How much an id tells, by its number alone: nothing for the first ones, which are single bytes."""
    number = np.arange(VOCABULARY)
    return np.log(np.maximum(number, BYTES) / BYTES)


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id (as string) and ids, a row for each row of docs, in the order of their most telling ids within partitions: a stored table.

    A row more for each task holds the task's statistics instead, see statistics().
    """
    tells = telling()

    def rows(frames):
        encoder = Encoder(tokenizer)
        df, n, total = np.zeros(VOCABULARY, "<i8"), 0, 0
        for frame in frames:
            texts = frame["text"].tolist()
            gc.disable()  # the tables hold no cycles, and would be walked over and over as they grow
            try:
                found = [encoder.encode(t or "") for t in texts]
            finally:
                gc.enable()
            routes = np.zeros((len(found), 2), np.int32)
            for k, b in enumerate(found):
                ids, tf = np.unique(np.frombuffer(b, dtype="<u2"), return_counts=True)
                df[ids] += 1
                n, total = n + 1, total + len(b) // 2
                weight = tells[ids] * tf / (tf + K1)
                first = weight.argmax()
                routes[k, 0] = ids[first]
                weight[first] = 0
                routes[k, 1] = ids[weight.argmax()]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": found, "counts": None, "k1": routes[:, 0], "k2": routes[:, 1]})
        counts = zlib.compress(np.append(df, [n, total]).astype("<i8").tobytes(), 1)
        yield pd.DataFrame({"doc_id": [None], "ids": [None], "counts": [counts], "k1": [0], "k2": [0]})

    # Ids pass Python as strings: pandas would turn a column with nulls into floats.
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(rows, "doc_id string, ids binary, counts binary, k1 int, k2 int")
    # Partitions of one id that are too large are split, small ones put together.
    return stored(out.hint("rebalance", "k1").sortWithinPartitions("k1", "k2", "doc_id").drop("k1", "k2"))


def statistics(ids: DataFrame) -> tuple[np.ndarray, int, int]:
    """Document frequency of each id, documents and tokens, over all documents: the sum of what each task counted, 65,538 numbers for a task."""

    def added(frames):
        total = np.zeros(VOCABULARY + 2, np.int64)
        for frame in frames:
            for b in frame["counts"]:
                total += np.frombuffer(zlib.decompress(b), dtype="<i8")
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "n": total[at]})

    found = ids.where("counts is not null").select("counts").mapInPandas(added, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    of = np.zeros(VOCABULARY + 2, np.int64)
    of[found["term"]] = found["n"]
    return of[:VOCABULARY], int(of[VOCABULARY]), int(of[VOCABULARY + 1])


class Index:
    """BM25 postings of a shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        size = np.array([len(x) for x in docs])
        key = np.repeat(np.arange(len(docs), dtype=np.int64) << 16, size) | np.concatenate(docs)
        key.sort()
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        tf = np.diff(np.append(new, len(key)))
        key = key[new]
        term = (key & 0xFFFF).astype(np.uint16)
        use = idf[term] > 0
        term, doc, tf = term[use], key[use] >> 16, tf[use]
        self.own, self.own_start = term.astype(np.int64), np.searchsorted(doc, np.arange(len(docs) + 1))
        order = np.argsort(term, kind="stable")
        self.term, self.doc, tf = term[order].astype(np.int64), doc[order], tf[order]
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.doc] / max(mean, 1.0)))
        self.n = len(docs)
        common = np.flatnonzero(np.bincount(self.term, minlength=VOCABULARY) > COMMON * len(docs))
        self.row = np.full(VOCABULARY, -1)
        self.row[common] = np.arange(len(common))
        at = self.row[self.term]
        self.matrix = np.zeros((len(common), len(docs)))
        self.matrix[at[at >= 0], self.doc[at >= 0]] = self.weight[at >= 0]
        self.term, self.doc, self.weight = self.term[at < 0], self.doc[at < 0], self.weight[at < 0]
        self.start = np.searchsorted(self.term, np.arange(VOCABULARY + 1))

    def neighbours(self, seed: int, among: np.ndarray | None = None) -> np.ndarray:
        """Documents (of those that among marks) that share a term with the seed, best first; ties in their order."""
        terms = self.own[self.own_start[seed] : self.own_start[seed + 1]]
        low, size = self.start[terms], self.start[terms + 1] - self.start[terms]
        total = int(size.sum())
        at = np.arange(total) + np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if total else np.zeros(0, np.int64)
        score = np.bincount(self.doc[at], self.weight[at], self.n).astype(float)
        rows = self.row[terms]
        if len(rows := rows[rows >= 0]):
            held = np.zeros(len(self.matrix))
            held[rows] = 1
            score += held @ self.matrix
        found = np.flatnonzero(score if among is None else score * among)
        return found[np.argsort(-score[found], kind="stable")]


class Packer:
    """Windows of one partition; out holds the finished pieces."""

    def __init__(self, idf: np.ndarray, mean: float, base: int):
        self.idf, self.mean, self.sequence, self.out = idf, mean, base, []
        self.window: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.room = WINDOW

    def put(self, doc, start: int) -> int:
        """Adds of doc what fits, from start on; where its rest begins."""
        doc_id, ids = doc
        n = min(self.room, len(ids) - start)
        self.window.append((doc_id, start, ids[start : start + n], len(ids)))
        self.room -= n
        if not self.room:
            self.close(self.window)
        return start + n

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1
        self.window, self.room = [], WINDOW

    def shard(self, docs: list[tuple]) -> None:
        """Packs (doc_id, ids) of one shard. The last window may stay open for the next shard."""
        index = Index([ids for _, ids in docs], self.idf, self.mean)
        unused = np.ones(len(docs), bool)
        size = [len(ids) for _, ids in docs]
        sizes = np.array(size)
        first, seed, start, near = 0, -1, 0, np.zeros(0, np.int64)
        while True:
            if seed < 0:
                while first < len(docs) and not unused[first]:
                    first += 1
                if first == len(docs):
                    return
                seed, start = first, 0
                unused[seed] = False
            # The seed's rest may fill windows of its own.
            while start < size[seed]:
                start = self.put(docs[seed], start)
            if self.room == WINDOW:
                seed = -1
                continue
            near = index.neighbours(seed, unused)
            seed = -1
            # Of those that fitted when the window was last looked at, in their order.
            for k in near[sizes[near] <= self.room].tolist():
                if size[k] <= self.room:
                    unused[k] = False
                    room = self.room
                    self.put(docs[k], 0)
                    if room == size[k]:
                        break
            if self.room < WINDOW:
                rest = near[unused[near]]
                if len(rest):
                    seed, start = int(rest[0]), 0
                    unused[seed] = False
                    start = self.put(docs[seed], 0)
                    if start == size[seed]:
                        seed = -1

    def end(self) -> None:
        """Cuts an open window into sequences at powers of two."""
        pieces, left = self.window, WINDOW - self.room
        while left:
            take, now = 1 << (left.bit_length() - 1), []
            left -= take
            while take:
                doc_id, start, ids, n = pieces.pop(0)
                now.append((doc_id, start, ids[:take], n))
                if len(ids) > take:
                    pieces.insert(0, (doc_id, start + take, ids[take:], n))
                take -= min(take, len(ids))
            self.close(now)


def inverse_frequency(df: np.ndarray, n: int) -> np.ndarray:
    """Above 0 for each id that occurs but the end mark."""
    idf = np.where(df > 0, np.log(1 + (n - df + 0.5) / (df + 0.5)), 0.0)
    idf[END] = 0.0
    return idf


def packed(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset, a row for each piece of docs (doc_id, text)."""
    ids = tokenized(docs, tokenizer or default_tokenizer())
    df, n, total = statistics(ids)
    idf = inverse_frequency(df, n)
    mean = total / n if n else 1.0
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pieces(frames):
        packer = Packer(idf, mean, TaskContext.get().partitionId() << 40)
        shard, held = [], 0
        take = lambda: pd.DataFrame(packer.out, columns=columns)
        for frame in frames:
            for doc_id, b in zip(frame["doc_id"], frame["ids"]):
                x = np.frombuffer(b, dtype="<u2")
                shard.append((doc_id, x))
                held += len(x)
                if held >= SHARD_TOKENS:
                    packer.shard(shard)
                    yield take()
                    packer.out, shard, held = [], [], 0
        if shard:
            packer.shard(shard)
        packer.end()
        if packer.out:
            yield take()

    out = ids.where("ids is not null").select("doc_id", "ids").mapInPandas(pieces, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
