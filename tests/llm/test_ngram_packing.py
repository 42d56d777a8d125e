import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import ngram_join, packing
from tests.llm.conftest import prose
from tests.llm.test_quality_mixing import WORD


def shingles(text):
    w = WORD.findall(text or "")
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def brute(texts: dict):
    """Links and classes of all pairs."""
    sets = {k: shingles(t) for k, t in texts.items()}
    links, root = defaultdict(int), {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x = len(sets[a] & sets[b])
            if x and 9 * x >= 4 * (len(sets[a]) + len(sets[b])):
                links[a] += 1
                links[b] += 1
                a2, b2 = find(a), find(b)
                root[max(a2, b2)] = min(a2, b2)
    return {k: (find(k), links[k]) for k in keys}


def family(seed: int, n: int, words: int, changes: int) -> list[str]:
    r = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, changes)):
            w[r.randrange(len(w))] = "".join(r.choice("klmnop") for _ in range(6))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [256, 3])
def test_join_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "CELL", 16)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    line = "the same line that very many documents share with each other"
    texts = [t for s in range(12) for t in family(s, 6, 30 + 40 * s, 1 + s // 2)] + family(99, 40, 150, 3) + [f"{line} {prose(200 + i, 40)}" for i in range(40)]
    texts += [texts[0], texts[0], "a b c", "a b c", "a b", None, "", " "]
    want = brute(dict(enumerate(texts)))
    out = ngram_join.joined(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out} == want


def test_one_of_each(docs, no_docs):
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns
    rows = docs.collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    seen, want = [], []
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        s = shingles(r["text"])
        if not s or not any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen):
            seen.append(s)
            want.append((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))
    assert got == sorted(want)
    assert ngram_join.one_of_each(no_docs).count() == 0
    assert ngram_join.joined(no_docs).count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(300, k) for k in range(301, 340)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    out = {x["node"]: x["root"] for x in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


ODD = ["ΟΔΟΣ Σ don't I'LL 3.14 \x1c a b İstanbul ﬁ x 中文 12e5 ''s <|endoftext|>", "a b it's'd", "É é Å é", "🙂🙂 ok!!", "\x85q\x00z ﻿", "don't we've x'sy '' 's"]


def test_ids_equal_the_tokenizers(docs):
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(packing.default_tokenizer()), packing.Encoder(packing.default_tokenizer())
    texts = ODD + [r["text"] or "" for r in docs.collect()]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u2").tolist() == [*whole.encode(t, add_special_tokens=False).ids, packing.END]


def test_words_split_alike_on_both_ways():
    """What is split without the pattern is split as by it, for every character."""
    own = packing.Encoder(packing.default_tokenizer())
    for c in map(chr, range(1, 0x11000)):
        if not 0xD800 <= ord(c) < 0xE000 and len((w := c.lower()).split()) == 1:
            for word in (w, "ab" + w, w + ".", "a" + w + "'"):
                assert own.of_word(word) == b"".join(own.merged(x) for x in own.PARTS.findall(word)), ascii(word)


def test_pieces_cover_all_ids(spark, docs, no_docs, monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    rows = [(i, r["text"]) for i, r in enumerate(docs.collect())] + [(100 + i, prose(i, 10 + 37 * i % 900)) for i in range(120)]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, packing.END], "<u4") for i, t in rows}
    at, sequences = defaultdict(int), defaultdict(list)
    for r in sorted(out, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(own) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        at[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert at == {i: len(x) for i, x in ids.items()}
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        total = sum(n for _, n in pieces)
        assert total <= packing.WINDOW and total & (total - 1) == 0
    assert packing.packed(no_docs).count() == 0
    assert {r["doc_id"] for r in packing.packed(docs).collect()} == {r["doc_id"] for r in docs.collect()}


def test_neighbours_are_the_best_by_bm25():
    r = np.random.default_rng(3)
    docs = [r.integers(10, 60, r.integers(5, 80)).astype("<u2") for _ in range(40)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=packing.VOCABULARY)
    idf = np.where(df > 0, np.log(1 + (40 - df + 0.5) / (df + 0.5)), 0)
    mean = np.mean([len(d) for d in docs])
    index = packing.Index(docs, idf, mean)
    for seed in (0, 7, 39):
        score = [sum(idf[t] * (tf := (d == t).sum()) * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) for t in np.unique(docs[seed])) for d in docs]
        near = index.neighbours(seed)
        assert np.allclose(np.array(score)[near], sorted((s for s in score if s > 0), reverse=True))


def test_common_ids_count(spark):
    """Ids in half of all documents decide what no rarer id does."""
    df = np.zeros(packing.VOCABULARY, np.int64)
    df[[10, 11, packing.END]] = 20, 20, 40
    idf = packing.inverse_frequency(df, 40)
    assert idf[10] == idf[11] > 0.6 and idf[packing.END] == idf[12] == 0
    docs = [np.array([10 + i % 2, packing.END], "<u2") for i in range(40)]
    assert packing.Index(docs, idf, 2.0).neighbours(1).tolist() == list(range(1, 40, 2))
    text = {i: ("red " if i % 2 else "blue ") * 1500 for i in range(12)}
    out = packing.packed(spark.createDataFrame(list(text.items()), "doc_id long, text string").coalesce(1)).collect()
    first = min(r["sequence_id"] for r in out)
    assert len({r["doc_id"] % 2 for r in out if r["sequence_id"] == first}) == 1


def test_a_window_holds_its_seed_and_neighbours():
    docs = [(i, np.full(1000, 10 + i % 2, "<u2")) for i in range(8)]
    idf = np.zeros(packing.VOCABULARY)
    idf[10:12] = 1.0
    packer = packing.Packer(idf, 1000.0, 0)
    packer.shard(docs)
    first = [o[0] for o in packer.out if o[5] == 0]
    assert first[:4] == [0, 2, 4, 6] and sum(o[2] for o in packer.out if o[5] == 0) == packing.WINDOW
