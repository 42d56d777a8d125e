import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from tessera.llm import resampling
from tessera.llm.words import cut_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text, order):
    w = WORD.findall(lower(text))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, order=1):
    found = [features(t, order) for _, t in docs]
    s = Counter(b for _, f in found for b in f)
    t = Counter(b for x in target for b in features(x, order)[1])
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in s}
    out = []
    for (i, _), (n, f) in zip(docs, found):
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = Counter()
    ranks = {}
    for k, x in enumerate(able[: 10 * len(able) // 100], 1):
        ranks.setdefault(x[:4], []).append(k)
    for x in out:
        own = ranks.get(x[:4], [])
        at = drawn[x[:4]]
        drawn[x[:4]] += 1
        yield (*x[:4], own[at] if at < len(own) else None)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


TARGET = ["abc hij Straße ÀÉ x9", None, "", "the the ABC_def"]


def test_words_equal_the_pattern():
    for text in ["", None, "A-b_c`d{e}~f", "Éa ÉA\x00b\tc\nD9٣é", "ab cd ſK", "x" * 100_000]:
        assert [w.decode() for w in cut_words(text.encode() if text is not None else None)] == WORD.findall(lower(text))


def test_equals_brute_force_on_odd_rows(spark, docs):
    """Nulls in every column, empty and very long texts, repeated rows and ids, near copies, clashing names."""
    target = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TARGET)], "item_id long, text string, score string")
    more = docs.select("doc_id", "text").unionByName(spark.range(1000, 1300).selectExpr("id doc_id", "concat(repeat('abc hij klm ', 7 + id % 5), repeat('zz ', id % 9)) text"))
    plain = [(r["doc_id"], r["text"]) for r in more.collect()]
    for order in (1, 2):
        got = rows_of(resampling.resampled(more.withColumn("score", more.text).withColumn("rank", more.doc_id), target, order=order))
        assert got == sorted(brute(plain, TARGET, order), key=str)


def test_hot_rows_share_ranks_out(spark):
    """A third of all rows are one row: all counted, each drawn one with a rank of its own."""
    df = spark.range(0, 3000).selectExpr("if(id % 3 = 0, 7, id) doc_id", "repeat(if(id % 3 = 0, 'abc def ', concat('w', id, ' ')), 15) text").repartition(6)
    target = spark.createDataFrame([("abc def",)], "text string")
    plain = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = rows_of(resampling.resampled(df, target))
    assert got == sorted(brute(plain, ["abc def"]), key=str)
    ranks = [r[4] for r in got if r[4]]
    assert sorted(ranks) == list(range(1, len(ranks) + 1)) and len(ranks) == 10 * sum(r[1] >= 20 for r in got) // 100


def test_empty_tables(spark, no_docs, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resampled(no_docs, none).collect() == []
    assert rows_of(resampling.resampled(docs, none)) == sorted(brute([(r["doc_id"], r["text"]) for r in docs.collect()], []), key=str)


def test_gain_is_taken_in_doubles():
    big = np.zeros(10_000, np.int64)
    big[3] = 2**60
    assert resampling.gains(big, big)[3] == 0
