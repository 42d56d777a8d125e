import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.llm import mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark, docs):
    texts = [r["text"] for r in docs.collect()] + ["a b c d e f g h a b c d e f g h a", "x\nx\n\n \ny | $ x\nx", "w " * 9, "a b c d e f g h"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.judged(df, [F.col("doc_id")]).collect():
        want = measured(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


RULES = len(quality_rules.RULES)


def encoded(bad: tuple = (), none: tuple = ()) -> int:
    return sum((quality_rules.BAD if k in bad else quality_rules.ABSTAIN if k in none else quality_rules.GOOD) * 3**k for k in range(RULES))


#: Rule 0 also fires on many good documents; rules 1 to 3 fire together on bad ones; 4 and 5 are so-so.
CORPUS = {
    encoded(): 8000, encoded((0,)): 400, encoded((1, 2, 3)): 200, encoded((1, 2, 3, 4)): 300, encoded((0, 1, 2)): 60, encoded((2, 3, 5)): 300,
    encoded((4,)): 40, encoded((5,)): 40, encoded((4, 5, 1)): 40, encoded((), (0, 8)): 900, encoded((1,), (2,)): 12,
}


def odds(counts: dict, bad: tuple = ()) -> float:
    prior, added = quality_rules.estimate(counts)
    return prior + sum(a[quality_rules.BAD if k in bad else quality_rules.GOOD] for k, a in enumerate(added))


def test_rates_equal_brute_force():
    """The same estimation, a document at a time."""
    docs = [[p // 3**k % 3 for k in range(RULES)] for p, n in CORPUS.items() for _ in range(n // 10)]
    good = [0.95 if 2 not in d else max(0.05, 0.5 - 0.2 * d.count(2)) for d in docs]
    for _ in range(500):
        prior = (sum(good) + 8) / (len(docs) + 10)
        caught, alarms = [], []
        for k in range(RULES):
            voted = [(g, d[k] == 2) for g, d in zip(good, docs) if d[k]]
            caught.append((sum(1 - g for g, v in voted if v) + 1) / (sum(1 - g for g, _ in voted) + 3))
            alarms.append((sum(g for g, v in voted if v) + 1) / (sum(g for g, _ in voted) + 20))
        new = []
        for d in docs:
            y, x = prior, 1 - prior
            for k, v in enumerate(d):
                y *= alarms[k] if v == 2 else 1 - alarms[k] if v else 1
                x *= caught[k] if v == 2 else 1 - caught[k] if v else 1
            new.append(y / (y + x))
        off, good = max(abs(a - b) for a, b in zip(good, new)), new
        if off <= 1e-9:
            break
    got = quality_rules.rates({p: n // 10 for p, n in CORPUS.items() if n // 10})
    assert abs(got[0] - prior) < 1e-6
    assert max(abs(a - b) for a, b in zip([*got[1], *got[2]], [*caught, *alarms])) < 1e-6


def test_votes_are_weighed_and_not_all_must_pass():
    assert odds(CORPUS) > 0
    assert odds(CORPUS, (0,)) > 0 and odds(CORPUS, (4,)) > 0 and odds(CORPUS, (5,)) > 0  # one bad vote of a poor rule
    assert odds(CORPUS, (4, 5)) < 0  # two of them
    assert odds(CORPUS, (2,)) < 0 and odds(CORPUS, (1, 2, 3)) < 0  # rules that are right
    _, caught, alarms = quality_rules.rates(CORPUS)
    assert alarms[0] > 20 * alarms[2] and caught[2] > caught[4]


def test_all_good_stays():
    assert odds({encoded(): 100}) > 0
    assert odds({}) > 0
    assert odds({encoded(none=tuple(range(RULES))): 50}) > 0


def test_junk_goes_and_prose_stays(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeilmnorst") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() + ("." if i % 12 == 11 else "") for i in range(n))
    texts = [(prose(r.randint(60, 400)), True) for _ in range(150)]
    texts += [("TERMS\n" * 8 + prose(90) + "\n" + prose(60), True) for _ in range(6)]  # one rule fires: duplicate lines
    texts += [(" | ".join(word() for _ in range(80)), False) for _ in range(8)] + [(" ".join(word().upper() + "!!" for _ in range(90)), False) for _ in range(8)]
    texts += [(" ".join(word() + r.choice("#%&$") * 3 for _ in range(90)), False) for _ in range(8)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {x["doc_id"]: x["kept"] for x in quality_rules.judged(df, [F.col("doc_id")]).collect()}
    assert [got[i] for i in range(len(texts))] == [y for _, y in texts]


def test_keep_good_keeps_rows_and_columns(spark, docs, no_docs):
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    verdict = {(r["doc_id"], r["text"]): r["kept"] for r in quality_rules.judged(docs, [F.col("doc_id"), F.col("text")]).collect()}
    assert got == Counter((r["doc_id"], r["text"]) for r in docs.collect() if verdict[r["doc_id"], r["text"]])
    assert quality_rules.keep_good(no_docs).count() == 0
    assert quality_rules.judged(no_docs, [F.col("doc_id")]).count() == 0


def water(sizes: dict, weights=(5, 2, 1)) -> dict:
    """Targets by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        unit = left / sum(w[s] for s in free)
        over = [s for s in free if unit * w[s] > 3 * sizes[s]]
        if not over:
            return target | {s: unit * w[s] for s in free}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
            free.remove(s)
    return target


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 500, None: 3}, {"a": 1, "b": 1, "c": 1000, "d": 5}, {"x": 7}, {"a": 0, "b": 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        want = water(sizes)
        for r in mixing.targets(df, mixing.WEIGHTS).collect():
            assert abs(r["target"] - want[r["source"]]) < 1e-6


def test_mix(spark, docs, no_docs):
    out = mixing.mixed(docs, ("doc_id", "source")).collect()
    assert len(out) == docs.count()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert {r["source"]: r["source_size"] for r in out} == dict(sizes)
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    again = mixing.mixed(docs, ("doc_id", "source")).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["copies"])
    assert sorted(out, key=key) == sorted(again, key=key)
    assert mixing.mixed(no_docs).count() == 0


def test_mix_comes_near_and_prefix_is_in_key_order(spark):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 4}") for i in range(3000)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), ("doc_id", "source")).collect()
    taken, target = defaultdict(int), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 2


def test_resample_repeats_rows(spark, docs, no_docs):
    out = mixing.resample(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in mixing.mixed(docs, ("doc_id", "source", "text")).collect():
        want[r["doc_id"], r["source"], r["text"]] += r["copies"]
    assert Counter((r["doc_id"], r["source"], r["text"]) for r in out.collect()) == +want
    assert mixing.resample(no_docs).count() == 0


def test_rows_without_id_have_keys_of_their_own(spark):
    rows = [(None, f"{'w ' * (1 + i % 9)}x{i}", "s") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keys = df.select(mixing.order(F.col("doc_id"), F.col("text"), F.lit(1.0), "s").alias("p")).select(F.floor(F.col("p") * 100)).groupBy("FLOOR((p * 100))").count().collect()
    assert len(keys) == 100 and max(r["count"] for r in keys) < 60
