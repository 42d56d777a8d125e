"""Quality rules by weak supervision.

Each of ten rules looks at a whole text and votes good, bad or abstains. The votes of all documents are
counted by pattern, expectation-maximisation estimates how often each rule votes bad on good
and on bad documents, and a document stays if its posterior probability of being good is 0.5 or more. So one bad vote of a rule that
also fires on good documents doesn't reject a text, and several weak ones do.

Everything over documents is DataFrame expressions. There are ten rules with three votes each, so
there are at most 3 ** 10 = 59,049 patterns, whatever the corpus: that bounded count table is what the
driver reads for the estimation, and the posterior goes back as a sum of 31 constants per row. No document is exchanged.

Defined cases: a null text counts as an empty one; a text with fewer than 20 words, or with over
30 % of its words in repeated eight-word windows, fails the base rules and is never kept (the rules abstain on the former); an empty
table gives an empty result; equal texts get equal verdicts; other columns are left alone.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, let, whole_rows, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
ABSTAIN, GOOD, BAD = 0, 1, 2
RULES = ("symbols", "letters", "bare_words", "capitals", "exclamations", "sentence_ends", "adjacent_words", "variety", "duplicate_lines", "word_length")
#: What is believed before any vote is seen, as counts of imagined documents: good and bad ones, and bad and good votes of a rule on bad and on good documents.
PRIOR, PRIOR_CAUGHT, PRIOR_ALARM = (8, 2), (1, 2), (1, 19)


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; windows are numbered by their first word."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(
        ordered,
        lambda s: F.filter(
            s,
            lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
        ),
    )
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
    return F.aggregate(starts, zero, step, lambda a: a["n"])


def repeated_words(w: Column) -> Column:
    """Words of array w in eight-word windows that occur twice or more. Windows are compared by 64-bit hashes."""
    hashes = let(
        F.transform(w, lambda x: F.xxhash64(x)),
        lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))),
    )
    # Most texts repeat no window: one hash set settles them, and only the others are sorted.
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))
    return F.when(F.size(w) > WINDOW, found).otherwise(F.lit(0).cast("long"))


def measures(df: DataFrame, keys: list[Column]) -> DataFrame:
    """keys and the measures of df.text, a row for each row of df."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda x, name: x.cast("long").alias(name)
    of_words = let(
        words(F.col("text")),
        lambda w: F.struct(
            long(F.size(w), "n_words"), long(F.length(F.array_join(w, "")), "word_chars"), long(repeated_words(w), "n_repeat_words"), long(F.size(F.array_distinct(w)), "n_distinct"),
            long(F.size(F.filter(w, lambda x: ~x.rlike(r"[\p{L}\p{N}]"))), "n_bare"), long(F.size(F.filter(w, lambda x: F.substring(x, -1, 1).isin(".", "!", "?"))), "n_ends"),
            long(F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))), "n_adjacent"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(long(F.size(x), "n_lines"), long(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines")))
    counts = {"n_symbols": SYMBOLS, "n_capitals": r"\p{Lu}", "n_exclamations": "!", "n_other": r"[^\p{L}\x20\x09-\x0D]"}
    counted = [long(F.regexp_count(text, F.lit(pattern)), name) for name, pattern in counts.items()]
    return df.select(*keys, of_words.alias("w"), of_lines.alias("l"), *counted).select(*[F.col(c) for c in df.select(*keys).columns], "w.*", "l.*", *counts)


def votes() -> dict[str, Column]:
    """A vote of each rule, from the columns of measures(); none for a text too short for the base rules."""
    n, lines, letters = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1)), F.col("word_chars") - F.col("n_other")
    per_word = lambda c: F.col(c) / n
    variety = F.col("n_distinct") / F.sqrt(n)
    vote = lambda bad, good: F.when(F.col("n_words") < MIN_WORDS, ABSTAIN).when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)
    out = {
        "symbols": vote(per_word("n_symbols") >= 0.1, per_word("n_symbols") <= 0.02),
        "letters": vote(letters < 0.8 * F.col("word_chars"), letters >= 0.9 * F.col("word_chars")),
        "bare_words": vote(per_word("n_bare") >= 0.1, per_word("n_bare") <= 0.02),
        "capitals": vote(F.col("n_capitals") >= 0.3 * letters, F.col("n_capitals") <= 0.1 * letters),
        "exclamations": vote(per_word("n_exclamations") >= 0.2, per_word("n_exclamations") <= 0.05),
        "sentence_ends": vote((per_word("n_ends") < 0.01) | (per_word("n_ends") > 0.3), per_word("n_ends").between(0.02, 0.2)),
        "adjacent_words": vote(per_word("n_adjacent") >= 0.1, per_word("n_adjacent") <= 0.03),
        "variety": vote(variety < 3, variety >= 4.5),
        "duplicate_lines": vote(F.col("n_dup_lines") / lines >= 0.3, (F.col("n_dup_lines") == 0) & (F.col("n_lines") > 2)),
        "word_length": vote((per_word("word_chars") < 3.5) | (per_word("word_chars") > 7), per_word("word_chars").between(4, 6.5)),
    }
    assert tuple(out) == RULES
    return out


def pattern(cast: dict[str, Column]) -> Column:
    return sum((cast[r] * 3**k for k, r in enumerate(RULES)), F.lit(0))


def rates(counts: dict[int, int], rounds: int = 500, tolerance: float = 1e-9) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: the share of good documents, and by rule the shares of bad votes on bad documents (caught) and on good ones (alarms).

    Given the class, votes are independent, and whether a rule abstains says nothing. The start takes a document for the worse the more bad votes
    it has. The imagined documents of PRIOR keep rates of rules that hardly vote off 0 and 1; they are a handful beside any corpus.
    """
    seen = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[p] for p in seen.tolist()], dtype=float)
    cast = seen[:, None] // 3 ** np.arange(len(RULES)) % 3
    bad, voted = (cast == BAD).astype(float), (cast != ABSTAIN).astype(float)
    good = np.where(bad.sum(1) == 0, 0.95, np.maximum(0.05, 0.5 - 0.2 * bad.sum(1)))
    share = lambda weight, prior: (weight @ bad + prior[0]) / (weight @ voted + sum(prior))
    for _ in range(rounds):
        prior, caught, alarms = (n @ good + PRIOR[0]) / (n.sum() + sum(PRIOR)), share(n * (1 - good), PRIOR_CAUGHT), share(n * good, PRIOR_ALARM)
        odds = np.log(prior / (1 - prior)) + bad @ np.log(alarms / caught) + (voted - bad) @ np.log((1 - alarms) / (1 - caught))
        before, good = good, 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(good - before).max(initial=0) <= tolerance:
            break
    return float(prior), caught, alarms


def estimate(counts: dict[int, int]) -> tuple[float, list[list[float]]]:
    """The prior log-odds of good, and by rule the log-odds that each vote adds."""
    prior, caught, alarms = rates(counts)
    return math.log(prior / (1 - prior)), [[0.0, math.log((1 - a) / (1 - c)), math.log(a / c)] for c, a in zip(caught.tolist(), alarms.tolist())]


def counted(voted: DataFrame) -> dict[int, int]:
    """Documents by vote pattern: one row for each pattern there is, 59,049 at most."""
    return {r[0]: r[1] for r in voted.groupBy(pattern({r: F.col(f"vote_{r}").cast("int") for r in RULES}).alias("pattern")).count().collect()}


def with_votes(df: DataFrame, keys: list[Column]) -> DataFrame:
    return measures(df, keys).withColumns({f"vote_{r}": v.cast("tinyint") for r, v in votes().items()})


def verdict(counts: dict[int, int]) -> tuple[Column, Column, Column]:
    """base_failed, the log-odds of good and kept, from the columns of with_votes()."""
    prior, added = estimate(counts)
    odds = F.lit(prior)
    for k, r in enumerate(RULES):
        cast = F.col(f"vote_{r}")
        odds = odds + F.when(cast == GOOD, F.lit(added[k][GOOD])).when(cast == BAD, F.lit(added[k][BAD])).otherwise(F.lit(added[k][ABSTAIN]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return failed, odds, ~failed & (odds >= 0)


def judged(df: DataFrame, keys: list[Column]) -> DataFrame:
    """keys, the base measures, base_failed, p_good and kept, a row for each row of df (which needs a column text)."""
    names = df.select(*keys).columns
    seen = cut(with_votes(df, keys))
    failed, odds, kept = verdict(counted(seen))
    return seen.select(
        *names,
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        failed.alias("base_failed"),
        (1 / (1 + F.exp(-odds))).alias("p_good"),
        kept.alias("kept"),
    )


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return judged(table(spark, sf_dir, "documents"), [F.col("doc_id")])


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without what is judged bad; all columns and repeated rows stay as they are.

    A verdict follows from the text and the estimated rates alone, so texts are measured once for the rates and once more for the verdicts, and no
    document is joined or exchanged.
    """
    _, _, kept = verdict(counted(with_votes(docs.select("text"), [])))
    return with_votes(docs, [whole_rows(docs).alias("row")]).where(kept).select("row.*")
