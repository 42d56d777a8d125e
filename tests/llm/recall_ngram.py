"""Recall of the n-gram join on a whole table: its links against all pairs with a similarity of 0.8 or more, found exactly by prefix filtering.

python -m tests.llm.recall_ngram [folder of tables] writes recall_ngram.json beside this file.
"""

from __future__ import annotations

import json
import sys
from collections import Counter, defaultdict
from pathlib import Path

from pyspark.sql import SparkSession

from tessera.llm import ngram_join


def exact(texts: list[str | None]) -> tuple[list[int], int]:
    """Links of each text, and how many pairs of different sets are linked: sets of shingles as tuples of words, nothing hashed."""
    sets, members = {}, defaultdict(list)
    for i, t in enumerate(texts):
        w = ngram_join._WORD.findall(t or "")
        n = min(5, len(w))
        s = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if n else None
        members[s].append(i)
        if s is not None:
            sets.setdefault(s, len(sets))
    distinct = list(sets)
    often = Counter(t for s in distinct for t in s)
    number = {t: k for k, (t, _) in enumerate(sorted(often.items(), key=lambda x: (x[1], x[0])))}
    tokens = [sorted(map(number.__getitem__, s)) for s in distinct]
    links, index, pairs = [0] * len(texts), defaultdict(list), 0
    near = defaultdict(set)
    for k in sorted(range(len(distinct)), key=lambda k: len(tokens[k])):
        own, size = tokens[k], len(tokens[k])
        met = {j for t in own[: size - (4 * size + 4) // 5 + 1] for j in index[t]}
        mine = set(own)
        for j in met:
            both = len(mine.intersection(tokens[j]))
            if 9 * both >= 4 * (size + len(tokens[j])):
                near[k].add(j)
                near[j].add(k)
                pairs += 1
        for t in own[: size - (4 * size + 4) // 5 + 1]:
            index[t].append(k)
    for k, s in enumerate(distinct):
        n = len(members[s]) - 1 + sum(len(members[distinct[j]]) for j in near[k])
        for i in members[s]:
            links[i] = n
    return links, pairs


def main(folder: str) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want, pairs = exact([r["text"] for r in rows])
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.joined(docs).select("doc_id", "n_links").collect()}
    found = sum(min(got[r["doc_id"]], n) for r, n in zip(rows, want))
    result = {
        "table": Path(folder).name, "documents": len(rows), "links_exact": sum(want), "links_found": found, "recall": round(found / max(1, sum(want)), 6),
        "links_too_many": sum(max(0, got[r["doc_id"]] - n) for r, n in zip(rows, want)), "linked_pairs_of_different_sets": pairs,
    }
    out = Path(__file__).with_suffix(".json")
    held = json.loads(out.read_text()) if out.exists() else {}
    out.write_text(json.dumps(held | {result["table"]: result}, indent=1) + "\n")
    print(result)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
