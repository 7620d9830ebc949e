"""Operator 13 against exhaustive scoring."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from bookpulse.llm import ranked_search


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=20):
    counted = [(d, Counter(t), len(t)) for d, t in ((d, terms_of(t)) for d, t in docs) if t]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    queries = {}
    for item, text in set(items):
        if item is not None:
            queries.setdefault(item, Counter()).update(terms_of(text))
    out = []
    for item, asked in queries.items():
        scores = []
        for doc, c, n in counted:
            m = 100 - 25 + 25 * n * n_docs // length
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
                for t, times in asked.items() if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def found(docs, items, **options):
    return sorted((tuple(r) for r in ranked_search.search(docs, items, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"shard": 40, "block_bytes": 200}, {"top": 3, "shard": 7}])
def test_against_exhaustive_scores(spark, monkeypatch, options):
    monkeypatch.setattr(ranked_search, "CHUNK", 2)
    r = random.Random(13)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)] + ["É", "The", "THE", "12", "x-y"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 40, 90])))) for i in range(260)]
    docs += [(d, "copy of w1 w2 w3") for d in (900, 901, 901, 902, None)] * 4  # ties across the 20th place
    docs += [(None, None), (700, None), (701, ""), (702, " !\n"), (703, "w1 w2 " * 9000), (704, "zebra"), (None, "zebra")]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 25)))) for i in range(30)]
    items += [(40, "w1 w2 w3 copy"), (41, "zebra zebra Zebra"), (42, "nowhere"), (43, ""), (44, None), (None, "w1"), (45, "of"),
              (46, "w1 w5"), (46, "w5 w7"), (46, "w1 w5"), (47, "w3 w4 " * 300)]
    clashing = [f"'old' AS {c}" for c in ("term", "times", "item", "score", "rank", "salt", "block")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *clashing).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", *clashing)
    assert found(df, bench, **options) == brute(docs, items, options.get("top", 20))


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert found(none, items) == [] and found(some, items.limit(0)) == []
    assert found(some, items) == brute([(1, "a")], [(1, "a b")])
    assert found(spark.createDataFrame([(1, None), (2, "!")], "doc_id long, text string"), items) == []


def test_lists_are_abandoned():
    """With a good k-th score known, long lists of common terms are hardly read."""
    r = np.random.default_rng(5)
    n, rare = 3000, 20  # four terms in 20 documents, four in all
    corpus = ranked_search.Corpus(n, 8 * n, np.array([7000] * 4 + [500] * 4))
    terms = [list(range(8)) if d < rare else list(range(4, 8)) for d in range(n)]
    counts = [r.integers(1, 30, size=len(t)).tolist() for t in terms]
    shard = ranked_search.Shard(corpus, list(range(n)), [corpus.norm(sum(c)) for c in counts], [len(t) for t in terms],
                                [t for d in terms for t in d], [c for d in counts for c in d])
    query = ranked_search.Query(1, np.arange(8), np.ones(8, np.int64))
    none = np.zeros(0, np.int64)
    everything = sorted(shard.search(query, none, n)[1].tolist(), reverse=True)
    assert len(everything) == n

    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, at):
            if isinstance(at, slice):
                Counted.read += len(range(*at.indices(len(self))))
            return np.asarray(super().__getitem__(at))

    shard.impact = shard.impact.view(Counted)
    for best, top, least in ((np.full(20, 10**12), 20, 0), (np.full(20, everything[0] * 6 // 5), 20, 0), (none, 10, 80)):
        Counted.read = 0
        found = sorted(shard.search(query, best, top, chunk=16)[1].tolist(), reverse=True)
        assert found[:top] == ([] if len(best) else everything[:10])
        assert least <= Counted.read < (1000 if len(best) else 4 * n + 4 * rare + 1)
