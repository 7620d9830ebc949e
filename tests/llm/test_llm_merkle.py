"""Operator 11 against a tree built by hand."""

import hashlib
import random
import zlib

import pytest

from bookpulse.llm import merkle
from bookpulse.llm.queries import op11_merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    doc, text, lang, source, n = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def climb(nodes):
    """Root of a list of digests, and per node its siblings as (before, after), level by level."""
    ways, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, at in zip(ways, places):
            run = nodes[at // 16 * 16:at // 16 * 16 + 16]
            way.append(("".join(run[:at % 16]), "".join(run[at % 16 + 1:])))
        nodes = [sha("".join(nodes[i:i + 16])) for i in range(0, len(nodes), 16)]
        places = [p // 16 for p in places]
    return nodes[0], ways


def brute(rows):
    if not rows:
        return []
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s, own in by_source.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in own])
    root, tops = climb([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for row, way in zip(by_source[s], trees[s][1]):
            doc, text, lang, _, n = row
            if doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 5 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            folded = leaf((doc, text, lang, s, n))
            for before, after in way + top:
                folded = sha(before + folded + after)
            siblings = "".join(b + a for b, a in way + top)
            out.append((doc, leaf(row), trees[s][0], root, sha(siblings), folded, folded == root))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in merkle.manifest(df, merkle.lower_cased()).collect()), key=str)


def test_proofs_of_sources_of_any_size(spark):
    r = random.Random(11)
    rows = []
    for source, n in (("a", 1), (None, 2), ("b", 16), ("B", 17), ("é", 256), ("c", 257), ("hot", 4500), ("", 3)):
        rows += [(r.randrange(-50, 10**6), r.choice(["Aa É", "", None, "x:1"]) and f"T {i} É", r.choice(["en", None]), source,
                  r.choice([None, 5])) for i in range(n)]
    rows += [(77, "Same", "en", f"s{i}", 4) for i in range(300)]  # more sources than one block holds
    rows += [(5, "A", "en", "a", 1), (5, "A", "en", "a", 1), (None, "A", None, "a", None), (None, None, None, None, None),
             (6, "Lang " * 40000, "en", "a", 0)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert found(df) == want
    assert merkle.root_of(df) == want[0][3]
    assert 0 < sum(not x[-1] for x in want) < len(want)
    changed = df.selectExpr("doc_id", "concat(text, ' ') AS text", "lang", "source", "n_chars")
    assert merkle.root_of(changed) != want[0][3]


@pytest.mark.parametrize("rows", [
    [], [(5, "A", "en", "a", 1)], [(None, None, None, None, None)], [(1, "x", None, "a", 1), (1, "x", None, "a", 1)],
    [(i, "Tie", "en", "a", 3) for i in (4, 4, 4, 2)] + [(9, "", "de", "b", 0)],
])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", *[f"'old' AS {c}" for c in ("key", "hash", "other", "rank", "n", "block", "d0", "d1", "kids", "node", "leaf", "root", "of")])
    assert found(df) == brute(rows)
    assert merkle.root_of(df) == (brute(rows)[0][3] if rows else None)


def test_proofs_without_joins_inside_a_block(spark):
    """Digits are grouped away in one partitioning; the source's hot block is bounded."""
    nodes = spark.range(10_000).selectExpr("concat('1hot', id div 10000) AS key", "10000L AS n", "id AS rank", "sha2(string(id), 256) AS hash")
    rolled = merkle.rolled(nodes)
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert rolled.count() == 40 and rolled.selectExpr("max(size(flatten(kids.kids)))").first()[0] == merkle.BLOCK


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted((tuple(r) for r in op11_merkle(spark, folder).collect()), key=str) == brute(rows)
