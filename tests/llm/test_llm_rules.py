"""Operator 12 on hand-made and random texts."""

import random
import re

import duckdb
import pytest

from bookpulse.llm import quality_rules
from bookpulse.llm.oracles import ORACLES
from checks.compare import difference

SCHEMA = "doc_id long, text string"
NAMES = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines",
         "n_ellipsis_lines", "n_bullet_lines")


def brute(doc, text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    bare = [x.strip(quality_rules.SPACE) for x in lines]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 3)}
    stop = {*quality_rules.STOP_WORDS, *map(str.capitalize, quality_rules.STOP_WORDS)}
    return (
        doc, len(words), sum(map(len, words)), sum(c in quality_rules.SYMBOLS for c in text), len(lines) - len(set(lines)),
        len(covered), sum(w in stop for w in words), len(lines), sum(x.endswith(("...", "…")) for x in bare),
        sum(x.startswith(("-", "*", "•")) for x in bare),
    )


def brute_verdict(counts):
    c = dict(zip(NAMES, counts))
    failed = [
        r.name for r in quality_rules.RULES
        if r.low is not None and 1000 * c[r.part] < r.low * c[r.whole] or r.high is not None and 1000 * c[r.part] > r.high * c[r.whole]
    ]
    base = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
    return base, ",".join(failed), not base and not failed


def judged(df):
    return sorted((tuple(r) for r in quality_rules.judge(df).collect()), key=str)


def test_counts_of_random_texts(spark):
    r = random.Random(12)
    bits = ["the", "The", "a b c", "é😀", "x", "the cat sat", "\n", " \n\t", "- y", "...", "…", "#", "*|<>$%&", "\x0b", "\x0c", "\r", "\x1f", "\xa0", "longerword"]
    rows = [(i, "".join(r.choice(bits) + r.choice(["", " ", " ", "\n"]) for _ in range(r.randrange(90)))) for i in range(300)]
    rows += [
        (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (4, "one two three"),
        (5, "a a a a"), (6, "a a a"), (1007, "x z q " * 5000), (8, "the cat and dog " * 13), (9, "#" * 60), (10, "a b x a b c a b"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'old' AS {n}" for n in ("words", "bare", "lines", "n_words", "kept")])
    want = []
    for doc, text in rows:
        counts = brute(doc, text) if doc != 1007 else (1007, 15000, 15000, 0, 0, 15000, 0, 1, 0, 0)
        want.append((*counts, *brute_verdict(counts)))
    assert judged(df) == sorted(want, key=str)
    assert judged(df.limit(0)) == []
    con = duckdb.connect()
    documents = df.select("doc_id", "text").toArrow()  # noqa: F841
    cursor = con.execute(ORACLES["op12_quality_rules"])
    got = quality_rules.judge(df)
    assert difference((got.columns, [tuple(x) for x in got.collect()]), ([d[0] for d in cursor.description], cursor.fetchall())) is None


def test_thresholds_are_inclusive(spark):
    def row(**counts):
        return {n: counts.get(n, {"n_words": 100, "word_chars": 500, "n_stop_words": 20, "n_lines": 10}.get(n, 0)) for n in NAMES}

    cases = [
        ("n_symbols", 10, "symbols", 11), ("n_dup_lines", 3, "duplicate_lines", 4), ("word_chars", 300, "word_length", 299),
        ("word_chars", 1000, "word_length", 1001), ("n_stop_words", 2, "stop_words", 1), ("n_stop_words", 80, "stop_words", 81),
        ("n_ellipsis_lines", 3, "ellipsis_lines", 4), ("n_bullet_lines", 9, "bullet_lines", 10),
    ]
    for part, at, name, beyond in cases:
        rule = next(r for r in quality_rules.RULES if r.name == name)
        df = spark.createDataFrame([row(**{part: at}), row(**{part: beyond})])
        assert [x[0] for x in df.select(quality_rules.broken(rule)).collect()] == [False, True], part


def test_plan_is_one_projection(spark):
    df = spark.createDataFrame([(1, "x")], SCHEMA)
    plan = quality_rules.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_labelled_documents(spark):
    """Clean labelled documents of enough words stay, junk goes."""
    folder = "/root/testdata/sf0.01"
    rows = quality_rules.judge(spark.read.parquet(f"{folder}/documents.parquet")).join(
        spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.02 * len(bad) and len(bad) > 30


@pytest.mark.parametrize("name", [r.name for r in quality_rules.RULES])
def test_rules_name_counts(name):
    rule = next(r for r in quality_rules.RULES if r.name == name)
    assert rule.part in NAMES and rule.whole in NAMES
