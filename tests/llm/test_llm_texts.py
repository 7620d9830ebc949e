"""Operators 1, 3, 4, 7, 8 on documents: brute force, edge cases, held-out accuracy."""

import hashlib
import random
import re
import zlib
from functools import partial
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from bookpulse.llm import common, decontaminate, language_id, line_dedup, simhash, spotsigs

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like what the operators make or use inside.
CLASHING = ("n_words", "hits", "items", "fp", "fingerprint", "component_id", "part", "guard", "n_lines", "n_dropped",
            "site", "found", "score", "row", "curve", "bad", "host", "stored")
ODD = [
    (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 4),
    (4, "the cat sat", "en", "a", 11), (4, "the cat sat", "en", "a", 11), (5, "the cat sat", "en", "b", 11),
    (6, "12 34 !!", "de", "b", 8), (None, "the dog and the bird in a tree", "en", "b", 30),
    (7, "die katze und der hund " * 3000, "de", "a", 0),
]


@pytest.fixture
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit(f"old {c}") for c in CLASHING})


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def given_docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# --- 1: benchmark decontamination ---

def brute_contamination(docs, items, window=10):
    patterns = {}
    for item, text in items:
        w = words(text)
        if item is None or not w:
            continue
        m = min(len(w), window)
        for i in range(len(w) - m + 1):
            patterns.setdefault(tuple(w[i:i + m]), set()).add(item)
    sizes = {len(p) for p in patterns}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if own := patterns.get(tuple(w[i:i + m])):
                    hit.update(range(i, i + m))
                    found |= own
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def contamination(docs, items, **options):
    found = decontaminate.contamination_digest(decontaminate.find_contamination(docs, items, **options))
    return sorted((tuple(r)[:6] for r in found.collect()), key=str)


def test_contamination_of_random_words(spark, monkeypatch):
    r = random.Random(3)
    texts = [" ".join(r.choice("ab cé D,e f".split()) for _ in range(r.randrange(60))) for _ in range(120)]
    docs = list(enumerate(texts))
    items = [(i, " ".join(r.choice("ab cé d e f".split()) for _ in range(r.randrange(16)))) for i in range(25)]
    items += [(3, "ab ab"), (None, "ab"), (30, None), (31, " ! "), (10, items[4][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(docs, items)
    assert contamination(df, bench) == want
    assert contamination(df, bench, block_bytes=100) == want  # many blocks, long items cut
    clean = decontaminate.drop_contaminated(df, bench, block_bytes=100)
    assert sorted(x.doc_id for x in clean.collect()) == sorted(x[0] for x in want if not x[5])
    monkeypatch.setattr(decontaminate, "runs", partial(common.runs, size=20))
    find = decontaminate.Search([(i, t.encode()) for i, t in items if i is not None and t])
    for (doc, text), row in zip(docs, sorted(want, key=lambda x: x[0])):
        n, spans, found = find(text.encode())
        assert (n, sum(b - a for a, b in spans), len(found)) == row[1:4]


@pytest.mark.parametrize("block_bytes", [64, 400, 4000, 10**6])
def test_contamination_by_sparse_items(spark, block_bytes):
    """Words far apart in a long item text: only windows of ten words count, wherever the item is cut."""
    far = "." * 300
    items = [
        (1, f"the cat {far} " + " ".join(f"w{i}" for i in range(12))), (2, f"{far} the {far} cat {far} sat"),
        (3, f" {far} ".join(f"v{i}" for i in range(25))), (4, far), (5, f"x y z {far}"),
    ]
    docs = [
        (1, "i saw the cat today"), (2, "the cat " + " ".join(f"w{i}" for i in range(8))), (3, "x the cat sat down"),
        (4, "a " + " ".join(f"v{i}" for i in range(5, 15)) + " b"), (5, "x y z"), (6, " ".join(f"v{i}" for i in range(9))),
        (7, " ".join(f"w{i}" for i in range(12))),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(docs, items)
    assert [r[5] for r in want] == [False, True, True, True, True, False, True]
    assert contamination(df, bench, block_bytes=block_bytes) == want


def test_contamination_edges(spark, odd, nothing):
    bench = spark.createDataFrame([(9, "The cat SAT"), (10, "katze und der hund die katze und der hund die katze")], "item_id long, text string")
    want = brute_contamination([(r[0], r[1]) for r in ODD], [tuple(r) for r in bench.collect()])
    assert contamination(odd, bench) == want
    assert contamination(nothing, bench) == [] and len(contamination(odd, bench.limit(0))) == len(ODD)
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == sum(not x[5] for x in want)
    assert decontaminate.drop_contaminated(nothing, bench).count() == 0


# --- 3: fingerprints ---

def test_fingerprints_of_neighbours(spark, given_docs):
    rows = sorted((r.doc_id, r.text or "") for r in given_docs.collect())
    for parts in (1, 5):
        got = sorted((tuple(r) for r in spotsigs.fingerprint_documents(given_docs, parts=parts).collect()), key=str)
        want = []
        for i, (doc, text) in enumerate(rows):
            after = rows[(i + 1) % len(rows)][1]
            cut = len(text) // 4
            edited = text[:len(text) - cut] + after[:cut]
            own, new, other = (spotsigs.signatures(t.encode()) for t in (text, edited, after))
            like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
            want.append((
                doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), spotsigs.fingerprint_of(own),
                spotsigs.fingerprint_of(new), like(own, new), like(own, other), len(own),
                spotsigs.length_class(len(own), 0.8),
            ))
        assert got == sorted(want, key=str)


def test_fingerprint_edges(odd, nothing):
    rows = spotsigs.fingerprint_documents(odd, parts=3).collect()
    assert len(rows) == len(ODD) and {r.doc_id for r in rows} == {x[0] for x in ODD}
    by_text = {}
    for r in rows:
        by_text.setdefault((r.n_chars, r.fingerprint), []).append(r)
    assert len({r.fingerprint for r in rows if r.doc_id in (4, 5)}) == 1
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in rows)
    assert spotsigs.fingerprint_documents(nothing).collect() == []
    one = spotsigs.fingerprint_documents(odd.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_signatures_do_not_depend_on_runs(monkeypatch):
    r = random.Random(5)
    for _ in range(200):
        text = " ".join(r.choice("the of cat dog a b is xx yy".split()) for _ in range(r.randrange(80))).encode()
        whole = spotsigs.signatures(text)
        with monkeypatch.context() as m:
            m.setattr(spotsigs, "runs", partial(common.runs, size=r.randrange(5, 60)))
            assert spotsigs.signatures(text) == whole


def test_likeness_of_texts_with_few_anchors(spark):
    def pairs(text):
        w = text.encode().translate(spotsigs._FOLD).split()
        return {tuple(w[i:i + 2]) for i in range(len(w))}

    r = random.Random(6)
    plain = [f"w{r.randrange(10**6)}" for _ in range(400)]
    rows = []
    for n, at in enumerate(((), (0,), (90,), (10, 60), (0, 30, 60, 80))):  # where a text of 100 words has anchors
        own = plain[:]
        r.shuffle(own)
        rows.append((2 * n, " ".join("the" if i in at else w for i, w in enumerate(own[:100]))))
        rows.append((2 * n + 1, "the and of " + " ".join(w if i % 3 else "the" for i, w in enumerate(own[100:250]))))
    rows.append((10, "to be or not to be that is the it was on of in " * 3))
    rows.append((11, "cat " * 200))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = {x.doc_id: x.near_edited for x in spotsigs.fingerprint_documents(df, parts=2).collect()}
    assert near[10] > 0.4  # common words only, then "cat"
    for doc in (0, 2, 4, 6, 8):
        text, edited = rows[doc][1], spotsigs.edited_text(rows[doc][1], rows[doc + 1][1])
        a, b = pairs(text), pairs(edited)
        assert abs(near[doc] - len(a & b) / len(a | b)) < 0.16, doc
    # An equal passage gives equal signatures, whatever stands before and after it.
    passage = " ".join(plain[:60])
    inner = spotsigs.signatures(" ".join(plain[spotsigs.STRETCH:60]).encode())
    for text in (f"the {passage} the cat", f"{passage} of", f"dog {passage}"):
        assert len(inner - spotsigs.signatures(text.encode())) <= 1


@given(st.frozensets(st.integers(0, 40)), st.frozensets(st.integers(0, 40)), st.floats(0.05, 1))
def test_pruned_jaccard(a, b, least):
    exact = len(a & b) / len(a | b) if a | b else 1.0
    assert spotsigs.pruned_jaccard(a, b) == exact
    assert spotsigs.pruned_jaccard(a, b, least) == (exact if exact >= least else 0.0) or abs(exact - least) < 1e-9
    if a and b and exact >= 0.8:
        assert abs(spotsigs.length_class(len(a), 0.8) - spotsigs.length_class(len(b), 0.8)) <= 1


# --- 4: language ---

def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_id.identify(docs, model).collect()
    out = [r for r in rows if r.held_out]
    assert {r.doc_id for r in out} == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    # A smaller sample per language is enough, and no label of a held-out row is read.
    fewer = language_id.identify(docs, language_id.train(docs, sample=40)).collect()
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in fewer if r.held_out]) > 0.95


def test_language_edges(spark, odd, nothing):
    model = language_id.train(odd)
    assert set(model.languages) <= {"en", "de"}
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == len(ODD)
    unknown = {(r.doc_id, r.lang_pred, r.score) for r in rows if r.doc_id in (1, 2, 3, 6)}
    assert unknown == {(d, "und", 0.0) for d in (1, 2, 3, 6)}
    kept = language_id.keep_identified(odd, language_id.Model(["en"], np.ones((1, language_id.BUCKETS))))
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 4, 5, 7]
    nobody = language_id.train(nothing)
    assert {r.lang_pred for r in language_id.identify(odd, nobody).collect()} == {"und"}
    assert language_id.identify(nothing, model).collect() == []


def test_grams_in_pieces(monkeypatch):
    text = language_id.letters_of("Größe und Maß, the quick brown fox " * 40)
    whole = np.sort(np.concatenate(list(language_id.gram_buckets(text))))
    monkeypatch.setattr(language_id, "_PIECE", 64)
    pieces = np.sort(np.concatenate(list(language_id.gram_buckets(text))))
    assert (whole == pieces).all()


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 30, 120])
def test_codewords(n):
    code = language_id.codewords(n)
    assert len({tuple(c) for c in code}) == n and set(np.unique(code)) == {-1.0, 1.0}
    assert (np.abs(code.sum(axis=0)) < n).all()


# --- 7: lines ---

def brute_lines(rows, ratio, least):
    pages, on = {}, {}
    for _, text, _, source, *_ in rows:
        if source is not None:
            pages[source] = pages.get(source, 0) + 1
            for line in {x.strip(" \t\r") for x in (text or "").split("\n")} - {""}:
                on.setdefault((source, line), []).append(text)
    bad = {k for k, t in on.items() if len(set(t)) >= least and len(t) > ratio * pages[k[0]]}
    out = []
    for doc, text, _, source, *_ in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if (source, x.strip(" \t\r")) not in bad]
        out.append((doc, source, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_lines_of_random_pages(spark):
    r = random.Random(8)
    lines = ["home", " home\t", "about us", "", "x", *[f"line {i}" for i in range(30)]]
    rows = [
        (i, "\n".join(r.choice(lines) for _ in range(r.randrange(6))), "en", r.choice(["a", "b", None]), 0)
        for i in range(300)
    ] + ODD + [(900 + i, "copied page\nhome", "en", "c", 0) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    for ratio, least in ((line_dedup.RATIO, line_dedup.LEAST), (0.1, 10), (0.02, 2)):
        got = line_dedup.dedup_lines(df, ratio=ratio, least=least).select("doc_id", "source", "text", "n_lines", "n_dropped")
        assert sorted((tuple(x) for x in got.collect()), key=str) == brute_lines(rows, ratio, least)


def test_footer_of_small_hosts(spark):
    import corpus_pipeline

    rows, want = [], {}
    for pages in (1, 2, 3, 9, 50):
        for i in range(pages):
            lines = [f"text {i}", "footer", "five" if pages == 50 and i < 5 else "", "six" if pages == 50 and i < 6 else ""]
            rows.append((100 * pages + i, "\n".join(lines), "en", f"host{pages}", 0))
            # 5 of 50 pages are not more than a tenth, 6 are; a line of one page is not repeated.
            kept = [x for x in lines if x != "six" and (x != "footer" or pages == 1)]
            want[100 * pages + i] = "\n".join(kept)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == want
    assert {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, df, FOLDER).collect()} == want


def test_copies_count_as_pages(spark):
    """Copies of one page are no boilerplate by themselves, but they count among a host's pages."""
    rows = [(i, "copied\nfooter", "en", "a", 0) for i in range(40)]
    rows += [(100 + i, f"own {i}\nfooter\n" + ("four" if i < 4 else "six" if i < 10 else ""), "en", "a", 0) for i in range(10)]
    rows += [(200 + i, "a long text " * 20_000 + f"{i}\nend", "en", "b", 0) for i in range(2)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == "copied" and got[100] == "own 0\nfour" and got[105] == "own 5"
    assert got[200].endswith("0") and len(got[200]) > 200_000
    assert got == {r[0]: r[2] for r in brute_lines(rows, line_dedup.RATIO, line_dedup.LEAST)}


def test_line_edges(odd, nothing):
    got = line_dedup.dedup_lines(odd)
    assert sorted(got.columns) == sorted(odd.columns) and got.count() == len(ODD)
    assert {r.found for r in got.collect()} == {"old found"} and {r.n_dropped for r in got.collect()} == {0}
    assert line_dedup.dedup_lines(nothing).count() == 0


# --- 8: SimHash ---

def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=2):
    fps = [(doc, brute_fingerprint(text)) for doc, text in rows]
    known = sorted({d for d, _ in fps if d is not None})
    root = {d: d for d in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations([f for f in fps if f[0] is not None], 2):
        if (x ^ y).bit_count() <= radius:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return sorted(((d, f"{x:016x}", None if d is None else find(d)) for d, x in fps), key=str)


def near(df, **options):
    return sorted((tuple(r) for r in simhash.near_duplicates(df, **options).collect()), key=str)


def test_components_of_given_documents(given_docs):
    assert near(given_docs) == brute_components([(r.doc_id, r.text) for r in given_docs.collect()])


def test_simhash_edges(odd, nothing):
    want = brute_components([(r[0], r[1]) for r in ODD])
    assert near(odd) == want and near(nothing) == []
    kept = simhash.keep_one(odd)
    # Of rows null, 1, 2, 3 (fingerprint zero) and 4, 4, 5 one each.
    assert kept.columns == odd.columns and simhash.keep_one(nothing).count() == 0
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 6, 7]


def test_rows_are_kept_by_themselves(spark):
    r = random.Random(9)
    a, b, c = (" ".join(f"w{r.randrange(10**6)}" for _ in range(400)) for _ in range(3))
    near = a.rsplit(" ", 1)[0] + " changed"
    assert (brute_fingerprint(a) ^ brute_fingerprint(near)).bit_count() <= 2
    cases = [
        ([(1, a), (2, a), (2, b)], {(1, a), (2, b)}),            # an unrelated text under the id of a copy
        ([(5, a), (5, near), (5, near)], 1),                      # a page crawled again
        ([(None, a), (None, a), (None, near), (None, c)], 2),     # copies without an id
        ([(None, a), (3, near)], {(3, near)}),                    # an id goes before none
        ([(7, a), (7, a), (8, b), (8, b), (9, c)], {(7, a), (8, b), (9, c)}),
    ]
    for rows, want in cases:
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'old' AS row_key", "'old' AS dropped_key", "'x' AS fp")
        got = simhash.keep_one(df)
        assert got.columns == df.columns
        kept = [(x.doc_id, x.text) for x in got.collect()]
        assert len(kept) == want if isinstance(want, int) else sorted(kept, key=str) == sorted(want, key=str)


def test_links_of_large_groups(spark):
    """Thousands of close fingerprints: hashed blocks of a group lose no link."""
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, size=6, dtype=np.uint64)
    fps = base[r.integers(0, 6, 400)]
    for _ in range(3):
        fps ^= np.where(r.random(400) < 0.6, np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64), np.uint64(0))
    fps = np.unique(fps)
    rows = [(int(x), i) for i, x in enumerate(fps.view(np.int64).tolist())]
    classes = spark.createDataFrame(rows, "fp long, rep long")
    want = {i: i for i in range(len(fps))}
    label = np.arange(len(fps))
    pairs = [(i, j) for i, j in combinations(range(len(fps)), 2) if int(fps[i] ^ fps[j]).bit_count() <= 2]
    simhash.join_labels(label, *np.array(pairs).T)
    want = {i: int(x) for i, x in enumerate(label) if x != i or (label == i).sum() > 1}
    for group in (8192, 16):
        edges = simhash.links(classes, group=group)
        found = {x.vertex: x.component for x in simhash.components(edges).collect()}
        for i in set(want) - set(found):
            assert want[i] == i
        found = {i: found.get(i, i) for i in want}
        assert found == want


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (5, 5), (101, 100)], "a long, b long")
    found = {x.vertex: x.component for x in simhash.components(edges).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {101: 100}


def test_fingerprint_runs(monkeypatch):
    r = random.Random(1)
    for _ in range(60):
        text = " ".join(r.choice(["Ä", "b", "cc", "D\n"]) for _ in range(r.randrange(40)))
        monkeypatch.setattr(simhash, "runs", partial(common.runs, size=r.randrange(2, 40)))
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
