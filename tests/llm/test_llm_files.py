"""Operators 2, 5, 6, 9, 10 and the pipeline: exact round trips, brute force, edge cases."""

import base64
import glob
import gzip
import hashlib
import random
import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from bookpulse.llm import chat, common, packing, queries, token_files, tokens, url_filter, warc

FOLDER = "/root/testdata/sf0.001"
ODD = [
    (None, None), (1, None), (2, ""), (3, " \n"), (4, "Hello, <|endoftext|> WORLD! it's I'LL"), (4, "Hello"), (4, "Hello"),
    (5, "é É ǅ İ " * 4000), (None, "x"), (9, "x"),
]


@pytest.fixture
def odd(spark):
    from pyspark.sql import functions as F

    names = ("ids", "start", "row", "curve", "part", "n_tokens", "at", "upto", "n", "length")
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("old") for c in names})


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.tokenizer_file())


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


# --- tokens ---

def test_words_have_the_ids_of_the_whole_text(library, monkeypatch):
    r = random.Random(1)
    parts = [*"abXYZ.,'!?)(-_ \n\t<|>19éÉßıİΣ中😀", "\u0331", "\u0301", "\x1c", "\x85", "\xa0", "H\u0331",
             "<|endoftext|>", "<|ENDOFTEXT|>", "I'm", "'LL", " the "]
    encoder = tokens.WordEncoder(tokens.tokenizer_file(), known_bytes=50_000)
    assert encoder.by_word
    monkeypatch.setattr(tokens, "RUN_BYTES", 30)
    monkeypatch.setattr(tokens, "runs", partial(common.runs, size=30))
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(40)))
        want = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text.encode()) == np.array(want, dtype="<u4").tobytes(), repr(text)
    assert len(encoder.known) <= 50_000 // 210


def test_words_are_kept_until_the_texts_change(library):
    encoder = tokens.WordEncoder(tokens.tokenizer_file(), known_bytes=210 * 300)
    r = random.Random(2)
    for first in "abcdé":
        for _ in range(60):
            text = " ".join(first + "".join(r.choice("xyzß") for _ in range(4)) for _ in range(40)) + " " + "long" * 30 + "."
            assert encoder.encode(text.encode()) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            assert len(encoder.known) <= 300
    # After a change of texts, words of the new ones are kept.
    assert any(k.decode().startswith("é") for k in encoder.known)


def test_all_latin_letters(library):
    encoder = tokens.WordEncoder(tokens.tokenizer_file())
    for code in range(0xA0, 0x2FF):
        text = f"a{chr(code)}b {chr(code)} {chr(code).upper()}x"
        assert encoder.encode(text.encode()) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), hex(code)


# --- 10: token files ---

def brute_tokens(library, rows):
    at, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = ids_of(library, text)
        out.append((doc, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def read_tokens(df, folder):
    token_files.write_token_files(df, folder, tokens.tokenizer_file())
    spark = df.sparkSession
    return sorted(tuple(r) for r in token_files.with_checksums(token_files.read_tokens(spark, folder)).select(
        "start", "doc_id", "n_tokens", "ids_crc32").collect())


def test_token_files(spark, library, odd, nothing, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for k, (df, rows) in enumerate((
        (docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd, ODD), (nothing, []),
    )):
        want = [(at, doc, n, c) for doc, at, n, c in brute_tokens(library, rows)]
        assert [(a, d, n, c) for a, d, n, c in read_tokens(df, f"{tmp_path}/{k}")] == want


def test_rows_of_one_doc_id_are_split(spark, library, tmp_path):
    """Half the rows without a doc_id: no task gets them all, and places stay gapless."""
    rows = [(None if i % 2 else i, f"{i * 7919 % 1000} text {i}") for i in range(1200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        got = read_tokens(df, f"{tmp_path}/t")
        parts = token_files.read_metadata(spark, f"{tmp_path}/t").where("doc_id IS NULL").select("part").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1 and got == [(at, doc, n, c) for doc, at, n, c in brute_tokens(library, rows)]


def test_token_file_format(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    token_files.write_token_files(docs, f"{tmp_path}/t", tokens.tokenizer_file(), row_group_bytes=1 << 16, page_bytes=1 << 12)
    seen = []
    for path in sorted(glob.glob(f"{tmp_path}/t/ids/*.parquet")):
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.num_columns)}
            ids = next(v for k, v in columns.items() if k.startswith("ids"))
            assert "RLE_DICTIONARY" in ids.encodings or "PLAIN_DICTIONARY" in ids.encodings
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
            assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
        seen += pq.read_table(path, columns=["doc_id"])["doc_id"].to_pylist()
    assert seen == sorted(seen) and len(seen) == docs.count()
    some = token_files.read_tokens(spark, f"{tmp_path}/t", 10, 12)
    assert sorted(r.doc_id for r in some.collect()) == [10, 11, 12]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in plan
    meta = token_files.read_metadata(spark, f"{tmp_path}/t").select("doc_id", "n_tokens")
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


# --- 5: packing ---

def check_packed(library, rows, pieces, length):
    texts = {}
    for doc, text in rows:
        texts.setdefault((doc, crc(ids_of(library, text)), len(ids_of(library, text))), []).append(ids_of(library, text))
    sequences = {}
    for p in pieces:
        ids = np.frombuffer(p.ids, dtype="<u4")
        assert len(ids) == p.length and crc(ids) == p.ids_crc32
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for s, own in sequences.items():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == length or s == len(sequences) - 1 and at <= length
    # Pieces of a document, in order of their places, give its ids.
    stream = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    whole, now = [], []
    for p in stream:
        if p.start == 0:
            now = []
        now += np.frombuffer(p.ids, dtype="<u4").tolist()
        if p.start + p.length == p.doc_tokens:
            whole.append((p.doc_id, tuple(now)))
    assert sorted(whole, key=str) == sorted(((d, tuple(ids_of(library, t))) for d, t in rows), key=str)


@pytest.mark.parametrize("length", [64, 4096])
def test_packing(spark, library, odd, length):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    check_packed(library, [(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs, tokens.tokenizer_file(), length).collect(), length)
    check_packed(library, ODD, packing.pack(odd, tokens.tokenizer_file(), length).collect(), length)


def test_packing_nothing(nothing):
    pieces = packing.pack(nothing, tokens.tokenizer_file())
    assert pieces.collect() == [] and packing.padded_length(pieces).collect() == []


def test_padding(spark):
    rows = spark.createDataFrame([(0, 4096), (1, 1000), (1, 24), (2, 1000)], "sequence_id long, length long")
    assert sorted(tuple(r) for r in packing.padded_length(rows).collect()) == [(0, 4096, 0), (1, 1024, 0), (2, 1000, 3096)]


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = packing.hilbert_keys(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours_on_the_curve_are_alike(spark):
    """Documents of one language lie closer together than in doc_id order."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    order = packing.encode_documents(docs, tokens.tokenizer_file()).select("doc_id", "curve").collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    along = [lang[r.doc_id] for r in sorted(order, key=lambda r: r.curve)]
    as_given = [lang[d] for d in sorted(lang)]
    changes = lambda x: sum(a != b for a, b in zip(x, x[1:]))
    assert changes(along) < 0.6 * changes(as_given)


# --- 6: chat ---

def brute_turns(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        n, turns, loss = out.setdefault(conv, [0, "", ""])
        text, role = text or "", role or ""
        out[conv] = [n + 1, f"{turns}{role}\n{text}\n", loss + text * (role == "assistant")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (n, sha(t), len(a), sha(a)) for c, (n, t, a) in out.items()}


def test_chat_round_trip(spark):
    r = random.Random(2)
    bits = ["\\", "### ", "Assistant:", "</turn>", "<", "/turn>", " ", "é", "😀", "\n", "### User: ", "#", "### Role x: ", "<|endoftext|>"]
    rows = [
        (c, t, r.choice(["user", "assistant", "system", "tool\n### User:", None]), "".join(r.choice(bits) for _ in range(r.randrange(9))))
        for c in range(60) for t in range(r.randrange(1, 7))
    ] + [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"),
         (70, None, "assistant", None), (70, 1, "user", None), (70, 1, "user", None), (None, 0, "assistant", "x" * 90_000), (71, 0, "assistant", " " * 2_000_000 + "x" + "\n\u3000" * 5000)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {c: F.lit("old") for c in ("chunk", "input_ids", "n_turns", "formatted")})
    for chunk in (1 << 20, 20):
        formatted = chat.format_conversations(df, chat.tokenizer_file(), chunk).cache()
        got = {x.conv_id: tuple(x)[1:5] for x in chat.read_back(formatted, chat.tokenizer_file()).collect()}
        assert got == brute_turns(rows)
        for x in formatted.collect():
            strings = re.findall(r"### (?:User|Assistant|System): |</turn>|### Role ", x.formatted)
            assert strings.count("</turn>") == x.n_turns and len(strings) == 2 * x.n_turns
            assert len(x.input_ids) == len(x.loss_mask)
        formatted.unpersist()
    assert chat.read_back(chat.format_conversations(df.limit(0), chat.tokenizer_file()), chat.tokenizer_file()).collect() == []


def test_chat_spreads_a_hot_conversation(spark):
    rows = [(5, t, ("user", "assistant")[t % 2], f"turn {t} \\ </turn>") for t in range(3000)]
    rows += [(c, 0, "assistant", str(c)) for c in (1, 9)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
        formatted = chat.format_conversations(df, chat.tokenizer_file()).cache()
        tasks = {x.chunk >> 32 for x in formatted.where("conv_id = 5").select("chunk").collect()}
        got = {x.conv_id: tuple(x)[1:5] for x in chat.read_back(formatted, chat.tokenizer_file()).collect()}
        formatted.unpersist()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and got == brute_turns(rows)


def test_chat_query(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    text = "\\### Assistant: </turn> ok"
    want = brute_turns([*given, (-7, 0, "user", text), (-7, 1, "assistant", text)])
    rows = queries.op6_chat_format(spark, FOLDER).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in rows} == want and all(r.formatted_chars > 0 for r in rows)


# --- 9: WARC ---

PAGES = [
    (1, "http://a/x", "<p>" + "é" * 200), (2, "http://a/y", "<p>" + "é" * 200), (3, None, "short"), (4, "http://a/z", "short"),
    (5, "http://b\r\nX: y", None), (6, "", ""), (None, "http://c", "<p>" + "é" * 200), (None, "http://d", "n" * 300),
    (7, "http://e", "\r\n\r\n" * 60), (2, "http://a/y", "<p>" + "é" * 200), (8, "u", "z" * 400_000),
]


def brute_pages(pages):
    payload = [(p, (h or "").encode()) for p, _, h in pages]
    first = {}
    for p, b in payload:
        if len(b) >= 100 and p is not None:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, b in payload:
        f = first.get(b)
        again = f is not None and f != p
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None, True))
    return sorted(out, key=str)


def test_warc(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr(
        "*", "'old' AS digest", "'old' AS first", "'old' AS n")
    for size in (warc.ARCHIVE_BYTES, 200):
        folder = f"{tmp_path}/{size}"
        warc.write_archives(df, folder, archive_bytes=size)
        got = warc.read_archives(spark, folder)
        assert sorted((tuple(r) for r in warc.page_digests(got).collect()), key=str) == brute_pages(PAGES)
        files = glob.glob(f"{folder}/part-*")
        for path in files:  # one member per record; the last one closes the archive
            data, members = open(path, "rb").read(), 0
            types = []
            while data:
                one = zlib.decompressobj(31)
                text = one.decompress(data) + one.flush()
                data, members = one.unused_data, members + 1
                assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
                types.append(re.search(rb"WARC-Type: (\w+)", text)[1])
            assert types[-1] == b"metadata" and b"metadata" not in types[:-1]
    warc.write_archives(df.limit(0), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0


def test_broken_archives():
    one = warc.page_record(1, b"http://a", b"x" * 5000, hashlib.sha256(b"x" * 5000).hexdigest(), None, False)
    two = warc.page_record(2, b"http://b", b"y", hashlib.sha256(b"y").hexdigest(), None, False)
    assert [h["warc-record-id"] for h, _ in warc.read_records(one + two)] == ["<urn:page:1>", "<urn:page:2>"]
    for broken in (one[:-12], one + two[:30], gzip.compress(gzip.decompress(one) + gzip.decompress(two)),
                   gzip.compress(gzip.decompress(one)[:-300]), gzip.compress(b"no record\r\n\r\n")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_records(broken))
    assert not warc._matches("sha256:00", b"x")
    sha1 = base64.b32encode(hashlib.sha1(b"payload").digest()).decode()
    assert warc._matches(f"sha1:{sha1}", b"payload") and not warc._matches(f"sha1:{sha1}", b"other")


# --- 2: urls ---

def test_hosts_paths_rules(spark):
    cases = {
        None: ("", "", None), "nothing": ("", "", None), "http://A.ORG": ("a.org", "", None), "http://a.org/": ("a.org", "/", "org/"),
        "x://WWW.example.org/es/1?q#f": ("www.example.org", "/es/1", "example.org/es/"),
        "http://example.org/en/1": ("example.org", "/en/1", "example.org/en/1"), "http://example.org/en/2": ("example.org", "/en/2", "org/"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/"), "http://b.com/fr/x": ("b.com", "/fr/x", "com/fr/"),
        "http://b.com/de/x": ("b.com", "/de/x", "com/de/"), "http://b.com#/de/": ("b.com", "", None), "http://b.com?x/de/": ("b.com", "", None),
        "http://telecom/de/": ("telecom", "/de/", None), "http://com/de/é": ("com", "/de/é", "com/de/"),
        "a://b://c/d": ("b:", "//c/d", None), "http://Ä.com/fr/\n1": ("Ä.com", "/fr/\n1", "com/fr/"), "": ("", "", None),
    }
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(cases)], "page_id long, url string, grams string")
    model = url_filter.train(url_filter.labelled_urls(spark), features=1 << 12)
    got = url_filter.judge(df, model)
    rows = {r.url: r for r in got.collect()}
    assert {u: (r.host, r.path, r.rule) for u, r in rows.items()} == cases
    assert {r.grams for r in rows.values()} == {"old"}
    for u, r in rows.items():
        if r.rule:
            assert r.verdict == ("allow" if r.rule in ("org/", "com/fr/") else "block")
        else:
            assert r.verdict == ("block" if r.score >= 0.5 else "allow")
    assert url_filter.judge(df.limit(0), model).collect() == []


def test_verdicts_of_the_model(spark):
    rows = queries.op2_url_filter(spark, "/root/testdata/sf0.01").collect()
    spam = re.compile("casino|pills|adult|ads-track|spam-farm")
    free = [r for r in rows if r.rule is None]
    assert len(free) > 50
    wrong = [r.host for r in free if (r.verdict == "block") != bool(spam.search(r.host))]
    assert len(wrong) <= 0.02 * len(free), wrong


def test_model_on_labels_left_out(spark):
    labelled = url_filter.labelled_urls(spark).selectExpr("*", "pmod(xxhash64(url), 4) = 0 AS out")
    model = url_filter.train(labelled.where("NOT out"))
    rows = url_filter.judge(labelled.where("out"), model, rules=()).collect()
    assert np.mean([(r.verdict == "block") == (r.label == 1) for r in rows]) > 0.9


# --- pipeline ---

def test_pipeline(spark, library):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, FOLDER).cache()
        if name != "packing":
            assert docs.schema.names == before.schema.names and 0 < docs.count() <= before.count()
    check_packed(library, [(r.doc_id, r.text) for r in before.collect()], docs.collect(), packing.LENGTH)


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "the cat sat on the mat", "en", "a", 0),
            (3, "the cat sat on the mat", "en", "a", 0), (None, "the cat sat on the mat", None, "b", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for k, own in enumerate((rows, [])):
        spark.createDataFrame(own, schema).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        spark.createDataFrame([(1, "w " * 12)], "item_id long, text string").write.parquet(f"{tmp_path}/{k}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()
        assert sorted({p.doc_id or 0 for p in out}) == ([3] if own else [])  # the row without an id is a copy of 3
        assert len([p for p in out if p.doc_id == 3]) == (1 if own else 0)
