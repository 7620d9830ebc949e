"""Language identification with error-correcting output codes.

Every language has a codeword; a binary n-gram classifier per bit tells the languages with
a 1 from those with a 0 (hashed character n-grams, log ratio of their mean frequencies).
A text gets the language whose codeword has the smallest loss, each bit weighted by how
well its classifier separates the languages; a small gap to the next one is flagged.

Rows: a null text, or one without a letter, is ``und`` with score 0; without any labelled
text all rows are ``und``; with one learned language every other text gets it; of codewords
with equal losses the first language by name wins, with a gap of 0; repeated rows are judged
alike; very long texts are counted in pieces; rows with a null doc_id count as held out; an empty table gives no
rows; other columns are ignored (``keep_identified`` keeps them all).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse.llm.common import importable, own_columns, slices

#: Labelled documents that are learned from, per language (about: chosen by hash).
SAMPLE = 2000
BUCKETS, ORDERS = 1 << 15, (1, 2, 3)
UNKNOWN = "und"
#: A smaller gap between the two smallest losses is ambiguous.
LEAST_GAP = 0.02
_SHARPNESS = 4.0
_PIECE = 1 << 20
_NO_LETTERS = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the doc_id as text leaves 1 when divided by 3, and for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def letters_of(text: str | None) -> str:
    """Lower-cased words, one space before and after each; empty if there is no letter."""
    words = _NO_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {words} " if any(map(str.isalpha, words)) else ""


def gram_buckets(words: str) -> Iterator[np.ndarray]:
    """Hash buckets of all character n-grams, in arrays of bounded size."""
    overlap = max(ORDERS) - 1
    for at in range(0, max(1, len(words) - overlap), _PIECE):
        piece = words[at:at + _PIECE + overlap]
        last = at + _PIECE + overlap >= len(words)
        codes = np.frombuffer(piece.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        mixed = np.zeros(len(codes), dtype=np.uint64)
        for n in ORDERS:
            # Code points have 21 bits: three of them fit one word.
            mixed = (mixed[:len(codes) - n + 1] << np.uint64(21)) | codes[n - 1:]
            hashed = (mixed + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            found = (hashed >> np.uint64(40)) % np.uint64(BUCKETS)
            yield (found if last else found[:_PIECE]).astype(np.int64)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """Rows of +1 / -1, one per language, with every column splitting the languages.

    All splits for few languages; for many, the best separated of several random codes.
    """
    if n <= 1:
        return np.ones((n, 0))
    if n <= 5:
        return np.array([c for c in product((1.0, -1.0), repeat=n) if c[0] == 1 and -1 in c]).T
    rng, best = np.random.default_rng(seed), (-1, None)
    for _ in range(50):
        code = np.where(rng.random((n, int(np.ceil(10 * np.log2(n))))) < 0.5, -1.0, 1.0)
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - code @ code.T) / 2 + np.diag(np.full(n, np.inf))
        if apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


class Model:
    """Binary classifiers of all bits and the loss-weighted decoder."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """``counts``: n-gram counts, one row per language."""
        self.languages = languages
        self.code = codewords(len(languages))
        share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
        seen = counts.sum(axis=0) >= 3
        bits = self.code.shape[1]
        self.weights = np.zeros((counts.shape[1], bits), dtype=np.float32)
        for b in range(bits):
            one = self.code[:, b] > 0
            ratio = np.log(share[one].mean(axis=0)) - np.log(share[~one].mean(axis=0))
            self.weights[:, b] = np.where(seen, ratio, 0)
        if bits:
            # What each classifier gives on average for a text of each language.
            mean = (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)) @ self.weights
            margin = self.code * mean
            self.scale = np.maximum(np.abs(mean).mean(axis=0), 1e-6)
            sure = np.clip(margin.min(axis=0) / self.scale, 0.05, None)
            self.trust = sure / sure.sum()

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the two best are too close to tell."""
        words = letters_of(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        total, n = np.zeros(self.weights.shape[1]), 0
        for found in gram_buckets(words):
            total += self.weights[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        answers = np.clip(total / max(n, 1) / self.scale, -4, 4)
        losses = np.exp(-self.code * answers) @ self.trust
        order = np.argsort(losses, kind="stable")
        best = int(order[0])
        chances = np.exp(-_SHARPNESS * (losses - losses[best]))
        return self.languages[best], float(1 / chances.sum()), bool(losses[order[1]] - losses[best] < LEAST_GAP)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from text and lang of about ``sample`` documents per language that are not held out.

    Languages are counted over all rows; a hash of the doc_id then picks the share of each.
    Only n-gram counts per language come to the driver: languages times ``BUCKETS`` at most.
    """
    importable(docs.sparkSession)
    rows = own_columns(docs, "doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    languages = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    part = F.create_map(*[F.lit(x) for k, n in languages.items() for x in (k, min(1.0, sample / n))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(draw < F.try_element_at(part, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = totals.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for found in gram_buckets(letters_of(text)):
                    own += np.bincount(found, minlength=BUCKETS)
        for lang, own in totals.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])],
                ["lang", "bucket", "n"],
            )

    counted = chosen.mapInArrow(count, "lang string, bucket int, n bigint")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(languages)
    counts = np.zeros((len(names), BUCKETS))
    place = {k: i for i, k in enumerate(names)}
    row = np.array([place[k] for k in found.column("lang").to_pylist()], dtype=np.int64)
    counts[row, found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return Model(names, counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row."""
    spark = importable(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = shared.value.judge
        for batch in slices(batches):
            found = [judged(t) for t in batch.column(1).to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            out = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["doc_id", "lang_pred", "score", "ambiguous"])

    rows = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    judged = rows.mapInArrow(judge, "doc_id bigint, lang_pred string, score double, ambiguous boolean")
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a language that is not in doubt, with all their columns.

    Without any learned language only texts without a letter go.
    """
    shared, at = importable(docs.sparkSession).sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged, learned = shared.value.judge, bool(shared.value.languages)
        for batch in slices(batches):
            kept = []
            for text in batch.column(at).to_pylist():
                language, _, ambiguous = judged(text)
                kept.append(language != UNKNOWN and not ambiguous if learned else bool(letters_of(text)))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
