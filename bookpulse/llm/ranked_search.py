"""Ranked lexical search by NRA: impact-sorted lists are only ever read on, never looked up.

The items of a benchmark are queries. A term's list holds the documents of a shard by falling
impact (what one occurrence in a query adds to their score). All lists of a query are read a
chunk at a time. What has been read of a document is its lower bound; the heads of the lists in
which it has not been met, added on top, are its upper bound. As long as the sum of all heads
reaches the score of the k-th best document, any document may still enter; after that only
those whose upper bound reaches it are followed, and reading goes on until every interval that
touches the k-th place has closed: members, ties and scores are exact, none is cut off.

Corpus counts (N, L, df) come from one pass over all documents, shards from a second. A task
searches one shard of bounded size after the other and keeps the k best documents of every
query, whose k-th score lets it abandon the lists of later shards early. Documents are never
shuffled; k rows a query and task are.

Rows: a null text has no terms and does not count for N; repeated documents are documents of
their own; a null doc_id ranks after all others of its score; texts of one item_id form one
query, equal rows of it once; an item without terms or with a null item_id gives no rows; ties
go by doc_id; very long texts are read in runs; empty tables give no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookpulse.functions.running import running_totals
from bookpulse.llm.common import importable, own_columns, runs, slices, texts
from bookpulse.llm.decontaminate import _FOLD, words_of
from bookpulse.session import stage

TOP = 20
#: Bytes of query terms that a worker holds at a time; more are searched block by block.
BLOCK_BYTES = 16_000_000
#: Postings of a shard. A document adds at most one for each term of the block.
SHARD = 1 << 19
#: Postings of a list read in the first round; every further round reads twice as many.
CHUNK = 256
_SALTS = 64


class Query(NamedTuple):
    item: int
    terms: np.ndarray  # numbers of its terms in the block's vocabulary
    times: np.ndarray  # occurrences in the query


class Corpus(NamedTuple):
    """Counts over all documents, and the weight of each term of the vocabulary."""

    documents: int
    length: int
    weights: np.ndarray

    @classmethod
    def of(cls, documents: int, length: int, df: Sequence[int]) -> Corpus:
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df]
        return cls(documents, length, np.array(weights, dtype=np.int64))

    def norm(self, n: int) -> int:
        return 100 - 25 + 25 * n * self.documents // self.length


class Shard:
    """Impact-sorted lists of a bounded number of documents."""

    def __init__(self, corpus: Corpus, docs: list[int | None], norms: list[int], sizes: list[int],
                 terms: list[int], counts: list[int]):
        self.ids = np.array([d or 0 for d in docs], dtype=np.int64)
        self.no_id = np.array([d is None for d in docs], dtype=bool)
        doc = np.repeat(np.arange(len(docs)), np.array(sizes, dtype=np.int64))
        term, tf = np.array(terms, dtype=np.int64), np.array(counts, dtype=np.int64)
        impact = corpus.weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * np.array(norms, dtype=np.int64)[doc]))
        some = impact > 0
        doc, term, impact = doc[some], term[some], impact[some]
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        bounds = np.searchsorted(term[order], np.arange(len(corpus.weights) + 1))
        self.starts, self.ends = bounds[:-1], bounds[1:]

    def search(self, query: Query, best: np.ndarray, top: int, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
        """(documents, exact scores) of all that can be among the ``top`` best, given ``best`` scores elsewhere."""
        filled = self.starts[query.terms] < self.ends[query.terms]
        terms, times = query.terms[filled], query.times[filled]
        at, ends = self.starts[terms].copy(), self.ends[terms]
        lower = np.zeros(len(self.ids), dtype=np.int64)
        heads = self.impact[at] * times if len(terms) else np.zeros(0, np.int64)

        def read(k: int) -> tuple[np.ndarray, np.ndarray]:
            """The next chunk of list ``k``: documents and what it adds to their scores."""
            upto = min(at[k] + chunk, ends[k])
            docs, adds = self.doc[at[k]:upto], self.impact[at[k]:upto] * times[k]
            at[k] = upto
            heads[k] = self.impact[upto] * times[k] if upto < ends[k] else 0
            return docs, adds

        def least(bounds: np.ndarray) -> int:
            """Score of the k-th best document known so far, 1 if there are fewer."""
            known = np.concatenate([best, bounds])
            return int(np.partition(known, len(known) - top)[len(known) - top]) if len(known) >= top else 1

        # Any document may still enter.
        goal = least(lower[:0])
        while heads.sum() >= goal:
            for k in np.flatnonzero(at < ends):
                docs, adds = read(k)
                lower[docs] += adds
            chunk *= 2
            goal = max(goal, least(lower[lower > 0]))
        # Only documents met so far can, and of them only those whose upper bound reaches the goal.
        near = np.flatnonzero((lower > 0) & (lower + heads.sum() >= goal))
        low, seen = lower[near], np.zeros((len(terms), len(near)), dtype=bool)
        place = np.full(len(lower), -1)
        place[near] = np.arange(len(near))
        for k, first in enumerate(self.starts[terms]):
            met = place[self.doc[first:at[k]]]
            seen[k, met[met >= 0]] = True
        while True:
            upper = low + (heads[:, None] * ~seen).sum(axis=0)
            kept = upper >= goal
            if (upper == low)[kept].all():
                return near[kept], low[kept]
            place[near] = -1
            near, low, seen = near[kept], low[kept], seen[:, kept]
            place[near] = np.arange(len(near))
            for k in np.flatnonzero(at < ends):
                docs, adds = read(k)
                met = place[docs]
                followed = met >= 0
                low[met[followed]] += adds[followed]
                seen[k, met[followed]] = True
            chunk *= 2
            goal = max(goal, least(low))


class Best:
    """The ``top`` best documents of a query so far: scores, and ids with nulls last."""

    def __init__(self, top: int):
        self.top = top
        self.scores, self.ids, self.no_id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        scores, ids, no_id = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.no_id, no_id)))
        order = np.lexsort((ids, no_id, -scores))[:self.top]
        self.scores, self.ids, self.no_id = scores[order], ids[order], no_id[order]


def query_terms(benchmark: DataFrame) -> DataFrame:
    """item, term (UTF-8 bytes) and times (occurrences) of every item."""
    importable(benchmark.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for item, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                found = Counter(words_of(text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(found), pa.int64()), pa.array(list(found), pa.binary()),
                     pa.array(list(found.values()), pa.int64())],
                    ["item", "term", "times"],
                )

    rows = own_columns(benchmark, "item_id", "text").where(F.col("item_id").isNotNull())
    rows = rows.select(F.col("item_id").cast("bigint"), "text").distinct()
    return rows.mapInArrow(split, "item bigint, term binary, times bigint").groupBy("item", "term").agg(
        F.sum("times").alias("times"))


def query_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[list[int], DataFrame]:
    """Numbers of the blocks, and the written terms with their block.

    A block holds the items that begin in its ``block_bytes`` of the running total, so at most
    that much and one more item.
    """
    terms = stage(query_terms(benchmark), "query-terms")
    sizes = terms.groupBy("item").agg(F.sum(F.octet_length("term") + 16).alias("size"))
    places = running_totals(sizes, [], [F.col("item")], {"upto": F.col("size")}).select(
        "item", F.floor((F.col("upto") - F.col("size")) / block_bytes).alias("block"))
    placed = stage(terms.join(places, "item"), "query-blocks")
    return sorted(r.block for r in placed.select("block").distinct().collect()), placed


def _load(placed: DataFrame, block: int) -> tuple[list[bytes], list[Query]]:
    """Vocabulary and queries of one block."""
    rows = placed.where(F.col("block") == block).select("item", "term", "times").toArrow()
    terms = rows["term"].to_pylist()
    vocabulary = sorted(set(terms))
    number = {t: i for i, t in enumerate(vocabulary)}
    by_item: dict[int, list[tuple[int, int]]] = {}
    for item, term, times in zip(rows["item"].to_pylist(), terms, rows["times"].to_pylist()):
        by_item.setdefault(item, []).append((number[term], times))
    return vocabulary, [
        Query(i, *np.array(sorted(of), dtype=np.int64).T) for i, of in sorted(by_item.items())
    ]


def _counted(text: bytes, number: dict[bytes, int]) -> tuple[int, Counter]:
    """All terms of a text, and occurrences by number of those in the vocabulary (others: None)."""
    n, found = 0, Counter()
    for run in runs(text):
        words = words_of(run)
        n += len(words)
        found.update(map(number.get, words))
    found.pop(None, None)
    return n, found


def corpus_counts(docs: DataFrame, vocabulary: list[bytes]) -> Corpus:
    """N, L and weights over all documents: one pass, one narrow row per term and task."""
    spark = importable(docs.sparkSession)
    shared = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        documents, length, df = 0, 0, np.zeros(len(number), dtype=np.int64)
        for batch in slices(batches):
            for text in texts(batch.column(0)):
                n, found = _counted(text, number)
                documents, length = documents + (n > 0), length + n
                df[list(found)] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[documents, length], df[some]]))],
            ["term", "n"],
        )

    rows = own_columns(docs, "text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in rows.collect()}  # at most the vocabulary of a block
    return Corpus.of(found.get(-2, 0), found.get(-1, 0), [found.get(i, 0) for i in range(len(vocabulary))])


def _best_of_block(docs: DataFrame, vocabulary: list[bytes], queries: list[Query], corpus: Corpus, top: int, shard: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, queries, corpus))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, queries, corpus = shared.value
        number = {t: i for i, t in enumerate(words)}
        best = [Best(top) for _ in queries]
        parts: tuple[list, ...] = ([], [], [], [], [])

        def flush() -> None:
            lists = Shard(corpus, *parts)
            for query, own in zip(queries, best):
                found, scores = lists.search(query, own.scores, top)
                if len(found):
                    own.add(scores, lists.ids[found], lists.no_id[found])
            for x in parts:
                x.clear()

        docs, norms, sizes, terms, counts = parts
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                n, found = _counted(text, number)
                if found:
                    docs.append(doc)
                    norms.append(corpus.norm(n))
                    sizes.append(len(found))
                    terms.extend(found)
                    counts.extend(found.values())
                    if len(terms) >= shard:
                        flush()
        if docs:
            flush()
        for query, own in zip(queries, best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own.scores), query.item)), pa.array(own.ids, mask=own.no_id), pa.array(own.scores)],
                ["item_id", "doc_id", "score"],
            )

    return docs.mapInArrow(search, "item_id bigint, doc_id bigint, score bigint")


def _top(rows: DataFrame, top: int, *keys) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES,
           shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of each item, scores above 0 only."""
    rows = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    blocks, placed = query_blocks(benchmark, block_bytes)
    each = []
    for block in blocks:
        vocabulary, queries = _load(placed, block)
        corpus = corpus_counts(rows, vocabulary)
        if corpus.documents:
            each.append(_best_of_block(rows, vocabulary, queries, corpus, top, shard))
    if not each:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    found = reduce(DataFrame.unionByName, each)
    # As many rows a query as tasks: salted first, so that no task gets all of a query's.
    salted = _top(found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS))), top, "item_id", "salt").drop("rank")
    return _top(salted, top, "item_id").select("item_id", "rank", "doc_id", "score")
