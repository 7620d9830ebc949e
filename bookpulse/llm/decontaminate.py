"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive words of a benchmark item. Tables for one pattern
length hold, per block of words, how far the search may jump (shift), and, per last and
first block of a window, where in the items such windows stand (suffix hash with prefix
check). What the tables let through is compared word by word.

Rows: a null text has no words; an item without words or with a null item_id has no
windows; items of one item_id count once, and a window that several items share counts for
each of them; repeated documents are judged once each; very long texts are searched in runs,
very long items are cut into pieces that share words; empty tables give no hits or no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookpulse.llm.common import importable, own_columns, runs, slices, texts
from bookpulse.session import stage

WINDOW = 10
#: Benchmark text whose tables one worker holds at a time (about 100 times that in memory).
BLOCK_BYTES = 2_000_000
FOUND = "n_words bigint, hits array<struct<start:bigint,end:bigint>>, items array<bigint>"

#: Words are runs of digits, letters a-z and all characters beyond ASCII; A-Z are lower-cased.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Patterns:
    """Wu-Manber tables for all windows of one length ``m`` over word lists."""

    def __init__(self, items: list[tuple[int, list[bytes]]], m: int, block: int = 2):
        self.items, self.m, self.b = items, m, min(block, m)
        self.jump = m - self.b + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(items):
            for end in range(self.b, len(words) + 1):
                block_words = tuple(words[end - self.b:end])
                # The window in which this block stands furthest right ends here, or begins the item.
                left = max(0, m - end)
                if left < self.shift.get(block_words, self.jump):
                    self.shift[block_words] = left
                if end >= m:
                    key = block_words + tuple(words[end - m:end - m + self.b])
                    self.bucket.setdefault(key, []).append((k, end - m))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(position, items) of every occurrence of a window in ``words``."""
        m, b, jump, n = self.m, self.b, self.jump, len(words)
        shift, bucket, items = self.shift, self.bucket, self.items
        end = m
        while end <= n:
            last = tuple(words[end - b:end])
            step = shift.get(last, jump)
            if step:
                end += step
                continue
            start = end - m
            candidates = bucket.get(last + tuple(words[start:start + b]))
            if candidates:
                window = words[start:end]
                found = [k for k, at in candidates if items[k][1][at:at + m] == window]
                if found:
                    yield start, found
            end += 1


class Search:
    """All pattern tables of a block of items: one for full windows, one per shorter length."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        same: dict[bytes, bytes] = {}
        by_length: dict[int, list[tuple[int, list[bytes]]]] = {}
        for item, text in items:
            words = [same.setdefault(w, w) for w in words_of(text)]
            if words:
                by_length.setdefault(min(len(words), window), []).append((item, words))
        self.tables = [Patterns(of, m) for m, of in sorted(by_length.items())]
        self.overlap = max([t.m for t in self.tables], default=1) - 1

    def __call__(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Words of ``text``, the sorted separate [start, end) ranges of hit words, the items found."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        seen, carried = 0, []
        for run in runs(text.translate(_FOLD)):
            words = carried + run.split()
            base = seen - len(carried)
            for table in self.tables:
                for start, found in table.find(words):
                    spans.append((base + start, base + start + table.m))
                    items.update(table.items[k][0] for k in found)
            seen = base + len(words)
            carried = words[max(0, len(words) - self.overlap):] if self.overlap else []
        spans.sort()
        merged: list[tuple[int, int]] = []
        for start, end in spans:
            if merged and start <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((start, end))
        return seen, merged, items


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW,
                     block_bytes: int = BLOCK_BYTES) -> tuple[list[int], DataFrame]:
    """Numbers of the blocks, and a written table (block, item, words) of all items.

    A block has at most about ``block_bytes`` of words; one is loaded at a time. Long items are cut into pieces that share ``window - 1`` words, so every window lies in
    one piece; pieces are dealt to blocks by a running total of their bytes.
    """
    importable(benchmark.sparkSession)
    least = max(block_bytes // 4, 64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pieces = [], []
            for item, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                # A piece has a window at least, unless the whole item has fewer words.
                carried, cut_off = [], False
                for run in runs(text.translate(_FOLD), least):
                    carried += run.split()
                    if len(carried) >= window:
                        ids.append(item)
                        pieces.append(b" ".join(carried))
                        carried, cut_off = carried[len(carried) - window + 1:], True
                if carried and not cut_off:
                    ids.append(item)
                    pieces.append(b" ".join(carried))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pieces, pa.binary())], ["item", "words"])

    rows = own_columns(benchmark, "item_id", "text").where(F.col("item_id").isNotNull())
    pieces = stage(
        rows.select(F.col("item_id").cast("bigint"), "text").mapInArrow(cut, "item bigint, words binary"), "items"
    )
    size = F.octet_length("words")
    number = F.pmod(F.xxhash64("item", "words"), F.lit(1 << 20))
    spread = pieces.groupBy(number.alias("slot")).agg(F.sum(size).alias("bytes"))
    upto = F.sum("bytes").over(Window.orderBy("slot"))  # at most 2**20 narrow rows
    placed = stage(
        pieces.withColumn("slot", number)
        .join(spread.select("slot", F.floor((upto - F.col("bytes")) / block_bytes).alias("block")), "slot")
        .select("block", "item", "words"),
        "item-blocks",
    )
    return [r.block for r in placed.select("block").distinct().orderBy("block").collect()], placed


def _load(placed: DataFrame, block: int) -> list[tuple[int, bytes]]:
    rows = placed.where(F.col("block") == block).select("item", "words").distinct().collect()
    return sorted((r.item, bytes(r.words)) for r in rows)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, hits (separate ranges of hit words) and items (sorted ids) of every document.

    A benchmark beyond one block is searched block by block against all documents; the
    narrow findings of the blocks are then put together per row.
    """
    spark = importable(docs.sparkSession)
    rows = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    blocks, placed = benchmark_blocks(benchmark, window, block_bytes)
    if len(blocks) <= 1:
        return _search(rows, spark.sparkContext.broadcast(_load(placed, blocks[0]) if blocks else []), window)
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "documents")
    each = [
        _search(rows, spark.sparkContext.broadcast(_load(placed, b)), window, "row") for b in blocks
    ]
    found = reduce(DataFrame.unionByName, each).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return found.select("doc_id", "n_words", "hits", "items")


def _search(rows: DataFrame, items, window: int, *extra: str) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Search(items.value, window)
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in slices(batches):
            found = [find(t) for t in texts(batch.column(1))]
            hits = pa.array([[{"start": a, "end": b} for a, b in f[1]] for f in found], pa.list_(span))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([f[0] for f in found], pa.int64()), hits,
                    pa.array([sorted(f[2]) for f in found], pa.list_(pa.int64())),
                    *(batch.column(2 + i) for i in range(len(extra))),
                ],
                ["doc_id", "n_words", "hits", "items", *extra],
            )

    kinds = "".join(f", {c} bigint" for c in extra)
    return rows.select("doc_id", "text", *extra).mapInArrow(search, f"doc_id bigint, {FOUND}{kinds}")


def covered(hits: Column) -> Column:
    """Words in the union of sorted ranges."""
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("upto"))
    return F.aggregate(
        hits, start,
        lambda a, x: F.struct(
            (a["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["upto"]))).alias("sum"),
            F.greatest(a["upto"], x["end"]).alias("upto"),
        ),
    )["sum"]


def contamination_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of ``find_contamination`` rows."""
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", covered(F.col("hits")).alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with all their columns."""
    spark = importable(docs.sparkSession)
    blocks, placed = benchmark_blocks(benchmark, window, block_bytes)
    at = docs.columns.index("text")
    for b in blocks:
        items = spark.sparkContext.broadcast(_load(placed, b))

        def clean(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            find = Search(items.value, window)
            for batch in slices(batches):
                yield batch.filter(pa.array(np.array([not find(t)[1] for t in texts(batch.column(at))], dtype=bool)))

        docs = docs.mapInArrow(clean, docs.schema)
        if len(blocks) > 1:
            docs = stage(docs, "decontaminated")
    return docs
