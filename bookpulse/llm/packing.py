"""Pack documents into fixed-length sequences along a space-filling curve.

A document's hashed token counts are projected to a few dimensions; the Hilbert key of that
point orders the documents, so that neighbours in a sequence are alike. Along the curve
the ids of all documents form one stream that is cut at every ``length`` ids: every
sequence but the last is full.

Rows: a null text is empty and holds the end id only; null doc_ids count as documents;
repeated rows are packed once each; ties on the curve go by doc_id, then by place in the
input; an empty table gives no pieces; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookpulse.functions.running import running_totals
from bookpulse.llm.common import importable, own_columns, slices, texts
from bookpulse.llm.tokens import encoder
from bookpulse.session import stage

LENGTH = 4096
FEATURES, DIMENSIONS, BITS, SEED = 512, 4, 12, 7
_CODED = "row bigint, doc_id bigint, curve bigint, n_tokens bigint, ids binary"
_PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points (rows of coordinates below 2**bits) on the Hilbert curve.

    The curve visits every cell of the grid once and moves by one step in one coordinate.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the sub-cubes, largest first
        low = q - 1
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[dims - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


class Projection:
    """Hashed token counts of a document, projected to a point of the grid."""

    def __init__(self, features: int = FEATURES, dimensions: int = DIMENSIONS, bits: int = BITS, seed: int = SEED):
        self.features, self.bits = features, bits
        self.axes = np.random.default_rng(seed).standard_normal((features, dimensions))
        self.bucket_of = np.zeros(0, dtype=np.int64)

    def buckets(self, ids: np.ndarray) -> np.ndarray:
        """The hashed place of each id, from a table as long as the largest id met."""
        if len(ids) and (top := int(ids.max())) >= len(self.bucket_of):
            known = np.arange(max(top + 1, 1 << 16), dtype=np.uint64)
            mixed = (known * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            self.bucket_of = (mixed % np.uint64(self.features)).astype(np.int64)
        return self.bucket_of[ids]

    def points(self, documents: list[np.ndarray]) -> np.ndarray:
        counts = np.zeros((len(documents), self.features))
        for row, ids in zip(counts, documents):
            row += np.bincount(self.buckets(ids), minlength=self.features)
        weights = np.sqrt(counts)
        weights /= np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-9)
        place = (weights @ self.axes + 4) / 8  # standard normal coordinates: 4 deviations each way
        top = (1 << self.bits) - 1
        return np.clip((place * (top + 1)).astype(np.int64), 0, top)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """row, doc_id, curve (Hilbert key), n_tokens, ids (little-endian uint32); one row per document.

    ``row`` numbers the rows by task and place; write the table before relying on it twice.
    """
    importable(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, projection = encoder(tokenizer).encode, Projection()
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            coded = [encode_text(t) + end for t in texts(batch.column(1))]
            keys = hilbert_keys(projection.points([np.frombuffer(c, "<u4") for c in coded]), BITS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(coded))), batch.column(0), pa.array(keys),
                    pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(coded, pa.binary()),
                ],
                ["row", "doc_id", "curve", "n_tokens", "ids"],
            )
            row += len(coded)

    rows = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(encode, _CODED)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 2) -> DataFrame:
    """One row per piece, with its ids, of the sequences that ``docs`` are packed into.

    Encoded documents are written once; only their narrow keys are range-sorted and added
    up (a running total over the whole curve, piece by piece), then joined to the ids.
    """
    coded = stage(encode_documents(docs, tokenizer, end_id), "encoded")
    order = coded.select("row", "doc_id", "curve", F.col("n_tokens").alias("n"))
    starts = running_totals(
        order, [], [F.col("curve"), F.col("doc_id"), F.col("row")], {"upto": F.col("n")}
    ).select("row", (F.col("upto") - F.col("n")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(8)]
            for doc, ids, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
                total, start = len(ids) // 4, 0
                while start < total:
                    sequence, offset = divmod(at + start, length)
                    taken = min(length - offset, total - start)
                    piece = ids[4 * start:4 * (start + taken)]
                    for column, value in zip(
                        out, (doc, start, taken, zlib.crc32(piece), total, sequence, offset, piece)
                    ):
                        column.append(value)
                    start += taken
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in out[:7]), pa.array(out[7], pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return (
        coded.select("row", "doc_id", "ids").join(starts, "row")
        .select("doc_id", "ids", "at").mapInArrow(cut, _PIECES + ", ids binary")
    )


def padded_length(sequences: DataFrame, length: int = LENGTH) -> DataFrame:
    """sequence_id, used and padded ids: up to ``length``, but a power of two stays as it is."""
    used = F.col("used")
    return (
        sequences.groupBy("sequence_id").agg(F.sum("length").alias("used"))
        .withColumn("padding", F.when(F.bit_count(used) == 1, 0).otherwise(length - used))
    )
