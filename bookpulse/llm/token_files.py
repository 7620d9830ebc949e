"""Token-id output: Parquet files with list columns, for selective reads of tokens or of metadata.

Layout of a folder: ``ids`` holds one row per document (doc_id, part, local_start, n_tokens,
ids) in ascending doc_id order, over files and within them; ``parts`` one row per file
position with the number of ids before it. Ids are dictionary-encoded, the integer columns
delta-encoded; row groups and pages are small enough that the page indexes on doc_id leave
only the pages asked for to be read.

Rows: a null text is empty and holds the end id only; null doc_ids come first; repeated
rows stay, ordered by their text; very long texts are encoded in runs, as one row; an empty table gives an empty, readable folder; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookpulse.llm.common import importable, own_columns, slices, texts
from bookpulse.llm.tokens import encoder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
IDS_SCHEMA = "doc_id bigint, part int, local_start bigint, n_tokens bigint, ids array<int>"

_FORMAT = {
    "parquet.writer.version": "PARQUET_2_0",      # delta encoding of the integer columns
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.page.write-checksum.enabled": "true",
    "compression": "zstd",
}


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2,
    row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES,
) -> None:
    """Encode every text, append ``end_id`` and write the files in ascending doc_id order.

    Texts are range-sorted before they are encoded, so each is encoded once and ids never
    cross the network; a task streams its sorted range and keeps one running count.
    """
    spark = importable(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, part, total = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            coded = [encode_text(t) + end for t in texts(batch.column(1))]
            counts = np.array([len(c) // 4 for c in coded], dtype=np.int64)
            upto = total + np.cumsum(counts)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(coded), dtype="<i4"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.full(len(coded), part, dtype=np.int32)),
                    pa.array(upto - counts), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), ids),
                ],
                ["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            total = int(upto[-1]) if len(upto) else total

    rows = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    coded = (
        # Rows of one doc_id, null included, are split by the beginnings of their texts.
        rows.repartitionByRange("doc_id", F.substring("text", 1, 48)).sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, IDS_SCHEMA)
    )
    writer = coded.write.options(**_FORMAT).option("parquet.block.size", row_group_bytes)
    writer.option("parquet.page.size", page_bytes).parquet(f"{folder}/ids")

    # One row per file position: as many as the sort had partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    (
        read_metadata(spark, folder).groupBy("part").agg(F.sum("n_tokens").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ids_before"))
        .write.parquet(f"{folder}/parts")
    )


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """All columns but the ids; the id pages are not read."""
    return spark.read.schema(IDS_SCHEMA).parquet(f"{folder}/ids").drop("ids")


def read_tokens(
    spark: SparkSession, folder: str, first_doc: int | None = None, last_doc: int | None = None
) -> DataFrame:
    """doc_id, start, n_tokens, ids; with bounds only the pages of those documents are read."""
    rows = spark.read.schema(IDS_SCHEMA).parquet(f"{folder}/ids")
    if first_doc is not None:
        rows = rows.where(F.col("doc_id") >= first_doc)
    if last_doc is not None:
        rows = rows.where(F.col("doc_id") <= last_doc)
    parts = spark.read.schema("part int, ids_before bigint").parquet(f"{folder}/parts")
    return rows.join(parts, "part").select(
        "doc_id", (F.col("local_start") + F.col("ids_before")).alias("start"), "n_tokens", "ids"
    )


def with_checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (over little-endian unsigned 32-bit ids) of read rows."""
    importable(tokens.sparkSession)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column(3)
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = lists.offsets.to_numpy()
            crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            counted = np.diff(at).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counted), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    rows = tokens.select("doc_id", "start", "n_tokens", "ids")
    return rows.mapInArrow(check, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
