"""CSV files read by many tasks, with line breaks inside quotes.

A reader that starts in the middle of a file cannot know whether it stands inside quotes. The
first pass counts the quotes of every split; added up over the splits of a file, an odd total
says that the next split begins inside a quoted field. With that known, the second pass glues
the lines of each record where they are read; only what a record has in a further split is
moved, at most two pieces a split. Quotes within a field are doubled (RFC 4180).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookpulse.session import importable

_RECORD, _HEAD, _TAIL, _MIDDLE = range(4)
_PIECES = "kind int, file string, block bigint, header boolean, text string"
_OPTIONS = {"quote": '"', "escape": '"'}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def _open_splits(lines: DataFrame) -> dict[tuple[str, int], bool]:
    """Per split whether it begins inside quotes; one row per split reaches the driver."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = odd.select("file", "block", "odd", (F.sum("odd").over(upto) % 2).alias("ends_open")).collect()
    last: dict[str, tuple[int, int]] = {}
    for r in rows:
        last[r.file] = max(last.get(r.file, (-1, 0)), (r.block, r.ends_open))
    unclosed = sorted(file for file, (_, is_open) in last.items() if is_open)
    if unclosed:
        raise ValueError(f"a quote is never closed in {', '.join(unclosed[:5])}")
    return {(r.file, r.block): (r.odd + r.ends_open) % 2 == 1 for r in rows}


def _pieces(begins_open: dict[tuple[str, int], bool]):
    """Function over batches of (value, file, block), in file order within a split."""

    def glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, first, is_open = None, True, False
        waiting: list[str] = []   # lines of the record that is not complete yet
        kind = _RECORD            # what the waiting lines are if a quote closes them
        out: list[list] = [[], [], [], [], []]

        def put(kind: int, text: str, header: bool) -> None:
            for column, value in zip(out, (kind, split[0], split[1], header, text)):
                column.append(value)

        def close_split() -> None:
            if split is not None and waiting:
                put(_MIDDLE if kind == _HEAD else _TAIL, "\n".join(waiting), header_waits)
                waiting.clear()

        def taken() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.string()))],
                ["kind", "file", "block", "header", "text"])
            for column in out:
                column.clear()
            return batch

        header_waits = False
        for batch in batches:
            flips = pc.count_substring(batch.column(0), '"').to_numpy(zero_copy_only=False) % 2 == 1
            for value, file, block, flip in zip(*(batch.column(i).to_pylist() for i in range(3)), flips.tolist()):
                if split is None or split[1] != block or split[0] != file:
                    close_split()
                    split, first = (file, block), True
                    if split not in begins_open:
                        raise RuntimeError(f"the files were split anew between two passes: {file} at {block}")
                    is_open = begins_open[split]
                    kind = _HEAD if is_open else _RECORD
                if not is_open and not waiting:
                    kind, header_waits = _RECORD, first and block == 0
                is_open ^= flip
                if is_open:
                    waiting.append(value)
                elif waiting or kind == _HEAD:
                    waiting.append(value)
                    put(kind, "\n".join(waiting), header_waits)
                    waiting.clear()
                    kind = _RECORD
                else:
                    put(_RECORD, value, header_waits)
                first = False
            yield taken()
        close_split()
        if out[0]:
            yield taken()

    return glue


def _glued(pieces: DataFrame) -> DataFrame:
    """Records whose lines lie in several splits: a tail, then whole splits, then a head."""
    upto = Window.partitionBy("file").orderBy("block", "begins")
    parts = pieces.where(F.col("kind") != _RECORD).withColumn("begins", (F.col("kind") == _TAIL).cast("int"))
    numbered = parts.withColumn("record", F.sum("begins").over(upto))  # at most two rows a split
    return numbered.groupBy("file", "record").agg(
        F.max("header").alias("header"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "begins", "text"))), lambda x: x["text"]), "\n").alias("text"),
    ).select("file", "header", "text")


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, header (the first of its file) and text of every record, line breaks as line feeds; blank lines left out."""
    lines = _lines(importable(spark), path)
    pieces = lines.mapInArrow(_pieces(_open_splits(lines)), _PIECES)
    whole = pieces.where(F.col("kind") == _RECORD).select("file", "header", "text")
    return whole.unionByName(_glued(pieces)).where(F.trim("text") != "")


def _names(record: str) -> list[str]:
    """The fields of a header."""
    import csv

    return next(csv.reader([record.removeprefix("﻿")], strict=True))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by the header that every file begins with."""
    found = records(spark, path)
    headers = {r.text.removeprefix("﻿") for r in found.where("header").select("text").distinct().limit(2).collect()}
    if len(headers) != 1:
        raise ValueError(f"no header in {path}" if not headers else f"the files of {path} begin with different headers")
    names = _names(headers.pop())
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    parsed = found.where(~F.col("header")).select(F.from_csv("text", schema, _OPTIONS).alias("r"))
    return parsed.select("r.*")
