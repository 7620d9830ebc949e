"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Texts longer than this are worked through in runs of about so many bytes.
RUN_BYTES = 1 << 22


#: Rows reach Python in batches of about so many bytes (or one row).
BATCH_BYTES = 8 << 20


def importable(spark: SparkSession) -> SparkSession:
    """Prepare a session for Python workers: small batches of rows, and the package on their path.

    The path serves workers on this machine; clusters ship the package with ``--py-files``.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, whatever others the table has."""
    return df.select(*[df[f"`{n}`"] for n in names])


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that work on a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs(data: bytes, size: int = RUN_BYTES) -> Iterator[bytes]:
    """Cut at spaces into runs of about ``size`` bytes; no word is cut."""
    at = 0
    while len(data) - at > size:
        end = data.find(b" ", at + size)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
