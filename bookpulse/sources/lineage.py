"""What a stored table was built from, so that it is built again when that changes.

A raw table is known by an order-free digest of its rows. A derived table is known by a
recipe: its name, the settings that shape it, and the recipes of the tables it is built from.
The recipe lies beside the table's files; a table whose stored recipe differs from the one
asked for follows from something else and is built anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

#: Bump when the rules of a table change, so that tables of older code are built anew.
RULES = 1
RECIPE = "_recipe.json"  # readers of a folder skip names that begin with an underscore
_LIMB = 22               # bits; sums of limbs hold 2 ** 41 rows
_PER_MASK = 60


def digest_parts(columns: Sequence[str]) -> dict[str, Column]:
    """Aggregates that are equal for equal rows in any order, repeated rows counted.

    Null marks are hashed as well, since a null alone leaves a hash as it is. Fixed-width
    sums of 22-bit limbs, combined before anything moves, cannot overflow.
    """
    values = [F.col(f"`{c}`") for c in columns]
    masks = [
        sum((F.when(v.isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, v in enumerate(values[at:at + _PER_MASK])),
            F.lit(0).cast("bigint"))
        for at in range(0, len(values), _PER_MASK)
    ]
    row = F.xxhash64(*masks, *values)
    limb = (1 << _LIMB) - 1
    return {
        "n": F.count(F.lit(1)),
        "x": F.coalesce(F.bit_xor(row), F.lit(0)),
        **{
            f"s{k}": F.coalesce(F.sum(F.shiftrightunsigned(row, k * _LIMB).bitwiseAND(F.lit(limb))), F.lit(0))
            for k in range(3)
        },
    }


def digest_text(found: Mapping[str, int] | Row, columns: Sequence[str]) -> str:
    """One short text from the aggregates and the names of the columns."""
    parts = [*columns, *(str(found[k]) for k in ("n", "x", "s0", "s1", "s2"))]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


def table_digest(df: DataFrame, columns: Sequence[str]) -> str:
    """Digest of the rows of ``df`` in ``columns``: one scan, one hash aggregate, one row."""
    return digest_text(df.agg(*[c.alias(k) for k, c in digest_parts(columns).items()]).first(), columns)


def observed(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, Callable[[], str]]:
    """``df``, and its digest once it has been written: taken on the way, without a scan of its own.

    A write that is repeated in part may count rows twice; the digest then fits no input, and
    the next run builds the table again.
    """
    watch = Observation()
    watched = df.observe(watch, *[c.alias(k) for k, c in digest_parts(columns).items()])
    return watched, lambda: digest_text(watch.get, columns)


def recipe(name: str, inputs: Mapping[str, str], settings: Mapping[str, object] | None = None) -> str:
    """Text that two builds of a table share if and only if they follow from the same things."""
    return json.dumps(
        {"table": name, "rules": RULES, "inputs": dict(inputs), "settings": dict(settings or {})}, sort_keys=True
    )


def short(text: str | None) -> str:
    """A recipe as it is named by the tables that build on it."""
    return hashlib.sha256((text or "").encode()).hexdigest()[:32]


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{RECIPE}")
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def stored_recipe(spark: SparkSession, path: str) -> str | None:
    """The recipe beside the table at ``path``, if there is one."""
    where, storage = _file(spark, path)
    if not storage.exists(where):
        return None
    stream = storage.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def store_recipe(spark: SparkSession, path: str, text: str) -> None:
    """Write the recipe; last, so that a table without one is never taken for whole."""
    where, storage = _file(spark, path)
    stream = storage.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
