"""Reading and writing the tables of the book."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType, StructType

from bookpulse import schemas
from bookpulse.functions.numbers import finite, read_number
from bookpulse.operators import boosting
from bookpulse.operators.boosting import BoostedTrees
from bookpulse.sources import csv_records, lineage, message_store

TABLES = {
    "features": schemas.SCORED_FEATURES,
    "opportunities": schemas.OPPORTUNITIES,
    "churn_labels": schemas.CHURN_LABELS,
    "churn_scores": schemas.CHURN_SCORES,
    "messages": schemas.MESSAGES,
}


def read_transactions(
    spark: SparkSession, path: str, fmt: str = "parquet", multi_line: bool = True
) -> DataFrame:
    """Raw transactions; the ten known columns get their raw types, others stay as read.

    CSV is read without a type scan: every column arrives as text and is cast here. Large
    files are read by many tasks; line breaks inside quotes belong to their field, and a
    quote that is never closed is an error. ``multi_line=False`` saves the pass over the
    quotes where every record is known to be one line.
    """
    if fmt == "csv" and multi_line:
        return type_raw(csv_records.read_csv(spark, path))
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(header=True, quote='"', escape='"')
    return type_raw(reader.load(path))


def type_raw(df: DataFrame) -> DataFrame:
    """Cast the known raw columns: keys and texts to string, rates to double."""
    casts = {}
    for field in schemas.RAW_TRANSACTIONS:
        column, given = F.col(field.name), df.schema[field.name].dataType
        if field.dataType != DoubleType():
            casts[field.name] = column.cast("string")
        elif isinstance(given, NumericType):
            casts[field.name] = finite(column.cast("double"))
        else:
            casts[field.name] = read_number(column.cast("string"))
    return df.withColumns(casts)


def _on_storage(spark: SparkSession, *parts: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def exists(spark: SparkSession, path: str) -> bool:
    """True when a finished table lies at ``path`` (a failed write leaves no marker)."""
    return _on_storage(spark, path, "_SUCCESS")


def read_table(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """Read table ``name`` under ``folder`` with its declared schema."""
    schema = TABLES[name]
    return spark.read.schema(schema).parquet(f"{folder}/{name}").select(schema.names)


def _read_or_empty(spark: SparkSession, path: str, schema: StructType, present: bool) -> DataFrame:
    if present:
        return spark.read.schema(schema).parquet(path).select(schema.names)
    return spark.createDataFrame([], schema)


def read_scores_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """The four reporting columns of the churn scores, or an empty typed table."""
    scores = _read_or_empty(spark, path, schemas.CHURN_SCORES, exists(spark, path))
    return scores.select(*schemas.SCORE_COLUMNS)


def read_messages_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """Stored messages, or an empty typed table."""
    return message_store.read(spark, path)


def get_or_build(
    spark: SparkSession, path: str, builder: Callable[[], DataFrame], recipe: str | None = None
) -> DataFrame:
    """Read the table at ``path``; build and write it first when it is missing.

    With a ``recipe`` also when the stored table was built from something else.
    """
    if not is_current(spark, path, recipe):
        write_table(builder(), path)
        if recipe is not None:
            lineage.store_recipe(spark, path, recipe)
    return spark.read.parquet(path)


def is_current(spark: SparkSession, path: str, recipe: str | None, marker: str = "") -> bool:
    """Is there a finished table at ``path``, built by this recipe? ``marker`` is a folder whose end shows the table's."""
    if not exists(spark, f"{path}{marker}"):
        return False
    return recipe is None or lineage.stored_recipe(spark, path) == recipe


def write_table(df: DataFrame, path: str) -> None:
    """Replace the table at ``path``."""
    df.write.mode("overwrite").parquet(path)


def upsert_messages(messages: DataFrame, path: str) -> None:
    """Replace the stored messages of every broker that occurs in ``messages``.

    Brokers that do not occur keep their rows, so an empty run changes nothing; readers see
    all of a run or nothing of it.
    """
    message_store.upsert(messages, path)


def export_json(df: DataFrame, path: str) -> None:
    """Replace ``path`` with one JSON record per row, as other programs read messages."""
    df.write.mode("overwrite").json(path)


def save_model(model: BoostedTrees, path: str) -> None:
    """Replace the model at ``path``; the feature list is part of its head."""
    boosting.save(model, path)


def load_model(path: str) -> tuple[BoostedTrees, list[str]]:
    """The fitted model and the names of its input columns."""
    model = boosting.load(path)
    return model, list(model.inputs)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table, if there is one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
