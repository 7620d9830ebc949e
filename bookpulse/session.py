"""Session settings the jobs rely on, and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the run-time settings that results depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package; clusters ship it with ``--py-files``."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
    return spark


def work_folder(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Where that is unset, a folder below the warehouse: shared only if the warehouse is, which by
    default it is not, so several machines need one of the two settings.
    """
    shared = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/bookpulse/{spark.sparkContext.applicationId}"


def keep_checkpoints(spark: SparkSession) -> None:
    """Give iterative fits a folder to cut their lineage in, where the cluster names none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{work_folder(spark)}/rdd")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage on reliable storage, so a lost executor never makes two readers
    of the same intermediate table see different rows, and keeps column pruning.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/stage/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; frames built on them end here."""
    _delete(spark, f"{work_folder(spark)}/stage")


def drop_work(spark: SparkSession) -> None:
    """Delete all that this application has left in the work folder: intermediate tables, files, stages of a pipeline."""
    _delete(spark, work_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
