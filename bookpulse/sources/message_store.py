"""Stored messages: a run replaces the rows of its brokers in one commit.

Rows lie in a fixed number of buckets by their broker's hash. A run writes the buckets of its
brokers anew, into a folder of its own, and then a manifest that names the folder of every
bucket. The manifest of the next version is renamed into place: before that readers see the old
state of all brokers, after it the new one, and a run that dies changes nothing. Of two runs at
the same time one finds the version taken and starts again on what the other has stored.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookpulse import schemas

BUCKETS = 64
#: Versions whose files are kept for readers that have begun.
KEPT = 3
_ATTEMPTS = 20


class Taken(RuntimeError):
    """Another run has stored this version."""


def _storage(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    where, storage = _storage(spark, path)
    if not storage.exists(where):
        return []
    return [f.getPath().getName() for f in storage.listStatus(where)]


def versions(spark: SparkSession, path: str) -> list[int]:
    """The stored versions, oldest first."""
    return sorted(
        int(n.removeprefix("v").removesuffix(".json")) for n in _names(spark, f"{path}/_manifests") if n.startswith("v")
    )


def _manifest(spark: SparkSession, path: str, version: int) -> dict[str, str]:
    """Folder of each bucket that has rows."""
    where, storage = _storage(spark, f"{path}/_manifests/v{version:012d}.json")
    stream = storage.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, version: int, manifest: dict[str, str]) -> None:
    """Rename a finished manifest to the version's name; raises ``Taken`` where that exists."""
    draft, storage = _storage(spark, f"{path}/_manifests/draft-{uuid.uuid4().hex}")
    stream = storage.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    finally:
        stream.close()
    final, _ = _storage(spark, f"{path}/_manifests/v{version:012d}.json")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(storage.getUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(storage.makeQualified(draft), storage.makeQualified(final), no_options)
    except Py4JJavaError as error:
        storage.delete(draft, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise Taken(f"version {version} of {path}") from error
        raise


def bucket(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64("broker_id"), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, manifest: dict[str, str], names: list[str] | None = None) -> DataFrame:
    wanted = sorted(manifest if names is None else manifest.keys() & set(names), key=int)
    if not wanted:
        return spark.createDataFrame([], schemas.MESSAGES)
    folders = [f"{path}/{manifest[b]}/bucket={b}" for b in wanted]
    return spark.read.schema(schemas.MESSAGES).parquet(*folders).select(schemas.MESSAGES.names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the latest version, none where nothing has been stored."""
    stored = versions(spark, path)
    return _read(spark, path, _manifest(spark, path, stored[-1]) if stored else {})


def upsert(messages: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replace the stored rows of every broker that occurs in ``messages``; others keep theirs.

    Without rows nothing is stored. Only buckets of the brokers in the run are written; the
    rebalance keeps their files few and splits a broker too large for one task.
    """
    spark = messages.sparkSession
    rows = messages.select(schemas.MESSAGES.names)
    for _ in range(_ATTEMPTS):
        try:
            return _upsert(spark, rows, path, buckets)
        except Taken:
            continue
    raise Taken(f"{path}: {_ATTEMPTS} times another run was first")


def _upsert(spark: SparkSession, rows: DataFrame, path: str, buckets: int) -> None:
    stored = versions(spark, path)
    manifest = _manifest(spark, path, stored[-1]) if stored else {}
    brokers = rows.select("broker_id").distinct()
    touched = [str(r[0]) for r in brokers.select(bucket(buckets)).distinct().collect()]  # at most all buckets
    if not touched:
        return
    old = _read(spark, path, manifest, touched)
    kept = old.join(brokers, old.broker_id.eqNullSafe(brokers.broker_id), "left_anti")
    own = f"run-{uuid.uuid4().hex}"
    (
        kept.unionByName(rows).withColumn("bucket", bucket(buckets)).hint("rebalance", "bucket")
        .write.partitionBy("bucket").parquet(f"{path}/{own}")
    )
    _commit(spark, path, (stored[-1] if stored else 0) + 1, manifest | {b: own for b in touched})
    _forget(spark, path)


def _forget(spark: SparkSession, path: str) -> None:
    """Delete versions beyond the last ``KEPT`` and the buckets that no kept version names.

    Folders of runs that are neither named nor finished are left alone: they may be at work.
    """
    stored = versions(spark, path)
    kept, gone = stored[-KEPT:], stored[:-KEPT]
    if not gone:
        return
    needed = {(f, b) for v in kept for b, f in _manifest(spark, path, v).items()}
    for version in gone:
        for b, folder in _manifest(spark, path, version).items():
            if (folder, b) not in needed:
                where, storage = _storage(spark, f"{path}/{folder}/bucket={b}")
                storage.delete(where, True)
        where, storage = _storage(spark, f"{path}/_manifests/v{version:012d}.json")
        storage.delete(where, False)
    for folder in {f for f in _names(spark, path) if f.startswith("run-")} - {f for f, _ in needed}:
        names = _names(spark, f"{path}/{folder}")
        if "_SUCCESS" in names and not any(n.startswith("bucket=") for n in names):
            where, storage = _storage(spark, f"{path}/{folder}")
            storage.delete(where, True)
