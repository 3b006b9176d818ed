"""Helpers shared by the training-data operators: scratch tables and id folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    ``spark.checkpoint.dir`` of the session; only where that is unset (tests
    on one machine) a temporary folder is made once for the application.
    """
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_SCRATCH:
        _OWN_SCRATCH[app] = "file://" + tempfile.mkdtemp(prefix="loomarc-")
    return _OWN_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below :func:`scratch_dir`."""
    return f"{scratch_dir(spark)}/loomarc/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage, so a lost executor never recomputes what came
    before, and lets several later steps read one computation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def with_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most rows of one or two numbers that are broadcast (16 MB at 16 bytes).
BROADCAST_ROWS = 1_000_000


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most for the jobs run inside, where
    rows are wide; the session's own setting is put back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    with _setting(spark, key, str(min(rows, before) if before > 0 else rows)):
        yield


@contextmanager
def uncoalesced(spark: SparkSession) -> Iterator[None]:
    """Keep all shuffle partitions of the jobs run inside, for those that do
    much work on few bytes; the session's own setting is put back after."""
    with _setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        yield


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Mark a table of a few numbers a row, already staged, for broadcast if
    its rows are at most ``BROADCAST_ROWS``; else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def without(df: DataFrame, key: str, drop: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in the one-column table ``drop``.

    A table of at most ``BROADCAST_ROWS`` numbers is broadcast, so that wide
    rows stay where they are; a larger one is joined by a shuffle.  Rows with
    a null key stay unless ``drop`` holds a null.
    """
    keys = staged(drop.select(F.col(drop.columns[0]).alias("_drop")).distinct(), "drop")
    return df.join(broadcast_if_small(keys), F.col(key).eqNullSafe(F.col("_drop")), "left_anti")
