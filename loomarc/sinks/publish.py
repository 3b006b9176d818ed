"""Publishing a table in buckets that are named by their content.

A row's bucket follows from its key.  A bucket's digest is that of the sorted
digests of its rows, and a version is named by the digest of its buckets'
digests, so neither depends on the order of rows or the number of tasks.  Only
buckets whose digest is not stored yet are written; then the manifest of the
version is, as one file and last, and readers follow the newest manifest.  A
job that fails before leaves readers what they had.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written


def bucket_of(key: Column, buckets: int) -> Column:
    return (F.conv(F.substr(F.sha1(key.cast("string")), F.lit(1), F.lit(8)), 16, 10).cast("long") % buckets).cast("int")


def row_digest(columns: list[str]) -> Column:
    """sha256 of a row as JSON, its columns by name, nulls among them."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def manifest(items: DataFrame, key: str, buckets: int) -> DataFrame:
    """(bucket, digest, rows) of items; a bucket holds so few rows that their
    digests are sorted in one place (64 bytes each)."""
    each = items.select(bucket_of(F.col(key), buckets).alias("bucket"), row_digest(items.columns).alias("row"))
    return each.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("row")), ""), 256).alias("digest"), F.count("*").alias("rows"))


def version_of(manifest_: DataFrame) -> str:
    """The digest of all buckets' digests; a row for each bucket is read."""
    digests = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(F.lpad(F.col("bucket").cast("string"), 10, "0"), "digest"))), ""), 256)
    return manifest_.agg(digests).first()[0]


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/manifests")
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def newest(spark: SparkSession, path: str, back: int = 0) -> DataFrame | None:
    """The manifest of the newest version, or of one so many before it."""
    known = _manifests(spark, path)
    if known is None:
        return None
    numbers = sorted((r[0] for r in known.select("number").distinct().collect()), reverse=True)
    return known.where(F.col("number") == numbers[back]) if back < len(numbers) else None


def publish(items: DataFrame, key: str, path: str, buckets: int = 64) -> tuple[str, int]:
    """(version, buckets written) after publishing items under ``path``.

    Unchanged items write nothing, not even a manifest.
    """
    spark = items.sparkSession
    now = written(manifest(items, key, buckets), "manifest")
    version, before = version_of(now), newest(spark, path)
    if before is not None and before.select("version").first()[0] == version:
        return version, 0
    known = _manifests(spark, path)
    fresh = now if known is None else now.join(known.select("digest").distinct(), "digest", "left_anti")
    fresh = written(fresh.select("bucket", "digest"), "fresh")
    count = fresh.count()
    if count:
        rows = items.withColumn("_bucket", bucket_of(F.col(key), buckets)).join(F.broadcast(fresh.withColumnRenamed("bucket", "_bucket")), "_bucket").drop("_bucket")
        # A repeated job replaces the buckets that it left half written.
        writer = rows.repartition("digest").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("digest").parquet(f"{path}/buckets")
    number = 0 if before is None else before.select("number").first()[0] + 1
    now.withColumn("version", F.lit(version)).withColumn("number", F.lit(number)).coalesce(1).write.mode("append").parquet(f"{path}/manifests")
    return version, count


def published(spark: SparkSession, path: str, back: int = 0) -> DataFrame:
    """The rows of the newest version, or of one so many before it."""
    wanted = newest(spark, path, back)
    if wanted is None:
        raise ValueError(f"no such version under {path}")
    return spark.read.parquet(f"{path}/buckets").join(F.broadcast(wanted.select("digest")), "digest", "left_semi").drop("digest")


def stale(spark: SparkSession, path: str, keep: int = 2) -> DataFrame:
    """(digest) of stored buckets that none of the ``keep`` newest versions has."""
    known = _manifests(spark, path)
    if known is None:
        raise ValueError(f"nothing is published under {path}")
    last = sorted((r[0] for r in known.select("number").distinct().collect()), reverse=True)[:keep]
    return known.select("digest").distinct().join(known.where(F.col("number").isin(last)).select("digest"), "digest", "left_anti")


def unparsed(items: DataFrame, receipts: DataFrame, key: str, digest: Column, parser: str) -> DataFrame:
    """Items without a receipt (key, digest, parser) for their content by this
    parser: those to be parsed, or parsed again."""
    valid = receipts.where(F.col("parser") == parser).select(key, F.col("digest").alias("_digest"))
    return items.withColumn("_digest", digest).join(valid, [key, "_digest"], "left_anti").drop("_digest")
