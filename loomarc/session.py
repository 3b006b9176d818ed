"""Sessions and shipping of this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship_package(spark: SparkSession) -> SparkSession:
    """Let Python workers on machines that see this checkout import it.

    A cluster without a shared checkout installs the package or passes it with
    ``--py-files``; this then changes nothing that matters.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_HOME, *[p for p in paths if p]])
    return spark


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine."""
    return ship_package(
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


_OWN: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share, which is
    ``spark.checkpoint.dir``; only on one machine may that be unset."""
    context = spark.sparkContext
    told = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        told = _OWN.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="loomarc-")
        _OWN[context.applicationId] = told
    return f"{told.rstrip('/')}/loomarc/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table at a :func:`shared_path`."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
