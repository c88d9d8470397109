"""Intermediate tables in the folder that the driver and all executors share.

Every lineage cut of this subpackage is a Parquet table below
``spark.checkpoint.dir``, so a lost executor never loses an intermediate
result.  The setting is read from the session; only where it is unset *and* the
master is local (tests) a temporary folder is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def base(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="vecloom-")
    return _LOCAL[app]


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{base(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet and return the reread table: computed once, no lineage.

    ``instead_of`` is an earlier such table that nothing reads any more once
    this one is written; its files are removed.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if instead_of is not None:
        for old in {f.rpartition("/")[0] for f in instead_of.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(old)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return spark.read.schema(df.schema).parquet(path)
