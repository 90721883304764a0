"""Written intermediate tables, and versioned Parquet tables: a new version beside the old one, then a pointer."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder that all executors share, ``spark.checkpoint.dir``.

    Only a session on one machine (``local[n]``, as in tests) may leave that unset and gets a fresh folder.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(table: DataFrame) -> None:
    """Remove a table of ``written`` that nothing reads any more."""
    context = table.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(table._scratch)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def publish(df: DataFrame, root: str, name: str) -> str:
    """Write a new version of a table and point to it; returns the version's path. One writer at a time."""
    version = f"{root}/{name}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    spark = df.sparkSession
    held = _versions(spark, root, name)
    number = 1 + (held.agg(F.max("number")).first()[0] if held is not None else 0)
    spark.createDataFrame([(number, version)], "number long, path string").coalesce(1).write.mode("append").parquet(f"{root}/{name}/_versions")
    return version


def _versions(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """(number, path) of the published versions; None before the first."""
    try:
        return spark.read.schema("number long, path string").parquet(f"{root}/{name}/_versions")
    except AnalysisException:
        return None


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The latest published version, the one with the highest number."""
    newest = spark.read.schema("number long, path string").parquet(f"{root}/{name}/_versions").orderBy(F.desc("number"), F.desc("path")).first()
    return spark.read.parquet(newest["path"])
