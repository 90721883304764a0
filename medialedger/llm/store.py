"""Where intermediate tables go, and membership filters of bounded size."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a session on one machine (``local[n]``, as in tests) may leave it unset and gets a fresh folder; anywhere else that
    is an error, since executors would write where nobody else can read.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back; cuts the lineage, survives lost executors.

    The table stays until ``discard`` removes it: whatever is still to be read from it, also by the frame that an operator
    returns, needs it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing reads any more: what was made from them has been written itself."""
    for table in tables:
        context = table.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(table._scratch)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """``df``, marked to be broadcast if it has at most ``most_rows`` rows (of a few numbers each); else joins shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def member_bits(keys: DataFrame, key: Column, log2_bits: int = 23) -> np.ndarray:
    """A bit table of fixed size (2**log2_bits bits, 1 MB by default) with the hashed places of all keys set.

    ``key`` is a long whose low bits are evenly spread. At most 2**(log2_bits - 6) rows of two longs reach the driver,
    however many keys there are. A full table lets every key pass: it only saves work, an exact join must follow.
    """
    place = F.pmod(key, F.lit(1 << log2_bits))
    words = (
        keys.select(place.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b"))
        .toPandas()
    )
    table = np.zeros(1 << (log2_bits - 6), dtype=np.int64)
    table[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64)
    return table


def has_member(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each int64 key: may it be one of the keys of ``member_bits``?"""
    place = keys.astype(np.int64) & np.int64(len(table) * 64 - 1)
    return ((table[place >> 6] >> (place & 63)) & 1).astype(bool)
