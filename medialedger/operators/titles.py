"""F08 at scale: postings of title trigrams that find the few titles a pattern can match before it is tried on them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Postings are partitioned by a hash of their trigram, so that a search reads the partitions of its own trigrams only.
BUCKETS = 256


def _bucket(trigram: object) -> object:
    return F.pmod(F.crc32(F.encode(trigram, "UTF-8")), F.lit(BUCKETS)).cast("int")


def write_index(items: DataFrame, path: str) -> None:
    """(bucket, trigram, id): the distinct trigrams of each lower-case title, sorted by trigram within their partition, which lets
    the reader skip what a search doesn't ask for. Titles of less than three characters have none."""
    title = F.lower("title")
    places = F.when(F.length(title) >= 3, F.sequence(F.lit(1), F.length(title) - 2)).otherwise(F.array().cast("array<int>"))
    grams = F.array_distinct(F.transform(places, lambda i: F.substr(title, i, F.lit(3))))
    rows = items.select("id", F.explode(grams).alias("trigram")).withColumn("bucket", _bucket(F.col("trigram")))
    rows.repartition("bucket").sortWithinPartitions("bucket", "trigram", "id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def fragments(pattern: str) -> list[str]:
    """What a LIKE pattern demands literally, between its wildcards, in lower case; an escaped character stands for itself."""
    parts = re.split(r"(?<!\\)(?:\\\\)*[%_]", pattern.lower())
    return [re.sub(r"\\(.)", r"\1", p) for p in parts]


def titles_like(items: DataFrame, path: str, text: str) -> DataFrame:
    """the items whose title holds ``text`` without regard to case, % and _ in it being wildcards, through the index.

    Only items that hold every trigram of the pattern's literal parts are tried, and all of those are, so the result is that of a
    scan; a pattern without three literal characters in a row is a scan.
    """
    grams = sorted({f[i : i + 3] for f in fragments(text) for i in range(len(f) - 2)})
    wanted = F.col("title").ilike(f"%{text}%")
    if not grams:
        return items.where(wanted)
    spark: SparkSession = items.sparkSession
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, grams))).alias("trigram")).select(_bucket(F.col("trigram"))).distinct()
    buckets = [r[0] for r in asked.collect()]  # of the pattern's own trigrams
    postings = spark.read.schema("trigram string, id bigint, bucket int").parquet(path).where(F.col("bucket").isin(buckets) & F.col("trigram").isin(grams))
    found = postings.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")
    return items.join(found, "id", "left_semi").where(wanted)
