"""Two-pass external shuffle of a corpus into shards, in DataFrame functions only.

Pass one scatters the rows uniformly, by seeded hashes of what they hold, into buckets of bounded size. Pass two sorts each
bucket, shuffles it by Fisher-Yates with swaps that the seed decides, and deals its rows out. The law is ``rows``: a row's
place in the whole shuffled order, modulo the number of shards, is its shard, so counts are at most one apart.

Nothing depends on how the table is split or in which order its rows come: a seed gives the same order on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from medialedger.llm.store import materialize

#: Buckets are dealt over this many blocks; what stands before a block is found from as many sums.
BLOCKS = 4096


def fisher_yates(n: Column, seed: Column) -> Column:
    """The numbers from 0 to n - 1 in the order that a Fisher-Yates shuffle gives them, swaps drawn by hashes of the seed."""

    def swap(a: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(seed, i), i + 1).cast("int")

        def swapped(both: Column) -> Column:
            at_i, at_j = F.get(both["a"], i), F.get(both["a"], both["j"])
            return F.transform(both["a"], lambda x, k: F.when(k == i, at_j).when(k == both["j"], at_i).otherwise(x))

        return F.element_at(F.transform(F.array(F.struct(a.alias("a"), j.alias("j"))), swapped), 1)

    places = F.when(n > 1, F.sequence(n.cast("int") - 1, F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.sequence(F.lit(0), n.cast("int") - 1), swap)


def _with_copies_told_apart(docs: DataFrame) -> DataFrame:
    """Every row as a struct ``_row`` with a hash ``_h`` of it and ``_copy``, which numbers rows that are equal in all columns.

    Only rows whose hash repeats are gathered, one of each with its count, and spread out again in two steps.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(*docs.columns).alias("_h"))
    again = rows.groupBy("_h").agg(F.count("*").alias("n")).where("n > 1").select("_h")
    single = rows.select("_row", "_h", F.lit(0).cast("bigint").alias("_copy"))
    if again.isEmpty():
        return single
    again = materialize(again, "repeated-rows")
    step = F.lit(1000).cast("bigint")
    counted = rows.join(again, "_h", "left_semi").groupBy("_h", "_row").agg(F.count("*").alias("n"))
    ranges = counted.select("_h", "_row", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, step)).alias("begin")).repartition("_h", "begin")
    spread = ranges.select("_row", "_h", F.explode(F.sequence("begin", F.least(F.col("begin") + step, F.col("n")) - 1)).alias("_copy"))
    return single.join(again, "_h", "left_anti").select("_row", "_h", "_copy").unionByName(spread)


def shuffled_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 42, bucket_bytes: int = 4 << 20, bucket_rows: int = 48) -> DataFrame:
    """Write ``docs`` in random order as ``shards`` Parquet folders under ``path`` (shard=0, ...) and return them as read back.

    Columns are those of ``docs`` (named apart from shard and slot by the caller; of types that can be compared), shard, and
    slot, a gapless order from 0 in each shard. Buckets hold about ``bucket_rows`` rows, fewer if ``bucket_bytes`` of text are
    less. Null and empty texts are rows as others, repeated rows are kept as often as they occur and are dealt over the buckets
    as others are, and an empty table writes an empty one.

    Rows are hashed twice, to count the buckets and to fill them; both times the hash is of the row itself, so the counts hold.
    Places before a bucket come in two levels: within one of ``BLOCKS`` blocks of buckets, and before the block.
    """
    spark = docs.sparkSession
    names = docs.columns
    total, n = docs.agg(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 64), F.count("*")).first()
    n_buckets = max(1, -(-(total or 0) // bucket_bytes), -(-n // bucket_rows))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "_h", "_copy"), F.lit(n_buckets)).alias("_bucket")
    rows = _with_copies_told_apart(docs).select(bucket, "_h", "_copy", "_row")
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("n")).withColumn("block", F.expr(f"_bucket * {BLOCKS} div {n_buckets}"))
    counts = materialize(counts, "bucket-counts")
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).select("block", earlier(W.orderBy("block")).alias("before"))  # BLOCKS rows at most
    inside = counts.select("_bucket", "block", earlier(W.partitionBy("block").orderBy("_bucket")).alias("inside"))
    begins = inside.join(F.broadcast(blocks), "block").select("_bucket", (F.col("before") + F.col("inside")).alias("_begin"))
    held = rows.groupBy("_bucket").agg(F.array_sort(F.collect_list(F.struct("_h", "_copy", "_row"))).alias("_rows"))
    order = fisher_yates(F.size("_rows"), F.xxhash64(F.lit(seed + 1), "_bucket"))
    dealt = held.join(begins, "_bucket").select("_begin", "_rows", F.posexplode(order).alias("_at", "_from"))
    place = F.col("_begin") + F.col("_at")
    row = F.get("_rows", "_from")["_row"]
    out = dealt.select(*[row[c].alias(c) for c in names], (place % shards).cast("int").alias("shard"), F.floor(place / shards).cast("bigint").alias("slot"))
    out.write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path).select(*names, "shard", "slot") if n else out.limit(0)
