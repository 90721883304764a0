"""Joins of rows with one row for each key, where a few keys may hold a large part of all rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys are looked up as hubs, so what is broadcast has a bound; each other key holds less than its part of all rows.
HUBS = 1000
#: A key of fewer rows is no hub.
HUB_ROWS = 100_000
#: The rows of a hub go to so many tasks.
SALTS = 64


def join_by_key(rows: DataFrame, per_key: DataFrame, key: list[str], spread: str, hub_rows: int = HUB_ROWS) -> DataFrame:
    """``rows`` joined with ``per_key``, which has one row for each ``key`` and the number of its rows as ``n``; ``n`` is kept.

    The rows of the ``HUBS`` largest keys, those above ``hub_rows``, are salted by ``spread``, a column of ``rows``, and the one
    row of such a key is sent to each salt. All others are joined by the key alone. Rows with a null in the key join nothing,
    and a key counts only where ``per_key`` has it, as in a plain inner join.
    """
    # The same filter everywhere, so that the rows by key are gathered once and read by all that follows.
    known = reduce(and_, (F.col(c).isNotNull() for c in key))
    rows, per_key = rows.where(known), per_key.where(known)
    largest = per_key.orderBy(F.desc("n"), *key).limit(HUBS).where(F.col("n") > hub_rows).select(*key, F.lit(True).alias("_hub"))
    salt = F.when(F.col("_hub"), F.pmod(F.xxhash64(F.lit("hub"), spread), F.lit(SALTS)).cast("int")).otherwise(0).alias("_salt")
    salted = rows.join(F.broadcast(largest), key, "left").select(*rows.columns, salt)
    copies = F.when(F.col("_hub"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    sent = per_key.join(F.broadcast(largest), key, "left").select(*per_key.columns, F.explode(copies).alias("_salt"))
    return salted.join(sent, [*key, "_salt"]).drop("_salt")
