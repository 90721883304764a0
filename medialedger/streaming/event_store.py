"""Stored plays that a stream adds to, batch by batch, without rewriting what a batch doesn't touch.

Under one folder lie

* ``watch_events``, partitioned by a bucket of the item and the day of the play. A batch reads the partitions of its own plays, of
  the days that the gap reaches into, and those where its event ids are stored already; it overwrites the ones that changed.
* ``watch_event_ids``, a log of which partition each (source, event id) was put in. It is appended to before the events are, so an
  id is never missing from it; an entry too many only lets a partition be read. A batch reads it whole, three columns of it.
* ``watch_states``, a log of the states after each batch (M15); the newest row of an item and source counts.
* ``watch_event_errors``, partitioned by stream and batch.
* ``_batches``: the last batch of each stream that was stored whole.

A batch that runs again does nothing if it is among these. If it broke off before, it finds its own events in the table (each row
says which batch brought it), so that nothing is inserted or counted twice. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from medialedger import tables
from medialedger.operators import ledger

_EVENTS = (
    "media_item_id bigint, source_id int, source_event_id string, dedup_key string, watched_at timestamp_ntz, completed boolean, progress_ms bigint, duration_ms bigint, "
    "view_number int, playback_user string, origin string, stored_seq bigint, stored_batch string, bucket int, day date"
)
_IDS = "source_id int, source_event_id string, bucket int, day date, generation int"
_STATES = (
    "media_item_id bigint, source_id int, view_count bigint, last_watched_at timestamp_ntz, completed boolean, progress_ms bigint, observed_at timestamp_ntz, "
    "n_events bigint, stored_batch string, version bigint, generation int"
)
_ERRORS = "seq bigint, source_id int, source_event_id string, media_external_id string, message string, stream string, batch bigint"
_PLACE = ["bucket", "day"]
_KEY = ["media_item_id", "source_id"]


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing stored yet
        return spark.createDataFrame([], schema)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _overwrite(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that ``rows`` has rows of, and no others."""
    rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


class EventStore:
    """The tables under ``root``. ``buckets`` is fixed for their lifetime: it should make a day's bucket some tens of megabytes."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, gap_seconds: int = ledger.GAP_SECONDS):
        self.spark, self.root, self.buckets, self.gap = spark, root.rstrip("/"), buckets, gap_seconds

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _stored(self) -> DataFrame:
        return _table(self.spark, self._path("watch_events"), _EVENTS)

    def events(self) -> DataFrame:
        return self._stored().select(*ledger.EVENT)

    def _state_log(self, but: str | None = None) -> DataFrame:
        log = _table(self.spark, self._path("watch_states"), _STATES)
        return log if but is None else log.where(F.col("stored_batch") != but)

    def states(self) -> DataFrame:
        """The newest state of every item and source."""
        return self._newest(self._state_log()).select(*ledger.STATE)

    @staticmethod
    def _newest(log: DataFrame) -> DataFrame:
        best = log.groupBy(*_KEY).agg(F.max_by(F.struct(*log.columns), F.struct("version", "generation")).alias("s"))
        return best.select("s.*")

    def errors(self) -> DataFrame:
        return _table(self.spark, self._path("watch_event_errors"), _ERRORS)

    def _batches(self) -> DataFrame:
        return _table(self.spark, self._path("_batches"), "batch bigint, version bigint, stream string")

    def last_batch(self, stream: str) -> int:
        row = self._batches().where(F.col("stream") == stream).agg(F.max("batch")).first()
        return -1 if row[0] is None else row[0]

    def _generation(self, name: str, schema: str) -> int:
        row = _table(self.spark, self._path(name), schema).agg(F.max("generation")).first()
        return row[0] or 0

    def _append(self, rows: DataFrame, name: str, schema: str) -> None:
        rows.withColumn("generation", F.lit(self._generation(name, schema))).write.mode("append").partitionBy("generation").parquet(self._path(name))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("media_item_id"), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, refs: DataFrame, stream: str, number: int) -> bool:
        """Store batch ``number`` of a stream (rows as for M14, ``seq`` unique in it); false if it was stored before."""
        if number <= self.last_batch(stream):
            return False
        tag = f"{stream}:{number}"
        rows = tables.written(batch)
        touched = tables.written(self._touched(rows, refs))
        # At most as many numbers as there are buckets and days in a calendar.
        buckets, days = ([r[0] for r in touched.select(c).distinct().collect()] for c in _PLACE)
        stored = self._stored().where(F.col("bucket").isin(buckets) & F.col("day").isin(days)).join(touched, _PLACE, "left_semi")
        held = stored.select(*ledger.EVENT, "stored_seq", "stored_batch")
        done = ledger.merge_events(held, rows, refs, self.gap)
        inserted = done.inserted.select(*ledger.EVENT, F.col("seq").alias("stored_seq"), F.lit(tag).alias("stored_batch"))
        after = done.kept.unionByName(inserted).withColumns({"bucket": self._bucket(), "day": F.to_date("watched_at")})
        after, errors = tables.written(after), tables.written(done.errors)
        changed = tables.written(self._changed(stored, after))
        ids = after.join(changed, _PLACE, "left_semi").where("source_event_id IS NOT NULL").join(rows.select("source_id", "source_event_id").distinct(), ["source_id", "source_event_id"], "left_semi")
        self._append(ids.select("source_id", "source_event_id", *_PLACE), "watch_event_ids", _IDS)
        self._add_states(after, tag)
        _overwrite(after.join(changed, _PLACE, "left_semi"), self._path("watch_events"), _PLACE)
        for r in changed.where("NOT filled").collect():  # what lost its last row, at most one for each event that moved
            _remove(self.spark, f"{self._path('watch_events')}/bucket={r['bucket']}/day={r['day']}")
        _overwrite(errors.withColumns({"stream": F.lit(stream), "batch": F.lit(number).cast("bigint")}), self._path("watch_event_errors"), ["stream", "batch"])
        version = 1 + (self._batches().agg(F.max("version")).first()[0] or 0)
        mark = self.spark.range(1).select(F.lit(number).cast("bigint").alias("batch"), F.lit(version).cast("bigint").alias("version"), F.lit(stream).alias("stream"))
        _overwrite(mark, self._path("_batches"), ["stream"])
        for t in (rows, touched, after, errors, changed):
            tables.discard(t)
        return True

    def _touched(self, rows: DataFrame, refs: DataFrame) -> DataFrame:
        """(bucket, day) that a batch may change or has to look into."""
        known = refs.select("source_id", F.col("external_id").alias("media_external_id"), "media_item_id")
        gap = F.expr(f"INTERVAL {self.gap} SECONDS")
        days = F.array_distinct(F.array(*[F.to_date(at) for at in (F.col("watched_at") - gap, F.col("watched_at"), F.col("watched_at") + gap)]))
        own = rows.where("completed").join(known, ["source_id", "media_external_id"]).select(self._bucket().alias("bucket"), F.explode(days).alias("day"))
        ids = rows.where("completed AND source_event_id IS NOT NULL").select("source_id", "source_event_id").distinct()
        before = _table(self.spark, self._path("watch_event_ids"), _IDS).join(ids, ["source_id", "source_event_id"], "left_semi").select(*_PLACE)
        return own.unionByName(before).distinct()

    @staticmethod
    def _changed(stored: DataFrame, after: DataFrame) -> DataFrame:
        """(bucket, day, filled) of the partitions whose rows are others than before."""
        columns = [*ledger.EVENT, "stored_seq", "stored_batch"]
        count = lambda df, n: df.groupBy(*_PLACE).agg(F.struct(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).alias(n))
        both = count(stored, "a").join(count(after, "b"), _PLACE, "full")
        return both.where("NOT a <=> b").select(*_PLACE, F.col("b").isNotNull().alias("filled"))

    def _add_states(self, after: DataFrame, tag: str) -> None:
        inserted = after.where(F.col("stored_batch") == tag).withColumnRenamed("stored_seq", "seq")
        keys = inserted.select(*_KEY).distinct()
        old = self._newest(self._state_log(tag).join(keys, _KEY, "left_semi"))  # not what this batch wrote when it ran before
        counts = inserted.groupBy(*_KEY).agg(F.count("*").alias("_new")).join(old.select(*_KEY, "n_events"), _KEY, "left")
        counts = counts.select(*_KEY, (F.col("_new") + F.coalesce("n_events", F.lit(0))).alias("n"))
        new = ledger.apply_events(old.select(*ledger.STATE), inserted, counts).join(counts.withColumnRenamed("n", "n_events"), _KEY)
        version = 1 + (self._batches().agg(F.max("version")).first()[0] or 0)
        new = tables.written(new.withColumns({"stored_batch": F.lit(tag), "version": F.lit(version).cast("bigint")}))
        self._append(new, "watch_states", _STATES)
        tables.discard(new)

    def compact(self) -> None:
        """Rewrite both logs with one row of each key, in a generation of their own; the older ones go only then, and readers of both
        see the same states and ids as of either."""
        for name, schema in (("watch_states", _STATES), ("watch_event_ids", _IDS)):
            log = _table(self.spark, self._path(name), schema)
            old = [r[0] for r in log.select("generation").distinct().collect()]
            if not old:
                continue
            kept = self._newest(log) if name == "watch_states" else log.drop("generation").distinct()
            kept.withColumn("generation", F.lit(max(old) + 1)).write.mode("append").partitionBy("generation").parquet(self._path(name))
            for g in old:
                _remove(self.spark, f"{self._path(name)}/generation={g}")


def retain(spark: SparkSession, path: str, by: list[str], order: list[Column], n: int) -> int:
    """Keep the last ``n`` rows of each group in a table partitioned by ``day``; returns how many days were touched.

    ``order`` puts the newest first within a day, days go before it. From the counts of each group and day follow the days that stay
    whole, those that go, and the one of each group that is cut; only days that lose rows are rewritten, and removed if they lose all.
    """
    try:
        log = spark.read.parquet(path)
    except AnalysisException:
        return 0
    newer = W.partitionBy(*by).orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1)
    counts = log.groupBy(*by, "day").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_room", F.lit(n) - F.coalesce(F.sum("_n").over(newer), F.lit(0)))
    counts = tables.written(counts)
    losing = [r[0] for r in counts.where("_room < _n").select("day").distinct().collect()]  # days of the calendar
    if losing:
        room = counts.where(F.col("day").isin(losing)).select(*[F.col(c).alias(f"_{c}") for c in [*by, "day"]], "_room")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "day"]]
        rows = log.where(F.col("day").isin(losing)).join(room, same)
        ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(*by, "day").orderBy(*order)))
        kept = tables.written(ranked.where("_r <= _room").select(*log.columns))
        left = {r[0] for r in kept.select("day").distinct().collect()}
        _overwrite(kept, path, ["day"])
        for day in losing:
            if day not in left:
                _remove(spark, f"{path.rstrip('/')}/day={day}")
        tables.discard(kept)
    tables.discard(counts)
    return len(losing)
