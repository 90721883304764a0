"""Playback notifications: completion, deduplication and the now-playing state of each user, in batch and as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from medialedger.identity import matching
from medialedger.streaming.event_store import EventStore

ACTIVE = ("media.play", "media.resume")
KINDS = (*ACTIVE, "media.pause", "media.stop", "media.scrobble")
STALE_US = 3_600_000_000
SESSIONS = "source_id int, playback_user string, external_id string, started_at bigint, ended_at bigint, progress_percent int, completed boolean, closed_by string"


def completed(rows: DataFrame, percent: int = 90) -> DataFrame:
    """Allowed notifications with an identity, and whether each completes a play."""
    known = rows.where(F.col("event_type").isin(*KINDS) & F.col("external_id").isNotNull())
    done = (F.col("event_type") == "media.scrobble") | ((F.col("event_type") == "media.stop") & (F.coalesce("progress_percent", F.lit(0)) >= percent))
    return known.withColumn("completed", done)


class NowPlaying:
    """What one user of one server plays. Events come in order of time; each closed play is one session.

    A play or resume of the same item only updates its progress (the start stays); of another item it closes the one
    before. Pause, stop and scrobble close the item they name. A play that started over an hour ago is stale.
    """

    def __init__(self, item: str | None = None, started: int = 0, progress: int | None = None):
        self.item, self.started, self.progress = item, started, progress

    def close(self, at: int, completed: bool, why: str) -> Iterator[tuple]:
        if self.item is not None:
            yield self.item, self.started, at, self.progress, completed, why
        self.item = None

    def step(self, at: int, item: str, kind: str, progress: int | None, completed: bool) -> Iterator[tuple]:
        if self.item is not None and at - self.started > STALE_US:
            yield from self.close(self.started + STALE_US, False, "stale")
        if kind in ACTIVE:
            if self.item == item:
                self.progress = progress
            else:
                yield from self.close(at, False, "other")
                self.item, self.started, self.progress = item, at, progress
        elif self.item == item:
            self.progress = progress
            yield from self.close(at, completed, kind)
        elif kind in ("media.stop", "media.scrobble"):
            yield item, at, at, progress, completed, kind


def _rows(key: tuple, sessions: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(sessions, columns=["external_id", "started_at", "ended_at", "progress_percent", "completed", "closed_by"])
    frame.insert(0, "playback_user", key[1])
    frame.insert(0, "source_id", key[0])
    frame["progress_percent"] = frame["progress_percent"].astype("Int64")
    return frame


def sessions(rows: DataFrame) -> DataFrame:
    """W03 in batch: the closed plays of a table of notifications, and those still open (``closed_by`` open, ended_at null).

    The same as ``NowPlaying`` step by step, in windows: a run is a stretch of plays and resumes of one item that nothing else ends;
    plays over an hour after the start of theirs begin anew within it, and what ends a run closes the last of them. All windows over
    notifications go by one order of a user's, so these are sorted once, with spilling, and without the columns that no step reads;
    only the times of one run are held together.
    """
    user = ["source_id", "playback_user"]
    at = F.unix_micros(F.col("occurred_at").cast("timestamp"))
    timed = completed(rows).select(*user, "external_id", "event_id", "progress_percent", "completed", "event_type", at.alias("t"))
    order = W.partitionBy(*user).orderBy("t", "event_id")
    numbered = timed.withColumn("n", F.row_number().over(order)).withColumn("plays", F.col("event_type").isin(*ACTIVE))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    seen = numbered.withColumn("last_play", F.last(F.when(F.col("plays"), F.struct("n", "external_id")), ignorenulls=True).over(before))
    # What ends the item of the last play: its latest one tells whether that play is still on.
    same = F.coalesce(F.col("last_play.external_id") == F.col("external_id"), F.lit(False))
    last_end = F.last(F.when(~F.col("plays") & same, F.col("n")), ignorenulls=True).over(before)
    seen = seen.withColumn("holds", same & (F.coalesce(last_end, F.lit(0)) < F.col("last_play.n"))).drop("last_play")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = seen.withColumn("run", F.sum((F.col("plays") & ~F.col("holds")).cast("int")).over(so_far)).drop("event_id")
    end = F.struct("t", "progress_percent", "completed", "event_type")
    runs = seen.groupBy(*user, "run").agg(
        F.array_sort(F.collect_list(F.when(F.col("plays"), F.struct("n", "t", F.col("progress_percent").alias("p"))))).alias("plays"),
        F.max(F.when(F.col("plays"), F.col("external_id"))).alias("external_id"), F.max(F.when(~F.col("plays") & F.col("holds"), end)).alias("end"), F.max("t").alias("until"),
    )
    by_run = W.partitionBy(*user).orderBy("run")
    runs = runs.withColumn("next", F.lead(F.get("plays", 0)["t"]).over(by_run)).withColumn("until", F.max("until").over(W.partitionBy(*user))).where("run > 0")
    one = "STRUCT<s: BIGINT, p: INT>"
    first = F.struct(F.lit(None).cast(one).alias("now"), F.array().cast(f"ARRAY<{one}>").alias("stale"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.struct(x["t"].alias("s"), x["p"].alias("p"))
        more = F.struct(F.struct(acc["now"]["s"].alias("s"), x["p"].alias("p")).alias("now"), acc["stale"].alias("stale"))
        over = F.struct(fresh.alias("now"), F.concat(acc["stale"], F.array(acc["now"])).alias("stale"))
        return F.when(acc["now"].isNull(), F.struct(fresh.alias("now"), acc["stale"].alias("stale"))).when(x["t"] - acc["now"]["s"] > STALE_US, over).otherwise(more)

    runs = runs.withColumn("f", F.aggregate("plays", first, step))
    start, ended = F.col("f.now.s"), F.coalesce("end.t", "next", "until")
    is_stale = ended - start > STALE_US
    shown = lambda s, e, p, done, why: F.struct(s.alias("started_at"), e.cast("bigint").alias("ended_at"), p.cast("int").alias("progress_percent"), done.alias("completed"), why.alias("closed_by"))
    no = F.lit(False)
    stale = lambda x: shown(x["s"], x["s"] + STALE_US, x["p"], no, F.lit("stale"))
    closing = (
        F.when(is_stale, stale(F.col("f.now"))).when(F.col("end").isNotNull(), shown(start, ended, F.col("end.progress_percent"), F.col("end.completed"), F.col("end.event_type")))
        .when(F.col("next").isNotNull(), shown(start, ended, F.col("f.now.p"), no, F.lit("other"))).otherwise(shown(start, F.lit(None), F.col("f.now.p"), no, F.lit("open")))
    )
    # A stop or scrobble that ends nothing, or comes after its play went stale, is a play of no length.
    point = lambda e: shown(e["t"], e["t"], e["progress_percent"], e["completed"], e["event_type"])
    late = F.when(is_stale & F.col("end.event_type").isin("media.stop", "media.scrobble"), point(F.col("end")))
    closed = runs.select(*user, "external_id", F.explode(F.array_compact(F.concat(F.transform("f.stale", stale), F.array(closing, late)))).alias("x"))
    alone = seen.where(F.col("event_type").isin("media.stop", "media.scrobble") & ~F.col("holds")).select(*user, "external_id", point(end).alias("x"))
    return closed.unionByName(alone).select(*user, "external_id", "x.*")


def stream_sessions(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """W03, W04 as a stream: the closed plays of ``sessions``, whatever the order in which rows arrive within the watermark.

    Rows wait in the state of their (source, user) until the watermark has passed them and are then played in order of time and
    event id, so none that comes later can stand before them; rows older than the watermark are dropped by Spark. A timer wakes a
    user without new rows when the watermark reaches the next waiting row or the end of a stale play. A state holds the rows of one
    user within the watermark's delay, as JSON text.
    """

    def update(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        item, started, progress, held = state.get if state.exists else (None, 0, None, "[]")
        now, waiting = NowPlaying(item, started, progress), json.loads(held)
        if not state.hasTimedOut:
            for frame in frames:
                for r in zip(frame["t"], frame["event_id"], frame["external_id"], frame["event_type"], frame["progress_percent"], frame["completed"], strict=True):
                    waiting.append([int(r[0]), int(r[1]), r[2], r[3], None if pd.isna(r[4]) else int(r[4]), bool(r[5])])
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda r: (r[0], r[1]))
        out: list[tuple] = []
        for t, _, external_id, kind, percent, done in (r for r in waiting if r[0] <= passed):
            out += now.step(t, external_id, kind, percent, done)
        waiting = [r for r in waiting if r[0] > passed]
        if now.item is not None and now.started + STALE_US <= passed:  # rows to come are later still
            out += now.close(now.started + STALE_US, False, "stale")
        if now.item is None and not waiting:
            if state.exists:
                state.remove()
        else:
            state.update((now.item, now.started, now.progress, json.dumps(waiting)))
            due = [r[0] for r in waiting[:1]] + ([now.started + STALE_US] if now.item is not None else [])
            state.setTimeoutTimestamp(-(-min(due) // 1000))
        if out:
            yield _rows(key, out)

    timed = completed(stream).withColumn("at", F.col("occurred_at").cast("timestamp")).withColumn("t", F.unix_micros("at")).withWatermark("at", late)
    return timed.groupBy("source_id", "playback_user").applyInPandasWithState(
        update, SESSIONS, "item string, started bigint, progress int, waiting string", "append", GroupStateTimeout.EventTimeTimeout
    )


MATCHED = "source_id int, external_id string, media_item_id bigint, event_id bigint, occurred_at timestamp_ntz"


def late_dimension(completions: DataFrame, refs: DataFrame) -> DataFrame:
    """W07 as a stream: each completion with the item of its reference, at once if it is known and otherwise when it comes.

    Both are streams: ``completions`` (source_id, external_id, event_id, occurred_at; each event once, see ``deduplicated``) and
    ``refs``, the references as they are added (source_id, external_id, media_item_id). The state of a (source, external id) holds
    its item, the first that is told, and until then the completions that wait for it, as JSON text; they are released once.
    """

    def update(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        item, held = state.get if state.exists else (None, "[]")
        waiting = json.loads(held)
        for frame in frames:
            for media, event, micros in zip(frame["media_item_id"], frame["event_id"], frame["t"], strict=True):
                if pd.isna(event):
                    item = int(media) if item is None else item
                else:
                    waiting.append([int(event), int(micros)])
        if item is None:
            state.update((None, json.dumps(waiting)))
        else:
            state.update((item, "[]"))
            if waiting:
                waiting.sort()
                at = pd.to_datetime([t for _, t in waiting], unit="us")
                yield pd.DataFrame({"source_id": key[0], "external_id": key[1], "media_item_id": item, "event_id": [e for e, _ in waiting], "occurred_at": at})

    none = F.lit(None).cast("bigint")
    asked = completions.select("source_id", "external_id", none.alias("media_item_id"), "event_id", F.unix_micros(F.col("occurred_at").cast("timestamp")).alias("t"))
    known = refs.select("source_id", "external_id", F.col("media_item_id").cast("bigint"), none.alias("event_id"), none.alias("t"))
    both = asked.unionByName(known).where("source_id IS NOT NULL AND external_id IS NOT NULL")
    return both.groupBy("source_id", "external_id").applyInPandasWithState(update, MATCHED, "item bigint, waiting string", "append", GroupStateTimeout.NoTimeout)


def deduplicated(stream: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Each (source, event) once while its watermark lasts."""
    return stream.withColumn("at", F.col("occurred_at").cast("timestamp")).withWatermark("at", within).dropDuplicatesWithinWatermark(["source_id", "event_id"])


def persisted(stream: DataFrame, refs: DataFrame, root: str, within: str = "10 minutes", name: str = "notifications", buckets: int = 64) -> DataStreamWriter:
    """Completed notifications into the ``EventStore`` under ``root``: each stable id once, then M14 with its dedup key and two
    minutes per item across sources, and M15. A batch only touches the partitions that it changes; one that runs again changes
    nothing, errors included. ``name`` tells the batches of streams into one store apart."""

    def store(batch: DataFrame, number: int) -> None:
        none = F.lit(None)
        rows = batch.select(
            F.col("event_id").alias("seq"), "source_id", F.col("external_id").alias("media_external_id"), F.concat(F.lit("webhook:"), F.col("event_id").cast("string")).alias("source_event_id"),
            F.col("occurred_at").alias("watched_at"), "completed", *[none.cast("bigint").alias(c) for c in ("progress_ms", "duration_ms")], none.cast("int").alias("view_number"), "playback_user", F.lit("webhook").alias("origin"),
        )
        EventStore(batch.sparkSession, root, buckets).merge(rows, refs, name, number)

    return deduplicated(completed(stream).where("completed"), within).writeStream.foreachBatch(store)


def outbox(candidates: DataFrame, refs: DataFrame, sources: DataFrame, states: DataFrame, sent: DataFrame) -> DataFrame:
    """Completed plays (source_id, external_id, watched_at) to send to the other server, once for each (source, item, time)
    whatever is replayed.

    The target is the one available reference of the play's item in another enabled source (J19); plays without an available
    reference or a single target, and those whose target is completed already, give no row.
    """
    at = F.date_format(F.col("watched_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    key = F.sha2(F.concat_ws(":", F.lit("watch"), F.col("source_id").cast("string"), "external_id", at), 256)
    known = refs.where("available").select("source_id", "external_id", "media_item_id").dropDuplicates(["source_id", "external_id"])
    new = candidates.select("source_id", "external_id", "watched_at", key.alias("dedup_key")).dropDuplicates(["dedup_key"]).join(sent.select("dedup_key"), "dedup_key", "left_anti")
    aimed = new.join(known, ["source_id", "external_id"])
    aimed = aimed.join(matching.target_of(aimed, refs, sources), ["media_item_id", "source_id"])
    done = states.where("completed").select("media_item_id", F.col("source_id").alias("target_source"))
    return aimed.join(done, ["media_item_id", "target_source"], "left_anti")


def write_outbox(stream: DataFrame, refs: DataFrame, sources: DataFrame, states: DataFrame, path: str) -> DataStreamWriter:
    """W08 as a stream: each batch appends what was not sent before; a batch that runs again appends nothing.

    What was sent lies by the day of its play, which is part of its key, so a batch reads the days of its own plays only.
    """

    def send(batch: DataFrame, _: int) -> None:
        rows = batch.where("completed").select("source_id", "external_id", F.col("occurred_at").alias("watched_at"))
        days = [r[0] for r in rows.select(F.to_date("watched_at")).distinct().collect()]
        try:
            sent = batch.sparkSession.read.schema("dedup_key string, day date").parquet(path).where(F.col("day").isin(days))
        except AnalysisException:  # nothing sent yet
            sent = batch.sparkSession.createDataFrame([], "dedup_key string, day date")
        outbox(rows, refs, sources, states, sent).withColumn("day", F.to_date("watched_at")).write.mode("append").partitionBy("day").parquet(path)

    return completed(stream).writeStream.foreachBatch(send)
