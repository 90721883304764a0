import os
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from medialedger import tables
from medialedger.operators import ledger
from medialedger.streaming import event_store, playback
from medialedger.streaming.event_store import EventStore

T0 = datetime(2024, 1, 1, 12)
TOLD = "event_id bigint, occurred_at timestamp_ntz, source_id int, playback_user string, external_id string, event_type string, progress_percent int"
ROWS = (
    "seq bigint, source_id int, source_event_id string, media_external_id string, watched_at timestamp_ntz, completed boolean, progress_ms bigint, duration_ms bigint, "
    "view_number int, playback_user string, origin string"
)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def files(spark, folder, batches, schema):
    """One file for each batch, in order of their times."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for f in Path(folder).glob("part-*"):
            if f.stat().st_mtime > 1_000_000 + len(batches):
                os.utime(f, (1_000_000 + i, 1_000_000 + i))


def run(stream, tmp_path):
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(240) and query.exception() is None
    return query


def sessions_of(spark, tmp_path, batches):
    files(spark, f"{tmp_path}/in", batches, TOLD)
    stream = spark.readStream.schema(TOLD).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run(playback.stream_sessions(stream), tmp_path)
    return closed(spark.read.schema(playback.SESSIONS).parquet(f"{tmp_path}/out"))


def closed(df):
    return sorted(repr((r["source_id"], r["playback_user"], r["external_id"], r["started_at"], r["ended_at"], r["progress_percent"], r["completed"], r["closed_by"])) for r in df.collect())


def batch_sessions(spark, rows):
    """The batch form; a play that it leaves open went stale long before the last row of all, which a stream tells."""
    df = playback.sessions(spark.createDataFrame(rows, TOLD))
    stale = F.col("closed_by") == "open"
    return closed(df.withColumn("ended_at", F.when(stale, F.col("started_at") + playback.STALE_US).otherwise(F.col("ended_at"))).withColumn("closed_by", F.when(stale, "stale").otherwise(F.col("closed_by"))))


END = (10**6, at(60 * 48), 9, "end", "e", "media.pause", 0)  # closes nothing, moves the watermark over all others


def test_a_row_one_batch_late_counts_where_it_belongs(spark, tmp_path):
    play = lambda i, m, item, kind: (i, at(m), 1, "u", item, kind, 50)
    batches = [[play(1, 0, "a", "media.play"), play(3, 4, "a", "media.stop")], [play(2, 2, "b", "media.play")], [END], [(10**6 + 1, at(60 * 49), 9, "end", "e", "media.pause", 0)]]
    got = sessions_of(spark, tmp_path, batches)
    assert got == batch_sessions(spark, sum(batches, []))
    assert any("'a'" in r and "other" in r for r in got) and sum("media.stop" in r for r in got) == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_within_the_watermark_gives_the_same_plays(spark, tmp_path, seed):
    rng = random.Random(seed)
    kinds = ["media.play", "media.play", "media.resume", "media.pause", "media.stop", "media.scrobble", "other.kind"]
    rows = [(i, T0 + timedelta(seconds=rng.randint(0, 20_000)), 1 + i % 2, "u%d" % (i % 2), "e%d" % rng.randint(0, 3), rng.choice(kinds), rng.choice([None, 10, 95])) for i in range(240)]
    arrival = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randint(0, 590)))  # at most ten minutes late
    batches = [arrival[i : i + 40] for i in range(0, len(arrival), 40)] + [[END]]
    assert sessions_of(spark, tmp_path, batches) == batch_sessions(spark, [*rows, END])


def test_an_item_that_comes_later_releases_its_plays_once(spark, tmp_path):
    plays = [[(1, at(0), 1, "x"), (2, at(1), 1, "y")], [(3, at(2), 1, "x"), (4, at(2), 2, "x")], [(5, at(3), 1, "y")], [(6, at(4), 1, "x")], [(7, at(5), 1, "z")]]
    refs = [[(1, "y", 20)], [(3, "q", 9)], [(1, "x", 10)], [(1, "x", 10), (1, "x", 11)], [(2, "w", 1)]]
    files(spark, f"{tmp_path}/plays", plays, "event_id bigint, occurred_at timestamp_ntz, source_id int, external_id string")
    files(spark, f"{tmp_path}/refs", refs, "source_id int, external_id string, media_item_id bigint")
    read = lambda n, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}")
    stream = playback.late_dimension(read("plays", "event_id bigint, occurred_at timestamp_ntz, source_id int, external_id string"), read("refs", "source_id int, external_id string, media_item_id bigint"))
    run(stream, tmp_path)
    got = sorted((r["event_id"], r["external_id"], r["media_item_id"], r["occurred_at"]) for r in spark.read.schema(playback.MATCHED).parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "x", 10, at(0)), (2, "y", 20, at(1)), (3, "x", 10, at(2)), (5, "y", 20, at(3)), (6, "x", 10, at(4))]


# The stored plays.


REFS = [(1, "x", 10), (2, "y", 10), (1, "z", 20), (1, "v", 30)]


def batch(spark, rows):
    """(seq, source_id, source_event_id, media_external_id, minute) and perhaps view_number, progress_ms."""
    full = [(s, source, e, x, at(m), True, (more[1] if len(more) > 1 else None), None, (more[0] if more else None), "u", "webhook") for s, source, e, x, m, *more in rows]
    return spark.createDataFrame(full, ROWS)


def shown(df):
    return sorted(repr((r["media_item_id"], r["source_id"], r["source_event_id"], r["watched_at"])) for r in df.collect())


def refs_of(spark):
    return spark.createDataFrame(REFS, "source_id int, external_id string, media_item_id bigint")


DAY = 24 * 60
BATCHES = [
    [(1, 1, "a", "x", 0), (2, 1, "b", "z", 5, 7), (3, 1, "q", "?", 5)],
    [(4, 1, "c", "x", DAY), (5, 2, "d", "y", DAY + 1), (6, 1, None, "z", 2 * DAY, None, 4000), (7, 1, "b", "x", 9)],
    [(8, 1, "a", "x", 3 * DAY), (9, 1, None, "z", 2 * DAY), (10, 2, "e", "y", 1)],  # a moves to another day
]


@pytest.fixture(scope="module")
def all_at_once(spark):
    """What M14 makes of the first n batches without partitions, and what M15 makes of the states."""
    stored = spark.createDataFrame([], ", ".join(c for c in event_store._EVENTS.split(", ") if not c.startswith(("stored_", "bucket", "day"))))
    states = spark.createDataFrame([], "media_item_id bigint, source_id int, view_count bigint, last_watched_at timestamp_ntz, completed boolean, progress_ms bigint, observed_at timestamp_ntz")
    out = [([], [])]
    for rows in BATCHES:
        stored, states, _ = ledger.persist_with_states(stored, states, batch(spark, rows), refs_of(spark))
        stored, states = tables.written(stored), tables.written(states)
        out.append((shown(stored), sorted(map(repr, map(tuple, states.select(*ledger.STATE).collect())))))
    return out


def states_of(store):
    return sorted(map(repr, map(tuple, store.states().collect())))


def test_batches_equal_the_unpartitioned_form(spark, tmp_path, all_at_once):
    store = EventStore(spark, str(tmp_path), buckets=4)
    assert store.events().count() == store.states().count() == store.errors().count() == 0
    for n, rows in enumerate(BATCHES):
        assert store.merge(batch(spark, rows), refs_of(spark), "s", n)
        assert (shown(store.events()), states_of(store)) == all_at_once[n + 1]
    assert sorted((r["seq"], r["message"]) for r in store.errors().collect()) == [(3, "unknown media"), (7, "identity changed its media")]
    before = shown(store.events()), states_of(store)
    store.compact()
    store.compact()
    assert (shown(store.events()), states_of(store)) == before
    assert store.merge(batch(spark, [(1, 1, "c", "z", 0)]), refs_of(spark), "other", 0)  # the id is still known
    assert (shown(store.events()), states_of(store)) == before


def test_a_batch_touches_its_own_partitions_only(spark, tmp_path):
    written = lambda: {str(f): f.stat().st_mtime_ns for f in Path(f"{tmp_path}/watch_events").glob("*/*/part-*")}
    store = EventStore(spark, str(tmp_path), buckets=4)
    store.merge(batch(spark, BATCHES[0]), refs_of(spark), "s", 0)
    first = written()
    assert len(first) == 2
    store.merge(batch(spark, [(4, 1, "c", "v", DAY)]), refs_of(spark), "s", 1)
    assert first.items() <= written().items() and len(written()) == 3
    second = written()
    assert not store.merge(batch(spark, [(4, 1, "c", "v", DAY)]), refs_of(spark), "s", 1)  # a replay
    assert store.merge(batch(spark, [(4, 1, "c", "v", DAY), (5, 1, "p", "?", 0)]), refs_of(spark), "t", 0)  # the same play by another stream
    assert written() == second
    store.merge(batch(spark, [(1, 1, "a", "x", 5 * DAY)]), refs_of(spark), "s", 2)  # moves the only play of its partition
    assert len(written()) == 3 and not any("day=2024-01-01" in f and f in first and "bucket" in f for f in set(second) - set(written()) - set(first))
    assert shown(store.events()) == sorted(map(repr, [(10, 1, "a", at(5 * DAY)), (20, 1, "b", at(5)), (30, 1, "c", at(DAY))]))


@pytest.mark.parametrize(("step", "when"), [("watch_states", "after"), ("watch_events", "after"), ("_batches", "before")])
def test_a_batch_that_broke_off_is_made_whole(spark, tmp_path, monkeypatch, all_at_once, step, when):
    """Whatever was written when a batch broke off, before or after the named table, the next run gives the same."""
    store = EventStore(spark, f"{tmp_path}/{when}", buckets=4)
    store.merge(batch(spark, BATCHES[0]), refs_of(spark), "s", 0)
    with monkeypatch.context() as m:
        real_overwrite, real_append = event_store._overwrite, EventStore._append

        def overwrite(rows, path, by, real=real_overwrite, when=when):
            broke(path, lambda: real(rows, path, by), when)

        def append(self, rows, name, schema, real=real_append, when=when):
            broke(name, lambda: real(self, rows, name, schema), when)

        def broke(path, write, when):
            if path.endswith(step):
                if when == "after":
                    write()
                raise OSError("lost")
            write()

        m.setattr(event_store, "_overwrite", overwrite)
        m.setattr(EventStore, "_append", append)
        with pytest.raises(OSError, match="lost"):
            store.merge(batch(spark, BATCHES[1]), refs_of(spark), "s", 1)
    store.merge(batch(spark, BATCHES[1]), refs_of(spark), "s", 1)
    assert (shown(store.events()), states_of(store)) == all_at_once[2]
    assert sorted(r["seq"] for r in store.errors().collect()) == [3, 7]


def test_retention_rewrites_old_days_only(spark, tmp_path):
    rows = [(i, i % 2, datetime(2024, 1, 1 + i // 10)) for i in range(60)] + [(100, 7, datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "id bigint, source_id int, at timestamp_ntz").withColumn("day", F.to_date("at"))
    path = f"{tmp_path}/log"
    assert event_store.retain(spark, path, ["source_id"], [F.desc("id")], 12) == 0
    df.repartition("day").write.partitionBy("day").parquet(path)
    whole = {str(f): f.stat().st_mtime_ns for f in Path(path).glob("day=2024-01-0[56]/part-*")}
    assert event_store.retain(spark, path, ["source_id"], [F.desc("id")], 12) == 4
    kept = {r["id"] for r in spark.read.parquet(path).collect()}
    assert kept == {i for i in range(60) if i >= 36} | {100}
    assert whole == {str(f): f.stat().st_mtime_ns for f in Path(path).glob("day=2024-01-0[56]/part-*")}
    assert not list(Path(path).glob("day=2024-01-0[23]")) and event_store.retain(spark, path, ["source_id"], [F.desc("id")], 12) == 0
