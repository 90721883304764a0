import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from medialedger import functions as fn
from medialedger import quality, tables
from medialedger.identity import merge
from medialedger.operators import ledger
from medialedger.streaming import playback
from medialedger.streaming.event_store import EventStore

T0 = datetime(2024, 1, 1)


def test_near_duplicate_fold_equals_a_scan(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 6), rng.randint(1, 2), T0 + timedelta(seconds=rng.randint(0, 3000)), rng.random() < 0.9) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, media_item_id bigint, source_id int, watched_at timestamp_ntz, completed boolean")
    got = {r["id"] for r in ledger.without_near_duplicates(df).collect()}
    want, last = set(), {}
    for r in sorted((r for r in rows if r[4]), key=lambda r: (r[1], r[3], r[2], r[0])):
        if r[1] not in last or (r[3] - last[r[1]]).total_seconds() > 120:
            last[r[1]] = r[3]
            want.add(r[0])
    assert got == want


def test_upsert_twice_changes_nothing(spark, tmp_path):
    a = spark.createDataFrame([(1, "p1", "x"), (1, "p2", "y")], "source_id int, external_id string, title string")
    b = spark.createDataFrame([(1, "p2", "z"), (2, "p1", "n")], a.schema)
    once = ledger.upsert(a, b, ["source_id", "external_id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, ledger.upsert(once, b, ["source_id", "external_id"]).collect())) == [(1, "p1", "x"), (1, "p2", "z"), (2, "p1", "n")]
    assert ledger.insert_missing(a, b, ["source_id", "external_id"]).count() == 1
    tables.publish(once, str(tmp_path), "refs")
    assert tables.current(spark, str(tmp_path), "refs").count() == 3


def test_merge_plan(spark):
    refs = spark.createDataFrame([(1, 2), (2, 1), (5, 1), (6, 1), (8, 1)], "media_item_id bigint, source_id int")
    sources = spark.createDataFrame([(1, "plex"), (2, "jellyfin")], "id int, connector_type string")
    members = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "media_item_id bigint, group_id bigint")
    assert [tuple(r) for r in merge.merge_plan(members, refs, sources).collect()] == [(1, 2)]


def test_persisted_events(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    tail = "watched_at timestamp_ntz, completed boolean, progress_ms bigint, duration_ms bigint, view_number int, playback_user string, origin string"
    stored = [(10, 1, "a", "k1", at(0)), (10, 2, None, "k2", at(60)), (20, 1, "b", "k3", at(0))]
    stored = spark.createDataFrame([(*r, True, None, None, None, "u", "s") for r in stored], f"media_item_id bigint, source_id int, source_event_id string, dedup_key string, {tail}")
    refs = spark.createDataFrame([(1, "x", 10), (2, "y", 10), (1, "z", 20)], "source_id int, external_id string, media_item_id bigint")
    batch = [(1, 1, "a", "x", at(5), True), (2, 1, "b", "x", at(9), True), (3, 2, "c", "y", at(7), True), (4, 2, "d", "y", at(8), True), (5, 1, "e", "q", at(1), True), (6, 1, "f", "x", at(20), False),
             (7, 1, None, "x", at(58), True), (8, 1, None, "z", at(30), True), (9, 1, None, "z", at(30), True), (10, 2, "h", "y", at(9), True)]
    batch = spark.createDataFrame([(*r, None, None, None, "u", "s") for r in batch], f"seq bigint, source_id int, source_event_id string, media_external_id string, {tail}")
    new, errors = ledger.persist_events(stored, batch, refs)
    want = {(10, 1, "a", at(5)), (10, 2, None, at(60)), (20, 1, "b", at(0)), (10, 2, "d", at(8)), (20, 1, None, at(30))}
    shown = lambda df: sorted(map(repr, ((r["media_item_id"], r["source_id"], r["source_event_id"], r["watched_at"]) for r in df.collect())))
    assert shown(new) == sorted(map(repr, want))
    assert sorted((r["seq"], r["message"]) for r in errors.collect()) == [(2, "identity changed its media"), (5, "unknown media")]
    assert shown(ledger.persist_events(tables.written(new), batch, refs)[0]) == sorted(map(repr, want))

    told = [(1, at(0), 1, "u", "x", "media.scrobble", None), (2, at(1), 2, "v", "y", "media.stop", 95), (1, at(0), 1, "u", "x", "media.scrobble", None), (3, at(9), 1, "u", "x", "media.scrobble", None), (4, at(9), 1, "u", "w", "media.scrobble", None)]
    told = spark.createDataFrame(told, "event_id bigint, occurred_at timestamp_ntz, source_id int, playback_user string, external_id string, event_type string, progress_percent int")
    told.coalesce(1).write.parquet(f"{tmp_path}/in")
    query = playback.persisted(spark.readStream.schema(told.schema).parquet(f"{tmp_path}/in"), refs, str(tmp_path)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    held = EventStore(spark, str(tmp_path))
    assert shown(held.events()) == sorted(map(repr, [(10, 1, "webhook:1", at(0)), (10, 1, "webhook:3", at(9))]))
    assert [r["seq"] for r in held.errors().collect()] == [4]
    assert [(r["media_item_id"], r["view_count"], r["last_watched_at"], r["completed"]) for r in held.states().collect()] == [(10, 2, at(9), True)]


def test_propagation(spark):
    items = spark.createDataFrame([(1, "episode"), (2, "episode"), (3, "track"), (4, "track"), (5, "movie"), (6, "movie"), (7, "movie"), (8, "show")], "id bigint, kind string")
    ids = spark.createDataFrame([(1, "tvdb", "x"), (2, "tvdb", "x"), (3, "musicbrainz", "m"), (4, "musicbrainz", "m"), (5, "tvdb", "x"), (9, "imdb", "z")], "media_item_id bigint, provider string, external_id string")
    refs = [(1, 1, "p1"), (2, 2, "j2"), (3, 1, "p3"), (4, 2, "j4"), (5, 1, "p5"), (5, 2, "j5"), (6, 1, "p6"), (6, 2, "j6"), (7, 1, "p7"), (7, 2, "j7"), (8, 1, "p8"), (8, 2, "j8")]
    refs = spark.createDataFrame([(*r, True) for r in refs], "media_item_id bigint, source_id int, external_id string, available boolean")
    events = [(1, 1, T0, True, "me"), (5, 1, T0, True, "other"), (6, 2, T0, True, "you"), (7, 1, T0, True, "me"), (8, 1, T0, True, "me")]
    events = spark.createDataFrame(events, "media_item_id bigint, source_id int, watched_at timestamp_ntz, completed boolean, playback_user string")
    later = T0 + timedelta(days=1)
    states = spark.createDataFrame([(7, 2, None, later, True), (3, 1, None, None, True), (6, 1, None, later, False)], "media_item_id bigint, source_id int, last_watched_at timestamp_ntz, observed_at timestamp_ntz, completed boolean")
    servers = lambda on: spark.createDataFrame([(1, True), (2, on)], "id int, enabled boolean")

    def run(users=None, on=True, start=None, states=states):
        rows = merge.propagation(items, ids, refs, events, states, servers(on), {1: "me", 2: "you"} if users is None else users, tables.written, start=start).collect()
        return sorted((r["media_item_id"], r["source_id"], r["external_id"], r["watched_at"]) for r in rows)

    assert run() == [(2, 2, "j2", T0), (6, 1, "p6", T0)]
    assert run(start=1) == [(2, 2, "j2", T0)] and run(start=2) == [(6, 1, "p6", T0)]
    assert run(on=False) == run(users={1: "me"}) == run(users={1: "me", 2: " "}) == []
    assert run(states=states.where("media_item_id <> 7").unionByName(spark.createDataFrame([(5, 2, None, later, True)], states.schema))) == [(2, 2, "j2", T0), (5, 1, "p5", later), (6, 1, "p6", T0), (7, 2, "j7", T0)]


def test_now_playing(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [
        (1, at(0), 1, "a", "x", "media.play", 1), (2, at(5), 1, "a", "x", "media.resume", 10), (3, at(9), 1, "a", "y", "media.play", 0),
        (4, at(20), 1, "a", "y", "media.stop", 95), (5, at(30), 1, "a", "z", "media.play", 1), (6, at(100), 1, "a", "w", "media.play", 1),
        (7, at(3), 2, "b", "q", "media.scrobble", None), (8, at(4), 2, "b", "q", "media.pause", 3), (9, at(4), 2, "b", "q", "library.new", 3),
    ]
    df = spark.createDataFrame(rows, "event_id bigint, occurred_at timestamp_ntz, source_id int, playback_user string, external_id string, event_type string, progress_percent int")
    got = sorted((r["playback_user"], r["external_id"], r["closed_by"], r["completed"]) for r in playback.sessions(df).collect())
    assert got == [("a", "w", "open", False), ("a", "x", "other", False), ("a", "y", "media.stop", True), ("a", "z", "stale", False), ("b", "q", "media.scrobble", True)]


def test_functions(spark):
    df = spark.createDataFrame([("  Über  Straße ", "TMDB://12", "a &amp; b")], "t string, p string, h string")
    r = df.select(fn.title_key("t").alias("k"), fn.provider_id(F.col("p")).alias("p"), fn.unescape_html("h").alias("h"), fn.duration_text(F.lit(6960000)).alias("d"),
                  fn.redact(F.lit("token=abc Bearer xyz")).alias("r"), fn.sorted_tags(F.array(F.lit("b"), F.lit(" A "), F.lit("b"))).alias("s")).first()
    assert (r["k"], tuple(r["p"]), r["h"], r["d"], r["r"], r["s"]) == ("uber strasse", ("tmdb", "12"), "a & b", "1h 56min", "token=*** Bearer ***", ["A", "b"])


def test_quality(spark):
    df = spark.createDataFrame([("e1", "T", "episode", 5, 0, None, 1, 1, None, None), ("", "T", "movie", -1, 0, None, None, None, None, None), ("m", "T", "movie", None, 0, None, None, None, None, None)],
                               "external_id string, title string, kind string, duration_ms bigint, view_count int, show_external_id string, season_number int, episode_number int, artist_external_id string, album_external_id string")
    got = {r["external_id"]: r["reasons"] for r in quality.outside(df, quality.item_checks()).collect()}
    assert got == {"e1": ["episode"], "": ["external_id", "duration"]}


@pytest.mark.parametrize("name", ["f06_catalog", "w03_now_playing"])
def test_registered_queries_run(spark, name):
    from medialedger.plans import registry

    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_fold_of_a_busy_item_over_slices(spark):
    rng = random.Random(4)
    rows = [(i, 1, rng.randint(1, 2), T0 + timedelta(seconds=rng.choice([1, 40, 90]) * rng.randint(0, 2500)), True) for i in range(6000)]
    rows += [(10000 + i, 2, 1, T0 + timedelta(seconds=100 * i), True) for i in range(3000)]  # one chain over many slices
    df = spark.createDataFrame(rows, "id bigint, media_item_id bigint, source_id int, watched_at timestamp_ntz, completed boolean")
    want, last = set(), {}
    for r in sorted(rows, key=lambda r: (r[1], r[3], r[2], r[0])):
        if r[1] not in last or (r[3] - last[r[1]]).total_seconds() > 120:
            last[r[1]] = r[3]
            want.add(r[0])
    for width in (86_400, 40_000):
        assert {r["id"] for r in ledger.without_near_duplicates(df, slice_seconds=width).collect()} == want
    assert ledger.without_near_duplicates(df.limit(0)).count() == 0


def test_incremental_window(spark):
    marks = spark.createDataFrame([(1, None, None), (2, T0 - timedelta(hours=5), T0 - timedelta(days=2)), (3, T0 - timedelta(hours=5), T0 - timedelta(days=7))], "library_id int, watermark_at timestamp_ntz, last_full_scan_at timestamp_ntz")
    got = {r["library_id"]: (r["full_scan"], r["updated_since"], r["next_watermark"]) for r in ledger.incremental_window(marks, T0).collect()}
    mark = T0 - timedelta(seconds=120)
    assert got == {1: (True, None, mark), 2: (False, T0 - timedelta(hours=5), mark), 3: (True, None, mark)}


def test_outbox_in_batch_and_stream(spark, tmp_path):
    refs = spark.createDataFrame([(10, 1, "x", True), (10, 2, "y", True), (20, 1, "z", True), (20, 2, "w", False), (30, 1, "q", True), (30, 2, "r", True)], "media_item_id bigint, source_id int, external_id string, available boolean")
    sources = spark.createDataFrame([(1, True), (2, True)], "id int, enabled boolean")
    states = spark.createDataFrame([(30, 2, True), (10, 2, False)], "media_item_id bigint, source_id int, completed boolean")
    told = [(1, T0, 1, "u", "x", "media.scrobble", None), (2, T0, 1, "u", "x", "media.scrobble", None), (3, T0, 1, "u", "z", "media.scrobble", None), (4, T0, 1, "u", "q", "media.scrobble", None), (5, T0, 1, "u", "x", "media.play", None)]
    told = spark.createDataFrame(told, "event_id bigint, occurred_at timestamp_ntz, source_id int, playback_user string, external_id string, event_type string, progress_percent int")
    for k in (1, 2):  # the second run replays everything
        told.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(told.schema).parquet(f"{tmp_path}/in")
        query = playback.write_outbox(stream, refs, sources, states, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        got = spark.read.parquet(f"{tmp_path}/out").collect()
        assert [(r["external_id"], r["target_source"], r["target_external"]) for r in got] == [("x", 2, "y")], k


def test_stable_ids_once_in_a_stream(spark, tmp_path):
    rows = [(1, T0, 1), (1, T0, 1), (1, T0, 2), (2, T0 + timedelta(minutes=1), 1)]
    df = spark.createDataFrame(rows, "event_id bigint, occurred_at timestamp_ntz, source_id int")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = playback.deduplicated(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).select("source_id", "event_id")
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [(1, 1), (1, 2), (2, 1)]


def test_a_missing_folder_is_no_silent_fallback(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))

    class Frame:
        sparkSession = Cluster

    with pytest.raises(ValueError, match="checkpoint.dir"):
        tables.written(Frame)


def test_report_file(spark, tmp_path):
    from medialedger.operators import reports

    reports.write_report(spark.createDataFrame([(1, "x")], "events_read long, mode string"), f"{tmp_path}/report")
    assert [tuple(r) for r in spark.read.json(f"{tmp_path}/report").select("events_read", "mode").collect()] == [(1, "x")]
