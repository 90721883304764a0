"""What the review of round 3 found: ids that several items have, and steps whose work or memory outgrew their input."""

from datetime import datetime

from pyspark.sql import functions as F

from medialedger import functions as fn
from medialedger.operators import containers, creation, ledger, reports
from medialedger.sources import history_export
from medialedger.streaming import notifications, playback


def test_classify_gives_each_row_once_where_a_reference_is_stored_twice(spark):
    batch = spark.createDataFrame([(1, "p1", "a"), (1, "p1", "b"), (1, "p2", "a"), (1, "p3", "a")], "source_id int, external_id string, title string")
    stored = ledger.classify(batch.where("external_id <> 'p3'"), spark.createDataFrame([], "source_id int, external_id string, raw_hash string"), ["title"]).select("source_id", "external_id", "raw_hash")
    stored = stored.where("external_id = 'p1'").unionByName(spark.createDataFrame([(1, "p1", None), (1, "p2", "x"), (1, "p2", None)], stored.schema))
    rows = ledger.classify(batch, stored, ["title"]).select("external_id", "title", "classification")
    assert sorted(map(tuple, rows.collect())) == [("p1", "a", "unchanged"), ("p1", "b", "unchanged"), ("p2", "a", "updated"), ("p3", "a", "inserted")]


def test_hierarchy_is_looked_up_by_kind(spark):
    items = spark.createDataFrame(
        [(1, "show", None, None), (1, "movie", None, None), (2, "season", 1, 5), (2, "movie", None, None), (3, "episode", 2, 5)], "id long, kind string, parent_id long, season_number int"
    )
    refs = spark.createDataFrame([], "source_id int, external_id string, media_item_id long, library_id long, available boolean")
    matched = spark.createDataFrame(
        [(1, "e3", 7, 3, 5, "h", "S", None), (1, "e4", 7, 1, 5, "h", "S", None)],
        "source_id int, external_id string, library_id long, media_item_id long, season_number int, show_external_id string, show_title string, season_external_id string",
    )
    bound, _titles, errors = containers.bind_hierarchy(refs, matched, items, datetime(2024, 1, 1))
    assert sorted((r["external_id"], r["media_item_id"]) for r in bound.collect()) == [("h", 1), ("h:season:5", 2)]
    assert [(r["external_id"], r["message"]) for r in errors.collect()] == [("e4", "incompatible hierarchy")]


def test_detail_of_an_id_that_the_page_lists_twice(spark):
    items = spark.createDataFrame([(1, "movie", "m", None), (1, "show", "s", None), (2, "season", "t", 1)], "id long, kind string, title string, parent_id long").withColumns(
        {"season_number": F.lit(1), "episode_number": F.lit(1)}
    )
    none = spark.createDataFrame([], "media_item_id long, provider string, external_id string")
    refs = spark.createDataFrame([], "media_item_id long, source_id int, library_id long, external_id string, available boolean")
    rows = reports.media_detail(items.where("id = 1"), items, none, refs, none)
    assert sorted(r["title"] for r in rows.collect()) == ["m", "m", "s", "s"]
    assert sorted(r["title"] for r in reports.media_detail(items.where("kind = 'movie'"), items, none, refs, none).collect()) == ["m", "s"]


def test_a_notification_is_parsed_once(spark):
    raw = spark.createDataFrame([(1, '{"event": "media.stop", "Metadata": {"ratingKey": "7"}}', datetime(2024, 1, 1))], "source_id int, value string, arrived_at timestamp")
    for server in (notifications.first_server, notifications.second_server):
        plan = server(raw, [])._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1
    assert [r["external_id"] for r in notifications.first_server(raw, []).collect()] == ["7"]


def test_texts_are_stripped_of_white_space_of_any_script(spark):
    texts = ["a", " a", "a ", " é b\x1c", "é", "", " ", "\t　", None, "\U0001f600", "a\u0085"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(fn.strip(F.col("t")).alias("s"), fn.clean(F.col("t")).alias("c")).collect()
    assert [r["s"] for r in rows] == ["a", "a", "a", "é b", "é", "", "", "", None, "\U0001f600", "a"]
    assert [r["c"] for r in rows] == ["a", "a", "a", "é b", "é", None, None, None, None, "\U0001f600", "a"]


def test_play_with_a_shared_id_meets_no_item_of_it_by_itself(spark):
    """Each play shares one id with all items and one with its own; plays without an own one are ambiguous unless an item is preferred."""
    many = 3000
    ids = spark.range(many).select(F.col("id").alias("media_item_id"), F.lit("hub").alias("provider"), F.lit("h").alias("external_id"))
    ids = ids.unionByName(spark.range(many).select(F.col("id").alias("media_item_id"), F.lit("own").alias("provider"), F.col("id").cast("string").alias("external_id")))
    one = lambda p, c: F.struct(F.lit(p).alias("provider"), c.alias("external_id"))
    hub, own = one("hub", F.lit("h")), one("own", F.col("id").cast("string"))
    both = F.when(F.col("id") % 3 == 0, F.array(hub)).when(F.col("id") % 3 == 1, F.array(hub, own)).otherwise(F.array(own, one("none", F.lit("x"))))
    plays = spark.range(many).select(F.col("id").cast("string").alias("id"), both.alias("ids"), F.lit(None).cast("string").alias("reason"))
    none = spark.createDataFrame([], "media_item_id long")
    rows = {int(r["id"]): (r["media_item_id"], r["ambiguous"]) for r in history_export.match(plays, ids, none).collect()}
    assert rows == {i: (None, True) if i % 3 == 0 else (i, False) for i in range(many)}
    some = spark.createDataFrame([(17,)], "media_item_id long")
    rows = {int(r["id"]): (r["media_item_id"], r["ambiguous"]) for r in history_export.match(plays, ids, some).collect()}
    assert rows == {i: (17, False) if i % 3 == 0 else (i, False) for i in range(many)}


def test_matches_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(3)
    items = {i: {(p, str(rng.randrange(n))) for p, n in (("a", 3), ("b", 6), ("c", 9), ("d", 40)) if rng.random() < 0.7} for i in range(60)}
    plays = {str(k): sorted({(p, str(rng.randrange(n))) for p, n in (("a", 3), ("b", 6), ("c", 9), ("d", 40)) if rng.random() < 0.7}) for k in range(200)}
    liked = {i for i in items if i % 4 == 0}
    want = {}
    for k, ids in plays.items():
        scores = {i: len(own & set(ids)) for i, own in items.items() if own & set(ids)}
        if scores:
            best = [i for i, s in scores.items() if s == max(scores.values())]
            preferred = [i for i in best if i in liked]
            chosen = best[0] if len(best) == 1 else preferred[0] if len(preferred) == 1 else None
            want[k] = (chosen, chosen is None)
    held = spark.createDataFrame([(i, p, x) for i, own in items.items() for p, x in sorted(own)], "media_item_id long, provider string, external_id string")
    told = spark.createDataFrame([(k, ids, None) for k, ids in plays.items()], "id string, ids array<struct<provider: string, external_id: string>>, reason string")
    found = history_export.match(told, held, spark.createDataFrame([(i,) for i in sorted(liked)], "media_item_id long"))
    assert {r["id"]: (r["media_item_id"], r["ambiguous"]) for r in found.collect()} == want


def test_notifications_are_sorted_once_for_each_use(spark):
    rows = spark.createDataFrame([], "event_id long, occurred_at timestamp_ntz, source_id int, playback_user string, external_id string, event_type string, progress_percent int")
    plan = playback.sessions(rows)._jdf.queryExecution().sparkPlan().toString()
    orders = {line.split("windowspecdefinition(", 1)[1].split(", specifiedwindowframe", 1)[0].count("ASC") for line in plan.splitlines() if "Window [" in line and "event_id" in line}
    assert orders == {2} and "external_id" not in "".join(line.split("windowspecdefinition(", 1)[1].split("specifiedwindowframe", 1)[0] for line in plan.splitlines() if "Window [" in line)


def test_a_batch_of_events_is_joined_and_keyed_once(spark):
    event = "source_id int, source_event_id string, media_external_id string, watched_at timestamp, completed boolean, progress_ms long, duration_ms long, view_number int, playback_user string, origin string"
    at = lambda m: datetime(2024, 1, 1, 0, m)
    row = lambda seq, i, ext, t, done=True, source=1: (seq, source, i, ext, t, done, None, None, None, f"u{seq}", None)
    batch = [row(1, "a", "x", at(0)), row(2, "a", "y", at(1)), row(3, "a", "x", at(30)), row(4, None, "x", at(40)), row(5, None, "x", at(40)), row(6, "b", "y", at(9)), row(7, "b", "x", at(20)), row(8, "c", "z", at(5)), row(9, "d", "x", at(41)), row(10, "e", "x", at(50), False), row(11, "b", "y", at(7), source=2)]
    batch = spark.createDataFrame(batch, f"seq long, {event}")
    refs = spark.createDataFrame([(1, "x", 10), (1, "y", 20), (2, "y", 20)], "source_id int, external_id string, media_item_id long")
    stored = spark.createDataFrame([(10, 1, "b", "k", at(3), True, None, None, None, "old", None), (20, 1, None, "l", at(8), True, None, None, None, "old", None)], "media_item_id long, " + event.replace("media_external_id", "dedup_key"))
    events, errors = ledger.persist_events(stored, batch, refs)
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "sha2(" not in plan and "Generate explode(array(" not in plan
    got = {(r["source_id"], r["source_event_id"], r["media_item_id"], r["watched_at"], r["playback_user"]) for r in events.collect()}
    assert got == {(1, "a", 10, at(30), "u3"), (1, None, 10, at(40), "u4"), (1, "b", 10, at(20), "u7"), (1, None, 20, at(8), "old")}
    assert sorted((r["seq"], r["message"]) for r in errors.collect()) == [(2, "identity changed its media"), (6, "identity changed its media"), (8, "unknown media")]


def test_history_that_is_there_is_only_matched(spark, monkeypatch):
    """Plays that have ids need no title keys, and a second run passes over no graph."""
    ids = "array<struct<provider: string, external_id: string>>"
    plays = [(f"m{i}", "movie", f"M{i}", 2000, [("imdb", f"m{i // 2}")], None, None, None, None, None) for i in range(6)]
    plays += [(f"e{i}", "episode", f"E{i}", None, [("tvdb", f"e{i}")], "S", 1990, [("tvdb", "s")], 1, i) for i in range(4)]
    plays = spark.createDataFrame(plays, f"id string, kind string, title string, year int, ids {ids}, show_title string, show_year int, show_ids {ids}, season int, number int")
    items = spark.createDataFrame([(1, "show", None, "S", 1990, None, None)], "id long, kind string, parent_id long, title string, year int, season_number int, episode_number int")
    known = spark.createDataFrame([(1, "tvdb", "s")], "media_item_id long, provider string, external_id string")
    none, plans, write = spark.createDataFrame([], "media_item_id long"), [], creation.written

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    monkeypatch.setattr(creation, "written", seen)
    made = creation.create_history(plays, items, known, none)
    assert sorted((r["id"], r["kind"], r["title"]) for r in made.items.collect()) == sorted((r["id"], r["kind"], r["title"]) for r in made.items.dropDuplicates(["id"]).collect())
    assert sorted((r["kind"], r["title"]) for r in made.items.collect()) == [("episode", f"E{i}") for i in range(4)] + [("movie", f"M{i}") for i in (0, 2, 4)] + [("season", "Season 1")]
    monkeypatch.setattr(creation, "connected_components", None)
    again = creation.create_history(plays, items.unionByName(made.items), known.unionByName(made.identifiers), none)
    assert again.items.isEmpty() and again.identifiers.isEmpty() and again.ambiguous.isEmpty()
    assert sorted(map(tuple, again.plays.collect())) == sorted(map(tuple, made.plays.collect()))
    assert plans and not any("title_key" in p for p in plans)
