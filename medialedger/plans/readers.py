"""Queries of the readers and of operators that join several steps, over payloads and tables made from the given ones."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialedger import functions as fn
from medialedger import quality, tables
from medialedger.adapters import Tables
from medialedger.identity import cascade
from medialedger.operators import catalog, containers, creation, ingest, ledger, reports, titles
from medialedger.plans.details import ntz, second_payload, text_id
from medialedger.plans.registry import NOW, register
from medialedger.sources import history_export, payloads
from medialedger.streaming import event_store, notifications


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows over as many tasks as a shuffle has, whatever the size of their files."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def first_payload(t: Tables, rows: DataFrame, **fields: Column) -> DataFrame:
    """One JSON container with one item for each row; nulls are left out of it.

    Rows are dealt over tasks first: a payload is much more work than its row, and a small file is read by few tasks.
    """
    rows = spread(rows, "id")
    item = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    text = F.concat(F.lit('{"MediaContainer": {"Metadata": ['), item, F.lit("]}}"))
    return payloads.container_items(rows.select("id", F.lit("l1").alias("library_external_id"), text.alias("value")))


def scratch(t: Tables, name: str) -> str:
    """A folder of its own beside the intermediate tables, which all executors share."""
    held = tables.written(t.spark.range(1))
    path = held._scratch.rsplit("/", 1)[0]
    tables.discard(held)
    return f"{path}/{name}-{uuid.uuid4().hex}"


# The first server.


@register("s02_s11_p15_p18_first_server_items", """SELECT CAST(id AS VARCHAR) AS external_id, kind, CASE WHEN id % 13 <> 0 THEN title END AS title, CASE WHEN id % 7 = 0 AND year IS NOT NULL THEN -4 ELSE year END AS year, CAST(id % 4 AS INTEGER) AS season_number,
CAST(0 AS INTEGER) AS episode_number, CASE WHEN id % 5 <> 0 THEN DATE '2001-02-03' END AS originally_available_on, id * 10 AS duration_ms, CASE WHEN id % 13 = 0 THEN 'no title' WHEN id % 7 = 0 AND year IS NOT NULL THEN 'bad number' WHEN id % 5 = 0 THEN 'bad date' END AS reason FROM media_items""")
def _(t: Tables) -> DataFrame:
    year = F.when((F.col("id") % 7 == 0) & F.col("year").isNotNull(), F.lit("-4")).otherwise(F.col("year").cast("string"))
    rows = first_payload(
        t, t.items, ratingKey=F.col("id").cast("string"), type=F.col("kind"), title=F.when(F.col("id") % 13 != 0, F.concat(F.lit(" "), "title", F.lit("\t"))), year=year, parentIndex=(F.col("id") % 4).cast("string"), index=F.lit("-3"),
        duration=(F.col("id") * 10).cast("string"), originallyAvailableAt=F.when(F.col("id") % 5 == 0, "soon").otherwise("2001-02-03"),
    )
    columns = ("external_id", "kind", "title", "year", "season_number", "episode_number", "originally_available_on", "duration_ms", "reason")
    return payloads.first_server_items(rows).select(*columns)


@register("s03_s12_p13_first_server_history", """SELECT CASE WHEN id % 6 <> 0 THEN CAST(id AS VARCHAR) END AS media_external_id, concat('/h/', CAST(id AS VARCHAR)) AS source_event_id, CASE WHEN id % 11 <> 0 THEN TIMESTAMP '2023-11-14 22:13:20' + to_seconds(id % 1000) END AS watched_at,
id % 3 = 0 OR id % 100 >= 90 AS completed, CASE WHEN id % 6 = 0 THEN 'orphan' WHEN id % 11 = 0 THEN 'no time' END AS reason FROM media_items""")
def _(t: Tables) -> DataFrame:
    rows = first_payload(
        t, t.items, ratingKey=F.when(F.col("id") % 6 != 0, F.col("id").cast("string")), historyKey=text_id("/h/"), viewedAt=F.when(F.col("id") % 11 != 0, (F.lit(1_700_000_000) + F.col("id") % 1000).cast("string")),
        viewCount=F.when(F.col("id") % 3 == 0, "2"), viewOffset=(F.col("id") % 100).cast("string"), duration=F.lit("100"),
    )
    return payloads.first_server_history(rows).select("media_external_id", "source_event_id", F.col("watched_at").cast("timestamp_ntz"), "completed", "reason")


@register("s12_observed_orphans", "SELECT count(*) AS total, count(*) FILTER (WHERE id % 6 = 0) AS orphans FROM media_items")
def _(t: Tables) -> DataFrame:
    rows = first_payload(t, t.items, ratingKey=F.when(F.col("id") % 6 != 0, F.col("id").cast("string")), viewedAt=F.lit("1700000000"))
    history, seen = reports.observed(payloads.first_server_history(rows), {"total": F.count(F.lit(1)), "orphans": F.count_if(F.col("reason").eqNullSafe("orphan"))})
    tables.discard(tables.written(history))
    return reports.observed_row(t.spark, seen)


@register("s04_first_server_libraries", """SELECT CAST(id AS VARCHAR) AS external_id, name, CASE WHEN id % 5 = 0 THEN 'photo' WHEN media_type = 'music' THEN 'artist' ELSE media_type END AS media_type,
CASE WHEN id % 5 = 0 THEN 'unsupported library type' END AS reason FROM libraries""")
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("id") % 5 == 0, "photo").when(F.col("media_type") == "music", "artist").otherwise(F.col("media_type"))
    rows = first_payload(t, t.libraries, key=F.col("id").cast("string"), title=F.col("name"), type=kind)
    return payloads.first_server_libraries(rows).select("external_id", "name", "media_type", "reason")


@register("s05_first_server_users", "SELECT CAST(id AS VARCHAR) AS id, title AS name FROM media_items WHERE kind = 'episode' AND id % 3 <> 0")
def _(t: Tables) -> DataFrame:
    key = F.when(F.col("id") % 3 == 0, text_id("x")).otherwise(F.col("id").cast("string"))
    text = F.concat(F.lit('<MediaContainer><Account id="'), key, F.lit('" name="'), F.when(F.col("id") % 2 == 0, F.col("title")).otherwise(F.lit("")), F.lit('" title="'), "title", F.lit('"/></MediaContainer>'))
    rows = payloads.container_items(t.items.where("kind = 'episode'").select(F.col("id").alias("row"), F.lit("l1").alias("library_external_id"), text.alias("value")))
    return payloads.first_server_users(rows)


@register("s14_kinds_of_libraries", "SELECT CAST(id AS VARCHAR) AS external_id, CASE WHEN kind <> 'movie' THEN 'kind not of the library' END AS reason FROM media_items")
def _(t: Tables) -> DataFrame:
    items = payloads.first_server_items(first_payload(t, t.items, ratingKey=F.col("id").cast("string"), type=F.col("kind"), title=F.lit("t")))
    libraries = t.libraries.where("id = 0").select(F.lit("l1").alias("external_id"), F.lit("movie").alias("media_type"))
    return payloads.allowed_pairs(items, libraries).select("external_id", "reason")


# The second server.


@register("p05_p14_second_server_ids", """SELECT concat('i', CAST(id AS VARCHAR)) AS external_id, concat('mbid:m', CAST(id AS VARCHAR), ',tmdb:', CAST(id AS VARCHAR)) AS ids,
CASE WHEN id % 3 = 0 THEN TIMESTAMP '2024-01-02 01:04:05' WHEN id % 3 = 1 THEN TIMESTAMP '2024-01-02 03:04:05' END AS added_at FROM media_items""")
def _(t: Tables) -> DataFrame:
    ids = F.create_map(F.lit("Tmdb"), F.concat(F.lit(" "), F.col("id").cast("string")), F.lit("MusicBrainzTrack"), text_id("m"), F.lit("Zap2It"), F.lit("z"), F.lit("Imdb"), F.lit(" "))
    at = F.when(F.col("id") % 3 == 0, "2024-01-02T03:04:05+02:00").when(F.col("id") % 3 == 1, "2024-01-02T03:04:05").otherwise("then")
    items = payloads.second_server_items(second_payload(t, Id=text_id("i"), Name=F.col("title"), Type=F.lit("Movie"), ProviderIds=ids, DateCreated=at))
    return items.select("external_id", F.array_join(F.transform("identifiers", lambda i: F.concat_ws(":", i["provider"], i["external_id"])), ",").alias("ids"), F.col("added_at").cast("timestamp_ntz"))


@register("s09_series_ids", """SELECT concat('i', CAST(e.id AS VARCHAR)) AS external_id, CASE WHEN h.id % 2 = 0 THEN concat('tvdb:', CAST(h.id AS VARCHAR)) END AS show_ids
FROM media_items e JOIN media_items s ON s.id = e.parent_id JOIN media_items h ON h.id = s.parent_id WHERE e.kind = 'episode'""")
def _(t: Tables) -> DataFrame:
    up = t.items.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("show_id"))
    episodes = t.items.where("kind = 'episode'").join(up, "parent_id")
    text = F.to_json(F.struct(F.array(F.struct(text_id("i").alias("Id"), F.col("title").alias("Name"), F.lit("Episode").alias("Type"), text_id("i", "show_id").alias("SeriesId"))).alias("Items")))
    items = payloads.second_server_items(payloads.second_server_rows(episodes.select(F.lit("l1").alias("library_external_id"), text.alias("value"))))
    shows = t.items.where("kind = 'show' AND id % 2 = 0")
    told = F.to_json(F.struct(F.array(F.struct(text_id("i").alias("Id"), F.col("title").alias("Name"), F.create_map(F.lit("Tvdb"), F.col("id").cast("string")).alias("ProviderIds"))).alias("Items")))
    series = payloads.second_server_items(payloads.second_server_rows(shows.select(F.lit("l1").alias("library_external_id"), told.alias("value"))))
    out = payloads.with_series_ids(items, series)
    return out.select("external_id", F.array_join(F.transform("show_identifiers", lambda i: F.concat_ws(":", i["provider"], i["external_id"])), ",").alias("show_ids"))


# Notifications.


def told(t: Tables, value: Column) -> DataFrame:
    return spread(t.playback, "event_id").select("source_id", value.alias("value"), F.col("occurred_at").cast("timestamp").alias("arrived_at"))


@register("s18_f15_f16_p23_second_notifications", """SELECT CAST(event_id AS VARCHAR) AS event_key, external_id, event_type IN ('media.play', 'media.resume') AS active, progress_percent,
event_type IN ('media.pause', 'media.stop', 'media.scrobble') AND event_id % 2 = 0 AND playback_user IN ('7', '9') AS completed, CASE WHEN event_id % 7 = 0 THEN TIMESTAMP '2024-01-01 08:00:00' ELSE occurred_at END AS occurred_at
FROM playback_stream WHERE event_type IS NOT NULL AND event_id % 5 <> 0 AND event_id % 7 <> 1""")
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type").isin("media.play", "media.resume"), "Playback_Start").when(F.col("event_type").isNotNull(), "PlaybackStop").otherwise("ItemAdded")
    at = F.when(F.col("event_id") % 7 == 0, "2024-01-01T10:00:00+02:00").when(F.col("event_id") % 7 == 1, "2024-01-01T10:00:00")  # without an offset: not read, the row goes
    body = F.to_json(F.struct(
        kind.alias("NotificationType"), F.col("event_id").cast("string").alias("NotificationId"), F.col("external_id").alias("ItemId"), F.when(F.col("event_id") % 5 == 0, "TvChannel").otherwise("Movie").alias("ItemType"),
        F.when(F.col("event_id") % 2 == 0, " Yes").otherwise("no").alias("PlayedToCompletion"), F.col("playback_user").alias("UserId"), at.alias("UtcTimestamp"), F.lit("100").alias("RunTimeTicks"), F.col("progress_percent").cast("string").alias("PlaybackPositionTicks"),
    ))
    wrapped = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(body.alias("payload")))).otherwise(body)
    rows = notifications.second_server(told(t, wrapped), [" 7", "9"])
    return rows.select("event_key", "external_id", "active", "progress_percent", "completed", F.col("occurred_at").cast("timestamp_ntz"))


@register("u05_j18_w10_confirmed_stops", """SELECT source_id, CAST(event_id AS VARCHAR) AS event_key, event_type = 'media.scrobble' OR event_type = 'media.stop' AND (progress_percent >= 90 OR event_id % 2 = 0) AS completed,
occurred_at + CASE WHEN event_type = 'media.stop' AND progress_percent < 90 AND event_id % 2 = 0 THEN INTERVAL 9 MINUTE ELSE INTERVAL 0 MINUTE END AS occurred_at FROM playback_stream WHERE event_type IS NOT NULL
UNION ALL SELECT source_id, CAST(-event_id AS VARCHAR), false, occurred_at FROM playback_stream""")
def _(t: Tables) -> DataFrame:
    one = text_id("e", "event_id")  # an item of its own for each notification
    meta = F.struct(one.alias("ratingKey"), F.lit("100").alias("duration"), F.col("progress_percent").cast("string").alias("viewOffset"))
    first = notifications.first_server(told(t, F.to_json(F.struct(F.col("event_type").alias("event"), F.col("event_id").cast("string").alias("event_id"), meta.alias("Metadata")))), [])
    body = F.to_json(F.struct(F.lit("PlaybackProgress").alias("NotificationType"), (-F.col("event_id")).cast("string").alias("NotificationId"), one.alias("ItemId")))
    rows = notifications.both(first, notifications.second_server(told(t, body), []))
    near = F.col("occurred_at").cast("timestamp") + F.when(F.col("event_id") % 2 == 0, F.expr("INTERVAL 9 MINUTES")).otherwise(F.expr("INTERVAL 11 MINUTES"))
    stored = t.playback.select("source_id", one.alias("external_id"), near.alias("last_viewed_at"), F.lit(1).alias("view_count"))
    return notifications.confirmed_stops(rows, stored).select("source_id", "event_key", "completed", F.col("occurred_at").cast("timestamp_ntz"))


# Exports and counters.


@register("s16_p06_export_plays", """SELECT concat('p', CAST(id AS VARCHAR)) AS id, CASE WHEN kind = 'movie' THEN 'movie' ELSE 'episode' END AS kind, title, CASE WHEN id % 3 = 0 THEN concat('imdb:tt', CAST(id AS VARCHAR), ',plex:g', CAST(id AS VARCHAR)) ELSE concat('plex:g', CAST(id AS VARCHAR)) END AS ids,
CASE WHEN id % 7 = 0 THEN 'no time' END AS reason FROM media_items""")
def _(t: Tables) -> DataFrame:
    what = F.struct("title", F.struct(F.when(F.col("id") % 3 == 0, text_id(" tt")).alias("imdb"), F.struct(text_id("plex://g").alias("guid")).alias("plex")).alias("ids"))
    movie = F.col("kind") == "movie"
    play = F.to_json(F.struct(text_id("p").alias("id"), F.when(F.col("id") % 7 == 0, "never").otherwise("2024-01-02T03:04:05.000Z").alias("watched_at"), F.when(movie, "movie").otherwise("episode").alias("type"), F.when(movie, what).alias("movie"), F.when(~movie, what).alias("episode")))
    rows = history_export.plays(t.items.select(F.from_json(play, history_export.SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*"))
    return rows.select("id", "kind", "title", F.array_join(F.transform("ids", lambda i: F.concat_ws(":", i["provider"], i["external_id"])), ",").alias("ids"), "reason")


@register("p10_import_keys", """SELECT CAST(id AS VARCHAR) AS id, sha256(concat('trakt|', CAST(id AS VARCHAR), '|', CAST(min(media_item_id) AS VARCHAR), '|', strftime(min(watched_at), '%Y-%m-%dT%H:%M:%S.%fZ'))) AS dedup_key FROM watch_events WHERE id > 0 GROUP BY id""")
def _(t: Tables) -> DataFrame:
    plays = t.events.where("id > 0").select(F.col("id").cast("string").alias("id"), "media_item_id", F.col("watched_at").cast("timestamp").alias("watched_at"))
    new = ingest.import_plays(t.events.select(F.lit("none").alias("source_event_id")).distinct(), plays)
    return new.select(F.substring_index("source_event_id", ":", -1).alias("id"), "dedup_key")


@register("a15_observed_run", """SELECT count(*) AS total, count(*) FILTER (WHERE id % 11 = 0) AS inserted, count(*) FILTER (WHERE id % 11 <> 0 AND id % 7 = 0) AS updated, count(*) FILTER (WHERE id % 11 <> 0 AND id % 7 <> 0) AS unchanged FROM media_items""")
def _(t: Tables) -> DataFrame:
    batch = t.items.select(F.lit(1).alias("source_id"), text_id("p").alias("external_id"), "id", "kind", "title")
    signed = lambda title: fn.signature({"kind": F.col("kind"), "title": title})
    old = batch.where("id % 11 <> 0").select("source_id", "external_id", signed(F.when(F.col("id") % 7 == 0, F.concat("title", F.lit("*"))).otherwise(F.col("title"))).alias("raw_hash"))
    rows, seen = reports.observed(ledger.classify(batch, old, ["kind", "title"]), reports.outcome_counts("classification", ["inserted", "updated", "unchanged"]))
    tables.discard(tables.written(rows))  # the write that a run does anyway
    return reports.observed_row(t.spark, seen)


@register("a17_propagation_counters", """SELECT count(*) AS total, count(*) FILTER (WHERE o = 'updated') AS updated, count(*) FILTER (WHERE o = 'skipped') AS skipped, count(*) FILTER (WHERE o = 'failed') AS failed
FROM (SELECT CASE WHEN NOT available THEN 'failed' WHEN library_id % 3 = 0 THEN 'skipped' ELSE 'updated' END AS o FROM source_media_refs)""")
def _(t: Tables) -> DataFrame:
    outcome = F.when(~F.col("available"), "failed").when(F.col("library_id") % 3 == 0, "skipped").otherwise("updated")
    rows, seen = reports.observed(t.refs.withColumn("outcome", outcome), reports.outcome_counts("outcome", ["updated", "skipped", "failed"]))
    tables.discard(tables.written(rows))
    return reports.observed_row(t.spark, seen)


@register("w09_retained_log", "SELECT event_id, source_id FROM playback_stream QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY occurred_at DESC, event_id DESC) <= 100")
def _(t: Tables) -> DataFrame:
    path = scratch(t, "log")
    t.playback.withColumn("day", F.to_date("occurred_at")).repartition("day").write.partitionBy("day").parquet(path)
    event_store.retain(t.spark, path, ["source_id"], [F.desc("occurred_at"), F.desc("event_id")], 100)
    return t.spark.read.parquet(path).select("event_id", "source_id")


@register("f08_titles_by_trigrams", """SELECT 'a%st' AS asked, id, title FROM media_items WHERE title ILIKE '%a%st%' UNION ALL SELECT 'customer', id, title FROM media_items WHERE title ILIKE '%customer%'
UNION ALL SELECT 'r_ck', id, title FROM media_items WHERE title ILIKE '%r_ck%' UNION ALL SELECT 'gree', id, title FROM media_items WHERE title ILIKE '%gree%'""")
def _(t: Tables) -> DataFrame:
    path = scratch(t, "titles")
    titles.write_index(t.items, path)
    parts = [titles.titles_like(t.items, path, q).select(F.lit(q).alias("asked"), "id", "title") for q in ("a%st", "customer", "r_ck", "gree")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Keys without accents and odd white space.


ACCENTS = "concat(substring(title, 1, 2), 'é', substring(title, 3))"
PLAIN = "concat(substring(title, 1, 2), 'e', substring(title, 3))"


def accented(c: str = "title", letter: str = "é") -> Column:
    return F.concat(F.substring(c, 1, 2), F.lit(letter), F.expr(f"substring({c}, 3)"))


@register("p01_p02_p03_white_space", f"""SELECT id, nullif(CASE WHEN id % 3 = 0 THEN '' ELSE title END, '') AS cleaned, CASE WHEN id % 3 = 0 THEN '' ELSE lower(title) END AS folded, lower({PLAIN}) AS title_key FROM media_items""")
def _(t: Tables) -> DataFrame:
    odd = F.when(F.col("id") % 3 == 0, F.lit("\t \n")).otherwise(F.concat(F.lit("\t "), F.regexp_replace("title", " ", " \n"), F.lit("　\x1c")))
    cleaned = F.regexp_replace(fn.clean(odd), " \n", " ")
    return t.items.select("id", cleaned.alias("cleaned"), fn.fold(odd).alias("folded"), fn.title_key(F.concat(F.lit(" "), accented(letter="é"), F.lit("\n"))).alias("title_key"))


@register("m05_titles_without_accents", """, w AS (SELECT * FROM media_items WHERE kind = 'show') SELECT concat('x', CAST(q.id AS VARCHAR)) AS external_id, CASE WHEN count(i.id) = 1 THEN 'matched' ELSE 'ambiguous' END AS match_status, CASE WHEN count(i.id) = 1 THEN min(i.id) END AS media_item_id
FROM w q JOIN w i ON lower(i.title) = lower(q.title) GROUP BY q.id""")
def _(t: Tables) -> DataFrame:
    shows = t.items.where("kind = 'show'")
    staged = shows.select(F.lit(1).alias("source_id"), text_id("x").alias("external_id"), "kind", accented(letter="E").alias("title"), "parent_id", "season_number")
    stored = t.items.withColumn("title", F.when(F.col("kind") == "show", accented()).otherwise(F.col("title")))
    none = t.staged.select("source_id", "external_id", F.lit("p").alias("provider"), "identifier").limit(0)
    return containers.match_containers(staged, none, stored, t.identifiers.limit(0)).select("external_id", "match_status", "media_item_id")


@register("n06_cards_without_accents", """, m AS (SELECT * FROM media_items WHERE kind = 'movie')
SELECT max(id) AS largest, max(id) AS first FROM m GROUP BY lower(title), year""")
def _(t: Tables) -> DataFrame:
    movies = t.items.where("kind = 'movie'").select("id", "kind", "title", "year")
    twice = movies.withColumn("title", accented()).unionByName(movies.select((-F.col("id")).alias("id"), "kind", F.concat(F.lit("\t"), accented(letter="E")).alias("title"), "year"))
    rows = twice.withColumns({"on_plex": F.col("id") > 0, "on_jellyfin": F.col("id") < 0})
    merged = catalog.deduplicated(rows, t.identifiers.limit(0), [F.col("id").desc()]).where("on_plex AND on_jellyfin")
    return merged.select((-F.col("id")).alias("largest"), F.abs(F.col("placed_by")).alias("first"))


@register("p29_redacted_headers", "SELECT id, concat('Authorization: *** ', CAST(id AS VARCHAR), ' secret=***;') AS line FROM media_items")
def _(t: Tables) -> DataFrame:
    scheme = F.when(F.col("id") % 3 == 0, "Basic ").when(F.col("id") % 3 == 1, "Bearer ").otherwise("")
    line = F.concat(F.lit("Authorization: "), scheme, F.sha2(F.col("title"), 256), F.lit(" "), F.col("id").cast("string"), F.lit(" secret=abc;"))
    return t.items.select("id", fn.redact(line).alias("line"))


# Classification, states and retirement.


@register("m01_matched_items", """SELECT external_id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 'unchanged' ELSE 'updated' END WHEN id % 3 = 1 THEN 'updated' ELSE 'inserted' END AS classification, CASE WHEN id % 3 < 2 THEN id END AS media_item_id
FROM (SELECT concat('p', CAST(id AS VARCHAR)) AS external_id, id FROM media_items WHERE kind = 'movie')""")
def _(t: Tables) -> DataFrame:
    batch = t.items.where("kind = 'movie'").select(F.lit(1).alias("source_id"), text_id("p").alias("external_id"), "id", "title")
    refs = batch.where("id % 3 = 0").select("source_id", "external_id", F.col("id").alias("item"), fn.signature({"title": F.when(F.col("id") % 2 == 0, F.col("title"))}).alias("raw_hash"))
    resolved = batch.where("id % 3 <> 0").select("source_id", "external_id", F.when(F.col("id") % 3 == 1, "matched").otherwise("new").alias("match_status"), F.when(F.col("id") % 3 == 1, F.col("id")).alias("media_item_id"))
    rows = ledger.classify(batch, refs, ["title"], resolved).join(resolved.select("external_id", "media_item_id"), "external_id", "left").join(refs.select("external_id", "item"), "external_id", "left")
    return rows.select("external_id", "classification", F.coalesce("item", "media_item_id").alias("media_item_id"))


@register("m15_states_after_events", """, e AS (SELECT *, row_number() OVER (PARTITION BY media_item_id, source_id ORDER BY id DESC) AS back FROM watch_events WHERE completed AND id % 3 = 1),
g AS (SELECT media_item_id, source_id, count(*) AS n, max(watched_at) AS t, max(CAST(id % 7 AS INTEGER)) AS v, max(watched_at) FILTER (WHERE back = 1) AS last, max(id % 1000) FILTER (WHERE back = 1) AS p FROM e GROUP BY ALL),
c AS (SELECT media_item_id, source_id, count(*) AS n FROM watch_events WHERE completed GROUP BY ALL)
SELECT coalesce(s.media_item_id, g.media_item_id) AS media_item_id, coalesce(s.source_id, g.source_id) AS source_id, CAST(CASE WHEN g.n IS NULL THEN s.view_count ELSE greatest(s.view_count, g.v, c.n, 0) END AS BIGINT) AS view_count,
greatest(s.last_watched_at, g.t) AS last_watched_at, coalesce(s.completed, false) OR g.n IS NOT NULL AS completed, CASE WHEN g.n IS NULL THEN s.progress_ms ELSE g.p END AS progress_ms, CASE WHEN g.n IS NULL THEN s.observed_at ELSE g.last END AS observed_at
FROM watch_states s FULL JOIN g ON g.media_item_id = s.media_item_id AND g.source_id = s.source_id LEFT JOIN c ON c.media_item_id = g.media_item_id AND c.source_id = g.source_id""")
def _(t: Tables) -> DataFrame:
    done = t.events.where("completed")
    inserted = done.where("id % 3 = 1").select(F.col("id").alias("seq"), "media_item_id", "source_id", "watched_at", (F.col("id") % 1000).alias("progress_ms"), (F.col("id") % 7).cast("int").alias("view_number"))
    counts = done.groupBy("media_item_id", "source_id").agg(F.count("*").alias("n"))
    return ledger.apply_events(t.states, inserted, counts)


@register("m21_replaced_server", """SELECT 'library' AS part, concat(CAST(id AS VARCHAR), ' ', CASE WHEN source_id = 1 THEN concat('retired:library:', CAST(id AS VARCHAR), ':', substring(sha256(external_id), 1, 16), ' false false') ELSE concat(external_id, ' ', CAST(enabled AS VARCHAR), ' ', CAST(available AS VARCHAR)) END) AS text FROM libraries
UNION ALL SELECT 'mark', CAST(id AS VARCHAR) FROM libraries WHERE source_id <> 1 UNION ALL SELECT 'state', CAST(count(*) AS VARCHAR) FROM watch_states WHERE source_id <> 1 UNION ALL SELECT 'source', concat(CAST(id AS VARCHAR), CASE id WHEN 1 THEN ' new' ELSE ' old' END) FROM src
UNION ALL SELECT 'ref', CASE WHEN source_id = 1 THEN concat('retired:media:', CAST(media_item_id AS VARCHAR), ':', substring(sha256(external_id), 1, 16)) ELSE external_id END FROM source_media_refs""")
def _(t: Tables) -> DataFrame:
    held = {"refs": t.refs, "libraries": t.libraries, "marks": t.libraries.select(F.col("id").alias("library_id")), "states": t.states}
    _, new = ingest.apply_server_identity(t.sources.withColumn("server_identifier", F.lit("old")), 1, " new ", NOW, held, row="media_item_id")
    text = lambda *cs: F.concat_ws(" ", *[F.col(c).cast("string") for c in cs])
    parts = {
        "library": new["libraries"].select(text("id", "external_id", "enabled", "available").alias("text")), "mark": new["marks"].select(text("library_id").alias("text")), "ref": new["refs"].select(text("external_id").alias("text")),
        "state": new["states"].agg(F.count("*").cast("string").alias("text")), "source": new["sources"].select(text("id", "server_identifier").alias("text")),
    }
    rows = [df.select(F.lit(part).alias("part"), "text") for part, df in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# What is created and merged over several levels.


@register("m24_m25_m26_merged_shows", """, e AS (SELECT e.id, s.id AS season, h.id AS show FROM media_items e JOIN media_items s ON s.id = e.parent_id JOIN media_items h ON h.id = s.parent_id WHERE e.kind = 'episode')
SELECT id + 10000000 AS id, id AS winner_id, CAST(NULL AS BIGINT) AS parent_id FROM media_items WHERE kind = 'show' UNION ALL SELECT id + 10000000, CASE WHEN season_number % 2 = 0 THEN id END, CASE WHEN season_number % 2 <> 0 THEN parent_id END FROM media_items WHERE kind = 'season'
UNION ALL SELECT e.id + 10000000, CASE WHEN s.season_number % 2 = 0 AND e.id % 3 = 0 THEN e.id END, CASE WHEN s.season_number % 2 = 0 AND e.id % 3 <> 0 THEN e.season END FROM e JOIN media_items s ON s.id = e.season WHERE s.season_number % 2 = 0""")
def _(t: Tables) -> DataFrame:
    """Every show twice, of two servers: seasons of odd numbers only below the copy, a third of the episodes with the same id."""
    below = t.items.where("kind IN ('show', 'season', 'episode')")
    odd = below.where("kind = 'season' AND season_number % 2 <> 0").select("id")
    first = below.join(odd, "id", "left_anti").join(odd.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select(*t.items.columns)
    copy = below.withColumns({"id": F.col("id") + 10_000_000, "parent_id": F.col("parent_id") + 10_000_000})
    items = first.unionByName(copy.select(*t.items.columns))
    base = F.col("id") % 10_000_000
    own = F.when((F.col("kind") == "show") | (base % 3 == 0), base).otherwise(F.col("id"))
    ids = items.where("kind <> 'season'").select(F.col("id").alias("media_item_id"), F.lit("tvdb").alias("provider"), F.concat("kind", own.cast("string")).alias("external_id"))
    refs = items.select(F.col("id").alias("media_item_id"), F.when(F.col("id") > 10_000_000, 2).otherwise(1).alias("source_id"))
    remap, moved = cascade.cascade(items, ids, refs, t.sources, tables.written, tables.discard)
    return remap.select(F.col("media_item_id").alias("id"), "winner_id", F.lit(None).cast("bigint").alias("parent_id")).unionByName(
        moved.where("id > 10000000 AND parent_id < 10000000").select("id", F.lit(None).cast("bigint").alias("winner_id"), "parent_id")
    )


@register("m32_created_items", """, e AS (SELECT e.id, e.title, s.season_number + 1 AS n, h.id AS top, h.title AS top_title FROM media_items e JOIN media_items s ON s.id = e.parent_id JOIN media_items h ON h.id = s.parent_id WHERE e.kind = 'episode'),
held AS (SELECT parent_id AS top, season_number AS n FROM media_items WHERE kind = 'season' AND parent_id % 2 = 0)
SELECT 'show' AS kind, min(top_title) AS title, CAST(NULL AS VARCHAR) AS above, CAST(NULL AS INTEGER) AS season FROM e WHERE top % 2 = 1 GROUP BY top
UNION ALL SELECT 'season', concat('Season ', CAST(n AS VARCHAR)), min(top_title), CAST(n AS INTEGER) FROM e ANTI JOIN held USING (top, n) GROUP BY top, n
UNION ALL SELECT 'episode', e.title, coalesce(s.title, concat('Season ', CAST(n AS VARCHAR))), CAST(n AS INTEGER) FROM e LEFT JOIN media_items s ON s.kind = 'season' AND s.parent_id = e.top AND s.season_number = e.n AND e.top % 2 = 0
UNION ALL SELECT 'movie', title, NULL, NULL FROM media_items WHERE kind = 'movie' AND id % 5 = 0""")
def _(t: Tables) -> DataFrame:
    """Plays of every episode one season on, and of a fifth of the movies; shows with even ids are known by an identifier. Twice."""
    up = t.items.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("show_id"))
    tops = t.items.select(F.col("id").alias("show_id"), F.col("title").alias("show_title"))
    one = lambda c: F.array(F.struct(F.lit("tvdb").alias("provider"), c.alias("external_id")))
    episodes = t.items.where("kind = 'episode'").join(up, "parent_id").join(tops, "show_id")
    plays = episodes.select(
        text_id("p").alias("id"), "kind", "title", F.lit(None).cast("int").alias("year"), one(text_id("e")).alias("ids"), "show_title", F.lit(None).cast("int").alias("show_year"), one(text_id("h", "show_id")).alias("show_ids"),
        (F.col("season_number") + 1).alias("season"), F.col("episode_number").alias("number"),
    )
    none = F.lit(None)
    movies = t.items.where("kind = 'movie' AND id % 5 = 0").select(
        text_id("p").alias("id"), "kind", "title", "year", one(text_id("m")).alias("ids"), none.cast("string").alias("show_title"), none.cast("int").alias("show_year"), one(text_id("m")).alias("show_ids"), none.cast("int").alias("season"), none.cast("int").alias("number"),
    )
    plays = plays.unionByName(movies)
    ids = t.items.where("kind = 'show' AND id % 2 = 0").select(F.col("id").alias("media_item_id"), F.lit("tvdb").alias("provider"), text_id("h").alias("external_id"))
    preferred = t.refs.select("media_item_id").limit(0)
    made = creation.create_history(plays, t.items, ids, preferred)
    again = creation.create_history(plays, t.items.unionByName(made.items), ids.unionByName(made.identifiers), preferred)
    new = made.items.unionByName(again.items)  # the second adds nothing
    above = t.items.unionByName(made.items).select(F.col("id").alias("parent_id"), F.col("title").alias("above"))
    return new.join(above, "parent_id", "left").select("kind", "title", "above", F.col("season_number").alias("season"))


@register("q01_q02_all_constraints", """SELECT 'refs(source_id, external_id) unique' AS "constraint", concat('["', CAST(source_id AS VARCHAR), '","', external_id, '"]') AS value, count(*) AS n FROM (SELECT source_id, external_id FROM source_media_refs UNION ALL SELECT source_id, external_id FROM source_media_refs WHERE media_item_id % 10 = 0) GROUP BY source_id, external_id HAVING count(*) > 1
UNION ALL SELECT 'events(id) unique', concat('["', CAST(id AS VARCHAR), '"]'), count(*) FROM watch_events GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'events(media_item_id) in items', concat('["', CAST(media_item_id AS VARCHAR), '"]'), count(*) FROM watch_events WHERE media_item_id % 4 = 0 GROUP BY media_item_id
UNION ALL SELECT 'refs(media_item_id) in items', concat('["', CAST(media_item_id AS VARCHAR), '"]'), count(*) FROM (SELECT media_item_id FROM source_media_refs UNION ALL SELECT media_item_id FROM source_media_refs WHERE media_item_id % 10 = 0) WHERE media_item_id % 4 = 0 GROUP BY media_item_id
UNION ALL SELECT 'states(media_item_id) in items', concat('["', CAST(media_item_id AS VARCHAR), '"]'), count(*) FROM watch_states WHERE media_item_id % 4 = 0 GROUP BY media_item_id
UNION ALL SELECT 'items(parent_id) in items', concat('["', CAST(parent_id AS VARCHAR), '"]'), count(*) FROM media_items WHERE id % 4 <> 0 AND parent_id % 4 = 0 GROUP BY parent_id
UNION ALL SELECT 'refs(library_id) in libraries', concat('["', CAST(library_id AS VARCHAR), '"]'), count(*) FROM (SELECT library_id FROM source_media_refs UNION ALL SELECT library_id FROM source_media_refs WHERE media_item_id % 10 = 0) WHERE library_id NOT IN (SELECT id FROM libraries) GROUP BY library_id
UNION ALL SELECT 'identifiers(media_item_id) in items', concat('["', CAST(media_item_id AS VARCHAR), '"]'), count(*) FROM media_identifiers WHERE media_item_id % 4 = 0 GROUP BY media_item_id
UNION ALL SELECT 'genres(media_item_id) in items', concat('["', CAST(media_item_id AS VARCHAR), '"]'), count(*) FROM media_genres WHERE media_item_id % 4 = 0 GROUP BY media_item_id""")
def _(t: Tables) -> DataFrame:
    """A tenth of the references twice, and a quarter of the items gone."""
    refs = t.refs.unionByName(t.refs.where("media_item_id % 10 = 0"))
    held = {"sources": t.sources, "libraries": t.libraries, "items": t.items.where("id % 4 <> 0"), "refs": refs, "identifiers": t.identifiers, "genres": t.genres, "events": t.events, "states": t.states}
    return quality.violations(held)
