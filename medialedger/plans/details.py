"""Queries of the finer operators over the test tables, with their SQL. Payloads are built from the tables' own values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialedger import functions as fn
from medialedger import quality
from medialedger.adapters import Tables
from medialedger.identity import matching, merge
from medialedger.operators import catalog, containers, enrichment, ingest, ledger, repair, reports
from medialedger.plans.registry import NOW, register
from medialedger.sources import history_export, payloads
from medialedger.streaming import notifications, playback
from medialedger.tables import discard, written


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def text_id(prefix: str, c: str = "id") -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


# Columns and keys.


@register("p08_p09_canonical_keys", """SELECT id, sha256(concat('{"id":', CAST(id AS VARCHAR), ',"title":"', title, '","year":', coalesce(CAST(year AS VARCHAR), 'null'), '}')) AS signature,
sha256(concat('{"completed":true,"duration_ms":', coalesce(CAST(duration_ms AS VARCHAR), 'null'), ',"media_external_id":"m', CAST(id AS VARCHAR), '","progress_ms":null,"source_event_id":',
CASE WHEN id % 2 = 0 THEN concat('"e', CAST(id AS VARCHAR), '"') ELSE 'null' END, ',"source_id":1,"view_number":', CAST(id % 3 AS VARCHAR), ',"watched_at":"2024-01-01T00:00:00+00:00"}')) AS dedup_key FROM media_items""")
def _(t: Tables) -> DataFrame:
    event = F.when(F.col("id") % 2 == 0, text_id("e"))
    key = fn.event_key(F.lit(1), event, text_id("m"), ntz("2024-01-01"), F.lit(True), F.lit(None).cast("bigint"), F.col("duration_ms"), (F.col("id") % 3).cast("int"))
    return t.items.select("id", fn.signature({c: F.col(c) for c in ("title", "year", "id")}).alias("signature"), key.alias("dedup_key"))


@register("p22_p24_p26_p29_display", """SELECT id, substring(title, 1, 7) AS short, CASE WHEN duration_ms IS NULL THEN '\u2014' WHEN duration_ms // 60000 >= 60 THEN concat(CAST(duration_ms // 3600000 AS VARCHAR), 'h ', lpad(CAST(duration_ms // 60000 % 60 AS VARCHAR), 2, '0'), 'min')
ELSE concat(CAST(duration_ms // 60000 AS VARCHAR), ' min') END AS duration, concat(CAST(id % 5000 // 60 AS VARCHAR), 'm ', lpad(CAST(id % 5000 % 60 AS VARCHAR), 2, '0'), 's') AS elapsed,
strftime(TIMESTAMP '2024-01-01 12:00:00' + to_seconds(id % 100000) - INTERVAL 3 HOUR, '%d/%m/%Y %H:%M') AS local, id % 2 = 0 AS numeric, id % 3 = 0 AS mbid,
concat('token=*** ', title) AS redacted FROM media_items""".replace("\\u2014", "\u2014"))
def _(t: Tables) -> DataFrame:
    seconds = F.col("id") % 100000
    at = F.timestamp_seconds(F.lit(1704110400) + seconds)
    start = F.timestamp_seconds(F.lit(0).cast("bigint"))
    mbid = F.concat(F.lit("0a1b2c3d-0000-4000-8000-"), F.lpad(F.col("id").cast("string"), 12, "0"), F.when(F.col("id") % 3 != 0, "x").otherwise(""))
    return t.items.select(
        "id", fn.cut(F.col("title"), 7).alias("short"), fn.duration_text(F.col("duration_ms")).alias("duration"), fn.elapsed_text(start, F.timestamp_seconds(F.col("id") % 5000)).alias("elapsed"),
        fn.local_text(at, "America/Sao_Paulo").alias("local"), fn.is_numeric_id(F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise("x1")).alias("numeric"), fn.is_mbid(mbid).alias("mbid"),
        fn.redact(F.concat(F.lit("token=abc "), F.col("title"))).alias("redacted"),
    )


@register("p03_p04_p20_p21_texts", """SELECT id, lower(title) AS title_key, concat('a & ', title) AS plain, CASE WHEN id % 2 = 0 THEN 'tmdb' END AS provider, CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) END AS external_id,
CASE WHEN id % 3 = 0 THEN true WHEN id % 4 IS NOT NULL AND id % 100 >= 90 THEN true ELSE false END AS completed, 'A,b' AS tags FROM media_items""")
def _(t: Tables) -> DataFrame:
    done = fn.history_completed(F.when(F.col("id") % 3 == 0, 1).otherwise(0), F.col("id") % 100, F.lit(100), F.lit(True))
    p = fn.provider_id(F.when(F.col("id") % 2 == 0, text_id("TMDB://")).otherwise(F.lit("nothing")))
    return t.items.select(
        "id", fn.title_key("title").alias("title_key"), fn.unescape_html(F.concat(F.lit("a &amp; "), F.col("title"))).alias("plain"), p["provider"].alias("provider"), p["external_id"].alias("external_id"),
        done.alias("completed"), F.array_join(fn.sorted_tags(F.array(F.lit("b"), F.lit(" A "), F.lit("b"), F.lit(""))), ",").alias("tags"),
    )


# Payloads of the servers and providers, built from the tables.


@register("s01_container_items", """SELECT id, 'Metadata' AS tag, title, CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS n FROM media_items WHERE kind = 'movie' AND id % 5 <> 0
UNION ALL SELECT id, NULL, NULL, 0 FROM media_items WHERE kind = 'movie' AND id % 5 = 0""")
def _(t: Tables) -> DataFrame:
    item = F.to_json(F.struct(F.col("id").cast("string").alias("ratingKey"), F.lit("movie").alias("type"), "title"))
    held = F.when(F.col("id") % 3 == 0, F.concat(F.lit("["), item, F.lit(","), item, F.lit("]"))).otherwise(item)  # a list, or the item alone
    text = F.when(F.col("id") % 5 == 0, F.lit('{"MediaContainer": {"Metadata": [')).otherwise(F.concat(F.lit('{"MediaContainer": {"Metadata": '), held, F.lit("}}")))
    rows = payloads.container_items(t.items.where("kind = 'movie'").select("id", text.alias("value")))
    return rows.groupBy("id", "tag", F.col("item.title").alias("title")).agg(F.count("tag").cast("int").alias("n"))


@register("s01_xml_container_items", """SELECT id, 'Video' AS tag, CAST(id AS VARCHAR) AS external_id, kind, CAST(NULL AS VARCHAR) AS reason FROM media_items WHERE id % 7 <> 0
UNION ALL SELECT id, NULL, NULL, NULL, 'XML declarations' FROM media_items WHERE id % 7 = 0""")
def _(t: Tables) -> DataFrame:
    head = F.when(F.col("id") % 7 == 0, F.lit("<!DOCTYPE x>")).otherwise("")
    text = F.concat(head, F.lit('<MediaContainer size="1"><Video ratingKey="'), F.col("id").cast("string"), F.lit('" type="'), F.col("kind"), F.lit('"/></MediaContainer>'))
    rows = payloads.container_items(t.items.select("id", text.alias("value")))
    return rows.select("id", "tag", F.col("item.ratingKey").alias("external_id"), F.col("item.type").alias("kind"), "reason")


def second_payload(t: Tables, **fields: Column) -> DataFrame:
    item = F.struct(*[c.alias(n) for n, c in fields.items()])
    return payloads.second_server_rows(t.items.select("id", F.lit("l1").alias("library_external_id"), F.to_json(F.struct(F.array(item).alias("Items"))).alias("value")))


@register("s07_s08_second_server_history", """SELECT concat('i', CAST(id AS VARCHAR)) AS media_external_id, concat('jellyfin:i', CAST(id AS VARCHAR), ':2024-01-02T03:04:05+00:00') AS source_event_id, duration_ms, CAST(id % 3 AS INTEGER) AS view_number, true AS completed
FROM media_items WHERE id % 3 > 0 AND id % 2 = 0 AND kind IN ('movie', 'episode')""")
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("kind") == "movie", "Movie").when(F.col("kind") == "episode", "Episode").otherwise("Folder")
    played = F.struct(F.when(F.col("id") % 2 == 0, "2024-01-02T03:04:05Z").alias("LastPlayedDate"), (F.col("id") % 3).alias("PlayCount"))
    rows = payloads.second_server_items(second_payload(t, Id=text_id("i"), Name=F.col("title"), Type=kind, RunTimeTicks=F.col("duration_ms") * 10000, UserData=played))
    return payloads.second_server_history(rows).select("media_external_id", "source_event_id", "duration_ms", "view_number", "completed")


@register("s06_s10_second_server_lists", """SELECT 'library' AS list, concat('I-', CAST(id AS VARCHAR)) AS id, title AS name FROM media_items WHERE kind <> 'movie' AND id % 2 = 0
UNION ALL SELECT 'user', concat('i', CAST(id AS VARCHAR)), title FROM media_items""")
def _(t: Tables) -> DataFrame:
    kind = F.when((F.col("kind") != "movie") & (F.col("id") % 2 == 0), "TvShows").otherwise("photos")
    rows = second_payload(t, Id=text_id("I-"), Name=F.col("title"), CollectionType=kind)
    libraries = payloads.second_server_libraries(rows).select(F.lit("library").alias("list"), F.col("external_id").alias("id"), "name")
    return libraries.unionByName(payloads.second_server_users(rows).select(F.lit("user").alias("list"), "id", "name"))


@register("s25_s26_provider_answers", """SELECT id, title AS summary, CASE WHEN id % 2 = 0 THEN concat('https://image.tmdb.org/t/p/w500/', CAST(id AS VARCHAR), '.jpg') END AS poster_url, 'Drama,war' AS genres FROM media_items""")
def _(t: Tables) -> DataFrame:
    name = lambda x: F.struct(F.lit(x).alias("name"))
    path = F.when(F.col("id") % 2 == 0, F.concat(F.lit("/"), F.col("id").cast("string"), F.lit(".jpg"))).otherwise("/../x")
    text = F.to_json(F.struct(F.col("title").alias("overview"), path.alias("poster_path"), F.array(name("war"), name("Drama"), name(" war ")).alias("genres")))
    return payloads.provider_answers(t.items.select("id", text.alias("value"))).select("id", "summary", "poster_url", F.array_join("genres", ",").alias("genres"))


@register("w01_w02_f14_first_notifications", """SELECT CAST(event_id AS VARCHAR) AS event_key, external_id, event_type, progress_percent, event_type = 'media.scrobble' AND playback_user = '7' OR event_type = 'media.stop' AND progress_percent >= 90 AND playback_user = '7' AS completed
FROM playback_stream WHERE event_type IS NOT NULL AND event_id % 5 <> 0""")
def _(t: Tables) -> DataFrame:
    meta = F.struct(F.col("external_id").alias("ratingKey"), F.lit("100").alias("duration"), F.col("progress_percent").cast("string").alias("viewOffset"), F.when(F.col("event_id") % 5 == 0, "1").alias("live"))
    text = F.to_json(F.struct(F.upper("event_type").alias("event"), F.col("event_id").cast("string").alias("event_id"), F.struct(F.col("playback_user").alias("id")).alias("Account"), meta.alias("Metadata")))
    raw = t.playback.select("source_id", text.alias("value"), F.col("occurred_at").cast("timestamp").alias("arrived_at"))
    return notifications.first_server(raw, ["7"]).select("event_key", "external_id", "event_type", "progress_percent", "completed")


# Containers, episodes, repair and import.


SHOWS = """, w AS (SELECT id, CASE WHEN id % 2 = 0 THEN concat(title, '  ') ELSE 'Other' END AS title FROM media_items WHERE kind = 'show'),
ids AS (SELECT id AS media_item_id, 'tvdb' AS provider, concat('t', CAST(id % 3 AS VARCHAR)) AS external_id FROM media_items WHERE kind = 'show')"""


@register("m05_matched_containers", f"""{SHOWS}, q AS (SELECT concat('x', CAST(id AS VARCHAR)) AS external_id, title, CASE WHEN id % 2 = 1 THEN concat('t', CAST(id % 4 AS VARCHAR)) END AS tid, id FROM w),
m AS (SELECT q.external_id, i.id AS m, lower(trim(i.title)) = lower(trim(q.title)) AS alike FROM q JOIN ids d ON d.external_id = q.tid JOIN media_items i ON i.id = d.media_item_id),
g AS (SELECT external_id, CASE WHEN count(*) > 1 THEN min(m) FILTER (WHERE alike) ELSE min(m) END AS lo, CASE WHEN count(*) > 1 THEN max(m) FILTER (WHERE alike) ELSE max(m) END AS hi FROM m GROUP BY external_id),
h AS (SELECT q.external_id, min(i.id) AS lo, max(i.id) AS hi FROM q JOIN media_items i ON i.kind = 'show' AND lower(trim(i.title)) = lower(trim(q.title)) GROUP BY q.external_id),
shows AS (SELECT q.external_id, coalesce(g.lo, h.lo) AS lo, CASE WHEN g.lo IS NULL THEN h.hi ELSE g.hi END AS hi FROM q LEFT JOIN g USING (external_id) LEFT JOIN h USING (external_id)),
seasons AS (SELECT concat('s', CAST(i.id AS VARCHAR)) AS external_id, min(j.id) AS lo, max(j.id) AS hi FROM media_items i LEFT JOIN media_items j ON j.kind = 'season' AND j.parent_id = i.parent_id AND j.season_number = i.season_number + 5 WHERE i.kind = 'season' GROUP BY 1)
SELECT external_id, CASE WHEN lo IS NULL THEN 'new' WHEN lo <> hi THEN 'ambiguous' ELSE 'matched' END AS match_status, CASE WHEN lo = hi THEN lo END AS media_item_id FROM (SELECT * FROM shows UNION ALL SELECT * FROM seasons)""")
def _(t: Tables) -> DataFrame:
    shows = t.items.where("kind = 'show'")
    title = F.when(F.col("id") % 2 == 0, F.concat("title", F.lit("  "))).otherwise("Other")
    staged = shows.select(F.lit(1).alias("source_id"), text_id("x").alias("external_id"), "kind", title.alias("title"), "parent_id", "season_number")
    seasons = t.items.where("kind = 'season'").select(F.lit(1).alias("source_id"), text_id("s").alias("external_id"), "kind", "title", "parent_id", (F.col("season_number") + 5).alias("season_number"))
    named = shows.where("id % 2 = 1").select(F.lit(1).alias("source_id"), text_id("x").alias("external_id"), F.lit("tvdb").alias("provider"), F.concat(F.lit("t"), (F.col("id") % 4).cast("string")).alias("identifier"))
    ids = shows.select(F.col("id").alias("media_item_id"), F.lit("tvdb").alias("provider"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("external_id"))
    return containers.match_containers(staged.unionByName(seasons), named, t.items, ids).select("external_id", "match_status", "media_item_id")


@register("m06_bound_hierarchy", """, e AS (SELECT e.id, e.season_number + CASE WHEN e.id % 4 = 0 THEN 1 ELSE 0 END AS n, s.id AS season_id, s.season_number AS sn, s.parent_id AS show_id FROM media_items e JOIN media_items s ON s.id = e.parent_id WHERE e.kind = 'episode'),
x AS (SELECT *, concat('h', CAST(show_id AS VARCHAR)) AS hx, concat('h', CAST(show_id AS VARCHAR), ':season:', CAST(n AS VARCHAR)) AS sx FROM e),
old AS (SELECT concat('h', CAST(id AS VARCHAR)) AS external_id, CASE WHEN id % 5 = 0 THEN id ELSE -id END AS media_item_id FROM media_items WHERE kind = 'show' AND id % 5 < 2),
m AS (SELECT x.*, CASE WHEN n <> sn THEN 'incompatible hierarchy' WHEN o.media_item_id <> show_id THEN 'conflicting container' END AS message FROM x LEFT JOIN old o ON o.external_id = x.hx)
SELECT external_id, media_item_id, CAST(NULL AS VARCHAR) AS message FROM old UNION SELECT hx, show_id, NULL FROM m WHERE message IS NULL UNION SELECT sx, season_id, NULL FROM m WHERE message IS NULL
UNION ALL SELECT concat('e', CAST(id AS VARCHAR)), NULL, message FROM m WHERE message IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    shows = t.items.where("kind = 'season'").select(F.col("id").alias("season_id"), F.col("parent_id").alias("show_id"))
    episodes = t.items.where("kind = 'episode'").join(shows, F.col("parent_id") == F.col("season_id"))
    matched = episodes.select(
        F.lit(1).alias("source_id"), text_id("e").alias("external_id"), F.lit(7).cast("bigint").alias("library_id"), F.col("id").alias("media_item_id"), (F.col("season_number") + F.when(F.col("id") % 4 == 0, 1).otherwise(0)).alias("season_number"),
        text_id("h", "show_id").alias("show_external_id"), F.lit("S").alias("show_title"), F.lit(None).cast("string").alias("season_external_id"),
    )
    old = t.items.where("kind = 'show' AND id % 5 < 2").select(
        F.lit(1).alias("source_id"), text_id("h").alias("external_id"), F.when(F.col("id") % 5 == 0, F.col("id")).otherwise(-F.col("id")).alias("media_item_id"), F.lit(7).cast("bigint").alias("library_id"), F.lit(False).alias("available")
    )
    bound, _titles, errors = containers.bind_hierarchy(old, matched, t.items, NOW)
    none = F.lit(None)
    return bound.select("external_id", "media_item_id", none.cast("string").alias("message")).unionByName(errors.select("external_id", none.cast("bigint").alias("media_item_id"), "message"))


@register("m16_rebuilt_container_states", """, e AS (SELECT media_item_id, count(*) AS n, max(watched_at) AS t FROM watch_events WHERE completed AND source_id = 1 GROUP BY media_item_id),
s AS (SELECT * FROM watch_states WHERE source_id = 1),
c AS (SELECT i.parent_id, p.parent_id AS g, greatest(coalesce(e.n, 0), coalesce(s.view_count, 0)) AS plays, CASE WHEN e.t IS NULL THEN s.last_watched_at WHEN s.last_watched_at IS NULL THEN e.t ELSE greatest(e.t, s.last_watched_at) END AS last
  FROM source_media_refs r JOIN media_items i ON i.id = r.media_item_id AND i.kind = 'episode' JOIN media_items p ON p.id = i.parent_id LEFT JOIN e USING (media_item_id) LEFT JOIN s USING (media_item_id) WHERE r.available AND r.library_id = 8 AND r.source_id = 1),
d AS (SELECT media_item_id, CAST(greatest(min(plays), 0) AS INTEGER) AS view_count, max(last) AS last FROM (SELECT plays, last, unnest([parent_id, g]) AS media_item_id FROM c) WHERE media_item_id IS NOT NULL GROUP BY media_item_id)
SELECT media_item_id, source_id, view_count, last_watched_at, completed, progress_ms FROM watch_states WHERE NOT (source_id = 1 AND media_item_id IN (SELECT media_item_id FROM d))
UNION ALL SELECT media_item_id, 1, view_count, last, view_count > 0, NULL FROM d""")
def _(t: Tables) -> DataFrame:
    return catalog.rebuild_container_states(t.items, t.events, t.states, t.refs, 1, 8, NOW).drop("observed_at")


@register("m25_j16_merged_episodes", """, sea AS (SELECT id AS season_id, id - 1 AS target_id FROM media_items WHERE kind = 'season' AND id % 2 = 1 AND id % 3 <> 0),
ids AS (SELECT id AS media_item_id, id // 40 AS x FROM media_items WHERE kind = 'episode' AND id % 5 <> 0),
lost AS (SELECT e.id AS episode_id, s.target_id FROM media_items e JOIN sea s ON s.season_id = e.parent_id WHERE e.kind = 'episode'),
one AS (SELECT l.episode_id, min(w.id) AS m FROM lost l JOIN ids a ON a.media_item_id = l.episode_id JOIN ids b ON b.x = a.x JOIN media_items w ON w.id = b.media_item_id AND w.parent_id = l.target_id GROUP BY l.episode_id HAVING count(DISTINCT w.id) = 1),
safe AS (SELECT * FROM one WHERE NOT EXISTS (SELECT 1 FROM source_media_refs a JOIN source_media_refs b ON a.source_id = b.source_id WHERE a.media_item_id = one.episode_id AND b.media_item_id = one.m))
SELECT l.episode_id, coalesce(s.m, l.target_id) AS target_id, CASE WHEN s.m IS NULL THEN 'reparent' ELSE 'merge' END AS action FROM lost l LEFT JOIN safe s USING (episode_id)""")
def _(t: Tables) -> DataFrame:
    seasons = t.items.where("kind = 'season' AND id % 2 = 1 AND id % 3 <> 0").select(F.col("id").alias("season_id"), (F.col("id") - 1).alias("target_id"), F.lit("merge").alias("action"))
    ids = t.items.where("kind = 'episode' AND id % 5 <> 0").select(F.col("id").alias("media_item_id"), F.lit("tvdb").alias("provider"), F.floor(F.col("id") / 40).cast("string").alias("external_id"))
    return matching.episode_merge(t.items, ids, t.refs, seasons)


@register("m19_repaired_rows", """, ids AS (SELECT id AS media_item_id, concat('m', CAST(id // 2 AS VARCHAR)) AS x FROM media_items WHERE kind = 'movie'),
ref AS (SELECT id AS media_item_id, CASE WHEN id % 6 < 4 THEN 1 + id % 2 ELSE 1 END AS source_id FROM media_items WHERE kind = 'movie'),
grp AS (SELECT x, min(media_item_id) AS lo, max(media_item_id) AS hi FROM ids GROUP BY x),
st AS (SELECT g.*, lo <> hi AND (SELECT count(DISTINCT source_id) FROM ref WHERE media_item_id IN (g.lo, g.hi)) = 2 AS merges,
  (SELECT min(media_item_id) FROM ref WHERE media_item_id IN (g.lo, g.hi) AND source_id = 1) AS lead FROM grp g)
SELECT x AS external_id, CASE WHEN lo = hi OR merges THEN 'matched' ELSE 'ambiguous' END AS match_status, CASE WHEN lo = hi THEN lo WHEN merges THEN lead END AS media_item_id, lo <> hi AND merges AS repaired FROM st""")
def _(t: Tables) -> DataFrame:
    movies = t.items.where("kind = 'movie'").select("id", F.concat(F.lit("m"), F.floor(F.col("id") / 2).cast("string")).alias("x"))
    ids = movies.select(F.col("id").alias("media_item_id"), F.lit("tmdb").alias("provider"), F.col("x").alias("external_id"))
    refs = movies.select(F.col("id").alias("media_item_id"), F.when(F.col("id") % 6 < 4, 1 + F.col("id") % 2).otherwise(1).cast("int").alias("source_id"), text_id("r").alias("external_id"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    staged = movies.select(F.lit(3).alias("source_id"), F.col("x").alias("external_id"), F.lit("movie").alias("kind"), none("string", "title"), none("int", "year"), none("int", "season_number"), none("string", "show_external_id"), none("string", "season_external_id")).distinct()
    named = staged.select("source_id", "external_id", F.lit("tmdb").alias("provider"), F.col("external_id").alias("identifier"))
    rows, _plan, errors = repair.resolve_with_repair(staged, named, named.limit(0), t.items, ids, refs, t.sources, written)
    helped = errors.where("category = 'catalog_auto_reconciled'").select("external_id", F.lit(True).alias("r"))
    return rows.join(helped, "external_id", "left").select("external_id", "match_status", "media_item_id", F.coalesce("r", F.lit(False)).alias("repaired"))


def exported(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Plays of movies by two ids: one in five has a known first id, and its second one is that of the next play."""
    ident = lambda p, c: F.struct(F.lit(p).alias("provider"), F.concat(F.lit(p), c.cast("string")).alias("external_id"))
    plays = t.items.where("kind = 'movie'").select("id", F.array(ident("a", F.col("id")), ident("b", F.floor(F.col("id") / 2))).alias("ids"), F.when(F.col("id") % 11 == 0, "no title").alias("reason"))
    known = t.items.where("kind = 'movie' AND id % 5 = 0").select(F.col("id").alias("media_item_id"), F.lit("a").alias("provider"), text_id("a").alias("external_id"))
    return plays, known


@register("m31_two_rounds", """, p AS (SELECT id FROM media_items WHERE kind = 'movie' AND id % 11 <> 0), one AS (SELECT id FROM p WHERE id % 5 = 0),
b AS (SELECT id // 2 AS x, min(id) AS m FROM one GROUP BY 1)
SELECT id, id AS media_item_id, 1 AS round FROM one UNION ALL SELECT p.id, b.m, 2 FROM p JOIN b ON b.x = p.id // 2 WHERE p.id NOT IN (SELECT id FROM one)""")
def _(t: Tables) -> DataFrame:
    plays, known = exported(t)
    return history_export.match_in_rounds(plays, known, known.select("media_item_id").limit(0), known.limit(0))[0]


@register("a16_import_counters", """, p AS (SELECT id FROM media_items WHERE kind = 'movie'), one AS (SELECT id FROM p WHERE id % 5 = 0 AND id % 11 <> 0),
m AS (SELECT p.id FROM p WHERE id % 11 <> 0 AND id // 2 IN (SELECT id // 2 FROM one))
SELECT CAST(2 AS BIGINT) AS history_files, (SELECT count(*) FROM p) AS events_read, (SELECT count(*) FROM p WHERE id % 11 <> 0) AS events_valid, (SELECT count(*) FROM p WHERE id % 11 = 0) AS invalid_events, (SELECT count(*) FROM m) AS media_matched,
CAST(0 AS BIGINT) AS ambiguous_events, (SELECT count(*) FROM p) AS media_created, (SELECT count(*) FROM media_items WHERE kind = 'show') AS shows_created, (SELECT count(*) FROM media_items WHERE kind = 'season') AS seasons_created,
(SELECT count(DISTINCT id // 2) FROM one) AS identifiers_added, (SELECT count(*) FROM m WHERE id % 2 = 0) AS events_inserted, (SELECT count(*) FROM m WHERE id % 2 = 1) AS events_already_imported""")
def _(t: Tables) -> DataFrame:
    plays, known = exported(t)
    matched, ambiguous, added = history_export.match_in_rounds(plays, known, known.select("media_item_id").limit(0), known.limit(0))
    rows = matched.select("id", "media_item_id", F.lit(False).alias("ambiguous")).unionByName(ambiguous.select("id", F.lit(None).cast("bigint").alias("media_item_id"), F.lit(True).alias("ambiguous")))
    return reports.import_counters(2, plays, rows, t.items.where("kind IN ('movie', 'show', 'season')"), added, matched.where("id % 2 = 0"), matched.where("id % 2 = 1"))


# Streams in batch, quality and reports.


@register("w06_w07_replayed_notifications", """, r AS (SELECT source_id, external_id, min(media_item_id) AS m, min(CASE WHEN media_item_id % 2 = 0 THEN library_id END) AS l FROM source_media_refs GROUP BY ALL), lo AS (SELECT source_id, min(id) AS l FROM libraries GROUP BY source_id),
w AS (SELECT event_id, source_id, concat(CASE source_id WHEN 1 THEN 'p' ELSE 'j' END, CAST(1000000 + event_id % 3000 AS VARCHAR)) AS external_id FROM playback_stream WHERE event_type = 'media.scrobble')
SELECT concat('webhook:', CAST(event_id AS VARCHAR)) AS source_event_id, r.m AS media_item_id, coalesce(r.l, lo.l) AS library_id FROM w JOIN r USING (source_id, external_id) LEFT JOIN lo USING (source_id)""")
def _(t: Tables) -> DataFrame:
    name = F.concat(F.when(F.col("source_id") == 1, "p").otherwise("j"), (1000000 + F.col("event_id") % 3000).cast("string"))
    pending = playback.completed(t.playback.withColumn("external_id", name)).where("event_type = 'media.scrobble'").withColumnRenamed("event_id", "id")
    refs = t.refs.withColumn("library_id", F.when(F.col("media_item_id") % 2 == 0, F.col("library_id")))
    return matching.replayed(pending, refs, t.libraries).select("source_event_id", "media_item_id", "library_id")


@register("w08_outbox", """, c AS (SELECT DISTINCT source_id, concat(CASE source_id WHEN 1 THEN 'p' ELSE 'j' END, CAST(media_item_id AS VARCHAR)) AS external_id, media_item_id, watched_at FROM watch_events WHERE completed AND media_item_id < 2000000 AND id % 3 = 0)
SELECT c.source_id, c.external_id, t.source_id AS target_source, t.external_id AS target_external, sha256(concat('watch:', CAST(c.source_id AS VARCHAR), ':', c.external_id, ':', strftime(c.watched_at, '%Y-%m-%dT%H:%M:%SZ'))) AS dedup_key
FROM c JOIN source_media_refs r ON r.source_id = c.source_id AND r.external_id = c.external_id AND r.available JOIN source_media_refs t ON t.media_item_id = c.media_item_id AND t.source_id <> c.source_id AND t.available
WHERE NOT EXISTS (SELECT 1 FROM watch_states s WHERE s.media_item_id = c.media_item_id AND s.source_id = t.source_id AND s.completed) AND c.media_item_id % 13 <> 0""")
def _(t: Tables) -> DataFrame:
    name = F.concat(F.when(F.col("source_id") == 1, "p").otherwise("j"), F.col("media_item_id").cast("string"))
    plays = t.events.where("completed AND media_item_id < 2000000 AND id % 3 = 0").select("source_id", name.alias("external_id"), "watched_at", "media_item_id")
    none = t.refs.limit(0)
    sent = playback.outbox(plays.where("media_item_id % 13 = 0"), t.refs, t.sources, t.states.limit(0), none.select(F.col("external_id").alias("dedup_key")))
    left = plays.join(sent.select("source_id", "external_id").distinct(), ["source_id", "external_id"], "left_anti").where("media_item_id % 13 <> 0")
    return playback.outbox(left, t.refs, t.sources, t.states, sent.select("dedup_key")).select("source_id", "external_id", "target_source", "target_external", "dedup_key")


@register("m17_incremental_windows", """SELECT id AS library_id, id % 3 = 0 OR id % 4 = 0 AS full_scan, CASE WHEN NOT (id % 3 = 0 OR id % 4 = 0) THEN TIMESTAMP '2023-12-30' END AS updated_since, TIMESTAMP '2023-12-31 23:58:00' AS next_watermark FROM libraries""")
def _(t: Tables) -> DataFrame:
    full = F.when(F.col("id") % 4 == 0, ntz("2023-12-01")).otherwise(ntz("2023-12-29"))
    marks = t.libraries.select(F.col("id").alias("library_id"), F.when(F.col("id") % 3 != 0, ntz("2023-12-30")).alias("watermark_at"), full.alias("last_full_scan_at"))
    return ledger.incremental_window(marks, NOW)


@register("m22_reset_marks", "SELECT id AS library_id FROM libraries WHERE source_id <> 1")
def _(t: Tables) -> DataFrame:
    return ingest.reset_marks(t.libraries.select(F.col("id").alias("library_id")), t.libraries, 1)


@register("m34_repaired_records", "SELECT media_item_id, CASE WHEN media_item_id % 3 = 0 THEN 'not_found' WHEN media_item_id % 3 = 1 THEN 'failed' ELSE 'succeeded' END AS status FROM media_identifiers WHERE provider = 'tmdb'")
def _(t: Tables) -> DataFrame:
    rows = t.identifiers.where("provider = 'tmdb'").select("media_item_id", F.when(F.col("media_item_id") % 3 == 2, "succeeded").otherwise("failed").alias("status"), F.when(F.col("media_item_id") % 3 != 1, "gone").alias("message"))
    return enrichment.repaired(rows, ["gone"]).select("media_item_id", "status")


@register("s22_inserted_if_missing", "SELECT source_id, external_id, title FROM staged WHERE item_id % 2 = 1")
def _(t: Tables) -> DataFrame:
    rows = t.staged.select("source_id", "external_id", "title", "item_id")
    return ledger.insert_missing(rows.where("item_id % 2 = 0").drop("item_id"), rows.drop("item_id").unionByName(rows.drop("item_id")), ["source_id", "external_id"])


@register("q04_invalid_staged_rows", """SELECT external_id, concat_ws(',', CASE WHEN item_id % 7 = 0 THEN 'title' END, CASE WHEN item_id % 4 = 0 THEN 'duration' END, CASE WHEN kind = 'episode' AND item_id % 3 = 0 THEN 'episode' END) AS reasons
FROM staged WHERE item_id % 7 = 0 OR item_id % 4 = 0 OR kind = 'episode' AND item_id % 3 = 0""")
def _(t: Tables) -> DataFrame:
    i = F.col("item_id")
    rows = t.staged.select(
        "external_id", "kind", F.when(i % 7 == 0, " ").otherwise(F.col("title")).alias("title"), F.when(i % 4 == 0, -1).otherwise(5).alias("duration_ms"), F.lit(0).alias("view_count"), "show_external_id",
        F.when(i % 3 != 0, F.lit(1)).alias("season_number"), F.lit(1).alias("episode_number"), F.lit("a").alias("artist_external_id"), F.lit("b").alias("album_external_id"),
    )
    return quality.outside(rows, quality.item_checks()).select("external_id", F.array_join("reasons", ",").alias("reasons"))


@register("r02_library_and_run_rows", """SELECT 'library' AS kind, id, name AS text FROM libraries UNION ALL SELECT 'run', id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') FROM runs""")
def _(t: Tables) -> DataFrame:
    rows = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), "id", F.col(c).alias("text"))
    return rows(reports.library_rows(t.libraries), "library", "name").unionByName(rows(reports.run_rows(t.runs), "run", "created_at"))


@register("r04_run_detail", """, rl AS (SELECT l.id, l.id % 3 AS run_id, l.id AS library_id FROM libraries l)
SELECT 'library' AS part, id FROM rl WHERE run_id = 1 UNION ALL SELECT 'checkpoint', library_id FROM rl WHERE run_id = 1 AND library_id % 2 = 0
UNION ALL (SELECT 'error', id FROM media_items WHERE id % 3 = 1 ORDER BY CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END, id LIMIT 100) UNION ALL SELECT 'run', id FROM runs WHERE id = 1""")
def _(t: Tables) -> DataFrame:
    own = t.libraries.select("id", (F.col("id") % 3).alias("run_id"), F.col("id").alias("library_id"))
    errors = t.items.select("id", (F.col("id") % 3).alias("run_id"), F.when(F.col("id") % 2 == 0, "regression").otherwise("item").alias("category"))
    parts = reports.run_detail(t.runs, own, errors, own.where("library_id % 2 = 0").select("library_id"), 1)
    ids = lambda name, c="id": parts[name].select(F.lit(name.removesuffix("s") if name != "libraries" else "library").alias("part"), F.col(c).cast("bigint").alias("id"))
    return ids("libraries").unionByName(ids("checkpoints", "library_id")).unionByName(ids("errors")).unionByName(ids("run"))


@register("n05_tracks_in_order", """SELECT id, row_number() OVER (PARTITION BY parent_id ORDER BY id % 3 NULLS FIRST, id % 11 NULLS FIRST, episode_number NULLS FIRST, id) AS place FROM media_items WHERE parent_id IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    rows = t.items.where("parent_id IS NOT NULL").withColumn("disc_number", (F.col("id") % 3).cast("int")).withColumn("track_number", (F.col("id") % 11).cast("int"))
    return catalog.ordered_children(rows).select("id", "place")


@register("f13_missing_fields_or_poster", """SELECT id FROM media_items WHERE kind = 'movie' AND (year % 2 = 0 OR id % 3 = 0)""")
def _(t: Tables) -> DataFrame:
    movies = t.items.where("kind = 'movie'").withColumn("summary", F.when(F.col("year") % 2 != 0, "s"))
    posters = movies.where("id % 3 <> 0").select(F.col("id").alias("media_item_id"), F.lit("poster").alias("image_type"))
    return enrichment.incomplete(movies, ["summary"], posters).select("id")


@register("a12_scored_matches", """, g AS (SELECT c_nationkey AS k, c_custkey AS id, 4000000 + c_custkey AS m FROM customer)
SELECT id, m AS media_item_id, false AS ambiguous FROM g WHERE id % 4 <> 0 UNION ALL SELECT id, CASE WHEN n = 1 THEN lo END, n <> 1 FROM (SELECT g.id, count(h.m) AS n, min(h.m) AS lo FROM g JOIN g h ON h.k = g.k WHERE g.id % 4 = 0 GROUP BY g.id)""")
def _(t: Tables) -> DataFrame:
    episodes = t.items.where("kind = 'episode'").select(F.col("id").alias("media_item_id"), (F.col("id") - 4000000).alias("id"), F.col("season_number").cast("string").alias("k"))
    ident = lambda p, c: F.struct(F.lit(p).alias("provider"), c.cast("string").alias("external_id"))
    both = F.when(F.col("id") % 4 != 0, F.array(ident("k", F.col("k")), ident("own", F.col("id")))).otherwise(F.array(ident("k", F.col("k"))))
    plays = episodes.select("id", both.alias("ids"), F.lit(None).cast("string").alias("reason"))
    ids = episodes.select("media_item_id", F.lit("k").alias("provider"), F.col("k").alias("external_id")).unionByName(episodes.select("media_item_id", F.lit("own").alias("provider"), F.col("id").cast("string").alias("external_id")))
    return history_export.match(plays, ids, episodes.select("media_item_id").limit(0))


@register("m23_groups_of_stable_ids", """, k AS (SELECT DISTINCT external_id, media_item_id AS id FROM media_identifiers WHERE provider = 'imdb'), f AS (SELECT external_id, min(id) AS lo, count(*) AS n FROM k GROUP BY external_id)
SELECT k.id AS media_item_id, f.lo AS group_id FROM k JOIN f USING (external_id) WHERE f.n > 1""")
def _(t: Tables) -> DataFrame:
    return merge.groups(t.items, t.identifiers, written, providers=("imdb",), drop=discard)
