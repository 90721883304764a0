"""Queries over the test tables by operator, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialedger import functions as fn
from medialedger import quality
from medialedger.adapters import Tables, with_views
from medialedger.identity import merge
from medialedger.tables import discard, written
from medialedger.operators import catalog, ledger, reports
from medialedger.streaming import playback

NOW = datetime(2024, 1, 1)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None) -> Callable:
    """Add a query; ``sql`` follows the views, so it may start with further ones (``, x AS (...) SELECT``)."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = f"{with_views()}\n{sql}".replace("WITH ", "WITH RECURSIVE ", 1)
        return f

    return add


E_LAST = "SELECT media_item_id AS id, max(watched_at) AS e, min(watched_at) AS f, count(*) AS n FROM watch_events WHERE completed GROUP BY media_item_id"
S_LAST = "SELECT media_item_id AS id, max(last_watched_at) AS s, max(view_count) AS c FROM watch_states WHERE completed GROUP BY media_item_id"
LAST = f", e AS ({E_LAST}), s AS ({S_LAST})"
STATS = f"""{LAST}, stats AS (SELECT i.*, CAST(greatest(coalesce(e.n, 0), coalesce(s.c, 0)) AS BIGINT) AS completion_count, e.f AS first_completed,
  coalesce(e.e, s.s) AS last_completed FROM media_items i LEFT JOIN e USING (id) LEFT JOIN s USING (id))"""
ROOT = ", roots AS (SELECT i.id, coalesce(p.parent_id, i.parent_id, i.id) AS root_id FROM media_items i LEFT JOIN media_items p ON i.parent_id = p.id)"
PLAYED = f"""{ROOT}, ea AS (SELECT media_item_id AS id, max(watched_at) AS e FROM watch_events GROUP BY media_item_id),
sa AS (SELECT media_item_id AS id, max(last_watched_at) AS s, max(CASE WHEN NOT completed AND progress_ms > 0 THEN last_watched_at END) AS p
  FROM watch_states WHERE completed OR progress_ms > 0 GROUP BY media_item_id),
act AS (SELECT root_id, max(e) AS e, max(s) AS s, max(p) AS p FROM roots LEFT JOIN ea USING (id) LEFT JOIN sa USING (id) GROUP BY root_id),
played AS (SELECT root_id, CASE WHEN e IS NOT NULL THEN greatest(e, coalesce(p, e)) ELSE s END AS last_played FROM act)"""
FLAGS = """, direct AS (SELECT r.media_item_id, bool_or(s.connector_type = 'plex') AS on_plex, bool_or(s.connector_type = 'jellyfin') AS on_jellyfin
  FROM source_media_refs r JOIN src s ON r.source_id = s.id WHERE r.available GROUP BY r.media_item_id),
own AS (SELECT d.*, i.kind FROM media_identifiers d JOIN media_items i ON i.id = d.media_item_id),
shared AS (SELECT a.media_item_id, bool_or(f.on_plex) AS on_plex, bool_or(f.on_jellyfin) AS on_jellyfin FROM own a
  JOIN own b USING (kind, provider, external_id) JOIN direct f ON f.media_item_id = b.media_item_id GROUP BY a.media_item_id)"""


@register("a01_history_last_completed", f"{LAST} SELECT i.id, i.title, CASE WHEN e.e IS NULL THEN s.s WHEN s.s IS NULL THEN e.e ELSE greatest(e.e, s.s) END AS last_completed FROM media_items i LEFT JOIN e USING (id) LEFT JOIN s USING (id)")
def _(t: Tables) -> DataFrame:
    return catalog.last_completed(t.items, t.events, t.states).select("id", "title", "last_completed")


HISTORY = f"{LAST}, h AS (SELECT i.id, i.kind, i.title, CASE WHEN e.e IS NULL THEN s.s WHEN s.s IS NULL THEN e.e ELSE greatest(e.e, s.s) END AS last_completed FROM media_items i LEFT JOIN e USING (id) LEFT JOIN s USING (id))"


@register("f07_history_page", f"{HISTORY} SELECT * FROM h WHERE last_completed IS NOT NULL ORDER BY last_completed DESC, id DESC LIMIT 51 OFFSET 50")
def _(t: Tables) -> DataFrame:
    rows = catalog.history(t.items, t.events, t.states).select("id", "kind", "title", "last_completed")
    return catalog.page(rows, [F.desc("last_completed"), F.desc("id")], 2, 50)


@register("f12_unwatched", f"{HISTORY} SELECT id, kind, title FROM h WHERE last_completed IS NULL")
def _(t: Tables) -> DataFrame:
    return catalog.history(t.items, t.events, t.states, watched="unwatched").select("id", "kind", "title")


@register("a20_history_total", f"{HISTORY} SELECT kind, count(*) AS total FROM h WHERE last_completed IS NOT NULL GROUP BY kind")
def _(t: Tables) -> DataFrame:
    return catalog.history(t.items, t.events, t.states).groupBy("kind").agg(F.count("*").alias("total"))


@register("a02_completion_stats", f"{STATS} SELECT id, completion_count, first_completed, last_completed FROM stats")
def _(t: Tables) -> DataFrame:
    return catalog.completion_stats(t.items, t.events, t.states).select("id", "completion_count", "first_completed", "last_completed")


@register("a03_last_played_by_root", f"{PLAYED} SELECT * FROM played")
def _(t: Tables) -> DataFrame:
    return catalog.last_played(t.items, t.events, t.states)


@register("j08_roots", f"{ROOT} SELECT * FROM roots")
def _(t: Tables) -> DataFrame:
    return catalog.with_root(t.items)


CATALOG = f"""{STATS}{PLAYED}{FLAGS}, cat AS (SELECT t.*, p.last_played, coalesce(h.on_plex, false) OR coalesce(d.on_plex, false) AS on_plex,
  coalesce(h.on_jellyfin, false) OR coalesce(d.on_jellyfin, false) AS on_jellyfin FROM stats t LEFT JOIN played p ON p.root_id = t.id
  LEFT JOIN shared h ON h.media_item_id = t.id LEFT JOIN direct d ON d.media_item_id = t.id WHERE t.kind IN ('movie', 'show', 'artist'))"""
CATALOG_COLUMNS = "id, kind, title, year, completion_count, first_completed, last_completed, last_played, on_plex, on_jellyfin"


def full_catalog(t: Tables, **filters: object) -> DataFrame:
    return catalog.catalog(t.items, t.events, t.states, t.identifiers, t.genres, t.refs, t.sources, **filters)


@register("f06_catalog", f"{CATALOG} SELECT {CATALOG_COLUMNS} FROM cat")
def _(t: Tables) -> DataFrame:
    return full_catalog(t).select(*CATALOG_COLUMNS.split(", "))


@register("f06_catalog_filtered", f"""{CATALOG} SELECT {CATALOG_COLUMNS} FROM cat WHERE title ILIKE '%re%' AND completion_count > 0
  AND id IN (SELECT media_item_id FROM source_media_refs WHERE available)""")
def _(t: Tables) -> DataFrame:
    return full_catalog(t, title="re", available="available", played="played").select(*CATALOG_COLUMNS.split(", "))


@register("f10_catalog_unavailable", f"{CATALOG} SELECT id, title FROM cat WHERE id NOT IN (SELECT media_item_id FROM source_media_refs WHERE available)")
def _(t: Tables) -> DataFrame:
    return full_catalog(t, available="unavailable").select("id", "title")


SORTS = {
    "title": "coalesce(d.sort_title, c.title)", "original_title": "coalesce(d.original_title, c.title)", "year": "c.year", "last_played": "c.last_played", "first_played": "c.first_completed",
    "play_count": "c.completion_count", "added": "coalesce(d.source_added_at, d.created_at)", "updated": "d.updated_at", "removed": "r.removed_at", "duration": "c.duration_ms", "rating": "c.audience_rating",
}


def sorted_page(key: str, descending: bool) -> None:
    way = "DESC" if descending else "ASC"
    sql = f"""{CATALOG}, r AS (SELECT media_item_id AS id, max(CASE WHEN NOT available THEN CAST(media_item_id % 97 AS INTEGER) END) AS removed_at FROM source_media_refs GROUP BY media_item_id)
SELECT c.id, c.title, c.completion_count FROM cat c JOIN item_dates d USING (id) LEFT JOIN r USING (id) ORDER BY {SORTS[key]} {way} NULLS LAST, c.title ASC NULLS LAST, c.id LIMIT 41"""

    @register(f"l01_sorted_by_{key}", sql)
    def _(t: Tables) -> DataFrame:
        gone = t.refs.where("NOT available").groupBy(F.col("media_item_id").alias("id")).agg(F.max((F.col("media_item_id") % 97).cast("int")).alias("removed_at"))
        rows = full_catalog(t).join(t.item_dates, "id").join(gone, "id", "left")
        return catalog.page(rows, catalog.sort_order(key, descending), 1, 40).select("id", "title", "completion_count")


for number, sort_key in enumerate(SORTS):
    sorted_page(sort_key, number % 2 == 0)


@register("n06_catalog_deduplicated", f"""{CATALOG}, best AS (SELECT media_item_id, first(provider ORDER BY o, external_id) AS provider, first(external_id ORDER BY o, external_id) AS external_id FROM
  (SELECT *, CASE provider WHEN 'tmdb' THEN 0 WHEN 'tvdb' THEN 1 WHEN 'imdb' THEN 2 ELSE 3 END AS o FROM media_identifiers) GROUP BY media_item_id),
keyed AS (SELECT c.*, concat(c.kind, '~', CASE WHEN b.provider IS NOT NULL THEN concat(b.provider, '~', b.external_id) ELSE concat(lower(trim(c.title)), '~', coalesce(CAST(c.year AS VARCHAR), '')) END) AS key
  FROM cat c LEFT JOIN best b ON b.media_item_id = c.id)
SELECT min(id) AS id, first(title ORDER BY id) AS title, bool_or(on_plex) AS on_plex, bool_or(on_jellyfin) AS on_jellyfin, first(id ORDER BY title ASC NULLS LAST, id) AS placed_by FROM keyed GROUP BY key""")
def _(t: Tables) -> DataFrame:
    return catalog.deduplicated(full_catalog(t), t.identifiers, [F.col("title").asc_nulls_last(), F.col("id").asc()]).select("id", "title", "on_plex", "on_jellyfin", "placed_by")


@register("a05_dashboard", """, w AS (SELECT media_item_id FROM watch_events WHERE completed UNION SELECT media_item_id FROM watch_states WHERE completed)
SELECT kind, count(*) AS total, count(w.media_item_id) AS watched FROM media_items i LEFT JOIN w ON w.media_item_id = i.id GROUP BY kind""")
def _(t: Tables) -> DataFrame:
    return catalog.dashboard(t.items, t.events, t.states)


@register("a06_state_dashboard", """SELECT kind, count(DISTINCT i.id) AS total, count(s.completed) AS states, count(*) FILTER (WHERE s.completed) AS completed_states
FROM media_items i LEFT JOIN watch_states s ON s.media_item_id = i.id GROUP BY kind""")
def _(t: Tables) -> DataFrame:
    return catalog.state_dashboard(t.items, t.states)


@register("a08_container_progress", f"""{STATS}, up AS (SELECT s.completion_count, s.last_completed, unnest([s.parent_id, p.parent_id]) AS container_id
  FROM stats s LEFT JOIN media_items p ON p.id = s.parent_id WHERE s.kind IN ('episode', 'track'))
SELECT container_id, count(*) AS total, count(*) FILTER (WHERE completion_count > 0) AS played, CAST(sum(completion_count) AS BIGINT) AS plays, max(last_completed) AS last_completed
FROM up WHERE container_id IS NOT NULL GROUP BY container_id""")
def _(t: Tables) -> DataFrame:
    return catalog.container_progress(t.items, t.events, t.states)


@register("a09_container_states", """, e AS (SELECT media_item_id, source_id, count(*) AS n, max(watched_at) AS t FROM watch_events WHERE completed GROUP BY ALL),
s AS (SELECT * FROM watch_states),
c AS (SELECT r.source_id, r.library_id, i.parent_id, p.parent_id AS g, greatest(coalesce(e.n, 0), coalesce(s.view_count, 0)) AS plays,
  CASE WHEN e.t IS NULL THEN s.last_watched_at WHEN s.last_watched_at IS NULL THEN e.t ELSE greatest(e.t, s.last_watched_at) END AS last
  FROM source_media_refs r JOIN media_items i ON i.id = r.media_item_id AND i.kind IN ('episode', 'track') JOIN media_items p ON p.id = i.parent_id
  LEFT JOIN e ON e.media_item_id = r.media_item_id AND e.source_id = r.source_id LEFT JOIN s ON s.media_item_id = r.media_item_id AND s.source_id = r.source_id WHERE r.available),
u AS (SELECT source_id, library_id, plays, last, unnest([parent_id, g]) AS media_item_id FROM c)
SELECT media_item_id, source_id, library_id, CAST(greatest(min(plays), 0) AS BIGINT) AS view_count, max(last) AS last_watched_at, min(plays) > 0 AS completed
FROM u WHERE media_item_id IS NOT NULL GROUP BY media_item_id, source_id, library_id""")
def _(t: Tables) -> DataFrame:
    return catalog.container_states(t.items, t.events, t.states, t.refs)


@register("a14_available_refs", "SELECT library_id, count(*) AS refs, count(*) FILTER (WHERE available) AS available FROM source_media_refs GROUP BY library_id")
def _(t: Tables) -> DataFrame:
    return t.refs.groupBy("library_id").agg(F.count("*").alias("refs"), F.count_if("available").alias("available"))


@register("a19_event_counts", "SELECT media_item_id, count(*) AS events FROM watch_events GROUP BY media_item_id")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("media_item_id").agg(F.count("*").alias("events"))


@register("j01_recent_plays", """SELECT e.id, i.title, s.connector_type, e.watched_at FROM watch_events e JOIN media_items i ON i.id = e.media_item_id JOIN src s ON s.id = e.source_id
WHERE e.completed ORDER BY e.watched_at DESC, e.id DESC LIMIT 8""")
def _(t: Tables) -> DataFrame:
    items = t.items.select(F.col("id").alias("media_item_id"), "title")
    kinds = t.sources.select(F.col("id").alias("source_id"), "connector_type")
    recent = t.events.where("completed").join(items, "media_item_id", "left_semi").join(kinds, "source_id", "left_semi").orderBy(F.desc("watched_at"), F.desc("id")).limit(8)
    return recent.join(items, "media_item_id").join(kinds, "source_id").select("id", "title", "connector_type", "watched_at")


@register("j10_shared_availability", f"{FLAGS} SELECT * FROM shared")
def _(t: Tables) -> DataFrame:
    return catalog.shared_availability(t.items, t.identifiers, t.refs, t.sources)


@register("j11_direct_availability", f"{FLAGS} SELECT * FROM direct")
def _(t: Tables) -> DataFrame:
    return catalog.availability(t.refs, t.sources)


@register("j06_genre_filter", "SELECT id, title FROM media_items WHERE id IN (SELECT media_item_id FROM media_genres WHERE normalized_name LIKE 'promo%')")
def _(t: Tables) -> DataFrame:
    chosen = t.genres.where(F.col("normalized_name").startswith("promo")).select(F.col("media_item_id").alias("id"))
    return t.items.join(chosen, "id", "left_semi").select("id", "title")


@register("j07_used_genres", "SELECT DISTINCT normalized_name FROM media_genres WHERE media_item_id IN (SELECT id FROM media_items WHERE kind = 'movie')")
def _(t: Tables) -> DataFrame:
    movies = t.items.where("kind = 'movie'").select(F.col("id").alias("media_item_id"))
    return t.genres.join(movies, "media_item_id", "left_semi").select("normalized_name").distinct()


@register("f01_media", """SELECT id, title FROM media_items i WHERE kind = 'movie' AND year >= 1975 AND EXISTS (SELECT 1 FROM source_media_refs r WHERE r.media_item_id = i.id AND NOT r.available)
AND EXISTS (SELECT 1 FROM watch_states s WHERE s.media_item_id = i.id AND s.completed)""")
def _(t: Tables) -> DataFrame:
    return catalog.media(t.items, t.refs, t.states, kind="movie", available=False, watched=True).where("year >= 1975").select("id", "title")


@register("f01_media_page_of_library", """SELECT id, title FROM media_items i WHERE kind = 'movie' AND title ILIKE '%e%' AND id > 1000020 AND EXISTS (SELECT 1 FROM source_media_refs r WHERE r.media_item_id = i.id AND r.library_id = 8)
ORDER BY id LIMIT 51""")
def _(t: Tables) -> DataFrame:
    return catalog.media(t.items, t.refs, t.states, kind="movie", title="e", library_id=8, after_id=1000020, size=50).select("id", "title")


@register("f02_watch_events", """SELECT e.id, e.watched_at FROM watch_events e WHERE e.completed AND e.source_id = 1 AND e.watched_at >= TIMESTAMP '1994-01-01' AND e.watched_at < TIMESTAMP '1996-01-01'
AND e.media_item_id IN (SELECT id FROM media_items WHERE kind = 'movie') AND e.media_item_id IN (SELECT media_item_id FROM source_media_refs WHERE library_id = 5)""")
def _(t: Tables) -> DataFrame:
    since, until = F.lit("1994-01-01").cast("timestamp_ntz"), F.lit("1996-01-01").cast("timestamp_ntz")
    return catalog.watch_events(t.events, t.items, t.refs, "movie", 1, True, 5, since, until).select("id", "watched_at")


@register("f02_newest_events_of_library", """SELECT id, watched_at FROM watch_events WHERE completed AND id < 100000000000000 AND media_item_id IN (SELECT media_item_id FROM source_media_refs WHERE library_id = 8)
ORDER BY watched_at DESC, id DESC LIMIT 51""")
def _(t: Tables) -> DataFrame:
    return catalog.watch_events(t.events, t.items, t.refs, completed=True, library_id=8, before_id=100000000000000, size=50).select("id", "watched_at")


@register("f03_states_after", "SELECT media_item_id, source_id, view_count, completed FROM watch_states WHERE completed AND media_item_id > 1000100 ORDER BY media_item_id, source_id LIMIT 51")
def _(t: Tables) -> DataFrame:
    rows = t.states.where("completed AND media_item_id > 1000100").orderBy("media_item_id", "source_id").limit(51)
    return rows.select("media_item_id", "source_id", "view_count", "completed")


@register("l04_keyset_page", "SELECT id, watched_at FROM watch_events WHERE watched_at < TIMESTAMP '1995-06-01' OR watched_at = TIMESTAMP '1995-06-01' AND id < 0 ORDER BY watched_at DESC, id DESC LIMIT 51")
def _(t: Tables) -> DataFrame:
    return catalog.after(t.events.select("id", "watched_at"), "watched_at", "id", datetime(1995, 6, 1), 0, 50)


@register("n01_latest_state", "SELECT media_item_id, source_id, last_watched_at FROM watch_states QUALIFY row_number() OVER (PARTITION BY media_item_id ORDER BY last_watched_at DESC NULLS LAST, source_id DESC) = 1")
def _(t: Tables) -> DataFrame:
    return catalog.latest_state(t.states).select("media_item_id", "source_id", "last_watched_at")


@register("n02_canonical_identifier", "SELECT media_item_id, provider, external_id FROM media_identifiers QUALIFY row_number() OVER (PARTITION BY media_item_id ORDER BY CASE provider WHEN 'tmdb' THEN 0 WHEN 'tvdb' THEN 1 ELSE 2 END, external_id) = 1")
def _(t: Tables) -> DataFrame:
    return catalog.canonical_identifier(t.identifiers)


@register("n05_ordered_children", "SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY season_number NULLS LAST, episode_number NULLS LAST, id) AS place FROM media_items WHERE parent_id IS NOT NULL")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("parent_id").orderBy(F.col("season_number").asc_nulls_last(), F.col("episode_number").asc_nulls_last(), "id")
    return t.items.where("parent_id IS NOT NULL").select("id", "parent_id", F.row_number().over(w).cast("bigint").alias("place"))


@register("n07_keep_last", "SELECT event_id, playback_user FROM playback_stream QUALIFY row_number() OVER (PARTITION BY playback_user ORDER BY occurred_at DESC, event_id DESC) <= 20")
def _(t: Tables) -> DataFrame:
    return catalog.keep_last(t.playback, ["playback_user"], [F.desc("occurred_at"), F.desc("event_id")], 20).select("event_id", "playback_user")


@register("r05_media_detail", """, p AS (SELECT id FROM media_items WHERE id % 5 = 0 OR kind <> 'movie'),
c AS (SELECT parent_id AS id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS children FROM media_items GROUP BY parent_id),
d AS (SELECT media_item_id AS id, string_agg(provider || ':' || external_id, ',' ORDER BY provider, external_id) AS identifiers FROM media_identifiers GROUP BY media_item_id),
r AS (SELECT media_item_id AS id, string_agg(concat_ws(':', CAST(source_id AS VARCHAR), CAST(library_id AS VARCHAR), external_id, CAST(available AS VARCHAR)), ',' ORDER BY source_id, library_id, external_id) AS refs FROM source_media_refs GROUP BY media_item_id),
e AS (SELECT media_item_id AS id, count(*) AS n FROM watch_events GROUP BY media_item_id)
SELECT i.id, i.title, c.children, d.identifiers, r.refs, coalesce(e.n, 0) AS known_event_count FROM media_items i JOIN p USING (id) LEFT JOIN c USING (id) LEFT JOIN d USING (id) LEFT JOIN r USING (id) LEFT JOIN e USING (id)""")
def _(t: Tables) -> DataFrame:
    text = lambda c, *f: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[n].cast("string") for n in f])), ",")
    rows = reports.media_detail(t.items.where("id % 5 = 0 OR kind <> 'movie'"), t.items, t.identifiers, t.refs, t.events)
    return rows.select(
        "id", "title", text("children", "child_id").alias("children"), text("identifiers", "provider", "external_id").alias("identifiers"),
        text("references", "source_id", "library_id", "external_id", "available").alias("refs"), "known_event_count",
    )


@register("r06_series_titles", """SELECT i.id, CASE WHEN p.kind = 'show' THEN p.title WHEN g.kind = 'show' THEN g.title END AS series_title
FROM media_items i LEFT JOIN media_items p ON p.id = i.parent_id LEFT JOIN media_items g ON g.id = p.parent_id WHERE i.kind = 'episode'""")
def _(t: Tables) -> DataFrame:
    return catalog.series_titles(t.items)


@register("j13_near_duplicate_fold", """, ev AS (SELECT id, media_item_id, source_id, watched_at, row_number() OVER (PARTITION BY media_item_id ORDER BY watched_at, source_id, id) AS r FROM watch_events WHERE completed),
fold AS (SELECT *, watched_at AS last, true AS kept FROM ev WHERE r = 1 UNION ALL
SELECT e.*, CASE WHEN e.watched_at - f.last > INTERVAL 120 SECOND THEN e.watched_at ELSE f.last END, e.watched_at - f.last > INTERVAL 120 SECOND
FROM fold f JOIN ev e ON e.media_item_id = f.media_item_id AND e.r = f.r + 1)
SELECT id, media_item_id, source_id, watched_at FROM fold WHERE kept""")
def _(t: Tables) -> DataFrame:
    return ledger.without_near_duplicates(t.events)


@register("m14_persisted_events", """, st AS (SELECT * FROM watch_events WHERE id % 2 = 0),
b AS (SELECT id, media_item_id, source_id, watched_at + INTERVAL 1 HOUR AS watched_at, completed FROM watch_events WHERE id % 3 <> 0 AND completed AND media_item_id % 10 <> 0),
cur AS (SELECT * FROM st WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT * FROM b WHERE id IN (SELECT id FROM st)),
far AS (SELECT * FROM b WHERE id NOT IN (SELECT id FROM st) AND NOT EXISTS (SELECT 1 FROM cur c WHERE c.completed AND c.media_item_id = b.media_item_id AND c.watched_at BETWEEN b.watched_at - INTERVAL 120 SECOND AND b.watched_at + INTERVAL 120 SECOND)),
ev AS (SELECT *, row_number() OVER (PARTITION BY media_item_id ORDER BY watched_at, source_id, id) AS r FROM far),
fold AS (SELECT *, watched_at AS last, true AS kept FROM ev WHERE r = 1 UNION ALL
SELECT e.*, CASE WHEN e.watched_at - f.last > INTERVAL 120 SECOND THEN e.watched_at ELSE f.last END, e.watched_at - f.last > INTERVAL 120 SECOND
FROM fold f JOIN ev e ON e.media_item_id = f.media_item_id AND e.r = f.r + 1)
SELECT CAST(id AS VARCHAR) AS source_event_id, media_item_id, source_id, watched_at, completed FROM cur UNION ALL SELECT CAST(id AS VARCHAR), media_item_id, source_id, watched_at, completed FROM fold WHERE kept""")
def _(t: Tables) -> DataFrame:
    extra = {c: F.lit(None).cast(k) for c, k in (("progress_ms", "bigint"), ("duration_ms", "bigint"), ("view_number", "int"), ("playback_user", "string"), ("origin", "string"))}
    rows = t.events.withColumn("source_event_id", F.col("id").cast("string")).withColumns(extra)
    stored = rows.where("id % 2 = 0").withColumn("dedup_key", F.concat(F.lit("old"), F.col("id").cast("string")))
    batch = rows.where("id % 3 <> 0").withColumn("watched_at", F.expr("watched_at + INTERVAL 1 HOUR")).withColumn("media_external_id", F.concat(F.lit("x"), F.col("media_item_id").cast("string")))
    items = t.items.where("id % 10 <> 0").select(F.col("id").alias("media_item_id"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("external_id"))
    refs = items.crossJoin(F.broadcast(t.sources.select(F.col("id").alias("source_id"))))
    events, _ = ledger.persist_events(stored, batch.withColumnRenamed("id", "seq").drop("media_item_id"), refs)
    return events.select("source_event_id", "media_item_id", "source_id", "watched_at", "completed")


@register("a13_refreshed_states", """, n AS (SELECT media_item_id, source_id, count(*) AS n, max(watched_at) AS t FROM watch_events WHERE completed GROUP BY ALL)
SELECT coalesce(s.media_item_id, n.media_item_id) AS media_item_id, coalesce(s.source_id, n.source_id) AS source_id, CAST(greatest(coalesce(s.view_count, n.n), coalesce(n.n, s.view_count)) AS BIGINT) AS view_count,
greatest(coalesce(s.last_watched_at, n.t), coalesce(n.t, s.last_watched_at)) AS last_watched_at, coalesce(s.completed, false) OR n.n IS NOT NULL AS completed
FROM watch_states s FULL JOIN n ON s.media_item_id = n.media_item_id AND s.source_id = n.source_id""")
def _(t: Tables) -> DataFrame:
    return ledger.refresh_states(t.states, t.events)


@register("m11_merged_states", """, nw AS (SELECT media_item_id, source_id, view_count - 1 AS view_count, last_watched_at, completed, progress_ms, observed_at FROM watch_states WHERE media_item_id % 2 = 0)
SELECT o.media_item_id, o.source_id, o.view_count, o.last_watched_at, o.completed, o.progress_ms, n.media_item_id IS NOT NULL AS regressed
FROM watch_states o LEFT JOIN nw n ON o.media_item_id = n.media_item_id AND o.source_id = n.source_id""")
def _(t: Tables) -> DataFrame:
    new = t.states.where("media_item_id % 2 = 0").withColumn("view_count", F.col("view_count") - 1)
    return ledger.merge_states(t.states, new).drop("observed_at")


@register("m13_missing_refs", """SELECT media_item_id, source_id, external_id, library_id, available AND (library_id <> 8 OR media_item_id % 4 <> 0) AS available,
CASE WHEN available AND library_id = 8 AND media_item_id % 4 = 0 THEN TIMESTAMP '2024-01-01' END AS unavailable_since FROM source_media_refs""")
def _(t: Tables) -> DataFrame:
    return ledger.mark_missing(t.refs, t.refs.where("media_item_id % 4 <> 0"), NOW, 8)


@register("a10_shared_identifiers", """, k AS (SELECT DISTINCT i.kind, d.provider, d.external_id, d.media_item_id FROM media_identifiers d JOIN media_items i ON i.id = d.media_item_id)
SELECT kind, provider, external_id, media_item_id, count(*) OVER (PARTITION BY kind, provider, external_id) AS n FROM k QUALIFY n > 1""")
def _(t: Tables) -> DataFrame:
    return merge.shared_identifiers(t.items, t.identifiers)


@register("a06_table_counts", "SELECT (SELECT count(*) FROM src) AS sources, (SELECT count(*) FROM libraries) AS libraries, (SELECT count(*) FROM watch_states WHERE completed) AS completed_states")
def _(t: Tables) -> DataFrame:
    return catalog.table_counts(sources=t.sources, libraries=t.libraries, completed_states=t.states.where("completed"))


@register("a11_without_identifier", """SELECT kind, count(*) AS n FROM media_items WHERE kind IN ('movie', 'show', 'artist', 'album', 'track') AND id IN (SELECT media_item_id FROM source_media_refs)
AND id NOT IN (SELECT media_item_id FROM media_identifiers) GROUP BY kind""")
def _(t: Tables) -> DataFrame:
    own = lambda df: df.select(F.col("media_item_id").alias("id"))
    rows = t.items.where(F.col("kind").isin(*merge.KINDS)).join(own(t.refs), "id", "left_semi").join(own(t.identifiers), "id", "left_anti")
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


COMPONENTS = """, k AS (SELECT DISTINCT d.provider, d.external_id, d.media_item_id AS id FROM media_identifiers d),
edge AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b USING (provider, external_id) WHERE a.id <> b.id),
reach AS (SELECT a AS id, a AS other FROM edge UNION SELECT r.id, e.b FROM reach r JOIN edge e ON e.a = r.other),
grp AS (SELECT id AS media_item_id, min(other) AS group_id FROM reach GROUP BY id)"""


def found_groups(t: Tables) -> DataFrame:
    return merge.groups(t.items, t.identifiers, written, drop=discard)


@register("m23_duplicate_groups", f"{COMPONENTS} SELECT * FROM grp")
def _(t: Tables) -> DataFrame:
    return found_groups(t)


PLAN = f"""{COMPONENTS}, h AS (SELECT DISTINCT media_item_id, source_id FROM source_media_refs),
gh AS (SELECT g.group_id, g.media_item_id, h.source_id FROM grp g LEFT JOIN h USING (media_item_id)),
bad AS (SELECT group_id FROM gh WHERE source_id IS NOT NULL GROUP BY group_id, source_id HAVING count(DISTINCT media_item_id) > 1 UNION SELECT group_id FROM gh WHERE source_id IS NULL),
win AS (SELECT group_id, first(media_item_id ORDER BY lead DESC, media_item_id) AS winner_id FROM
  (SELECT group_id, media_item_id, max(CASE WHEN source_id = 1 THEN 1 ELSE 0 END) AS lead FROM gh GROUP BY group_id, media_item_id) GROUP BY group_id),
plan AS (SELECT g.media_item_id, w.winner_id FROM grp g JOIN win w USING (group_id) WHERE g.media_item_id <> w.winner_id AND g.group_id NOT IN (SELECT group_id FROM bad))"""


@register("m24_merge_plan", f"{PLAN} SELECT * FROM plan")
def _(t: Tables) -> DataFrame:
    return merge.merge_plan(found_groups(t), t.refs, t.sources)


@register("m27_merged_states", f"""{PLAN} SELECT coalesce(p.winner_id, s.media_item_id) AS media_item_id, s.source_id, max(s.view_count) AS view_count, bool_or(s.completed) AS completed, max(s.last_watched_at) AS last_watched_at
FROM watch_states s LEFT JOIN plan p USING (media_item_id) GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    plan = merge.merge_plan(found_groups(t), t.refs, t.sources)
    return merge.remap_states(t.states, plan).drop("observed_at")


@register("m29_propagation", f"""{COMPONENTS}, own AS (SELECT i.id AS media_item_id, coalesce(g.group_id, i.id) AS group_id FROM media_items i LEFT JOIN grp g ON g.media_item_id = i.id WHERE i.kind IN ('movie', 'episode', 'track')),
held AS (SELECT r.media_item_id, r.source_id, min(r.external_id) AS external_id, o.group_id FROM source_media_refs r JOIN own o USING (media_item_id) WHERE r.available GROUP BY ALL),
one AS (SELECT group_id, source_id, min(media_item_id) AS media_item_id, min(external_id) AS external_id FROM held GROUP BY group_id, source_id HAVING count(*) = 1),
done AS (SELECT o.group_id, d.source_id, max(d.t) AS t FROM (SELECT media_item_id, source_id, watched_at AS t FROM watch_events WHERE completed UNION ALL
  SELECT media_item_id, source_id, last_watched_at FROM watch_states WHERE completed) d JOIN own o USING (media_item_id) GROUP BY o.group_id, d.source_id),
side AS (SELECT one.*, done.t FROM one LEFT JOIN done USING (group_id, source_id))
SELECT a.group_id, CASE WHEN a.t IS NULL THEN a.source_id ELSE b.source_id END AS source_id, CASE WHEN a.t IS NULL THEN a.media_item_id ELSE b.media_item_id END AS media_item_id,
CASE WHEN a.t IS NULL THEN a.external_id ELSE b.external_id END AS external_id, coalesce(a.t, b.t) AS watched_at
FROM side a JOIN side b ON a.group_id = b.group_id AND a.source_id = 1 AND b.source_id = 2 WHERE (a.t IS NULL) <> (b.t IS NULL)""")
def _(t: Tables) -> DataFrame:
    return merge.propagation(t.items, t.identifiers, t.refs, t.events.withColumn("playback_user", F.lit("u")), t.states, t.sources, {1: "u", 2: "u"}, written)


# The test tables have no identifiers of episodes, users or null times, so these are derived. The pairs of episodes are (2k, 2k + 1).
@register("m29_propagation_by_user", """, ids AS (SELECT media_item_id, provider, external_id FROM media_identifiers
  UNION ALL SELECT id, CASE WHEN id % 4 < 2 THEN 'tvdb' ELSE 'musicbrainz' END, concat('e', CAST(id // 2 AS VARCHAR)) FROM media_items WHERE kind = 'episode'),
ref AS (SELECT media_item_id, source_id, min(external_id) AS external_id FROM source_media_refs WHERE available GROUP BY ALL),
k AS (SELECT DISTINCT i.kind, d.provider, d.external_id, i.id FROM ids d JOIN media_items i ON i.id = d.media_item_id WHERE d.provider IN ('tmdb', 'tvdb', 'imdb') AND i.kind IN ('movie', 'episode', 'track') AND i.id IN (SELECT media_item_id FROM ref)),
edge AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b USING (kind, provider, external_id) WHERE a.id <> b.id),
reach AS (SELECT a AS id, a AS other FROM edge UNION SELECT r.id, e.b FROM reach r JOIN edge e ON e.a = r.other),
grp AS (SELECT id, min(other) AS group_id FROM reach GROUP BY id),
own AS (SELECT i.id AS media_item_id, coalesce(g.group_id, i.id) AS group_id FROM media_items i LEFT JOIN grp g USING (id) WHERE i.kind IN ('movie', 'episode', 'track') AND i.id IN (SELECT media_item_id FROM ref)),
one AS (SELECT group_id, source_id, min(media_item_id) AS media_item_id, min(external_id) AS external_id FROM ref JOIN own USING (media_item_id) GROUP BY group_id, source_id HAVING count(*) = 1),
st AS (SELECT media_item_id, source_id, CASE WHEN media_item_id % 3 <> 0 THEN last_watched_at END AS last_watched_at, observed_at FROM watch_states WHERE completed AND media_item_id % 11 = 0),
done AS (SELECT o.group_id, d.source_id, max(d.t) AS t FROM (SELECT media_item_id, source_id, watched_at AS t FROM watch_events WHERE completed AND abs(id) % 5 = source_id
  UNION ALL SELECT media_item_id, source_id, coalesce(last_watched_at, observed_at) FROM st) d JOIN own o USING (media_item_id) GROUP BY o.group_id, d.source_id),
side AS (SELECT one.*, done.t FROM one LEFT JOIN done USING (group_id, source_id))
SELECT a.group_id, b.source_id, b.media_item_id, b.external_id, a.t AS watched_at FROM side a JOIN side b ON a.group_id = b.group_id AND a.source_id = 1 AND b.source_id = 2 WHERE a.t IS NOT NULL AND b.t IS NULL""")
def _(t: Tables) -> DataFrame:
    half = F.floor(F.col("id") / 2).cast("string")
    more = t.items.where("kind = 'episode'").select(F.col("id").alias("media_item_id"), F.when(F.col("id") % 4 < 2, "tvdb").otherwise("musicbrainz").alias("provider"), F.concat(F.lit("e"), half).alias("external_id"))
    events = t.events.withColumn("playback_user", (F.abs("id") % 5).cast("string"))
    states = t.states.where("media_item_id % 11 = 0").withColumn("last_watched_at", F.when(F.col("media_item_id") % 3 != 0, F.col("last_watched_at")))
    return merge.propagation(t.items, t.identifiers.unionByName(more), t.refs, events, states, t.sources, {1: "1", 2: "2"}, written, start=1)


@register("q01_duplicate_keys", "SELECT media_item_id, source_id, CAST(watched_at AS TIMESTAMP) AS watched_at, count(*) AS n FROM watch_events GROUP BY ALL HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return quality.duplicates(t.events, ["media_item_id", "source_id", "watched_at"])


@register("q02_orphan_events", "SELECT id, media_item_id FROM watch_events WHERE media_item_id NOT IN (SELECT id FROM media_items WHERE kind = 'movie')")
def _(t: Tables) -> DataFrame:
    return quality.orphans(t.events.select("id", "media_item_id"), "media_item_id", t.items.where("kind = 'movie'"), "id").select("id", "media_item_id")


@register("q03_out_of_domain", """SELECT id, concat_ws(',', CASE WHEN NOT duration_ms >= 600000 THEN 'duration' END, CASE WHEN NOT audience_rating >= 0 THEN 'rating' END) AS reasons
FROM media_items WHERE NOT duration_ms >= 600000 OR NOT audience_rating >= 0""")
def _(t: Tables) -> DataFrame:
    checks = {"duration": F.col("duration_ms") >= 600000, "rating": F.col("audience_rating") >= 0}
    return quality.outside(t.items, checks).select("id", F.array_join("reasons", ",").alias("reasons"))


@register("p_text_and_hash", """SELECT id, lower(regexp_replace(trim(title), '\\s+', ' ', 'g')) AS folded, nullif(trim(title), '') AS cleaned, sha256(concat(kind, '|', CAST(id AS VARCHAR))) AS key,
concat('retired:item:', CAST(id AS VARCHAR), ':', substring(sha256(title), 1, 16)) AS retired FROM media_items""")
def _(t: Tables) -> DataFrame:
    return t.items.select(
        "id", fn.fold(F.col("title")).alias("folded"), fn.clean(F.col("title")).alias("cleaned"), fn.key_hash(F.col("kind"), F.col("id")).alias("key"),
        fn.retired_identity("item", F.col("id"), F.col("title")).alias("retired"),
    )


@register("p_numbers_and_times", """SELECT event_id, CAST(floor(event_id * 7919 / 10000) AS BIGINT) AS ms, CAST(least(floor(progress_percent * 100 / 37), 100) AS INTEGER) AS percent,
strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS utc, CAST(least(3600, 15 * pow(2, least(event_id % 12, 8))) AS INTEGER) AS delay FROM playback_stream""")
def _(t: Tables) -> DataFrame:
    return t.playback.select(
        "event_id", fn.ticks_to_ms(F.col("event_id") * 7919).alias("ms"), fn.percent(F.col("progress_percent"), F.lit(37)).alias("percent"),
        fn.utc_text(F.col("occurred_at")).alias("utc"), fn.retry_delay(F.col("event_id") % 12 + 1).alias("delay"),
    )


@register("w02_completions", """SELECT event_id, source_id, external_id FROM playback_stream WHERE external_id IS NOT NULL AND event_type IS NOT NULL
AND (event_type = 'media.scrobble' OR event_type = 'media.stop' AND coalesce(progress_percent, 0) >= 90)""")
def _(t: Tables) -> DataFrame:
    return playback.completed(t.playback).where("completed").select("event_id", "source_id", "external_id")


#: The state machine row by row: what each step closes (x1 a stale play, x2 what the notification ends), and what is open at the end.
NOW_PLAYING = """, ev AS (SELECT source_id, playback_user, external_id AS x, event_type AS k, progress_percent AS p, epoch_us(occurred_at) AS t,
  event_type = 'media.scrobble' OR event_type = 'media.stop' AND coalesce(progress_percent, 0) >= 90 AS done, event_type IN ('media.play', 'media.resume') AS plays,
  row_number() OVER (PARTITION BY source_id, playback_user ORDER BY occurred_at, event_id) AS r FROM playback_stream WHERE event_type IS NOT NULL AND external_id IS NOT NULL),
st AS (SELECT source_id, playback_user, CAST(0 AS BIGINT) AS r, CAST(NULL AS VARCHAR) AS item, CAST(0 AS BIGINT) AS s, CAST(NULL AS INTEGER) AS prog,
  CAST(NULL AS STRUCT(x VARCHAR, s BIGINT, e BIGINT, p INTEGER, d BOOLEAN, w VARCHAR)) AS x1, CAST(NULL AS STRUCT(x VARCHAR, s BIGINT, e BIGINT, p INTEGER, d BOOLEAN, w VARCHAR)) AS x2 FROM ev WHERE r = 1
UNION ALL SELECT e.source_id, e.playback_user, e.r,
  CASE WHEN e.plays THEN e.x WHEN f.item IS NULL OR e.t - f.s > 3600000000 OR f.item = e.x THEN NULL ELSE f.item END,
  CASE WHEN e.plays AND (f.item IS NULL OR e.t - f.s > 3600000000 OR f.item <> e.x) THEN e.t ELSE f.s END, CASE WHEN e.plays THEN e.p ELSE f.prog END,
  CASE WHEN f.item IS NOT NULL AND e.t - f.s > 3600000000 THEN {'x': f.item, 's': f.s, 'e': f.s + 3600000000, 'p': f.prog, 'd': false, 'w': 'stale'} END,
  CASE WHEN e.plays AND f.item IS NOT NULL AND e.t - f.s <= 3600000000 AND f.item <> e.x THEN {'x': f.item, 's': f.s, 'e': e.t, 'p': f.prog, 'd': false, 'w': 'other'}
       WHEN NOT e.plays AND f.item = e.x AND e.t - f.s <= 3600000000 THEN {'x': f.item, 's': f.s, 'e': e.t, 'p': e.p, 'd': e.done, 'w': e.k}
       WHEN e.k IN ('media.stop', 'media.scrobble') THEN {'x': e.x, 's': e.t, 'e': e.t, 'p': e.p, 'd': e.done, 'w': e.k} END
FROM st f JOIN ev e ON e.source_id = f.source_id AND e.playback_user = f.playback_user AND e.r = f.r + 1),
closed AS (SELECT source_id, playback_user, x1 AS c FROM st WHERE x1 IS NOT NULL UNION ALL SELECT source_id, playback_user, x2 FROM st WHERE x2 IS NOT NULL
  UNION ALL SELECT source_id, playback_user, {'x': item, 's': s, 'e': NULL, 'p': prog, 'd': false, 'w': 'open'} FROM st
  WHERE item IS NOT NULL AND (source_id, playback_user, r) IN (SELECT source_id, playback_user, max(r) FROM ev GROUP BY source_id, playback_user))
SELECT source_id, playback_user, c.x AS external_id, c.s AS started_at, c.e AS ended_at, c.p AS progress_percent, c.d AS completed, c.w AS closed_by FROM closed"""


@register("w03_now_playing", NOW_PLAYING)
def _(t: Tables) -> DataFrame:
    return playback.sessions(t.playback)
