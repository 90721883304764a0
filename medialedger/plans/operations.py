"""Queries over the test tables for reports, matching, ingest and enrichment, each with the SQL that must give the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialedger import functions as fn
from medialedger import quality
from medialedger.adapters import Tables
from medialedger.identity import matching, merge
from medialedger.operators import catalog, enrichment, ingest, ledger, reports
from medialedger.plans.registry import NOW, register


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


@register("f04_libraries", "SELECT id, name FROM libraries WHERE source_id = 1 AND enabled AND available")
def _(t: Tables) -> DataFrame:
    return reports.matching(t.libraries, source_id=1, enabled=True, available=True).select("id", "name")


@register("f05_runs", "SELECT id, job_id, created_at FROM runs WHERE source_id = 2 AND status = 'succeeded' AND created_at >= TIMESTAMP '1995-01-01' AND created_at < TIMESTAMP '1996-01-01' ORDER BY created_at DESC, id DESC LIMIT 51")
def _(t: Tables) -> DataFrame:
    rows = reports.matching(t.runs, ntz("1995-01-01"), ntz("1996-01-01"), source_id=2, status="succeeded")
    return catalog.page(rows, [F.desc("created_at"), F.desc("id")], 1, 50).select("id", "job_id", "created_at")


@register("f05_active_run", "SELECT id, status FROM runs WHERE status IN ('queued', 'running') ORDER BY created_at DESC, id DESC LIMIT 1")
def _(t: Tables) -> DataFrame:
    return reports.active_run(t.runs).select("id", "status")


@register("n03_latest_run", "SELECT job_id, id, status, created_at FROM runs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) = 1")
def _(t: Tables) -> DataFrame:
    return reports.latest_per(t.runs, ["job_id"]).select("job_id", "id", "status", "created_at")


@register("n07_runs_kept_per_job", "SELECT id, job_id FROM runs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) <= 20")
def _(t: Tables) -> DataFrame:
    return catalog.keep_last(t.runs, ["job_id"], [F.desc("created_at"), F.desc("id")], 20).select("id", "job_id")


@register("n10_finished_since", """SELECT j.id, (SELECT r.id FROM runs r WHERE r.source_id = j.source_id AND r.status = 'succeeded' AND r.created_at >= j.created_at ORDER BY r.created_at DESC, r.id DESC LIMIT 1) AS run_id
FROM runs j WHERE j.status = 'queued'""")
def _(t: Tables) -> DataFrame:
    return reports.finished_since(t.runs.where("status = 'queued'"), t.runs.where("status = 'succeeded'")).select("id", "run_id")


STATS = """, e AS (SELECT media_item_id AS id, max(watched_at) AS e, count(*) AS n FROM watch_events WHERE completed GROUP BY media_item_id),
s AS (SELECT media_item_id AS id, max(last_watched_at) AS s, max(view_count) AS c FROM watch_states WHERE completed GROUP BY media_item_id)"""


@register("a07_children_progress", f"""{STATS} SELECT i.id, i.parent_id, CAST(greatest(coalesce(e.n, 0), coalesce(s.c, 0)) AS BIGINT) AS completion_count, coalesce(e.e, s.s) AS last_completed
FROM media_items i LEFT JOIN e USING (id) LEFT JOIN s USING (id) WHERE i.parent_id IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    return reports.children_progress(t.items, t.events, t.states)


@register("j12_child_availability", """, f AS (SELECT media_item_id AS id, bool_or(source_id = 1) AS p, bool_or(source_id = 2) AS j FROM source_media_refs WHERE available GROUP BY media_item_id)
SELECT i.id, i.parent_id, coalesce(f.p, false) AS on_plex, coalesce(f.j, false) AS on_jellyfin FROM media_items i LEFT JOIN f USING (id) WHERE i.parent_id IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    return reports.child_availability(t.items, t.refs, t.sources)


@register("j02_item_references", """SELECT r.media_item_id, r.external_id, s.connector_type, l.name AS library FROM source_media_refs r JOIN src s ON s.id = r.source_id
JOIN libraries l ON l.id = r.library_id""")
def _(t: Tables) -> DataFrame:
    return reports.item_references(t.refs, t.sources, t.libraries).select("media_item_id", "external_id", "connector_type", "library")


@register("n04_recent_by_item", """, p AS (SELECT id FROM media_items WHERE kind = 'movie' ORDER BY title, id LIMIT 50)
SELECT media_item_id, id, watched_at, row_number() OVER (PARTITION BY media_item_id ORDER BY watched_at DESC, id DESC) AS place FROM watch_events WHERE media_item_id IN (SELECT id FROM p)""")
def _(t: Tables) -> DataFrame:
    page = t.items.where("kind = 'movie'").orderBy("title", "id").limit(50)
    return reports.recent_by_item(t.events, page).select("media_item_id", "id", "watched_at", "place")


@register("r01_media_summary", """, p AS (SELECT media_item_id AS id, bool_or(available) AS a FROM source_media_refs GROUP BY media_item_id),
l AS (SELECT media_item_id AS id, source_id, view_count, last_watched_at FROM watch_states QUALIFY row_number() OVER (PARTITION BY media_item_id ORDER BY last_watched_at DESC NULLS LAST, source_id DESC) = 1)
SELECT i.id, i.kind, i.title, coalesce(p.a, false) AS available, l.source_id AS state_source, l.view_count AS state_count, l.last_watched_at AS state_last FROM media_items i LEFT JOIN p USING (id) LEFT JOIN l USING (id)""")
def _(t: Tables) -> DataFrame:
    state = [F.col(f"watch_state.{c}").alias(a) for c, a in (("source_id", "state_source"), ("view_count", "state_count"), ("last_watched_at", "state_last"))]
    return reports.media_summary(t.items, t.refs, t.states).select("id", "kind", "title", "available", *state)


@register("r03_event_rows", "SELECT id, media_item_id, source_id, strftime(watched_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS watched_at, completed FROM watch_events")
def _(t: Tables) -> DataFrame:
    return reports.event_rows(t.events)


@register("r04_top_errors", """SELECT id, CASE WHEN duration_ms < 600000 THEN 'invalid' ELSE 'regression' END AS category FROM media_items WHERE duration_ms < 600000 OR audience_rating < 0
ORDER BY CASE WHEN duration_ms < 600000 THEN 0 ELSE 1 END, id LIMIT 100""")
def _(t: Tables) -> DataFrame:
    bad = quality.outside(t.items, {"duration": F.col("duration_ms") >= 600000, "rating": F.col("audience_rating") >= 0})
    return reports.top_errors(bad.select("id", F.when(F.array_contains("reasons", "duration"), "invalid").otherwise("regression").alias("category")))


@register("a18_identifier_report", """, d AS (SELECT DISTINCT provider, external_id, media_item_id FROM media_identifiers), n AS (SELECT provider, external_id, count(*) AS n FROM d GROUP BY ALL HAVING count(*) > 1)
SELECT d.provider, d.external_id, n.n, concat_ws(':', CAST(i.id AS VARCHAR), i.kind, i.title) AS media FROM d JOIN n USING (provider, external_id) JOIN media_items i ON i.id = d.media_item_id""")
def _(t: Tables) -> DataFrame:
    return reports.cross_kind_identifiers(t.items, t.identifiers)


@register("a21_history_only_lookalikes", """, k AS (SELECT i.id, i.kind, lower(trim(i.title)) AS title_key, i.year, i.id IN (SELECT media_item_id FROM source_media_refs) AS held FROM media_items i WHERE title IS NOT NULL)
SELECT a.id, a.kind, a.title_key, count(*) AS candidates, min(b.id) AS first_candidate FROM k a JOIN k b ON a.kind = b.kind AND a.title_key = b.title_key AND a.year IS NOT DISTINCT FROM b.year
WHERE NOT a.held AND b.held GROUP BY a.id, a.kind, a.title_key""")
def _(t: Tables) -> DataFrame:
    return reports.history_only_lookalikes(t.items, t.refs)


@register("l02_removed_order", "SELECT media_item_id, max(CASE WHEN available AND media_item_id % 4 = 0 AND library_id = 8 THEN TIMESTAMP '2024-01-01' END) AS removed_at FROM source_media_refs GROUP BY media_item_id")
def _(t: Tables) -> DataFrame:
    return reports.removed_at(ledger.mark_missing(t.refs, t.refs.where("media_item_id % 4 <> 0"), NOW, 8))


def classified(t: Tables) -> DataFrame:
    """Items as a batch against stored references whose hashes are of other titles for some, and missing for others.

    Ids of large tables can be those of several items; each reference then still is one row of the batch.
    """
    named = t.items.groupBy(F.col("id").alias("media_item_id")).agg(F.min(F.struct("kind", "title")).alias("i")).select("media_item_id", "i.*")
    batch = t.refs.join(named, "media_item_id")
    before = batch.withColumn("title", F.when(F.col("media_item_id") % 7 == 0, F.concat("title", F.lit("*"))).otherwise(F.col("title")))
    stored = ledger.classify(before, before.select("source_id", "external_id").withColumn("raw_hash", F.lit("")), ["kind", "title"]).where("media_item_id % 11 <> 0")
    return ledger.classify(batch, stored, ["kind", "title"])


@register("m01_classify", "SELECT source_id, external_id, CASE WHEN media_item_id % 11 = 0 THEN 'inserted' WHEN media_item_id % 7 = 0 THEN 'updated' ELSE 'unchanged' END AS classification FROM source_media_refs")
def _(t: Tables) -> DataFrame:
    return classified(t).select("source_id", "external_id", "classification")


@register("a15_run_counters", """SELECT count(*) AS total, count(*) FILTER (WHERE media_item_id % 11 = 0) AS inserted, count(*) FILTER (WHERE media_item_id % 11 <> 0 AND media_item_id % 7 = 0) AS updated,
count(*) FILTER (WHERE media_item_id % 11 <> 0 AND media_item_id % 7 <> 0) AS unchanged FROM source_media_refs""")
def _(t: Tables) -> DataFrame:
    return reports.counters(classified(t), "classification", ["inserted", "updated", "unchanged"])


def staged_ids(t: Tables) -> DataFrame:
    return t.staged.where("item_id % 3 <> 0").select("source_id", "external_id", F.lit("tmdb").alias("provider"), "identifier")


BY_ID = """, own AS (SELECT s.source_id, s.external_id, d.media_item_id FROM staged s JOIN media_identifiers d ON d.provider = 'tmdb' AND d.external_id = s.identifier
JOIN media_items i ON i.id = d.media_item_id AND i.kind = s.kind WHERE s.item_id % 3 <> 0),
by_id AS (SELECT source_id, external_id, count(DISTINCT media_item_id) = 1 AS single, CASE WHEN count(DISTINCT media_item_id) = 1 THEN min(media_item_id) END AS media_item_id FROM own GROUP BY ALL)"""
BY_TITLE = """, tt AS (SELECT s.source_id, s.external_id, i.id FROM staged s JOIN media_items i ON i.kind = 'movie' AND s.kind = 'movie' AND lower(trim(i.title)) = lower(trim(s.title))
AND i.year IS NOT DISTINCT FROM s.year JOIN source_media_refs r ON r.media_item_id = i.id AND r.source_id <> s.source_id),
by_title AS (SELECT source_id, external_id, min(id) AS media_item_id FROM tt GROUP BY source_id, external_id HAVING count(DISTINCT id) = 1)"""


@register("j15_match_by_identifier", f"{BY_ID} SELECT * FROM by_id")
def _(t: Tables) -> DataFrame:
    return matching.by_identifier(t.staged, staged_ids(t), t.items, t.identifiers, t.refs)


@register("j14_match_by_title", f"{BY_TITLE} SELECT * FROM by_title")
def _(t: Tables) -> DataFrame:
    return matching.by_title_and_year(t.staged, t.items, t.refs)


@register("m02_resolve", f"""{BY_ID}{BY_TITLE} SELECT s.source_id, s.external_id, CASE WHEN b.single IS NULL AND t.media_item_id IS NOT NULL THEN 'matched' WHEN b.single IS NULL THEN 'new'
WHEN NOT b.single THEN 'ambiguous' ELSE 'matched' END AS match_status, CASE WHEN b.single IS NULL THEN t.media_item_id ELSE b.media_item_id END AS media_item_id
FROM staged s LEFT JOIN by_id b USING (source_id, external_id) LEFT JOIN by_title t USING (source_id, external_id)""")
def _(t: Tables) -> DataFrame:
    staged = t.staged.withColumn("season_external_id", F.lit(None).cast("string"))
    return matching.resolve(staged, staged_ids(t), t.items, t.identifiers, t.refs).select("source_id", "external_id", "match_status", "media_item_id")


@register("m03_compatible_episodes", """SELECT s.external_id, e.id AS media_item_id FROM staged s JOIN media_items e ON e.id = s.item_id AND e.kind = 'episode' JOIN media_items p ON p.id = e.parent_id AND p.kind = 'season'
JOIN media_items g ON g.id = p.parent_id AND g.kind = 'show' WHERE p.season_number = s.season_number""")
def _(t: Tables) -> DataFrame:
    rows = t.staged.where("kind = 'episode'").select("source_id", "external_id", F.col("item_id").alias("media_item_id"), "season_number", "show_external_id", F.lit(None).cast("string").alias("season_external_id"))
    return matching.compatible_episodes(rows, t.items, t.refs).select("external_id", "media_item_id")


@register("j09_ancestors", "SELECT e.id, s.id AS season_id, h.id AS show_id FROM media_items e JOIN media_items s ON s.id = e.parent_id AND s.kind = 'season' JOIN media_items h ON h.id = s.parent_id AND h.kind = 'show' WHERE e.kind = 'episode'")
def _(t: Tables) -> DataFrame:
    return matching.ancestors(t.items)


@register("j17_arrived", """, p AS (SELECT event_id, source_id, concat(CASE source_id WHEN 1 THEN 'p' ELSE 'j' END, CAST(1000000 + event_id % 3000 AS VARCHAR)) AS external_id FROM playback_stream WHERE event_type = 'media.scrobble')
SELECT p.event_id, r.media_item_id FROM p JOIN source_media_refs r USING (source_id, external_id)""")
def _(t: Tables) -> DataFrame:
    name = F.concat(F.when(F.col("source_id") == 1, "p").otherwise("j"), (1000000 + F.col("event_id") % 3000).cast("string"))
    pending = t.playback.where("event_type = 'media.scrobble'").select("event_id", "source_id", name.alias("external_id"))
    return matching.arrived(pending, t.refs).select("event_id", "media_item_id")


@register("j19_targets", """SELECT e.media_item_id, e.source_id, min(r.source_id) AS target_source, min(r.external_id) AS target_external FROM (SELECT DISTINCT media_item_id, source_id FROM watch_events WHERE completed) e
JOIN source_media_refs r ON r.media_item_id = e.media_item_id AND r.source_id <> e.source_id AND r.available AND r.source_id = 2 GROUP BY e.media_item_id, e.source_id HAVING count(*) = 1""")
def _(t: Tables) -> DataFrame:
    return matching.target_of(t.events.where("completed"), t.refs, t.sources.withColumn("enabled", F.col("id") == 2))


@register("m25_hierarchy_merge", """, lost AS (SELECT id AS season_id, season_number FROM media_items WHERE kind = 'season' AND parent_id <> 2000000),
own AS (SELECT season_number % 7 AS k, count(*) AS n, min(id) AS match FROM media_items WHERE kind = 'season' AND parent_id = 2000000 GROUP BY 1)
SELECT season_id, CASE WHEN own.n = 1 THEN own.match ELSE 2000000 END AS target_id, CASE WHEN own.n = 1 THEN 'merge' ELSE 'reparent' END AS action FROM lost LEFT JOIN own ON own.k = lost.season_number % 7""")
def _(t: Tables) -> DataFrame:
    shows = t.items.where("kind = 'show' AND id <> 2000000").select(F.col("id").alias("media_item_id"), F.lit(2000000).cast("bigint").alias("winner_id"))
    return matching.hierarchy_merge(t.items.withColumn("season_number", F.col("season_number") % 7), shows)


@register("m28_filled_items", """, plan AS (SELECT id AS media_item_id, id - 1 AS winner_id FROM media_items WHERE kind = 'movie' AND id % 2 = 1),
masked AS (SELECT id, CASE WHEN id % 4 <> 0 THEN year END AS year, CASE WHEN id % 3 <> 0 THEN duration_ms END AS duration_ms FROM media_items WHERE kind = 'movie')
SELECT w.id, coalesce(w.year, l.year) AS year, coalesce(w.duration_ms, l.duration_ms) AS duration_ms FROM masked w LEFT JOIN plan p ON p.winner_id = w.id LEFT JOIN masked l ON l.id = p.media_item_id WHERE w.id NOT IN (SELECT media_item_id FROM plan)""")
def _(t: Tables) -> DataFrame:
    movies = t.items.where("kind = 'movie'").select("id", F.when(F.col("id") % 4 != 0, F.col("year")).alias("year"), F.when(F.col("id") % 3 != 0, F.col("duration_ms")).alias("duration_ms"))
    plan = movies.where("id % 2 = 1").select(F.col("id").alias("media_item_id"), (F.col("id") - 1).alias("winner_id"))
    return matching.fill_missing(movies, plan, ["year", "duration_ms"])


@register("m26_remapped_genres", """, plan AS (SELECT id AS media_item_id, id - 1 AS winner_id FROM media_items WHERE kind = 'movie' AND id % 2 = 1)
SELECT DISTINCT coalesce(p.winner_id, g.media_item_id) AS media_item_id, g.normalized_name FROM media_genres g LEFT JOIN plan p USING (media_item_id)""")
def _(t: Tables) -> DataFrame:
    plan = t.items.where("kind = 'movie' AND id % 2 = 1").select(F.col("id").alias("media_item_id"), (F.col("id") - 1).alias("winner_id"))
    return merge.remap(t.genres, plan, ["media_item_id", "normalized_name"]).select("media_item_id", "normalized_name")


CONTAINERS = """, e AS (SELECT * FROM staged WHERE kind = 'episode'), box AS (
SELECT source_id, show_external_id AS external_id, 'show' AS kind, min(show_title) AS title, CAST(NULL AS VARCHAR) AS parent_external_id, CAST(NULL AS INTEGER) AS number FROM e GROUP BY 1, 2
UNION ALL SELECT source_id, concat_ws(':', show_external_id, 'season', CAST(season_number AS VARCHAR)), 'season', min(concat('Season ', CAST(season_number AS VARCHAR))), show_external_id, season_number FROM e GROUP BY source_id, show_external_id, season_number)"""


def full_staged(t: Tables) -> DataFrame:
    nothing = [F.lit(None).cast("string").alias(c) for c in ("season_external_id", "artist_external_id", "artist_title", "album_external_id", "album_title")]
    return t.staged.select("*", *nothing)


@register("m04_containers", f"{CONTAINERS} SELECT * FROM box")
def _(t: Tables) -> DataFrame:
    return ingest.containers(full_staged(t))


@register("u03_seen_ids", f"{CONTAINERS} SELECT source_id, external_id FROM staged UNION SELECT source_id, external_id FROM box")
def _(t: Tables) -> DataFrame:
    return ingest.seen_ids(full_staged(t))


PRECEDENCE = ", f AS (SELECT *, source_id = 1 OR item_id NOT IN (SELECT media_item_id FROM source_media_refs WHERE source_id = 1) AS may_update FROM staged)"


def allowed(t: Tables) -> DataFrame:
    return ingest.may_update(t.staged.withColumnRenamed("item_id", "media_item_id"), t.refs, t.sources)


@register("m07_source_precedence", f"{PRECEDENCE} SELECT source_id, external_id, may_update FROM f")
def _(t: Tables) -> DataFrame:
    return allowed(t).select("source_id", "external_id", "may_update")


@register("m08_applied_fields", f"{PRECEDENCE} SELECT i.id, CASE WHEN f.may_update THEN upper(f.title) ELSE i.title END AS title, CASE WHEN f.may_update THEN f.year + 1 ELSE i.year END AS year FROM media_items i LEFT JOIN f ON f.item_id = i.id")
def _(t: Tables) -> DataFrame:
    new = allowed(t).withColumn("title", F.upper("title")).withColumn("year", F.col("year") + 1)
    return ingest.apply_fields(t.items, new, ["title", "year"]).select("id", "title", "year")


def staged_genres(t: Tables) -> DataFrame:
    return t.staged.where("item_id % 2 = 0").select(F.col("item_id").alias("media_item_id"), F.array(F.concat(F.lit(" New  "), "genre")).alias("genres"))


@register("m09_replaced_genres", "SELECT media_item_id, normalized_name FROM media_genres WHERE media_item_id % 2 <> 0 UNION ALL SELECT item_id, concat('new ', lower(genre)) FROM staged WHERE item_id % 2 = 0")
def _(t: Tables) -> DataFrame:
    return ingest.replace_genres(t.genres, staged_genres(t))


@register("m09_merged_genres", "SELECT media_item_id, normalized_name FROM media_genres UNION SELECT item_id, concat('new ', lower(genre)) FROM staged WHERE item_id % 2 = 0")
def _(t: Tables) -> DataFrame:
    return ingest.merge_genres(t.genres, staged_genres(t))


IMAGES = """, img AS (SELECT media_item_id, 'poster' AS image_type, source_id, CASE source_id WHEN 1 THEN 'plex' ELSE 'jellyfin' END AS provider, external_id AS source_path,
CASE WHEN media_item_id % 4 = 0 THEN 'pending' ELSE 'cached' END AS cache_status FROM source_media_refs QUALIFY row_number() OVER (PARTITION BY media_item_id ORDER BY source_id) = 1)"""


def images(t: Tables) -> DataFrame:
    first = t.refs.groupBy("media_item_id").agg(F.min_by(F.struct("source_id", "external_id"), "source_id").alias("r"))
    return first.select(
        "media_item_id", F.lit("poster").alias("image_type"), "r.source_id", F.when(F.col("r.source_id") == 1, "plex").otherwise("jellyfin").alias("provider"),
        F.col("r.external_id").alias("source_path"), F.when(F.col("media_item_id") % 4 == 0, "pending").otherwise("cached").alias("cache_status"),
    )


@register("m10_merged_images", f"""{IMAGES}, n AS (SELECT item_id AS media_item_id, CASE WHEN item_id % 5 <> 0 THEN concat('p', CAST(item_id AS VARCHAR)) END AS source_path, source_id, CASE source_id WHEN 1 THEN 'plex' ELSE 'jellyfin' END AS provider FROM staged),
b AS (SELECT coalesce(o.media_item_id, n.media_item_id) AS media_item_id, o.source_path AS op, o.provider AS oq, o.cache_status AS oc, n.source_path AS np, n.provider AS nq FROM img o FULL JOIN (SELECT * FROM n WHERE source_path IS NOT NULL) n ON n.media_item_id = o.media_item_id)
SELECT media_item_id, CASE WHEN nq IS NULL OR (oq = 'plex' AND nq <> 'plex') OR (op = np AND oq = nq) THEN op ELSE np END AS source_path,
CASE WHEN nq IS NULL OR (oq = 'plex' AND nq <> 'plex') OR (op = np AND oq = nq) THEN oc ELSE 'pending' END AS cache_status FROM b""")
def _(t: Tables) -> DataFrame:
    path = F.when(F.col("item_id") % 5 != 0, F.concat(F.lit("p"), F.col("item_id").cast("string")))
    new = t.staged.select(F.col("item_id").alias("media_item_id"), F.lit("poster").alias("image_type"), "source_id", F.when(F.col("source_id") == 1, "plex").otherwise("jellyfin").alias("provider"), path.alias("source_path"))
    return ingest.merge_images(images(t), new).select("media_item_id", "source_path", "cache_status")


@register("j23_images_to_drop", f"{IMAGES} SELECT media_item_id FROM img WHERE cache_status <> 'cached' AND media_item_id NOT IN (SELECT media_item_id FROM source_media_refs WHERE available)")
def _(t: Tables) -> DataFrame:
    return reports.stale_images(images(t), t.refs)[0].select("media_item_id")


@register("m12_implied_events", """SELECT source_id, CAST(media_item_id AS VARCHAR) AS media_external_id, concat('state:', CAST(media_item_id AS VARCHAR), ':', strftime(last_watched_at, '%Y-%m-%dT%H:%M:%S')) AS source_event_id,
last_watched_at AS watched_at, true AS completed FROM watch_states WHERE view_count > 0 AND last_watched_at IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    return ingest.implied_events(t.states.select("source_id", F.col("media_item_id").cast("string").alias("external_id"), "view_count", F.col("last_watched_at").alias("last_viewed_at")))


@register("m20_discovered", """, n AS (SELECT source_id, concat(external_id, CASE WHEN id % 6 = 0 THEN 'x' ELSE '' END) AS external_id, upper(name) AS name, media_type FROM libraries WHERE id % 7 <> 0)
SELECT coalesce(l.source_id, n.source_id) AS source_id, coalesce(l.external_id, n.external_id) AS external_id, coalesce(n.name, l.name) AS name, coalesce(n.media_type, l.media_type) AS media_type,
coalesce(l.enabled, false) AS enabled, n.name IS NOT NULL AS available FROM libraries l FULL JOIN n ON n.source_id = l.source_id AND n.external_id = l.external_id""")
def _(t: Tables) -> DataFrame:
    found = t.libraries.where("id % 7 <> 0").withColumn("external_id", F.concat("external_id", F.when(F.col("id") % 6 == 0, "x").otherwise(""))).withColumn("name", F.upper("name"))
    return ingest.discover(t.libraries, found)


@register("m21_retired_refs", """SELECT media_item_id, source_id, CASE WHEN source_id = 2 THEN concat('retired:media:', CAST(media_item_id AS VARCHAR), ':', substring(sha256(external_id), 1, 16)) ELSE external_id END AS external_id,
library_id, source_id <> 2 AND available AS available, CASE WHEN source_id = 2 THEN TIMESTAMP '2024-01-01' END AS unavailable_since FROM source_media_refs""")
def _(t: Tables) -> DataFrame:
    return ingest.retire_source(t.refs, 2, NOW)


@register("m22_states_without_source", "SELECT media_item_id, source_id FROM watch_states WHERE source_id <> 2")
def _(t: Tables) -> DataFrame:
    return ingest.without_source(t.states, 2).select("media_item_id", "source_id")


@register("m30_applied_propagation", """, n AS (SELECT item_id AS media_item_id, source_id, TIMESTAMP '2024-01-01' AS t FROM staged WHERE item_id % 3 = 0)
SELECT coalesce(s.media_item_id, n.media_item_id) AS media_item_id, coalesce(s.source_id, n.source_id) AS source_id, CAST(CASE WHEN n.t IS NULL THEN s.view_count ELSE greatest(coalesce(s.view_count, 0), 1) END AS BIGINT) AS view_count,
coalesce(n.t, s.last_watched_at) AS last_watched_at, n.t IS NOT NULL OR s.completed AS completed, CASE WHEN n.t IS NULL THEN s.progress_ms END AS progress_ms
FROM watch_states s FULL JOIN n ON n.media_item_id = s.media_item_id AND n.source_id = s.source_id""")
def _(t: Tables) -> DataFrame:
    sent = t.staged.where("item_id % 3 = 0").select(F.col("item_id").alias("media_item_id"), "source_id", ntz("2024-01-01").alias("watched_at"))
    return ingest.apply_propagation(t.states, sent)


@register("m31_imported_plays", "SELECT media_item_id, concat('trakt:', CAST(id AS VARCHAR)) AS source_event_id, watched_at FROM watch_events WHERE completed AND id % 2 = 0")
def _(t: Tables) -> DataFrame:
    plays = t.events.where("completed")
    return ingest.import_plays(plays.where("id % 2 <> 0").select(F.concat(F.lit("trakt:"), F.col("id").cast("string")).alias("source_event_id")), plays).select("media_item_id", "source_event_id", "watched_at")


@register("m32_history_containers", """, e AS (SELECT * FROM staged WHERE kind = 'episode')
SELECT 'movie' AS kind, identifier AS show_key, CAST(NULL AS INTEGER) AS season, CAST(NULL AS INTEGER) AS number, min(title) AS title FROM staged WHERE kind = 'movie' GROUP BY identifier
UNION ALL SELECT 'show', show_external_id, NULL, NULL, min(show_title) FROM e GROUP BY show_external_id
UNION ALL SELECT 'season', show_external_id, season_number, NULL, concat('Season ', CAST(season_number AS VARCHAR)) FROM e GROUP BY show_external_id, season_number
UNION ALL SELECT 'episode', show_external_id, season_number, CAST(item_id % 50 AS INTEGER), min(title) FROM e GROUP BY show_external_id, season_number, item_id % 50""")
def _(t: Tables) -> DataFrame:
    key = F.when(F.col("kind") == "movie", F.col("identifier")).otherwise(F.col("show_external_id"))
    return ingest.history_containers(t.staged.select("kind", key.alias("key"), F.col("season_number").alias("season"), (F.col("item_id") % 50).alias("number"), "title", "show_title"))


RECORDS = """, rec AS (SELECT media_item_id, provider, CASE media_item_id % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' ELSE 'not_found' END AS status, CAST(media_item_id % 3 AS INTEGER) AS attempts FROM media_identifiers WHERE media_item_id % 5 <> 0),
m AS (SELECT id, CASE WHEN id % 2 = 0 THEN year END AS year, CASE WHEN id % 3 <> 0 THEN duration_ms END AS duration_ms FROM media_items WHERE kind = 'movie'),
cand AS (SELECT d.*, rec.attempts FROM media_identifiers d JOIN m ON m.id = d.media_item_id AND (m.year IS NULL OR m.duration_ms IS NULL) LEFT JOIN rec USING (media_item_id, provider) WHERE rec.status IS NULL OR rec.status = 'failed'),
ans AS (SELECT provider, external_id, CAST(max(media_item_id) % 90 AS INTEGER) AS year, max(media_item_id) AS duration_ms FROM media_identifiers WHERE media_item_id % 7 <> 0 GROUP BY provider, external_id)"""


def to_enrich(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Movies that miss fields, their candidates, and answers derived from the identifiers."""
    status = F.when(F.col("media_item_id") % 4 == 0, "succeeded").when(F.col("media_item_id") % 4 == 1, "failed").otherwise("not_found")
    records = t.identifiers.where("media_item_id % 5 <> 0").select("media_item_id", "provider", status.alias("status"), (F.col("media_item_id") % 3).cast("int").alias("attempts"), ntz("2024-01-01").alias("checked_at"))
    movies = t.items.where("kind = 'movie'").select("id", "kind", F.when(F.col("id") % 2 == 0, F.col("year")).alias("year"), F.when(F.col("id") % 3 != 0, F.col("duration_ms")).alias("duration_ms"))
    top = F.max("media_item_id")
    answers = t.identifiers.where("media_item_id % 7 <> 0").groupBy("provider", "external_id").agg((top % 90).cast("int").alias("year"), top.alias("duration_ms"))
    return movies, enrichment.candidates(movies, t.identifiers, records, ["year", "duration_ms"]), answers


@register("j20_enrichment_candidates", f"{RECORDS} SELECT media_item_id, provider, external_id FROM cand")
def _(t: Tables) -> DataFrame:
    return to_enrich(t)[1].select("media_item_id", "provider", "external_id")


@register("l07_enrichment_order", f"{RECORDS} SELECT media_item_id, provider, external_id FROM cand ORDER BY CASE WHEN attempts IS NULL THEN 0 ELSE 1 END, media_item_id, provider, external_id LIMIT 200")
def _(t: Tables) -> DataFrame:
    return enrichment.in_order(to_enrich(t)[1], 200).select("media_item_id", "provider", "external_id")


@register("m33_enriched_items", f"""{RECORDS}, got AS (SELECT c.media_item_id AS id, arg_min(a.year, c.provider) AS year, arg_min(a.duration_ms, c.provider) AS duration_ms FROM cand c JOIN ans a USING (provider, external_id) GROUP BY c.media_item_id)
SELECT m.id, coalesce(m.year, got.year) AS year, coalesce(m.duration_ms, got.duration_ms) AS duration_ms FROM m LEFT JOIN got USING (id)""")
def _(t: Tables) -> DataFrame:
    movies, wanted, answers = to_enrich(t)
    return enrichment.enrich(movies, wanted, answers, ["year", "duration_ms"]).select("id", "year", "duration_ms")


@register("m33_records", f"""{RECORDS} SELECT c.media_item_id, c.provider, CASE WHEN count(a.year) > 0 THEN 'succeeded' ELSE 'not_found' END AS status, CAST(coalesce(max(c.attempts), 0) + 1 AS INTEGER) AS attempts
FROM cand c LEFT JOIN ans a USING (provider, external_id) GROUP BY c.media_item_id, c.provider""")
def _(t: Tables) -> DataFrame:
    _, wanted, answers = to_enrich(t)
    return enrichment.records_after(wanted, answers)


def told(answers: DataFrame) -> DataFrame:
    """The answers with genres, posters and failures, derived from their largest item."""
    n = F.col("duration_ms")
    genre = F.concat(F.lit(" G  "), (n % 5).cast("string"))
    return answers.select(
        "provider", "external_id", F.when(n % 2 == 0, F.array(genre, genre, F.lit(" "))).otherwise(F.array().cast("array<string>")).alias("genres"), F.when(n % 3 == 0, F.concat(F.lit("u"), n.cast("string"))).alias("poster_url"),
        F.lit("tmdb").alias("poster_provider"), F.when(n % 11 == 0, "failed").alias("status"),
    )


@register("m33_genres_and_posters", f"""{RECORDS}, ok AS (SELECT c.media_item_id, c.provider, a.duration_ms AS n FROM cand c JOIN ans a USING (provider, external_id) WHERE a.duration_ms % 11 <> 0),
p AS (SELECT DISTINCT media_item_id FROM media_identifiers WHERE media_item_id % 10 = 0)
SELECT DISTINCT media_item_id, 'genre' AS kind, normalized_name AS value FROM media_genres UNION SELECT media_item_id, 'genre', concat('g ', CAST(n % 5 AS VARCHAR)) FROM ok WHERE n % 2 = 0
UNION ALL SELECT media_item_id, 'poster', 'old' FROM p UNION ALL SELECT media_item_id, 'poster', concat('u', CAST(arg_min(n, provider) AS VARCHAR)) FROM ok WHERE n % 3 = 0 AND media_item_id NOT IN (SELECT media_item_id FROM p) GROUP BY media_item_id""")
def _(t: Tables) -> DataFrame:
    _, wanted, answers = to_enrich(t)
    images = t.identifiers.where("media_item_id % 10 = 0").select("media_item_id", F.lit("poster").alias("image_type"), F.lit("own").alias("provider"), F.lit("old").alias("source_url"), F.lit("cached").alias("cache_status")).distinct()
    genres = enrichment.enriched_genres(t.genres, wanted, told(answers)).select("media_item_id", F.lit("genre").alias("kind"), F.col("normalized_name").alias("value"))
    return genres.unionByName(enrichment.enriched_images(images, wanted, told(answers)).select("media_item_id", F.col("image_type").alias("kind"), F.col("source_url").alias("value")))


@register("m33_failed_records", f"""{RECORDS} SELECT c.media_item_id, c.provider, CASE WHEN coalesce(bool_or(a.duration_ms % 11 <> 0), false) THEN 'succeeded' WHEN count(a.duration_ms) > 0 THEN 'failed' ELSE 'not_found' END AS status,
CAST(coalesce(max(c.attempts), 0) + 1 AS INTEGER) AS attempts FROM cand c LEFT JOIN ans a USING (provider, external_id) GROUP BY c.media_item_id, c.provider""")
def _(t: Tables) -> DataFrame:
    _, wanted, answers = to_enrich(t)
    return enrichment.records_after(wanted, told(answers))


@register("s13_incremental_scan", "SELECT id, media_item_id FROM watch_events WHERE watched_at > TIMESTAMP '1998-01-01'")
def _(t: Tables) -> DataFrame:
    return t.events.where(F.col("watched_at") > ntz("1998-01-01")).select("id", "media_item_id")


@register("s19_table_page", "SELECT id, title FROM media_items ORDER BY id LIMIT 100 OFFSET 200")
def _(t: Tables) -> DataFrame:
    return t.items.select("id", "title").orderBy("id").offset(200).limit(100)


@register("s21_upserted_refs", """SELECT source_id, external_id, CASE WHEN media_item_id % 3 = 0 THEN NOT available ELSE available END AS available FROM source_media_refs
UNION ALL SELECT source_id, external_id, true FROM staged""")
def _(t: Tables) -> DataFrame:
    refs = t.refs.select("source_id", "external_id", "available")
    batch = t.refs.where("media_item_id % 3 = 0").select("source_id", "external_id", (~F.col("available")).alias("available")).unionByName(t.staged.select("source_id", "external_id", F.lit(True).alias("available")))
    return ledger.upsert(refs, batch, ["source_id", "external_id"])


@register("u02_retention_difference", "SELECT id FROM runs EXCEPT SELECT id FROM (SELECT id FROM runs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) <= 20)")
def _(t: Tables) -> DataFrame:
    kept = catalog.keep_last(t.runs, ["job_id"], [F.desc("created_at"), F.desc("id")], 20).select("id")
    return t.runs.select("id").join(kept, "id", "left_anti")


@register("w05_latest_activity", "SELECT source_id, playback_user, event_id, event_type FROM playback_stream QUALIFY row_number() OVER (PARTITION BY source_id, playback_user ORDER BY occurred_at DESC, event_id DESC) = 1")
def _(t: Tables) -> DataFrame:
    return ingest.latest_activity(t.playback).select("source_id", "playback_user", "event_id", "event_type")


@register("w04_stale_closed", "SELECT event_id, event_type IN ('media.play', 'media.resume') AND occurred_at >= TIMESTAMP '2024-01-03 23:00:00' AS active FROM playback_stream WHERE event_type IS NOT NULL")
def _(t: Tables) -> DataFrame:
    rows = t.playback.where("event_type IS NOT NULL").withColumn("active", F.col("event_type").isin("media.play", "media.resume"))
    return ingest.close_stale(rows, datetime(2024, 1, 4)).select("event_id", "active")


@register("p_keys_and_dates", """SELECT id, sha256(concat_ws('|', CAST(id AS VARCHAR), CAST(media_item_id AS VARCHAR), CAST(source_id AS VARCHAR))) AS dedup_key, strftime(watched_at, '%Y-%m-%d') AS day,
CAST(epoch(watched_at) AS BIGINT) AS seconds FROM watch_events""")
def _(t: Tables) -> DataFrame:
    return t.events.select(
        "id", fn.key_hash(F.col("id"), F.col("media_item_id"), F.col("source_id")).alias("dedup_key"), F.date_format("watched_at", "yyyy-MM-dd").alias("day"),
        F.unix_seconds(F.col("watched_at").cast("timestamp")).alias("seconds"),
    )


@register("p_json_fields", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def _(t: Tables) -> DataFrame:
    raw = t.spark.read.parquet(f"{t.folder}/events.parquet")
    return raw.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
