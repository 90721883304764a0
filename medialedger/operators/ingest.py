"""Ingest of staged items: hierarchy rows, precedence of sources, genres, images, retirement of replaced servers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialedger import functions as fn

LEADING = "plex"


def containers(staged: DataFrame) -> DataFrame:
    """(source_id, external_id, kind, title, parent_external_id, number) of the shows, seasons, artists and albums that
    staged episodes and tracks imply, each once with its smallest title. A season without an id is ``<show>:season:<n>``."""
    season = F.coalesce("season_external_id", F.concat_ws(":", "show_external_id", F.lit("season"), F.col("season_number").cast("string")))
    row = lambda ext, kind, title, parent, number: F.struct(
        ext.alias("external_id"), F.lit(kind).alias("kind"), title.alias("title"), parent.cast("string").alias("parent_external_id"), number.cast("int").alias("number")
    )
    none = F.lit(None)
    show, artist = F.col("show_external_id"), F.col("artist_external_id")
    rows = F.when(
        F.col("kind") == "episode",
        F.array(row(show, "show", F.col("show_title"), none, none), row(season, "season", F.concat(F.lit("Season "), F.col("season_number").cast("string")), show, F.col("season_number"))),
    ).when(F.col("kind") == "track", F.array(row(artist, "artist", F.col("artist_title"), none, none), row(F.col("album_external_id"), "album", F.col("album_title"), artist, none)))
    found = staged.select("source_id", F.explode(rows).alias("c")).select("source_id", "c.*").where("external_id IS NOT NULL")
    return found.groupBy("source_id", "external_id", "kind").agg(*[F.min(c).alias(c) for c in ("title", "parent_external_id", "number")])


def seen_ids(staged: DataFrame) -> DataFrame:
    """(source_id, external_id) of all staged items and of the containers they imply."""
    return staged.select("source_id", "external_id").unionByName(containers(staged).select("source_id", "external_id")).distinct()


def may_update(staged: DataFrame, refs: DataFrame, sources: DataFrame) -> DataFrame:
    """Staged rows (source_id, media_item_id) with ``may_update``: the leading kind of server always may, another one only
    where the leading kind has no reference to the item."""
    kinds = sources.select(F.col("id").alias("source_id"), "connector_type")
    lead = refs.join(kinds.where(F.col("connector_type") == LEADING), "source_id").select("media_item_id").distinct().withColumn("_lead", F.lit(True))
    rows = staged.join(kinds, "source_id", "left").join(lead, "media_item_id", "left")
    return rows.withColumn("may_update", F.coalesce(F.col("connector_type") == LEADING, F.lit(False)) | F.col("_lead").isNull()).select(*staged.columns, "may_update")


def apply_fields(items: DataFrame, staged: DataFrame, fields: list[str]) -> DataFrame:
    """Items whose fields a staged row (one per item, with ``may_update``) overwrites, nulls included."""
    new = staged.where("may_update").select(F.col("media_item_id").alias("id"), F.lit(True).alias("_is"), *[F.col(c).alias(f"_{c}") for c in fields])
    rows = items.join(new, "id", "left")
    return rows.select(*[F.when(F.col("_is"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in items.columns])


def genre_rows(staged: DataFrame) -> DataFrame:
    """(media_item_id, normalized_name, name) of staged ``genres`` arrays, each once per item."""
    rows = staged.select("media_item_id", F.explode("genres").alias("g")).select("media_item_id", fn.fold(F.col("g")).alias("normalized_name"), fn.single_spaced(F.col("g")).alias("name"))
    return rows.where("normalized_name <> ''").groupBy("media_item_id", "normalized_name").agg(F.min("name").alias("name"))


def replace_genres(old: DataFrame, staged: DataFrame) -> DataFrame:
    """Items that were staged get exactly their new genres (none if the array is empty); other items keep theirs."""
    touched = staged.select("media_item_id").distinct()
    return old.join(touched, "media_item_id", "left_anti").select("media_item_id", "normalized_name").unionByName(genre_rows(staged).select("media_item_id", "normalized_name"))


def merge_genres(old: DataFrame, staged: DataFrame) -> DataFrame:
    """M09 for containers: the union of both."""
    return old.select("media_item_id", "normalized_name").unionByName(genre_rows(staged).select("media_item_id", "normalized_name")).distinct()


def merge_images(old: DataFrame, new: DataFrame) -> DataFrame:
    """Image references by (media_item_id, image_type): a null path changes nothing, the leading server's image gives way
    to no other's, a changed path or provider makes the image pending again."""
    key, fields = ["media_item_id", "image_type"], ["source_id", "provider", "source_path", "cache_status"]
    side = lambda df, p: df.select(*key, *[F.col(c).alias(f"{p}{c}") for c in fields])
    rows = side(old, "o_").join(side(new.where("source_path IS NOT NULL").withColumn("cache_status", F.lit("pending")), "n_"), key, "full")
    guarded = (F.col("o_provider") == LEADING) & (F.col("n_provider") != LEADING)
    same = F.col("o_source_path").eqNullSafe(F.col("n_source_path")) & F.col("o_provider").eqNullSafe(F.col("n_provider"))
    keep = F.col("n_provider").isNull() | F.coalesce(guarded, F.lit(False)) | same
    return rows.select(*key, *[F.when(keep, F.col(f"o_{c}")).otherwise(F.col(f"n_{c}")).alias(c) for c in fields])


def implied_events(staged: DataFrame) -> DataFrame:
    """The completed event that a staged item with plays and a last play implies."""
    at = F.date_format("last_viewed_at", "yyyy-MM-dd'T'HH:mm:ss")
    rows = staged.where("view_count > 0 AND last_viewed_at IS NOT NULL")
    return rows.select("source_id", F.col("external_id").alias("media_external_id"), F.concat_ws(":", F.lit("state"), "external_id", at).alias("source_event_id"),
                       F.col("last_viewed_at").alias("watched_at"), F.lit(True).alias("completed"))


def discover(libraries: DataFrame, found: DataFrame, succeeded: bool = True) -> DataFrame:
    """Libraries (source_id, external_id, name, media_type, enabled, available) after a discovery: new ones disabled, known
    ones keep ``enabled`` and take name and type, those not found become unavailable. One that failed changes nothing."""
    if not succeeded:
        return libraries.select("source_id", "external_id", "name", "media_type", "enabled", "available")
    key = ["source_id", "external_id"]
    new = found.select(*key, F.col("name").alias("_name"), F.col("media_type").alias("_type"), F.lit(True).alias("_found"))
    return libraries.join(new, key, "full").select(
        *key, F.coalesce("_name", "name").alias("name"), F.coalesce("_type", "media_type").alias("media_type"), F.coalesce("enabled", F.lit(False)).alias("enabled"),
        F.coalesce("_found", F.lit(False)).alias("available"),
    )


def retire_source(refs: DataFrame, source_id: int, now: object, row: str = "media_item_id") -> DataFrame:
    """References of a replaced server: unavailable since ``now``, without key, with retired identities
    (``retired:media:<row>:<hash>``, ``row`` being the column with the reference's own id) that no scan can meet again."""
    hit = F.col("source_id") == source_id
    value = {
        "external_id": F.when(hit, fn.retired_identity("media", F.col(row), F.col("external_id"))).otherwise(F.col("external_id")),
        "available": F.when(hit, False).otherwise(F.col("available")),
        "external_key": F.when(~hit, F.col("external_key")) if "external_key" in refs.columns else None,
        "unavailable_since": F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("unavailable_since") if "unavailable_since" in refs.columns else F.lit(None).cast("timestamp_ntz")),
    }
    columns = refs.columns if "unavailable_since" in refs.columns else [*refs.columns, "unavailable_since"]
    return refs.select(*[value[c].alias(c) if value.get(c) is not None else F.col(c) for c in columns])


def retire_libraries(libraries: DataFrame, source_id: int) -> DataFrame:
    """Libraries of a replaced server: unavailable, disabled, with retired identities."""
    hit = F.col("source_id") == source_id
    value = {
        "external_id": F.when(hit, fn.retired_identity("library", F.col("id"), F.col("external_id"))).otherwise(F.col("external_id")),
        "enabled": F.when(hit, False).otherwise(F.col("enabled")), "available": F.when(hit, False).otherwise(F.col("available")),
    }
    return libraries.select(*[value.get(c, F.col(c)).alias(c) for c in libraries.columns])


def apply_server_identity(sources: DataFrame, source_id: int, identifier: str | None, now: object, tables: dict[str, DataFrame], row: str = "id") -> tuple[bool, dict[str, DataFrame]]:
    """(whether the server was replaced, new versions of ``sources`` and of all ``tables``) after a server told its identity.

    Without an identity, or with the one that is stored, nothing changes. Where none is stored it is the first one: it is stored and
    nothing else changes. A different one means another server: its references and libraries are retired (``refs``, ``libraries``),
    and what belongs to the source goes from all other tables: marks by library (``marks``), the rest by source_id (states,
    notifications, images, outbox rows, whose source stands in a column of its own).
    """
    wanted = (identifier or "").strip()
    stored = sources.where(F.col("id") == source_id).select("server_identifier").first()
    if stored is None or not wanted or stored[0] == wanted:
        return False, {"sources": sources, **tables}
    named = sources.withColumn("server_identifier", F.when(F.col("id") == source_id, F.lit(wanted)).otherwise(F.col("server_identifier")))
    if stored[0] is None:
        return False, {"sources": named, **tables}
    out = {"sources": named}
    for name, rows in tables.items():
        if name == "refs":
            out[name] = retire_source(rows, source_id, now, row)
        elif name == "libraries":
            out[name] = retire_libraries(rows, source_id)
        elif name == "marks":
            out[name] = reset_marks(rows, tables["libraries"], source_id)
        else:
            out[name] = without_source(rows, source_id)
    return True, out


def without_source(rows: DataFrame, source_id: int) -> DataFrame:
    """States, notifications, images, marks or outbox rows without those of one source; rows without a source stay."""
    return rows.where(F.coalesce(F.col("source_id") != source_id, F.lit(True)))


def reset_marks(marks: DataFrame, libraries: DataFrame, source_id: int, library_id: int | None = None) -> DataFrame:
    """Incremental marks (library_id, ...) without those of one library, or of all libraries of a source; what has no mark is
    scanned in full."""
    own = libraries.where(F.col("source_id") == source_id)
    own = own.where(F.col("id") == library_id) if library_id is not None else own
    return marks.join(own.select(F.col("id").alias("library_id")), "library_id", "left_anti")


def apply_propagation(states: DataFrame, sent: DataFrame) -> DataFrame:
    """States after plays were sent to their targets: completed at the event's time, one view at least, no progress."""
    key = ["media_item_id", "source_id"]
    new = sent.groupBy(*key).agg(F.max("watched_at").alias("_t"))
    hit = F.col("_t").isNotNull()
    return states.select(*key, "view_count", "last_watched_at", "completed", "progress_ms").join(new, key, "full").select(
        *key, F.when(hit, F.greatest(F.coalesce("view_count", F.lit(0)), F.lit(1))).otherwise(F.col("view_count")).cast("bigint").alias("view_count"),
        F.coalesce("_t", "last_watched_at").alias("last_watched_at"), F.when(hit, True).otherwise(F.col("completed")).alias("completed"),
        F.when(~hit, F.col("progress_ms")).alias("progress_ms"),
    )


def import_plays(events: DataFrame, plays: DataFrame) -> DataFrame:
    """Matched plays of an export (id, media_item_id, watched_at) as new events with their ``dedup_key``; those imported
    before are skipped, of repeated ones the first in time is taken."""
    ids = plays.where("media_item_id IS NOT NULL").select(
        "media_item_id", F.concat(F.lit("trakt:"), F.col("id").cast("string")).alias("source_event_id"), "watched_at",
        fn.key_hash(F.lit("trakt"), F.col("id"), F.col("media_item_id"), fn.utc_text(F.col("watched_at"))).alias("dedup_key"),
    )
    first = ids.groupBy("source_event_id").agg(F.min(F.struct("watched_at", "media_item_id", "dedup_key")).alias("p"))
    once = first.select("p.media_item_id", "source_event_id", "p.watched_at", "p.dedup_key")
    return once.join(events.select("source_event_id"), "source_event_id", "left_anti")


def history_containers(plays: DataFrame) -> DataFrame:
    """(kind, show_key, season, number, title) of movies, shows, seasons and episodes that unmatched plays need, each once."""
    level = lambda kind, season, number, title: F.struct(F.lit(kind).alias("kind"), F.col("key").alias("show_key"), season.cast("int").alias("season"), number.cast("int").alias("number"), title.alias("title"))
    none = F.lit(None)
    rows = F.when(F.col("kind") == "movie", F.array(level("movie", none, none, F.col("title")))).when(
        F.col("kind") == "episode",
        F.array(level("show", none, none, F.col("show_title")), level("season", F.col("season"), none, F.concat(F.lit("Season "), F.col("season").cast("string"))), level("episode", F.col("season"), F.col("number"), F.col("title"))),
    )
    found = plays.select(F.explode(rows).alias("r")).select("r.*")
    return found.groupBy("kind", "show_key", "season", "number").agg(F.min("title").alias("title"))


def close_stale(rows: DataFrame, now: object, hours: int = 1) -> DataFrame:
    """W04 in batch: active rows that started longer ago than allowed are no longer active."""
    old = F.col("occurred_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")
    return rows.withColumn("active", F.col("active") & ~old)


def latest_activity(rows: DataFrame) -> DataFrame:
    """The newest notification of each (source, user); ties by event id."""
    best = rows.groupBy("source_id", "playback_user").agg(F.max_by(F.struct("event_id", "occurred_at", "external_id", "event_type"), F.struct("occurred_at", "event_id")).alias("r"))
    return best.select("source_id", "playback_user", "r.*")
