"""Catalog and history queries: statistics, roll-ups, availability, lists, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from medialedger import functions as fn
from medialedger.hubs import HUB_ROWS, join_by_key

ROOT_KINDS = ("movie", "show", "artist")
PROVIDER_ORDER = ("tmdb", "tvdb", "imdb")


def last_completed(items: DataFrame, events: DataFrame, states: DataFrame) -> DataFrame:
    """The later of an item's last completed event and last completed state (null without either)."""
    e = events.where("completed").groupBy(F.col("media_item_id").alias("id")).agg(F.max("watched_at").alias("event_last"))
    s = states.where("completed").groupBy(F.col("media_item_id").alias("id")).agg(F.max("last_watched_at").alias("state_last"))
    return items.join(e, "id", "left").join(s, "id", "left").withColumn("last_completed", F.greatest("event_last", "state_last"))


def history(items: DataFrame, events: DataFrame, states: DataFrame, watched: str = "watched", kind: str | None = None, title: str | None = None) -> DataFrame:
    """items of the history page; ``watched`` is watched, unwatched or all. Wildcards in ``title`` are live."""
    rows = last_completed(items, events, states)
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if title:
        rows = rows.where(F.col("title").ilike(f"%{title}%"))
    if watched != "all":
        rows = rows.where(F.col("last_completed").isNotNull() if watched == "watched" else F.col("last_completed").isNull())
    return rows


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page by offset, with one row more to tell whether another follows."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size + 1)


def after(rows: DataFrame, time: str, key: str, at: object, last_key: int, size: int) -> DataFrame:
    """The page after (``at``, ``last_key``) in order of time and key, both falling."""
    rest = rows.where((F.col(time) < F.lit(at)) | ((F.col(time) == F.lit(at)) & (F.col(key) < last_key)))
    return rest.orderBy(F.desc(time), F.desc(key)).limit(size + 1)


def completion_stats(items: DataFrame, events: DataFrame, states: DataFrame) -> DataFrame:
    """completion_count is the larger of completed events and highest state count; an event's time goes first."""
    e = events.where("completed").groupBy(F.col("media_item_id").alias("id")).agg(
        F.count("*").alias("event_count"), F.min("watched_at").alias("first_completed"), F.max("watched_at").alias("event_last")
    )
    s = states.where("completed").groupBy(F.col("media_item_id").alias("id")).agg(
        F.max("view_count").alias("state_count"), F.max("last_watched_at").alias("state_last")
    )
    count = F.greatest(F.coalesce("event_count", F.lit(0)), F.coalesce("state_count", F.lit(0))).cast("bigint")
    return items.join(e, "id", "left").join(s, "id", "left").select(
        *items.columns, count.alias("completion_count"), "first_completed", F.coalesce("event_last", "state_last").alias("last_completed")
    )


def with_root(items: DataFrame) -> DataFrame:
    """Id and root_id, the topmost of at most three levels."""
    parents = items.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("grandparent_id"))
    return items.select("id", "parent_id").join(parents, "parent_id", "left").select("id", F.coalesce("grandparent_id", "parent_id", "id").alias("root_id"))


def last_played(items: DataFrame, events: DataFrame, states: DataFrame) -> DataFrame:
    """root_id and last_played: the last event unless a later partial play exists, else the last state."""
    roots = with_root(items).withColumnRenamed("id", "media_item_id")
    e = events.groupBy("media_item_id").agg(F.max("watched_at").alias("e"))
    active = states.where("completed OR progress_ms > 0")
    partial = F.when(~F.col("completed") & (F.col("progress_ms") > 0), F.col("last_watched_at"))
    s = active.groupBy("media_item_id").agg(F.max("last_watched_at").alias("s"), F.max(partial).alias("p"))
    both = roots.join(e, "media_item_id", "left").join(s, "media_item_id", "left")
    by_root = both.groupBy("root_id").agg(F.max("e").alias("e"), F.max("s").alias("s"), F.max("p").alias("p"))
    return by_root.select("root_id", F.when(F.col("e").isNotNull(), F.greatest("e", "p")).otherwise(F.col("s")).alias("last_played"))


def availability(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """For each item with an available reference, whether each kind of server has it."""
    has = lambda c: F.bool_or(F.col("connector_type") == c).alias(f"on_{c}")
    kinds = sources.select(F.col("id").alias("source_id"), "connector_type")
    return refs.where("available").join(kinds, "source_id").groupBy("media_item_id").agg(has("plex"), has("jellyfin"))


def _through_keys(own: DataFrame, flags: DataFrame, key: list[str], hub_rows: int) -> DataFrame:
    """The flags of each item through all items that have one of its keys; keys of very many items are salted."""
    either = [F.bool_or("on_plex").alias("on_plex"), F.bool_or("on_jellyfin").alias("on_jellyfin")]
    by_key = own.join(flags, "media_item_id", "left").groupBy(*key).agg(*either, F.count("*").alias("n")).where("on_plex IS NOT NULL OR on_jellyfin IS NOT NULL")
    return join_by_key(own, by_key, key, "media_item_id", hub_rows).groupBy("media_item_id").agg(*either)


def shared_availability(items: DataFrame, identifiers: DataFrame, refs: DataFrame, sources: DataFrame, hub_rows: int = HUB_ROWS) -> DataFrame:
    """Availability of an item through all items of its kind that share an identifier.

    Flags are first gathered by identifier, so an identifier of many items costs its rows and not its pairs.
    """
    own = identifiers.join(items.select(F.col("id").alias("media_item_id"), "kind"), "media_item_id")
    flags = availability(refs, sources)
    key = ["kind", "provider", "external_id"]
    return _through_keys(own, flags, key, hub_rows)


def catalog_availability(items: DataFrame, identifiers: DataFrame, refs: DataFrame, sources: DataFrame) -> DataFrame:
    """J10 and J11 together: availability of each item through its own references or those of items of its kind that share an
    identifier; an item stands for itself under a key of its own, so references are read and gathered once."""
    kinds = items.select(F.col("id").alias("media_item_id"), "kind")
    own = identifiers.select("media_item_id", "provider", "external_id").join(kinds, "media_item_id")
    own = own.unionByName(kinds.select("media_item_id", F.lit("").alias("provider"), F.col("media_item_id").cast("string").alias("external_id"), "kind"))
    key = ["kind", "provider", "external_id"]
    return _through_keys(own, availability(refs, sources), key, HUB_ROWS)


def canonical_identifier(identifiers: DataFrame) -> DataFrame:
    """The best identifier of each item by provider order, then by its text."""
    rank = F.coalesce(*(F.when(F.col("provider") == p, F.lit(i)) for i, p in enumerate(PROVIDER_ORDER)), F.lit(len(PROVIDER_ORDER)))
    best = identifiers.groupBy("media_item_id").agg(F.min(F.struct(rank.alias("rank"), "provider", "external_id")).alias("b"))
    return best.select("media_item_id", "b.provider", "b.external_id")


def catalog(items: DataFrame, events: DataFrame, states: DataFrame, identifiers: DataFrame, genres: DataFrame, refs: DataFrame, sources: DataFrame,
            kinds: tuple[str, ...] = ROOT_KINDS, title: str | None = None, genre: str | None = None, available: str = "all", played: str = "all") -> DataFrame:
    """catalog rows with completion, last play and availability.

    ``available`` is all, available or unavailable (no available reference); ``played`` is all, played or unplayed.
    """
    rows = completion_stats(items.where(F.col("kind").isin(*kinds)), events, states)
    if title:
        rows = rows.where(F.col("title").ilike(f"%{title}%"))
    if genre:
        rows = rows.join(genres.where(F.col("normalized_name") == genre.lower()).select(F.col("media_item_id").alias("id")), "id", "left_semi")
    if available != "all":
        present = refs.where("available").select(F.col("media_item_id").alias("id"))
        rows = rows.join(present, "id", "left_semi" if available == "available" else "left_anti")
    if played != "all":
        rows = rows.where((F.col("completion_count") > 0) == (played == "played"))
    flags = catalog_availability(items.where(F.col("kind").isin(*kinds)), identifiers, refs, sources).withColumnRenamed("media_item_id", "id")
    rows = rows.join(last_played(items, events, states).withColumnRenamed("root_id", "id"), "id", "left").join(flags, "id", "left")
    known = [F.coalesce(c, F.lit(False)).alias(c) for c in ("on_plex", "on_jellyfin")]
    return rows.select(*items.columns, "completion_count", "first_completed", "last_completed", "last_played", *known)


def deduplicated(rows: DataFrame, identifiers: DataFrame, order: list[Column]) -> DataFrame:
    """One row per canonical identifier and kind (without one, per title key P03 and year), before paging.

    Its place is that of the group's first row in ``order``, its content that of the smallest id, its flags of any.
    """
    best = canonical_identifier(identifiers).withColumnRenamed("media_item_id", "id")
    named = F.col("provider").isNotNull()
    key = F.struct("kind", "provider", "external_id", fn.title_key(F.when(~named, F.col("title"))).alias("title"), F.when(~named, F.col("year")).alias("year"))
    keyed = rows.join(best, "id", "left").withColumn("key", key)
    content = [c for c in rows.columns if c not in ("on_plex", "on_jellyfin")]
    # The window and the aggregate share one shuffle by key.
    merged = keyed.withColumn("_place", F.row_number().over(W.partitionBy("key").orderBy(*order))).groupBy("key").agg(
        F.min_by(F.struct(*content), "id").alias("c"), F.min_by("id", "_place").alias("placed_by"), F.bool_or("on_plex").alias("on_plex"), F.bool_or("on_jellyfin").alias("on_jellyfin")
    )
    return merged.select("c.*", "on_plex", "on_jellyfin", "placed_by")


#: Each sort key of the catalog with the columns it takes, the first that has a value.
SORT_KEYS = {
    "title": ("sort_title", "title"), "original_title": ("original_title", "title"), "year": ("year",), "last_played": ("last_played",),
    "first_played": ("first_completed",), "play_count": ("completion_count",), "added": ("source_added_at", "created_at"), "updated": ("updated_at",),
    "removed": ("removed_at",), "duration": ("duration_ms",), "rating": ("audience_rating",),
}


def sort_order(key: str, descending: bool) -> list[Column]:
    """Nulls last both ways, ties by title and id; the rows need the columns of the key in ``SORT_KEYS``."""
    c = F.coalesce(*SORT_KEYS[key])
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col("title").asc_nulls_last(), F.col("id").asc()]


def dashboard(items: DataFrame, events: DataFrame, states: DataFrame) -> DataFrame:
    """Items and distinct watched items by kind, watched by a completed event or state."""
    done = events.where("completed").select("media_item_id").union(states.where("completed").select("media_item_id")).distinct()
    rows = items.select("id", "kind").join(done.select(F.col("media_item_id").alias("id"), F.lit(1).alias("w")), "id", "left")
    return rows.groupBy("kind").agg(F.count("*").alias("total"), F.count("w").alias("watched"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table (sources, libraries)."""
    row = None
    for name, table in tables.items():
        one = table.agg(F.count("*").alias(name))
        row = one if row is None else row.crossJoin(F.broadcast(one))  # each is one row
    return row


def state_dashboard(items: DataFrame, states: DataFrame) -> DataFrame:
    """Items, state rows and completed state rows by kind."""
    rows = items.select(F.col("id").alias("media_item_id"), "kind").join(states.select("media_item_id", "completed"), "media_item_id", "left")
    return rows.groupBy("kind").agg(
        F.countDistinct("media_item_id").alias("total"), F.count("completed").alias("states"), F.count_if(F.col("completed")).alias("completed_states")
    )


def container_progress(items: DataFrame, events: DataFrame, states: DataFrame) -> DataFrame:
    """For each show or season its playable descendants: total, played, sum of plays, last play."""
    leaf = completion_stats(items.where("kind IN ('episode', 'track')"), events, states)
    up = items.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("grandparent_id"))
    rows = leaf.join(up, "parent_id", "left").select(F.explode(F.array_compact(F.array("parent_id", "grandparent_id"))).alias("container_id"), "completion_count", "last_completed")
    return rows.groupBy("container_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("completion_count") > 0).alias("played"), F.sum("completion_count").alias("plays"), F.max("last_completed").alias("last_completed")
    )


def container_states(items: DataFrame, events: DataFrame, states: DataFrame, refs: DataFrame) -> DataFrame:
    """Per source and library, the state of each season and show from its episodes available there.

    A child counts the larger of its state's count and its completed events; a container's count is the smallest of its
    children, 0 if any was never played; the last play is kept anyway.
    """
    e = events.where("completed").groupBy("media_item_id", "source_id").agg(F.count("*").alias("n"), F.max("watched_at").alias("t"))
    s = states.select("media_item_id", "source_id", "view_count", "last_watched_at")
    key = ["media_item_id", "source_id"]
    leaf = items.where("kind IN ('episode', 'track')").select(F.col("id").alias("media_item_id"), "parent_id")
    child = refs.where("available").select(*key, "library_id").distinct().join(leaf, "media_item_id").join(e, key, "left").join(s, key, "left")
    child = child.select(
        "source_id", "library_id", "parent_id", F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("view_count", F.lit(0))).alias("plays"), F.greatest("t", "last_watched_at").alias("last")
    )
    up = items.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("grandparent_id"))
    rows = child.join(up, "parent_id").select("source_id", "library_id", F.explode(F.array_compact(F.array("parent_id", "grandparent_id"))).alias("media_item_id"), "plays", "last")
    done = rows.groupBy("media_item_id", "source_id", "library_id").agg(F.greatest(F.min("plays"), F.lit(0)).cast("bigint").alias("view_count"), F.max("last").alias("last_watched_at"))
    return done.withColumn("completed", F.col("view_count") > 0)


def rebuild_container_states(items: DataFrame, events: DataFrame, states: DataFrame, refs: DataFrame, source_id: int, library_id: int, observed_at: object) -> DataFrame:
    """``states`` after the containers of one library were derived anew: their progress is null, all others stay."""
    new = container_states(items, events, states, refs.where((F.col("source_id") == source_id) & (F.col("library_id") == library_id)))
    kept = states.join(new.select("media_item_id", "source_id"), ["media_item_id", "source_id"], "left_anti")
    rows = new.select(
        "media_item_id", "source_id", F.col("view_count").cast(states.schema["view_count"].dataType).alias("view_count"), "last_watched_at", "completed",
        F.lit(None).cast(states.schema["progress_ms"].dataType).alias("progress_ms"), F.lit(observed_at).cast(states.schema["observed_at"].dataType).alias("observed_at"),
    )
    return kept.select(*rows.columns).unionByName(rows)


def latest_state(states: DataFrame) -> DataFrame:
    """The latest state row of each item; ties by source, the highest first."""
    w = W.partitionBy("media_item_id").orderBy(F.col("last_watched_at").desc_nulls_last(), F.desc("source_id"))
    return states.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def media(items: DataFrame, refs: DataFrame, states: DataFrame, kind: str | None = None, parent_id: int | None = None, year: int | None = None, title: str | None = None,
          available: bool | None = None, watched: bool | None = None, library_id: int | None = None, after_id: int | None = None, size: int | None = None) -> DataFrame:
    """items by field; ``available`` and ``watched`` ask for a reference or state with that very value (F09), ``library_id``
    for a reference in that library. With ``size`` the page after ``after_id`` in order of id, and one row more."""
    rows = items
    for c, v in (("kind", kind), ("parent_id", parent_id), ("year", year)):
        rows = rows.where(F.col(c) == v) if v is not None else rows
    rows = rows.where(F.col("title").ilike(f"%{title}%")) if title else rows
    own = lambda df: df.select(F.col("media_item_id").alias("id"))
    if available is not None:
        rows = rows.join(own(refs.where(F.col("available") == available)), "id", "left_semi")
    if watched is not None:
        rows = rows.join(own(states.where(F.col("completed") == watched)), "id", "left_semi")
    rows = rows.join(own(refs.where(F.col("library_id") == library_id)), "id", "left_semi") if library_id is not None else rows
    rows = rows.where(F.col("id") > after_id) if after_id is not None else rows
    return rows.orderBy("id").limit(size + 1) if size is not None else rows


def watch_events(events: DataFrame, items: DataFrame, refs: DataFrame, kind: str | None = None, source_id: int | None = None, completed: bool | None = None,
                 library_id: int | None = None, since: object = None, until: object = None, media_id: int | None = None, before_id: int | None = None, size: int | None = None) -> DataFrame:
    """Events by item, source, kind, completion, half-open time range and a library that lists their item.

    With ``size`` the newest of those with an id below ``before_id``, ties by id, and one row more.
    """
    rows = events
    for c, v in (("source_id", source_id), ("completed", completed), ("media_item_id", media_id)):
        rows = rows.where(F.col(c) == v) if v is not None else rows
    rows = rows.where(F.col("watched_at") >= F.lit(since)) if since is not None else rows
    rows = rows.where(F.col("watched_at") < F.lit(until)) if until is not None else rows
    if kind:
        rows = rows.join(items.where(F.col("kind") == kind).select(F.col("id").alias("media_item_id")), "media_item_id", "left_semi")
    rows = rows.join(refs.where(F.col("library_id") == library_id).select("media_item_id"), "media_item_id", "left_semi") if library_id is not None else rows
    rows = rows.where(F.col("id") < before_id) if before_id is not None else rows
    return rows.orderBy(F.desc("watched_at"), F.desc("id")).limit(size + 1) if size is not None else rows


def series_titles(items: DataFrame) -> DataFrame:
    """For each episode its show's title: that of its season's parent, or of its parent if that is a show."""
    up = lambda n: items.select(F.col("id").alias(f"{n}_id"), F.col("kind").alias(f"{n}_kind"), F.col("title").alias(f"{n}_title"), F.col("parent_id").alias(f"{n}_up"))
    rows = items.where("kind = 'episode'").join(up("p"), F.col("parent_id") == F.col("p_id"), "left").join(up("g"), F.col("p_up") == F.col("g_id"), "left")
    return rows.select("id", F.when(F.col("p_kind") == "show", F.col("p_title")).when(F.col("g_kind") == "show", F.col("g_title")).alias("series_title"))


def keep_last(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each group."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def ordered_children(items: DataFrame) -> DataFrame:
    """Each child with its place under its parent, by disc, track, episode and id, those without a number first."""
    w = W.partitionBy("parent_id").orderBy("disc_number", "track_number", "episode_number", "id")
    return items.where("parent_id IS NOT NULL").withColumn("place", F.row_number().over(w).cast("bigint"))
