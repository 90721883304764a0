"""Duplicate groups over shared identifiers, their merge plan, and what goes from one server's item to another's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialedger.hubs import HUB_ROWS, join_by_key
from medialedger.identity.components import connected_components

STABLE_PROVIDERS = ("tmdb", "tvdb", "imdb", "musicbrainz")
KINDS = ("movie", "show", "artist", "album", "track")
WATCHED_PROVIDERS = ("tmdb", "tvdb", "imdb")
WATCHED_KINDS = ("movie", "episode", "track")


def _keyed(items: DataFrame, identifiers: DataFrame, kinds: tuple[str, ...], providers: tuple[str, ...]) -> DataFrame:
    own = items.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("media_item_id"), "kind")
    return identifiers.where(F.col("provider").isin(*providers)).join(own, "media_item_id").select("kind", "provider", "external_id", "media_item_id").distinct()


def shared_identifiers(items: DataFrame, identifiers: DataFrame, kinds: tuple[str, ...] = KINDS, providers: tuple[str, ...] = STABLE_PROVIDERS,
                       hub_rows: int = HUB_ROWS) -> DataFrame:
    """A10: identifiers with two or more items of one kind: one row for each of these items, with their number."""
    keyed = _keyed(items, identifiers, kinds, providers)
    several = keyed.groupBy("kind", "provider", "external_id").agg(F.count("*").alias("n")).where("n > 1")
    return join_by_key(keyed, several, ["kind", "provider", "external_id"], "media_item_id", hub_rows)


def groups(items: DataFrame, identifiers: DataFrame, cut: Callable[[DataFrame], DataFrame], kinds: tuple[str, ...] = KINDS,
           providers: tuple[str, ...] = STABLE_PROVIDERS, drop: Callable[[DataFrame], None] | None = None,
           hub_rows: int = HUB_ROWS) -> DataFrame:
    """(media_item_id, group_id) of all items in groups of two or more; the id is the smallest item.

    ``cut`` and ``drop`` are those of ``connected_components``. Every item of an identifier is linked to its smallest one, a star and no clique, and the components of that are found.
    """
    keyed = _keyed(items, identifiers, kinds, providers)
    key = ["kind", "provider", "external_id"]
    smallest = keyed.groupBy(*key).agg(F.min("media_item_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    edges = join_by_key(keyed, smallest, key, "media_item_id", hub_rows).where(F.col("media_item_id") != F.col("first")).select("media_item_id", "first")
    return connected_components(edges, "media_item_id", "first", cut, drop, hub_rows).select(F.col("node").alias("media_item_id"), F.col("root").alias("group_id"))


def merge_plan(members: DataFrame, refs: DataFrame, sources: DataFrame, hub_rows: int = HUB_ROWS) -> DataFrame:
    """(media_item_id, winner_id) for the losers of every group that may merge.

    A group merges if all its items have references and no source holds two of them; the winner is the smallest item with
    a reference of the leading server kind, else the smallest.
    """
    held = refs.join(sources.select(F.col("id").alias("source_id"), "connector_type"), "source_id").select("media_item_id", "source_id", "connector_type").distinct()
    rows = members.join(held, "media_item_id", "left")
    per_source = rows.where("source_id IS NOT NULL").groupBy("group_id", "source_id").agg(F.countDistinct("media_item_id").alias("n"))
    clash = per_source.where("n > 1").select("group_id").distinct()
    missing = rows.where("source_id IS NULL").select("group_id").distinct()
    item = rows.groupBy("group_id", "media_item_id").agg(F.max(F.coalesce(F.col("connector_type") == "plex", F.lit(False))).alias("leads"))
    winner = item.groupBy("group_id").agg(F.min(F.struct((~F.col("leads")).alias("o"), "media_item_id")).alias("w"), F.count("*").alias("n"))
    # What stops a group is asked of its one row, not of its items.
    free = winner.join(clash, "group_id", "left_anti").join(missing, "group_id", "left_anti").select("group_id", "n", F.col("w.media_item_id").alias("winner_id"))
    return join_by_key(item, free, ["group_id"], "media_item_id", hub_rows).where(F.col("media_item_id") != F.col("winner_id")).select("media_item_id", "winner_id")


def remap(rows: DataFrame, plan: DataFrame, unique: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows moved to their winners; where two have one unique key, the winner's own row stays."""
    from pyspark.sql import Window as W

    moved = rows.join(plan, "media_item_id", "left").withColumn("_moved", F.col("winner_id").isNotNull()).withColumn("_own", F.col("media_item_id"))
    moved = moved.withColumn("media_item_id", F.coalesce("winner_id", "media_item_id")).drop("winner_id")
    w = W.partitionBy(*unique).orderBy("_moved", *(order or [F.col("_own")]))
    return moved.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*rows.columns)


def remap_states(states: DataFrame, plan: DataFrame) -> DataFrame:
    """States by winner and source: highest count, any completion, latest times."""
    rows = states.join(plan, "media_item_id", "left").withColumn("media_item_id", F.coalesce("winner_id", "media_item_id"))
    return rows.groupBy("media_item_id", "source_id").agg(
        F.max("view_count").alias("view_count"), F.bool_or("completed").alias("completed"), F.max("last_watched_at").alias("last_watched_at"), F.max("observed_at").alias("observed_at")
    )


def propagation(items: DataFrame, identifiers: DataFrame, refs: DataFrame, events: DataFrame, states: DataFrame, sources: DataFrame, users: dict[int, str],
                cut: Callable[[DataFrame], DataFrame], a: int = 1, b: int = 2, start: int | None = None) -> DataFrame:
    """Plays that one of two sources lacks: (group_id, source_id, media_item_id, external_id, watched_at) of the target.

    Movies, episodes and tracks with an available reference to either source are grouped by shared identifiers; items without
    a group are their own. A group counts if each source has exactly one item in it; a side is complete with a completed state
    (last watched, else observed) or a completed event of the source's user in ``users``, at its latest time; only one-sided
    groups are returned, with ``start`` only those complete on that source. Both sources must be enabled and have a user.
    """
    if start not in (None, a, b):
        raise ValueError("start must be one of the two sources")
    users = {s: (users.get(s) or "").strip() for s in (a, b)}
    enabled = sources.where(F.col("enabled") & F.col("id").isin(a, b)).agg(F.countDistinct("id").alias("_n")).where(F.col("_n") == (2 if all(users.values()) else None))
    held = refs.where(F.col("available") & F.col("source_id").isin(a, b)).groupBy("media_item_id", "source_id").agg(F.min("external_id").alias("external_id"))
    usable = items.where(F.col("kind").isin(*WATCHED_KINDS)).join(held.select(F.col("media_item_id").alias("id")), "id", "left_semi")
    members = groups(usable, identifiers, cut, WATCHED_KINDS, WATCHED_PROVIDERS)
    own = usable.select(F.col("id").alias("media_item_id")).join(members, "media_item_id", "left")
    grouped = cut(own.select("media_item_id", F.coalesce("group_id", "media_item_id").alias("group_id")))
    held = held.join(grouped, "media_item_id")
    one = held.groupBy("group_id", "source_id").agg(F.count("*").alias("n"), F.first("media_item_id").alias("media_item_id"), F.first("external_id").alias("external_id")).where("n = 1")
    user = ((F.col("source_id") == a) & (F.col("playback_user") == users[a])) | ((F.col("source_id") == b) & (F.col("playback_user") == users[b]))
    done = events.where(F.col("completed") & user).select("media_item_id", "source_id", F.col("watched_at").alias("t")).unionByName(
        states.where("completed").select("media_item_id", "source_id", F.coalesce("last_watched_at", "observed_at").alias("t"))
    )
    at = done.join(grouped, "media_item_id").groupBy("group_id", "source_id").agg(F.max("t").alias("t"))
    sides = one.join(at, ["group_id", "source_id"], "left")
    side = lambda s: F.max(F.when(F.col("source_id") == s, F.struct("source_id", "media_item_id", "external_id", "t")))
    pairs = sides.groupBy("group_id").agg(side(a).alias("a"), side(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND (a.t IS NULL) <> (b.t IS NULL)").crossJoin(F.broadcast(enabled))
    target = lambda c: F.when(F.col("a.t").isNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    found = pairs.select("group_id", target("source_id"), target("media_item_id"), target("external_id"), F.coalesce("a.t", "b.t").alias("watched_at"))
    return found if start is None else found.where(F.col("source_id") != start)
