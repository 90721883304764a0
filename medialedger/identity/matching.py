"""Which stored item a staged one is: by identifiers, by title and year, by the place in a hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialedger import functions as fn


def by_identifier(staged: DataFrame, staged_ids: DataFrame, items: DataFrame, identifiers: DataFrame, refs: DataFrame) -> DataFrame:
    """(source_id, external_id, single, media_item_id) of staged items that share an identifier with items of their kind.

    media_item_id is the one item that matches; with several it is null and ``single`` false. For episodes, items that the same source
    holds already are no match. Staged items without a match have no row.
    """
    key = ["source_id", "external_id"]
    wanted = staged.select(*key, "kind").join(staged_ids, key).select(*key, "kind", "provider", F.col("identifier"))
    stored = identifiers.join(items.select(F.col("id").alias("media_item_id"), "kind"), "media_item_id")
    stored = stored.select("kind", "provider", F.col("external_id").alias("identifier"), "media_item_id")
    pairs = wanted.join(stored, ["kind", "provider", "identifier"])
    own = refs.select("source_id", "media_item_id").distinct().withColumn("_own", F.lit(True))
    pairs = pairs.join(own, ["source_id", "media_item_id"], "left").where((F.col("kind") != "episode") | F.col("_own").isNull())
    # The smallest and the largest item tell one match from several without gathering them.
    found = pairs.groupBy(*key).agg(F.min("media_item_id").alias("low"), F.max("media_item_id").alias("high"))
    return found.select(*key, (F.col("low") == F.col("high")).alias("single"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("media_item_id"))


def by_title_and_year(staged: DataFrame, items: DataFrame, refs: DataFrame) -> DataFrame:
    """(source_id, external_id, media_item_id) of staged movies with exactly one movie of equal title key and year that
    another source holds. Titles are folded alike on both sides; two unknown years are equal."""
    movies = items.where("kind = 'movie'").select(F.col("id").alias("media_item_id"), fn.fold(F.col("title")).alias("k"), F.coalesce("year", F.lit(-1)).alias("y"))
    held = movies.join(refs.select("media_item_id", "source_id").distinct(), "media_item_id")
    per_source = held.groupBy("k", "y", F.col("source_id").alias("holder")).agg(F.min("media_item_id").alias("low"), F.max("media_item_id").alias("high"))
    wanted = staged.where("kind = 'movie'").select("source_id", "external_id", fn.fold(F.col("title")).alias("k"), F.coalesce("year", F.lit(-1)).alias("y"))
    met = wanted.join(per_source, ["k", "y"]).where("holder <> source_id").groupBy("source_id", "external_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return met.where("low = high").select("source_id", "external_id", F.col("low").alias("media_item_id"))


def compatible_episodes(matched: DataFrame, items: DataFrame, refs: DataFrame) -> DataFrame:
    """Matched episodes (source_id, external_id, media_item_id, season_number, show_external_id, season_external_id) whose
    stored hierarchy may be shared: an episode of a season of that number of a show, and the source's own references to the
    show and season, if any, name these very rows."""
    up = lambda n: items.select(F.col("id").alias(f"{n}_id"), F.col("kind").alias(f"{n}_kind"), F.col("parent_id").alias(f"{n}_up"), F.col("season_number").alias(f"{n}_number"))
    ref = lambda n: refs.select("source_id", F.col("external_id").alias(f"{n}_ext"), F.col("media_item_id").alias(f"{n}_ref"))
    season_ext = F.coalesce("season_external_id", F.concat_ws(":", "show_external_id", F.lit("season"), F.col("season_number").cast("string")))
    rows = matched.withColumn("season_ext", season_ext).withColumn("show_ext", F.col("show_external_id"))
    rows = rows.join(up("e"), F.col("media_item_id") == F.col("e_id")).join(up("s"), F.col("e_up") == F.col("s_id")).join(up("h"), F.col("s_up") == F.col("h_id"))
    rows = rows.join(ref("show"), ["source_id", "show_ext"], "left").join(ref("season"), ["source_id", "season_ext"], "left")
    fits = (F.col("e_kind") == "episode") & (F.col("s_kind") == "season") & (F.col("h_kind") == "show") & F.col("s_number").eqNullSafe(F.col("season_number"))
    agrees = F.coalesce(F.col("show_ref") == F.col("h_id"), F.lit(True)) & F.coalesce(F.col("season_ref") == F.col("s_id"), F.lit(True))
    return rows.where(fits & agrees).select(*matched.columns)


def resolve(staged: DataFrame, staged_ids: DataFrame, items: DataFrame, identifiers: DataFrame, refs: DataFrame) -> DataFrame:
    """Each staged item with match_status (matched, new, ambiguous, incompatible) and media_item_id if matched.

    Several items for an episode, or an episode in another hierarchy, leave it new or incompatible; several for any other kind
    are ambiguous (an error row of the caller). Movies without any identifier match fall back to title and year.
    """
    key = ["source_id", "external_id"]
    ids = by_identifier(staged, staged_ids, items, identifiers, refs)
    rows = staged.join(ids.withColumnRenamed("media_item_id", "by_id"), key, "left")
    rows = rows.join(by_title_and_year(staged, items, refs).withColumnRenamed("media_item_id", "by_title"), key, "left")
    episodes = rows.where("kind = 'episode' AND by_id IS NOT NULL").select(*key, F.col("by_id").alias("media_item_id"), "season_number", "show_external_id", "season_external_id")
    fitting = compatible_episodes(episodes, items, refs).select(*key, F.lit(True).alias("fits")).distinct()
    rows = rows.join(fitting, key, "left")
    episode = F.col("kind") == "episode"
    status = (
        F.when(F.col("single").isNull() & F.col("by_title").isNotNull(), "matched").when(F.col("single").isNull(), "new")
        .when(~F.col("single"), F.when(episode, "new").otherwise("ambiguous")).when(episode & F.col("fits").isNull(), "incompatible").otherwise("matched")
    )
    return rows.withColumn("match_status", status).select(
        *staged.columns, "match_status", F.when(F.col("match_status") == "matched", F.coalesce("by_id", "by_title")).alias("media_item_id")
    )


def ancestors(items: DataFrame) -> DataFrame:
    """(id, season_id, show_id) of episodes that lie in a season of a show."""
    of = lambda kind: items.where(F.col("kind") == kind)
    seasons = of("season").select(F.col("id").alias("season_id"), F.col("parent_id").alias("show_id"))
    shows = of("show").select(F.col("id").alias("show_id"))
    return of("episode").select("id", F.col("parent_id").alias("season_id")).join(seasons, "season_id").join(shows, "show_id").select("id", "season_id", "show_id")


def target_of(plays: DataFrame, refs: DataFrame, sources: DataFrame) -> DataFrame:
    """For each (media_item_id, source_id) the one available reference of its item in another enabled source; with none or
    several, no row."""
    enabled = sources.where("enabled").select(F.col("id").alias("target_source"))
    held = refs.where("available").select("media_item_id", F.col("source_id").alias("target_source"), F.col("external_id").alias("target_external")).join(enabled, "target_source", "left_semi")
    met = plays.select("media_item_id", "source_id").distinct().join(held, "media_item_id").where("target_source <> source_id")
    best = met.groupBy("media_item_id", "source_id").agg(F.count("*").alias("n"), F.min(F.struct("target_source", "target_external")).alias("t"))
    return best.where("n = 1").select("media_item_id", "source_id", "t.*")


def arrived(pending: DataFrame, refs: DataFrame) -> DataFrame:
    """Pending plays whose item has come into the catalog; the others stay pending."""
    return pending.join(refs.select("source_id", "external_id", "media_item_id").distinct(), ["source_id", "external_id"])


def replayed(pending: DataFrame, refs: DataFrame, libraries: DataFrame) -> DataFrame:
    """Completed pending notifications (id, source_id, external_id, occurred_at) whose item has arrived, as events to persist.

    Their identity is ``webhook:<id>``, so a replay changes nothing. The library is that of the reference, or where it has none the
    source's library with the lowest id.
    """
    lowest = libraries.groupBy("source_id").agg(F.min("id").alias("_lowest"))
    known = refs.groupBy("source_id", "external_id").agg(F.min("media_item_id").alias("media_item_id"), F.min("library_id").alias("library_id"))
    rows = pending.where("completed").join(known, ["source_id", "external_id"]).join(lowest, "source_id", "left")
    return rows.select(
        F.col("id").alias("seq"), "source_id", F.col("external_id").alias("media_external_id"), F.coalesce("library_id", "_lowest").alias("library_id"), "media_item_id",
        F.concat(F.lit("webhook:"), F.col("id").cast("string")).alias("source_event_id"), F.col("occurred_at").alias("watched_at"), F.lit(True).alias("completed"),
    )


def hierarchy_merge(items: DataFrame, shows: DataFrame) -> DataFrame:
    """(season, target, action) for the seasons of losing shows (``media_item_id`` -> ``winner_id``).

    A season is merged into the winner's one season of its number; without one, or with several, it is reparented.
    """
    seasons = items.where("kind = 'season'").select(F.col("id").alias("season_id"), "parent_id", "season_number")
    lost = seasons.join(shows.select(F.col("media_item_id").alias("parent_id"), "winner_id"), "parent_id")
    own = seasons.groupBy(F.col("parent_id").alias("winner_id"), "season_number").agg(F.count("*").alias("n"), F.min("season_id").alias("match"))
    rows = lost.join(own, ["winner_id", "season_number"], "left")
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    return rows.select("season_id", F.when(one, F.col("match")).otherwise(F.col("winner_id")).alias("target_id"), F.when(one, "merge").otherwise("reparent").alias("action"))


def episode_merge(items: DataFrame, identifiers: DataFrame, refs: DataFrame, seasons: DataFrame) -> DataFrame:
    """(episode_id, target_id, action) for the episodes of merged seasons (season_id -> target_id with action merge).

    An episode is merged into the one episode of the winner's season that shares an identifier with it, if no source holds both;
    else it is reparented to the winner's season.
    """
    moved = seasons.where("action = 'merge'").select(F.col("season_id").alias("parent_id"), F.col("target_id").alias("winner_season"))
    episodes = items.where("kind = 'episode'").select(F.col("id").alias("episode_id"), "parent_id")
    lost = episodes.join(moved, "parent_id").select("episode_id", "winner_season")
    ids = identifiers.select(F.col("media_item_id").alias("episode_id"), "provider", "external_id").distinct()
    theirs = items.select(F.col("id").alias("match_id"), F.col("parent_id").alias("winner_season")).join(ids.withColumnRenamed("episode_id", "match_id"), "match_id")
    shared = lost.join(ids, "episode_id").join(theirs, ["winner_season", "provider", "external_id"])
    one = shared.groupBy("episode_id").agg(F.min("match_id").alias("match_id"), F.max("match_id").alias("high")).where("match_id = high").select("episode_id", "match_id")
    held = refs.select("media_item_id", "source_id").distinct()
    both = one.join(held.withColumnRenamed("media_item_id", "episode_id"), "episode_id").join(held.withColumnRenamed("media_item_id", "match_id"), ["match_id", "source_id"])
    safe = one.join(both.select("episode_id").distinct(), "episode_id", "left_anti")
    rows = lost.join(safe, "episode_id", "left")
    merged = F.col("match_id").isNotNull()
    return rows.select("episode_id", F.coalesce("match_id", "winner_season").alias("target_id"), F.when(merged, "merge").otherwise("reparent").alias("action"))


def fill_missing(items: DataFrame, plan: DataFrame, fields: list[str]) -> DataFrame:
    """Winners with null fields taken from their losers, the smallest loser that has a value first; losers are dropped."""
    lost = items.join(plan.select(F.col("media_item_id").alias("id"), "winner_id"), "id")
    take = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(f"_{c}")
    spare = lost.groupBy(F.col("winner_id").alias("id")).agg(*[take(c) for c in fields])
    kept = items.join(plan.select(F.col("media_item_id").alias("id")), "id", "left_anti").join(spare, "id", "left")
    return kept.select(*[F.coalesce(c, f"_{c}").alias(c) if c in fields else F.col(c) for c in items.columns])
