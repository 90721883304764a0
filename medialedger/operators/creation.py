"""Containers and history items that are not there yet, looked up from the top down before they are created.

New rows get dense ids after the largest one; what is created is found by the same lookup the next time, so a second run creates
nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from medialedger import functions as fn
from medialedger.hubs import join_by_key
from medialedger.identity.components import connected_components
from medialedger.operators import containers, ingest
from medialedger.sources import history_export
from medialedger.tables import discard, written

#: Rows are numbered within one of so many blocks, after as many sums.
BLOCKS = 1024


def numbered(rows: DataFrame, key: list[str], start: int, column: str = "id") -> DataFrame:
    """``rows`` with ``column``: start + 1, start + 2, ... without gaps, in an order that only depends on their unique key."""
    block = F.pmod(F.xxhash64(*key), F.lit(BLOCKS))
    placed = rows.withColumn("_block", block).withColumn("_at", F.row_number().over(W.partitionBy("_block").orderBy(*key)))
    counts = placed.groupBy("_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # BLOCKS rows
    offsets = F.broadcast(counts.select("_block", before.alias("_before")))
    return placed.join(offsets, "_block").select(*rows.columns, (F.lit(start) + F.col("_before") + F.col("_at")).cast("bigint").alias(column))


def _after(*tables: DataFrame) -> int:
    """The largest id in use."""
    return max((t.agg(F.max("id")).first()[0] or 0) for t in tables)


def _like(rows: DataFrame, model: DataFrame) -> DataFrame:
    """The columns of ``model``, null where ``rows`` has none."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in model.dtypes])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Hierarchy(NamedTuple):
    """New versions of items and references, the parent of each staged leaf (source_id, external_id, parent_id), and error rows."""

    items: DataFrame
    refs: DataFrame
    parents: DataFrame
    errors: DataFrame
    created: DataFrame


def ensure_hierarchy(staged: DataFrame, staged_ids: DataFrame, items: DataFrame, identifiers: DataFrame, refs: DataFrame, observed_at: object) -> Hierarchy:
    """The shows, seasons, artists and albums that staged episodes and tracks (with library_id) name, each with its reference.

    From the top down, a container is the item of its source's reference; else the one that M05 matches (shows by identifiers or
    title, seasons by parent and number), which gets a reference; else a new item with one. References that are met are available
    and seen now. A known album keeps its parent, takes the title it is told and needs no artist. A reference to an item of another
    kind or parent, and several matches, are errors; what lies below these is left out.
    """
    key = ["source_id", "external_id"]
    boxes = written(ingest.containers(staged))
    library = staged.groupBy("source_id").agg(F.min("library_id").alias("_library"))
    stored = items.select(F.col("id").alias("media_item_id"), F.col("kind").alias("_kind"), F.col("parent_id").alias("_up"))
    known = refs.select(*key, "media_item_id")

    def level(rows: DataFrame, start: int, extra: DataFrame | None) -> tuple[DataFrame, DataFrame, int]:
        """(source_id, external_id, kind, title, number, parent_id, media_item_id, how), error rows, the largest id used."""
        met = rows.join(known, key, "left").join(stored, "media_item_id", "left")
        fits = (F.col("_kind") == F.col("kind")) & ((F.col("kind") == "album") | F.col("_up").eqNullSafe(F.col("parent_id")))
        met = written(met.withColumn("how", F.when(F.col("media_item_id").isNull(), "none").when(fits, "known").otherwise("conflict")))
        rest = met.where("how = 'none'").select(*key, "kind", "title", "parent_id", F.col("number").alias("season_number"))
        every = items if extra is None else items.unionByName(_like(extra, items))
        matched = written(containers.match_containers(rest, staged_ids, every, identifiers))
        new = numbered(matched.where("match_status = 'new'").drop("media_item_id", "match_status"), key, start, "media_item_id")
        columns = [*key, "kind", "title", "parent_id"]
        found = _union([
            met.where("how = 'known'").select(*columns, "number", "media_item_id", F.lit("known").alias("how")),
            matched.where("match_status = 'matched'").select(*columns, F.col("season_number").alias("number"), "media_item_id", F.lit("matched").alias("how")),
            new.select(*columns, F.col("season_number").alias("number"), "media_item_id", F.lit("new").alias("how")),
        ])
        errors = met.where("how = 'conflict'").select(*key, F.lit("conflicting hierarchy").alias("message"))
        errors = errors.unionByName(matched.where("match_status = 'ambiguous'").select(*key, F.lit("ambiguous container").alias("message")))
        found = written(found)
        return found, errors, start + found.where("how = 'new'").count()

    top = boxes.where("kind IN ('show', 'artist')").withColumn("parent_id", F.lit(None).cast("bigint"))
    # Artists are asked for by albums that have no reference yet.
    unknown = boxes.where("kind = 'album'").join(known, key, "left_anti").select("source_id", F.col("parent_external_id").alias("external_id"), F.lit(True).alias("_asked")).distinct()
    top = top.join(unknown, key, "left").where("kind = 'show' OR _asked").drop("_asked")
    first, first_errors, used = level(top, _after(items), None)
    up = first.select("source_id", F.col("external_id").alias("parent_external_id"), F.col("media_item_id").alias("parent_id"))
    below = boxes.where("kind IN ('season', 'album')").join(up, ["source_id", "parent_external_id"], "left")
    is_known = below.join(known.select(*key, F.lit(True).alias("_known")), key, "left")
    below = is_known.where("parent_id IS NOT NULL OR (kind = 'album' AND _known)").drop("_known")
    second, second_errors, _ = level(below, used, first.where("how = 'new'").select(F.col("media_item_id").alias("id"), "kind", "parent_id", "title"))
    found = first.unionByName(second)

    created = found.where("how = 'new'").select(F.col("media_item_id").alias("id"), "kind", "parent_id", "title", F.when(F.col("kind") == "season", F.col("number")).alias("season_number"))
    titles = found.where("how = 'known' AND kind = 'album' AND title IS NOT NULL").groupBy(F.col("media_item_id").alias("id")).agg(F.min("title").alias("_title"))
    kept = items.join(titles, "id", "left").select(*[F.coalesce("_title", "title").alias(c) if c == "title" else F.col(c) for c in items.columns])
    seen = found.join(library, "source_id", "left").groupBy(*key).agg(F.min("media_item_id").alias("_item"), F.min("_library").alias("_library"), F.lit(True).alias("_seen"))
    both, hit = refs.join(seen, key, "full"), F.col("_seen").isNotNull()
    value = {
        "media_item_id": F.coalesce("media_item_id", "_item"), "library_id": F.coalesce("library_id", "_library"), "available": F.when(hit, True).otherwise(F.col("available")),
        "unavailable_since": F.when(~hit, F.col("unavailable_since")) if "unavailable_since" in refs.columns else None,
        "last_seen_at": F.when(hit, F.lit(observed_at).cast("timestamp_ntz")).otherwise(F.col("last_seen_at")) if "last_seen_at" in refs.columns else None,
    }
    new_refs = both.select(*[value[c].alias(c) if value.get(c) is not None else F.col(c) for c in refs.columns])
    season = F.coalesce("season_external_id", F.concat_ws(":", "show_external_id", F.lit("season"), F.col("season_number").cast("string")))
    leaf = staged.where("kind IN ('episode', 'track')").select(*key, F.when(F.col("kind") == "episode", season).otherwise(F.col("album_external_id")).alias("_box"))
    parents = leaf.join(second.select("source_id", F.col("external_id").alias("_box"), F.col("media_item_id").alias("parent_id")), ["source_id", "_box"]).select(*key, "parent_id")
    return Hierarchy(kept.unionByName(_like(created, items)), new_refs, parents, first_errors.unionByName(second_errors), created)


class Created(NamedTuple):
    """Item of each play (id, media_item_id), ids of ambiguous plays, and the new items and identifiers."""

    plays: DataFrame
    ambiguous: DataFrame
    items: DataFrame
    identifiers: DataFrame


def _claims(rows: DataFrame, key: Column, ids: Column, title: Column, year: Column, place: list[Column]) -> DataFrame:
    """One row for each key: its ids, and title and year of the first play. ``place`` has what stands above."""
    named = rows.select("id", key.alias("key"), F.sort_array(F.array_distinct(F.coalesce(ids, F.array().cast("array<struct<provider: string, external_id: string>>")))).alias("ids"), title.alias("title"), year.alias("year"), *place)
    return named.groupBy("key").agg(F.first("ids").alias("ids"), *[F.min_by(c, "id").alias(c) for c in named.columns if c not in ("id", "key", "ids")])


def _settle(claims: DataFrame, kind: str, held: DataFrame | None, identifiers: DataFrame, preferred: DataFrame, start: int, cut: Callable, drop: Callable) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(key, media_item_id or null where ambiguous; new items; new identifiers), the last two None where nothing is new.

    A claim is the stored item of its kind that shares most of its ids (A12); one without ids is the one that ``held`` (key,
    media_item_id; None if each claim has ids) names. The others are new: those that share ids, over any number of steps, are one
    item, with all their ids. ``claims`` is read twice and should be a written table.
    """
    own = identifiers.where(F.col("kind") == kind).select("media_item_id", "provider", "external_id")
    score = history_export.match(claims.select(F.col("key").alias("id"), F.lit(None).cast("string").alias("reason"), "ids"), own, preferred)
    done = claims.join(score.select(F.col("id").alias("key"), "media_item_id", "ambiguous"), "key", "left")
    if held is not None:
        done = done.join(held.select("key", F.col("media_item_id").alias("_held")), "key", "left")
        done = done.withColumn("media_item_id", F.when(F.size("ids") > 0, F.col("media_item_id")).otherwise(F.col("_held"))).drop("_held")
    unmet, counted = F.col("media_item_id").isNull() & F.col("ambiguous").isNull(), Observation()
    done = cut(done.observe(counted, F.count_if(unmet).alias("n")))
    if counted.get.get("n") == 0:  # an empty plan may give no count
        return done.select("key", "media_item_id"), None, None
    new = cut(numbered(done.where(unmet).drop("media_item_id", "ambiguous"), ["key"], 0, "claim"))
    each = new.select("claim", F.explode("ids").alias("i")).select("claim", "i.provider", "i.external_id")
    key = ["provider", "external_id"]
    star = join_by_key(each, each.groupBy(*key).agg(F.min("claim").alias("first"), F.count("*").alias("n")), key, "claim")
    roots = connected_components(star, "claim", "first", cut, drop)
    new = cut(new.join(roots.select(F.col("node").alias("claim"), "root"), "claim", "left").withColumn("root", F.coalesce("root", "claim")))
    rest = [c for c in new.columns if c not in ("key", "ids", "claim", "root")]
    made = cut(numbered(new.groupBy("root").agg(*[F.min_by(c, "claim").alias(c) for c in rest]), ["root"], start))
    given = new.join(made.select("root", F.col("id").alias("media_item_id")), "root")
    names = given.select("media_item_id", F.explode("ids").alias("i")).select("media_item_id", "i.provider", "i.external_id").distinct()
    assigned = done.where("media_item_id IS NOT NULL OR ambiguous IS NOT NULL").select("key", "media_item_id").unionByName(given.select("key", "media_item_id"))
    return cut(assigned), made.drop("root").withColumn("kind", F.lit(kind)), names.withColumn("kind", F.lit(kind))


def create_history(plays: DataFrame, items: DataFrame, identifiers: DataFrame, preferred: DataFrame) -> Created:
    """Items for plays that M31 found none for (id, kind, title, year, ids, and of episodes show_title, show_year, show_ids,
    season, number), with the shows and seasons above them.

    Shows are those that share most ids with the play's show, seasons the one with the lowest id of their show and number, and only
    what is not there is created: from the top down, each once. Movies, shows and episodes without any id are told apart by title
    key and year, or place, and found by these again. A play whose ids, or whose show's ids, fit several items alike is ambiguous.
    """
    kinds = items.select(F.col("id").alias("media_item_id"), "kind")
    ids = identifiers.join(kinds, "media_item_id").select("kind", "media_item_id", "provider", "external_id")
    bare = items.join(identifiers.select(F.col("media_item_id").alias("id")), "id", "left_anti")
    title_of = lambda t, y: F.concat(F.lit("t"), F.to_json(F.struct(t.alias("t"), y.alias("y")), {"ignoreNullFields": "false"}))
    by_ids = lambda c: F.concat(F.lit("i"), F.to_json(F.sort_array(F.array_distinct(c))))
    without = lambda c: F.size(F.coalesce(c, F.array().cast("array<struct<provider: string, external_id: string>>"))) == 0
    is_movie, is_episode, no_ids, no_show_ids = F.col("kind") == "movie", F.col("kind") == "episode", without(F.col("ids")), without(F.col("show_ids"))
    untold = {"movie": is_movie & no_ids, "show": is_episode & no_show_ids, "episode": is_episode & no_ids}
    by_id = F.when(is_movie & ~no_ids, by_ids(F.col("ids"))).when(is_episode & ~no_show_ids, by_ids(F.col("show_ids")))
    # A few files may hold all plays, so these are dealt out first.
    rows, seen = plays.repartition("id").withColumns({"_key": by_id, "_own": F.when(is_episode & ~no_ids, by_ids(F.col("ids"))), "_title": F.lit(None).cast("string")}), Observation()
    rows = written(rows.observe(seen, *[F.count_if(c).alias(k) for k, c in untold.items()]))
    if any(seen.get.get(k) != 0 for k in untold):  # only what has no ids is known by its title
        lacking = untold["movie"] | untold["show"] | untold["episode"]
        told = rows.where(lacking).withColumns({"_title": fn.title_key(F.when(no_ids, F.col("title"))), "_show": fn.title_key(F.when(is_episode & no_show_ids, F.col("show_title")))})
        by_name = F.when(is_movie, title_of(F.col("_title"), F.col("year").cast("int"))).when(is_episode, title_of(F.col("_show"), F.col("show_year").cast("int")))
        before, rows = rows, written(rows.where(~lacking).unionByName(told.withColumn("_key", F.coalesce("_key", by_name)).drop("_show")))
        discard(before)
    used = _after(items)
    made, names = [], []

    def add(new: DataFrame) -> DataFrame:
        nonlocal used
        made.append(written(_like(new, items)))
        used += made[-1].count()
        return made[-1]

    def settle(claims: DataFrame, kind: str, held: DataFrame) -> DataFrame:
        claims = written(claims)
        by_key = held.groupBy("key").agg(F.min("media_item_id").alias("media_item_id")) if seen.get.get(kind) != 0 else None
        assigned, new, given = _settle(claims, kind, by_key, ids, preferred, used, written, discard)
        if new is not None:
            add(new)
            names.append(written(given))
        discard(claims)
        return assigned

    by_title = lambda kind: bare.where(F.col("kind") == kind).select(title_of(fn.title_key("title"), F.col("year").cast("int")).alias("key"), F.col("id").alias("media_item_id"))
    movies, episodes = rows.where("kind = 'movie'"), rows.where("kind = 'episode'")
    movie = settle(_claims(movies, F.col("_key"), F.col("ids"), F.col("title"), F.col("year"), []), "movie", by_title("movie"))
    show = settle(_claims(episodes, F.col("_key"), F.col("show_ids"), F.col("show_title"), F.col("show_year"), []), "show", by_title("show"))
    with_show = episodes.join(show.select(F.col("key").alias("_key"), F.col("media_item_id").alias("show_id")), "_key", "left")

    places = written(with_show.where("show_id IS NOT NULL").select(F.col("show_id").alias("parent_id"), F.col("season").cast("int").alias("season_number")).distinct())
    stored = items.where("kind = 'season'").groupBy("parent_id", "season_number").agg(F.min("id").alias("_id"))
    same = lambda a, b: (a["parent_id"] == b["parent_id"]) & a["season_number"].eqNullSafe(b["season_number"])
    met = places.join(stored, same(places, stored), "left").select(places["parent_id"], places["season_number"], "_id")
    new = numbered(met.where("_id IS NULL").drop("_id"), ["parent_id", "season_number"], used)
    title = F.concat(F.lit("Season "), F.coalesce(F.col("season_number").cast("string"), F.lit("?")))
    added = add(new.select("id", "parent_id", "season_number", title.alias("title"), F.lit("season").alias("kind")))
    seasons = met.where("_id IS NOT NULL").select("parent_id", "season_number", F.col("_id").alias("season_id"))
    seasons = written(seasons.unionByName(added.select("parent_id", "season_number", F.col("id").alias("season_id"))))
    s = seasons.select(F.col("parent_id").alias("_p"), F.col("season_number").alias("_s"), "season_id")
    placed = with_show.join(s, (F.col("show_id") == F.col("_p")) & F.col("season").cast("int").eqNullSafe(F.col("_s")))

    place_of = lambda p, n, t: F.concat(F.lit("p"), F.to_json(F.struct(p.cast("bigint").alias("p"), n.cast("int").alias("n"), F.when(n.isNull(), t).alias("t")), {"ignoreNullFields": "false"}))
    episode_key = F.coalesce("_own", place_of(F.col("season_id"), F.col("number"), F.col("_title")))
    above = [F.col("season_id").alias("parent_id"), F.col("season").cast("int").alias("season_number"), F.col("number").cast("int").alias("episode_number")]
    named = fn.title_key(F.when(F.col("episode_number").isNull(), F.col("title")))
    held = bare.where("kind = 'episode'").select(place_of(F.col("parent_id"), F.col("episode_number"), named).alias("key"), F.col("id").alias("media_item_id"))
    placed = written(placed.select("id", "title", "ids", "season", "number", "season_id", episode_key.alias("_key")))
    episode = settle(_claims(placed, F.col("_key"), F.col("ids"), F.col("title"), F.lit(None).cast("int"), above), "episode", held)
    given = lambda df, found: df.select("id", F.col("_key").alias("key")).join(found, "key", "left").select("id", "media_item_id")
    assigned = written(given(movies, movie).unionByName(given(placed, episode)))
    lost = with_show.where("show_id IS NULL").select("id")
    return Created(
        assigned.where("media_item_id IS NOT NULL"), assigned.where("media_item_id IS NULL").select("id").unionByName(lost), _union(made), _union(names or [identifiers.limit(0)]).select("media_item_id", "provider", "external_id")
    )
