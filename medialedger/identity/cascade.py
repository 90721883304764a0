"""M24, M25, M26 as one cascade: merged shows merge their seasons, these their episodes, and all of it is one remap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from medialedger.identity import merge

Cut = Callable[[DataFrame], DataFrame]


def compressed(remap: DataFrame, cut: Cut, drop: Callable[[DataFrame], None]) -> DataFrame:
    """(media_item_id, winner_id) with every chain of winners replaced by its end; each pass halves the chains. No cycles."""
    while True:
        ends = remap.select(F.col("media_item_id").alias("winner_id"), F.col("winner_id").alias("_end"))
        shorter = cut(remap.join(ends, "winner_id", "left").select("media_item_id", F.coalesce("_end", "winner_id").alias("winner_id"), F.col("_end").isNotNull().alias("_moved")))
        drop(remap)
        remap = shorter.select("media_item_id", "winner_id")
        remap._scratch = shorter._scratch
        if shorter.where("_moved").isEmpty():
            return remap


def season_steps(seasons: DataFrame, losers: DataFrame) -> DataFrame:
    """(id, target, merged) for the seasons of losing shows (``losers``: show, winner), one losing show of each winner at a time.

    A season goes into the winner's one season of its number. Where there is none the first of them moves to the winner, and the
    others of that number go into it; where there are several it moves.
    """
    lost = seasons.join(losers, F.col("parent") == F.col("show")).select("id", "number", "winner")
    own = seasons.groupBy(F.col("parent").alias("_show"), F.col("number").alias("_number")).agg(F.count("*").alias("_n"), F.min("id").alias("_match"))
    met = lost.join(own, (F.col("winner") == F.col("_show")) & F.col("number").eqNullSafe(F.col("_number")), "left")
    first = F.min("id").over(W.partitionBy("winner", "number"))
    match = F.when(F.col("_n") == 1, F.col("_match")).when(F.col("_n").isNull() & (F.col("id") != first), first)
    return met.select("id", F.coalesce(match, "winner").alias("target"), match.isNotNull().alias("merged"))


def episode_steps(waiting: DataFrame, children: DataFrame, identifiers: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, target, merged, season) for the episodes of merged seasons that can be decided now (``waiting``: id, season, place).

    An episode waits for those before it, by place, that come to the same season with one of its identifiers: they may be what it is
    merged with. It is merged with the one child of the season that shares an identifier, if both have references and no source has
    both; else it moves to the season.
    """
    ids = identifiers.select(F.col("media_item_id").alias("id"), "provider", "external_id").distinct()
    mine = waiting.join(ids, "id")
    key = ["season", "provider", "external_id"]
    first = mine.groupBy(*key).agg(F.min("place").alias("_first"))
    held_up = mine.join(first, key).where("place > _first").select("id").distinct()
    ready = waiting.join(held_up, "id", "left_anti").select("id", "season")
    theirs = children.select(F.col("id").alias("match"), F.col("parent").alias("season")).join(ids.withColumnRenamed("id", "match"), "match")
    shared = ready.join(ids, "id").join(theirs, key).groupBy("id").agg(F.min("match").alias("match"), F.max("match").alias("_high")).where("match = _high").select("id", "match")
    held = refs.select(F.col("media_item_id").alias("id"), "source_id").distinct()
    owners = shared.join(held, "id").select("id", "match", "source_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    owners = owners.unionByName(shared.join(held.withColumnRenamed("id", "match"), "match").select("id", "match", "source_id", F.lit(0).alias("a"), F.lit(1).alias("b")))
    by_source = owners.groupBy("id", "match", "source_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    safe = by_source.groupBy("id", "match").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max(F.col("a") + F.col("b")).alias("most")).where("a > 0 AND b > 0 AND most = 1")
    out = ready.join(safe.select("id", "match"), "id", "left")
    return out.select("id", F.coalesce("match", "season").alias("target"), F.col("match").isNotNull().alias("merged"), "season")


def cascade(items: DataFrame, identifiers: DataFrame, refs: DataFrame, sources: DataFrame, cut: Cut, drop: Callable[[DataFrame], None]) -> tuple[DataFrame, DataFrame]:
    """(remap: media_item_id, winner_id; moved: id, parent_id) of all duplicate groups that may merge and of what lies below them.

    Groups and winners are those of M23 and M24. Losing shows of a winner are taken one after the other, by id, those of all winners
    at once; their seasons and episodes go as ``season_steps`` and ``episode_steps`` say, each seeing what was done before. ``remap``
    has no chains, so that every child table (events, states, references, identifiers, genres, images) takes it in one join
    (``merge.remap``); ``moved`` has the new parents of items that stay. There are as many rounds as the largest group has losing
    shows; only items below shows that merge are read after the first step.
    """
    plan = cut(merge.merge_plan(cut(merge.groups(items, identifiers, cut, drop=drop)), refs, sources))
    shows = plan.join(items.where("kind = 'show'").select(F.col("id").alias("media_item_id")), "media_item_id")
    shows = cut(shows.select(F.col("media_item_id").alias("show"), F.col("winner_id").alias("winner"), F.row_number().over(W.partitionBy("winner_id").orderBy("media_item_id")).alias("turn")))
    rounds = shows.agg(F.max("turn")).first()[0] or 0
    every = shows.select("show").unionByName(shows.select(F.col("winner").alias("show"))).distinct()
    seasons = cut(items.where("kind = 'season'").join(every, F.col("parent_id") == F.col("show")).select("id", F.col("parent_id").alias("parent"), F.col("season_number").alias("number")))
    below = items.join(seasons.select(F.col("id").alias("_season")), F.col("parent_id") == F.col("_season"))
    children = cut(below.select("id", F.col("parent_id").alias("parent"), "kind"))
    own = children.select(F.col("id").alias("media_item_id"))
    ids = cut(identifiers.join(own, "media_item_id", "left_semi").select("media_item_id", "provider", "external_id"))
    held = cut(refs.join(own, "media_item_id", "left_semi").select("media_item_id", "source_id"))
    merged, moved = [plan], []

    def passed(rows: DataFrame, steps: DataFrame) -> DataFrame:
        """Rows of child tables with merged items in their winners' place."""
        to = steps.where("merged").select(F.col("id").alias("media_item_id"), F.col("target").alias("_to"))
        return cut(rows.join(to, "media_item_id", "left").withColumn("media_item_id", F.coalesce("_to", "media_item_id")).drop("_to").distinct())

    def placed(rows: DataFrame, steps: DataFrame, parent: str) -> DataFrame:
        """Without the merged ones, the others of the steps below their new parents."""
        done = steps.select("id", "merged", F.col(parent).alias("_parent"))
        return cut(rows.join(done, "id", "left").where("NOT coalesce(merged, false)").withColumn("parent", F.coalesce("_parent", "parent")).drop("merged", "_parent"))

    for turn in range(1, rounds + 1):
        steps = cut(season_steps(seasons, shows.where(F.col("turn") == turn).select("show", "winner")))
        gone = steps.where("merged").select(F.col("id").alias("parent"), F.col("target").alias("season"))
        lost = children.where("kind = 'episode'").join(gone, "parent")
        waiting = cut(lost.select("id", "season", F.struct("parent", "id").alias("place")))
        while not waiting.isEmpty():
            done = cut(episode_steps(waiting, children, ids, held))
            merged.append(done.where("merged").select(F.col("id").alias("media_item_id"), F.col("target").alias("winner_id")))
            moved.append(done.where("NOT merged").select("id", F.col("season").alias("parent_id")))
            before = children, ids, held, waiting
            children, ids, held = placed(children, done, "season"), passed(ids, done), passed(held, done)
            waiting = cut(waiting.join(done.select("id"), "id", "left_anti"))
            for t in before:
                drop(t)
        merged.append(steps.where("merged").select(F.col("id").alias("media_item_id"), F.col("target").alias("winner_id")))
        moved.append(steps.where("NOT merged").select("id", F.col("target").alias("parent_id")))
        before, seasons = seasons, placed(seasons, steps, "target")
        drop(before)
    remap = merged[0]
    for m in merged[1:]:
        remap = remap.unionByName(m)
    remap = compressed(cut(remap), cut, drop)
    # What lay below a merged item and is no episode or season of the steps follows its parent.
    rest = items.join(remap.select(F.col("media_item_id").alias("parent_id"), F.col("winner_id").alias("_to")), "parent_id").select("id", F.col("_to").alias("parent_id"))
    later = rest.limit(0)
    for m in moved:
        later = later.unionByName(m)
    follow = rest.join(later.select("id"), "id", "left_anti").unionByName(later)
    ends = remap.select(F.col("media_item_id").alias("parent_id"), F.col("winner_id").alias("_to"))
    follow = follow.join(ends, "parent_id", "left").select("id", F.coalesce("_to", "parent_id").alias("parent_id"))
    return remap, cut(follow.join(remap.select(F.col("media_item_id").alias("id")), "id", "left_anti"))


def apply_cascade(items: DataFrame, remap: DataFrame, moved: DataFrame) -> DataFrame:
    """Items without the losers, below their new parents; see ``matching.fill_missing`` for the winners' fields."""
    kept = items.join(remap.select(F.col("media_item_id").alias("id")), "id", "left_anti").join(moved.withColumnRenamed("parent_id", "_parent"), "id", "left")
    return kept.select(*[F.coalesce("_parent", "parent_id").alias(c) if c == "parent_id" else F.col(c) for c in items.columns])
