"""Bulk history exports: files named watched-history-N.json, each a JSON array of plays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialedger.sources import large_json
from medialedger.tables import written

_IDS = "STRUCT<trakt: STRING, imdb: STRING, tmdb: STRING, tvdb: STRING, plex: STRUCT<guid: STRING>>"
_TITLE = f"STRUCT<title: STRING, year: INT, season: INT, number: INT, ids: {_IDS}>"
SCHEMA = f"id STRING, watched_at STRING, type STRING, movie {_TITLE}, episode {_TITLE}, show {_TITLE}, _corrupt STRING"


def read_export(spark: SparkSession, folder: str) -> DataFrame:
    """The plays of all exports in a folder, with ``file_number``. Files of other names are ignored, and large ones are read by
    many tasks. A play that can't be parsed has the reason "broken JSON"."""
    objects = large_json.array_objects(spark, folder, "watched-history-*.json")
    row = F.from_json("value", SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})
    number = F.regexp_extract("path", r"watched-history-(\d+)\.json", 1).cast("int")
    return plays(objects.select(number.alias("file_number"), row.alias("r")).select("file_number", "r.*"))


def plays(raw: DataFrame) -> DataFrame:
    """One row for each play of ``raw`` (SCHEMA, file_number if there is one): file_number, id, kind, watched_at (UTC),
    title, show_title, year, season, number, ids, reason. ``reason`` is null for valid rows; broken ones are kept with theirs."""
    what = F.coalesce("movie", "episode")
    at = F.try_to_timestamp("watched_at")
    prefix = lambda p, c: F.when(F.nullif(F.trim(c), F.lit("")).isNotNull(), F.struct(F.lit(p).alias("provider"), F.trim(c).alias("external_id")))
    ids = [prefix(p, what["ids"][p]) for p in ("trakt", "imdb", "tmdb", "tvdb")] + [prefix("plex", F.regexp_replace(what["ids"]["plex"]["guid"], "^plex://", ""))]
    kept = F.array_sort(F.array_distinct(F.filter(F.array_compact(F.array(*ids)), lambda s: F.length(s["external_id"]) <= 255)))
    reason = (
        F.when(F.col("_corrupt").isNotNull(), "broken JSON").when(F.col("id").isNull(), "no id").when(at.isNull(), "no time")
        .when(~F.col("type").isin("movie", "episode") | F.col("type").isNull(), "unknown type").when(what["title"].isNull() & F.col("show.title").isNull(), "no title")
    )
    file_number = F.col("file_number") if "file_number" in raw.columns else F.lit(None).cast("int")
    return raw.select(
        file_number.alias("file_number"), "id", F.col("type").alias("kind"), at.alias("watched_at"), what["title"].alias("title"), F.col("show.title").alias("show_title"),
        what["year"].alias("year"), F.col("episode.season").alias("season"), F.col("episode.number").alias("number"), kept.alias("ids"), reason.alias("reason"),
    )


def match(plays: DataFrame, identifiers: DataFrame, preferred: DataFrame) -> DataFrame:
    """For each play the item that shares most of its ids; ties go to the one preferred item (media_item_id), else ambiguous.

    Returns id, media_item_id (null if nothing or no single item matches), ambiguous. An item that shares two ids or more with a play
    shares one besides the id that most items have, so plays meet items by the others only; where no item shares two, what each id's
    items come to (how many, the smallest) is the answer. An id that very many items have thus costs their number and not their
    pairs with plays. Plays with the same known ids are looked up once.

    Both sides of every join grow with the input, and the sizes that Spark expects of them, by their files, are far below those that
    they have in memory; so they are merged and never sent to the driver.
    """
    one = F.struct("provider", "external_id").alias("i")
    marks = preferred.select("media_item_id").distinct().withColumn("p", F.lit(True)).hint("merge")
    named = identifiers.where("provider IS NOT NULL AND external_id IS NOT NULL").select("media_item_id", one).distinct()
    summed = (F.count("*").alias("n"), F.min("media_item_id").alias("only"), F.count_if("p").alias("n_p"), F.min(F.when(F.col("p"), F.col("media_item_id"))).alias("only_p"))
    per_id = named.join(marks, "media_item_id", "left").groupBy("i").agg(*summed)
    wanted = plays.where("reason IS NULL").select("id", F.explode("ids").alias("i")).select("id", F.struct("i.provider", "i.external_id").alias("i")).distinct()
    known = wanted.join(per_id.hint("merge"), "i").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "i", "only", "n_p", "only_p"))).alias("ids"))  # the rarest first
    several = known.where(F.size("ids") > 1).select("ids").distinct().select(F.col("ids.i").alias("all"))
    met = several.select("all", F.explode(F.slice("all", 1, F.size("all") - 1)).alias("i")).join(named.hint("merge"), "i").select("all", "media_item_id").distinct()
    own = named.groupBy("media_item_id").agg(F.collect_list("i").alias("own"))
    scored = met.join(own.hint("merge"), "media_item_id").select("all", "media_item_id", F.size(F.array_intersect("all", "own")).alias("score")).where("score > 1")
    ties = scored.join(marks, "media_item_id", "left").groupBy("all", "score").agg(*summed)
    best = ties.groupBy("all").agg(F.max_by(F.struct("n", "only", "n_p", "only_p"), "score").alias("b"))
    total = lambda c: F.aggregate("ids", F.lit(0).cast("bigint"), lambda acc, x: acc + x[c])
    least = lambda c: F.array_min(F.transform("ids", lambda x: x[c]))
    alone = F.struct(total("n").alias("n"), least("only").alias("only"), total("n_p").alias("n_p"), least("only_p").alias("only_p"))
    rows = known.withColumn("all", F.col("ids.i")).join(best.hint("merge"), "all", "left").select("id", F.coalesce("b", alone).alias("b"))
    chosen = F.when(F.col("b.n") == 1, F.col("b.only")).when(F.col("b.n_p") == 1, F.col("b.only_p"))
    return rows.select("id", chosen.alias("media_item_id"), chosen.isNull().alias("ambiguous"))


def match_in_rounds(plays: DataFrame, identifiers: DataFrame, preferred: DataFrame, show_of: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched plays: id, media_item_id, round; ids of ambiguous plays; identifiers added) in two rounds of A12.

    What the first round matches gives its ids to the item, and to the item's show (``show_of``: media_item_id, show_id) the ids of
    the play's show (``show_ids``, if the plays have that column), so that plays of the second round can match through them. Plays
    in neither table have no item yet and need new ones (M32); the import then continues with these. An identifier that some item
    has already is not added to another. Each round and what it adds is written once, whatever is counted or read of it; as in
    ``match``, joins are merged.
    """
    first = written(match(plays, identifiers, preferred))
    one = first.where("media_item_id IS NOT NULL").select("id", "media_item_id")
    found = plays.join(one.hint("merge"), "id")
    named = found.select("media_item_id", F.explode("ids").alias("i")).select("media_item_id", "i.provider", "i.external_id")
    if "show_ids" in plays.columns:
        shows = found.join(show_of.hint("merge"), "media_item_id").select(F.col("show_id").alias("media_item_id"), F.explode("show_ids").alias("i"))
        named = named.unionByName(shows.select("media_item_id", "i.provider", "i.external_id"))
    free = named.join(identifiers.select("provider", "external_id").distinct().hint("merge"), ["provider", "external_id"], "left_anti")
    added = written(free.groupBy("provider", "external_id").agg(F.min("media_item_id").alias("media_item_id")).select("media_item_id", "provider", "external_id"))
    rest = plays.join(first.select("id").hint("merge"), "id", "left_anti")
    second = written(match(rest, identifiers.select("media_item_id", "provider", "external_id").unionByName(added), preferred))
    two = second.where("media_item_id IS NOT NULL").select("id", "media_item_id")
    matched = one.withColumn("round", F.lit(1)).unionByName(two.withColumn("round", F.lit(2)))
    return matched, first.where("ambiguous").select("id").unionByName(second.where("ambiguous").select("id")), added
