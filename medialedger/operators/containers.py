"""Shows and seasons that staged episodes belong to: which stored container each is, and their references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialedger import functions as fn


def match_containers(staged: DataFrame, staged_ids: DataFrame, items: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Each staged container (source_id, external_id, kind, title, parent_id, season_number) with match_status (matched, new,
    ambiguous) and media_item_id if matched.

    First by shared identifiers among items of the kind, ties broken by the title key (P03: without accents); a container without such a match is looked
    up by its place: a show by its title key among shows of the same parent (usually none), a season by parent and number. Several
    are ambiguous, an error row of the caller. The smallest and the largest item tell one match from several.
    """
    key = ["source_id", "external_id"]
    stored = items.select(F.col("id").alias("media_item_id"), F.col("kind").alias("_kind"), fn.title_key("title").alias("_title"), F.col("parent_id").alias("_parent"), F.col("season_number").alias("_number"))
    wanted = staged.select(*key, "kind", fn.title_key("title").alias("_wanted"), "parent_id", "season_number")
    ids = wanted.join(staged_ids.select(*key, "provider", "identifier"), key)
    own = identifiers.select("provider", F.col("external_id").alias("identifier"), "media_item_id").join(stored, "media_item_id")
    met = ids.join(own, ["provider", "identifier"]).where("kind = _kind")
    ends = lambda c, p: [F.min(c).alias(f"{p}_low"), F.max(c).alias(f"{p}_high")]
    alike = F.when(F.col("_title") == F.col("_wanted"), F.col("media_item_id"))
    by_id = met.groupBy(*key).agg(*ends(F.col("media_item_id"), "any"), *ends(alike, "alike"))
    several = F.col("any_low") != F.col("any_high")
    by_id = by_id.select(
        *key, F.when(several, F.col("alike_low")).otherwise(F.col("any_low")).alias("id_low"), F.when(several, F.col("alike_high")).otherwise(F.col("any_high")).alias("id_high")
    )
    shows = wanted.where("kind = 'show'").join(stored, (F.col("_wanted") == F.col("_title")) & F.col("parent_id").eqNullSafe(F.col("_parent")) & (F.col("_kind") == "show"))
    seasons = wanted.where("kind = 'season'").join(stored, F.col("parent_id").eqNullSafe(F.col("_parent")) & F.col("season_number").eqNullSafe(F.col("_number")) & (F.col("_kind") == "season"))
    place = lambda df: df.select(*key, "media_item_id")
    by_place = place(shows).unionByName(place(seasons)).groupBy(*key).agg(*ends(F.col("media_item_id"), "place"))
    rows = staged.join(by_id, key, "left").join(by_place, key, "left")
    low, high = F.coalesce("id_low", "place_low"), F.when(F.col("id_low").isNotNull(), F.col("id_high")).otherwise(F.col("place_high"))
    status = F.when(low.isNull(), "new").when(low != high, "ambiguous").otherwise("matched")
    return rows.select(*staged.columns, status.alias("match_status"), F.when(status == "matched", low).alias("media_item_id"))


def bind_hierarchy(refs: DataFrame, matched: DataFrame, items: DataFrame, observed_at: object) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the new version of ``refs``, shows with their new titles, error rows) after matched episodes named their containers.

    ``matched`` has source_id, external_id, library_id, media_item_id, season_number, show_external_id, show_title and
    season_external_id (null: made from the show's). The show and season above the stored episode get the source's references, new
    or refreshed. An episode that lies in no season of that number of a show, or whose container's reference names another item, is
    an error and changes nothing. Each level is looked up among the items of its kind, so that others of the same id give no rows.
    """
    up = lambda n, kind: items.where(F.col("kind") == kind).select(F.col("id").alias(f"{n}_id"), F.col("parent_id").alias(f"{n}_up"), F.col("season_number").alias(f"{n}_number"))
    ref = lambda n: refs.select("source_id", F.col("external_id").alias(f"{n}_ext"), F.col("media_item_id").alias(f"{n}_ref"))
    season = F.coalesce("season_external_id", F.concat_ws(":", "show_external_id", F.lit("season"), F.col("season_number").cast("string")))
    rows = matched.withColumn("s_ext", season).withColumn("h_ext", F.col("show_external_id"))
    rows = rows.join(up("e", "episode"), F.col("media_item_id") == F.col("e_id"), "left").join(up("s", "season"), F.col("e_up") == F.col("s_id"), "left")
    rows = rows.join(up("h", "show"), F.col("s_up") == F.col("h_id"), "left")
    rows = rows.join(ref("s"), ["source_id", "s_ext"], "left").join(ref("h"), ["source_id", "h_ext"], "left")
    fits = F.col("h_id").isNotNull() & F.col("s_number").eqNullSafe(F.col("season_number"))
    clash = F.coalesce(F.col("s_ref") != F.col("s_id"), F.lit(False)) | F.coalesce(F.col("h_ref") != F.col("h_id"), F.lit(False))
    message = F.when(~F.coalesce(fits, F.lit(False)), "incompatible hierarchy").when(clash, "conflicting container")
    rows = rows.withColumn("message", message)
    good = rows.where("message IS NULL")
    # Episodes of one batch may name two items by one new reference; the smallest item keeps it.
    parts = [good.select("source_id", "library_id", F.col(f"{n}_ext").alias("external_id"), F.col(f"{n}_id").alias("media_item_id")) for n in ("s", "h")]
    new = parts[0].unionByName(parts[1]).groupBy("source_id", "external_id").agg(F.min(F.struct("media_item_id", "library_id")).alias("n"))
    since = "unavailable_since" in refs.columns
    both = refs.join(new, ["source_id", "external_id"], "full")
    hit = F.col("n").isNotNull()
    value = {
        "media_item_id": F.coalesce("media_item_id", "n.media_item_id"), "library_id": F.coalesce("library_id", "n.library_id"), "available": F.when(hit, True).otherwise(F.col("available")),
        "last_seen_at": F.when(hit, F.lit(observed_at).cast("timestamp_ntz")).otherwise(F.col("last_seen_at")) if "last_seen_at" in refs.columns else None,
        "unavailable_since": F.when(~hit, F.col("unavailable_since")) if since else None,
    }
    bound = both.select(*[value[c].alias(c) if value.get(c) is not None else F.col(c) for c in refs.columns])
    titles = good.groupBy(F.col("h_id").alias("id")).agg(F.max_by("show_title", F.struct("source_id", "external_id")).alias("title"))
    return bound, titles, rows.where("message IS NOT NULL").select("source_id", "external_id", "message")
