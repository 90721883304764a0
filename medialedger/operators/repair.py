"""Rows that fail once: the duplicates they point at are merged, and they are tried a second time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialedger.identity import matching, merge


def implicated(failed: DataFrame, staged_ids: DataFrame, show_ids: DataFrame, items: DataFrame, identifiers: DataFrame) -> DataFrame:
    """The stored identifiers that failing rows name: by their own ids for items of their kind, by their shows' ids for shows."""
    key = ["source_id", "external_id"]
    own = failed.select(*key, "kind").join(staged_ids, key).select("kind", "provider", "identifier")
    shows = failed.where("kind = 'episode'").select(*key).join(show_ids, key).select(F.lit("show").alias("kind"), "provider", "identifier")
    named = own.unionByName(shows).distinct().withColumnRenamed("identifier", "external_id")
    kinds = items.select(F.col("id").alias("media_item_id"), "kind")
    return identifiers.join(kinds, "media_item_id").join(named, ["kind", "provider", "external_id"], "left_semi").select("media_item_id", "provider", "external_id")


def resolve_with_repair(staged: DataFrame, staged_ids: DataFrame, show_ids: DataFrame, items: DataFrame, identifiers: DataFrame, refs: DataFrame, sources: DataFrame,
                        cut: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(every staged row as ``matching.resolve`` has it, the merge plan of the repair, error rows).

    Rows that are ambiguous the first time have the duplicate items merged that share the identifiers they name, as far as M24
    allows, and are resolved once more against the merged catalog; only these rows run twice. Those that fail again are errors
    (item_persistence), those that a merge helped leave a note (catalog_auto_reconciled); all other rows go on as they are.
    """
    key = ["source_id", "external_id"]
    first = cut(matching.resolve(staged, staged_ids, items, identifiers, refs))
    failed = first.where("match_status = 'ambiguous'").select(*staged.columns)
    named = implicated(failed, staged_ids, show_ids, items, identifiers)
    members = merge.groups(items, named, cut, (*merge.KINDS, "episode"))
    plan = cut(merge.merge_plan(members, refs, sources))
    merged_ids = merge.remap(identifiers, plan, ["media_item_id", "provider", "external_id"])
    merged_refs = refs.join(plan, "media_item_id", "left").withColumn("media_item_id", F.coalesce("winner_id", "media_item_id")).select(*refs.columns)
    left = items.join(plan.select(F.col("media_item_id").alias("id")), "id", "left_anti")
    second = cut(matching.resolve(failed, staged_ids.join(failed.select(*key), key, "left_semi"), left, merged_ids, merged_refs))
    moved = first.where("match_status <> 'ambiguous'").join(plan, "media_item_id", "left").withColumn("media_item_id", F.coalesce("winner_id", "media_item_id"))
    out = moved.select(*first.columns).unionByName(second)
    ok = F.col("match_status") != "ambiguous"
    errors = second.select(
        *key, F.when(ok, "catalog_auto_reconciled").otherwise("item_persistence").alias("category"), F.when(ok, "repaired before the second attempt").otherwise("several items match").alias("message")
    )
    return out, plan, errors
