"""Data-quality checks; each returns the violating rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Q01: keys that occur twice or more; as in SQL, keys with a null never do."""
    known = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in key))
    return known.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Q02: rows whose reference has no parent; null references are none."""
    keys = parents.select(F.col(parent_key).alias(column)).distinct()
    return rows.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


#: The keys and references of the tables (Q01, Q02): table -> keys, and (table, columns, parent, parent's columns).
KEYS = {
    "sources": [("id",)], "libraries": [("id",), ("source_id", "external_id")], "items": [("id",)], "refs": [("source_id", "external_id")],
    "identifiers": [("media_item_id", "provider", "external_id")], "genres": [("media_item_id", "normalized_name")], "images": [("media_item_id", "image_type")],
    "records": [("media_item_id", "provider")], "events": [("id",), ("source_id", "source_event_id"), ("source_id", "dedup_key")], "states": [("media_item_id", "source_id")],
    "runs": [("id",)], "run_libraries": [("run_id", "library_id")], "marks": [("library_id",)], "outbox": [("dedup_key",)],
}
REFERENCES = [
    ("libraries", ("source_id",), "sources", ("id",)), ("items", ("parent_id",), "items", ("id",)), ("refs", ("source_id",), "sources", ("id",)), ("refs", ("media_item_id",), "items", ("id",)),
    ("refs", ("library_id",), "libraries", ("id",)), ("identifiers", ("media_item_id",), "items", ("id",)), ("genres", ("media_item_id",), "items", ("id",)), ("images", ("media_item_id",), "items", ("id",)),
    ("records", ("media_item_id",), "items", ("id",)), ("events", ("media_item_id",), "items", ("id",)), ("events", ("source_id",), "sources", ("id",)), ("states", ("media_item_id",), "items", ("id",)),
    ("states", ("source_id",), "sources", ("id",)), ("runs", ("source_id",), "sources", ("id",)), ("run_libraries", ("run_id",), "runs", ("id",)), ("run_libraries", ("library_id",), "libraries", ("id",)),
    ("marks", ("library_id",), "libraries", ("id",)),
]


def violations(tables: dict[str, DataFrame], keys: dict[str, list[tuple[str, ...]]] = KEYS, references: list[tuple] = REFERENCES) -> DataFrame:
    """Q01, Q02 for all keys and references at once: (constraint, value, n) of every value of a key that occurs twice or more (how
    often), and of every reference without a parent (how many rows have it).

    Tables that are not given, and keys and references whose columns a table lacks, are left out; values with a null are no
    violation. Rows of all constraints are stacked as (constraint, value as JSON, child or parent) and counted in one shuffle; they
    are summed before it, so a value that very many rows refer to costs one row for each task.
    """
    has = lambda t, cs: t in tables and set(cs) <= set(tables[t].columns)
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def values(table: str, columns: tuple[str, ...], constraint: str, child: Column, parent: Column, unique: bool) -> DataFrame:
        rows = tables[table].where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
        value = F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))
        return rows.select(F.lit(constraint).alias("constraint"), value.alias("value"), child.alias("child"), parent.alias("parent"), F.lit(unique).alias("unique"))

    parts = [values(t, k, f"{t}({', '.join(k)}) unique", one, none, True) for t, ks in keys.items() for k in ks if has(t, k)]
    for table, columns, parent, theirs in references:
        if has(table, columns) and has(parent, theirs):
            name = f"{table}({', '.join(columns)}) in {parent}"
            parts += [values(table, columns, name, one, none, False), values(parent, theirs, name, none, one, False)]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    counted = stacked.groupBy("constraint", "value", "unique").agg(F.sum("child").alias("n"), F.sum("parent").alias("parents"))
    return counted.where("(unique AND n > 1) OR (NOT unique AND n > 0 AND parents = 0)").select("constraint", "value", "n")


def outside(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Q03, Q04: rows that fail a check, with the names of all that fail; a check that is null passes."""
    failed = F.array_compact(F.array(*[F.when(~check, F.lit(name)) for name, check in checks.items()]))
    return rows.withColumn("reasons", failed).where(F.size("reasons") > 0)


def item_checks() -> dict[str, Column]:
    """Q04: what a staged item needs."""
    full = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    here = lambda *cs: ~F.greatest(*[F.col(c).isNull() for c in cs], F.lit(False))
    return {
        "external_id": full("external_id"), "title": full("title"), "duration": F.col("duration_ms") >= 0, "views": F.col("view_count") >= 0,
        "episode": (F.col("kind") != "episode") | here("show_external_id", "season_number", "episode_number"),
        "track": (F.col("kind") != "track") | here("artist_external_id", "album_external_id"),
    }
