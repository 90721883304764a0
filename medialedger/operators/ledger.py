"""The ledger of completed plays: near-duplicate fold, upserts, state merges, availability."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from medialedger import functions as fn
from medialedger import tables

GAP_SECONDS = 120
EVENT = ("media_item_id", "source_id", "source_event_id", "dedup_key", "watched_at", "completed", "progress_ms", "duration_ms", "view_number", "playback_user", "origin")
STATE = ("media_item_id", "source_id", "view_count", "last_watched_at", "completed", "progress_ms", "observed_at")


def without_near_duplicates(events: DataFrame, gap_seconds: int = GAP_SECONDS, slice_seconds: int = 86_400, columns: tuple[str, ...] = ()) -> DataFrame:
    """Completed events of which none lies within the gap (inclusive) of an earlier kept one of its item, with further ``columns``.

    Order is (watched_at, source_id, id). An item's time is cut into slices, which are folded by themselves, so a busy item is
    spread over its slices; of plays at one time only the first is carried along. Where the first play of a slice lies within the
    gap of the last one before, the slices are folded again with what the one before kept last, until nothing changes: mostly
    once or twice, at worst as often as one chain of such plays has slices. A slice's times (8 bytes each) are held by one task.
    """
    gap, width = gap_seconds * 1_000_000, slice_seconds * 1_000_000
    key = ["media_item_id", "slice"]
    micros = F.unix_micros(F.col("watched_at").cast("timestamp"))
    rows = events.where("completed").select("id", "media_item_id", "source_id", "watched_at", *columns, micros.alias("t"))
    first = rows.groupBy("media_item_id", "t").agg(F.min(F.struct("source_id", "id", "watched_at", *columns)).alias("e")).withColumn("slice", F.floor(F.col("t") / width))
    held = first.groupBy(*key).agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def folded(last: Column) -> Column:
        """(the times kept, the last of them) after a play that was kept at ``last`` (null: none)."""
        start = F.struct(last.alias("last"), F.array().cast("array<bigint>").alias("kept"))
        far = lambda acc, t: acc["last"].isNull() | (t - acc["last"] > gap)
        return F.aggregate("ts", start, lambda acc, t: F.when(far(acc, t), F.struct(t.alias("last"), F.concat(acc["kept"], F.array(t)).alias("kept"))).otherwise(acc))

    by_item = W.partitionBy("media_item_id").orderBy("slice")
    near = F.coalesce(F.element_at("ts", 1) - F.lag(F.element_at("ts", -1)).over(by_item) <= gap, F.lit(False))
    none = F.lit(None).cast("bigint")
    slices = tables.written(held.withColumn("near", near).withColumn("carried", none).withColumn("last", folded(none)["last"]))
    while True:
        # Only what a slice before kept last can change a slice that begins near it.
        carried = F.when(F.col("near"), F.lag("last").over(by_item))
        moved = slices.withColumn("now", carried)
        if moved.where("NOT now <=> carried").isEmpty():
            break
        again = moved.select(*key, "ts", "near", F.col("now").alias("carried"), F.when(F.col("now").eqNullSafe(F.col("carried")), F.col("last")).otherwise(folded(F.col("now"))["last"]).alias("last"))
        before, slices = slices, tables.written(again)
        tables.discard(before)
    kept = slices.select("media_item_id", F.explode(folded(F.col("carried"))["kept"]).alias("t"))
    out = first.join(kept, ["media_item_id", "t"])
    return out.select(F.col("e.id").alias("id"), "media_item_id", *[F.col(f"e.{c}").alias(c) for c in ("source_id", "watched_at", *columns)])


class Persisted(NamedTuple):
    """What M14 made of a batch: stored events (EVENT) with their new values, events to insert (``seq`` and EVENT), and error rows."""

    kept: DataFrame
    inserted: DataFrame
    errors: DataFrame


def persist_events(stored: DataFrame, batch: DataFrame, refs: DataFrame, gap_seconds: int = GAP_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(the new version of ``stored`` with its columns EVENT, error rows of the batch with a ``message``); see ``merge_events``."""
    done = merge_events(stored, batch, refs, gap_seconds)
    return done.kept.select(*EVENT).unionByName(done.inserted.select(*EVENT)), done.errors


def persist_with_states(stored: DataFrame, states: DataFrame, batch: DataFrame, refs: DataFrame, gap_seconds: int = GAP_SECONDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the new versions of the events and of the states (STATE), error rows) after a batch.

    The new events are written between the steps: ``tables.written`` holds them while both results are read.
    """
    done = merge_events(stored, batch, refs, gap_seconds)
    inserted = tables.written(done.inserted)
    events = done.kept.select(*EVENT).unionByName(inserted.select(*EVENT))
    key = ["media_item_id", "source_id"]
    counts = events.where("completed").join(inserted.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.count("*").alias("n"))
    return events, apply_events(states, inserted, counts), done.errors


def merge_events(stored: DataFrame, batch: DataFrame, refs: DataFrame, gap_seconds: int = GAP_SECONDS) -> Persisted:
    """A batch of events against the stored ones.

    ``batch`` has media_external_id in place of the item and the key, and a unique ``seq`` that gives its order. Incomplete
    events are dropped, unknown media are errors. An event stored under the same source_event_id takes the new values (another
    item is an error; within a batch the first row names the item and the last one gives the values). Then repeats of a
    dedup_key are dropped, and events within the gap of a stored one of their item; what is left is folded by itself. Further
    columns of ``stored`` stay with their rows. Each step that later ones read more than once is written, so none is done again.
    """
    extra = [c for c in stored.columns if c not in EVENT and c != "id"]
    known = refs.select("source_id", F.col("external_id").alias("media_external_id"), "media_item_id")
    parts = [F.col(c) for c in ("source_id", "source_event_id", "media_external_id", "watched_at", "completed", "progress_ms", "duration_ms", "view_number")]
    every = batch.where("completed").join(known, ["media_external_id", "source_id"], "left")
    every = tables.written(every.withColumn("dedup_key", F.when(F.col("media_item_id").isNotNull(), fn.event_key(*parts))))
    unknown = every.where("media_item_id IS NULL").withColumn("message", F.lit("unknown media"))
    rows = every.where("media_item_id IS NOT NULL").select("seq", *EVENT, "media_external_id")
    # Sorts compare the first column first: one of two sources tells next to nothing.
    identity, play = ["source_event_id", "source_id"], ["dedup_key", "source_id"]
    named = rows.where("source_event_id IS NOT NULL").withColumn("_first", F.first("media_item_id").over(W.partitionBy(*identity).orderBy("seq")))
    held = stored.where("source_event_id IS NOT NULL").select(*identity, F.col("media_item_id").alias("_held"), *extra)
    named = named.join(held, identity, "left")
    same = F.col("media_item_id") == F.coalesce("_held", "_first")
    changed = named.where(~same).withColumn("message", F.lit("identity changed its media"))
    pick = F.struct("seq", *EVENT)
    last = named.where(same).groupBy(*identity).agg(F.max_by(pick, "seq").alias("e"), *[F.max(c).alias(c) for c in ("_held", *extra)]).select("e.*", "_held", *extra)
    last = tables.written(last)
    updates = last.where("_held IS NOT NULL").select(*EVENT, *extra)
    now = stored.select(*EVENT, *extra).join(updates.select(*identity), identity, "left_anti").select(*EVENT, *extra).unionByName(updates)
    now = tables.written(now)
    new = last.where("_held IS NULL").drop("_held", *extra).unionByName(rows.where("source_event_id IS NULL").select("seq", *EVENT))
    new = new.withColumn("_r", F.row_number().over(W.partitionBy(*play).orderBy("seq"))).where("_r = 1").join(now.select(*play), play, "left_anti")
    # Times within the gap lie in one slice of its length or in neighbours.
    micros, gap = F.unix_micros(F.col("watched_at").cast("timestamp")), gap_seconds * 1_000_000
    piece = F.floor(F.col("t") / gap)
    near = now.where("completed").select("media_item_id", micros.alias("t")).select("media_item_id", F.col("t").alias("_t"), F.explode(F.array(piece - 1, piece, piece + 1)).alias("_piece"))
    new = new.withColumn("t", micros).withColumn("_piece", piece).alias("n")
    near = near.alias("o")
    close = (F.col("n.media_item_id") == F.col("o.media_item_id")) & (F.col("n._piece") == F.col("o._piece")) & (F.abs(F.col("n.t") - F.col("o._t")) <= gap)
    far = tables.written(new.join(near, close, "left_anti").select(F.col("seq").alias("id"), *EVENT))
    rest = tuple(c for c in EVENT if c not in ("media_item_id", "source_id", "watched_at"))
    kept = without_near_duplicates(far, gap_seconds, columns=rest).select(F.col("id").alias("seq"), *EVENT)
    errors = [e.select("seq", "source_id", "source_event_id", "media_external_id", "message") for e in (unknown, changed)]
    return Persisted(now, kept, errors[0].unionByName(errors[1]))


def merge_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """States by item and source after an observation; counts never fall, completion stays, a fall is flagged."""
    key = ["media_item_id", "source_id"]
    fields = ["view_count", "last_watched_at", "completed", "progress_ms", "observed_at"]
    side = lambda df, p: df.select(*key, *[F.col(c).alias(f"{p}_{c}") for c in fields], F.lit(True).alias(f"{p}_is"))
    both = side(old, "o").join(side(new.where("view_count IS NOT NULL OR last_watched_at IS NOT NULL OR progress_ms IS NOT NULL"), "n"), key, "full")
    fresh = F.col("n_is").isNotNull()
    return both.select(
        *key,
        F.greatest("o_view_count", "n_view_count").alias("view_count"),
        F.coalesce("n_last_watched_at", "o_last_watched_at").alias("last_watched_at"),
        (F.coalesce("o_completed", F.lit(False)) | F.coalesce("n_completed", F.lit(False))).alias("completed"),
        F.when(fresh, F.col("n_progress_ms")).otherwise(F.col("o_progress_ms")).alias("progress_ms"),
        F.when(fresh, F.col("n_observed_at")).otherwise(F.col("o_observed_at")).alias("observed_at"),
        F.coalesce(F.col("n_view_count") < F.col("o_view_count"), F.lit(False)).alias("regressed"),
    )


def refresh_states(states: DataFrame, events: DataFrame) -> DataFrame:
    """States raised to what the completed events of their item and source show, all of them at once."""
    key = ["media_item_id", "source_id"]
    seen = events.where("completed").groupBy(*key).agg(F.count("*").alias("n"), F.max("watched_at").alias("t"))
    return states.select(*key, "view_count", "last_watched_at", "completed").join(seen, key, "full").select(
        *key, F.greatest("view_count", "n").cast("bigint").alias("view_count"), F.greatest("last_watched_at", "t").alias("last_watched_at"),
        (F.coalesce("completed", F.lit(False)) | F.col("n").isNotNull()).alias("completed"),
    )


def apply_events(states: DataFrame, inserted: DataFrame, counts: DataFrame) -> DataFrame:
    """States (STATE columns) after events were inserted, each making its state complete.

    ``inserted`` are the new events with a unique ``seq`` that gives their order, ``counts`` (media_item_id, source_id, n) the
    completed events that are stored for the items and sources among them, the new ones included. The count becomes the largest of
    what was there, the events' view_number and their number; the last play is the latest; progress and the time of observation are
    those of the last event, whatever they are. Other states stay as they are.
    """
    key = ["media_item_id", "source_id"]
    last = F.max_by(F.struct("progress_ms", "watched_at"), "seq")
    new = inserted.groupBy(*key).agg(F.max("view_number").alias("_views"), F.max("watched_at").alias("_t"), last.alias("_last")).join(counts.select(*key, "n"), key, "left")
    hit = F.col("_last").isNotNull()
    both = states.select(*STATE).join(new, key, "full")
    return both.select(
        *key, F.greatest("view_count", "_views", "n", F.when(hit, 0)).cast("bigint").alias("view_count"), F.greatest("last_watched_at", "_t").alias("last_watched_at"),
        (F.coalesce("completed", F.lit(False)) | hit).alias("completed"), F.when(hit, F.col("_last.progress_ms")).otherwise(F.col("progress_ms")).alias("progress_ms"),
        F.when(hit, F.col("_last.watched_at")).otherwise(F.col("observed_at")).alias("observed_at"),
    )


def mark_missing(refs: DataFrame, seen: DataFrame, now: object, library_id: int, complete: bool = True) -> DataFrame:
    """References of one library that its complete scan did not see become unavailable, from now on if they were
    available. ``seen`` has the external ids of that scan; references of all other libraries stay as they are."""
    if not complete:
        return refs
    found = refs.join(seen.select("external_id").distinct().withColumn("_seen", F.lit(True)), "external_id", "left")
    gone = F.col("_seen").isNull() & (F.col("library_id") == library_id)
    columns = [c for c in refs.columns if c not in ("available", "unavailable_since")]
    since = F.col("unavailable_since") if "unavailable_since" in refs.columns else F.lit(None).cast("timestamp_ntz")
    return found.select(
        *columns, F.when(gone, False).otherwise(F.col("available")).alias("available"),
        F.when(gone & F.col("available"), F.lit(now).cast("timestamp_ntz")).otherwise(since).alias("unavailable_since"),
    )


def classify(batch: DataFrame, refs: DataFrame, fields: list[str], resolved: DataFrame | None = None) -> DataFrame:
    """Each staged item as inserted, updated or unchanged, with ``raw_hash``, a hash of its fields.

    An item with a stored reference is unchanged if that has the same hash, else updated. Without one it is updated where
    ``resolved`` (of M02: source_id, external_id, match_status, media_item_id) matched it with a stored item, else inserted.
    Each row of the batch gives one row, also where a reference is stored several times: it is unchanged if one of these has its hash.
    """
    signature = fn.signature({c: F.col(c) for c in fields})
    key = ["source_id", "external_id"]
    # A window and not an aggregate: it gathers what one sort by key, which the join needs as well, has put together.
    by_key = W.partitionBy(*key).orderBy("raw_hash")
    whole = by_key.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    old = refs.select(*key, F.collect_set("raw_hash").over(whole).alias("_old"), F.row_number().over(by_key).alias("_held")).where("_held = 1")
    rows = batch.withColumn("raw_hash", signature).join(old, key, "left")
    matched = F.lit(None).cast("boolean")
    if resolved is not None:
        rows = rows.join(resolved.where("match_status = 'matched'").select(*key, F.lit(True).alias("_matched")).distinct(), key, "left")
        matched = F.col("_matched")
    new = F.when(matched, "updated").otherwise("inserted")
    kind = F.when(F.col("_held").isNull(), new).when(F.array_contains("_old", F.col("raw_hash")), "unchanged").otherwise("updated")
    return rows.withColumn("classification", kind).drop("_old", "_held", "_matched")


def refresh_refs(refs: DataFrame, classified: DataFrame, observed_at: object) -> DataFrame:
    """The new version of ``refs`` (REF columns and others) after a batch of ``classified`` items (source_id, external_id,
    library_id, media_item_id, external_key, external_updated_at, raw_hash; one row each) was seen: those that are there keep item
    and library and take key, times and hash, new ones are added; all of them are available and seen now."""
    key = ["source_id", "external_id"]
    fields = ("external_key", "external_updated_at", "raw_hash")
    seen = classified.select(*key, *[F.col(c).alias(f"_{c}") for c in (*fields, "media_item_id", "library_id")], F.lit(True).alias("_seen"))
    both, hit = refs.join(seen, key, "full"), F.col("_seen").isNotNull()
    value = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in fields} | {
        "media_item_id": F.coalesce("media_item_id", "_media_item_id"), "library_id": F.coalesce("library_id", "_library_id"), "available": F.when(hit, True).otherwise(F.col("available")),
        "unavailable_since": F.when(~hit, F.col("unavailable_since")), "last_seen_at": F.when(hit, F.lit(observed_at).cast("timestamp_ntz")).otherwise(F.col("last_seen_at")),
    }
    return both.select(*[value.get(c, F.col(c)).alias(c) for c in refs.columns])


def upsert(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """The new version of ``target``: rows of ``batch`` replace those of equal key and add the rest (one schema)."""
    return target.join(batch.select(*key), key, "left_anti").select(*target.columns).unionByName(batch.select(*target.columns))


def insert_missing(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``batch`` (one of each key) whose key ``target`` lacks."""
    return batch.dropDuplicates(key).join(target.select(*key), key, "left_anti").select(*target.columns)


def incremental_window(marks: DataFrame, started: object, full_days: int = 7, overlap_seconds: int = 120) -> DataFrame:
    """Per library whether to scan in full, the time to scan from, and the mark to store afterwards."""
    at = F.lit(started).cast("timestamp_ntz")
    full = F.col("watermark_at").isNull() | F.col("last_full_scan_at").isNull() | (F.col("last_full_scan_at") + F.expr(f"INTERVAL {full_days} DAYS") <= at)
    return marks.select("library_id", full.alias("full_scan"), F.when(~full, F.col("watermark_at")).alias("updated_since"), (at - F.expr(f"INTERVAL {overlap_seconds} SECONDS")).alias("next_watermark"))
