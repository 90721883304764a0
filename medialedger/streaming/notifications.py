"""Playback notifications of both servers as one stream of neutral rows. All of it is stateless, for batch and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialedger import functions as fn
from medialedger.sources.payloads import strict_time

# Event names and the names of live television.
FIRST_EVENTS = ("media.play", "media.resume", "media.pause", "media.stop", "media.scrobble")
SECOND_EVENTS = ("playbackstart", "playbackprogress", "playbackstop")
LIVE_SECTIONS = ("live", "livetv", "live-tv")
LIVE_KINDS = ("livetv", "livetvchannel", "livetvprogram", "tvchannel")
TRUE = ("1", "true", "yes")

_FIRST = (
    "event STRING, eventTime STRING, event_id STRING, Account STRUCT<id: STRING, title: STRING>, Metadata STRUCT<ratingKey: STRING, librarySectionID: STRING, type: STRING, "
    "title: STRING, grandparentTitle: STRING, duration: STRING, viewOffset: STRING, live: STRING, librarySectionType: STRING>"
)
_PLAYED = "UserId STRING, NotificationUsername STRING, Username STRING, UtcTimestamp STRING, PlayedToCompletion STRING"
_BOTH = "RunTimeTicks: STRING, PlaybackPositionTicks: STRING, PositionTicks: STRING, IsLive: STRING, MediaType: STRING, Name: STRING, SeriesName: STRING"
_SECOND = (
    f"NotificationType STRING, NotificationId STRING, ItemId STRING, ItemType STRING, ItemName STRING, {_PLAYED}, {_BOTH.replace(':', '')}, Item STRUCT<Id: STRING, Type: STRING, {_BOTH}>"
)
COLUMNS = ("source_id", "external_id", "event_key", "title", "series_title", "playback_user", "media_kind", "event_type", "occurred_at", "progress_percent", "completed", "active")


def _parsed(raw: DataFrame, arrived: str, text: Column, schema: str) -> DataFrame:
    """Source and time of arrival with the parsed text as ``d``, by a generator of one row: what follows can't be moved before it, so a
    text is parsed once and not again for each field that a filter reads."""
    return raw.select("source_id", arrived, F.explode(F.array(F.from_json(text, schema))).alias("d"))


def _true(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUE), F.lit(False))


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def _percent(position: Column, duration: Column) -> Column:
    count = lambda c: F.when(c.rlike("^[0-9]+$"), c.try_cast("decimal(30,0)"))
    return F.when(count(duration) > 0, F.least(F.floor(count(position) * 100 / count(duration)), F.lit(100))).cast("int")


def _of_user(users: list[str], *fields: Column) -> Column:
    """whether any field names one of the configured users; without any, everybody counts."""
    wanted = [u.strip().lower() for u in users if u.strip()]
    if not wanted:
        return F.lit(True)
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.lower(F.trim(f)).isin(*wanted), F.lit(False))
    return hit


def first_server(raw: DataFrame, users: list[str], arrived: str = "arrived_at") -> DataFrame:
    """Allowed notifications (source_id, value, arrived_at) with an identity, live television left out.

    A play is completed by a scrobble or by a stop at 90 percent or more, of a configured user.
    """
    m = lambda c: fn.clean(F.col(f"d.Metadata.{c}"))
    rows = _parsed(raw, arrived, F.col("value"), _FIRST)
    event = F.lower("d.event")
    live = _true(m("live")) | F.coalesce(F.lower(m("librarySectionType")).isin(*LIVE_SECTIONS), F.lit(False))
    rows = rows.where(event.isin(*FIRST_EVENTS) & m("ratingKey").isNotNull() & ~live)
    percent = _percent(m("viewOffset"), m("duration"))
    done = (event == "media.scrobble") | F.coalesce((event == "media.stop") & (percent >= 90), F.lit(False))
    return rows.select(
        "source_id", m("ratingKey").alias("external_id"), fn.clean(F.col("d.event_id")).alias("event_key"), F.coalesce(m("title"), m("grandparentTitle"), m("ratingKey")).alias("title"),
        F.when(m("type") == "episode", m("grandparentTitle")).alias("series_title"), F.coalesce(fn.clean(F.col("d.Account.title")), fn.clean(F.col("d.Account.id"))).alias("playback_user"),
        m("type").alias("media_kind"), event.alias("event_type"), F.coalesce(strict_time(F.col("d.eventTime")), F.col(arrived)).alias("occurred_at"), percent.alias("progress_percent"),
        (done & _of_user(users, F.col("d.Account.id"), F.col("d.Account.title"))).alias("completed"), event.isin("media.play", "media.resume").alias("active"),
    )


def second_server(raw: DataFrame, users: list[str], arrived: str = "arrived_at") -> DataFrame:
    """S18, F14-F16, W01, W02, W10 of the other server: JSON, or a JSON text in ``payload``. A given time that can't be read drops the row."""
    inner = F.coalesce(F.get_json_object("value", "$.payload"), F.col("value"))
    rows = _parsed(raw, arrived, inner, _SECOND)
    v, i = (lambda c: fn.clean(F.col(f"d.{c}"))), (lambda c: fn.clean(F.col(f"d.Item.{c}")))
    event, kind = _letters(F.col("d.NotificationType")), F.coalesce(v("ItemType"), i("Type"))
    live = _true(F.coalesce(v("IsLive"), i("IsLive")))
    for c in (v("ItemType"), v("MediaType"), i("Type"), i("MediaType")):
        live = live | F.coalesce(_letters(c).isin(*LIVE_KINDS), F.lit(False))
    at = strict_time(F.col("d.UtcTimestamp"))
    key = F.coalesce(v("ItemId"), i("Id"))
    rows = rows.where(event.isin(*SECOND_EVENTS) & ~live & key.isNotNull() & (v("UtcTimestamp").isNull() | at.isNotNull()))
    percent = _percent(F.coalesce(v("PlaybackPositionTicks"), v("PositionTicks"), i("PlaybackPositionTicks"), i("PositionTicks")), F.coalesce(v("RunTimeTicks"), i("RunTimeTicks")))
    done = (event == "playbackstop") & _true(v("PlayedToCompletion")) & _of_user(users, v("UserId"), v("NotificationUsername"), v("Username"))
    return rows.select(
        "source_id", key.alias("external_id"), v("NotificationId").alias("event_key"), F.coalesce(v("Name"), v("ItemName"), i("Name"), key).alias("title"),
        F.when(F.lower(kind) == "episode", F.coalesce(v("SeriesName"), i("SeriesName"))).alias("series_title"), F.coalesce(v("NotificationUsername"), v("Username"), v("UserId")).alias("playback_user"),
        kind.alias("media_kind"), event.alias("event_type"), F.coalesce(at, F.col(arrived)).alias("occurred_at"), percent.alias("progress_percent"), done.alias("completed"),
        event.isin("playbackstart", "playbackprogress").alias("active"),
    )


def both(first: DataFrame, second: DataFrame) -> DataFrame:
    """One stream of both servers."""
    return first.select(*COLUMNS).unionByName(second.select(*COLUMNS))


def confirmed_stops(rows: DataFrame, stored: DataFrame, seconds: int = 600) -> DataFrame:
    """Stops below the mark that the server's stored state (source_id, external_id, last_viewed_at, view_count) confirms
    within the tolerance become completed at the stored time."""
    known = stored.where("view_count > 0 AND last_viewed_at IS NOT NULL").groupBy("source_id", "external_id").agg(F.max("last_viewed_at").alias("_at"))
    met = rows.join(known, ["source_id", "external_id"], "left")
    near = F.abs(F.unix_micros("_at") - F.unix_micros("occurred_at")) <= seconds * 1_000_000
    hit = F.coalesce((F.col("event_type") == "media.stop") & ~F.col("completed") & near, F.lit(False))
    changed = {"completed": F.col("completed") | hit, "occurred_at": F.when(hit, F.col("_at")).otherwise(F.col("occurred_at"))}
    return met.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in rows.columns])
