"""Column helpers: cleaning, keys, hashes, times and display forms."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: White space of any script and the four separators among the control characters.
SPACE = r"(?U)[\s\x1c-\x1f]"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def _bare(c: Column) -> Column:
    """Whether both ends are printable ASCII, so that there is nothing to strip; most texts are, and need no pattern."""
    return F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.when(_bare(c), c).otherwise(_stripped(c))


def single_spaced(c: Column) -> Column:
    """Stripped, every run of white space within as one space."""
    return F.regexp_replace(strip(c), f"{SPACE}+", " ")


def clean(c: Column) -> Column:
    """Stripped, with empty as null."""
    return F.when(_bare(c), c).otherwise(F.nullif(_stripped(c), F.lit("")))


def fold(c: Column) -> Column:
    """Key of a tag: runs of white space as one space, letters folded (capitals first, so that one letter's forms and those
    that stand for two come out alike; both small sigmas are one)."""
    return F.replace(F.lower(F.upper(single_spaced(c))), F.lit("\u03c2"), F.lit("\u03c3"))


@F.pandas_udf(StringType())
def title_key(titles: pd.Series) -> pd.Series:
    """Key of a title: compatibility form without combining marks, single spaces, case folded; Spark has no such form."""

    def key(t: str | None) -> str | None:
        if t is None:
            return None
        plain = t if t.isascii() else "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch))
        return " ".join(plain.split()).casefold()

    return titles.map(key)


@F.pandas_udf(StringType())
def unescape_html(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else html.unescape(v))


def provider_id(c: Column) -> Column:
    """``provider://id`` as a struct, null unless both parts are there."""
    parts = r"^([^:/]+)://(.+)$"
    provider, external = F.lower(F.trim(F.regexp_extract(c, parts, 1))), F.trim(F.regexp_extract(c, parts, 2))
    return F.when((provider != "") & (external != ""), F.struct(provider.alias("provider"), external.alias("external_id")))


def sorted_tags(tags: Column) -> Column:
    """Distinct cleaned tags, sorted without regard to case."""
    kept = F.array_distinct(F.array_compact(F.transform(tags, clean)))
    return F.transform(F.array_sort(F.transform(kept, lambda t: F.struct(F.lower(t).alias("k"), t.alias("t")))), lambda s: s["t"])


def ticks_to_ms(c: Column) -> Column:
    return F.floor(c / 10000).cast("bigint")


def percent(position: Column, duration: Column) -> Column:
    """Whole percent played, 100 at most; null without a positive duration."""
    return F.when(duration > 0, F.least(F.floor(position * 100 / duration), F.lit(100))).cast("int")


def history_completed(views: Column, progress: Column, duration: Column, has_key: Column) -> Column:
    """Plays count as complete when viewed, at nine tenths, or listed in the history without progress."""
    ratio = F.when((duration > 0) & progress.isNotNull(), progress / duration >= 0.9)
    return F.when(views > 0, True).when(ratio, True).when(has_key & progress.isNull(), True).otherwise(False)


def utc_text(c: Column) -> Column:
    return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def key_hash(*parts: Column, sep: str = "|") -> Column:
    return F.sha2(F.concat_ws(sep, *(p.cast("string") for p in parts)), 256)


def retired_identity(kind: str, row: Column, identity: Column) -> Column:
    return F.concat(F.lit(f"retired:{kind}:"), row.cast("string"), F.lit(":"), F.substring(F.sha2(identity, 256), 1, 16))


NOTHING = "\u2014"


def canonical_json(fields: dict[str, Column]) -> Column:
    """The fields as JSON text with sorted keys, no spaces and nulls spelled out: different values never give one text."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def signature(fields: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(fields), 256)


def utc_iso(c: Column) -> Column:
    """UTC text as ``2024-01-01T00:00:00+00:00``, with six decimals only where there are any."""
    at = c.cast("timestamp")
    whole = F.unix_micros(at) % 1_000_000 == 0
    return F.concat(F.when(whole, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.lit("+00:00"))


def event_key(source_id: Column, source_event_id: Column, media_external_id: Column, watched_at: Column, completed: Column, progress_ms: Column, duration_ms: Column, view_number: Column) -> Column:
    """What two reports of one play share: SHA-256 of the canonical JSON of eight fields. Users and libraries are not among them.

    The session's time zone is to be UTC, as for all texts of times here.
    """
    return signature({
        "source_id": source_id, "source_event_id": source_event_id, "media_external_id": media_external_id, "watched_at": utc_iso(watched_at),
        "completed": completed, "progress_ms": progress_ms, "duration_ms": duration_ms, "view_number": view_number,
    })


def cut(c: Column, most: int) -> Column:
    """The first characters of a text (500 for messages, 255 for titles, 32 for names)."""
    return F.substring(c, 1, most)


def local_text(c: Column, zone: str) -> Column:
    """Local day and time of a UTC time; a dash for none."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(c.cast("timestamp"), zone), "dd/MM/yyyy HH:mm"), F.lit(NOTHING))


def duration_text(ms: Column) -> Column:
    """``1h 05min`` or ``56 min``; a dash for none."""
    minutes = F.floor(ms / 60000)
    long = F.format_string("%dh %02dmin", F.floor(minutes / 60), minutes % 60)
    return F.when(ms.isNull(), NOTHING).when(minutes >= 60, long).otherwise(F.format_string("%d min", minutes))


def elapsed_text(started: Column, finished: Column) -> Column:
    """``2m 05s`` between two times, never below zero; a dash without a start."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    seconds = F.greatest(F.lit(0), F.floor((micros(finished) - micros(started)) / 1_000_000))
    return F.when(started.isNull(), NOTHING).otherwise(F.format_string("%dm %02ds", F.floor(seconds / 60), seconds % 60))


def is_mbid(c: Column) -> Column:
    """The shape of a MusicBrainz id."""
    return F.coalesce(c.rlike("^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lit(False))


def is_numeric_id(c: Column) -> Column:
    """The shape of a numeric provider id."""
    return F.coalesce(c.rlike("^[0-9]+$"), F.lit(False))


def retry_delay(attempts: Column) -> Column:
    return F.least(F.lit(3600), 15 * F.pow(F.lit(2), F.least(attempts - 1, F.lit(8)))).cast("int")


def redact(c: Column) -> Column:
    """Log text without tokens, passwords, keys and the values of Authorization headers, whatever their scheme."""
    headers = F.regexp_replace(c, r"(?i)(authorization\s*[=:]\s*)(?:(?:bearer|basic|digest|mediabrowser)\s+)?[^\s,;&]+", "$1***")
    named = F.regexp_replace(headers, r"(?i)(token|password|secret|api[_-]?key)(\s*[=:]\s*)[^\s,;&]+", "$1$2***")
    return F.regexp_replace(named, r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+", "$1***")
