"""Payloads of the two media servers as neutral rows. Rows that break a rule are kept with a reason, none is dropped.

Functions take DataFrames of whole payload texts (``value``) with the columns that say where they come from, so the same
code reads files in batch and messages in a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialedger import functions as fn

# What the servers call things, and the labels of tracks without names.
LIBRARY_KINDS = ("movie", "show", "artist")
MEDIA_KINDS = ("movie", "show", "season", "episode", "artist", "album", "track")
COLLECTIONS = {"movies": "movie", "tvshows": "show", "music": "artist"}
ITEM_TYPES = {"Movie": "movie", "Episode": "episode", "Audio": "track"}
PROVIDERS = {
    "imdb": "imdb", "tmdb": "tmdb", "tvdb": "tvdb",
    "musicbrainztrack": "mbid", "musicbrainzalbum": "mbid-release", "musicbrainzartist": "mbid-artist",
}
UNTITLED_TRACK = "Faixa sem título ({})"
UNKNOWN_ALBUM = "Álbum desconhecido"
UNKNOWN_ARTIST = "Artista desconhecido"
POSTERS = "https://image.tmdb.org/t/p/w500"
COVERS = "https://coverartarchive.org/release/{}/front-500"

_TEXTS = (
    "ratingKey key librarySectionID type title originalTitle year duration originallyAvailableAt updatedAt addedAt studio contentRating audienceRating rating "
    "lastViewedAt viewCount viewOffset viewedAt viewIndex historyKey summary tagline thumb art parentRatingKey parentTitle parentIndex parentThumb grandparentRatingKey "
    "grandparentTitle grandparentThumb index id name username"
).split()
_ITEM = "STRUCT<" + ", ".join(f"`{c}`: STRING" for c in _TEXTS) + ", Guid: ARRAY<STRUCT<id: STRING>>, Genre: ARRAY<STRUCT<tag: STRING>>>"
_TAGS = ("Video", "Track", "Directory", "Account", "User")
_XML = ", ".join(f"{t} ARRAY<{_ITEM}>" for t in _TAGS)
#: A list of one item may come as the item alone.
_SINGLE = f"MediaContainer STRUCT<Metadata: {_ITEM}, Directory: {_ITEM}>, Metadata {_ITEM}, Directory {_ITEM}, _broken STRING"
_JSON = f"MediaContainer STRUCT<Metadata: ARRAY<{_ITEM}>, Directory: ARRAY<{_ITEM}>>, Metadata ARRAY<{_ITEM}>, Directory ARRAY<{_ITEM}>, _broken STRING"


def read_texts(spark, folder: str) -> DataFrame:
    """Whole files as ``value``, with their ``path``."""
    return spark.read.text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))


def container_items(payloads: DataFrame) -> DataFrame:
    """One row per item of XML or JSON containers: the payload's other columns, ``tag``, ``item``; broken payloads, and XML
    with declarations, give one row with a null item and a ``reason``."""
    rest = [c for c in payloads.columns if c != "value"]
    is_json = F.col("value").rlike(r"^\s*[{\[]")
    declared = F.when(is_json, False).otherwise(F.col("value").rlike("(?iu)<!(DOCTYPE|ENTITY)"))
    doc = F.from_json("value", _JSON, {"columnNameOfCorruptRecord": "_broken"})
    single = F.from_json("value", _SINGLE, {"columnNameOfCorruptRecord": "_broken"})  # only of what can't be read as lists
    xml = F.from_xml(F.when(~is_json & ~declared, F.col("value")), _XML, {"attributePrefix": "", "rowTag": "MediaContainer", "mode": "PERMISSIVE"})
    rows = payloads.select(*rest, is_json.alias("is_json"), declared.alias("declared"), F.when(is_json, doc).alias("j"), xml.alias("x"), "value")
    rows = rows.withColumn("s", F.when(F.col("j._broken").isNotNull(), single))
    tagged = lambda tag, items: F.transform(items, lambda i: F.struct(F.lit(tag).alias("tag"), i.alias("item")))
    none = F.array().cast(f"ARRAY<STRUCT<tag: STRING, item: {_ITEM}>>")
    places = ("MediaContainer.Metadata", "MediaContainer.Directory", "Metadata", "Directory")
    alone = F.coalesce(*[F.col(f"s.{p}") for p in places])
    is_single = F.col("j._broken").isNotNull() & F.col("s._broken").isNull() & alone.isNotNull()
    listed = F.when(is_single, F.array(alone)).otherwise(F.coalesce(*[F.col(f"j.{p}") for p in places]))
    from_xml = F.flatten(F.array(*[F.coalesce(tagged(t, F.col(f"x.{t}")), none) for t in _TAGS]))
    items = F.when(F.col("is_json"), F.coalesce(tagged("Metadata", listed), none)).otherwise(F.coalesce(from_xml, none))
    closed = F.col("value").rlike(r"(?s)<MediaContainer[^>]*(/>|>.*</MediaContainer>)\s*$")
    reason = F.when(F.col("declared"), "XML declarations").when(F.col("is_json") & F.col("j._broken").isNotNull() & ~is_single, "broken JSON").when(~F.col("is_json") & ~closed, "broken XML")
    marked = rows.select(*rest, reason.alias("reason"), F.when(reason.isNull(), items).alias("items"))
    out = marked.select(*rest, "reason", F.explode_outer("items").alias("i")).select(*rest, "reason", "i.tag", "i.item")
    return out.where("item IS NOT NULL OR reason IS NOT NULL")


def _whole(c: Column) -> Column:
    return fn.clean(c).try_cast("bigint")


def _bad_number(c: Column) -> Column:
    """Given, but no whole number of zero or more."""
    return fn.clean(c).isNotNull() & F.coalesce(_whole(c) < 0, F.lit(True))


def first_server_items(items: DataFrame) -> DataFrame:
    """Items of ``container_items`` (library_external_id, item) as neutral columns and ``reason`` (null: valid)."""
    v = lambda c: fn.clean(F.col(f"item.{c}"))
    kind, track = v("type"), F.coalesce(v("type") == "track", F.lit(False))
    index = lambda c: F.greatest(_whole(F.col(f"item.{c}")), F.lit(0)).cast("int")
    number = lambda c: _whole(F.col(f"item.{c}"))
    at = lambda c: F.timestamp_seconds(number(c))
    ids = F.array_compact(F.transform(F.coalesce("item.Guid", F.array().cast("ARRAY<STRUCT<id: STRING>>")), lambda g: fn.provider_id(g["id"])))
    genres = fn.sorted_tags(F.transform(F.coalesce("item.Genre", F.array().cast("ARRAY<STRUCT<tag: STRING>>")), lambda g: g["tag"]))
    numbers = ("year", "duration", "addedAt", "updatedAt", "lastViewedAt", "viewCount", "viewOffset")
    bad = F.lit(False)
    for c in numbers:
        bad = bad | _bad_number(F.col(f"item.{c}"))
    unread = v("originallyAvailableAt").isNotNull() & v("originallyAvailableAt").try_cast("date").isNull()
    reason = (
        F.coalesce(F.col("reason"), F.when(~F.coalesce(kind.isin(*MEDIA_KINDS), F.lit(False)), "unsupported type").when(v("ratingKey").isNull(), "no id")
        .when(v("title").isNull() & ~track, "no title").when(bad, "bad number").when(unread, "bad date"))
    )
    title = F.coalesce(v("title"), F.when(track, F.format_string(UNTITLED_TRACK.replace("{}", "%s"), v("ratingKey"))))
    album = F.coalesce(v("parentRatingKey"), F.when(track, F.concat(F.coalesce(v("grandparentRatingKey"), F.col("library_external_id")), F.lit(":album:unknown"))))
    return items.select(
        "library_external_id", v("ratingKey").alias("external_id"), v("key").alias("external_key"), kind.alias("kind"), title.alias("title"), v("originalTitle").alias("original_title"),
        number("year").cast("int").alias("year"), v("grandparentRatingKey").alias("show_external_id"), v("grandparentTitle").alias("show_title"), v("parentRatingKey").alias("season_external_id"),
        index("parentIndex").alias("season_number"), index("index").alias("episode_number"), v("grandparentRatingKey").alias("artist_external_id"), v("grandparentTitle").alias("artist_title"),
        album.alias("album_external_id"), F.coalesce(v("parentTitle"), F.when(track, UNKNOWN_ALBUM)).alias("album_title"), F.when(track, index("parentIndex")).alias("disc_number"),
        F.when(track, index("index")).alias("track_number"), number("duration").alias("duration_ms"), v("originallyAvailableAt").try_cast("date").alias("originally_available_on"),
        v("summary").alias("summary"), v("tagline").alias("tagline"), v("studio").alias("studio"), v("contentRating").alias("content_rating"),
        F.coalesce(v("audienceRating"), v("rating")).try_cast("double").alias("audience_rating"), genres.alias("genres"), at("addedAt").alias("added_at"), v("thumb").alias("thumb_path"),
        v("art").alias("art_path"), ids.alias("identifiers"), at("updatedAt").alias("updated_at"), at("lastViewedAt").alias("last_viewed_at"), number("viewCount").cast("int").alias("view_count"),
        number("viewOffset").alias("view_offset_ms"), reason.alias("reason"),
    )


def first_server_history(items: DataFrame) -> DataFrame:
    """History rows as events; rows without an item or a time have a reason."""
    v = lambda c: fn.clean(F.col(f"item.{c}"))
    n = lambda c: _whole(F.col(f"item.{c}"))
    reason = F.coalesce(F.col("reason"), F.when(v("ratingKey").isNull(), "orphan").when(n("viewedAt").isNull(), "no time"))
    done = fn.history_completed(n("viewCount"), n("viewOffset"), n("duration"), v("historyKey").isNotNull())
    return items.select(
        "library_external_id", v("ratingKey").alias("media_external_id"), v("historyKey").alias("source_event_id"), F.timestamp_seconds(n("viewedAt")).alias("watched_at"),
        done.alias("completed"), n("viewOffset").alias("progress_ms"), n("duration").alias("duration_ms"), n("viewIndex").cast("int").alias("view_number"), reason.alias("reason"),
    )


def first_server_libraries(items: DataFrame) -> DataFrame:
    """(external_id, name, media_type, updated_at, reason) of each listed library."""
    v = lambda c: fn.clean(F.col(f"item.{c}"))
    kind = F.coalesce(v("type"), F.lit("unknown"))
    reason = F.coalesce(F.col("reason"), F.when(~kind.isin(*LIBRARY_KINDS), "unsupported library type").when(v("key").isNull() | v("title").isNull(), "no name"))
    return items.select(v("key").alias("external_id"), v("title").alias("name"), kind.alias("media_type"), F.timestamp_seconds(_whole(F.col("item.updatedAt"))).alias("updated_at"), reason.alias("reason"))


def first_server_users(items: DataFrame) -> DataFrame:
    """Accounts with a numeric id and a name, by name without regard to case."""
    v = lambda c: fn.clean(F.col(f"item.{c}"))
    users = items.where(F.lower("tag") == "account").select(v("id").alias("id"), F.coalesce(v("name"), v("title"), v("username")).alias("name"))
    return users.where(F.col("id").rlike("^[0-9]+$") & F.col("name").isNotNull()).orderBy(F.lower("name"), "id")


_USER = "UserData STRUCT<LastPlayedDate: STRING, PlayCount: BIGINT, PlaybackPositionTicks: BIGINT>"
SECOND_ITEM = (
    "Id STRING, Name STRING, Type STRING, OriginalTitle STRING, ProductionYear BIGINT, SeriesId STRING, SeriesName STRING, SeasonId STRING, ParentIndexNumber BIGINT, "
    "IndexNumber BIGINT, AlbumId STRING, Album STRING, AlbumArtist STRING, AlbumArtists ARRAY<STRUCT<Id: STRING, Name: STRING>>, RunTimeTicks BIGINT, PremiereDate STRING, "
    "Overview STRING, Taglines ARRAY<STRING>, Studios ARRAY<STRUCT<Name: STRING>>, OfficialRating STRING, CommunityRating DOUBLE, Genres ARRAY<STRING>, DateCreated STRING, "
    f"DateLastSaved STRING, DateLastMediaAdded STRING, ImageTags MAP<STRING, STRING>, ProviderIds MAP<STRING, STRING>, CollectionType STRING, {_USER}"
)


def second_server_rows(payloads: DataFrame) -> DataFrame:
    """The ``Items`` of second-server answers, one row each: the payload's other columns and ``item`` (null: broken, with reason)."""
    rest = [c for c in payloads.columns if c != "value"]
    doc = F.from_json("value", f"Items ARRAY<STRUCT<{SECOND_ITEM}>>, _broken STRING", {"columnNameOfCorruptRecord": "_broken"})
    rows = payloads.select(*rest, doc.alias("d"))
    reason = F.when(F.col("d").isNull() | F.col("d._broken").isNotNull(), "broken JSON")
    return rows.select(*rest, reason.alias("reason"), F.explode_outer("d.Items").alias("item")).where("item IS NOT NULL OR reason IS NOT NULL")


def lenient_time(c: Column) -> Column:
    """ISO time; without an offset it is UTC (the session's zone must be UTC); null if unreadable."""
    return F.try_to_timestamp(fn.clean(c))


def strict_time(c: Column) -> Column:
    """P14 of notifications: only times with an offset count."""
    return F.when(F.trim(c).rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(F.trim(c)))


def alias_ids(ids: Column) -> Column:
    """A map of provider names to ids as sorted structs, other names left out."""
    known = F.create_map(*[F.lit(x) for pair in PROVIDERS.items() for x in pair])
    found = F.transform(F.map_entries(ids), lambda e: F.struct(F.element_at(known, F.lower(e["key"])).alias("provider"), fn.clean(e["value"]).alias("external_id")))
    return F.array_sort(F.filter(found, lambda s: s["provider"].isNotNull() & s["external_id"].isNotNull()))


def second_server_items(rows: DataFrame) -> DataFrame:
    """Rows of ``second_server_rows`` (library_external_id, item) as neutral columns and ``reason``."""
    v = lambda c: fn.clean(F.col(f"item.{c}"))
    n = lambda c: F.when(F.col(f"item.{c}") >= 0, F.col(f"item.{c}"))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in ITEM_TYPES.items() for x in pair]), v("Type"))
    track = F.coalesce(kind == "track", F.lit(False))
    lead = F.get(F.col("item.AlbumArtists"), 0)
    artist = F.coalesce(fn.clean(lead["Id"]), F.when(track, F.concat("library_external_id", F.lit(":artist:unknown"))))
    artist_name = F.coalesce(fn.clean(lead["Name"]), v("AlbumArtist"), F.when(track, UNKNOWN_ARTIST))
    album = F.coalesce(v("AlbumId"), F.when(track, F.concat(artist, F.lit(":album:unknown"))))
    image = lambda i: F.when(i.isNotNull(), F.concat(F.lit("/Items/"), i, F.lit("/Images/Primary")))
    reason = F.coalesce(F.col("reason"), F.when(kind.isNull(), "unsupported type").when(v("Id").isNull(), "no id").when(v("Name").isNull(), "no title"))
    return rows.select(
        "library_external_id", v("Id").alias("external_id"), F.concat(F.lit("/Items/"), v("Id")).alias("external_key"), kind.alias("kind"), v("Name").alias("title"),
        v("OriginalTitle").alias("original_title"), n("ProductionYear").cast("int").alias("year"), v("SeriesId").alias("show_external_id"), v("SeriesName").alias("show_title"),
        v("SeasonId").alias("season_external_id"), n("ParentIndexNumber").cast("int").alias("season_number"), n("IndexNumber").cast("int").alias("episode_number"),
        artist.alias("artist_external_id"), artist_name.alias("artist_title"), album.alias("album_external_id"), F.coalesce(v("Album"), F.when(track, UNKNOWN_ALBUM)).alias("album_title"),
        F.when(track, n("ParentIndexNumber")).cast("int").alias("disc_number"), F.when(track, n("IndexNumber")).cast("int").alias("track_number"),
        F.expr("CASE WHEN item.RunTimeTicks >= 0 THEN item.RunTimeTicks div 10000 END").alias("duration_ms"), lenient_time(F.col("item.PremiereDate")).cast("date").alias("originally_available_on"),
        v("Overview").alias("summary"), fn.clean(F.get(F.col("item.Taglines"), 0)).alias("tagline"), fn.clean(F.get(F.col("item.Studios"), 0)["Name"]).alias("studio"),
        v("OfficialRating").alias("content_rating"), F.col("item.CommunityRating").alias("audience_rating"), F.filter("item.Genres", lambda g: F.trim(g) != "").alias("genres"),
        lenient_time(F.col("item.DateCreated")).alias("added_at"), F.when(F.col("item.ImageTags")["Primary"].isNotNull(), image(v("Id"))).alias("thumb_path"),
        image(F.coalesce(v("SeriesId"), artist)).alias("artist_thumb_path"), image(F.coalesce(v("SeasonId"), album)).alias("album_thumb_path"), alias_ids(F.col("item.ProviderIds")).alias("identifiers"),
        lenient_time(F.coalesce(v("DateLastSaved"), v("DateLastMediaAdded"))).alias("updated_at"), lenient_time(F.col("item.UserData.LastPlayedDate")).alias("last_viewed_at"),
        n("UserData.PlayCount").cast("int").alias("view_count"), F.expr("CASE WHEN item.UserData.PlaybackPositionTicks >= 0 THEN item.UserData.PlaybackPositionTicks div 10000 END").alias("view_offset_ms"),
        reason.alias("reason"),
    )


def second_server_history(items: DataFrame) -> DataFrame:
    """Items with a last play and plays as completed events."""
    at = F.date_format("last_viewed_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return items.where("reason IS NULL AND last_viewed_at IS NOT NULL AND view_count > 0").select(
        "library_external_id", F.col("external_id").alias("media_external_id"), F.concat_ws(":", F.lit("jellyfin"), "external_id", at).alias("source_event_id"),
        F.col("last_viewed_at").alias("watched_at"), F.lit(True).alias("completed"), "duration_ms", F.col("view_count").alias("view_number"),
    )


def with_series_ids(items: DataFrame, series: DataFrame) -> DataFrame:
    """``show_identifiers`` of episodes from the rows of their series (external_id, identifiers)."""
    one = series.groupBy(F.col("external_id").alias("show_external_id")).agg(F.first("identifiers", ignorenulls=True).alias("show_identifiers"))
    return items.join(one, "show_external_id", "left").select(*items.columns, "show_identifiers")


def second_server_libraries(rows: DataFrame) -> DataFrame:
    """Libraries of the known collection types; others are no error and left out."""
    known = F.create_map(*[F.lit(x) for pair in COLLECTIONS.items() for x in pair])
    libs = rows.select(fn.clean(F.col("item.Id")).alias("external_id"), fn.clean(F.col("item.Name")).alias("name"), F.element_at(known, F.lower("item.CollectionType")).alias("media_type"))
    return libs.where("external_id IS NOT NULL AND name IS NOT NULL AND media_type IS NOT NULL")


def second_server_users(rows: DataFrame) -> DataFrame:
    """Users (id without dashes, lower case; name), by name."""
    users = rows.select(F.lower(F.regexp_replace(fn.clean(F.col("item.Id")), "-", "")).alias("id"), fn.clean(F.col("item.Name")).alias("name"))
    return users.where("id IS NOT NULL AND id <> '' AND name IS NOT NULL").orderBy(F.lower("name"), "id")


def allowed_pairs(items: DataFrame, libraries: DataFrame) -> DataFrame:
    """Items with ``reason`` set where their kind can't lie in a library of that type (movie; show; artist)."""
    types = libraries.select(F.col("external_id").alias("library_external_id"), F.col("media_type").alias("_type"))
    family = F.when(F.col("kind").isin("show", "season", "episode"), "show").when(F.col("kind").isin("artist", "album", "track"), "artist").otherwise(F.col("kind"))
    rows = items.join(types, "library_external_id", "left")
    return rows.withColumn("reason", F.coalesce("reason", F.when(~F.col("_type").eqNullSafe(family), "kind not of the library"))).select(*items.columns)


ANSWER = "overview STRING, tagline STRING, vote_average DOUBLE, poster_path STRING, genres ARRAY<STRUCT<name: STRING>>, production_companies ARRAY<STRUCT<name: STRING>>, releases ARRAY<STRUCT<id: STRING>>"


def provider_answers(payloads: DataFrame) -> DataFrame:
    """Dumped provider answers (value; provider, external_id, language kept) as fields for enrichment."""
    rest = [c for c in payloads.columns if c != "value"]
    rows = payloads.select(*rest, F.from_json("value", ANSWER).alias("a"))
    path = fn.clean(F.col("a.poster_path"))
    poster = F.when(path.startswith("/") & ~path.contains(".."), F.concat(F.lit(POSTERS), path))
    release = F.get(F.filter("a.releases", lambda r: F.coalesce(F.lower(r["id"]).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False))), 0)["id"]
    cover = F.when(release.isNotNull(), F.format_string(COVERS.replace("{}", "%s"), release))
    return rows.select(
        *rest, fn.clean(F.col("a.overview")).alias("summary"), fn.clean(F.col("a.tagline")).alias("tagline"), fn.clean(F.get(F.col("a.production_companies"), 0)["name"]).alias("studio"),
        F.col("a.vote_average").alias("audience_rating"), fn.sorted_tags(F.transform("a.genres", lambda g: g["name"])).alias("genres"), F.coalesce(poster, cover).alias("poster_url"),
    )
