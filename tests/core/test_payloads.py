import json
from datetime import datetime

from pyspark.sql import functions as F

from medialedger.sources import payloads as p
from medialedger.streaming import notifications as n

MOVIES = """<?xml version="1.0"?>
<MediaContainer size="3" totalSize="3">
 <Video ratingKey="10" key="/library/10" type="movie" title=" Alien " year="1979" duration="7000000" addedAt="1700000000" viewCount="2" audienceRating="8.5" originallyAvailableAt="1979-05-25">
  <Guid id="TMDB://348"/><Guid id="bad"/><Genre tag="Sci-Fi"/><Genre tag="horror"/><Genre tag="horror"/></Video>
 <Video ratingKey="11" type="movie" title="No years" year="-4"/>
 <Track ratingKey="12" type="track" parentIndex="-1" index="3"/>
</MediaContainer>"""


def test_first_server_items(spark):
    episode = {"ratingKey": 20, "type": "episode", "title": "E", "grandparentRatingKey": "s1", "grandparentTitle": "Show", "parentIndex": 1, "index": 2, "Guid": [{"id": "imdb://tt1"}]}
    texts = [("xml", MOVIES), ("json", json.dumps({"MediaContainer": {"Metadata": [episode]}})), ("bomb", '<!DOCTYPE x><MediaContainer/>'), ("cut", "<MediaContainer><Video"), ("bad", '{"MediaContainer": '), ("none", "<MediaContainer size='0'/>")]
    raw = p.container_items(spark.createDataFrame(texts, "library_external_id string, value string"))
    rows = {(r["library_external_id"], r["external_id"]): r for r in p.first_server_items(raw).collect()}
    assert {k: r["reason"] for k, r in rows.items()} == {
        ("xml", "10"): None, ("xml", "11"): "bad number", ("xml", "12"): None, ("json", "20"): None, ("bomb", None): "XML declarations", ("cut", None): "broken XML", ("bad", None): "broken JSON",
    }
    film, track, ep = rows["xml", "10"], rows["xml", "12"], rows["json", "20"]
    assert (film["title"], film["year"], film["duration_ms"], film["genres"], film["view_count"], film["audience_rating"]) == ("Alien", 1979, 7000000, ["horror", "Sci-Fi"], 2, 8.5)
    assert [tuple(i) for i in film["identifiers"]] == [("tmdb", "348")] and film["added_at"] == datetime(2023, 11, 14, 22, 13, 20)
    assert (track["title"], track["album_external_id"], track["album_title"], track["disc_number"]) == ("Faixa sem título (12)", "xml:album:unknown", "Álbum desconhecido", 0)
    assert (ep["show_external_id"], ep["season_number"], ep["episode_number"]) == ("s1", 1, 2)


def test_first_server_lists(spark):
    xml = """<MediaContainer><Directory key="1" type="movie" title="Films"/><Directory key="2" type="photo" title="Pics"/><Account id="7" name="zed"/><Account id="x" name="no"/><Account id="8" title="Amy"/>
    <Video ratingKey="5" historyKey="/h/1" viewedAt="1700000000"/><Video ratingKey="6" historyKey="/h/2" viewedAt="1700000000" viewOffset="10" duration="100"/><Video historyKey="/h/3" viewedAt="1"/></MediaContainer>"""
    raw = p.container_items(spark.createDataFrame([("l", xml)], "library_external_id string, value string"))
    libs = p.first_server_libraries(raw.where("tag = 'Directory'")).collect()
    assert sorted((r["external_id"], r["reason"]) for r in libs) == [("1", None), ("2", "unsupported library type")]
    assert [tuple(r) for r in p.first_server_users(raw).collect()] == [("8", "Amy"), ("7", "zed")]
    plays = p.first_server_history(raw.where("tag = 'Video'")).collect()
    assert sorted((r["source_event_id"], r["completed"], r["reason"]) for r in plays) == [("/h/1", True, None), ("/h/2", False, None), ("/h/3", True, "orphan")]


def test_second_server(spark):
    song = {"Id": "a", "Name": "Song", "Type": "Audio", "RunTimeTicks": 25001, "Genres": ["Rock", " "], "ProviderIds": {"MusicBrainzTrack": "m1", "Other": "x"}, "AlbumArtists": [], "UserData": {"LastPlayedDate": "2024-01-01T10:00:00Z", "PlayCount": 2}}
    rows = p.second_server_rows(spark.createDataFrame([("lib", json.dumps({"Items": [song, {"Id": "b", "Name": "P", "Type": "Photo"}]})), ("lib", "{")], "library_external_id string, value string"))
    items = p.second_server_items(rows)
    got = {r["external_id"]: r for r in items.collect()}
    assert {k: r["reason"] for k, r in got.items()} == {"a": None, "b": "unsupported type", None: "broken JSON"}
    a = got["a"]
    assert (a["duration_ms"], a["artist_external_id"], a["album_external_id"], a["genres"]) == (2, "lib:artist:unknown", "lib:artist:unknown:album:unknown", ["Rock"])
    assert [tuple(i) for i in a["identifiers"]] == [("mbid", "m1")]
    assert [r["source_event_id"] for r in p.second_server_history(items).collect()] == ["jellyfin:a:2024-01-01T10:00:00+00:00"]
    libs = p.second_server_rows(spark.createDataFrame([(json.dumps({"Items": [{"Id": "1", "Name": "M", "CollectionType": "Movies"}, {"Id": "2", "Name": "B", "CollectionType": "books"}]}),)], "value string"))
    assert [tuple(r) for r in p.second_server_libraries(libs).collect()] == [("1", "M", "movie")]
    assert {r["reason"] for r in p.allowed_pairs(items.where("external_id = 'a'"), spark.createDataFrame([("lib", "movie")], "external_id string, media_type string")).collect()} == {"kind not of the library"}


def test_provider_answers(spark):
    film = {"overview": " O ", "vote_average": 7.5, "poster_path": "/x.jpg", "genres": [{"name": "b"}, {"name": "A"}], "production_companies": [{"name": "S"}]}
    track = {"releases": [{"id": "no"}, {"id": "01234567-89ab-cdef-0123-456789abcdef"}]}
    rows = spark.createDataFrame([("1", json.dumps(film)), ("2", json.dumps(track)), ("3", json.dumps({"poster_path": "/../x"}))], "external_id string, value string")
    got = {r["external_id"]: (r["summary"], r["studio"], r["genres"], r["poster_url"]) for r in p.provider_answers(rows).collect()}
    assert got["1"] == ("O", "S", ["A", "b"], "https://image.tmdb.org/t/p/w500/x.jpg")
    assert got["2"][3] == "https://coverartarchive.org/release/01234567-89ab-cdef-0123-456789abcdef/front-500" and got["3"][3] is None


def test_notifications(spark):
    first = lambda event, **k: json.dumps({"event": event, "eventTime": "2024-01-01T10:00:00+02:00", "event_id": event, "Account": {"id": 1, "title": "Ann"}, "Metadata": {"ratingKey": "5", "type": "movie", "title": "T", "duration": 200, "viewOffset": 150} | k})
    at = datetime(2024, 1, 1, 9)
    raw = spark.createDataFrame([(1, first("media.stop"), at), (1, first("media.stop", viewOffset=190), at), (1, first("media.play", live="1"), at), (1, first("library.new"), at), (1, "junk", at)], "source_id int, value string, arrived_at timestamp")
    a = n.first_server(raw, ["ann"])
    assert sorted((r["progress_percent"], r["completed"], r["occurred_at"].hour) for r in a.collect()) == [(75, False, 8), (95, True, 8)]
    assert {r["completed"] for r in n.first_server(raw, ["bob"]).collect()} == {False}
    second = {"NotificationType": "Playback Stop", "ItemId": "9", "ItemType": "Episode", "SeriesName": "S", "PlayedToCompletion": True, "NotificationUsername": "ann", "RunTimeTicks": 100, "PlaybackPositionTicks": 50}
    texts = [second, {"payload": json.dumps(second)}, second | {"ItemType": "TvChannel"}, second | {"UtcTimestamp": "2024-01-01T10:00:00"}]
    b = n.second_server(spark.createDataFrame([(2, json.dumps(t), at) for t in texts], "source_id int, value string, arrived_at timestamp"), [])
    assert [(r["series_title"], r["completed"], r["progress_percent"], r["occurred_at"]) for r in b.collect()] == [("S", True, 50, at)] * 2
    assert n.both(a, b).count() == 4
    stored = spark.createDataFrame([(1, "5", datetime(2024, 1, 1, 8, 9), 1)], "source_id int, external_id string, last_viewed_at timestamp, view_count int")
    assert sorted((r["completed"], r["occurred_at"].minute) for r in n.confirmed_stops(a, stored).collect()) == [(True, 0), (True, 9)]
