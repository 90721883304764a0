import json

from medialedger.sources import history_export as h


def test_export(spark, tmp_path):
    play = lambda i, **k: {"id": i, "watched_at": "2024-01-01T10:00:00.000Z", "type": "movie", "movie": {"title": "M", "year": 2000, "ids": {"imdb": "tt1", "tmdb": "7"}}} | k
    (tmp_path / "watched-history-2.json").write_text(json.dumps([play("a"), play("b", watched_at="nonsense"), play("c", movie={"title": "N", "ids": {"tmdb": "8"}})]))
    (tmp_path / "watched-history-10.json").write_text(json.dumps([play("d", type="track"), play("e", movie={"title": "X", "ids": {"tvdb": "9"}})]))
    (tmp_path / "other.json").write_text("[1]")
    rows = {r["id"]: r for r in h.read_export(spark, str(tmp_path)).collect()}
    assert {k: r["reason"] for k, r in rows.items()} == {"a": None, "b": "no time", "c": None, "d": "unknown type", "e": None}
    assert (rows["a"]["file_number"], rows["e"]["file_number"]) == (2, 10)
    ids = spark.createDataFrame([(1, "imdb", "tt1"), (1, "tmdb", "7"), (2, "tmdb", "7"), (3, "tmdb", "8"), (4, "tmdb", "8"), (5, "tvdb", "9"), (6, "tvdb", "9")], "media_item_id bigint, provider string, external_id string")
    preferred = spark.createDataFrame([(4,), (5,), (6,)], "media_item_id bigint")
    got = {r["id"]: (r["media_item_id"], r["ambiguous"]) for r in h.match(h.read_export(spark, str(tmp_path)), ids, preferred).collect()}
    assert got == {"a": (1, False), "c": (4, False), "e": (None, True)}


def test_series_ids_and_users_of_the_second_server(spark):
    from medialedger.sources import payloads as p

    items = spark.createDataFrame([("e1", "s1"), ("e2", "s2"), ("e3", None)], "external_id string, show_external_id string")
    series = spark.createDataFrame([("s1", ["tvdb:1"]), ("s1", None), ("s3", ["x"])], "external_id string, identifiers array<string>")
    got = {r["external_id"]: r["show_identifiers"] for r in p.with_series_ids(items, series).collect()}
    assert got == {"e1": ["tvdb:1"], "e2": None, "e3": None}
    text = json.dumps({"Items": [{"Id": "AB-cd", "Name": "zoe"}, {"Id": "1-2", "Name": "Ann"}, {"Id": "-", "Name": "x"}, {"Id": "3", "Name": " "}]})
    rows = p.second_server_rows(spark.createDataFrame([(text,)], "value string"))
    assert [tuple(r) for r in p.second_server_users(rows).collect()] == [("12", "Ann"), ("abcd", "zoe")]


def test_one_item_alone_in_a_container(spark):
    from medialedger.sources import payloads as p

    one, two = {"ratingKey": "1", "type": "movie", "title": "A"}, {"ratingKey": "2", "type": "movie", "title": "B"}
    texts = [{"MediaContainer": {"Metadata": one}}, {"MediaContainer": {"Metadata": [one, two]}}, {"Directory": two}, {"MediaContainer": {}}]
    rows = p.container_items(spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(texts)] + [(9, "{broken")], "n int, value string")).collect()
    assert sorted((r["n"], r["item"]["ratingKey"] if r["item"] else None, r["reason"]) for r in rows) == [(0, "1", None), (1, "1", None), (1, "2", None), (2, "2", None), (9, None, "broken JSON")]


def test_rounds_of_an_import(spark):
    ident = "id string, ids array<struct<provider: string, external_id: string>>, show_ids array<struct<provider: string, external_id: string>>, reason string"
    plays = [("a", [("tmdb", "1"), ("imdb", "x")], [("tvdb", "9")], None), ("b", [("imdb", "x")], [], None), ("c", [("imdb", "y")], [], None), ("d", [("tmdb", "5")], [], None), ("e", [("tmdb", "1")], [], "no title")]
    ids = spark.createDataFrame([(10, "tmdb", "1"), (20, "tmdb", "5"), (21, "tmdb", "5")], "media_item_id bigint, provider string, external_id string")
    shows = spark.createDataFrame([(10, 7)], "media_item_id bigint, show_id bigint")
    matched, ambiguous, added = h.match_in_rounds(spark.createDataFrame(plays, ident), ids, ids.select("media_item_id").limit(0), shows)
    assert sorted(map(tuple, matched.collect())) == [("a", 10, 1), ("b", 10, 2)]
    assert [r["id"] for r in ambiguous.collect()] == ["d"]
    assert sorted(map(tuple, added.collect())) == [(7, "tvdb", "9"), (10, "imdb", "x")]
