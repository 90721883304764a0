from datetime import datetime

from pyspark.sql import functions as F

from medialedger.operators import creation

ITEMS = "id bigint, kind string, parent_id bigint, title string, year int, season_number int, episode_number int"
IDS = "media_item_id bigint, provider string, external_id string"
_I = "array<struct<provider: string, external_id: string>>"
PLAYS = f"id string, kind string, title string, year int, ids {_I}, show_title string, show_year int, show_ids {_I}, season int, number int"
STAGED = (
    "source_id int, external_id string, library_id bigint, kind string, title string, season_number int, show_external_id string, show_title string, season_external_id string, "
    "artist_external_id string, artist_title string, album_external_id string, album_title string"
)
REFS = "source_id int, external_id string, media_item_id bigint, library_id bigint, available boolean, last_seen_at timestamp_ntz, unavailable_since timestamp_ntz"
T0 = datetime(2024, 1, 1)


def test_numbers_are_dense_whatever_the_partitions(spark):
    rows = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    a = {r["k"]: r["id"] for r in creation.numbered(rows, ["k"], 100).collect()}
    assert sorted(a.values()) == list(range(101, 5101))
    assert a == {r["k"]: r["id"] for r in creation.numbered(rows.repartition(7), ["k"], 100).collect()}


def tree(items):
    """Titles from the top down."""
    held = {r["id"]: r for r in items.collect()}

    def path(r):
        return (*(path(held[r["parent_id"]]) if r["parent_id"] else ()), (r["kind"], r["title"], r["season_number"], r["episode_number"]))

    return sorted(map(repr, map(path, held.values())))


def test_history_items_are_created_once(spark):
    items = spark.createDataFrame([(1, "show", None, "Pokémon", 1997, None, None), (2, "season", 1, "Season 1", None, 1, None), (3, "season", 1, "Season 1", None, 1, None), (4, "movie", None, "Alien", 1979, None, None), (5, "movie", None, "Alien", 1979, None, None)], ITEMS)
    ids = spark.createDataFrame([(1, "tvdb", "p"), (4, "imdb", "x"), (5, "imdb", "x")], IDS)
    show, new = [("tvdb", "p")], [("tvdb", "n"), ("imdb", "n")]
    plays = [
        ("a", "episode", "One", None, [("tvdb", "e1")], "Pokemon", 1997, show, 1, 1), ("b", "episode", "One", None, [("tvdb", "e1"), ("imdb", "e1")], "Pokemon", 1997, show, 1, 1),
        ("c", "episode", "Two", None, [("imdb", "e1")], "Pokemon", 1997, show, 1, 1), ("d", "episode", "Pilot", None, [], "New", 2000, new, 2, 1), ("e", "episode", "Pilot", None, [], "New", 2000, new[:1], 2, 1),
        ("f", "episode", "Later", None, None, "Bare", None, [], 1, 3), ("g", "movie", "Heat", 1995, [("imdb", "h")], None, None, None, None, None), ("h", "movie", "Heat", 1995, [("imdb", "h"), ("tmdb", "h")], None, None, None, None, None),
        ("i", "movie", "Ámbar", None, [], None, None, None, None, None), ("j", "movie", "amb ar", None, [], None, None, None, None, None), ("k", "movie", " AMBAR ", None, [], None, None, None, None, None),
        ("l", "movie", "Alien", 1979, [("imdb", "x")], None, None, None, None, None), ("m", "episode", "Special", None, [("tvdb", "s")], "New", 2000, new[1:], None, None),
    ]
    plays = spark.createDataFrame(plays, PLAYS)
    none = spark.createDataFrame([], "media_item_id bigint")
    made = creation.create_history(plays, items, ids, none)
    assert [r["id"] for r in made.ambiguous.collect()] == ["l"]
    of = {r["id"]: r["media_item_id"] for r in made.plays.collect()}
    assert of["a"] == of["b"] == of["c"] and of["d"] == of["e"] and of["g"] == of["h"] and of["i"] == of["k"] != of["j"] and len(set(of.values())) == 7
    after, names = items.unionByName(made.items), ids.unionByName(made.identifiers)
    assert sorted(r["id"] for r in made.items.collect()) == list(range(6, 6 + made.items.count()))
    assert sorted((r["kind"], r["n"]) for r in made.items.groupBy("kind").agg(F.count("*").alias("n")).collect()) == [("episode", 4), ("movie", 3), ("season", 3), ("show", 2)]
    up = {r["id"]: r["parent_id"] for r in after.collect()}
    assert up[of["a"]] == 2  # the season with the lowest id
    again = creation.create_history(plays, after, names, none)
    assert again.items.isEmpty() and again.identifiers.isEmpty() and {r["id"]: r["media_item_id"] for r in again.plays.collect()} == of


def test_hierarchy_is_created_once(spark):
    items = spark.createDataFrame([(1, "show", None, "Pokémon", None, None, None), (2, "season", 1, "Season 1", None, 1, None), (3, "artist", None, "Band", None, None, None), (4, "album", 3, "Old", None, None, None), (5, "movie", None, "x", None, None, None), (6, "show", None, "Twice", None, None, None), (7, "show", None, "twice", None, None, None)], ITEMS)
    refs = spark.createDataFrame([(1, "al1", 4, 8, False, None, T0), (1, "wrong", 5, 8, True, None, None), (2, "z", 1, 9, True, None, None)], REFS)
    ep = lambda ext, season, show, title, s_ext=None: (1, ext, 8, "episode", ext, season, show, title, s_ext, None, None, None, None)
    tr = lambda ext, artist, album, title: (1, ext, 8, "track", ext, None, None, None, None, artist, f"Artist {artist}", album, title)
    staged = [ep("e1", 1, "s1", "Pokemon"), ep("e2", 2, "s1", "Pokemon"), ep("e3", 1, "s2", "New", "own"), ep("e4", 1, "wrong", "x"), ep("e5", 1, "s3", "TWICE"), tr("t1", "ar1", "al1", "Renamed"), tr("t2", "ar2", "al2", "B"), tr("t3", "ar2", "al2", "B")]
    staged = spark.createDataFrame(staged, STAGED)
    none = spark.createDataFrame([], "source_id int, external_id string, provider string, identifier string")
    ids = spark.createDataFrame([], IDS)
    got = creation.ensure_hierarchy(staged, none, items, ids, refs, T0)
    created = {(r["kind"], r["title"], r["season_number"]): r for r in got.created.collect()}
    assert set(created) == {("season", "Season 2", 2), ("show", "New", None), ("season", "Season 1", 1), ("artist", "Artist ar2", None), ("album", "B", None)}
    assert created["season", "Season 2", 2]["parent_id"] == 1 and created["season", "Season 1", 1]["parent_id"] == created["show", "New", None]["id"]
    assert sorted(r["id"] for r in created.values()) == [8, 9, 10, 11, 12]
    assert sorted((r["external_id"], r["message"]) for r in got.errors.collect()) == [("s3", "ambiguous container"), ("wrong", "conflicting hierarchy")]
    parents = {r["external_id"]: r["parent_id"] for r in got.parents.collect()}
    assert parents == {"e1": 2, "e2": created["season", "Season 2", 2]["id"], "e3": created["season", "Season 1", 1]["id"], "t1": 4, "t2": created["album", "B", None]["id"], "t3": created["album", "B", None]["id"]}
    held = {r["external_id"]: r for r in got.refs.collect()}
    assert held["al1"]["available"] and held["al1"]["unavailable_since"] is None and held["s1"]["media_item_id"] == 1 and held["s1:season:1"]["media_item_id"] == 2 and "ar1" not in held
    assert {r["id"]: r["title"] for r in got.items.collect()}[4] == "Renamed"
    again = creation.ensure_hierarchy(staged, none, got.items, ids, got.refs, T0)
    assert again.created.isEmpty() and {r["external_id"]: r["parent_id"] for r in again.parents.collect()} == parents
    assert sorted(map(repr, again.refs.collect())) == sorted(map(repr, got.refs.collect()))
