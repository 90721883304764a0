from pyspark.sql import functions as F

from medialedger.operators import enrichment, reports


def test_secrets_are_not_projected(spark):
    rows = reports.source_rows(spark.createDataFrame([(1, "x"), (2, " "), (3, None)], "id bigint, secret string"))
    assert rows.columns == ["id", "has_secret"] and [tuple(r) for r in rows.orderBy("id").collect()] == [(1, True), (2, False), (3, False)]


def test_known_failures_become_not_found(spark):
    rows = spark.createDataFrame([(1, "failed", "gone"), (2, "failed", "other"), (3, "succeeded", "gone"), (4, "failed", None)], "id int, status string, message string")
    assert [r["status"] for r in enrichment.repaired(rows, ["gone"]).orderBy("id").collect()] == ["not_found", "failed", "succeeded", "failed"]


def test_language_fallback_fills_only_gaps(spark):
    rows = spark.createDataFrame([("tmdb", "1", "pt", "a", None), ("tmdb", "1", "en", "b", "c"), ("tmdb", "2", "en", "d", "e")], "provider string, external_id string, language string, summary string, tagline string")
    assert [tuple(r) for r in enrichment.with_fallback(rows, "pt", "en", ["summary", "tagline"]).collect()] == [("tmdb", "1", "a", "c")]


def test_progress_is_clamped(spark):
    rows = spark.createDataFrame([(0, 10), (5, 10), (10, 10), (5, 0)], "s int, t int")
    assert [r[0] for r in rows.select(reports.progress(F.col("s"), F.col("t"))).collect()] == [1, 50, 99, 1]


def test_enrichment_adds_genres_and_posters(spark):
    schema = "provider string, external_id string, language string, summary string, genres array<string>, poster_url string, poster_provider string, status string"
    rows = [("tmdb", "1", "pt", "", [], "", "tmdb", None), ("tmdb", "1", "en", "s", [" New  Wave", "drama"], "u1", "tmdb", None), ("tmdb", "2", "pt", "x", ["War"], "u2", "tmdb", "failed"), ("tmdb", "3", "pt", "y", ["Drama"], "u3", "tmdb", None)]
    answers = enrichment.with_fallback(spark.createDataFrame(rows, schema), "pt", "en", ["summary", "genres", "poster_url", "poster_provider"])
    items = spark.createDataFrame([(1, "movie", None), (2, "movie", None), (3, "movie", "own"), (4, "movie", "own")], "id bigint, kind string, summary string")
    ids = spark.createDataFrame([(i, "tmdb", str(i)) for i in (1, 2, 3, 4)], "media_item_id bigint, provider string, external_id string")
    old = spark.createDataFrame([(2, "tmdb", "failed", 1, None)], "media_item_id bigint, provider string, status string, attempts int, checked_at timestamp_ntz")
    images = spark.createDataFrame([(4, "poster", "own", "o4", "cached"), (3, "backdrop", "own", "b3", "cached")], "media_item_id bigint, image_type string, provider string, source_url string, cache_status string")
    wanted = enrichment.candidates(items, ids, old, ["summary"], images)
    assert sorted(r["media_item_id"] for r in wanted.collect()) == [1, 2, 3]
    assert {r["id"]: r["summary"] for r in enrichment.enrich(items, wanted, answers, ["summary"]).collect()} == {1: "s", 2: None, 3: "own", 4: "own"}
    genres = spark.createDataFrame([(1, "drama"), (4, "noir")], "media_item_id bigint, normalized_name string")
    assert sorted(map(tuple, enrichment.enriched_genres(genres, wanted, answers).collect())) == [(1, "drama"), (1, "new wave"), (3, "drama"), (4, "noir")]
    assert sorted((r[0], r[1], r[3]) for r in enrichment.enriched_images(images, wanted, answers).collect()) == [(1, "poster", "u1"), (3, "backdrop", "b3"), (3, "poster", "u3"), (4, "poster", "o4")]
    records = enrichment.records_after(wanted, answers.where("external_id <> '3'"))
    assert sorted((r["media_item_id"], r["status"], r["attempts"]) for r in records.collect()) == [(1, "succeeded", 1), (2, "failed", 2), (3, "not_found", 1)]
