"""Filling of missing descriptive fields from a table of provider answers; nothing is fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialedger.operators import ingest

FIELDS = ("summary", "tagline", "studio", "audience_rating")
DONE = ("succeeded", "not_found")


def missing_any(fields: list[str]) -> Column:
    """whether any of the fields is null."""
    return F.greatest(*[F.col(c).isNull() for c in fields], F.lit(False))


def incomplete(items: DataFrame, fields: list[str], images: DataFrame) -> DataFrame:
    """items that miss one of the fields or a poster."""
    held = posters(images).select(F.col("media_item_id").alias("id")).withColumn("_has", F.lit(True))
    return items.join(held, "id", "left").where(missing_any(fields) | F.col("_has").isNull()).select(*items.columns)


def candidates(items: DataFrame, identifiers: DataFrame, records: DataFrame, fields: list[str], images: DataFrame | None = None) -> DataFrame:
    """Identifiers of items that miss a field (with ``images`` also a poster) and were not answered yet, with
    ``attempts`` and ``checked_at`` so far.

    Order for a limit: never tried first, then the longest unchecked, item, identifier (see ``in_order``).
    """
    short = items.select(F.col("id").alias("media_item_id"), "kind", missing_any(fields).alias("_short"))
    if images is not None:
        short = short.join(posters(images).withColumn("_has", F.lit(True)), "media_item_id", "left").withColumn("_short", F.col("_short") | F.col("_has").isNull()).drop("_has")
    short = short.where("_short").drop("_short")
    done = records.select("media_item_id", "provider", "status", "attempts", "checked_at")
    rows = identifiers.join(short, "media_item_id").join(done, ["media_item_id", "provider"], "left")
    return rows.where(F.col("status").isNull() | ~F.col("status").isin(*DONE))


def in_order(rows: DataFrame, n: int | None = None) -> DataFrame:
    rows = rows.orderBy(F.when(F.col("status").isNull(), 0).otherwise(1), F.col("checked_at").asc_nulls_first(), "media_item_id", "provider", "external_id")
    return rows if n is None else rows.limit(n)


def posters(images: DataFrame) -> DataFrame:
    """Items that have a poster."""
    return images.where("image_type = 'poster'").select("media_item_id").distinct()


def given(answers: DataFrame) -> DataFrame:
    """Answers that hold something: those without a ``status`` or with succeeded."""
    return answers.where("status IS NULL OR status = 'succeeded'") if "status" in answers.columns else answers


def with_fallback(answers: DataFrame, language: str, fallback: str, fields: list[str]) -> DataFrame:
    """One answer per (provider, external_id) in ``language``; what it lacks comes from ``fallback``.

    Empty texts and lists are lacking. A ``status`` is that of the first language; a failed fallback is left out.
    """
    key = ["provider", "external_id"]
    kinds = {f.name: f.dataType.typeName() for f in answers.schema.fields}
    empty = {"array": lambda c: F.when(F.size(c) > 0, F.col(c)), "string": lambda c: F.nullif(F.col(c), F.lit(""))}
    value = lambda c: empty.get(kinds[c], F.col)(c)
    status = [F.max("status").alias("status")] if "status" in answers.columns else []
    one = lambda rows, lang, p, more: rows.where(F.col("language") == lang).groupBy(*key).agg(*[F.first(value(c), ignorenulls=True).alias(f"{p}{c}") for c in fields], *more)
    both = one(answers, language, "a_", status).join(one(given(answers), fallback, "b_", []), key, "left")
    return both.select(*key, *[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in fields], *["status" for _ in status])


def enrich(items: DataFrame, wanted: DataFrame, answers: DataFrame, fields: list[str]) -> DataFrame:
    """Items with null fields filled from the answers to their candidates; fields with a value never change.

    Of several answers for one item, the smallest identifier that has the value counts.
    """
    rank = F.struct("provider", "external_id")
    found = wanted.select("media_item_id", "provider", "external_id").join(given(answers), ["provider", "external_id"])
    pick = [F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(f"_{c}") for c in fields]
    new = found.groupBy(F.col("media_item_id").alias("id")).agg(*pick)
    return items.join(new, "id", "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in fields else F.col(c) for c in items.columns])


def enriched_genres(genres: DataFrame, wanted: DataFrame, answers: DataFrame) -> DataFrame:
    """(media_item_id, normalized_name) of the items' genres and those of their answers' ``genres``, each once."""
    found = wanted.select("media_item_id", "provider", "external_id").join(given(answers), ["provider", "external_id"])
    return genres.select("media_item_id", "normalized_name").unionByName(ingest.genre_rows(found).select("media_item_id", "normalized_name")).distinct()


def enriched_images(images: DataFrame, wanted: DataFrame, answers: DataFrame) -> DataFrame:
    """Images (media_item_id, image_type, provider, source_url, cache_status) and, for items without a poster, the one of
    the smallest identifier whose answer has ``poster_url`` and ``poster_provider``."""
    found = wanted.select("media_item_id", "provider", "external_id").join(given(answers), ["provider", "external_id"])
    found = found.where("poster_url <> '' AND poster_provider <> ''").join(posters(images), "media_item_id", "left_anti")
    new = found.groupBy("media_item_id").agg(F.min_by(F.struct("poster_provider", "poster_url"), F.struct("provider", "external_id")).alias("p"))
    columns = ("media_item_id", "image_type", "provider", "source_url", "cache_status")
    return images.select(*columns).unionByName(
        new.select("media_item_id", F.lit("poster").alias("image_type"), F.col("p.poster_provider").alias("provider"), F.col("p.poster_url").alias("source_url"), F.lit("pending").alias("cache_status"))
    )


def records_after(wanted: DataFrame, answers: DataFrame) -> DataFrame:
    """The record of each try: succeeded with an answer, failed if the answer's ``status`` says so, else not_found; one
    attempt more. Of several identifiers succeeded counts first, then failed."""
    status = F.coalesce("status", F.lit("succeeded")) if "status" in answers.columns else F.lit("succeeded")
    hit = answers.select("provider", "external_id", status.alias("_hit")).distinct()
    rows = wanted.drop("status").join(hit, ["provider", "external_id"], "left")
    any_of = lambda s: F.coalesce(F.bool_or(F.col("_hit") == s), F.lit(False))
    return rows.groupBy("media_item_id", "provider").agg(
        F.when(any_of("succeeded"), "succeeded").when(any_of("failed"), "failed").otherwise("not_found").alias("status"), (F.coalesce(F.max("attempts"), F.lit(0)) + 1).alias("attempts")
    )


def repaired(records: DataFrame, messages: list[str]) -> DataFrame:
    """Failed records with one of the known messages become not_found."""
    known = (F.col("status") == "failed") & F.col("message").isin(*messages)
    return records.withColumn("status", F.when(known, "not_found").otherwise(F.col("status")))
