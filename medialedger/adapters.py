"""The test tables as media tables, by SQL text that Spark and DuckDB both read."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: Base tables that the views below read.
BASE = ("part", "region", "nation", "customer", "lineitem", "orders", "events")
VIEWS = {
    "src": "SELECT * FROM (VALUES (1,'plex',true),(2,'jellyfin',true)) AS t(id, connector_type, enabled)",
    "media_items": """SELECT CAST(1000000 + p_partkey AS BIGINT) AS id, 'movie' AS kind, CAST(NULL AS BIGINT) AS parent_id, p_name AS title,
       CAST(1975 + p_size AS INT) AS year, CAST(NULL AS INT) AS season_number, CAST(NULL AS INT) AS episode_number,
       CAST(p_size AS BIGINT) * 60000 AS duration_ms, p_retailprice AS audience_rating FROM part
UNION ALL SELECT CAST(2000000 + r_regionkey AS BIGINT), 'show', NULL, r_name, NULL, NULL, NULL, NULL, NULL FROM region
UNION ALL SELECT CAST(3000000 + n_nationkey AS BIGINT), 'season', CAST(2000000 + n_regionkey AS BIGINT), n_name, NULL,
       CAST(n_nationkey AS INT), NULL, NULL, NULL FROM nation
UNION ALL SELECT CAST(4000000 + c_custkey AS BIGINT), 'episode', CAST(3000000 + c_nationkey AS BIGINT), c_name, NULL,
       CAST(c_nationkey AS INT), CAST(c_custkey AS INT), NULL, c_acctbal FROM customer""",
    "source_media_refs": """SELECT id AS media_item_id, 1 AS source_id, concat('p', CAST(id AS STRING)) AS external_id, id % 5 <> 0 AS available, CAST(id % 12 * 2 AS BIGINT) AS library_id
  FROM media_items WHERE id % 3 <> 0
UNION ALL SELECT id, 2, concat('j', CAST(id AS STRING)), id % 7 <> 0, CAST(id % 12 * 2 + 1 AS BIGINT) FROM media_items WHERE id % 2 = 0""",
    "item_dates": """SELECT id, CASE WHEN id % 3 = 0 THEN concat('The ', title) END AS sort_title, CASE WHEN id % 4 = 0 THEN concat('Orig ', title) END AS original_title,
       CASE WHEN id % 5 <> 0 THEN concat('20', lpad(CAST(id % 24 AS STRING), 2, '0')) END AS source_added_at, concat('19', lpad(CAST(id % 90 AS STRING), 2, '0')) AS created_at,
       concat('20', lpad(CAST(id % 17 AS STRING), 2, '0')) AS updated_at FROM media_items""",
    "media_identifiers": """SELECT CAST(1000000 + p_partkey AS BIGINT) AS media_item_id, 'tmdb' AS provider,
       concat(p_name, '/', p_brand, '/', p_type) AS external_id FROM part
UNION ALL SELECT CAST(1000000 + p_partkey AS BIGINT), 'imdb',
       concat(p_name, '/', p_type, '/', CAST(p_size AS STRING)) FROM part""",
    "media_genres": "SELECT CAST(1000000 + p_partkey AS BIGINT) AS media_item_id, lower(p_type) AS normalized_name FROM part",
    "watch_events": """SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS id, CAST(1000000 + l_partkey AS BIGINT) AS media_item_id,
       CAST(1 + l_suppkey % 2 AS INT) AS source_id, l_shipdate AS watched_at, l_linestatus = 'F' AS completed FROM lineitem
UNION ALL SELECT -1 - o_orderkey, CAST(4000000 + o_custkey AS BIGINT), CAST(1 + o_orderkey % 2 AS INT),
       o_orderdate, o_orderstatus = 'F' FROM orders""",
    "watch_states": """SELECT media_item_id, source_id, CAST(count(*) AS INT) AS view_count, max(watched_at) AS last_watched_at,
       bool_or(completed) AS completed, CASE WHEN max(id) % 4 = 0 THEN 60000 END AS progress_ms, max(watched_at) AS observed_at
  FROM watch_events WHERE id % 3 = 0 GROUP BY media_item_id, source_id""",
    "playback_stream": """SELECT event_id, ts AS occurred_at, CAST(1 + user_id % 2 AS INT) AS source_id, CAST(user_id AS STRING) AS playback_user,
       concat('e', CAST(CAST(floor(value) AS BIGINT) % 20 AS STRING)) AS external_id,
       CASE event_type WHEN 'view' THEN 'media.play' WHEN 'click' THEN 'media.resume' WHEN 'error' THEN 'media.pause'
            WHEN 'signup' THEN 'media.stop' WHEN 'purchase' THEN 'media.scrobble' END AS event_type,
       CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS progress_percent FROM events""",
    "libraries": """SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(1 + n_nationkey % 2 AS INT) AS source_id, concat('l', CAST(n_nationkey AS STRING)) AS external_id, n_name AS name,
       CASE n_regionkey % 3 WHEN 0 THEN 'movie' WHEN 1 THEN 'show' ELSE 'music' END AS media_type, n_nationkey % 4 <> 0 AS enabled, n_nationkey % 5 <> 0 AS available FROM nation""",
    "runs": """SELECT o_orderkey AS id, o_orderpriority AS job_id, CAST(1 + o_custkey % 2 AS INT) AS source_id,
       CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'queued' ELSE 'running' END AS status, o_orderdate AS created_at FROM orders""",
    "staged": """SELECT CAST(1 + p_partkey % 2 AS INT) AS source_id, concat('s', CAST(p_partkey AS STRING)) AS external_id, 'movie' AS kind, p_name AS title, CAST(1975 + p_size AS INT) AS year,
       CAST(1000000 + p_partkey AS BIGINT) AS item_id, CAST(NULL AS INT) AS season_number, CAST(NULL AS STRING) AS show_external_id, CAST(NULL AS STRING) AS show_title, p_type AS genre,
       concat(p_name, '/', p_brand, '/', p_type) AS identifier FROM part
UNION ALL SELECT CAST(1 + c_custkey % 2 AS INT), concat('c', CAST(c_custkey AS STRING)), 'episode', c_name, NULL, CAST(4000000 + c_custkey AS BIGINT), CAST(c_custkey % 9 AS INT),
       concat('t', CAST(c_nationkey AS STRING)), c_mktsegment, c_mktsegment, concat('c', CAST(c_custkey AS STRING)) FROM customer""",
}


def with_views(names: tuple[str, ...] = tuple(VIEWS)) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)


class Tables:
    """The views over one data folder, each read when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _view(self, name: str) -> DataFrame:
        needed = {"source_media_refs": ("media_items", name), "item_dates": ("media_items", name), "watch_states": ("watch_events", name)}.get(name, (name,))
        text = with_views(needed)
        for base in BASE:
            text = text.replace(f"FROM {base}", f"FROM parquet.`{self.folder}/{base}.parquet`")
        return self.spark.sql(f"{text} SELECT * FROM {name}")

    sources = cached_property(lambda self: self._view("src"))
    items = cached_property(lambda self: self._view("media_items"))
    refs = cached_property(lambda self: self._view("source_media_refs"))
    identifiers = cached_property(lambda self: self._view("media_identifiers"))
    genres = cached_property(lambda self: self._view("media_genres"))
    events = cached_property(lambda self: self._view("watch_events"))
    states = cached_property(lambda self: self._view("watch_states"))
    playback = cached_property(lambda self: self._view("playback_stream"))
    libraries = cached_property(lambda self: self._view("libraries"))
    runs = cached_property(lambda self: self._view("runs"))
    item_dates = cached_property(lambda self: self._view("item_dates"))
    staged = cached_property(lambda self: self._view("staged"))
