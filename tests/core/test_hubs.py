"""Keys that hold a large part of all rows: the same results, and their rows spread over tasks."""

import random

from pyspark.sql import functions as F

from medialedger import hubs, tables
from medialedger.identity import merge
from medialedger.identity.components import connected_components
from medialedger.operators import catalog


def roots(edges):
    """Smallest node that each node reaches, by a plain union of sets."""
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def test_join_by_key_equals_a_plain_join_and_spreads_a_hub(spark):
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.4 else rng.randint(2, 300), i) for i in range(3000)] + [(None, -1), (None, -2), (999, -3)]
    df = spark.createDataFrame(rows, "k int, v bigint")
    per_key = df.where("k <> 999").groupBy("k").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    got = hubs.join_by_key(df, per_key, ["k"], "v", hub_rows=100)
    want = df.join(per_key, "k").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # Without hubs as with them, and for an empty table.
    assert sorted(map(tuple, hubs.join_by_key(df, per_key, ["k"], "v").collect())) == sorted(map(tuple, want.collect()))
    assert hubs.join_by_key(df.limit(0), per_key.limit(0), ["k"], "v", 1).count() == 0
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("-1", "false", "16"), strict=True):
        spark.conf.set(n, v)
    try:
        hub = lambda d: d.where("k = 1").groupBy(F.spark_partition_id()).count().collect()
        plain, salted = hub(df.join(per_key, "k")), hub(hubs.join_by_key(df, per_key, ["k"], "v", hub_rows=100))
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert len(plain) == 1 and len(salted) > 8 and max(r["count"] for r in salted) < plain[0]["count"] / 3


def test_components_of_hubs(spark):
    rng = random.Random(2)
    for center in (0, 5000):  # a hub that is the smallest node, and one that is the largest
        edges = [(center, i) for i in range(1, 800)] + [(rng.randint(1, 4999), rng.randint(1, 4999)) for _ in range(1500)] + [(7, 7)]
        df = spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")
        got = {r["node"]: r["root"] for r in connected_components(df, "a", "b", tables.written, tables.discard, hub_rows=50).collect()}
        want = roots(e for e in edges if e[0] != e[1])
        assert got == want
    none = df.limit(0)
    assert connected_components(none, "a", "b", tables.written, hub_rows=1).collect() == []


def test_groups_plans_and_availability_of_hubs(spark):
    rng = random.Random(3)
    n = 600
    items = spark.createDataFrame([(i, rng.choice(("movie", "show"))) for i in range(n)], "id bigint, kind string")
    ids = [(i, "tmdb", "hub" if rng.random() < 0.4 else f"t{rng.randint(0, 400)}") for i in range(n)] + [(i, "imdb", f"m{rng.randint(0, 900)}") for i in range(n)]
    identifiers = spark.createDataFrame(ids, "media_item_id bigint, provider string, external_id string")
    refs = spark.createDataFrame([(i, 1 + i % 2, i % 3 > 0) for i in range(0, n, 2)] + [(i, 2, True) for i in range(1, n, 4)], "media_item_id bigint, source_id int, available boolean")
    sources = spark.createDataFrame([(1, "plex"), (2, "jellyfin")], "id int, connector_type string")
    shown = lambda df: sorted(map(repr, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))
    assert shown(merge.shared_identifiers(items, identifiers, hub_rows=20)) == shown(merge.shared_identifiers(items, identifiers))
    kind = {r["id"]: r["kind"] for r in items.collect()}
    by_key = {}
    for i, p, x in ids:
        by_key.setdefault((kind[i], p, x), []).append(i)
    want = roots((m[0], x) for m in by_key.values() for x in m[1:] if x != m[0])
    members = merge.groups(items, identifiers, tables.written, drop=tables.discard, hub_rows=20)
    assert {r["media_item_id"]: r["group_id"] for r in members.collect()} == want
    assert shown(merge.merge_plan(members, refs, sources, hub_rows=20)) == shown(merge.merge_plan(members, refs, sources))
    have = {}
    name = {1: "plex", 2: "jellyfin"}
    for r in refs.where("available").collect():
        have.setdefault(r["media_item_id"], set()).add(name[r["source_id"]])
    got = {r["media_item_id"]: {k for k in ("plex", "jellyfin") if r[f"on_{k}"]} for r in catalog.shared_availability(items, identifiers, refs, sources, hub_rows=20).collect()}
    through = {}
    for m in by_key.values():
        flags = set().union(*(have.get(i, set()) for i in m))
        for i in m:
            if flags:
                through.setdefault(i, set()).update(flags)
    assert got == through
