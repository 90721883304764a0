"""Connected components by alternating large-star and small-star passes (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from medialedger.hubs import HUB_ROWS, join_by_key


def connected_components(edges: DataFrame, a: str, b: str, cut: Callable[[DataFrame], DataFrame], drop: Callable[[DataFrame], None] | None = None,
                         hub_rows: int = HUB_ROWS) -> DataFrame:
    """(node, root) for every node of an undirected edge list, root being the smallest node that can be reached.

    Each pass only keeps, for every node, its edges to smaller nodes and rewires them to the smallest neighbour, so no
    pass holds more edges than the input and no neighbour list is ever gathered. ``cut`` must return its argument with
    the lineage cut, at once (a written table or an eager checkpoint); it is called once a pass, and ``drop`` with the table of the pass
    before. A node of very many edges is salted in the joins (``join_by_key``) as soon as there are ``hub_rows`` edges. Loops and repeated edges are allowed, edges with a null end are dropped; a table without edges gives no rows.
    """
    first = Observation()
    current = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
        .observe(first, F.count(F.lit(1)).alias("n"))
    )
    seen, n = None, first.get.get("n")
    while n != 0:  # an empty plan may give no count
        # Without as many edges as a hub has, no node can be one.
        met = (lambda rows, per_node: join_by_key(rows, per_node, ["u"], "v", hub_rows)) if 2 * (n or 0) > hub_rows else (lambda rows, per_node: rows.join(per_node, "u"))
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = met(both, smallest).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = met(large, least).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        counted = Observation()  # of the pass that writes the edges, so they are not read again to be counted
        edges_now = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().observe(counted, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        before, current = current, cut(edges_now)
        if drop is not None:
            drop(before)
        # Every pass keeps the components; when a pass changes nothing, each node points at its root.
        now = counted.get
        if now == seen:
            break
        seen, n = now, now.get("n")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
