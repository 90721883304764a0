"""Merkle manifest of a dataset: a tree of digests for each group, one over the groups, and inclusion proofs for all leaves.

Leaves of a group are ranked in order; every run of ``FANOUT`` consecutive nodes becomes the digest of their texts, until one is
left, the group's subroot. Subroots, in bytewise order of the groups, become the root in the same way.

The store maps a digest to its children (``Tree.records``). It is written in blocks of ``LEVELS`` levels, each row the map of one
subtree of up to ``SPAN`` nodes, found by the digest at its top. Requests for leaves start at the root: those with the same leading
digits of their rank go down together, one block a step, where each digit of the rank picks a child and the others are collected.
The segments come top-down, so they are reversed for the proof. There are as many steps as a rank has digits to the base ``SPAN``,
and no digest of the upper levels is ever a join key for more than the nodes right below it.

Everything is in DataFrame functions; a group may hold any share of the rows, since ranks come from a range sort of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from medialedger.llm.store import discard, materialize, small

FANOUT = 3
#: Levels of a block, and how many nodes stand below its top at most.
LEVELS = 4
SPAN = FANOUT**LEVELS


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """A value that can't be taken for another one or run into the next: its UTF-8 length, a colon and itself; null is a dash."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(*columns: Column) -> Column:
    return digest(*map(field, columns))


def ranked(rows: DataFrame, by: str, order: list[Column], name: str) -> DataFrame:
    """A written table of ``rows`` with ``rank`` (gapless from 0 within each ``by``, nulls of the order first) and ``n``, the group's
    rows. A range sort of all rows and the counts of each group in each partition; no group is ever held by one task."""
    placed = rows.repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("_part", F.shiftright("_at", 33)), f"{name}-sorted")
    runs = placed.groupBy(by, "_part").agg(F.min("_at").alias("_begin"), F.count("*").alias("_rows"))
    parts = W.partitionBy(by)  # as many rows as partitions at most
    before = F.coalesce(F.sum("_rows").over(parts.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(by, "_part", (F.col("_begin") - before).alias("_zero"), F.sum("_rows").over(parts).alias("n"))
    runs = materialize(runs, f"{name}-runs")
    out = placed.join(small(runs), [by, "_part"]).select(*rows.columns, (F.col("_at") - F.col("_zero")).alias("rank"), "n")
    out = materialize(out, name)
    discard(placed, runs)
    return out


@dataclass
class Tree:
    """The written blocks of trees of digests, by round from the leaves up: tree, block, digest (at the top), steps (levels within),
    children (map of digest to children), and in round 0 the items (rank, digest and what the caller keeps of each leaf)."""

    blocks: list[DataFrame]
    roots: DataFrame

    def records(self) -> DataFrame:
        """The content-addressed store: every inner node once, by its digest, with the digests of its children in order."""
        parts = [b.select(F.explode("children").alias("digest", "children")) for b in self.blocks]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.dropDuplicates(["digest"])

    def discard(self) -> None:
        discard(*self.blocks, self.roots)


def _up(level: Column) -> Column:
    """The digests of each run of children."""
    run = lambda i: F.sha2(F.array_join(F.slice(level, i * FANOUT + 1, FANOUT), "").cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FANOUT).cast("int")), run)


def _steps(n: Column) -> Column:
    """How many levels of a block stand over n nodes: none over a lone one."""
    steps = F.lit(LEVELS)
    for k in range(LEVELS - 1, -1, -1):
        steps = F.when(n <= FANOUT**k, k).otherwise(steps)
    return steps.cast("int")


def grow(leaves: DataFrame, name: str) -> Tree:
    """The trees over ranked leaves (tree, rank, n, digest and more columns to keep). A group of one leaf has that as its root."""
    keep = [c for c in leaves.columns if c not in ("tree", "rank", "n", "digest")]
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes, blocks, roots = leaves, [], None
    while True:
        item = F.struct("rank", "digest", *(keep if not blocks else []))
        held = nodes.groupBy("tree", F.floor(F.col("rank") / SPAN).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"), F.max("n").alias("n"))
        held = held.withColumn("steps", _steps(F.col("n"))).withColumn("bottom", F.transform("items", lambda x: x["digest"]))
        numbers = F.slice(F.array(*map(F.lit, range(1, LEVELS + 1))), 1, F.col("steps"))
        levels = F.aggregate(numbers, F.array("bottom"), lambda acc, _: F.concat(acc, F.array(_up(F.element_at(acc, -1)))))
        held = held.withColumn("levels", levels)
        kids = lambda k, i: F.slice(F.element_at(F.col("levels"), k), i * FANOUT + 1, FANOUT)
        of_level = lambda k: F.transform(F.element_at(F.col("levels"), k + 1), lambda d, i: F.struct(d.alias("digest"), kids(k, i).alias("children")))
        store = F.map_from_entries(F.array_distinct(F.flatten(F.transform(numbers, of_level))))
        top = F.element_at(F.element_at("levels", -1), 1)
        block = held.select("tree", "block", "n", "steps", top.alias("digest"), store.alias("children"), F.size("items").alias("size"), *([] if blocks else ["items"]))
        blocks.append(materialize(block, f"{name}-blocks-{len(blocks)}"))
        done = blocks[-1].where(F.col("n") <= SPAN).select("tree", "digest", F.lit(len(blocks) - 1).alias("round"))
        roots = done if roots is None else roots.unionByName(done)
        if most <= SPAN:
            return Tree(blocks, materialize(roots, f"{name}-roots"))
        most = -(-most // SPAN)
        up = blocks[-1].where(F.col("n") > SPAN)
        nodes = up.select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / SPAN).cast("bigint").alias("n"), "digest")


def _descend(j: Column) -> Column:
    """From the top of a block to its j-th node below: that digest, and what was passed by on each level, from the top down."""
    powers = F.slice(F.array(*(F.lit(FANOUT**k) for k in range(LEVELS - 1, -1, -1))), F.lit(LEVELS + 1) - F.col("steps"), F.col("steps"))
    passed = "array<struct<before: string, after: string>>"

    def step(at: Column, power: Column) -> Column:
        digit = F.floor(j / power).cast("int") % FANOUT

        def pick(kids: Column) -> Column:
            others = F.struct(F.array_join(F.slice(kids, F.lit(1), digit), "").alias("before"), F.array_join(F.slice(kids, digit + 2, F.lit(FANOUT)), "").alias("after"))
            return F.struct(F.get(kids, digit).alias("digest"), F.concat(at["path"], F.array(others)).alias("path"))

        return F.element_at(F.transform(F.array(F.element_at(F.col("children"), at["digest"])), pick), 1)

    return F.aggregate(powers, F.struct(F.col("digest").alias("digest"), F.array().cast(passed).alias("path")), step)


def descend(tree: Tree, starts: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """The leaves (tree, rank, digest, what was kept, and the columns of ``starts``) with ``path``, the siblings from the top down.

    ``starts`` has a row for each tree: tree, digest (its root), round, path (of what stands above it) and columns to hand down.
    ``requests`` (tree, rank) names the leaves that are asked for; without it all are. Only blocks that hold some are read.
    """
    keys = ["tree", "block", "digest"]  # the digest finds the block; the place tells equal subtrees apart
    handed = [c for c in starts.columns if c not in (*keys, "round", "path")]
    begin = lambda r: starts.where(F.col("round") == r).select("tree", F.lit(0).cast("bigint").alias("block"), "digest", "path", *handed)
    frontier = begin(len(tree.blocks) - 1)
    for r in range(len(tree.blocks) - 1, -1, -1):
        if requests is not None:
            asked = requests.select("tree", F.floor(F.col("rank") / SPAN ** (r + 1)).alias("block")).distinct()
            frontier = frontier.join(asked, ["tree", "block"], "left_semi")
        met = frontier.join(tree.blocks[r], keys)
        if r:
            below = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda j: F.struct((F.col("block") * SPAN + j).alias("block"), _descend(j).alias("d")))
            down = met.select("tree", "path", *handed, F.explode(below).alias("x"))
            frontier = down.select("tree", "x.block", "x.d.digest", F.concat("path", "x.d.path").alias("path"), *handed).unionByName(begin(r - 1))
    leaves = met.select("tree", "path", *handed, F.explode(F.transform("items", lambda x, j: F.struct(x.alias("item"), _descend(j)["path"].alias("path")))).alias("x"))
    leaves = leaves.select("tree", "x.item.*", F.concat("path", "x.path").alias("path"), *handed)
    return leaves if requests is None else leaves.join(requests.select("tree", "rank").distinct(), ["tree", "rank"], "left_semi")


def proof(path: Column) -> Column:
    """The text of a proof: siblings level by level from the leaf to the root, each level left to right."""
    return F.array_join(F.transform(F.reverse(path), lambda s: F.concat(s["before"], s["after"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path lead to."""
    return F.aggregate(F.reverse(path), leaf, lambda at, s: F.sha2(F.concat(s["before"], at, s["after"]).cast("binary"), 256))


def manifest(rows: DataFrame, group: Column, order: str, leaf: Column, found: Column | None = None, requests: Column | None = None) -> DataFrame:
    """For each row its ``order`` column, leaf, subroot, root, path (siblings from the root down), ``found_leaf``, folded_root (from
    the found leaf and the path) and verified (it equals the root).

    ``leaf`` is the digest of a row as it was recorded, ``found`` (null, or None: the same) that of the row as it is found now.
    Groups are told apart by the text of ``group``, null is one of them and comes first. Leaves of a group come by ``order``, nulls
    first, then by their digest; equal rows are leaves of their own, in no particular order, which no result shows. ``requests``
    (a condition on ``order``) asks for the proofs of some rows only; the trees are always over all. An empty table has no rows.
    """
    tree = F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), group.cast("string")))
    now = F.lit(None).cast("string") if found is None else found
    leaves = materialize(rows.select(tree.alias("tree"), F.col(order).alias("key"), leaf.alias("digest"), now.alias("found")), "merkle-leaves")
    spread = leaves.withColumn("copy", F.monotonically_increasing_id())  # so that many equal rows are sorted by many tasks
    placed = ranked(spread, "tree", [F.col("key").asc_nulls_first(), F.col("digest"), F.col("copy")], "merkle-ranks").drop("copy")
    discard(leaves)
    trees = grow(placed, "merkle")
    subroots = trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    placed_groups = ranked(subroots, "tree", [F.col("group")], "merkle-groups")
    top = grow(placed_groups, "merkle-top")
    start = top.roots.select("tree", "digest", "round", F.array().cast("array<struct<before: string, after: string>>").alias("path"), F.col("digest").alias("root"))
    above = descend(top, start).select(F.col("group").alias("tree"), "path", "root")
    starts = trees.roots.withColumn("subroot", F.col("digest")).join(above, "tree")
    asked = None if requests is None else placed.where(requests).select("tree", "rank")
    out = descend(trees, starts, asked)
    out = out.select(F.col("key").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "path", F.coalesce("found", "digest").alias("found_leaf"))
    out = out.withColumn("folded_root", fold(F.col("found_leaf"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
