"""Near-duplicate embeddings of one label by cosine, found through an inverted multi-index.

1. Equal vectors of a label are one node with a weight, so copies never meet.
2. Two codebooks are fitted on the halves of a bounded sample of unit vectors; their product is the grid of cells. A node lies in
   the cell of its nearest codes. Multi-sequence traversal visits the cells in rising order of a lower bound on the distance from
   the node to anything in the cell: the sum over the halves of the squared distance to the border between its own code's region
   and the other's. Links are no longer than ``sqrt(2 - 2 * threshold)``, so once the next cell is farther than that, every link
   has been passed: with the target 1.0 recall is whole whatever the codebooks are. A lower target stops at the distance that
   passes that share of the sample's links.
3. Nodes so near the middle of their cell that any two of them are linked (the *core*) are counted, not compared. All other pairs
   of a node with a cell it visits are verified in double precision; a pair in two cells is met from the cell with the smaller
   number only and counts for both ends. Large cells are cut into parts of about ``part_rows`` rows, to all of which their
   visitors go, in a stream; a task holds one part.
4. A part hands on how many links each node has there and a spanning forest of them, never its pairs.

Rows that are near each other but neither equal nor in a core are compared pair by pair inside their cell, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from medialedger.identity.components import connected_components
from medialedger.llm.store import discard, materialize, small
from medialedger.llm.wordscan import give_back

_CODED = "vec_id bigint, label string, dim int, vec binary"
_PLACED = "node bigint, w bigint, label string, dim int, vec binary, cell int, core boolean, visits array<int>"
_FOUND = "node bigint, links bigint, other bigint"
_CHUNK = 512


def coded(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, dim, vec: the bytes of the vector, scaled by a power of two so that nothing overflows; null for vectors that
    are null, zero, without components or hold null or non-finite ones, and where the label is null."""
    kind = np.dtype("<f4" if vectors.schema[vector].dataType.elementType == FloatType() else "<f8")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = column.flatten()
            values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(sizes)
            label = batch.column("label")
            named = label.is_valid().to_numpy(zero_copy_only=False)
            out: list[bytes | None] = []
            for end, size, ok in zip(ends, sizes, named, strict=True):
                x = values[end - size : end]
                top = np.abs(x).max() if size else 0.0
                if not ok or not np.isfinite(top) or top == 0:
                    out.append(None)
                else:
                    out.append((np.ldexp(x, -int(np.frexp(top)[1])) + 0.0).astype(kind).tobytes())  # + 0.0: one zero
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), label, pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "label", "dim", "vec"])

    kept = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("string"), F.col(vector).alias("vector"))
    return kept.mapInArrow(code, _CODED)


def unit(blobs: list[bytes], dim: int) -> np.ndarray:
    """The vectors as rows of length one, in double precision."""
    kind = "<f4" if len(blobs[0]) == 4 * dim else "<f8"
    x = np.frombuffer(b"".join(blobs), dtype=kind).reshape(len(blobs), dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Codebooks:
    """The codes of both halves for one length of vectors."""

    halves: tuple[np.ndarray, np.ndarray]
    gaps: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.gaps = [np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2) for c in self.halves]

    @staticmethod
    def fit(x: np.ndarray, codes: int, passes: int = 8) -> Codebooks:
        """k-means of each half, from the row farthest from the mean and then always the one farthest from those chosen."""
        halves = []
        for part in (x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]):
            chosen = [int(np.argmax(((part - part.mean(axis=0)) ** 2).sum(axis=1)))]
            far = ((part - part[chosen[0]]) ** 2).sum(axis=1)
            while len(chosen) < min(codes, len(part)) and far.max() > 0:
                chosen.append(int(np.argmax(far)))
                far = np.minimum(far, ((part - part[chosen[-1]]) ** 2).sum(axis=1))
            c = part[chosen]
            for _ in range(passes):
                near = _squares(part, c).argmin(axis=1)
                c = np.stack([part[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
            halves.append(np.unique(c, axis=0))
        return Codebooks((halves[0], halves[1]))

    def bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each half: the nearest code, and the squared distance at least from a row to the region of each code."""
        own, low = [], []
        at = self.halves[0].shape[1]
        for part, codes, gaps in zip((x[:, :at], x[:, at:]), self.halves, self.gaps, strict=True):
            d = _squares(part, codes)
            near = d.argmin(axis=1)
            gap = gaps[near]
            border = (d - d[np.arange(len(d)), near][:, None]) / np.where(gap > 0, 2 * gap, 1)
            border[np.arange(len(d)), near] = 0
            own.append(near)
            low.append(np.maximum(border, 0) ** 2)
        return own, low

    def number(self, own: list[np.ndarray]) -> np.ndarray:
        return own[0] * len(self.halves[1]) + own[1]

    def middle(self, cells: np.ndarray) -> np.ndarray:
        """The unit vector through the middle of each cell (zero where a cell has none)."""
        c = np.concatenate([self.halves[0][cells // len(self.halves[1])], self.halves[1][cells % len(self.halves[1])]], axis=1)
        size = np.linalg.norm(c, axis=1, keepdims=True)
        return c / np.where(size > 0, size, 1)


def _squares(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ codes.T + (codes**2).sum(axis=1)[None, :], 0)


def traverse(first: np.ndarray, second: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the cells that each row visits: multi-sequence traversal of the grid of two sorted sequences.

    Every row of the sorted first sequence has a pointer into the sorted second one; the least sum of what the pointers show is
    visited next and its pointer moves on, until that sum is over ``radius``. All rows take their steps together.
    """
    order = np.argsort(first, axis=1, kind="stable"), np.argsort(second, axis=1, kind="stable")
    a, b = np.take_along_axis(first, order[0], 1), np.take_along_axis(second, order[1], 1)
    b = np.concatenate([b, np.full((len(b), 1), np.inf)], axis=1)
    at = np.arange(len(a))
    pointer = np.zeros(a.shape, dtype=np.int64)
    rows, cells = [], []
    while len(at):
        sums = a[at] + np.take_along_axis(b[at], pointer[at], 1)
        best = sums.argmin(axis=1)
        going = sums[np.arange(len(at)), best] <= radius
        at, best = at[going], best[going]
        rows.append(at)
        cells.append(order[0][at, best] * second.shape[1] + order[1][at, pointer[at, best]])
        pointer[at, best] += 1
    return np.concatenate(rows), np.concatenate(cells)


class MultiIndex:
    """Links of equal label and cosine of ``threshold`` or more."""

    def __init__(self, threshold: float = 0.98, target_recall: float = 1.0, sample_rows: int = 4096, codes: int | None = None, part_rows: int = 4096):
        self.threshold, self.target, self.sample_rows, self.codes, self.part_rows = threshold, target_recall, sample_rows, codes, part_rows
        self.angle = float(np.arccos(threshold))

    def fit(self, nodes: DataFrame, n: int) -> dict[int, tuple[Codebooks, float]]:
        """Codebooks and stopping distance for each length of vectors among ``sample_rows`` nodes, taken by a hash; other lengths
        have one cell. The number of codes follows the number of nodes, 2048 to a cell of all labels: finer cells are visited by more."""
        codes = self.codes or int(np.clip(np.ceil(np.sqrt(n / 2048)), 4, 256))
        rows = nodes.select("label", "dim", "vec", F.xxhash64("key").alias("h")).orderBy("h").limit(self.sample_rows).toPandas()
        out = {}
        for dim, own in rows.groupby("dim"):
            x = unit(own["vec"].tolist(), int(dim))
            books = Codebooks.fit(x, codes)
            out[int(dim)] = books, self._radius(books, x, own["label"].to_numpy())
        return out

    def _radius(self, books: Codebooks, x: np.ndarray, labels: np.ndarray) -> float:
        whole = 2 - 2 * self.threshold + 1e-9
        if self.target >= 1:
            return whole
        own, low = books.bounds(x)
        needed = [np.zeros(0)]
        for i in range(0, len(x), _CHUNK):
            u, v = np.nonzero((x[i : i + _CHUNK] @ x.T >= self.threshold) & (labels[i : i + _CHUNK, None] == labels[None, :]))
            u, v = u[u + i != v] + i, v[u + i != v]
            needed.append(low[0][u, own[0][v]] + low[1][u, own[1][v]])
        sums = np.concatenate(needed)
        return min(whole, float(np.quantile(sums, self.target, method="higher"))) if len(sums) else whole

    def place(self, nodes: DataFrame, books: dict[int, tuple[Codebooks, float]]) -> DataFrame:
        """Each node with its cell, whether it is in the core, and the cells with larger numbers that it visits."""
        half = self.angle / 2 - 1e-9

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    part = batch.filter(pa.array(dims == dim))
                    cell, core, visits = np.zeros(len(part), np.int64), np.zeros(len(part), bool), [np.zeros(0, np.int64)] * len(part)
                    if int(dim) in books:
                        grid, radius = books[int(dim)]
                        x = unit(part.column("vec").to_pylist(), int(dim))
                        own, low = grid.bounds(x)
                        cell = grid.number(own)
                        core = (x * grid.middle(cell)).sum(axis=1) >= np.cos(half)
                        row, seen = traverse(*low, radius)
                        later = seen > cell[row]
                        row, seen = row[later], seen[later]
                        by = np.argsort(row, kind="stable")
                        visits = np.split(seen[by], np.cumsum(np.bincount(row, minlength=len(part)))[:-1])
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in ("node", "w", "label", "dim", "vec")), pa.array(cell, pa.int32()), pa.array(core), pa.array([v.tolist() for v in visits], pa.list_(pa.int32()))],
                        names=["node", "w", "label", "dim", "vec", "cell", "core", "visits"],
                    )
            give_back()

        return nodes.select("node", "w", "label", "dim", "vec").mapInArrow(run, _PLACED)

    def sizes(self, placed: DataFrame) -> DataFrame:
        """How many parts the core and the rest of each cell have."""
        return placed.groupBy("label", "dim", "cell", "core").agg(F.ceil(F.count("*") / self.part_rows).cast("int").alias("parts"))

    def meet(self, placed: DataFrame, sizes: DataFrame) -> DataFrame:
        """Each node of a part of a cell (role 0) and, after them, its visitors (role 1; ``both`` if the pair counts for both ends)."""
        key = ["label", "dim", "cell", "core"]
        sized = small(sizes)
        payload = ["node", "w", "vec"]
        held = placed.join(sized, key).select(*key, F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("role"), F.lit(False).alias("both"), *payload)
        other = lambda c, core, both: F.struct(c.alias("cell"), F.lit(core).alias("core"), F.lit(both).alias("both"))
        visited = F.flatten(F.transform("visits", lambda c: F.array(other(c, True, True), other(c, False, True))))
        at_home = F.when(~F.col("core"), F.array(other(F.col("cell"), True, True), other(F.col("cell"), False, False)))
        goes = F.when(F.col("core"), visited).otherwise(F.concat(visited, at_home))
        asks = placed.select("label", "dim", *payload, F.explode(goes).alias("x")).select("label", "dim", "x.*", *payload)
        asks = asks.join(sized, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"), "both", *payload)
        return held.unionByName(asks).repartition(*key, "part").sortWithinPartitions(*key, "part", "role")

    def verify(self, met: DataFrame) -> DataFrame:
        """(node, links, other): weights of the nodes it is linked with in a part, and links that join up what is linked there."""
        threshold = self.threshold
        keys = ["label", "dim", "cell", "core", "part"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part: Part | None = None
            last = None
            for batch in batches:
                n = len(batch)
                new = np.zeros(n, dtype=bool)
                for c in [*keys, "role"]:
                    col = batch.column(c)
                    new[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
                starts = [0, *np.flatnonzero(new).tolist(), n]
                for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                    if lo == hi:
                        continue
                    run_ = batch.slice(lo, hi - lo)
                    now = tuple(run_.column(c)[0].as_py() for c in keys)
                    if now != last:
                        if part is not None:
                            yield from part.end()
                        part, last = Part(now[1], threshold), now
                    if run_.column("role")[0].as_py() == 0:
                        part.add(run_)
                    else:
                        yield from part.ask(run_)
            if part is not None:
                yield from part.end()
            give_back()

        return met.mapInArrow(run, _FOUND)

    def classes(self, vectors: DataFrame, vector: str = "embedding") -> DataFrame:
        """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, label, the vector).

        n_links counts the other rows of the same label (compared as text) with a cosine of ``threshold`` or more, equal rows
        included; component_id is the smallest vec_id that links reach, the row's own included; kept says that this is its own.
        Rows whose vector is null, empty, zero or holds null or non-finite components, or whose label is null, have no links.
        Vectors of different lengths are never linked. Ids may repeat or be null: links are between rows, a null id is no
        component_id unless there is no other. Extra columns are ignored; an empty table gives no rows.
        """
        rows = coded(vectors, vector).withColumn("key", F.md5(F.concat(F.concat_ws("/", F.col("dim").cast("string"), "label").cast("binary"), F.lit("/").cast("binary"), F.col("vec"))))
        nodes = rows.where("key IS NOT NULL").groupBy("key").agg(
            F.count("*").alias("w"), F.min("vec_id").alias("low"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec")
        )
        nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "index-nodes")
        books = self.fit(nodes, nodes.count())
        placed = materialize(self.place(nodes, books), "index-placed")
        sizes = materialize(self.sizes(placed), "index-sizes")
        found = materialize(self.verify(self.meet(placed, sizes)), "index-found")
        cores = placed.where("core").groupBy("label", "dim", "cell").agg(F.sum("w").alias("all"), F.min("node").alias("first"))
        cores = materialize(cores, "index-cores")
        in_core = placed.where("core").join(small(cores), ["label", "dim", "cell"])
        in_core = in_core.select("node", (F.col("all") - F.col("w")).alias("links"), F.when(F.col("node") != F.col("first"), F.col("first")).alias("other"))
        every = found.unionByName(in_core)
        roots = connected_components(every.where("other IS NOT NULL"), "node", "other", lambda df: materialize(df, "index-components"), discard)
        counts = every.groupBy("node").agg(F.sum("links").alias("links"))
        known = nodes.select("node", "key", "w", "low").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        smallest = known.groupBy("root").agg(F.min("low").alias("component_id"))
        by_key = materialize(known.join(smallest, "root").select("key", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "index-classes")
        discard(nodes, placed, sizes, found, cores)
        out = rows.select("vec_id", "key").join(by_key, "key", "left")
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


class Part:
    """One part of a cell: its nodes, then its visitors in a stream; sets of nodes that visitors join up are kept as labels."""

    def __init__(self, dim: int, threshold: float):
        self.dim, self.threshold = dim, threshold
        self.ids, self.weights, self.blobs = [], [], []
        self.x: np.ndarray | None = None

    def add(self, run: pa.RecordBatch) -> None:
        self.ids.append(run.column("node").to_numpy())
        self.weights.append(run.column("w").to_numpy())
        self.blobs += run.column("vec").to_pylist()

    def ask(self, run: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.x is None:
            if not self.blobs:  # the hash left this part empty
                return
            self.x, self.blobs = unit(self.blobs, self.dim), []
            self.node, self.w = np.concatenate(self.ids), np.concatenate(self.weights)
            self.links = np.zeros(len(self.node), dtype=np.int64)
            self.set = np.arange(len(self.node))
        node, w, both = (run.column(c).to_numpy(zero_copy_only=False) for c in ("node", "w", "both"))
        blobs = run.column("vec").to_pylist()
        for lo in range(0, len(run), _CHUNK):
            hi = min(lo + _CHUNK, len(run))
            linked = unit(blobs[lo:hi], self.dim) @ self.x.T >= self.threshold
            linked &= node[lo:hi, None] != self.node[None, :]
            some = np.flatnonzero(linked.any(axis=1))
            if not len(some):
                continue
            linked = linked[some]
            ids, first = node[lo:hi][some], linked.argmax(axis=1)
            two = both[lo:hi][some]
            self.links += (linked & two[:, None]).T @ w[lo:hi][some]
            yield self._rows(ids, linked @ self.w, self.node[first])
            yield from self._join(linked)

    def _join(self, linked: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links between nodes that one visitor joins up and that were apart so far: fewer than there are nodes in all."""
        high = len(self.set)
        apart = np.where(linked, self.set, high).min(axis=1) != np.where(linked, self.set, -1).max(axis=1)
        for row in linked[apart]:
            sets = np.unique(self.set[row])
            if len(sets) > 1:
                self.set[np.isin(self.set, sets)] = sets[0]
                yield self._rows(np.full(len(sets) - 1, self.node[sets[0]]), np.zeros(len(sets) - 1, np.int64), self.node[sets[1:]])

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.x is not None and self.links.any():
            some = np.flatnonzero(self.links)
            yield self._rows(self.node[some], self.links[some], None)

    @staticmethod
    def _rows(node: np.ndarray, links: np.ndarray, other: np.ndarray | None) -> pa.RecordBatch:
        last = pa.nulls(len(node), pa.int64()) if other is None else pa.array(other, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64()), last], names=["node", "links", "other"])
