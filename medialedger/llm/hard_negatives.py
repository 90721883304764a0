"""Hard negatives: rows of another label that score a little less than a positive of an anchor, by angular triangle filtering.

Components become integers and scores are exact integer inner products. Every row stores its angles to a few reference directions,
taken from a bounded sample. By the triangle inequality the angle between an anchor and a row is no less than the difference of
their angles to a reference and no more than their sum, so the rows of a block lie in an interval of cosines, which times the norms
and rounded outwards is an interval of scores. Blocks are runs of rows of one nearest reference, sorted by the angle to it; only
blocks whose interval overlaps what an anchor still wants are scored, and of these only the stretch of angles that can reach it.

Anchors meet rows in blocks: anchors go in groups of about ``group_anchors`` to every shard of blocks, and a task holds one group
and one block at a time. First an eighth of the blocks is searched; the scores found there are floors below which the search of all
blocks returns nothing, so that what comes out of the shards doesn't grow with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from medialedger.llm.store import discard, materialize, shuffle_partitions, small
from medialedger.llm.wordscan import give_back

_CODED = "vec_id bigint, label string, dim int, q binary"
_ROWS = "vec_id bigint, label string, dim int, q binary, norm double, cell int, angle double, angles binary"
_BLOCKS = "block bigint, dim int, ids binary, labels array<string>, q binary, norms binary, own int, angles binary"
_FOUND = "anchor bigint, place int, score bigint, vec_id bigint"
#: Angles are kept in single precision; bounds are widened by this much.
_MARGIN = 1e-6
_LEAST, _MOST = -(1 << 62), 1 << 62
_CHUNK = 512


def coded(vectors: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label (as text), dim, q: the components as floor(scale * x), 32-bit integers.

    Rows with a null id, label or vector, without components, or with null or non-finite ones are left out, and so are those with
    components so large that a score could be over 63 bits.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            values = np.floor(scale * pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False))
            ends, out = np.cumsum(sizes), []
            for end, size in zip(ends, sizes, strict=True):
                x = values[end - size : end]
                top = np.abs(x).max() if size else np.nan
                out.append(x.astype("<i4").tobytes() if np.isfinite(top) and top < 1 << 31 and int(top) ** 2 * int(size) < 1 << 62 else None)
            done = pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "label", "dim", "q"])
            yield done.filter(pc.is_valid(done.column("q")))

    named = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col(vector).alias("vector"))
    return named.where("vec_id IS NOT NULL AND label IS NOT NULL").mapInArrow(code, _CODED)


def references(rows: DataFrame, most: int = 16, sample_rows: int = 2048) -> dict[int, np.ndarray]:
    """Reference directions for each length of vectors in a sample of ``sample_rows`` rows, taken by a hash: each is the row of the
    sample farthest from those before. Lengths that the sample lacks have none; their blocks are always scored."""
    sample = rows.select("dim", "q", F.xxhash64("q", "vec_id").alias("h")).orderBy("h").limit(sample_rows).toPandas()
    out = {}
    for dim, own in sample.groupby("dim"):
        x = np.frombuffer(b"".join(own["q"]), dtype="<i4").reshape(len(own), int(dim)).astype(np.float64)
        size = np.linalg.norm(x, axis=1)
        x = x[size > 0] / size[size > 0][:, None]
        if len(x):
            chosen = [0]
            near = x @ x[0]
            while len(chosen) < most and near.min() < 1 - 1e-6:
                chosen.append(int(near.argmin()))
                near = np.maximum(near, x @ x[chosen[-1]])
            out[int(dim)] = x[chosen]
    return out


def with_angles(rows: DataFrame, directions: dict[int, np.ndarray]) -> DataFrame:
    """The rows with their norm, angles to all references, the nearest one (``cell``, -1 without any) and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = np.frombuffer(b"".join(part.column("q").to_pylist()), dtype="<i4").reshape(len(part), int(dim)).astype(np.float64)
                norm = np.linalg.norm(x, axis=1)
                r = directions.get(int(dim), np.zeros((0, int(dim))))
                theta = np.arccos(np.clip(x @ r.T / np.where(norm > 0, norm, 1)[:, None], -1, 1)).astype("<f4")
                cell = theta.argmin(axis=1) if len(r) else np.full(len(part), -1)
                own = theta[np.arange(len(part)), cell] if len(r) else np.zeros(len(part))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("vec_id", "label", "dim", "q")), pa.array(norm), pa.array(cell, pa.int32()), pa.array(own, pa.float64()), pa.array([t.tobytes() for t in theta], pa.binary())],
                    names=["vec_id", "label", "dim", "q", "norm", "cell", "angle", "angles"],
                )

    return rows.mapInArrow(run, _ROWS)


def blocks(rows: DataFrame, most: int = 2048) -> DataFrame:
    """Rows of one nearest reference in blocks of ``most`` at most, sorted by the angle to it; neighbours have one label mostly."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal number
            t = pa.Table.from_batches(parts).combine_chunks()
            t = t.take(pa.array(np.argsort(t.column("angle").to_numpy(), kind="stable")))
            joined = lambda c: b"".join(t.column(c).to_pylist())
            number += 1
            row = {
                "block": number, "dim": t.column("dim")[0].as_py(), "ids": t.column("vec_id").to_numpy().tobytes(), "labels": t.column("label").to_pylist(), "q": joined("q"),
                "norms": t.column("norm").to_numpy().tobytes(), "own": t.column("cell")[0].as_py(), "angles": joined("angles"),
            }
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_SCHEMA)

        held, n, last = [], 0, None
        for batch in batches:
            if not len(batch):
                continue
            dim, cell = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero((dim[1:] != dim[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist(), len(batch)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                now = (int(dim[lo]), int(cell[lo]))
                if held and now != last:
                    yield block(held)
                    held, n = [], 0
                last = now
                while lo < hi:
                    step = min(hi - lo, most - n)
                    held.append(batch.slice(lo, step))
                    lo, n = lo + step, n + step
                    if n == most:
                        yield block(held)
                        held, n = [], 0
        if held:
            yield block(held)
        give_back()

    order = ["dim", "cell", "label", "angle", "vec_id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, _BLOCKS)


_BLOCK_SCHEMA = pa.schema(
    [("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.list_(pa.string())), ("q", pa.binary()), ("norms", pa.binary()), ("own", pa.int32()), ("angles", pa.binary())]
)


class Search:
    """What one group of anchors wants, and the best that some blocks have for it: for each anchor and place (a window of scores) the
    first ``k`` by falling score, then rising id."""

    def __init__(self, rows: list[dict], same_label: bool, k: int):
        self.same, self.k, self.dim = same_label, k, rows[0]["dim"]
        self.anchor = np.array([r["anchor"] for r in rows])
        self.id = np.array([r["vec_id"] for r in rows])
        self.codes: dict[str, int] = {}
        self.label = np.array([self.codes.setdefault(r["label"], len(self.codes)) for r in rows])
        self.q = np.frombuffer(b"".join(r["q"] for r in rows), dtype="<i4").reshape(len(rows), self.dim)
        self.top = int(np.abs(self.q.astype(np.int64)).max())
        self.norm = np.array([r["norm"] for r in rows])
        self.theta = np.frombuffer(b"".join(r["angles"] for r in rows), dtype="<f4").reshape(len(rows), -1).astype(np.float64)
        places = max(len(r["low"]) for r in rows)
        self.low, self.high = np.full((len(rows), places), 1, dtype=np.int64), np.zeros((len(rows), places), dtype=np.int64)  # wants nothing
        for i, r in enumerate(rows):
            self.low[i, : len(r["low"])], self.high[i, : len(r["high"])] = r["low"], r["high"]
        self.pool = np.zeros((0, 4), dtype=np.int64)  # anchor's number, place, score, id

    def bounds(self, theta: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores, at least and at most, that each anchor can have with the rows of a block."""
        if theta.shape[1]:
            least, most = theta.min(axis=0), theta.max(axis=0)
            apart = np.maximum(self.theta - most, least - self.theta).max(axis=1) - _MARGIN
            around = np.minimum(self.theta + most, 2 * np.pi - self.theta - least).min(axis=1) + _MARGIN
            high, low = np.cos(np.maximum(apart, 0)), np.cos(np.minimum(around, np.pi))
        else:
            high, low = np.ones(len(self.norm)), -np.ones(len(self.norm))
        small_, large = self.norm * norms.min(), self.norm * norms.max()
        slack = 1e-9 * large + 1e-6
        return np.where(low >= 0, low * small_, low * large) - slack, np.where(high >= 0, high * large, high * small_) + slack

    def see(self, block: dict) -> None:
        theta = np.frombuffer(block["angles"], dtype="<f4").astype(np.float64)
        ids, norms = np.frombuffer(block["ids"], dtype=np.int64), np.frombuffer(block["norms"], dtype=np.float64)
        theta = theta.reshape(len(ids), -1)
        labels = np.array([self.codes.get(x, -1) for x in block["labels"]])
        low, high = self.bounds(theta, norms)
        wanted = (high[:, None] >= self.low) & (low[:, None] <= self.high) & (self.low <= self.high)
        if self.same:
            wanted &= np.isin(self.label, labels)[:, None]
        at = np.flatnonzero(wanted.any(axis=1))
        if not len(at):
            return
        begin, end = 0, len(ids)
        if theta.shape[1]:
            # The least score that is wanted gives the largest angle, and that a stretch of angles to the block's own reference.
            need = np.where(wanted[at], self.low[at].astype(np.float64), np.inf).min(axis=1)
            cosine = np.clip(need / np.maximum(self.norm[at] * norms.max() * (1 + 1e-9), 1e-300), -1, 1)
            reach = np.where(need > 0, np.arccos(cosine) + 2 * _MARGIN, np.pi)
            own, centre = theta[:, block["own"]], self.theta[at, block["own"]]
            begin = int(np.searchsorted(own, (centre - reach).min(), "left"))
            end = int(np.searchsorted(own, (centre + reach).max(), "right"))
        if begin == end:
            return
        q = np.frombuffer(block["q"], dtype="<i4").reshape(len(ids), self.dim)[begin:end]
        exact = float if self.top * int(np.abs(q.astype(np.int64)).max()) * self.dim < 1 << 53 else np.int64  # doubles hold such sums exactly
        q, ids, labels = q.astype(exact).T, ids[begin:end], labels[begin:end]
        new = []
        for lo in range(0, len(at), _CHUNK):
            some = at[lo : lo + _CHUNK]
            scores = self.q[some].astype(exact) @ q
            fits = (self.label[some][:, None] == labels[None, :]) == self.same
            fits &= self.id[some][:, None] != ids[None, :]
            for place in np.flatnonzero(wanted[some].any(axis=0)):
                hit = fits & (scores >= self.low[some, place][:, None]) & (scores <= self.high[some, place][:, None])
                if hit.sum() > 4 * self.k * len(some) and hit.shape[1] > self.k:
                    best = np.partition(np.where(hit, -scores, np.inf), self.k - 1, axis=1)[:, self.k - 1] if exact is float else None
                    if best is not None:
                        hit &= scores >= -best[:, None]
                a, b = np.nonzero(hit)
                if len(a):
                    new.append(np.stack([some[a], np.full(len(a), place), scores[a, b].astype(np.int64), ids[b]], axis=1))
        if new:
            self._keep(np.concatenate([self.pool, *new]))

    def _keep(self, pool: np.ndarray) -> None:
        order = np.lexsort((pool[:, 3], -pool[:, 2], pool[:, 1], pool[:, 0]))
        pool = pool[order]
        first = np.ones(len(pool), dtype=bool)
        first[1:] = (pool[1:, :2] != pool[:-1, :2]).any(axis=1)
        heads = np.flatnonzero(first)
        rank = np.arange(len(pool)) - np.repeat(heads, np.diff(np.append(heads, len(pool))))
        last = pool[rank == self.k - 1]
        self.low[last[:, 0], last[:, 1]] = np.maximum(self.low[last[:, 0], last[:, 1]], last[:, 2])  # equal scores may still have a smaller id
        self.pool = pool[rank < self.k]

    def found(self) -> pa.RecordBatch:
        p = self.pool
        return pa.RecordBatch.from_arrays([pa.array(self.anchor[p[:, 0]]), pa.array(p[:, 1], pa.int32()), pa.array(p[:, 2]), pa.array(p[:, 3])], names=["anchor", "place", "score", "vec_id"])


def best(anchors: DataFrame, packed: DataFrame, shards: int, groups: int, same_label: bool, k: int) -> DataFrame:
    """(anchor, place, score, vec_id, rank) of the first ``k`` rows for each anchor and window of scores.

    ``anchors`` has anchor, vec_id, label, dim, q, norm, angles and arrays low and high; they are searched for in the blocks of
    their length of vectors.
    """
    group = F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int").alias("group")
    nothing = lambda names, df: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    mine, theirs = ["anchor", "vec_id", "label", "norm", "low", "high"], ["block", "ids", "labels", "norms", "own"]
    pairs = small(anchors.select(group, "dim").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        search, last = None, None
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                now = (row["group"], row["dim"], row["shard"])
                if now != last:
                    if search is not None:
                        yield search.found()
                    search, rows, last = None, [], now
                if row["role"] == 0:
                    rows.append(row)
                elif rows:
                    search = search or Search(rows, same_label, k)
                    search.see(row)
        if search is not None:
            yield search.found()
        give_back()

    def searched(wanted: DataFrame, part: Column) -> DataFrame:
        shard = F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int").alias("shard")
        asks = wanted.select(group, "dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("role"), "q", "angles", *mine, *nothing(theirs, packed))
        seen = packed.where(part).join(pairs, "dim").select("group", "dim", shard, F.lit(1).alias("role"), "q", "angles", *nothing(mine, wanted), *theirs)
        met = asks.unionByName(seen).repartition("group", "dim", "shard").sortWithinPartitions("group", "dim", "shard", "role")
        out = met.mapInArrow(run, _FOUND)
        by = W.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
        return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    # Scores of an eighth of the blocks: less than the last of k can't be among the first k of all.
    first = materialize(searched(anchors, F.pmod(F.xxhash64("block", F.lit(7)), F.lit(8)) == 0), "negatives-floors")
    floor = first.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("floors"))
    raised = F.transform("low", lambda x, i: F.coalesce(F.greatest(x, F.col("floors")[i]), x))
    wanted = anchors.join(floor, "anchor", "left").withColumn("low", raised).drop("floors")
    out = materialize(searched(wanted, F.lit(True)), "negatives-found")
    discard(first)
    return out


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), vector: str = "embedding", group_anchors: int = 4096, shard_rows: int = 65_536
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its first other rows of the same label, by falling score, then rising id; for each, the first rows of
    other labels whose score is from ``window[0]`` to ``window[1]`` percent of the positive's are its negatives. Labels are compared
    as text, rows with other ids and vectors of one length only; ``coded`` says which rows take no part. Equal anchors are one,
    repeated rows count as often as they stand. An anchor without positives, or a positive without negatives, has no rows; extra
    columns are ignored; an empty table gives no rows.
    """
    rows = coded(vectors, vector)
    placed = materialize(with_angles(rows, references(rows)), "negatives-rows")
    packed = materialize(blocks(placed), "negatives-blocks")
    chosen = placed.where(anchors).dropDuplicates(["vec_id", "label", "dim", "q"]).select("vec_id", "label", "dim", "q", "norm", "angles")
    chosen = materialize(chosen.withColumn("anchor", F.monotonically_increasing_id()), "negatives-anchors")
    shards = max(shuffle_partitions(vectors.sparkSession), -(-placed.count() // shard_rows))
    groups = max(1, -(-chosen.count() // group_anchors))
    every = lambda x: F.array(F.lit(x).cast("bigint"))
    found = best(chosen.withColumns({"low": every(_LEAST), "high": every(_MOST)}), packed, shards, groups, True, positives)
    held = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("positives"))
    asked = chosen.join(held, "anchor").withColumns({
        "low": F.transform("positives", lambda x: -F.floor(-(x["score"].cast("decimal(30,0)") * window[0]) / 100).cast("bigint")),
        "high": F.transform("positives", lambda x: F.floor(x["score"].cast("decimal(30,0)") * window[1] / 100).cast("bigint")),
    })
    asked = materialize(asked, "negatives-asked")
    hard = best(asked.drop("positives"), packed, shards, groups, False, negatives)
    out = hard.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(asked.select("anchor", "vec_id", "positives"), "anchor")
    positive = F.get("positives", F.col("place"))
    out = out.select(
        F.col("vec_id").alias("anchor_id"), positive["vec_id"].alias("positive_id"), "rank", "negative_id", positive["score"].alias("positive_score"), "negative_score"
    )
    out = materialize(out, "negatives")
    discard(placed, packed, chosen, found, asked, hard)
    return out
