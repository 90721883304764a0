import numpy as np
import pytest
from pyspark.sql import functions as F

from medialedger.llm import hard_negatives, queries
from medialedger.llm.multi_index import Codebooks, MultiIndex, traverse

VECTORS = "vec_id bigint, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def whole(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def clusters(seed, n, dim, groups, spread, labels=2):
    """Points around a few centres, a third of them copies of one."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    rows = [(i, (centres[i % groups] + rng.normal(size=dim) * spread).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]
    return [(i, rows[0][1] if i % 3 == 0 else v, label) for i, v, label in rows]


def brute_links(rows, threshold=0.98):
    ok = [whole(v) and any(v) and label is not None for _, v, label in rows]
    unit = [np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    near = [[j for j in range(len(rows)) if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(len(rows))]
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((vec_id, len(near[i]), low, vec_id == low))
    return out


def equal(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize(("spread", "index"), [(0.02, MultiIndex()), (0.12, MultiIndex(codes=6, part_rows=20)), (0.2, MultiIndex(codes=12, part_rows=7)), (0.3, MultiIndex(threshold=0.9, codes=5, part_rows=30))])
def test_links_equal_brute_force(spark, spread, index):
    rows = clusters(3, 240, 12, 7, spread)
    got = index.classes(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    equal(got, brute_links(rows, index.threshold))


def test_links_of_odd_rows(spark):
    big, tiny = 3e38, 1e-40
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [NAN, 1.0], 1), (8, [None, 1.0], 1),
        (9, [INF, 1.0], 1), (10, [big, 0.0], 1), (11, [tiny, 0.0], 1), (12, [-1.0, 0.0], 1), (13, [1.0, 0.0, 0.0], 1), (14, [1.0, -0.0], 1), (None, [1.0, 0.1], 1), (None, [0.0, 1.0], 1),
        (15, [5.0], 2), (16, [7.0], 2), (17, [1.0, 0.0], 2),
    ]
    table = spark.createDataFrame(rows, VECTORS)
    for c in ("node", "w", "key", "cell", "vec", "dim", "links"):
        table = table.withColumn(c, F.lit("x"))
    equal(MultiIndex(codes=2).classes(table).collect(), brute_links(rows))
    assert MultiIndex().classes(spark.createDataFrame([], VECTORS)).collect() == []


def test_traversal_visits_cells_in_rising_order_until_the_radius():
    rng = np.random.default_rng(5)
    a, b = rng.random((30, 6)), rng.random((30, 9))
    rows, cells = traverse(a, b, 0.7)
    for i in range(30):
        sums = [a[i, c // 9] + b[i, c % 9] for c in cells[rows == i]]
        assert sums == sorted(sums)
        assert sorted(cells[rows == i]) == [p * 9 + q for p in range(6) for q in range(9) if a[i, p] + b[i, q] <= 0.7]


def test_bounds_hold_for_every_pair():
    x = np.random.default_rng(7).normal(size=(400, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = Codebooks.fit(x, 8)
    own, low = books.bounds(x)
    distance = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    assert (low[0][:, own[0]] + low[1][:, own[1]] <= distance + 1e-9).all()


def test_target_recall_of_a_partial_traversal(spark):
    """Links found with a target of 0.9 on points that fill their space: none is wrong, recall holds."""
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist(), 0) for i in range(1500)]
    unit = np.array([v for _, v, _ in rows], dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in MultiIndex(target_recall=0.9, codes=10).classes(spark.createDataFrame(rows, VECTORS)).collect()}
    found = np.array([got[i] for i in range(len(rows))])
    assert (found <= want).all()
    assert found.sum() >= 0.88 * want.sum()


def brute_negatives(rows, anchors=lambda i: i % 5 == 0, k=5, n=3):
    use = [(i, [int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows if i is not None and label is not None and whole(v)]
    use = [r for r in use if max(map(abs, r[1])) ** 2 * len(r[1]) < 1 << 62]
    for a in {(i, tuple(q), label) for i, q, label in use if anchors(i)}:
        score = sorted((-sum(x * y for x, y in zip(a[1], q, strict=True)), i, label == a[2]) for i, q, label in use if i != a[0] and len(q) == len(a[1]))
        for p, pid, _ in [s for s in score if s[2]][:k]:
            fits = [(s, i) for s, i, same in score if not same and 50 * -p <= 100 * -s <= 95 * -p]
            for rank, (s, i) in enumerate(fits[:n]):
                yield a[0], pid, rank + 1, i, -p, -s


@pytest.mark.parametrize(("seed", "spread"), [(1, 0.05), (2, 0.4), (3, 2.0)])
def test_negatives_equal_brute_force(spark, seed, spread):
    rows = clusters(seed, 300, 9, 6, spread, labels=3)
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 5 == 0, group_anchors=20, shard_rows=40)
    equal(got.collect(), brute_negatives(rows))


def test_negatives_of_odd_rows(spark):
    """Ties, repeated rows and ids, rows that take no part, vectors of several lengths, very large ones, clashing columns."""
    rows = [(i, [1.0, (i % 4) / 8], i % 2) for i in range(20)] + [(0, [1.0, 0.0], 0), (20, [0.5, 0.5], 0), (20, [0.5, 0.25], 1), (25, [0.0, 0.0], 0), (30, [-1.0, -1.0], 1), (35, [1.0], 0), (36, [0.8], 0), (37, [0.7], 1)]
    rows += [(40, [3e6, 1.0, 2.0], 0), (41, [3e6, 2.0, 2.0], 0), (42, [2e6, 1.0, 1.0], 1), (45, [1e38, 1.0], 0), (50, [NAN, 1.0], 0), (55, [None, 1.0], 0), (60, None, 0), (65, [1.0, 1.0], None), (None, [1.0, 1.0], 0), (70, [], 1)]
    table = spark.createDataFrame(rows, VECTORS)
    for c in ("q", "angle", "cell", "anchor", "low", "norm", "block"):
        table = table.withColumn(c, F.lit("x"))
    equal(hard_negatives.mine(table, F.col("vec_id") % 5 == 0).collect(), brute_negatives(rows))
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 5 == 0).collect() == []


def test_score_bounds_hold():
    rng = np.random.default_rng(13)
    q = rng.integers(-300, 300, (60, 6)).astype("<i4")
    r = rng.normal(size=(4, 6))
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    norm = np.linalg.norm(q.astype(float), axis=1)
    theta = np.arccos(np.clip(q @ r.T / norm[:, None], -1, 1)).astype("<f4")
    rows = [{"anchor": i, "vec_id": i, "label": "a", "dim": 6, "q": q[i].tobytes(), "norm": norm[i], "angles": theta[i].tobytes(), "low": [0], "high": [1]} for i in range(30)]
    search = hard_negatives.Search(rows, True, 1)
    scores = q[:30].astype(int) @ q[30:].T.astype(int)
    for j in range(30):
        low, high = search.bounds(theta[30 + j : 31 + j].astype(float), norm[30 + j : 31 + j])
        assert (low <= scores[:, j]).all() and (scores[:, j] <= high).all()
    low, high = search.bounds(theta[30:].astype(float), norm[30:])
    assert (low <= scores.min(axis=1)).all() and (scores.max(axis=1) <= high).all()


def test_queries_are_registered():
    assert {"op11_hard_negatives", "op12_merkle_manifest", "op13_multi_index_dedup"} <= set(queries.QUERIES)
