import random

import pytest

from medialedger.identity.components import connected_components
from medialedger.llm.jaccard_join import JaccardJoin
from medialedger.llm.store import materialize
from tests.llm.helpers import documents, words


def shingles(text, k):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def brute(texts, k=5, num=80):
    sets = [shingles(t, k) for t in texts]
    parent = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= num * max(len(a), len(b)) and 100 * len(a & b) >= num * len(a | b):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(parent, i)) for i, s in enumerate(sets)]


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 3)))
    passage = [word() for _ in range(40)]
    texts = [None, "", " \n", "A b", "a B", "a b c d", "a b c d e", "a b c d e f", "x " * 60, "x " * 9]
    base = [[word() for _ in range(rng.choice([7, 9, 12, 30, 60, 150, 400]))] for _ in range(8)]
    while len(texts) < n:
        w = list(rng.choice(base)) if rng.random() < 0.8 else [word() for _ in range(rng.randint(1, 200))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 2)] = [word() for _ in range(rng.randint(0, 2))] or [word()]
        if rng.random() < 0.3:
            at = rng.randint(0, len(w))
            w[at:at] = passage
        texts.append(" ".join(x.upper() if rng.random() < 0.05 else x for x in w))
    return texts


@pytest.mark.parametrize(("seed", "rare"), [(1, 8), (2, 2), (3, 1)])
def test_equals_brute_force(spark, seed, rare):
    texts = corpus(seed, 220)
    docs = documents(spark, texts).repartition(4, "doc_id")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in JaccardJoin(rare=rare).components(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_odd_rows(spark):
    docs = documents(spark, ["a b c", "A b c", None, ""], ids=[None, 4, 4, None])
    rows = JaccardJoin().components(docs.withColumn("node", docs["doc_id"])).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in rows) == [(-1, 0, -1), (-1, 1, 4), (4, 0, 4), (4, 1, 4)]
    assert JaccardJoin().components(documents(spark, [])).collect() == []


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7), (None, 3)]
    parent = list(range(300))
    for a, b in edges:
        if a is not None:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in connected_components(df, "a", "b", lambda d: materialize(d, "test")).collect()}
    want = {x: find(parent, x) for e in edges if e[0] is not None and e[0] != e[1] for x in e}
    assert got == want


def test_long_texts_and_groups_just_below_the_threshold(spark):
    long = [f"w{i}" for i in range(200_000)]
    near = [*long[:100_000], "new", *long[100_001:]]
    shared = [f"t{i}" for i in range(165)]
    groups = [" ".join([*shared, *(f"o{i}x{j}" for j in range(35))]) for i in range(400)]  # 82.5 % of the words are those of all
    linked = [" ".join([*shared, *(f"p{j}" for j in range(30)), *(f"q{i}x{j}" for j in range(4))]) for i in range(30)]
    texts = [" ".join(long), " ".join(near), *groups, *linked]
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in JaccardJoin().components(documents(spark, texts)).collect()}
    assert rows[0] == (199_996, 0) and rows[1][1] == 0
    assert all(rows[2 + i][1] == 2 + i for i in range(400))
    assert all(rows[402 + i][1] == 402 for i in range(30))


def test_one_row_of_each_component_stays(spark):
    texts = corpus(5, 150)
    ids = [i // 2 if i % 5 else None for i in range(len(texts))]
    docs = documents(spark, [*texts, *texts[40:60]], ids=[*ids, *ids[40:60]]).withColumnsRenamed({"source": "root"}).repartition(3)
    kept = JaccardJoin().first_of_each(docs)
    assert kept.columns == docs.columns
    roots = brute([*texts, *texts[40:60]])
    words_of = [bool(words(t)) for t in [*texts, *texts[40:60]]]
    want_components = {r for (n, r), w in zip(roots, words_of, strict=True) if w}
    got = kept.collect()
    by_text = {}
    for t, (_, r) in zip([*texts, *texts[40:60]], roots, strict=True):
        by_text[t] = r
    held = [by_text[r["text"]] for r in got if words(r["text"])]
    assert sorted(held) == sorted(want_components)
    assert sum(not words(r["text"]) for r in got) == sum(not w for w in words_of)
    for r in got:  # an id before none, then the smallest
        if words(r["text"]):
            mates = [i for i, (_, c) in zip([*ids, *ids[40:60]], roots, strict=True) if c == by_text[r["text"]]]
            known = [i for i in mates if i is not None]
            assert r["doc_id"] == (min(known) if known else None)
