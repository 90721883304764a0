import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from medialedger.llm import merkle, queries
from tests.llm.helpers import DOCS


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        at = i // 3 * 3
        yield "".join(level[at:i]), "".join(level[i + 1 : at + 3])
        i //= 3


def brute(rows):
    """(doc_id, text, lang, source, n_chars) -> the rows of the query."""
    digest = lambda r, text: sha(*map(field, (r[0], r[3], r[2], r[4], text)))
    groups = {}
    for r in rows:
        groups.setdefault("" if r[3] is None else "s" + r[3], []).append(r)
    names = sorted(groups, key=str.encode)
    order = {n: sorted(groups[n], key=lambda r: (r[0] is not None, r[0] or 0, digest(r, r[1]))) for n in names}
    trees = {n: levels([digest(r, r[1]) for r in order[n]]) for n in names}
    top = levels([trees[n][-1][0] for n in names])
    for k, n in enumerate(names):
        for i, r in enumerate(order[n]):
            path = [*siblings(trees[n], i), *siblings(top, k)]
            tampered = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            at = digest(r, r[1].replace("\n", "") if tampered else r[1])
            for before, after in path:
                at = sha(before, at, after)
            yield r[0], trees[n][0][i], trees[n][-1][0], top[-1][0], sha(*(b + a for b, a in path)), at, at == top[-1][0]


def query(docs):
    row = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    found = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, merkle.row_digest(*row[:-1], F.replace("text", F.lit("\n"), F.lit(""))))
    out = merkle.manifest(docs, F.col("source"), "doc_id", merkle.row_digest(*row), found)
    return out.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.proof(F.col("path"))).alias("proof_sha256"), "folded_root", "verified")


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("sizes", [[1], [3], [4, 1], [82, 1, 9, 28], [250, 2, 81, 81]])
def test_proofs_equal_brute_force(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(100 * k + i * 7, rng.choice(["a\nb", "ü", "x" * 50, "\n"]), "en", None if k == 1 else f"s{k}", i) for k, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    same(query(spark.createDataFrame(rows, DOCS).repartition(5)).collect(), brute(rows))


def test_odd_rows(spark):
    """Nulls anywhere, empty and long texts, repeated rows and ids, clashing columns, values that run into each other."""
    long = "word\n" * 100_000
    rows = [(None, None, None, None, None), (1, "", "", "", 0), (1, "", "", "", 0), (1, "", "", "", 0), (1, "other", "", "", 0), (2, long, "en", "é", 5), (3, "1:a", "-", "-", None), (None, "x", "en", "é", 1)]
    rows += [(9, "copy\n", "en", "hot", 5)] * 200
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("tree", "rank", "n", "digest", "block", "path", "key", "copy"):
        docs = docs.withColumn(c, F.lit(1))
    same(query(docs).collect(), brute(rows))


def test_empty_table(spark):
    assert query(spark.createDataFrame([], DOCS)).collect() == []


def test_requests_and_records(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 3}", i) for i in range(700)]
    docs = spark.createDataFrame(rows, DOCS)
    leaf = merkle.row_digest(F.col("doc_id"), F.col("text"))
    every = {r["doc_id"]: r["path"] for r in merkle.manifest(docs, F.col("source"), "doc_id", leaf).collect()}
    some = merkle.manifest(docs, F.col("source"), "doc_id", leaf, requests=F.col("key") % 100 == 7).collect()
    assert sorted(r["doc_id"] for r in some) == [7, 107, 207, 307, 407, 507, 607]
    assert all(r["path"] == every[r["doc_id"]] and r["verified"] for r in some)


def test_store_is_addressed_by_content(spark):
    nodes = [sha(str(i)) for i in range(100)]
    leaves = spark.createDataFrame([("t", i, 100, d) for i, d in enumerate(nodes)], "tree string, rank bigint, n bigint, digest string")
    tree = merkle.grow(leaves, "test")
    records = {r["digest"]: r["children"] for r in tree.records().collect()}
    assert all(sha(*kids) == d for d, kids in records.items())
    assert sum(map(len, levels(nodes)[1:])) == len(records)
    assert [r["digest"] for r in tree.roots.collect()] == [levels(nodes)[-1][0]]
    tree.discard()


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    same(queries.op12_merkle_manifest(spark, folder).collect(), brute([tuple(r) for r in docs]))
