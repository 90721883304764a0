"""Texts on which polynomials modulo a power of two collide whatever the base: runs of the Thue-Morse pattern and its complement."""

import numpy as np
import pyarrow as pa

from medialedger.llm import decontamination, quality_rules, substring_dedup, wordscan
from medialedger.llm.jaccard_join import JaccardJoin
from tests.llm.helpers import documents


def pattern(n, a, b):
    return [(a, b)[bin(i).count("1") & 1] for i in range(n)]


A, B = "".join(pattern(2048, "a", "b")), "".join(pattern(2048, "b", "a"))


def test_words_and_runs_of_words_are_told_apart():
    words = wordscan.scan_words(pa.array([A, B, A]))
    assert words.hash[0] != words.hash[1] and words.hash[0] == words.hash[2]
    runs = wordscan.scan_words(pa.array([" ".join(pattern(4096, "x", "y")), " ".join(pattern(4096, "y", "x"))]))
    first = runs.first
    hashes = wordscan.spans_hash(runs.hash, first[:-1], first[1:], "gram")
    assert hashes[0] != hashes[1]


def test_span_hashes_are_polynomials_modulo_the_prime():
    values = np.random.default_rng(1).integers(0, 1 << 62, 300).astype(np.uint64) * np.uint64(3)
    spans = [(0, 300), (7, 42), (299, 300)]
    base, prime = wordscan._BASES["gram"], wordscan._PRIME
    want = [sum(int(values[i]) % prime * pow(base, i - s, prime) for i in range(s, e)) % prime for s, e in spans]
    got = wordscan.spans_hash(values, *np.array(spans).T, "gram")
    assert (got == wordscan.mix(np.array(want, dtype=np.uint64))).all()


def test_word_hashes_do_not_depend_on_what_stands_around():
    alone = wordscan.scan_words(pa.array(["word", "é"])).hash
    inside = wordscan.scan_words(pa.array(["some  word\tand é", "word"]))
    assert inside.hash[1] == inside.hash[4] == alone[0] and inside.hash[3] == alone[1]


def test_substring_dedup_keeps_both(spark):
    tail = " ".join(f"w{i}" for i in range(34))
    rows = substring_dedup.remove_repeats(documents(spark, [f"{A} {tail}", f"{B} {tail}"]), 35).collect()
    assert [r["n_removed"] for r in rows] == [0, 0]


def test_jaccard_join_does_not_link_them(spark):
    rows = JaccardJoin().components(documents(spark, [f"{A} x y", f"{B} x y"])).collect()
    assert sorted(r["component_id"] for r in rows) == [0, 1]


def test_lines_are_not_repeats(spark):
    row = quality_rules.features(documents(spark, [f"{A}\n{B}"])).first()
    assert row["n_dup_lines"] == 0


def test_benchmark_items_stay_apart(spark):
    items = [" ".join(pattern(2048, "x", "y")), " ".join(pattern(2048, "y", "x"))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = decontamination.matches(documents(spark, [items[0]]), bench, percent=0).collect()
    assert [r["item_id"] for r in found] == [0]
    assert decontamination.items(bench, 15).select("item").distinct().count() == 2
