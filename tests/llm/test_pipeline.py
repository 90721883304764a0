import collections
import re

import numpy as np
import public_tokenizers
import zlib
from tokenizers import Tokenizer

import corpus_pipeline
from medialedger.llm import pseudonyms, quality_rules
from tests.llm.test_decontamination import distance, lower
from tests.llm.test_jaccard_join import brute as components

DIR = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, DIR), "test")
        steps.append(sorted(docs.collect(), key=lambda r: (r["doc_id"], r["piece"] if "piece" in r else 0)))
        if name != "best-fit packing":
            assert docs.columns == columns
    judged, single, clean, private, packed = steps
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    verdicts = quality_rules.judge(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")).collect()
    assert [r["doc_id"] for r in judged] == sorted(r["doc_id"] for r in verdicts if r["kept"])
    ids = [r["doc_id"] for r in judged]
    roots = components([texts[i] for i in ids])
    assert [r["doc_id"] for r in single] == [i for k, i in enumerate(ids) if roots[k][1] == k]
    items = [lower(r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    grams = collections.defaultdict(set)
    for k, p in enumerate(items):
        for i in range(len(p) - 2):
            grams[tuple(p[i : i + 3])].add(k)
    dirty = set()
    for r in single:
        w = lower(r["text"])
        hits = collections.Counter(k for i in range(len(w) - 2) for k in grams.get(tuple(w[i : i + 3]), ()))
        dirty |= {r["doc_id"] for k, n in hits.items() if n >= 2 and distance(items[k], w) <= len(items[k]) * 15 // 100}
    assert [r["doc_id"] for r in clean] == [r["doc_id"] for r in single if r["doc_id"] not in dirty]
    assert [r["doc_id"] for r in private] == [r["doc_id"] for r in clean]
    for a, b in zip(clean, private, strict=True):
        assert b["n_chars"] == len(b["text"]) and (a["text"] == b["text"] or re.search(pseudonyms.PATTERN, a["text"]))
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in private:
        t = np.array([*whole.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        want += [(r["doc_id"], at // 4096, zlib.crc32(t[at : at + 4096].tobytes())) for at in range(0, len(t), 4096)]
    assert [(r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed] == want
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)


def test_stages_take_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(70))
    other = " ".join(f"v{i}" for i in range(70))
    rows = [(1, long), (1, long), (2, long), (2, other), (3, None), (None, long), (None, None), (4, ""), (5, "x@" + "a." * 3000 + "com")]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.selectExpr("*", "'a' AS text_key", "'b' AS k1", "'c' AS n_pseudonyms", "1 AS root")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    single = corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path))
    assert single.columns == docs.columns
    got = sorted(((r["doc_id"] or -1, r["text"] or "") for r in single.collect()))
    assert got == sorted([(1, long), (2, other), (3, ""), (-1, ""), (4, ""), (5, rows[-1][1])])
    for table in (docs, docs.limit(0)):
        made = table
        for name, stage in corpus_pipeline.STAGES:
            made = corpus_pipeline.materialize(stage(spark, made, str(tmp_path)), "odd")
            if name != "best-fit packing":
                assert made.columns == docs.columns
        assert sorted({r["doc_id"] for r in made.collect()}) == ([1, 2] if table is docs else [])
