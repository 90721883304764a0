import random
from collections import Counter
from math import comb

from pyspark.sql import functions as F

from medialedger.llm import quality_rules as q
from tests.llm.helpers import documents, words


def brute(text):
    t = text or ""
    w = words(t)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + d for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
    }


def texts(seed, n):
    rng = random.Random(seed)
    out = [None, "", "\n\n", "a\na\n a\na\n\n", "x " * 70, "one\r\ntwo\r\none\r\n", "|#é| <>"]
    while len(out) < n:
        w = [rng.choice(["a", "bé", "the", "C#", "d,", "zz%%", "日本"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 120))]
        out.append("".join(x + rng.choice([" ", " ", "\n", "  ", "\t\n"]) for x in w))
    return out


def test_counts_equal_brute_force(spark, monkeypatch):
    t = texts(1, 300)
    for run in (1 << 20, 40, 7, 1):
        monkeypatch.setattr(q, "_RUN", run)
        import pyarrow as pa

        got = q.count_features(pa.array(t))
        for i, x in enumerate(t):
            want = brute(x)
            assert {k: int(got[k][i]) for k in want} == want, x


def test_binomial_bound_is_exact():
    for n, p in ((1, 0.3), (20, 0.05), (400, 0.02)):
        for r in (0, 1, min(n, 7)):
            want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(r + 1))
            assert abs(q.binomial_cdf(r, n, p) - want) < 1e-9


def test_cutoffs_hold_the_risk_and_reject_junk(spark):
    rng = random.Random(2)
    good = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80)) for _ in range(600)]
    junk = [" ".join(w + "###" for w in g.split()) for g in good[:200]]
    docs = documents(spark, good + junk + ["short", None]).withColumn("level", F.lit("clash"))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 50 == 0, None).otherwise("en"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)] + [(i, 0, 0) for i in range(600, 800)], "doc_id bigint, quality int, toxic int")
    rows = {r["doc_id"]: r for r in q.judge(docs, labels).collect()}
    assert len(rows) == 802
    assert all(rows[i]["kept"] for i in range(600))
    assert not any(rows[i]["kept"] for i in range(600, 800) if i % 50)
    assert all(rows[i]["kept"] for i in range(600, 800) if not i % 50)  # too few labels without a language
    assert rows[800]["base_failed"] and rows[801]["base_failed"]
    kept = q.keep(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in rows.items() if r["kept"])
    none = q.judge(docs, labels.limit(0)).where("NOT kept").collect()
    assert {r["doc_id"] for r in none} == {800, 801}
    assert q.judge(documents(spark, []), labels).collect() == []


def test_a_hundred_languages_hold_their_bounds(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for lang in range(100):
        for k in range(40):
            bad = k % 4 == 0
            w = ["".join(rng.choice("abcdefghij") for _ in range(6)) + ("###" if bad else "") for _ in range(60)]
            rows.append((lang * 40 + k, " ".join(w), f"l{lang}"))
            labels.append((lang * 40 + k, int(not bad)))
    # In one language good texts have symbols too, so its own bound forbids what the others certify.
    rows = [(i, t.replace(" ", "### ") if lang == "l99" else t, lang) for i, t, lang in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = q.fit(q.features(docs), marks, risk=0.3, error=0.5).by_lang
    assert len(got) == 100
    n = 30
    certain = q.binomial_cdf(0, n, 0.3) <= 0.5 / 100
    assert certain and all(got[f"l{i}"] >= 0 for i in range(99)) and got["l99"] == -1
    # Rows of one labelled id are one draw: many copies of three good documents certify nothing.
    few = docs.where("doc_id IN (1, 2, 3)").unionByName(docs.where("doc_id % 4 = 0 AND lang = 'l0'"))
    many = few.join(spark.range(200).select(), how="cross")
    assert q.fit(q.features(many), marks, risk=0.05).by_lang == {"l0": -1}
    assert q.judge(many, marks).where("kept").count() == many.count()
