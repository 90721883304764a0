import collections
import random

from medialedger.llm import substring_dedup
from tests.llm.helpers import documents, words


def brute(texts, k):
    where = collections.Counter(tuple(w[i : i + k]) for w in map(words, texts) for i in range(len(w) - k + 1))
    out = []
    for w in map(words, texts):
        gone = set()
        for i in range(len(w) - k + 1):
            if where[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(12)]
    texts = [None, "", " \n\t ", "one", "x " * 40, "x " * 5]
    for _ in range(60):
        w = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 4) :]
        texts.append(rng.choice([" ", "\n", " \t"]).join(w))
    texts += texts[10:14]
    texts.append("long " + " ".join(word() for _ in range(30000)))
    for k in (1, 5, 7):
        docs = documents(spark, texts).repartition(3, "doc_id")
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(docs, k).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, k)


def test_odd_rows(spark):
    docs = documents(spark, ["a b c", "a b c", None], ids=[None, 4, 4]).withColumn("spans", docs_extra())
    rows = sorted((r["doc_id"] or -1, r["n_words"], r["kept_text"]) for r in substring_dedup.remove_repeats(docs, 2).collect())
    assert rows == [(-1, 3, ""), (4, 0, ""), (4, 3, "")]
    assert substring_dedup.remove_repeats(documents(spark, []), 2).collect() == []


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("clash")
