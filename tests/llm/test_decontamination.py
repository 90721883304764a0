import random

from pyspark.sql import functions as F

from medialedger.llm import decontamination as dc
from tests.llm.helpers import documents, words


def distance(pattern, text):
    """Least edits between the pattern and any part of the text, by the textbook table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def lower(text):
    return words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_myers_equals_table():
    rng = random.Random(1)
    for _ in range(400):
        p = [rng.randrange(3) for _ in range(rng.randint(1, 90))]
        t = [rng.randrange(3) for _ in range(rng.randint(0, 120))]
        got = dc.search(p, t)
        assert min([*got, len(p)]) == distance(p, t)
        match = dc.best_match(p, t, len(p) - 1)
        if match:
            assert match[0] == distance(p, t) == distance(p, t[match[1] : match[2]])


def test_equals_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 3)))
    items = [" ".join(word() for _ in range(n)) for n in (1, 3, 6, 7, 13, 14, 20, 30, 45, 60)] + ["", None, "a a a a a a a a a a a a a a"]
    texts = [None, "", "a " * 50]
    for _ in range(150):
        w = [word() for _ in range(rng.randint(0, 80))]
        item = words(rng.choice(items[:10]))
        for _ in range(rng.randint(0, len(item) // 5)):
            at = rng.randint(0, len(item))
            item[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
        at = rng.randint(0, len(w))
        texts.append(rng.choice([" ", "\n"]).join(x.upper() if rng.random() < 0.1 else x for x in w[:at] + item + w[at:]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").withColumn("doc_id", F.lit(9))
    docs = documents(spark, texts)
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            p = lower(item)
            if p and (d := distance(p, lower(t))) <= len(p) * 15 // 100:
                want[i, j] = d
    rows = dc.matches(docs, bench, 15).collect()
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in rows} == want and len(rows) == len(want)
    for r in rows:
        part = lower(texts[r["doc_id"]])[r["start_word"] : r["end_word"]]
        assert distance(lower(items[r["item_id"]]), part) == r["distance"]
    crowded = dc.matches(docs, bench, 15, crowded=0).collect()
    assert sorted(map(repr, crowded)) == sorted(map(repr, rows))
    dirty = {i for i, _ in want}
    kept = dc.clean(docs, bench, 15)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(texts)) if i not in dirty]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert dc.matches(documents(spark, ["a b"]), none).collect() == []
    assert dc.clean(documents(spark, ["a b"], ids=[None]), none).count() == 1
    assert dc.matches(documents(spark, []), none).collect() == []


def test_repeated_rows_and_long_texts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    item = " ".join(word() for _ in range(20))
    short = [" ".join(word() for _ in range(3)) for _ in range(2000)]
    long = " ".join(rng.choice(short) if rng.random() < 0.5 else word() for _ in range(20000))
    edited = " ".join(w if i != 7 else "zz" for i, w in enumerate(item.split()))
    texts = [item, item, f"x {edited} y", long, f"{long} {edited}"]
    docs = documents(spark, texts, ids=[1, 1, None, 4, 5]).withColumns({"k1": F.lit("clash"), "item": F.lit(0)})
    bench = spark.createDataFrame([(0, item), (None, item), (0, item), *((10 + i, t) for i, t in enumerate(short))], "item_id bigint, text string")
    rows = dc.matches(docs, bench).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"] if r["item_id"] is not None else -1, r["distance"]) for r in rows if r["item_words"] == 20) == sorted(
        (d, i, e) for d, e in ((1, 0), (1, 0), (-1, 1), (5, 1)) for i in (0, 0, -1)
    )
    found = {(r["doc_id"], r["item_id"]): r["start_word"] for r in rows if r["item_words"] == 3}
    w = long.split()
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(" ".join(w[i : i + 3]), i)
    assert found == {(d, 10 + i): at[t] for d in (4, 5) for i, t in enumerate(short) if t in at}
    assert dc.clean(docs, bench).count() == 0


def test_a_preamble_that_items_share(spark):
    """Texts that hold the preamble only meet no item; every item is found with its edits, in the preamble or after it."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    preamble = [word() for _ in range(20)]
    items = [preamble + [word() for _ in range(15)] for _ in range(120)]
    texts, want = [], set()
    for i in range(600):
        w = [word() for _ in range(10)] + preamble + [word() for _ in range(20)]
        if i % 20 == 0:
            item = items[i // 5].copy()
            for at in rng.sample(range(len(item)), 5):  # the whole budget
                item[at] = "edited"
            w, want = w[:10] + item + w[30:], want | {(i, i // 5)}
        texts.append(" ".join(w))
    docs = documents(spark, texts)
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id bigint, text string")
    found = dc.matches(docs, bench, 15, crowded=1000)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    distinct = dc._distinct(dc.items(bench, 15))
    rare = dc.rarest_pieces(docs, distinct)
    assert {r["count"] for r in rare.groupBy("item").count().collect()} == {6}
    # The pieces lie behind the preamble, so the candidates are the items that are there, not all with all.
    assert rare.where("at < 20").count() == 0
    assert dc.hits(docs, dc._bits_of(rare), [r["length"] for r in rare.select("length").distinct().collect()]).join(rare, "piece").select("k1", "item").distinct().count() == len(want)
