import json
import random

import pytest

from medialedger.sources import history_export, large_json


def text_of(rng, depth=0):
    kinds = ['plain', '} { "', "back\\slash\\", "é ü \U0001f600", "", "[{]}", '\\"', "line\nbreak"]
    if depth > 2 or rng.random() < 0.4:
        return rng.choice([rng.choice(kinds), rng.randint(-9, 9), None, True])
    return {rng.choice(kinds) + str(i): text_of(rng, depth + 1) for i in range(rng.randint(0, 4))} if rng.random() < 0.6 else [text_of(rng, depth + 1) for _ in range(rng.randint(0, 3))]


@pytest.mark.parametrize("size", [37, 120, 1 << 20])
def test_objects_of_arrays_cut_anywhere(spark, tmp_path, size):
    rng = random.Random(size)
    want = []
    for k in range(4):
        rows = [{"id": f"{k}-{i}", "x": text_of(rng)} for i in range(40)] + [{"id": f"{k}-long", "x": "{" * 300}]
        want += rows
        (tmp_path / f"a-{k}.json").write_text(json.dumps(rows, indent=rng.choice([None, 1]), ensure_ascii=k % 2 == 0))
    (tmp_path / "a-none.json").write_text("[]")
    (tmp_path / "a-one.json").write_text('{"id": "alone", "x": {}}')
    (tmp_path / "other.txt").write_text('[{"id": "no"}]')
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
        rows = large_json.array_objects(spark, str(tmp_path), "a-*.json")
        got = [json.loads(r["value"]) for r in rows.collect()]
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    key = lambda r: r["id"]
    assert sorted(got, key=key) == sorted([*want, {"id": "alone", "x": {}}], key=key)


def test_exports_with_broken_rows(spark, tmp_path):
    play = {"id": "1", "watched_at": "2024-01-02T03:04:05.000Z", "type": "movie", "movie": {"title": "A } film", "ids": {"imdb": "tt1"}}}
    (tmp_path / "watched-history-2.json").write_text(json.dumps([play, play | {"id": None}]))
    (tmp_path / "watched-history-10.json").write_text(json.dumps([play | {"id": "3"}])[:-9])
    (tmp_path / "readme.json").write_text("[{}]")
    rows = history_export.read_export(spark, str(tmp_path)).collect()
    assert sorted(((r["file_number"], r["id"] or "", r["reason"]) for r in rows), key=repr) == sorted([(2, "", "no id"), (2, "1", None), (10, "", "broken JSON")], key=repr)
