from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from medialedger.operators import titles
from medialedger.sources import incremental

TITLES = ["The Alien", "alienation", "A", "", None, "100% Wolf", "ÉCLAIR au chocolat", "Café_Noir", "back\\slash", "ab", "abc", "aXbc", "Straße", "the  ali"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    items = spark.createDataFrame([(i, t) for i, t in enumerate(TITLES)], "id bigint, title string")
    path = f"{tmp_path_factory.mktemp('index')}/titles"
    titles.write_index(items, path)
    return items, path


@pytest.mark.parametrize("text", ["alien", "ALI", "al", "a%ien", "a_i", "abc", "a_bc", "100\\% w", "é", "éclair", "é_lair", "back\\\\slash", "zzz", "%", "", "the  ali", "straße", "café\\_noir", "e\\%x"])
def test_titles_through_the_index_equal_a_scan(index, text):
    items, path = index
    want = sorted(r["id"] for r in items.where(F.col("title").ilike(f"%{text}%")).collect())
    assert sorted(r["id"] for r in titles.titles_like(items, path, text).collect()) == want


def test_only_the_partitions_of_the_pattern_are_read(index):
    items, path = index
    plan = titles.titles_like(items, path, "alienation")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_each_run_reads_what_is_new(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    schema, seen = "id bigint, updated_at timestamp_ntz", []

    def run(fail=False):
        def apply(batch, number):
            if fail:
                raise OSError("lost")
            seen.append((number, sorted(r["id"] for r in batch.collect())))

        incremental.scan_new(spark, f"{tmp_path}/in", schema, f"{tmp_path}/cp", apply)

    assert incremental.mark(spark, f"{tmp_path}/cp") is None
    add = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    add((1, at(0)), (2, at(9)))
    run()
    assert seen == [(0, [1, 2])] and incremental.mark(spark, f"{tmp_path}/cp") == at(7)
    run()
    add((3, at(5)))
    with pytest.raises(Exception, match="lost"):
        run(fail=True)
    run()
    assert seen == [(0, [1, 2]), (1, [3])] and incremental.mark(spark, f"{tmp_path}/cp") == at(7)
