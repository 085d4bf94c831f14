"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from fieldloom import registry
from fieldloom.sources import store

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, D)
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    got = sorted(repr(tuple(r)) for r in df.collect())
    want = sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
    assert got and got == want


@pytest.mark.parametrize("name", ["list_replay", "list_clear_refill"])
def test_lists_meet_their_changes_where_partitions_are_merged_apart(spark, duck, name):
    """The two sides of the replay have partitions of different sizes, as larger tables do under the usual sizes."""
    size = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(size, "2k")
    try:
        got = sorted(map(tuple, registry.queries()[name](spark, D).collect()))
    finally:
        spark.conf.unset(size)
    assert got == sorted(duck.sql(registry.oracle_sql()[name]).fetchall())


def test_class_facts_are_dealt_to_tasks_by_their_number_and_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(registry, "TASK_CLASSES", 10)
    n = -(-spark.read.parquet(f"{D}/customer.parquet").count() // 10)
    assert n > spark.sparkContext.defaultParallelism
    assert {t.rdd.getNumPartitions() for t in registry._class_tables(spark, D).values()} == {n}
    for name in ("caller_fetch", "class_facts", "method_report"):
        assert "BroadcastHashJoin" not in registry.queries()[name](spark, D)._jdf.queryExecution().executedPlan().toString()


def test_store_sorts_bounded_runs(spark, duck, monkeypatch):
    monkeypatch.setattr(store, "TASK_ROWS", 500)
    got = sorted(repr(tuple(r)) for r in registry.store_save(spark, D).collect())
    assert got == sorted(map(repr, duck.sql(registry.oracle_sql()["store_save"]).fetchall()))


def test_store_files_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "TASK_ROWS", 100)
    s = store.ParquetStore(spark, str(tmp_path))
    s.write("t", spark.range(5000))
    assert s.rows("t") == 5000 and max(f["rows"] for f in s.manifest("t")["files"]) <= 300
