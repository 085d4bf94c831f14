"""Class files and jars as a data source: splits, pushed filters, pruned columns."""

import json
import shutil
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fieldloom.sources import classfile, scan
from fieldloom.sources.assemble import class_file

ORDER = Path(__file__).parent / "data" / "Order.class"


def some_class(k):
    own = f"shop.C{k}"
    return class_file(own, [("update", "()V", [("getfield", own, f"f{k % 7}", "D")])], ("Lexample/AggregateRoot;",))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("scan")
    (d / "deep").mkdir()
    shutil.copy(ORDER, d / "deep/Order.class")
    (d / "Bad.class").write_bytes(b"\xca\xfe\xba\xbe\0")
    (d / "notes.txt").write_text("x")
    with zipfile.ZipFile(d / "lib.jar", "w", zipfile.ZIP_DEFLATED) as z:
        z.write(ORDER, "example/Order.class")
        z.writestr("META-INF/x.txt", "x")
        z.writestr("shop/Stored.class", some_class(1), zipfile.ZIP_STORED)
        z.writestr("odd/Bz.class", some_class(2), zipfile.ZIP_BZIP2)
    return d


def plain(df):
    return sorted((r.class_id.rpartition("/")[2], r.class_name, r.super_name, r.annotations, r.methods, r.insns, r.lines, r.corrupt and r.corrupt[:10]) for r in df.collect())


def test_equals_the_reader_through_spark(spark, folder):
    paths = [str(folder), str(folder / "deep/Order.class"), str(folder / "notes.txt")]
    assert plain(scan.read(spark, *paths)) == plain(classfile.read(spark, *paths))
    jar = scan.read(spark, f"file:{folder}/lib.jar")
    assert [(r.entry_name, r.class_name) for r in jar.orderBy("entry_name").collect()] == [("example/Order.class", "example.Order"), ("odd/Bz.class", None), ("shop/Stored.class", "shop.C1")]
    whole = classfile.read(spark, str(folder / "lib.jar")).where("entry_name = 'example/Order.class'")
    assert plain(jar.where("entry_name = 'example/Order.class'")) == plain(whole)
    with pytest.raises(Exception, match="FileNotFoundError"):
        scan.read(spark, str(folder / "missing")).collect()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, folder):
    found = scan.find(spark, [str(folder), str(folder / "lib.jar")], "example/Order", "shop.C1", columns=["class_name", "entry_name"])
    assert sorted(map(tuple, found.collect())) == [("example.Order", ""), ("example.Order", "example/Order.class"), ("shop.C1", "shop/Stored.class")]
    assert "Filter (" not in plan_of(found)
    both = scan.read(spark, str(folder)).where("corrupt IS NULL AND class_name LIKE 'example.%'").select("class_name")
    assert [r.class_name for r in both.collect()] == ["example.Order"] and "Filter (" in plan_of(both)


def test_a_name_skips_what_stands_after_it():
    b = some_class(5)
    cut = b[: b.index(b"update") + 6]  # the pool's end and all that follows are gone
    pool_only = b[:-40]
    assert classfile.parse(pool_only, {"other.Name"}) is None
    with pytest.raises(Exception):
        classfile.parse(cut, {"shop.C5"})
    assert classfile.parse(b, {"shop.C5"}, insns=False, lines=False)["insns"] == []


def test_pushed_filters_choose_files_and_entries(folder):
    reader = scan.ClassFileReader(["class_name"], [str(folder), str(folder / "lib.jar")], scan.SPLIT_BYTES)
    left = list(reader.pushFilters([scan.EqualTo(("entry_name",), "shop/Stored.class"), scan.EqualTo(("class_id",), "x")]))
    assert [f.attribute for f in left] == [("class_id",)]
    assert [[x[0] for _, run in s.jars for x in run] + s.files for s in reader.partitions()] == [["shop/Stored.class"]]
    assert [r for s in reader.partitions() for r in reader.read(s)] == [("shop.C1",)]
    nothing = scan.ClassFileReader(["class_name"], [str(folder)], scan.SPLIT_BYTES)
    list(nothing.pushFilters([scan.In(("source_path",), ("nowhere",))]))
    assert [r for s in nothing.partitions() for r in nothing.read(s)] == []


def test_a_large_jar_is_many_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "large.jar", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(5000):
            z.writestr(f"shop/C{k}.class", some_class(k))
    df = scan.read(spark, str(tmp_path / "large.jar"), split_bytes=100_000)
    rows = df.select("class_name", F.spark_partition_id().alias("p"), F.col("insns")[0]["name"].alias("f")).collect()
    assert sorted(r.class_name for r in rows) == sorted(f"shop.C{k}" for k in range(5000))
    assert all(r.f == f"f{int(r.class_name[6:]) % 7}" for r in rows)
    assert len({r.p for r in rows}) > 10


def test_small_jars_share_a_task(spark, tmp_path):
    for k in range(300):
        with zipfile.ZipFile(tmp_path / f"j{k}.jar", "w") as z:
            z.writestr(f"shop/C{k}.class", some_class(k))
    df = scan.read(spark, *(str(tmp_path / f"j{k}.jar") for k in range(300)), columns=["class_name"])
    assert df.rdd.getNumPartitions() < 10 and df.distinct().count() == 300


def test_ten_thousand_files(spark, tmp_path):
    for k in range(10_000):
        at = tmp_path / f"p{k % 50}"
        at.mkdir(exist_ok=True)
        (at / f"C{k}.class").write_bytes(some_class(k))
    df = scan.read(spark, str(tmp_path), columns=["class_name", "methods"])
    assert df.rdd.getNumPartitions() > 4
    assert df.agg(F.count_distinct("class_name"), F.sum(F.size("methods"))).first() == (10_000, 10_000)
    assert scan.find(spark, [str(tmp_path)], "shop.C77").count() == 1


def test_planning_opens_no_small_jar_and_tasks_get_no_paths(tmp_path):
    import pickle
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.jar", "w") as z:
        z.writestr("x/A.class", b"no class")
        z.writestr("x/B.txt", b"x")
    jar = str(tmp_path / "a.jar")
    reader = scan.ClassFileReader(["entry_name", "corrupt"], [jar] * 1000, scan.SPLIT_BYTES)
    parts = reader.partitions()
    assert all(entries is None for p in parts for _, entries in p.jars)
    task = pickle.dumps(reader)
    assert jar.encode() not in task
    rows = [r for p in parts for r in pickle.loads(task).read(p)]
    assert len(rows) == 1000 and {r[0] for r in rows} == {"x/A.class"}


def test_tasks_and_plans_hold_no_lists_of_paths(spark, tmp_path):
    import pickle

    folder, jars = tmp_path / "classes" / "deep", []
    for i in range(2000):
        with scan.create(f"{folder}/c{i}.class") as f:
            f.write(class_file(f"shop.C{i}", []))
    for i in range(3):
        jars.append(f"{tmp_path}/j\n{i}.jar")
        with zipfile.ZipFile(jars[-1], "w") as z:
            z.writestr("x/J.class", class_file(f"shop.J{i}", []))
        scan.write_list(f"{tmp_path}/lists/{i}", jars[-1:])
    reader = scan.ClassFileReader(["class_name"], [str(tmp_path / "classes")], scan.SPLIT_BYTES, f"{tmp_path}/lists")
    parts = reader.partitions()
    assert sum(len(p.files) for p in parts) == 2000 and sum(len(p.jars) for p in parts) == 3
    # A path has more than fifty bytes; what the driver holds of it has a few.
    assert sum(len(pickle.dumps(p)) for p in parts) < 2003 * 20
    df = scan.read(spark, str(tmp_path / "classes"), jars[0], columns=["class_name"], listed=f"{tmp_path}/lists")
    assert sorted(r.class_name for r in df.collect()) == sorted([f"shop.C{i}" for i in range(2000)] + [f"shop.J{i}" for i in (0, 0, 1, 2)])
    source = scan.ClassFiles({"paths": json.dumps(jars)})
    assert json.loads(pickle.loads(pickle.dumps(source)).options["paths"]) == jars
    source.reader(df.schema)
    assert pickle.loads(pickle.dumps(source)).options == {}
    scan.write_list(f"{tmp_path}/lists/3", [f"{tmp_path}/none.jar"])
    with pytest.raises(FileNotFoundError):
        reader.partitions()
