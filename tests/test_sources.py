"""The class-file reader, the property report and the sinks, on a class compiled beforehand."""

import json
import shutil
import zipfile
from pathlib import Path

import pytest

from fieldloom.operators.property_access import classes_report, methods_report
from fieldloom.plans import report
from fieldloom.sources import classfile

ORDER = Path(__file__).parent / "data" / "Order.class"
ROLE = "Lexample/AggregateRoot;"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("classes")
    (d / "deep/er").mkdir(parents=True)
    shutil.copy(ORDER, d / "deep/er/Order.class")
    (d / "Bad.class").write_bytes(b"\xca\xfe\xba\xbe\0")
    (d / "notes.txt").write_text("x")
    with zipfile.ZipFile(d / "lib.jar", "w") as z:
        z.write(ORDER, "example/Order.class")
        z.writestr("META-INF/x.txt", "x")
    return d


def test_read_all_kinds(spark, folder):
    got = classfile.read(spark, str(folder), str(folder / "lib.jar"), str(folder / "deep/er/Order.class"), str(folder / "notes.txt"))
    rows = got.select("class_name", "corrupt", "annotations").collect()
    assert sorted(str(r.class_name) for r in rows) == ["None"] + ["example.Order"] * 3
    assert all((r.corrupt is None) == (r.class_name is not None) for r in rows)
    assert all(r.annotations == [ROLE] for r in rows if r.class_name)


def test_property_access(spark, folder):
    t = classfile.tables(classfile.read(spark, str(folder)))
    rows = {r.method_name: r for r in methods_report(t["classes"], t["methods"], t["insns"], [ROLE]).collect()}
    assert rows["<init>"].writes == ["big"] and rows["<init>"].reads == [] and rows["<init>"].calls == []
    assert (rows["touch"].reads, rows["touch"].writes) == (["age"], ["age", "name"])
    assert rows["look"].reads == ["age"]
    assert [(c.method_name, c.call_count) for c in rows["run"].calls] == [("getName", 1), ("recalc", 2)]
    assert rows["run"].reads == ["name"] and rows["recalc"].reads == ["items"]
    handles = t["insns"].where("kind = 'INDY'").select("bootstrap_name", "name").collect()
    assert {(r[0], r[1][:7]) for r in handles} == {("metafactory", "lambda$")}
    assert t["lines"].count() > 5


def test_sinks(spark, folder, tmp_path):
    t = classfile.tables(classfile.read(spark, str(folder)))
    classes = classes_report(t["classes"], t["methods"], t["insns"], [ROLE])
    report.write(classes, str(tmp_path / "a.json"), "json")
    found = json.loads((tmp_path / "a.json").read_text())
    assert found[0]["class_name"] == "example.Order" and found[0]["is_aggregate_root"] is True
    report.write(classes, str(tmp_path / "a.txt"), "TXT")
    assert "recalc(2)" in (tmp_path / "a.txt").read_text()
    report.write(classes, f"file:{tmp_path}/a.json", "JSON")  # again, over the one of before
    assert json.loads((tmp_path / "a.json").read_text()) == found and sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["a.json", "a.txt"]
    report.write(classes.limit(0), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == []
    with pytest.raises(ValueError):
        report.write(classes, "x", "xml")
    assert classes_report(t["classes"], t["methods"], t["insns"], ["Lother;"]).count() == 0


def many(spark, n=3000):
    method = "struct<method_name:string,method_desc:string,reads:array<string>,writes:array<string>,calls:array<struct<method_name:string,method_desc:string,call_count:bigint>>>"
    return spark.range(n, numPartitions=7).selectExpr("concat('c', lpad(CAST((id * 7919) % 3000 AS STRING), 4, '0')) AS class_name", f"CAST(array() AS array<{method}>) AS methods")


def test_a_large_report_is_many_files_in_order(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        report.write(many(spark), str(tmp_path / "parts"), "JSON", parts=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "parts").glob("part-*"))
    assert len(files) > 2
    found = json.loads("".join(f.read_text() for f in files))
    assert [x["class_name"] for x in found] == [f"c{k:04d}" for k in range(3000)]
    report.write(many(spark), str(tmp_path / "one.txt"), "TXT")
    text = (tmp_path / "one.txt").read_text().splitlines()
    assert text[0] == "class: c0000" and text[-1] == "total: 3000" and text[1] == "  no property access"
    assert report.read_lines(spark, str(tmp_path / "one.txt")).count() == 6001


def test_tree_and_console(spark, folder, tmp_path):
    paths = spark.createDataFrame([(["r", "b"],), (["r"],), (["r", "a", "x"],), (["r", "a"],)], "path array<string>")
    said = []
    report.say(report.tree_lines(paths), said.append)
    assert said == ["r", "└── a", "    └── x", "└── b"]
    report.write_lines(report.tree_lines(paths), str(tmp_path / "tree.txt"))
    assert (tmp_path / "tree.txt").read_text().splitlines() == said
    said.clear()
    report.log(many(spark).limit(2), said.append)
    assert said[0] == "analysis finished, 2 aggregate classes" and said[-1] == "total: 2"
