"""Mappings' rules, members, stores, options and build folders."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions import defaults, entry, lists
from fieldloom.functions.naming import by_length
from fieldloom.operators import callgraph, members
from fieldloom.operators.changes import adding_all, clearing, replay
from fieldloom.operators.mapping import Field, Fields, ListFields, effective, is_basic
from fieldloom.plans import analysis, fetch, report
from fieldloom.sources import classfile
from fieldloom.sources.assemble import class_file
from fieldloom.sources.store import Conflict, EntityOperator, ParquetStore, Schemas

ORDER = Path(__file__).parent / "data" / "Order.class"


def test_one_mapping_for_a_field():
    assert effective([], "name") == "name" and effective([Field("a")]) == Field("a")
    with pytest.raises(ValueError, match="x has 2 mappings"):
        effective([Fields({}), Field("a")], "x")
    assert effective([ListFields("l", {}), Fields({}), Field("a")], strict=False) == Field("a")
    with pytest.raises(TypeError):
        effective(["a"])
    assert by_length(["base:ccc", "base:", "base:a", "base:b"]) == [(1, "base:"), (2, "base:a"), (3, "base:b"), (0, "base:ccc")]
    assert [is_basic(t) for t in (T.StringType(), T.DecimalType(), T.DateType(), T.BinaryType(), T.ArrayType(T.LongType()), T.StructType())] == [True, True, True, False, False, False]


def test_members(spark):
    schema = T.StructType().add("id", "long").add("owner", "string")
    added = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "key long, own string")
    bound = spark.createDataFrame([(1, (10, None), "A"), (2, None, "B")], "key long, row struct<id:bigint,owner:string>, who string")
    got = {r.key: r for r in members.member_rows(added, bound, "key", ["base:owner", "base:"], ["who", "row"], schema).collect()}
    assert [(got[k].created, got[k].member.id, got[k].member.owner, got[k].own) for k in (1, 2, 3)] == [(False, 10, "A", "x"), (True, None, "B", "y"), (True, None, None, "z")]
    got = members.member_rows(added, bound, "key", ["base:owner"], ["who"], schema).orderBy("key").collect()
    assert [(r.created, r.member.id, r.member.owner) for r in got] == [(True, None, "A"), (True, None, "B"), (True, None, None)]


def test_clear_and_add_all(spark):
    state = spark.createDataFrame([(1, ["a", "b"], ["x", "y"], 1), (2, [], ["z"], 0)], "id long, items array<string>, new array<string>, at int")
    users = state.select("id", "items")
    put = adding_all(state, "id", 5, "at", "new")
    assert {r.id: r["items"] for r in replay(users, put, "id").collect()} == {1: ["a", "x", "y", "b"], 2: ["z"]}
    assert {r.id: r["items"] for r in replay(users, clearing(users, "id", 0).unionByName(put.where("id = 2")), "id").collect()} == {1: [], 2: ["z"]}
    row = state.where("id = 1").select(lists.add_all_at(F.col("items"), F.lit(2), F.col("new")), lists.clear(F.col("items")), lists.paired(F.col("items"), F.col("new"), F.lit("b")), lists.paired(F.col("items"), F.col("new"), F.lit("q"))).first()
    assert list(row) == [["a", "b", "x", "y"], [], "y", None]


def test_store_and_schemas(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path))
    with pytest.raises(LookupError):
        store.read("goods")
    store.write("goods", spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"))
    store.save("goods", spark.createDataFrame([(2, "c"), (3, "d")], "id long, name string"), "id")
    assert {tuple(r) for r in store.read("goods").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert store.find("goods", spark.createDataFrame([(3,)], "id long"), "id").first().name == "d"
    with pytest.raises(Exception, match="not found"):
        store.find("goods", spark.createDataFrame([(9,)], "id long"), "id").collect()
    store.write("lines", spark.createDataFrame([(1, "l1"), (2, "l2")], "id long, line string"))
    store.save_children("lines", spark.createDataFrame([(1, "new")], "id long, line string"), spark.createDataFrame([(1,)], "id long"), "id")
    assert {tuple(r) for r in store.read("lines").collect()} == {(1, "new"), (2, "l2")}
    again = ParquetStore(spark, str(tmp_path))
    assert {tuple(r) for r in again.read("goods").collect()} == {(1, "a"), (2, "c"), (3, "d")} and again.read("goods", 1).count() == 2
    again.save("goods", spark.createDataFrame([(3, "e")], "id long, name string"), "id")
    assert store.read("goods").where("id = 3").first().name == "e"
    schemas = Schemas({"Goods": {"goods": T.StructType().add("id", "long"), "address": T.StructType().add("x", T.StructType().add("y", "integer"))}})
    assert spark.range(1).select(*schemas.create("Goods")).schema.simpleString() == "struct<goods:struct<id:bigint>,address:struct<x:struct<y:int>>>"
    with pytest.raises(LookupError, match="no entities for Other"):
        schemas.create("Other")


def test_a_save_rewrites_what_it_touches(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write("t", spark.range(8000).selectExpr("id", "'a' AS v"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    before = {f["path"] for f in store.manifest("t")["files"]}
    assert len(before) > 4
    store.save("t", spark.createDataFrame([(17, "b"), (90_000, "c"), (17, "b2")], "id long, v string"), "id")
    after = {f["path"] for f in store.manifest("t")["files"]}
    assert len(before - after) == 1
    rows = store.read("t")
    assert rows.count() == 8002 and sorted(r.v for r in rows.where("id = 17 OR id > 8000").collect()) == ["b", "b2", "c"]
    store.save_children("t", rows.limit(0), spark.range(4000, 4002), "id")
    assert store.read("t").count() == 8000 and store.version("t") == 3
    store.save("t", rows.limit(0), "id")
    assert store.read("t").count() == 8000


def test_two_writers_of_one_version(spark, tmp_path):
    one, two = ParquetStore(spark, str(tmp_path)), ParquetStore(spark, str(tmp_path))
    one.write("t", spark.range(3).toDF("id"))
    made = two.manifest("t")
    two.save("t", spark.createDataFrame([(9,)], "id long"), "id")
    with pytest.raises(Conflict, match="version 2 of t"):
        one._commit("t", 2, made)
    assert one.read("t").count() == 4 and not [x for x in (tmp_path / "t" / "_log").iterdir() if len(x.name) == 33]


def test_entity_operator(spark):
    e, op = F.col("e"), EntityOperator()
    df = spark.createDataFrame([(("n", ["a", "b", "a"]),)], "e struct<name:string,xs:array<string>>")
    row = df.select(op.get(e, "name"), op.set(e, "name", F.lit("m"))["name"], op.add(e, "xs", F.lit("c"))["xs"], op.add_at(e, "xs", F.lit(1), F.lit("c"))["xs"], op.remove(e, "xs", F.lit("a"))["xs"]).first()
    assert list(row) == ["n", "m", ["a", "b", "a", "c"], ["a", "c", "b", "a"], ["b", "a"]]


def test_entry_forms(spark):
    df = spark.createDataFrame([("a.B", "run", ["int", "a.C[][]", "boolean"], "a.D")], "c string, n string, p array<string>, r string")
    a = df.select(entry.reflected_key(F.col("c"), F.col("n"), F.col("p"), F.col("r")).alias("k")).first().k
    b = df.select(entry.lambda_key(F.lit("a/B"), F.lit("run"), F.lit("(I[[La/C;Z)La/D;")).alias("k")).first().k
    c = df.select(entry.method_key(F.lit("a/B"), F.lit("run"), F.lit("(I[[La/C;Z)La/D;")).alias("k")).first().k
    assert a == b == c == ("a.B", "run", "(I[[La/C;Z)La/D;")


def test_snowflake(spark):
    at = lambda ms, n: spark.range(1).select(defaults.snowflake(F.lit(ms), F.lit(n))).first()[0]
    assert at(defaults.EPOCH_MS + 1, 2) == 1 << 22 | 1 << 17 | 1 << 12 | 2
    with pytest.raises(Exception, match="more ids"):
        at(defaults.EPOCH_MS, 4096)


@pytest.mark.parametrize("parts", [1, 9])
def test_snowflake_numbers(spark, parts):
    rnd = random.Random(parts)
    ms = [defaults.EPOCH_MS + t for t in rnd.choices([0, 0, 0, 1, 5, 6, 900], k=30_000)]
    rows = spark.createDataFrame(list(enumerate(ms)), "id long, ms long").repartition(parts)
    got = {r.id: r.number for r in defaults.numbered(rows, "ms", ["id"]).collect()}
    slot, want = -1, {}
    for i in sorted(range(len(ms)), key=lambda i: (ms[i], i)):
        slot = max(slot + 1, (ms[i] - defaults.EPOCH_MS) * 4096)
        want[i] = slot // 4096 << 22 | 1 << 17 | 1 << 12 | slot % 4096
    assert got == want and len(set(got.values())) == len(ms)
    assert defaults.numbered(rows.limit(0), "ms", ["id"]).count() == 0


def test_planned_fields_alone_reach_the_scan(spark, tmp_path):
    row = "id long, name string, address struct<city:string,place:struct<code:string,zip:string>>, items array<struct<sku:string,n:int,maker:struct<id:long,name:string>>>"
    df = spark.createDataFrame([(1, "a", ("x", ("c", "z")), [("s", 1, (7, "m")), ("t", 2, None)]), (2, "b", None, None), (3, "c", ("y", None), [])], row)
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    got = stored.select(*fetch.projection(stored, ["id", "address.place.code", "items.sku", "items.maker.id"]))
    scans = got._jdf.queryExecution().executedPlan().collectLeaves()
    assert scans.head().requiredSchema().simpleString() == "struct<id:bigint,address:struct<place:struct<code:string>>,items:array<struct<sku:string,maker:struct<id:bigint>>>>"
    rows = {r.id: r for r in got.collect()}
    assert rows[1].address.place.code == "c" and [(x.sku, x.maker) for x in rows[1]["items"]] == [("s", (7,)), ("t", (None,))]
    assert rows[2].address is None and rows[2]["items"] is None and rows[3].address.place is None and rows[3]["items"] == []
    assert stored.select(*fetch.projection(stored, ["items", "items.n"])).schema["items"].dataType == stored.schema["items"].dataType
    for bad in ("zip", "address.street", "name.first", "items.maker.x"):
        with pytest.raises(ValueError, match="no field|has no fields"):
            fetch.projection(stored, [bad])


def test_frames_by_bins(spark):
    rnd = random.Random(3)
    lines = [("C", rnd.choice("ab"), m, rnd.choice([5, 300, 1030, 70_000, 1_000_000]) + rnd.randint(0, 400)) for m in range(12) for _ in range(rnd.randint(1, 5))]
    frames = [(k, "C", rnd.choice("abz"), rnd.choice([x[3] for x in lines]) if k % 2 else rnd.randint(0, 80_000)) for k in range(300)]

    def resolve(name, at):
        own = [(m, line) for _, n, m, line in lines if n == name]
        if any(line == at for _, line in own):
            return max(m for m, line in own if line == at)
        around = [m for m in {m for m, _ in own} if min(x for k, x in own if k == m) <= at <= max(x for k, x in own if k == m)]
        return min(around) if around else min((m for m, _ in own), default=None)

    df = spark.createDataFrame(frames, "k int, cls string, name string, line int")
    got = {r.k: r.method_ord for r in callgraph.resolve_frames(df, spark.createDataFrame(lines, "cls string, name string, method_ord int, line int"), ["cls", "name"]).collect()}
    assert got == {k: resolve(n, at) for k, _, n, at in frames}


def test_build_folders_and_options(spark, tmp_path, capsys):
    project = str(tmp_path)
    assert analysis.class_folders(spark, project) == [f"{project}/{p}" for p in analysis.BUILD_FOLDERS]
    assert analysis.analyse(spark, project).count() == 0
    java = tmp_path / "build/classes/java/main"
    java.mkdir(parents=True)
    shutil.copy(ORDER, java / "Order.class")
    assert analysis.class_folders(spark, project) == [str(java)]
    out = tmp_path / "report.txt"
    found = analysis.analyse(spark, project, analysis.Options(output=str(out), form="txt", verbose=True))
    assert [r.class_name for r in found.collect()] == ["example.Order"]
    assert "class: example.Order" in out.read_text() and "1 aggregate classes" in capsys.readouterr().out
    dotted = tmp_path / "build.out"
    dotted.mkdir()
    shutil.copy(ORDER, dotted / "Order.class")
    options = analysis.Options(class_paths=("build.out", "missing", "report.txt"))
    assert analysis.class_folders(spark, project, options) == [str(dotted)]
    read = classfile.read(spark, str(dotted), str(out))
    assert read.count() == 1 and classfile.by_name(read, "example/Order").count() == 1 and classfile.by_name(read, "x.Y").count() == 0
    said = []
    report.show(found, said.append)
    assert "class: example.Order" in said[0] and said[-1] == "total: 1" and not any("calls" in x for x in said)
    with pytest.raises(ValueError, match="unknown format"):
        analysis.analyse(spark, project, analysis.Options(form="xml"))
    assert analysis.version("no-such-package") == "1.0.0"


def test_frames_keep_rows_and_columns(spark):
    lines = spark.createDataFrame([("C", 0, 10), ("C", 1, 20)], "cls string, method_ord int, line int")
    frames = spark.createDataFrame([("C", 20, "a"), ("C", 20, "a"), ("D", 1, "b")], "cls string, line int, more string")
    assert sorted(map(tuple, callgraph.resolve_frames(frames, lines, ["cls"]).collect()), key=str) == [("C", 20, "a", 1), ("C", 20, "a", 1), ("D", 1, "b", None)]


def test_paths_of_any_length_and_name(spark):
    names = [f"n'{i}" for i in range(60)]
    edge = spark.createDataFrame(list(zip(names, names[1:])) + [(names[-1], names[0])], "caller string, callee string")
    got = callgraph.call_paths(edge, spark.createDataFrame([(names[0],)], "root string")).collect()
    assert max(len(r.path) for r in got) == 60 and len(got) == 60


def test_inherited_methods(spark):
    declared = spark.createDataFrame([("A", "m", "()V", 1), ("A", "p", "()V", 2), ("B", "p", "()V", 1), ("C", "q", "()V", 0), ("A", "q", "()V", 1), ("A", "q", "()V", 2)], "class_name string, name string, descriptor string, access int")
    above = spark.createDataFrame([("C", "B"), ("B", "A"), ("A", None), ("X", "X")], "class_name string, super_name string")
    wanted = spark.createDataFrame([(c, n, "()V") for c, n in [("C", "m"), ("C", "p"), ("C", "q"), ("B", "q"), ("A", "p"), ("A", "none"), ("X", "m")]], "class_name string, name string, descriptor string")
    got = {(r.class_name, r.name): r.found_in for r in callgraph.find_methods(wanted, declared, above).collect()}
    assert got == {("C", "m"): "A", ("C", "p"): "B", ("C", "q"): "C", ("B", "q"): "A", ("A", "p"): "A", ("A", "none"): None, ("X", "m"): None}


def test_inheritance_with_cycles_and_diamonds(spark):
    key = "class_name string, name string, descriptor string"
    # D has parents B and C (in this order), both under A; X and Y are each other's parent.
    above = spark.createDataFrame([("D", "B", 0), ("D", "C", 1), ("B", "A", 0), ("C", "A", 0), ("X", "Y", 0), ("Y", "X", 0), ("Y", "A", 1), ("X", "X", 1), ("D", "C", 2)], "class_name string, super_name string, ord int")
    declared = spark.createDataFrame([("A", "m", "()V", 1), ("B", "n", "()V", 1), ("C", "n", "()V", 1), ("C", "p", "()V", 1), ("X", "q", "()V", 2), ("D", "r", "()V", 2), ("A", "r", "()V", 1)], key + ", access int")
    wanted = spark.createDataFrame([(c, n, "()V") for c in "DXY" for n in "mnpqr"] + [("D", "m", "()V"), (None, "m", "()V")], key)
    got = sorted(((r.class_name or "", r.name, r.found_in or "") for r in callgraph.find_methods(wanted, declared, above).collect()))
    assert got == sorted([("", "m", ""), ("D", "m", "A"), ("D", "m", "A"), ("D", "n", "B"), ("D", "p", "C"), ("D", "q", ""), ("D", "r", "D"), ("X", "m", "A"), ("X", "n", ""), ("X", "p", ""), ("X", "q", "X"), ("X", "r", "A"), ("Y", "m", "A"), ("Y", "n", ""), ("Y", "p", ""), ("Y", "q", ""), ("Y", "r", "A")])


def test_order_of_ancestors_equals_search(spark):
    rnd = random.Random(5)
    up = {f"c{i}": [f"c{rnd.randrange(60)}" for _ in range(rnd.randint(0, 3))] for i in range(60)}
    above = spark.createDataFrame([(c, p, i) for c, ps in up.items() for i, p in enumerate(ps)], "class_name string, super_name string, ord int")
    got = {}
    for r in callgraph.ancestors(above).orderBy("class_name", "depth", "path").collect():
        got.setdefault(r.class_name, []).append((r.ancestor, r.depth))
    for c in up:
        seen, level, want, depth = {c}, [c], [], 0
        while level:
            depth += 1
            level = [p for x in level for p in up[x] if p not in seen and not seen.add(p)]
            want += [(p, depth) for p in level]
        assert got.get(c, []) == want


def test_a_long_chain_of_parents(spark):
    above = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(120)], "class_name string, super_name string")
    declared = spark.createDataFrame([("c120", "m", "()V", 1)], "class_name string, name string, descriptor string, access int")
    wanted = spark.createDataFrame([("c0", "m", "()V"), ("c119", "m", "()V")], "class_name string, name string, descriptor string")
    assert {r.found_in for r in callgraph.find_methods(wanted, declared, above).collect()} == {"c120"}


def test_a_search_upward_ends_at_the_first_hit(spark, monkeypatch):
    """Every other class of a chain has the method: no rows are made for the classes above the one that is found."""
    n, rows = 64, []
    above = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(n)], "class_name string, super_name string")
    declared = spark.createDataFrame([(f"c{i}", "m", "()V", 1) for i in range(1, n, 2)], "class_name string, name string, descriptor string, access int")
    wanted = spark.createDataFrame([(f"c{i}", "m", "()V") for i in range(n)], "class_name string, name string, descriptor string")
    write = callgraph.checkpoint

    def counted(df):
        written = write(df)
        rows.append(written.count())
        return written

    monkeypatch.setattr(callgraph, "checkpoint", counted)
    got = {r.class_name: r.found_in for r in callgraph.find_methods(wanted, declared, above).collect()}
    assert got == {f"c{i}": f"c{i + 1 - i % 2}" for i in range(n)}
    assert sum(rows) <= 4 * n


def test_load_by_the_caller(spark):
    role = analysis.AGGREGATE_ROOT
    service = class_file("app.Service", [("handle", "()V", [("invokevirtual", "shop.Goods", "rename", "()V")]), ("other", "()V", [("invokevirtual", "shop.Goods", "price", "()V")])])
    goods = class_file("shop.Goods", [("rename", "()V", [("getfield", "shop.Goods", "name", "I"), ("invokevirtual", "shop.Goods", "check", "()V")]), ("check", "()V", [("getfield", "shop.Goods", "status", "I"), ("putfield", "shop.Goods", "log", "I")]), ("price", "()V", [("getfield", "shop.Goods", "price", "I")])], (role,))
    t = classfile.tables(classfile.from_bytes(spark.createDataFrame([("a.class", bytearray(service)), ("b.class", bytearray(goods))], "path string, content binary")))
    frames = spark.createDataFrame([("app.Service", "handle", 1)], "class_name string, method_name string, line int")
    plan = fetch.caller_fields(frames, t["methods"], t["lines"], t["insns"], t["classes"], [role])
    assert sorted(r.field for r in plan.collect()) == ["name", "status"]
    entity = spark.createDataFrame([(1, "n", "s", 2.0, "l")], "id long, name string, status string, price double, log string")
    assert fetch.load(entity, "id", plan, "shop.Goods").columns == ["id", "name", "status"]
