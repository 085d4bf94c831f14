"""Mappings, lists, changes and graphs against plain Python."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.functions import lists
from fieldloom.functions.choice import last_non_null
from fieldloom.functions.naming import split_path
from fieldloom.operators import bags, callgraph, hydrate
from fieldloom.operators.changes import replay
from fieldloom.operators.rope import Rope
from fieldloom.operators.mapping import Binding, Field, Fields, PolyFields, Poly


def test_paths():
    names = ["goods", "local"]
    assert split_path("name", names) == (0, ["name"])
    assert split_path("goods:a.b", names) == (0, ["a", "b"])
    assert split_path("local:x", names) == (1, ["x"])
    assert split_path("a1:x", names) == (1, ["x"])
    assert split_path("", names) == (0, []) and split_path("goods:", names) == (0, [])
    with pytest.raises(ValueError, match="entity name not found"):
        split_path("zz:x", names)


def test_lists(spark):
    df = spark.createDataFrame([(["x", "y", "x"], ["x", "z"])], "xs array<string>, ys array<string>")
    xs, ys, x = F.col("xs"), F.col("ys"), F.lit("x")
    row = df.select(
        lists.remove_first(xs, x), lists.remove_first(xs, F.lit("q")), lists.remove_all(xs, ys), lists.retain_all(xs, ys), lists.add_at(xs, F.lit(1), F.lit("n")),
        lists.set_at(xs, F.lit(2), F.lit("n")), lists.sub_list(xs, F.lit(1), F.lit(3)), lists.last_index_of(xs, x), lists.index_of(xs, F.lit("q")), lists.contains_all(xs, F.array(x)), lists.add_all(xs, ys),
    ).first()
    assert list(row) == [["y", "x"], ["x", "y", "x"], ["y", "x"], ["x", "x"], ["x", "n", "y", "x"], ["x", "y", "n"], ["y", "x"], 2, -1, True, ["x", "y", "x", "x", "z"]]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abc"), max_size=4), st.lists(st.tuples(st.sampled_from(["INSERT", "DELETE", "REPLACE"]), st.integers(0, 9), st.sampled_from("abc")), max_size=6))
def test_replay_equals_a_list(spark, start, ops):
    want, log = list(start), []
    for k, (op, pos, value) in enumerate(ops):
        if op == "INSERT":
            pos %= len(want) + 1
            want.insert(pos, value)
        elif not want:
            continue
        elif op == "DELETE":
            pos %= len(want)
            del want[pos]
            value = None
        else:
            pos %= len(want)
            want[pos] = value
        log.append((1, k, op, pos, value))
    state = spark.createDataFrame([(1, start), (2, ["k"])], "id long, items array<string>")
    changes = spark.createDataFrame(log, "id long, seq int, op string, pos int, value string")
    assert {r.id: r["items"] for r in replay(state, changes, "id").collect()} == {1: want, 2: ["k"]}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(), max_size=30), st.lists(st.tuples(st.sampled_from("idr"), st.integers(-2, 40)), max_size=80))
def test_rope_equals_a_list(start, ops):
    want, rope = list(start), Rope(start)
    for k, (op, at) in enumerate(ops):
        fits = 0 <= at < len(want) + (op == "i")
        try:
            rope.insert(at, k) if op == "i" else rope.delete(at) if op == "d" else rope.set(at, k)
            assert fits
        except IndexError:
            assert not fits
            continue
        if op == "i":
            want.insert(at, k)
        elif op == "d":
            del want[at]
        else:
            want[at] = k
        assert list(rope) == want and len(rope) == len(want)


def test_rope_of_small_blocks(monkeypatch):
    monkeypatch.setattr(Rope, "SIZE", 2)
    test_rope_equals_a_list()


@pytest.mark.parametrize("op,pos,value", [("DELETE", 2, None), ("DELETE", None, None), ("REPLACE", 2, "x"), ("REPLACE", -1, "x"), ("INSERT", 3, "x"), ("INSERT", 0, None), ("MOVE", 0, "x")])
def test_replay_refuses(spark, op, pos, value):
    state = spark.createDataFrame([(1, ["a", "b"])], "id long, items array<string>")
    log = spark.createDataFrame([(1, 0, op, pos, value)], "id long, seq int, op string, pos int, value string")
    with pytest.raises(Exception, match="no such position|null element|unknown change"):
        replay(state, log, "id").collect()


def test_replay_keeps_other_columns_and_lists(spark):
    state = spark.createDataFrame([(1, "x", [1]), (1, "y", [2]), (2, None, None), (None, "z", [3]), (3, "w", [])], "id long, more string, items array<int>")
    log = spark.createDataFrame([(1, 0, "INSERT", None, 7), (2, 0, "INSERT", None, 7), (9, 0, "DELETE", 0, None), (None, 0, "DELETE", 0, None)], "id long, seq int, op string, pos int, value int")
    got = replay(state, log, "id")
    assert got.columns == state.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(1, "x", [1, 7]), (1, "y", [2, 7]), (2, None, None), (None, "z", [3]), (3, "w", [])], state.schema).collect()))


def test_replay_of_a_hundred_thousand_changes(spark):
    rnd = random.Random(7)
    want, log = list(range(2000)), []
    for k in range(100_000):
        op = rnd.choice(["INSERT", "INSERT", "DELETE", "REPLACE"]) if want else "INSERT"
        at = rnd.randint(0, len(want) - (op != "INSERT"))
        if op == "INSERT":
            want.insert(at, k)
        elif op == "DELETE":
            del want[at]
        else:
            want[at] = k
        log.append((1, k, op, at, None if op == "DELETE" else k))
    state = spark.createDataFrame([(1, list(range(2000)))], "id long, items array<int>")
    changes = spark.createDataFrame(log, "id long, seq int, op string, pos int, value int")
    assert replay(state, changes, "id").first()["items"] == want


def test_bags_equal_lists(spark):
    rnd = random.Random(9)
    some = lambda n: [rnd.choice([None, "a", "b", "c", "d"]) for _ in range(n)]
    rows = [(i, some(rnd.randint(0, 12)), "x") for i in range(40)] + [(50, None, "x"), (51, [], "y"), (52, some(10_000), "z")]
    others = [(i, v) for i, xs, _ in rows for v in some(4000 if i == 52 else rnd.randint(0, 5))] + [(99, "a"), (None, "a")]
    state, more = spark.createDataFrame(rows, "id long, items array<string>, more string"), spark.createDataFrame(others, "id long, value string")

    def removed(i, xs):
        xs = None if xs is None else list(xs)
        for k, v in others:
            if k == i and xs and v in xs:
                xs.remove(v)
        return xs

    got = {r.id: (r["items"], r.more) for r in bags.remove_all(state, more, "id").collect()}
    assert got == {i: (removed(i, xs), m) for i, xs, m in rows}
    got = {r.id: r["items"] for r in bags.retain_all(state, more, "id").collect()}
    assert got == {i: None if xs is None else [x for x in xs if (i, x) in set(others)] for i, xs, _ in rows}


def test_null_elements(spark):
    df = spark.createDataFrame([(["x", None, "y", None], [None, "y"])], "xs array<string>, ys array<string>")
    xs, ys, none = F.col("xs"), F.col("ys"), F.lit(None).cast("string")
    row = df.select(lists.remove_first(xs, none), lists.remove_all(xs, ys), lists.retain_all(xs, ys), lists.index_of(xs, none), lists.last_index_of(xs, none), lists.index_of(F.array(F.lit("q")), none), lists.last_index_of(F.array(F.lit("q")), none), lists.remove_at(xs, F.lit(None).cast("int")), lists.contains_all(xs, ys), lists.paired(xs, F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), none)).first()
    assert list(row) == [["x", "y", None], ["x", None], [None, "y", None], 1, 3, -1, -1, ["x", None, "y", None], True, 2]


def test_mapping(spark):
    df = spark.createDataFrame([(("n", None), None), (("m", 2), ("b",))], "goods struct<name:string,n:int>, local struct<code:string>")
    b = Binding(["goods", "local"], [F.col("goods"), F.col("local")])
    rows = df.select(b.read("name").alias("a"), b.read(Field("local:code", "code")).alias("b"), b.write("goods:n", F.lit(None).cast("int")).alias("c"), b.write("goods:n", F.lit(None).cast("int"), "set").alias("d")).collect()
    assert [(r.a, r.b and r.b.code, r.c.n, r.d.n) for r in rows] == [("n", None, None, None), ("m", "b", 2, None)]
    poly = b.read(PolyFields({"N": "goods:n", "L": "local:code"}, {"v": Poly(by_type={"N": "goods:name", "L": "local:code"})}))
    assert df.where("local IS NOT NULL").select(poly.alias("p")).first().p == ("L", "b")
    for bad in (df.select(b.read(Fields({"x": "goods:n"}))), df.select(poly), df.select(b.write("local:code", F.lit("x")))):
        with pytest.raises(Exception, match="is null|no candidate|nothing to set"):
            bad.collect()
    with pytest.raises(NotImplementedError):
        b.write(Fields({}), F.lit(1))


def test_choice_takes_the_last(spark):
    c = [F.lit("a"), F.lit(None).cast("string"), F.lit("c"), F.lit(None).cast("string")]
    assert spark.range(1).select(last_non_null(c, ["1", "2", "3", "4"])).first()[0] == "3"


def test_closure_equals_search(spark):
    edges = [(i, (i * 7 + k) % 40) for i in range(40) for k in (1, 12) if i % 3]
    got = {}
    for r in callgraph.closure(spark.createDataFrame(edges, "caller long, callee long"), spark.createDataFrame([(1,), (3,), (99,)], "root long")).collect():
        got.setdefault(r.root, set()).add(r.node)
    for root in (1, 3, 99):
        seen, todo = {root}, [root]
        while todo:
            x = todo.pop()
            new = {b for a, b in edges if a == x} - seen
            seen |= new
            todo += new
        assert got[root] == seen


def test_edges_and_frames(spark):
    rows = [("m", 0, "CALL", "C", "a", "()V", None, None, None), ("m", 1, "INDY", "C", "h1", "()V", callgraph.METAFACTORY_OWNER, "metafactory", 6), ("m", 2, "INDY", "C", "h2", "()V", callgraph.METAFACTORY_OWNER, "metafactory", 6), ("m", 3, "INDY", "C", "new", "()V", callgraph.METAFACTORY_OWNER, "metafactory", 8)]
    insns = spark.createDataFrame(rows, "caller string, insn_ord int, kind string, owner string, name string, descriptor string, bootstrap_owner string, bootstrap_name string, handle_tag int")
    names = lambda last: sorted(r.callee.name for r in callgraph.edges(insns, last).collect())
    assert names(False) == ["a", "h1", "h2"] and names(True) == ["a", "h2"]
    f = spark.createDataFrame([(["t", "me", "x.Proxy$1", "java.X", None, "com.java.App"],), (["a", "b"],)], "f array<string>")
    assert [r[0] for r in f.select(callgraph.first_frame(F.col("f"), ["java."], ["Proxy"])).collect()] == ["com.java.App", None]


def test_nested_and_missing(spark):
    root = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    child = spark.createDataFrame([(1, "y"), (1, "x")], "root long, v string")
    got = {r.id: [c.v for c in r.kids] for r in hydrate.nested(root, child, "id", "root", "kids").collect()}
    assert got == {1: ["x", "y"], 2: []}
    with pytest.raises(Exception, match="not found"):
        hydrate.assert_found(root, spark.createDataFrame([(3,)], "id long"), "id").collect()
