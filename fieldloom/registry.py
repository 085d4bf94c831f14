"""Queries of the engine's own operators and their SQL, by name."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions import defaults, lists
from fieldloom.functions import entry as entry_forms
from fieldloom.functions.choice import column_for, last_or_null
from fieldloom.functions.naming import accessor_kind, accessor_property, is_blank, joined, method_text
from fieldloom.operators import bags, callgraph, hydrate, members, orders
from fieldloom.operators.changes import adding_all, clearing, replay
from fieldloom.operators.mapping import Binding, declared, Field, Fields, ListFields, Poly, PolyFields, PolyListFields
from fieldloom.operators.property_access import classes_report, facts, methods_report
from fieldloom.plans import analysis, fetch, report
from fieldloom.plans.checkpoints import checkpoint, ensure_checkpoint_dir, large
from fieldloom.sources import classfile, scan
from fieldloom.sources.assemble import class_file
from fieldloom.sources.store import EntityOperator, ParquetStore, Schemas, spread

ROLE = "Lexample/AggregateRoot;"
METAFACTORY = callgraph.METAFACTORY_OWNER
# Facts made of the tables, by expressions that mean the same in Spark and in the SQL below.
#: Parts as classes, some of them aggregates.
CLASSES = ["p_partkey AS class_id", "'shop.P' || CAST(p_partkey AS STRING) AS class_name", f"CASE WHEN p_size > 10 THEN '{ROLE}' ELSE 'Lexample/Other;' END AS role"]
_NAME = "CASE l_suppkey % 9 WHEN 0 THEN 'getStock' WHEN 1 THEN 'isOpen' WHEN 2 THEN 'setPrice' WHEN 3 THEN '<init>' WHEN 4 THEN 'recalc' WHEN 5 THEN 'get' WHEN 6 THEN 'total' WHEN 7 THEN 'issue' ELSE 'items' END"
_OPCODE = "CASE l_returnflag WHEN 'N' THEN 182 WHEN 'A' THEN 180 ELSE CASE WHEN l_quantity < 45 THEN 181 ELSE 178 END END"
_OWNER = "CASE WHEN l_discount < 0.08 THEN 'shop.P' || CAST(l_partkey AS STRING) ELSE 'shop.Other' END"
_DESCRIPTOR = "CASE WHEN l_tax < 0.04 THEN '()V' ELSE '(I)V' END"
_KIND_OF = "CASE l_returnflag WHEN 'N' THEN 'CALL' ELSE 'FIELD' END"
#: Lines as instructions of the part's methods.
INSNS = ["l_partkey AS class_id", "l_linenumber AS method_ord", "l_suppkey AS caller", f"{_KIND_OF} AS kind", f"{_OPCODE} AS opcode", f"{_OWNER} AS owner", f"{_NAME} AS name", f"{_DESCRIPTOR} AS descriptor"]
#: Lines as calls and lambdas of the order's method; equal places have equal targets.
LAMBDAS = [
    "l_orderkey AS caller", "l_partkey * 100000 + l_suppkey AS insn_ord", "CASE WHEN l_linenumber % 3 = 0 THEN 'CALL' ELSE 'INDY' END AS kind", "'shop.O' AS owner", "'h' || CAST(l_partkey AS STRING) AS name", "'()V' AS descriptor",
    f"CASE WHEN l_discount < 0.07 THEN '{METAFACTORY}' ELSE 'other.Bootstrap' END AS bootstrap_owner", "CASE WHEN l_tax < 0.03 THEN 'metafactory' WHEN l_tax < 0.06 THEN 'altMetafactory' ELSE 'concat' END AS bootstrap_name", "CASE l_returnflag WHEN 'A' THEN 6 WHEN 'N' THEN 8 ELSE 9 END AS handle_tag",
]
#: Customers as nodes: a heap, and ways back.
DOWN = ["CAST(floor(c_custkey / 2) AS BIGINT) AS caller", "c_custkey AS callee"]
BACK = ["c_custkey AS caller", "CAST(floor(c_custkey / 3) AS BIGINT) AS callee"]
#: A class's parents in order: two that meet again above, and for some one below, which makes a cycle.
PARENTS = ["CAST(floor(c_custkey / 2) AS BIGINT)", "CAST(floor(c_custkey / 3) AS BIGINT)", "CASE WHEN c_nationkey = 3 THEN 2 * c_custkey END"]
ACCESSORS = ["p_partkey", "CASE p_size % 7 WHEN 0 THEN 'get' WHEN 1 THEN 'is' WHEN 2 THEN 'set' WHEN 3 THEN 'issue' WHEN 4 THEN 'other' WHEN 5 THEN '<init>' ELSE 'getaway' END || CASE WHEN p_partkey % 5 = 0 OR p_size % 7 = 5 THEN '' ELSE replace(p_brand, '#', '') END AS name"]
#: Class names of frames: proxies and platform classes, and names that only contain a platform prefix.
FRAME_NAME = "CASE event_type WHEN 'click' THEN 'x.Proxy$1' WHEN 'view' THEN 'java.lang.Thread' WHEN 'error' THEN 'org.springframework.X' WHEN 'signup' THEN 'com.java.App' ELSE 'app.' || event_type END"
LINES = ["l_suppkey AS cls", "l_returnflag AS name", "l_linenumber AS method_ord", "l_partkey AS line"]
FRAMES = ["o_orderkey", "o_custkey AS cls", "CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS name", "o_orderkey % 2500 AS line"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def hydrate_by_key(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    p = _t(spark, d, "part").select("p_partkey", "p_name")
    return hydrate.flat(o, li, F.col("o_orderkey") == F.col("l_orderkey"), p, F.col("l_partkey") == F.col("p_partkey")).select("o_orderkey", "o_orderstatus", "l_linenumber", "l_quantity", "p_name")


def _lines(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("decimal(18,2)").alias("quantity"), F.col("l_extendedprice").cast("decimal(18,2)").alias("unit_price"), "l_linenumber")


def _items(spark, d):
    return hydrate.nested(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), _lines(spark, d), "o_orderkey", "l_orderkey", "items")


def element_sum(spark, d):
    totals = orders.totals(_lines(spark, d), "l_orderkey")
    o = _t(spark, d, "orders").select("o_orderkey")
    return o.join(totals, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("total", F.lit(0)).cast("decimal(38,4)").alias("total"))


def poly_choice(spark, d):
    e = _t(spark, d, "events")
    c = [F.when(F.col("event_type") == "click", F.col("value")), F.when(F.col("value") > 50, F.col("value")), F.when(F.col("event_type") != "view", F.col("value") * 2)]
    types = ["click", "large", "other"]
    chosen = e.select("event_id", last_or_null(c, types).alias("type"), *(x.alias(t) for x, t in zip(c, types, strict=True)))
    return chosen.select("event_id", "type", column_for(F.col("type"), types, [F.col(t) for t in types]).alias("chosen"))


def accessor_inference(spark, d):
    n = F.col("name")
    return _t(spark, d, "part").selectExpr(*ACCESSORS).select("p_partkey", "name", accessor_kind(n).alias("kind"), accessor_property(n).alias("property"))


def _calls(spark, d):
    c = _t(spark, d, "customer")
    return c.selectExpr(*DOWN).unionByName(c.where("c_acctbal < 0").selectExpr(*BACK))


def call_closure(spark, d):
    return callgraph.closure(_calls(spark, d), _t(spark, d, "region").selectExpr("CAST(r_regionkey + 1 AS BIGINT) AS root"))


def call_tree(spark, d):
    n, c = _t(spark, d, "nation"), _t(spark, d, "customer")
    edge = n.selectExpr("concat('r', n_regionkey) AS caller", "concat('n', n_nationkey) AS callee").unionByName(c.selectExpr("concat('n', c_nationkey) AS caller", "concat('c', c_custkey) AS callee"))
    edge = edge.unionByName(c.where("c_acctbal < 0").selectExpr("concat('c', c_custkey) AS caller", "concat('c', CAST(floor(c_custkey / 2) AS BIGINT)) AS callee")).unionByName(c.selectExpr("concat('c', c_custkey) AS caller", "concat('n', c_nationkey) AS callee").where("caller LIKE '%7'").selectExpr("caller", "caller AS callee"))
    return callgraph.call_paths(edge, _t(spark, d, "region").selectExpr("concat('r', r_regionkey) AS root")).select(F.array_join("path", "/").alias("path"), "node")


def call_tree_text(spark, d):
    paths = call_tree(spark, d).select(F.split("path", "/").alias("path"))
    return report.tree_lines(paths).select("value")


def frame_resolve(spark, d):
    return callgraph.resolve_frames(_t(spark, d, "orders").selectExpr(*FRAMES), _t(spark, d, "lineitem").selectExpr(*LINES), ["cls", "name"])


def _classes(spark, d):
    return _t(spark, d, "part").selectExpr(*CLASSES).select("class_id", "class_name", F.array("role").alias("annotations"))


def property_access_rows(spark, d):
    return facts(_classes(spark, d), _t(spark, d, "lineitem").selectExpr(*INSNS), [ROLE])


def lambda_last_edge(spark, d):
    found = callgraph.edges(_t(spark, d, "lineitem").selectExpr(*LAMBDAS), last_lambda_only=True)
    return found.where("kind = 'lambda'").select("caller", F.col("callee.name").alias("target"))


def edge_extract(spark, d):
    return callgraph.edges(_t(spark, d, "lineitem").selectExpr(*LAMBDAS)).select("caller", "callee.owner", "callee.name", "kind")


def declared_calls(spark, d):
    called = _t(spark, d, "lineitem").selectExpr(*INSNS).where("kind = 'CALL'").select("owner", "name", "descriptor")
    declared = _t(spark, d, "part").selectExpr("'shop.P' || CAST(p_partkey AS STRING) AS owner", "CASE p_size % 3 WHEN 0 THEN 'recalc' WHEN 1 THEN 'total' ELSE 'items' END AS name", "'()V' AS descriptor")
    return callgraph.direct_calls(called, declared)


def fetch_plan(spark, d):
    return callgraph.fetch_plan(call_closure(spark, d), _t(spark, d, "lineitem").selectExpr(*INSNS), _classes(spark, d), [ROLE])


def _bound(spark, d):
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    both = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return both.select("o_orderkey", F.struct("o_orderstatus", F.struct("o_orderpriority", "o_totalprice").alias("detail")).alias("order"), F.struct("c_name", "c_mktsegment").alias("customer"))


def mapped_path(spark, d):
    b = Binding(["order", "customer"], [F.col("order"), F.col("customer")])
    whole = b.read(Fields({"name": "customer:c_name", "segment": "a1:c_mktsegment"}))
    new = b.write("order:detail.o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, F.lit("NONE")))
    df = _bound(spark, d).select("o_orderkey", b.read("o_orderstatus").alias("status"), b.read(Field("order:detail.o_totalprice")).alias("price"), whole.alias("w"), new.alias("changed"))
    return df.select("o_orderkey", "status", "price", "w.name", "w.segment", F.col("changed.detail.o_orderpriority").alias("priority"))


def _lists(spark, d):
    return _items(spark, d).select("o_orderkey", F.struct("o_orderstatus", "items").alias("order"))


def entity_ops(spark, d):
    """Entities of a class by its schemas, a value wrapped by its domain type, and lists changed through the adapter."""
    schemas = Schemas({"shop.Order": {"order": T.StructType().add("id", "long").add("tags", T.ArrayType(T.StringType())), "place": T.StructType().add("code", "string")}})
    op, e = EntityOperator(), F.col("order")
    df = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", *schemas.create("shop.Order"))
    df = df.withColumn("order", op.set(op.set(e, "id", F.col("o_orderkey")), "tags", F.array("o_orderpriority", "o_orderstatus", "o_orderpriority")))
    df = df.withColumn("order", op.add(e, "tags", F.lit("end"))).withColumn("order", op.add_at(e, "tags", F.lit(1), F.lit("new"))).withColumn("order", op.remove(e, "tags", F.col("o_orderpriority")))
    b, money = Binding(["order", "place"], [e, F.col("place")]), T.StructType().add("number", "long")
    return df.select("o_orderkey", F.array_join(op.get(e, "tags"), ",").alias("tags"), b.read(declared(money, "order:id")).alias("w"), b.read(declared(T.LongType(), "order:id")).alias("id"), b.read(declared(T.StringType(), "place:code")).alias("code")).select("o_orderkey", "tags", "w.number", "id", "code")


def list_map(spark, d):
    b = Binding(["order"], [F.col("order")])
    df = _lists(spark, d).select("o_orderkey", F.explode(b.read(ListFields("order:items", {"product": "base:product_id", "quantity": "base:quantity", "status": "order:o_orderstatus"}))).alias("x"))
    return df.select("o_orderkey", "x.*")


def poly_list_map(spark, d):
    items = F.transform(F.col("order.items"), lambda x: F.struct(x["product_id"].alias("id"), F.when(x["quantity"] < 30, x["quantity"]).alias("few"), F.when(x["quantity"] > 20, x["quantity"] * 10).alias("many")))
    df = _lists(spark, d).select("o_orderkey", F.struct(items.alias("items")).alias("order"))
    m = PolyListFields("order:items", {"Few": "base:few", "Many": "base:many"}, {"id": Poly("base:id"), "amount": Poly(by_type={"Few": "base:few", "Many": "base:many"})})
    return df.select("o_orderkey", F.explode(Binding(["order"], [F.col("order")]).read(m)).alias("x")).select("o_orderkey", "x.id", "x.type", F.col("x.amount").cast("decimal(18,2)").alias("amount"))


def _types_by_user(spark, d):
    e = _t(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    return e.select("user_id", F.transform("e", lambda x: x["event_type"]).alias("xs"))


def list_remove_first(spark, d):
    return _types_by_user(spark, d).select("user_id", F.array_join(lists.remove_first(F.col("xs"), F.lit("click")), ",").alias("left"))


def retain_all(spark, d):
    return _types_by_user(spark, d).select("user_id", F.array_join(lists.retain_all(F.col("xs"), F.array(F.lit("click"), F.lit("view"))), ",").alias("kept"))


def list_replay(spark, d):
    users = _types_by_user(spark, d).select("user_id", F.col("xs").alias("items"))
    change = lambda seq, op, pos, value: F.struct(F.lit(seq).alias("seq"), F.lit(op).alias("op"), F.lit(pos).cast("int").alias("pos"), F.lit(value).cast("string").alias("value"))
    log = users.select("user_id", F.explode(F.array(change(1, "INSERT", 0, "new"), change(2, "INSERT", None, "end"), change(3, "DELETE", 1, None), change(4, "REPLACE", 0, "first"))).alias("c")).select("user_id", "c.*")
    return replay(users, log, "user_id").select("user_id", F.array_join("items", ",").alias("items"))


def upsert_replace(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    changed = o.where("o_orderstatus = 'P'")
    delta = changed.select("o_orderkey", F.lit("S").alias("o_orderstatus")).unionByName(changed.select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("N").alias("o_orderstatus")))
    children = delta.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(9.0).alias("l_quantity"))
    roots, kids = hydrate.save(o, delta, "o_orderkey"), hydrate.replace_children(li, children, children, "l_orderkey")
    n = kids.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(18,2)").alias("quantity"))
    return roots.join(n, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "quantity")


def store_save(spark, d):
    """The same save through a store: two tables are written and changed by one store object and read by another."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    o, li = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    writer = ParquetStore(spark, folder)
    writer.write("orders", o)
    writer.write("lines", li)
    changed = o.where("o_orderstatus = 'P'")
    delta = changed.select("o_orderkey", F.lit("S").alias("o_orderstatus")).unionByName(changed.select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("N").alias("o_orderstatus")))
    children = delta.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(9.0).alias("l_quantity"))
    writer.save("orders", delta, "o_orderkey")
    writer.save_children("lines", children, children, "l_orderkey")
    reader = ParquetStore(spark, folder)
    lines = spread(reader.read("lines"), reader.rows("lines"), "l_orderkey")
    n = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(18,2)").alias("quantity"))
    return reader.read("orders").join(n, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "quantity")


def status_transition(spark, d):
    s = F.expr("CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'CONFIRMED' ELSE 'SHIPPED' END")
    df = _items(spark, d).select("o_orderkey", s.alias("status"), "items")
    st = F.col("status")
    return df.select("o_orderkey", orders.confirm(st, F.col("items")).alias("confirmed"), orders.ship(st).alias("shipped"), orders.cancel(st).alias("cancelled"), orders.can_modify(st).alias("can_modify"))


def validate_rows(spark, d):
    c = _t(spark, d, "customer")
    name, email = F.when(F.col("c_custkey") % 7 == 0, F.lit(" \t")).when(F.col("c_custkey") % 11 != 0, F.col("c_name")), F.when(F.col("c_custkey") % 5 == 0, F.lit("none")).otherwise(F.concat(F.lit("u@"), F.col("c_mktsegment")))
    return c.select("c_custkey", is_blank(name).alias("blank"), orders.valid_user(F.col("c_custkey").cast("string"), name, email, F.col("c_acctbal")).alias("valid"))


# --- class files -------------------------------------------------------------------------------


def _assembled(it):
    """A class file, or a jar of one, for each customer; some are cut short."""
    for pdf in it:
        out = []
        for k, nation, segment in zip(pdf["c_custkey"].tolist(), pdf["c_nationkey"].tolist(), pdf["c_mktsegment"], strict=True):
            own = f"shop.C{k}"
            update = [("getfield", own, "balance", "D"), *[("invokevirtual", own, "recalc", "()V")] * (nation % 4), ("putfield", own, "status", "I"), ("getfield", "shop.Other", "x", "I"), ("getstatic", own, "LOG", "I")]
            recalc = [("getfield", own, "total", "D"), *[("invokevirtual", own, "audit", "()V")] * (nation % 3 == 0)]
            methods = [("update", "()V", update), ("recalc", "()V", recalc), ("audit", "()V", [("getfield", own, "log", "I")]), ("getName", "()V", [("getfield", own, "name", "I")]), ("idle", "()V", [("getfield", "shop.Other", "x", "I")])]
            b = class_file(own, methods, (ROLE if nation % 2 == 0 else "Lexample/Other;",))
            b = b[:40] if segment == "MACHINERY" else b
            if nation % 5 == 0:
                packed = io.BytesIO()
                with zipfile.ZipFile(packed, "w") as z:
                    z.writestr(f"shop/C{k}.class", b)
                    z.writestr("META-INF/x.txt", "x")
                b = packed.getvalue()
            out.append((f"c{k}{'.jar' if nation % 5 == 0 else '.class'}", b))
        yield pd.DataFrame(out, columns=["path", "content"])


#: Classes that one task makes, reads and reports, so that tasks grow in number with the table and not in size.
TASK_CLASSES = 20_000


def _class_tasks(spark, d) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-_t(spark, d, "customer").count() // TASK_CLASSES))


def _customers(spark, d):
    """Customers dealt to all cores: the table is one small file, and making and reading class files takes longer than moving rows."""
    return _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").repartition(_class_tasks(spark, d))


def _class_tables(spark, d):
    """Facts are dealt by class, to a number of tasks that follows the table, so what goes by class is not shuffled again."""
    files, n = _customers(spark, d).mapInPandas(_assembled, "path string, content binary"), _class_tasks(spark, d)
    return {name: t.repartition(n, "class_id") for name, t in classfile.tables(checkpoint(classfile.from_bytes(files))).items()}


def class_facts(spark, d):
    t = _class_tables(spark, d)
    rows = methods_report(t["classes"], t["methods"], t["insns"], [ROLE]).join(large(t["classes"].select("class_id", "class_name")), "class_id")
    calls = F.transform("calls", lambda x: F.concat(x["method_name"], x["method_desc"], F.lit("*"), x["call_count"].cast("string")))
    return rows.select("class_name", method_text(F.lit(""), F.col("method_name"), F.col("method_desc")).alias("method"), joined(F.col("reads")).alias("reads"), joined(F.col("writes")).alias("writes"), joined(calls).alias("calls"))


def class_scan(spark, d):
    """Customers' classes, written as jars by tasks, and scanned again by runs of entries."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"

    def write(it):
        path = f"{folder}/{TaskContext.get().partitionId()}.jar"
        with scan.create(path) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for pdf in it:
                for k, segment in zip(pdf["c_custkey"].tolist(), pdf["c_mktsegment"], strict=True):
                    b = class_file(f"shop.C{k}", [("update", "()V", [("getfield", f"shop.C{k}", "balance", "D")])] * (k % 3), (), f"shop.C{k // 2}")
                    z.writestr(f"shop/C{k}.class", b[:40] if segment == "MACHINERY" else b)
        yield pd.DataFrame({"path": [path]})

    written = _customers(spark, d).mapInPandas(write, "path string").collect()
    found = scan.read(spark, *(r.path for r in written), columns=["entry_name", "class_name", "super_name", "methods", "corrupt"])
    return found.select("entry_name", "class_name", "super_name", F.size("methods").alias("n_methods"), F.col("corrupt").isNotNull().alias("corrupt"))


def _built(spark, d):
    """A project folder with the customers' class files in its build folder, a folder of lists of the paths of their jars, both written by tasks, and each list's first jar."""
    ensure_checkpoint_dir(spark)
    project = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"

    def write(it):
        jars = []
        for pdf in it:
            paths = [f"{project}/{analysis.BUILD_FOLDERS[1] if p.endswith('.class') else 'lib'}/{p}" for p in pdf["path"]]
            for path, content in zip(paths, pdf["content"], strict=True):
                with scan.create(path) as f:
                    f.write(bytes(content))
            jars += [p for p in paths if p.endswith(".jar")]
        scan.write_list(f"{project}/lists/{TaskContext.get().partitionId()}", jars)
        yield pd.DataFrame({"path": jars[:1]})

    files = _customers(spark, d).mapInPandas(_assembled, "path string, content binary")
    firsts = [r.path for r in files.mapInPandas(write, "path string").collect()]
    return project, f"{project}/lists", firsts


def build_scan(spark, d):
    """The whole analysis of a project by its build folder."""
    project, _, _ = _built(spark, d)
    return analysis.analyse(spark, project).select("class_name", F.size("methods").alias("n_methods"))


def path_dispatch(spark, d):
    """Folders, class files, jars and files of other kinds in one list of paths; a path that is given twice counts twice."""
    project, lists, firsts = _built(spark, d)
    folder = f"{project}/{analysis.BUILD_FOLDERS[1]}"
    found = scan.read(spark, folder, *firsts[:1], columns=["source_path", "entry_name", "class_name", "corrupt"], listed=lists)
    kind = F.when(F.col("source_path").endswith(".jar"), "jar").otherwise("file")
    return found.groupBy(kind.alias("kind"), F.col("entry_name") != "").agg(F.count_distinct("source_path").alias("n"), F.count_distinct("class_name").alias("classes")).select("kind", "n", "classes")


def class_by_name(spark, d):
    """Nations' numbers as class names, looked for in the build folder by a filter that reaches the scan."""
    project, lists, _ = _built(spark, d)
    names = [f"shop/C{r.n_nationkey}" for r in _t(spark, d, "nation").select("n_nationkey").collect()]
    return scan.find(spark, [f"{project}/{analysis.BUILD_FOLDERS[1]}"], *names, columns=["class_name", "super_name", "annotations"], listed=lists).select("class_name", "super_name", joined(F.col("annotations")).alias("roles"))


def method_report(spark, d):
    t = _class_tables(spark, d)
    return report.text_of(classes_report(t["classes"], t["methods"], t["insns"], [ROLE]))


def _reported(spark, d, form, parts):
    ensure_checkpoint_dir(spark)
    t, path = _class_tables(spark, d), f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    report.write(classes_report(t["classes"], t["methods"], t["insns"], [ROLE]), path, form, parts)
    return path


def report_text(spark, d):
    """The lines of the text report, from the folder of files that they were written to."""
    return report.read_lines(spark, _reported(spark, d, "TXT", True)).select("value")


def report_json(spark, d):
    """The JSON report's objects, from the one file that it was written to."""
    found = spark.read.option("multiLine", "true").schema("class_name string, is_aggregate_root boolean, methods array<struct<method_name:string,reads:array<string>>>").json(_reported(spark, d, "JSON", False))
    return found.select("class_name", "is_aggregate_root", F.explode("methods").alias("m")).select("class_name", "is_aggregate_root", "m.method_name", joined(F.col("m.reads")).alias("reads"))


def caller_fetch(spark, d):
    t = _class_tables(spark, d)
    frames = _t(spark, d, "customer").select(F.concat(F.lit("shop.C"), F.col("c_custkey").cast("string")).alias("class_name"), F.lit("update").alias("method_name"), F.lit(1).alias("line"))
    return fetch.caller_fields(frames, t["methods"], t["lines"], t["insns"], t["classes"], [ROLE])


def entity_by_frame(spark, d):
    plan = caller_fetch(spark, d).select(F.lit("shop.Customer").alias("owner"), "field")
    return fetch.load(_t(spark, d, "customer"), "c_custkey", plan, "shop.Customer", {"total": "c_acctbal", "log": "c_mktsegment", "name": "c_name", "balance": "c_nationkey"})


# --- methods and frames ----------------------------------------------------------------------------


def find_inherited(spark, d):
    c = _t(spark, d, "customer")
    name = lambda k: F.concat(F.lit("m"), (k % 5).cast("string"))
    cls = lambda k: F.concat(F.lit("C"), k.cast("string"))
    key = F.col("c_custkey")
    wanted = c.select(cls(key).alias("class_name"), name(F.col("c_nationkey")).alias("name"), F.lit("()V").alias("descriptor"))
    declared = c.select(cls(key).alias("class_name"), name(key).alias("name"), F.lit("()V").alias("descriptor"), (key % 3).cast("int").alias("access"))
    parents = c.selectExpr("c_custkey", f"inline(array({', '.join(f'struct({up} AS up, {i} AS ord)' for i, up in enumerate(PARENTS))}))").where("up IS NOT NULL")
    return callgraph.find_methods(wanted, declared, parents.select(cls(key).alias("class_name"), cls(F.col("up")).alias("super_name"), "ord"))


def entry_keys(spark, d):
    e = _t(spark, d, "events")
    kind = F.concat(F.lit("shop."), F.col("event_type"))
    params = F.when(F.col("event_type") == "click", F.array(F.lit("int"), F.lit("java.lang.String[]"))).when(F.col("event_type") == "view", F.array(F.lit("long[][]"))).otherwise(F.array().cast("array<string>"))
    text = lambda k: method_text(k["owner"], k["name"], k["descriptor"])
    return e.select("event_id", text(entry_forms.reflected_key(kind, F.lit("run"), params, F.lit("void"))).alias("reflected"), text(entry_forms.lambda_key(F.translate(kind, ".", "/"), F.lit("lambda$0"), F.lit("()V"))).alias("lambda"))


def first_frames(spark, d):
    name = F.expr(FRAME_NAME)
    e = _t(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", name.alias("frame")))).alias("e"))
    return e.select("user_id", callgraph.first_frame(F.transform("e", lambda x: x["frame"]), ["java.", "org.springframework."], ["Proxy$"]).alias("frame"))


# --- lists, members, entities -------------------------------------------------------------------------


def list_ops(spark, d):
    xs, two, n = F.col("xs"), F.array(F.lit("click"), F.lit("view")), lambda k: F.lit(k)
    out = {"removed": lists.remove_all(xs, two), "replaced": lists.set_at(xs, n(1), n("new")), "part": lists.sub_list(xs, n(0), F.least(n(3), F.size(xs))), "inserted": lists.add_all_at(xs, n(1), two), "longer": lists.add(lists.add_all(xs, two), n("end")), "cleared": lists.clear(xs)}
    place = F.sequence(n(0), F.size(xs) - 1)
    return _types_by_user(spark, d).select("user_id", *(F.array_join(c, ",").alias(k) for k, c in out.items()), lists.index_of(xs, n("view")).alias("first"), lists.last_index_of(xs, n("view")).alias("last"), lists.contains_all(xs, two).alias("both"), lists.paired(xs, place, n("error")).alias("pair"))


def list_nulls(spark, d):
    """Lists with null elements, and null as an argument."""
    e = _t(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", F.expr("nullif(event_type, 'error')").alias("t")))).alias("e"))
    xs, none = F.col("xs"), F.lit(None).cast("string")
    two = F.array(none, F.lit("click"))
    said = lambda c: F.array_join(c, ",", "-")
    return e.select("user_id", F.transform("e", lambda x: x["t"]).alias("xs")).select(
        "user_id", said(lists.remove_first(xs, none)).alias("without"), said(lists.remove_all(xs, two)).alias("removed"), said(lists.retain_all(xs, two)).alias("retained"), lists.index_of(xs, none).alias("first"), lists.last_index_of(xs, none).alias("last"), lists.contains_all(xs, two).alias("both"),
    )


def list_bags(spark, d):
    """Each user's event types, null for errors, without one occurrence for each event of a large value; and those of the types that have a large one."""
    e = _t(spark, d, "events").select("user_id", "event_id", "value", F.expr("nullif(event_type, 'error')").alias("t"))
    users = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "t"))).alias("e")).select("user_id", F.transform("e", lambda x: x["t"]).alias("items"))
    large = e.where("value > 50").select("user_id", F.col("t").alias("value"))
    said = F.array_join("items", ",", "-")
    kept = bags.retain_all(users, large, "user_id").select("user_id", said.alias("kept"))
    return bags.remove_all(users, large, "user_id").select("user_id", said.alias("removed")).join(kept, "user_id")


def list_clear_refill(spark, d):
    users = _types_by_user(spark, d).select("user_id", F.col("xs").alias("items"))
    new = users.select("user_id", F.slice("items", 1, 2).alias("values"), F.lit(0).alias("at"))
    log = clearing(users, "user_id", 0).unionByName(adding_all(new, "user_id", 1_000_000, None, "values")).unionByName(adding_all(new, "user_id", 2_000_000, "at", "values"))
    return replay(users, log, "user_id").select("user_id", F.array_join("items", ",").alias("items"))


def list_listener(spark, d):
    o = _t(spark, d, "orders")
    row = F.struct(F.col("o_totalprice").alias("price"), F.struct(F.lit(None).cast("string").alias("name")).alias("detail"), F.lit(None).cast("long").alias("customer"))
    bound = o.where("o_orderstatus <> 'P'").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", row).alias("row"), F.struct(F.col("o_orderpriority").alias("name")).alias("detail"), F.col("o_custkey").alias("customer"))
    found = members.member_rows(o.select("o_orderkey"), bound, "o_orderkey", ["base:", "base:customer", "outer:x", "base:detail"], ["row", "customer", "row", "detail"], bound.schema["row"].dataType)
    return found.select("o_orderkey", "created", F.col("member.price").alias("price"), F.col("member.detail.name").alias("name"), F.col("member.customer").alias("customer"))


def poly_field(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.struct(F.when(F.col("o_orderpriority").startswith("1"), F.col("o_totalprice")).alias("urgent"), F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")).alias("large"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("plain"), F.col("o_totalprice").alias("price")).alias("order"))
    m = PolyFields({"Urgent": "order:urgent", "Large": "order:large", "Plain": "order:plain"}, {"price": Poly("order:price"), "amount": Poly(by_type={"Urgent": "order:urgent", "Large": "order:large", "Plain": "order:plain"})}, last_or_null)
    return o.select("o_orderkey", Binding(["order"], [F.col("order")]).read(m).alias("x")).select("o_orderkey", "x.*")


def new_entities(spark, d):
    schemas = {"goods": T.StructType().add("id", "long").add("name", "string"), "address": T.StructType().add("detail", "string").add("place", T.StructType().add("code", "string"))}
    made = members.construct(schemas, goods={"name": F.col("n_name"), "id": F.col("n_nationkey").cast("long")})
    n = _t(spark, d, "nation").select("n_regionkey", *made)
    b = Binding(["goods", "address"], [F.col("goods"), F.col("address")])
    return n.select("n_regionkey", b.read("goods:id").alias("id"), b.read("name").alias("name"), b.read("address:detail").alias("detail"), b.read("a1:place.code").alias("code"))


# --- the sample domain ----------------------------------------------------------------------------------


def order_items(spark, d):
    o = _items(spark, d).withColumn("items", F.transform("items", lambda x: x.withField("product_id", F.when(x["product_id"] % 7 != 0, x["product_id"]))))
    items = F.col("items")
    item = F.struct(F.lit(0).cast("long").alias("product_id"), F.lit(2).cast("decimal(18,2)").alias("quantity"), F.lit(5).cast("decimal(18,2)").alias("unit_price"), F.lit(0).alias("l_linenumber"))
    more, less = orders.add_item(items, item.cast(o.schema["items"].dataType.elementType)), orders.remove_item(items, F.col("o_orderkey") % 50)
    said = orders.order_summary(F.col("o_orderkey"), F.col("o_orderstatus"), orders.total(more), F.lit("PENDING"), more)
    return o.select("o_orderkey", said.alias("said"), orders.total(less).alias("total"), F.size(less).cast("long").alias("n"))


def stock(spark, d):
    s, want = F.col("p_size"), F.lit(20)
    price = orders.update_price(F.col("p_retailprice"), F.col("p_retailprice") * 2)
    return _t(spark, d, "part").select("p_partkey", orders.has_stock(s).alias("some"), orders.has_enough_stock(s, want).alias("enough"), orders.reduce_stock(s, want).alias("reduced"), orders.add_stock(s, want).alias("added"), price.alias("price"))


def user_updates(spark, d):
    c = _t(spark, d, "customer")
    active, age = F.col("c_acctbal") > 0, F.col("c_nationkey")
    name, email = orders.update_profile(F.col("c_name"), F.col("c_mktsegment"), F.when(age > 12, F.lit("new")).otherwise(F.col("c_name")), F.lit("u@x"))
    return c.select("c_custkey", name.alias("name"), email.alias("email"), orders.increment_age(age).alias("age"), orders.activate(active).alias("on"), orders.deactivate(active).alias("off"), orders.user_summary(F.col("c_custkey"), name, email, age, active).alias("said"))


def stamped(spark, d):
    o, now = _t(spark, d, "orders"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    given = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    number = defaults.snowflake(F.lit(defaults.EPOCH_MS) + F.col("o_custkey"), F.col("o_orderkey") % 4096)
    return o.select("o_orderkey", defaults.updated_at(given, now).alias("updated"), defaults.created_at(given, F.col("o_orderpriority") > "3", now).alias("created"), number.alias("number"))


def snowflake_ids(spark, d):
    """Orders of three milliseconds: more than a millisecond has numbers for, on larger tables."""
    o = _t(spark, d, "orders").select("o_orderkey", (F.lit(defaults.EPOCH_MS) + F.col("o_custkey") % 3).alias("ms"))
    return defaults.numbered(o, "ms", ["o_orderkey"]).select("o_orderkey", "number")


def nested_fetch(spark, d):
    """Orders stored with their lines, read again with the fields that a plan names: of all others, none is in the scan's schema."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    _bound(spark, d).select("o_orderkey", "order", "customer").join(_items(spark, d).select("o_orderkey", "items"), "o_orderkey").write.parquet(folder)
    plan = _t(spark, d, "region").selectExpr("'shop.Order' AS owner", "CASE r_regionkey WHEN 0 THEN 'price' WHEN 1 THEN 'products' WHEN 2 THEN 'quantities' WHEN 3 THEN 'customer' ELSE 'other' END AS field")
    mapping = {"price": "order.detail.o_totalprice", "status": "order.o_orderstatus", "products": "items.product_id", "quantities": "items.quantity", "lines": "items.l_linenumber", "customer": "customer.c_name"}
    found = fetch.load(spark.read.parquet(folder), "o_orderkey", plan, "shop.Order", mapping)
    return found.select("o_orderkey", "order.detail.o_totalprice", "customer.c_name", F.explode_outer("items").alias("i")).select("o_orderkey", "o_totalprice", "c_name", "i.product_id", "i.quantity")


_NAMES = (
    hydrate_by_key, element_sum, poly_choice, accessor_inference, call_closure, call_tree, call_tree_text, frame_resolve, property_access_rows, lambda_last_edge, fetch_plan,
    mapped_path, entity_ops, list_map, poly_list_map, list_remove_first, retain_all, list_replay, upsert_replace, store_save, status_transition, validate_rows,
    edge_extract, declared_calls, class_facts, class_scan, build_scan, path_dispatch, class_by_name, method_report, report_text, report_json, caller_fetch, entity_by_frame, find_inherited, entry_keys, first_frames,
    list_ops, list_nulls, list_bags, list_clear_refill, list_listener, poly_field, new_entities, order_items, stock, user_updates, stamped, snowflake_ids, nested_fetch,
)


def queries() -> dict:
    return {f.__name__: f for f in _NAMES}


_USERS = "WITH u AS (SELECT user_id, list(event_type ORDER BY event_id) AS xs FROM events GROUP BY user_id)"
_EDGES = f"(SELECT {', '.join(DOWN)} FROM customer UNION SELECT {', '.join(BACK)} FROM customer WHERE c_acctbal < 0)"
_CLOSED = f"WITH RECURSIVE e AS {_EDGES}, r(root, node) AS (SELECT CAST(r_regionkey + 1 AS BIGINT), CAST(r_regionkey + 1 AS BIGINT) FROM region UNION SELECT r.root, e.callee FROM r JOIN e ON e.caller = r.node)"
_FROM_LINES = f"SELECT {', '.join(INSNS)} FROM lineitem"
_FROM_PARTS = f"SELECT {', '.join(CLASSES)} FROM part"
_FROM_LAMBDAS = f"SELECT {', '.join(LAMBDAS)} FROM lineitem"
_LAMBDA = f"kind = 'INDY' AND bootstrap_owner = '{METAFACTORY}' AND bootstrap_name IN ('metafactory', 'altMetafactory') AND handle_tag IN (5, 6, 7, 9)"
_SAVED = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'S' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE count(l_orderkey) END AS n, CASE WHEN o_orderstatus = 'P' THEN 9 ELSE CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) END AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus UNION ALL SELECT -o_orderkey - 1, 'N', 1, 9 FROM orders WHERE o_orderstatus = 'P'"
_KEPT = "(SELECT c_custkey AS k, c_nationkey AS n FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_nationkey % 2 = 0)"

_REPORT = f"SELECT 'shop.C' || k AS class_name, 'class: shop.C' || k || e || '  update()V' || e || '    reads: balance' || e || '    writes: status' || CASE WHEN n % 4 > 0 THEN e || '    calls: recalc(' || (n % 4) || ')' ELSE '' END || e || '  recalc()V' || e || '    reads: total' || CASE WHEN n % 3 = 0 THEN e || '    calls: audit(1)' ELSE '' END || e || '  audit()V' || e || '    reads: log' || e || '  getName()V' || e || '    reads: name' AS text FROM {_KEPT}, (SELECT chr(10) AS e)"

_TREE = "WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS caller, 'n' || n_nationkey AS callee FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'c' || c_custkey, 'c' || CAST(floor(c_custkey / 2) AS BIGINT) FROM customer WHERE c_acctbal < 0 UNION SELECT 'c' || c_custkey, 'c' || c_custkey FROM customer WHERE 'c' || c_custkey LIKE '%7'), r(node, path) AS (SELECT 'r' || r_regionkey, ['r' || r_regionkey] FROM region UNION ALL SELECT callee, list_append(path, callee) FROM r JOIN e ON caller = node WHERE NOT list_contains(path, callee))"


def _without(xs: str, e: str) -> str:
    return f"CASE WHEN list_contains({xs}, '{e}') THEN list_concat({xs}[:list_position({xs}, '{e}') - 1], {xs}[list_position({xs}, '{e}') + 1:]) ELSE {xs} END"


_PROPERTY = "CASE WHEN starts_with(name, 'get') AND length(name) > 3 THEN lower(name[4]) || name[5:] WHEN starts_with(name, 'is') AND length(name) > 2 THEN lower(name[3]) || name[4:] WHEN starts_with(name, 'set') AND length(name) > 3 THEN lower(name[4]) || name[5:] END"
_KIND = "CASE WHEN starts_with(name, 'get') AND length(name) > 3 OR starts_with(name, 'is') AND length(name) > 2 THEN 'R' WHEN starts_with(name, 'set') AND length(name) > 3 THEN 'W' END"


def oracle_sql() -> dict[str, str]:
    return {
        "hydrate_by_key": "SELECT o_orderkey, o_orderstatus, l_linenumber, l_quantity, p_name FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey",
        "element_sum": "SELECT o_orderkey, CAST(coalesce(sum(CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(30,4))), 0) AS DECIMAL(38,4)) AS total FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
        "poly_choice": "SELECT event_id, CASE WHEN event_type <> 'view' THEN 'other' WHEN value > 50 THEN 'large' END AS type, CASE WHEN event_type <> 'view' THEN value * 2 WHEN value > 50 THEN value END AS chosen FROM events",
        "accessor_inference": f"WITH x AS (SELECT {', '.join(ACCESSORS)} FROM part) SELECT p_partkey, name, {_KIND} AS kind, {_PROPERTY} AS property FROM x",
        "call_closure": f"{_CLOSED} SELECT root, node FROM r",
        "call_tree": f"{_TREE} SELECT array_to_string(path, '/') AS path, node FROM r",
        "call_tree_text": f"{_TREE} SELECT repeat('    ', len(path) - 2) || CASE WHEN len(path) > 1 THEN '└── ' ELSE '' END || node AS value FROM r",
        "frame_resolve": f"WITH l AS (SELECT {', '.join(LINES)} FROM lineitem), f AS (SELECT {', '.join(FRAMES)} FROM orders), s AS (SELECT cls, name, method_ord, min(line) AS low, max(line) AS high, list(line) AS own FROM l GROUP BY ALL), j AS (SELECT f.*, method_ord, row_number() OVER (PARTITION BY f.o_orderkey ORDER BY CASE WHEN list_contains(own, f.line) THEN 1 WHEN f.line BETWEEN low AND high THEN 2 ELSE 3 END, CASE WHEN list_contains(own, f.line) THEN -method_ord ELSE method_ord END) AS k FROM f LEFT JOIN s ON s.cls = f.cls AND s.name = f.name) SELECT o_orderkey, cls, name, line, method_ord FROM j WHERE k = 1",
        "property_access_rows": f"WITH c AS ({_FROM_PARTS}), i AS ({_FROM_LINES}), o AS (SELECT i.* FROM i JOIN c USING (class_id) WHERE role = '{ROLE}' AND owner = class_name), x AS (SELECT class_id, method_ord, CASE opcode WHEN 180 THEN 'R' ELSE 'W' END AS kind, name, '' AS descriptor, 1 AS n FROM o WHERE kind = 'FIELD' AND opcode IN (180, 181) UNION ALL SELECT class_id, method_ord, {_KIND}, {_PROPERTY}, '', 1 FROM o WHERE kind = 'CALL' AND name NOT IN ('<init>', '<clinit>') AND {_KIND} IS NOT NULL UNION ALL SELECT class_id, method_ord, 'C', name, descriptor, 1 FROM o WHERE kind = 'CALL' AND name NOT IN ('<init>', '<clinit>')) SELECT class_id, method_ord, kind, name, descriptor, CAST(CASE WHEN kind = 'C' THEN sum(n) ELSE 1 END AS BIGINT) AS n FROM x GROUP BY class_id, method_ord, kind, name, descriptor",
        "lambda_last_edge": f"SELECT caller, arg_max(name, insn_ord) AS target FROM ({_FROM_LAMBDAS}) WHERE {_LAMBDA} GROUP BY caller",
        "fetch_plan": f"{_CLOSED}, i AS ({_FROM_LINES}), c AS ({_FROM_PARTS}) SELECT DISTINCT root, owner, i.name AS field FROM r JOIN i ON i.caller = r.node JOIN c ON c.class_name = i.owner WHERE kind = 'FIELD' AND opcode = 180 AND role = '{ROLE}'",
        "mapped_path": "SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price, c_name AS name, c_mktsegment AS segment, CASE WHEN o_orderkey % 2 = 0 THEN 'NONE' ELSE o_orderpriority END AS priority FROM orders JOIN customer ON o_custkey = c_custkey",
        "entity_ops": "SELECT o_orderkey, 'new,' || o_orderstatus || ',' || o_orderpriority || ',end' AS tags, o_orderkey AS number, o_orderkey AS id, CAST(NULL AS VARCHAR) AS code FROM orders",
        "list_map": "SELECT o_orderkey, l_partkey AS product, CAST(l_quantity AS DECIMAL(18,2)) AS quantity, o_orderstatus AS status FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
        "poly_list_map": "SELECT o_orderkey, l_partkey AS id, CASE WHEN l_quantity > 20 THEN 'Many' ELSE 'Few' END AS type, CAST(CASE WHEN l_quantity > 20 THEN l_quantity * 10 ELSE l_quantity END AS DECIMAL(18,2)) AS amount FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
        "list_remove_first": f"{_USERS} SELECT user_id, array_to_string(CASE WHEN list_contains(xs, 'click') THEN list_concat(xs[:list_position(xs, 'click') - 1], xs[list_position(xs, 'click') + 1:]) ELSE xs END, ',') AS \"left\" FROM u",
        "retain_all": f"{_USERS} SELECT user_id, array_to_string(list_filter(xs, lambda x: x IN ('click', 'view')), ',') AS kept FROM u",
        "list_replay": f"{_USERS} SELECT user_id, array_to_string(list_concat(['first'], xs[2:], ['end']), ',') AS items FROM u",
        "upsert_replace": _SAVED,
        "store_save": _SAVED,
        "status_transition": "WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'CONFIRMED' ELSE 'SHIPPED' END AS status, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has FROM orders) SELECT o_orderkey, CASE WHEN status = 'PENDING' AND has THEN 'CONFIRMED' ELSE status END AS confirmed, CASE WHEN status = 'CONFIRMED' THEN 'SHIPPED' ELSE status END AS shipped, CASE WHEN status IN ('PENDING', 'CONFIRMED') THEN 'CANCELLED' ELSE status END AS cancelled, status = 'PENDING' AS can_modify FROM o",
        "validate_rows": "SELECT c_custkey, c_custkey % 7 = 0 OR c_custkey % 11 = 0 AS blank, c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 5 <> 0 AND c_acctbal >= 0 AS valid FROM customer",
        "edge_extract": f"SELECT DISTINCT caller, owner, name, 'call' AS kind FROM ({_FROM_LAMBDAS}) WHERE kind = 'CALL' UNION ALL SELECT DISTINCT caller, owner, name, 'lambda' FROM ({_FROM_LAMBDAS}) WHERE {_LAMBDA}",
        "declared_calls": f"SELECT DISTINCT owner, name, descriptor FROM ({_FROM_LINES}) i WHERE kind = 'CALL' AND EXISTS (SELECT 1 FROM part WHERE i.owner = 'shop.P' || p_partkey AND i.name = CASE p_size % 3 WHEN 0 THEN 'recalc' WHEN 1 THEN 'total' ELSE 'items' END AND i.descriptor = '()V')",
        "class_facts": f"SELECT 'shop.C' || k AS class_name, '.' || m AS method, CASE m WHEN 'update()V' THEN 'balance' WHEN 'recalc()V' THEN 'total' WHEN 'audit()V' THEN 'log' ELSE 'name' END AS reads, CASE m WHEN 'update()V' THEN 'status' ELSE '' END AS writes, CASE WHEN m = 'update()V' AND n % 4 > 0 THEN 'recalc()V*' || (n % 4) WHEN m = 'recalc()V' AND n % 3 = 0 THEN 'audit()V*1' ELSE '' END AS calls FROM {_KEPT}, (SELECT unnest(['update()V', 'recalc()V', 'audit()V', 'getName()V']) AS m)",
        "class_scan": "SELECT 'shop/C' || c_custkey || '.class' AS entry_name, CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'shop.C' || c_custkey END AS class_name, CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'shop.C' || CAST(floor(c_custkey / 2) AS BIGINT) END AS super_name, CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(c_custkey % 3 AS INT) ELSE 0 END AS n_methods, c_mktsegment = 'MACHINERY' AS corrupt FROM customer",
        "build_scan": f"SELECT 'shop.C' || k AS class_name, 4 AS n_methods FROM {_KEPT} WHERE n % 5 <> 0",
        "path_dispatch": "SELECT CASE WHEN c_nationkey % 5 = 0 THEN 'jar' ELSE 'file' END AS kind, count(*) AS n, count(*) FILTER (c_mktsegment <> 'MACHINERY') AS classes FROM customer GROUP BY 1",
        "class_by_name": f"SELECT 'shop.C' || c_custkey AS class_name, 'java.lang.Object' AS super_name, CASE WHEN c_nationkey % 2 = 0 THEN '{ROLE}' ELSE 'Lexample/Other;' END AS roles FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_custkey IN (SELECT n_nationkey FROM nation)",
        "method_report": _REPORT,
        "report_text": f"SELECT unnest(string_split(text, chr(10))) AS value FROM ({_REPORT}) UNION ALL SELECT 'total: ' || count(*) FROM {_KEPT}",
        "report_json": f"SELECT 'shop.C' || k AS class_name, true AS is_aggregate_root, method_name, CASE method_name WHEN 'update' THEN 'balance' WHEN 'recalc' THEN 'total' WHEN 'audit' THEN 'log' ELSE 'name' END AS reads FROM {_KEPT}, (SELECT unnest(['update', 'recalc', 'audit', 'getName']) AS method_name)",
        "caller_fetch": f"SELECT 'shop.C' || k || '.update()V' AS root, 'shop.C' || k AS owner, field FROM {_KEPT}, (SELECT unnest(['total', 'log']) AS field) WHERE n % 4 > 0 AND (field = 'total' OR n % 3 = 0)",
        "entity_by_frame": "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer",
        "find_inherited": f"""WITH RECURSIVE e AS (SELECT k, up, min(ord) AS ord FROM ({' UNION ALL '.join(f'SELECT c_custkey AS k, {up} AS up, {i} AS ord FROM customer' for i, up in enumerate(PARENTS))}) WHERE up <> k GROUP BY k, up),
r(k, a, depth, path) AS (SELECT k, up, 1, [ord] FROM e UNION ALL SELECT r.k, e.up, r.depth + 1, min(list_append(r.path, e.ord)) FROM r JOIN e ON e.k = r.a WHERE e.up <> r.k AND r.depth < 20 GROUP BY r.k, e.up, r.depth + 1),
h AS (SELECT w.c_custkey AS k, r.a, row_number() OVER (PARTITION BY w.c_custkey ORDER BY r.depth, r.path) AS n FROM customer w JOIN r ON r.k = w.c_custkey JOIN customer o ON o.c_custkey = r.a AND o.c_custkey % 5 = w.c_nationkey % 5 WHERE (o.c_custkey % 3) % 2 = 1)
SELECT 'C' || c_custkey AS class_name, 'm' || (c_nationkey % 5) AS name, '()V' AS descriptor, 'C' || CASE WHEN c_custkey % 5 = c_nationkey % 5 THEN c_custkey ELSE a END AS found_in FROM customer LEFT JOIN h ON k = c_custkey AND n = 1""",
        "entry_keys": "SELECT event_id, 'shop.' || event_type || '.run(' || CASE event_type WHEN 'click' THEN 'I[Ljava/lang/String;' WHEN 'view' THEN '[[J' ELSE '' END || ')V' AS reflected, 'shop.' || event_type || '.lambda$0()V' AS \"lambda\" FROM events",
        "first_frames": f"WITH u AS (SELECT user_id, list({FRAME_NAME} ORDER BY event_id) AS xs FROM events GROUP BY user_id) SELECT user_id, list_filter(xs[3:], lambda x: NOT starts_with(x, 'java.') AND NOT starts_with(x, 'org.springframework.') AND NOT contains(x, 'Proxy$'))[1] AS frame FROM u",
        "list_ops": f"{_USERS}, v AS (SELECT *, {_without('xs', 'click')} AS a FROM u) SELECT user_id, array_to_string({_without('a', 'view')}, ',') AS removed, array_to_string(list_concat(xs[:1], CASE WHEN len(xs) > 1 THEN ['new'] ELSE [] END, xs[3:]), ',') AS replaced, array_to_string(xs[1:3], ',') AS part, array_to_string(list_concat(xs[:1], ['click', 'view'], xs[2:]), ',') AS inserted, array_to_string(list_concat(xs, ['click', 'view', 'end']), ',') AS longer, '' AS cleared, CAST(coalesce(list_position(xs, 'view'), 0) AS INT) - 1 AS first, CASE WHEN list_contains(xs, 'view') THEN CAST(len(xs) - list_position(list_reverse(xs), 'view') AS INT) ELSE -1 END AS last, list_contains(xs, 'click') AND list_contains(xs, 'view') AS both, CASE WHEN list_contains(xs, 'error') THEN CAST(list_position(xs, 'error') - 1 AS INT) END AS pair FROM v",
        "list_nulls": f"WITH u AS (SELECT user_id, list(CASE event_type WHEN 'error' THEN '-' ELSE event_type END ORDER BY event_id) AS xs FROM events GROUP BY user_id), v AS (SELECT *, {_without('xs', '-')} AS a FROM u) SELECT user_id, array_to_string(a, ',') AS without, array_to_string({_without('a', 'click')}, ',') AS removed, array_to_string(list_filter(xs, lambda x: x IN ('-', 'click')), ',') AS retained, CAST(coalesce(list_position(xs, '-'), 0) AS INT) - 1 AS first, CASE WHEN list_contains(xs, '-') THEN CAST(len(xs) - list_position(list_reverse(xs), '-') AS INT) ELSE -1 END AS last, list_contains(xs, '-') AND list_contains(xs, 'click') AS both FROM v",
        "list_bags": "WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN '-' ELSE event_type END AS t, value FROM events), k AS (SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id, t ORDER BY event_id) AS k, count(*) FILTER (value > 50) OVER (PARTITION BY user_id, t) AS n FROM e) SELECT user_id, coalesce(string_agg(t, ',' ORDER BY event_id) FILTER (k > n), '') AS removed, coalesce(string_agg(t, ',' ORDER BY event_id) FILTER (n > 0), '') AS kept FROM k GROUP BY user_id",
        "list_clear_refill": f"{_USERS} SELECT user_id, array_to_string(list_concat(xs[1:2], xs[1:2]), ',') AS items FROM u",
        "list_listener": "SELECT o_orderkey, o_orderstatus <> 'F' AS created, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS price, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS name, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS customer FROM orders",
        "poly_field": "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'Plain' WHEN o_totalprice > 200000 THEN 'Large' WHEN starts_with(o_orderpriority, '1') THEN 'Urgent' END AS type, o_totalprice AS price, CASE WHEN o_orderstatus <> 'P' OR o_totalprice > 200000 OR starts_with(o_orderpriority, '1') THEN o_totalprice END AS amount FROM orders",
        "new_entities": "SELECT n_regionkey, CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(NULL AS VARCHAR) AS detail, CAST(NULL AS VARCHAR) AS code FROM nation",
        "order_items": "WITH l AS (SELECT l_orderkey, l_partkey, CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(30,4)) AS p FROM lineitem), a AS (SELECT o_orderkey, o_orderstatus, count(p) AS n, coalesce(sum(p), 0) AS t, count(p) FILTER (l_partkey % 7 = 0 OR l_partkey <> o_orderkey % 50) AS n2, coalesce(sum(p) FILTER (l_partkey % 7 = 0 OR l_partkey <> o_orderkey % 50), 0) AS t2 FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus) SELECT o_orderkey, 'Order(id=' || o_orderkey || ', customer=' || o_orderstatus || ', total=' || CAST(t + 10 AS DECIMAL(38,4)) || ', status=PENDING, itemCount=' || (n + 1) || ')' AS said, CAST(t2 AS DECIMAL(38,4)) AS total, n2 AS n FROM a",
        "stock": "SELECT p_partkey, p_size > 0 AS some, p_size >= 20 AS enough, CASE WHEN p_size >= 20 THEN p_size - 20 ELSE p_size END AS reduced, p_size + 20 AS added, p_retailprice * 2 AS price FROM part",
        "user_updates": "SELECT c_custkey, CASE WHEN c_nationkey > 12 THEN 'new' ELSE c_name END AS name, 'u@x' AS email, c_nationkey + 1 AS age, true AS \"on\", false AS \"off\", 'User(id=' || c_custkey || ', name=' || CASE WHEN c_nationkey > 12 THEN 'new' ELSE c_name END || ', email=u@x, age=' || c_nationkey || ', active=' || CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END || ')' AS said FROM customer",
        "snowflake_ids": f"WITH o AS (SELECT o_orderkey, {defaults.EPOCH_MS} + o_custkey % 3 AS ms, row_number() OVER (ORDER BY o_custkey % 3, o_orderkey) - 1 AS i FROM orders), s AS (SELECT o_orderkey, i + max(ms * 4096 - i) OVER (ORDER BY i) AS slot FROM o) SELECT o_orderkey, (slot // 4096 - {defaults.EPOCH_MS}) * 4194304 + 135168 + slot % 4096 AS number FROM s",
        "nested_fetch": "SELECT o_orderkey, o_totalprice, c_name, l_partkey AS product_id, CAST(l_quantity AS DECIMAL(18,2)) AS quantity FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey",
        "stamped": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE TIMESTAMP '2024-01-01' END AS updated, CASE WHEN o_orderstatus = 'F' THEN o_orderdate WHEN o_orderpriority > '3' THEN TIMESTAMP '2024-01-01' END AS created, o_custkey * 4194304 + 135168 + o_orderkey % 4096 AS number FROM orders",
    }
