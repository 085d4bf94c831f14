"""The reader on compiled classes: a fixture with its source beside it, and jars of the installed Spark against the JDK's own disassembler."""

import random
import re
import shutil
import subprocess
import zipfile
from collections import Counter
from pathlib import Path

import pyspark
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import callgraph
from fieldloom.operators.property_access import methods_report
from fieldloom.sources import classfile, scan

DATA = Path(__file__).parent / "data"
JARS = Path(pyspark.__file__).parent / "jars"
ROLE = "Lexample/AggregateRoot;"
_OPS = re.compile(r"^\s+\d+: (getfield|putfield|getstatic|putstatic|invokevirtual|invokespecial|invokestatic|invokeinterface|invokedynamic)\b", re.M)


def test_the_fixture(spark):
    found = classfile.parse((DATA / "Features.class").read_bytes())
    assert (found["class_name"], found["super_name"]) == ("example.Features", "java.lang.Object")
    assert found["annotations"] == ["Lexample/Outer;", "Ljava/lang/Deprecated;", ROLE]
    by_name = {m[1]: m[0] for m in found["methods"]}
    calls = lambda name: [x[5] for x in found["insns"] if x[0] == by_name[name] and x[2] == "CALL"]
    assert calls("table") == ["getName", "length", "setName"] and calls("lookup") == ["isOpen", "twice", "lookup"]
    assert calls("many") == [] and calls("arrays") == ["table"]
    handles = [(x[5], x[8], x[9]) for x in found["insns"] if x[0] == by_name["lambdas"] and x[2] == "INDY"]
    assert handles == [("lambda$lambdas$0", "metafactory", 5), ("getName", "metafactory", 5), ("<init>", "metafactory", 8), ("lambda$lambdas$1", "metafactory", 5)]
    assert [m[1] for m in classfile.parse((DATA / "Features$Base.class").read_bytes())["methods"]] == ["<init>", "nothing", "outside"]
    assert classfile.parse((DATA / "Priced.class").read_bytes())["super_name"] == "java.lang.Object"


def test_reports_and_edges_of_the_fixture(spark):
    t = classfile.tables(scan.read(spark, str(DATA)))
    features = t["classes"].where("class_name = 'example.Features'")
    rows = {r.method_name: r for r in methods_report(features, t["methods"], t["insns"], [ROLE]).collect()}
    assert (rows["table"].reads, rows["table"].writes) == (["amount", "name"], ["name"])
    assert (rows["lookup"].reads, rows["lookup"].writes) == (["open"], ["rate"])
    assert [(c.method_name, c.call_count) for c in rows["lookup"].calls] == [("isOpen", 1), ("lookup", 1), ("twice", 1)]
    insns = t["insns"].join(features, "class_id").join(t["methods"], ["class_id", "method_ord"]).select(F.col("method_name").alias("caller"), "insn_ord", "kind", "owner", "name", "descriptor", "bootstrap_owner", "bootstrap_name", "handle_tag")
    edge = callgraph.edges(insns).where("caller = 'lambdas' AND kind = 'lambda'")
    assert sorted(r.callee.name for r in edge.collect()) == ["getName", "lambda$lambdas$0", "lambda$lambdas$1"]


@pytest.mark.skipif(shutil.which("javap") is None, reason="no disassembler")
@pytest.mark.parametrize("name", ["scala-library", "spark-unsafe"])
def test_jars_against_the_disassembler(spark, name):
    jar = next(JARS.glob(f"{name}*.jar"))
    with zipfile.ZipFile(jar) as z:
        entries = [e for e in z.namelist() if e.endswith(".class")]
    df = scan.read(spark, str(jar), split_bytes=500_000)
    facts = df.select("entry_name", "class_name", "corrupt", F.size("methods").alias("methods"), F.transform("insns", lambda x: x["opcode"]).alias("ops"), F.size("lines").alias("lines"), F.spark_partition_id().alias("p")).collect()
    assert sorted(r.entry_name for r in facts) == sorted(entries) and {r.corrupt for r in facts} == {None}
    assert name != "scala-library" or len({r.p for r in facts}) > 5
    rows = {r.entry_name: r for r in facts}
    for entry in random.Random(1).sample(entries, min(25, len(entries))):
        r = rows[entry]
        said = subprocess.run(["javap", "-c", "-l", "-p", "-cp", str(jar), r.class_name], capture_output=True, text=True, check=True).stdout
        want = Counter(_OPS.findall(said))
        names = {0xB2: "getstatic", 0xB3: "putstatic", 0xB4: "getfield", 0xB5: "putfield", 0xB6: "invokevirtual", 0xB7: "invokespecial", 0xB8: "invokestatic", 0xB9: "invokeinterface"}
        got = Counter(names[o] for o in r.ops if o in names)
        want.pop("invokedynamic", None)
        assert got == want, entry
        assert r.lines == len(re.findall(r"^\s+line \d+: \d+", said, re.M)), entry
