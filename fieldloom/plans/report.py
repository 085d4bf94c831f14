"""Reports of property access and call trees, written where the data is: rows are sorted and written by Spark, on any path that it can write.

A report is lines in order. It becomes one file, or a folder of part files whose names are in the order of their lines
(`parts`): then as many tasks write as the report needs. Files are written beside the target and renamed into place when
all are complete, so a failed job leaves the report of before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.naming import joined
from fieldloom.plans.checkpoints import checkpoint

FORMATS = ("JSON", "TXT")


def text_of(classes: DataFrame, calls: bool = True) -> DataFrame:
    """(class_name, text): a class's part of the text report."""

    def part(label, xs):
        return F.when(F.size(xs) > 0, F.concat(F.lit(f"\n    {label}: "), joined(xs))).otherwise("")

    def method(m):
        said = F.concat(F.lit("  "), m["method_name"], m["method_desc"], part("reads", m["reads"]), part("writes", m["writes"]))
        return F.concat(said, part("calls", F.transform(m["calls"], lambda x: F.concat(x["method_name"], F.lit("("), x["call_count"].cast("string"), F.lit(")"))))) if calls else said

    body = F.when(F.size("methods") == 0, F.lit("  no property access")).otherwise(F.array_join(F.transform("methods", method), "\n"))
    return classes.select("class_name", F.concat(F.lit("class: "), F.col("class_name"), F.lit("\n"), body).alias("text"))


def _in_order(rows: DataFrame, *keys: str) -> tuple[DataFrame, int, int]:
    """(at, value) of rows(keys..., value) in order of the keys, their number, and the last place; the sorted rows are checkpointed."""
    placed = checkpoint(rows.orderBy(*keys).select("value").withColumn("at", F.monotonically_increasing_id()))
    n, last = placed.agg(F.count("*"), F.max("at")).first()
    return placed.select("at", "value"), n, -1 if last is None else last


def _around(body: DataFrame, last: int, head: list[str], foot: list[str]) -> DataFrame:
    more = [(k - len(head), x) for k, x in enumerate(head)] + [(last + 1 + k, x) for k, x in enumerate(foot)]
    return body.unionByName(body.sparkSession.createDataFrame(more, "at long, value string")) if more else body


def lines(classes: DataFrame, form: str = "JSON", calls: bool = True, head: str | None = None) -> DataFrame:
    """(at, value): the report's lines, at in their order. JSON: an array with an object on each line; text: a part for each class, then the total."""
    if form.upper() not in FORMATS:
        raise ValueError(f"unknown format: {form}")
    if form.upper() == "TXT":
        body, n, last = _in_order(text_of(classes, calls).select("class_name", F.col("text").alias("value")), "class_name", "value")
        return _around(body, last, [] if head is None else [head.format(n)], [f"total: {n}"])
    objects = classes.select("class_name", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    body, n, last = _in_order(objects, "class_name", "value")
    ended: Column = F.when(F.col("at") == last, "").otherwise(",")
    return _around(body.select("at", F.concat(F.lit("  "), F.col("value"), ended).alias("value")), last, ["["], ["]"])


def write_lines(ordered: DataFrame, path: str, parts: bool = False) -> None:
    """Lines (at, value) as one text file, or as a folder of part files in order."""
    spark = ordered.sparkSession
    rows = ordered.orderBy("at").select("value")
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    (rows if parts else rows.coalesce(1)).write.text(beside)
    jvm = spark._jvm
    at, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path.rstrip("/")))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    made = at if parts else next(x.getPath() for x in fs.listStatus(at) if x.getPath().getName().startswith("part-"))
    fs.delete(target, True)
    if not fs.rename(made, target):
        raise OSError(f"cannot rename to {path}")
    fs.delete(at, True)


def write(classes: DataFrame, path: str, form: str = "JSON", parts: bool = False) -> None:
    write_lines(lines(classes, form), path, parts)


def say(ordered: DataFrame, out: Callable[[str], object] = print) -> None:
    """Lines to the driver's console, one after the other: the driver holds one partition at a time."""
    for r in ordered.orderBy("at").select("value").toLocalIterator():
        out(r.value)


def show(classes: DataFrame, out: Callable[[str], object] = print) -> None:
    """The text report without calls, for a console."""
    say(lines(classes, "TXT", calls=False), out)


def log(classes: DataFrame, out: Callable[[str], object] = print) -> None:
    """The text report under a line that says what was found."""
    say(lines(classes, "TXT", head="analysis finished, {} aggregate classes"), out)


def tree_lines(paths: DataFrame) -> DataFrame:
    """(at, value): call paths (path array) as the lines of an indented tree, a caller before what it calls."""
    depth = F.size("path")
    text = F.concat(F.repeat(F.lit("    "), depth - 2), F.when(depth > 1, F.lit("└── ")).otherwise(""), F.element_at("path", -1))
    return _in_order(paths.select("path", text.alias("value")), "path")[0]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of a written report; file names are in the order of the lines."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), "value")
