"""Change-tracked lists: a log of INSERT, DELETE and REPLACE rows, replayed onto lists.

Positions are resolved before a change, so equal elements and the two sides of a list never come apart.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fieldloom.operators.rope import Rope

#: Lists that are given back at once.
OUT_ROWS = 1000
OPS = ("INSERT", "DELETE", "REPLACE")


def adding_all(lists_of: DataFrame, key: str, seq: int, pos: str | None, values: str) -> DataFrame:
    """Log rows that insert an array's elements one after the other, from pos on (null: at the end); their seq rises from seq."""
    at = F.lit(None).cast("int") if pos is None else (F.col(pos) + F.col("i")).cast("int")
    rows = lists_of.select(key, *([] if pos is None else [pos]), F.posexplode(values).alias("i", "value"))
    return rows.select(key, (F.lit(seq) + F.col("i")).cast("int").alias("seq"), F.lit("INSERT").alias("op"), at.alias("pos"), "value")


def clearing(state: DataFrame, key: str, seq: int, items: str = "items") -> DataFrame:
    """Log rows that delete every element, the first one first; their seq rises from seq."""
    rows = state.select(key, F.posexplode(items).alias("i", "gone"))
    return rows.select(key, (F.lit(seq) + F.col("i")).cast("int").alias("seq"), F.lit("DELETE").alias("op"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("value"))


def replay(state: DataFrame, log: DataFrame, key: str, items: str = "items") -> DataFrame:
    """state(key, items, ...) after log(key, seq, op, pos, value) in order of seq; pos from 0, for INSERT null is the end.

    A position that is out of range or missing, an unknown op and a null element to put in are errors. Lists without changes are not touched; the
    others meet their changes in one shuffle, in order, and a task streams them through a Rope, so a list of n elements with m
    changes takes (n + m) log n steps and its log is never one row. A null list or a key that only the log has stays as it is.
    """
    changed = log.select(key).distinct()
    rest, touched = state.join(changed, key, "left_anti"), state.join(changed, key, "left_semi")
    element = state.schema[items].dataType.elementType
    none = lambda kind: F.lit(None).cast(kind)
    rows = touched.select(*touched.columns, none("long").alias("_seq"), none("string").alias("_op"), none("long").alias("_pos"), none(element).alias("_value"), F.lit(0).alias("_change"))
    steps = log.where(F.col(key).isNotNull()).select(*(F.col(c) if c == key else none(touched.schema[c].dataType).alias(c) for c in touched.columns), F.col("seq").cast("long").alias("_seq"), F.col("op").alias("_op"), F.col("pos").cast("long").alias("_pos"), F.col("value").cast(element).alias("_value"), F.lit(1).alias("_change"))
    # By a hash of the key: a union of two sides that are partitioned by the key counts as partitioned already, though their partitions are merged apart at run time.
    met = rows.unionByName(steps).repartition(F.xxhash64(key)).sortWithinPartitions(key, "_change", "_seq", "_op", "_pos")
    arrow = to_arrow_schema(state.schema)

    def run(it):
        held, ready = [], []
        for b in it:
            for r in b.to_pylist():
                if not r["_change"]:
                    if held and held[0][0][key] != r[key]:
                        ready += map(finish, held)
                        held = []
                    held.append((r, None if r[items] is None else Rope(r[items])))
                elif held and held[0][0][key] == r[key]:
                    for _, xs in held:
                        if xs is not None:
                            step(xs, r)
                if len(ready) >= OUT_ROWS:
                    yield pa.RecordBatch.from_pylist(ready, schema=arrow)
                    ready = []
        ready += map(finish, held)
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=arrow)

    def finish(x):
        row, xs = x
        return {c: row[c] for c in arrow.names} | {items: None if xs is None else list(xs)}

    def step(xs: Rope, r: dict) -> None:
        op, at, value = r["_op"], r["_pos"], r["_value"]
        if op not in OPS:
            raise ValueError(f"unknown change: {op}")
        if value is None and op != "DELETE":
            raise ValueError("null element")
        if op == "INSERT":
            xs.insert(len(xs) if at is None else at, value)
        elif at is None:
            raise IndexError("no such position")
        elif op == "DELETE":
            xs.delete(at)
        else:
            xs.set(at, value)

    return rest.unionByName(met.mapInArrow(run, state.schema))
