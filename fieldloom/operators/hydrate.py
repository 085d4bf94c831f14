"""Aggregates from flat tables: read by key, flat or nested; save with replaced children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat(root: DataFrame, child: DataFrame, on: Column, leaf: DataFrame | None = None, leaf_on: Column | None = None) -> DataFrame:
    """root with its children and theirs, one row each; a root without children stays."""
    out = root.join(child, on, "left")
    return out if leaf is None else out.join(leaf, leaf_on, "left")


def nested(root: DataFrame, child: DataFrame, root_key: str, child_key: str, into: str) -> DataFrame:
    """root with an array of its children's structs, in their own order; empty without any.

    Children are grouped before the join, so a root row is never repeated; one root's children make one row.
    """
    names = [c for c in child.columns if c != child_key]
    lists = child.groupBy(F.col(child_key).alias("_key")).agg(F.sort_array(F.collect_list(F.struct(*names))).alias(into))
    out = root.join(lists, F.col(root_key) == F.col("_key"), "left").drop("_key")
    return out.withColumn(into, F.coalesce(into, F.filter(F.array(F.struct(*(F.lit(None).cast(child.schema[n].dataType).alias(n) for n in names))), lambda x: F.lit(False))))


def save(stored: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Upsert: changed rows replace the stored ones of their key, or are added."""
    return stored.join(changed.select(key), key, "left_anti").unionByName(changed)


def replace_children(stored: DataFrame, changed: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """All children of the saved roots go; the given ones take their place."""
    return stored.join(roots.select(key).distinct(), key, "left_anti").unionByName(changed)


def assert_found(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """wanted ⟕ df, with an error for a key that is missing."""
    there = df.withColumn("_there", F.lit(True))
    out = wanted.select(key).join(there, key, "left")
    return out.where(F.coalesce("_there", F.raise_error(F.lit("not found")).cast("boolean"))).drop("_there")
