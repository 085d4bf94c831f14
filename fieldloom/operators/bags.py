"""Removing and keeping elements of long lists, as joins: null equals null, equal elements are counted, order stays.

lists.remove_all and lists.retain_all do the same for short arrays within a row, at the product of both lengths; here an
element is a row, and the lists that have none of the others' elements move once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _elements(state: DataFrame, key: str, items: str) -> DataFrame:
    return state.select(F.col(key).alias("_key"), F.posexplode(items).alias("_at", "_value"))


def _back(state: DataFrame, key: str, items: str, left: DataFrame) -> DataFrame:
    """state with what is left of each list; a null list stays null."""
    whole = left.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_at", "_value"))).alias("_left"))
    values = F.transform("_left", lambda x: x["_value"])
    some = F.when(F.col(items).isNotNull(), F.coalesce(values, F.slice(items, 1, 0)))
    return state.join(whole, F.col(key) == F.col("_key"), "left").withColumn(items, some).drop("_key", "_left")


def remove_all(state: DataFrame, others: DataFrame, key: str, items: str = "items", value: str = "value") -> DataFrame:
    """state(key, items, ...) where each row of others(key, value) has taken the first occurrence that is left, if there is one. Keys of state are unique."""
    first = Window.partitionBy("_key", "_value").orderBy("_at")
    ranked = _elements(state, key, items).withColumn("_k", F.row_number().over(first))
    taken = others.groupBy(F.col(key).alias("_key2"), F.col(value).alias("_value2")).agg(F.count("*").alias("_n"))
    met = ranked.join(taken, (F.col("_key") == F.col("_key2")) & F.col("_value").eqNullSafe(F.col("_value2")), "left")
    return _back(state, key, items, met.where(F.col("_k") > F.coalesce("_n", F.lit(0))))


def retain_all(state: DataFrame, others: DataFrame, key: str, items: str = "items", value: str = "value") -> DataFrame:
    """state with the elements that others(key, value) has for its key, however often."""
    kept = others.select(F.col(key).alias("_key2"), F.col(value).alias("_value2")).distinct()
    met = _elements(state, key, items).join(kept, (F.col("_key") == F.col("_key2")) & F.col("_value").eqNullSafe(F.col("_value2")), "left_semi")
    return _back(state, key, items, met)
