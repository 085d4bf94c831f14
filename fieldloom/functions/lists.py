"""List operations on arrays; indexes are from 0. Equal elements stay apart, and positions decide; a null element is one like any other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_of(xs: Column, e: Column) -> Column:
    """Place of the first element equal to e (null equals null), -1 without one; null for a null list."""
    null_at = F.array_position(F.transform(xs, lambda x: x.isNull()), F.lit(True))
    return (F.when(e.isNull(), null_at).otherwise(F.array_position(xs, e)) - 1).cast("int")


def last_index_of(xs: Column, e: Column) -> Column:
    at = index_of(F.reverse(xs), e)
    return F.when(at < 0, -1).otherwise(F.size(xs) - 1 - at).cast("int")


def add(xs: Column, e: Column) -> Column:
    return F.array_append(xs, e)


def add_at(xs: Column, i: Column, e: Column) -> Column:
    return F.array_insert(xs, i + 1, e)


def add_all(xs: Column, ys: Column) -> Column:
    return F.concat(xs, ys)


def add_all_at(xs: Column, i: Column, ys: Column) -> Column:
    return F.concat(F.slice(xs, F.lit(1), i), ys, F.slice(xs, i + 1, F.greatest(F.size(xs) - i, F.lit(0))))


def clear(xs: Column) -> Column:
    return F.slice(xs, 1, 0)


def paired(xs: Column, ys: Column, e: Column) -> Column:
    """The element of ys at the place where e first stands in xs; null if it does not."""
    at = index_of(xs, e)
    return F.get(ys, F.when(at >= 0, at))


def remove_at(xs: Column, i: Column) -> Column:
    """Without the element at place i; a place that is null or outside takes nothing away."""
    return F.filter(xs, lambda x, k: ~k.eqNullSafe(i))


def remove_first(xs: Column, e: Column) -> Column:
    """Without the first element equal to e, if there is one."""
    return remove_at(xs, index_of(xs, e))


def remove_all(xs: Column, ys: Column) -> Column:
    """Without one occurrence for each element of ys; bags.remove_all is for long lists."""
    return F.aggregate(ys, xs, lambda acc, y: remove_first(acc, y))


def retain_all(xs: Column, ys: Column) -> Column:
    """The elements that ys has, null included; bags.retain_all is for long lists."""
    return F.filter(xs, lambda x: F.exists(ys, lambda y: y.eqNullSafe(x)))


def set_at(xs: Column, i: Column, e: Column) -> Column:
    return F.transform(xs, lambda x, k: F.when(k == i, e).otherwise(x))


def sub_list(xs: Column, start: Column, end: Column) -> Column:
    return F.slice(xs, start + 1, end - start)


def contains_all(xs: Column, ys: Column) -> Column:
    """Every element of ys is one of xs; array_except takes null for an element."""
    return F.size(F.array_except(ys, xs)) == 0
