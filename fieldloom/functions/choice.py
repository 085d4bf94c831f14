"""The default rule for polymorphic fields: the type of the last candidate that is not null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A rule makes the chosen type's name from the candidates and their type names.
Rule = Callable[[list[Column], list[str]], Column]


def last_or_null(candidates: list[Column], types: list[str]) -> Column:
    """The type of the last candidate that is not null, null where there is none."""
    return F.coalesce(*(F.when(c.isNotNull(), F.lit(t)) for c, t in reversed(list(zip(candidates, types, strict=True)))))


def last_non_null(candidates: list[Column], types: list[str]) -> Column:
    """The same; without a candidate it is an error."""
    return F.coalesce(last_or_null(candidates, types), F.raise_error(F.lit("no candidate is set")).cast("string"))


def column_for(chosen: Column, types: list[str], columns: list[Column]) -> Column:
    """The column that belongs to the chosen type."""
    out = F.when(chosen == types[0], columns[0])
    for t, c in zip(types[1:], columns[1:], strict=True):
        out = out.when(chosen == t, c)
    return out
