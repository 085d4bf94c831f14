"""Names: internal to dotted class names, accessors to properties, path parsing, blank test."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def dotted(name: Column) -> Column:
    return F.translate(name, "/", ".")


def _rest(name: Column, skip: int) -> Column:
    return F.concat(F.lower(F.substring(name, skip + 1, 1)), F.substr(name, F.lit(skip + 2)))


def accessor_property(name: Column) -> Column:
    """The property that a getX, isX or setX call touches, else null. The first rule that fits decides."""
    n = F.length(name)
    return F.when(name.startswith("get") & (n > 3), _rest(name, 3)).when(name.startswith("is") & (n > 2), _rest(name, 2)).when(name.startswith("set") & (n > 3), _rest(name, 3))


def accessor_kind(name: Column) -> Column:
    """R or W for accessors, else null."""
    n = F.length(name)
    return F.when((name.startswith("get") & (n > 3)) | (name.startswith("is") & (n > 2)), "R").when(name.startswith("set") & (n > 3), "W")


def method_text(owner: Column, name: Column, desc: Column) -> Column:
    return F.concat(owner, F.lit("."), name, desc)


def is_blank(c: Column) -> Column:
    """Null, or no character that is not Unicode white space."""
    return F.coalesce(~c.rlike(r"(?U)[^\s]"), F.lit(True))


def by_length(paths: list[str]) -> list[tuple[int, str]]:
    """Paths with their places, the shortest first; equal lengths stay in order."""
    return sorted(enumerate(paths), key=lambda x: len(x[1]))


def joined(xs: Column) -> Column:
    return F.array_join(xs, ", ")


def split_path(path: str, objects: list[str]) -> tuple[int, list[str]]:
    """`name:a.b` to (number of the object, segments).

    Without a colon it is object 0; a name in `objects` goes before the positional form a<N>; a blank
    path is the object itself.
    """
    head, colon, tail = path.partition(":")
    at = 0
    if colon:
        if head in objects:
            at = objects.index(head)
        elif m := re.fullmatch(r"a(\d+)", head):
            at = int(m[1])
        else:
            raise ValueError(f"entity name not found: {head}")
    else:
        tail = path
    return at, [x for x in tail.split(".")] if tail.strip() else []
