"""Declared mappings of domain fields to entity structs, compiled once to columns.

A domain object is bound to one or more entity columns; a field's mapping is one of `Field`, `Fields`,
`ListFields`, `PolyFields` and `PolyListFields`. Paths are `object:a.b`; in lists, `base:a.b` starts at the
list's element.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.choice import Rule, column_for, last_non_null
from fieldloom.functions.naming import split_path


@dataclass(frozen=True)
class Field:
    """One path; wrap makes a domain struct of a value that is not null."""

    path: str = ""
    wrap: str | None = None


@dataclass(frozen=True)
class Fields:
    """A struct of several paths, none of which may be null."""

    paths: dict[str, str]


@dataclass(frozen=True)
class ListFields:
    base: str
    paths: dict[str, str]


@dataclass(frozen=True)
class Poly:
    """A path, or one for each type."""

    path: str = ""
    by_type: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class PolyFields:
    candidates: dict[str, str]
    columns: dict[str, Poly]
    rule: Rule = last_non_null


@dataclass(frozen=True)
class PolyListFields:
    base: str
    candidates: dict[str, str]
    columns: dict[str, Poly]
    rule: Rule = last_non_null


#: Which mapping of a field counts where one may have several, the first first.
PRECEDENCE = (Field, Fields, ListFields, PolyFields, PolyListFields)


def effective(mappings: list, name: str = "", strict: bool = True):
    """A field's mapping: the only one, or by precedence if not strict; without one, the column of the field's name."""
    for m in mappings:
        if not isinstance(m, PRECEDENCE):
            raise TypeError(f"not a mapping: {m!r}")
    if strict and len(mappings) > 1:
        raise ValueError(f"{name or 'a field'} has {len(mappings)} mappings")
    return min(mappings, key=lambda m: PRECEDENCE.index(type(m))) if mappings else name


def is_basic(kind: T.DataType) -> bool:
    """Types whose values are taken as they are; lists, maps, binaries and structs belong to domain objects."""
    return isinstance(kind, (T.BooleanType, T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.TimeType))


def declared(kind: T.DataType, path: str = "") -> Field:
    """The mapping of a domain field of this type: a basic value is taken as it is, any other becomes a struct around the value, named as its first field."""
    if is_basic(kind):
        return Field(path)
    if not isinstance(kind, T.StructType) or not kind.names:
        raise TypeError(f"{kind.simpleString()} cannot hold a single value")
    return Field(path, kind.names[0])


def _walk(c: Column, segments: list[str]) -> Column:
    for s in segments:
        c = c.getField(s)
    return c


@dataclass(frozen=True)
class Binding:
    """Names and columns of the entities that a domain object is bound to."""

    names: list[str]
    columns: list[Column]

    def get(self, path: str, element: Column | None = None) -> Column:
        if element is not None and path.startswith("base:"):
            return _walk(element, split_path(path[5:], [])[1])
        at, segments = split_path(path, self.names)
        if at >= len(self.columns):
            raise ValueError(f"no entity {at}")
        return _walk(self.columns[at], segments)

    def _whole(self, paths: dict[str, str], element: Column | None = None) -> Column:
        return F.struct(*(_not_null(self.get(p, element), n).alias(n) for n, p in paths.items()))

    def _poly(self, m: PolyFields | PolyListFields, element: Column | None = None) -> Column:
        types = list(m.candidates)
        chosen = m.rule([self.get(p, element) for p in m.candidates.values()], types)
        out = [chosen.alias("type")]
        for n, p in m.columns.items():
            c = self.get(p.path, element) if p.path or not p.by_type else column_for(chosen, list(p.by_type), [self.get(x, element) for x in p.by_type.values()])
            out.append(c.alias(n))
        return F.struct(*out)

    def read(self, mapping) -> Column:
        match mapping:
            case str():
                return self.get(mapping)
            case Field():
                c = self.get(mapping.path)
                return c if mapping.wrap is None else F.when(c.isNotNull(), F.struct(c.alias(mapping.wrap)))
            case Fields():
                return self._whole(mapping.paths)
            case ListFields():
                return F.transform(self.get(mapping.base), lambda x: self._whole(mapping.paths, x))
            case PolyFields():
                return self._poly(mapping)
            case PolyListFields():
                return F.transform(self.get(mapping.base), lambda x: self._poly(mapping, x))
        raise TypeError(f"not a mapping: {mapping!r}")

    def write(self, mapping, value: Column, on_null: str = "keep", empty: bool = False) -> Column:
        """The changed entity column. A null value changes nothing unless on_null is "set"."""
        if isinstance(mapping, (ListFields, PolyListFields)) and empty:
            return self.get(mapping.base)
        if not isinstance(mapping, (str, Field)):
            raise NotImplementedError(f"{type(mapping).__name__} cannot be set")
        path = mapping if isinstance(mapping, str) else mapping.path
        at, segments = split_path(path, self.names)
        if not segments:
            raise ValueError("a whole entity cannot be set")
        old, entity = self.get(path), self.columns[at]
        parent = _walk(entity, segments[:-1])
        there = F.when(parent.isNull(), F.raise_error(F.lit(f"nothing to set {path} in"))).otherwise(F.lit(True))
        new = value if on_null == "set" else F.coalesce(value, old)
        return F.when(there.cast("boolean"), entity.withField(".".join(segments), new))


def _not_null(c: Column, name: str) -> Column:
    return F.coalesce(c, F.raise_error(F.lit(f"{name} is null")))
