"""What a tracked list does when a member is added: the member's bound row is used, or a new one made, and its columns set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.naming import by_length


def empty_entity(schema: T.StructType) -> Column:
    """A struct of typed nulls; nested structs are empty ones of theirs."""
    return F.struct(*((empty_entity(f.dataType) if isinstance(f.dataType, T.StructType) else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def construct(schemas: dict[str, T.StructType], **values: dict[str, Column]) -> list[Column]:
    """New entities to bind an object to, in order: empty ones with the given columns set."""
    out = []
    for name, schema in schemas.items():
        entity = empty_entity(schema)
        for field, value in values.get(name, {}).items():
            entity = entity.withField(field, value)
        out.append(entity.alias(name))
    return out


def member_rows(added: DataFrame, bound: DataFrame, key: str, columns: list[str], entities: list[str], schema: T.StructType, base: str = "base:") -> DataFrame:
    """added(key, ...) with `member`, the row to insert, and `created`.

    columns are the list mapping's paths; those that start with `base` say what goes into the member: the entity that
    stands at the same place in `entities` (columns of bound, which has a row of entity structs for a key). `base:` alone is
    the member itself, so its bound row is used; without one, or where a key is not bound, a new row is made. The other
    paths are set on it, the shortest first. Both sides meet by one equi-join.
    """
    own = [(entities[i], p[len(base) :]) for i, p in by_length(columns) if p.startswith(base)]
    both = added.join(bound.select(F.col(key).alias("_bound"), *entities), F.col(key) == F.col("_bound"), "left")
    itself = next((e for e, p in own if not p), None)
    there = F.col(itself).isNotNull() if itself else F.lit(False)
    member = F.when(there, F.col(itself)).otherwise(empty_entity(schema)) if itself else empty_entity(schema)
    for e, p in own:
        if p:
            member = member.withField(p, F.col(e))
    return both.select(*(added[c] for c in added.columns), member.alias("member"), (~there).alias("created"))
