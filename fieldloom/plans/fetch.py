"""Reading an entity with the columns that the caller's code will need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.naming import method_text
from fieldloom.operators import callgraph
from fieldloom.plans.checkpoints import large


def caller_fields(frames: DataFrame, methods: DataFrame, lines: DataFrame, insns: DataFrame, classes: DataFrame, roles: list[str]) -> DataFrame:
    """(root, owner, field): fields that the methods called from frames(class_name, method_name, line) read, in the end.

    A frame becomes a method; its calls of methods that classes of the roles declare are closed over the call graph, and fields read
    there, of classes with a role, are the plan. root is the frame's method. Facts are those of classfile.tables.
    """
    named = large(methods.join(large(classes.select("class_id", "class_name", "annotations")), "class_id"))
    text = method_text(F.col("class_name"), F.col("method_name"), F.col("method_desc"))
    key = ["class_id", "method_ord"]
    at = large(lines).join(named.select(*key, "class_name", "method_name"), key).select("class_name", "method_name", "method_ord", "line")
    caller = callgraph.resolve_frames(frames, at, ["class_name", "method_name"]).join(large(named.select("class_name", "method_name", "method_ord", text.alias("caller"))), ["class_name", "method_name", "method_ord"]).select("caller").distinct()
    every = large(insns).join(named.select(*key, text.alias("caller")), key)
    edges = callgraph.edges(every).select("caller", method_text(F.col("callee.owner"), F.col("callee.name"), F.col("callee.descriptor")).alias("callee"))
    role = F.arrays_overlap("annotations", F.array(*map(F.lit, roles)))
    declared = named.where(role).select(text.alias("callee")).distinct()
    direct = edges.join(large(caller), "caller").join(large(declared), "callee", "left_semi").select("caller", "callee").distinct()
    reached = callgraph.closure(edges, direct.select(F.col("callee").alias("root")))
    return direct.withColumnRenamed("callee", "root").join(large(callgraph.fetch_plan(reached, every, classes, roles)), "root").select(F.col("caller").alias("root"), "owner", "field").distinct()


def projection(entity: DataFrame, paths: list[str]) -> list[Column]:
    """Columns of the entity with these dotted paths and no others, in their nesting: the paths form a prefix tree, and a path takes in all below it.

    Structs become smaller structs, lists of structs are put together from the lists of their fields, so the scan reads the planned
    fields alone (a null element of a list comes back as a struct of nulls; a list within a list is read whole). A path that the entity doesn't have is an error.
    """
    tree: dict = {}
    for p in sorted(paths):
        at = tree
        for s in p.split("."):
            at = at.setdefault(s, {})
        at[""] = {}  # a whole field

    def part(c: Column, kind: T.DataType, want: dict, path: str) -> Column:
        if "" in want:
            return c
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if not isinstance(inner, T.StructType):
            raise ValueError(f"{path} has no fields")
        missing = [x for x in want if x not in inner.names]
        if missing:
            raise ValueError(f"no field {path}.{missing[0]}")
        if isinstance(kind, T.ArrayType):
            fields = [part(c.getField(x), T.ArrayType(inner[x].dataType), want[x], f"{path}.{x}").alias(x) for x in inner.names if x in want]
            return F.arrays_zip(*fields)
        return F.when(c.isNotNull(), F.struct(*(part(c.getField(x), inner[x].dataType, want[x], f"{path}.{x}").alias(x) for x in inner.names if x in want)))

    missing = [x for x in tree if x not in entity.columns]
    if missing:
        raise ValueError(f"no field {missing[0]}")
    return [part(F.col(c), entity.schema[c].dataType, tree[c], c).alias(c) for c in entity.columns if c in tree]


def load(entity: DataFrame, key: str, plan: DataFrame, owner: str, column_of: dict[str, str] | None = None) -> DataFrame:
    """The entity's key and what the plan's fields of the owner are mapped to: columns or dotted paths in them (by name without a mapping).

    The plan is collected: it has at most as many rows as the mapping. Only the planned fields reach the scan's schema.
    """
    column_of = column_of or {c: c for c in entity.columns}
    wanted = {r["field"] for r in plan.where((F.col("owner") == owner) & F.col("field").isin(*column_of)).select("field").distinct().collect()}
    return entity.select(*projection(entity, [key, *(p for f, p in column_of.items() if f in wanted)]))
