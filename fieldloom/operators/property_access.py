"""Which properties each method of a kept class reads and writes, and which own methods it calls.

Facts: classes(class_id, class_name, annotations), methods(class_id, method_ord, method_name, method_desc),
insns(class_id, method_ord, insn_ord, kind, opcode, owner, name, descriptor); names are dotted. Two inputs
that hold the same class keep two class_ids and are reported twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.naming import accessor_kind, accessor_property
from fieldloom.plans.checkpoints import large

#: Fixed: opcodes of the class-file format.
GETFIELD, PUTFIELD = 180, 181
CONSTRUCTORS = ("<init>", "<clinit>")


def kept_classes(classes: DataFrame, roles: list[str]) -> DataFrame:
    return classes.where(F.arrays_overlap("annotations", F.array(*map(F.lit, roles))))


def facts(classes: DataFrame, insns: DataFrame, roles: list[str], strict: bool = False) -> DataFrame:
    """(class_id, method_ord, kind R/W/C, name, descriptor, n): what each method does to its own class."""
    own = insns.join(large(kept_classes(classes, roles).select("class_id", "class_name")), "class_id").where(F.col("owner") == F.col("class_name"))
    key = ["class_id", "method_ord"]
    fields = own.where((F.col("kind") == "FIELD") & F.col("opcode").isin(GETFIELD, PUTFIELD))
    fields = fields.select(*key, F.when(F.col("opcode") == GETFIELD, "R").otherwise("W").alias("kind"), "name", F.lit("").alias("descriptor"), F.lit(1).alias("n"))
    calls = own.where((F.col("kind") == "CALL") & ~F.col("name").isin(*CONSTRUCTORS))
    inferred = calls.select(*key, accessor_kind(F.col("name")).alias("kind"), accessor_property(F.col("name")).alias("name"), F.lit("").alias("descriptor"), F.lit(1).alias("n")).where("kind IS NOT NULL")
    if strict:
        known = insns.where("kind = 'FIELD'").select("class_id", "name").distinct()
        inferred = inferred.join(known, ["class_id", "name"], "left_semi").select(fields.columns)
    calls = calls.select(*key, F.lit("C").alias("kind"), "name", "descriptor", F.lit(1).alias("n"))
    every = fields.unionByName(inferred).unionByName(calls)
    return every.groupBy(*key, "kind", "name", "descriptor").agg(F.when(F.col("kind") == "C", F.sum("n")).otherwise(F.lit(1)).cast("long").alias("n"))


def methods_report(classes: DataFrame, methods: DataFrame, insns: DataFrame, roles: list[str], strict: bool = False) -> DataFrame:
    """One row for each method that does anything: reads, writes and calls as sorted arrays."""
    pick = lambda k, c: F.sort_array(F.collect_list(F.when(F.col("kind") == k, c)))
    call = F.struct(F.col("name").alias("method_name"), F.col("descriptor").alias("method_desc"), F.col("n").alias("call_count"))
    rows = facts(classes, insns, roles, strict).groupBy("class_id", "method_ord").agg(pick("R", F.col("name")).alias("reads"), pick("W", F.col("name")).alias("writes"), pick("C", call).alias("calls"))
    return rows.join(large(methods.select("class_id", "method_ord", "method_name", "method_desc")), ["class_id", "method_ord"])


def classes_report(classes: DataFrame, methods: DataFrame, insns: DataFrame, roles: list[str]) -> DataFrame:
    """One row for each kept class, with its methods in order."""
    rows = methods_report(classes, methods, insns, roles)
    listed = rows.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("method_ord", "method_name", "method_desc", "reads", "writes", "calls"))).alias("methods"))
    kept = kept_classes(classes, roles).select("class_id", "class_name", F.lit(True).alias("is_aggregate_root"))
    return kept.join(large(listed), "class_id", "left").withColumn("methods", F.coalesce("methods", F.slice(F.array(F.lit(None).cast(listed.schema["methods"].dataType.elementType)), 1, 0)))
