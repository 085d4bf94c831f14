"""Keys of methods from the forms in which a method is given: raw names, reflection, serialized lambdas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.naming import dotted

#: Fixed: the class-file format's letters of primitive types.
PRIMITIVES = {"void": "V", "boolean": "Z", "byte": "B", "char": "C", "short": "S", "int": "I", "long": "J", "float": "F", "double": "D"}


def type_descriptor(name: Column) -> Column:
    """`int` to I, `a.B` to La/B;, with a [ for every trailing []."""
    base = F.replace(name, F.lit("[]"), F.lit(""))
    letters = F.create_map(*[F.lit(x) for pair in PRIMITIVES.items() for x in pair])
    dims = F.repeat(F.lit("["), ((F.length(name) - F.length(base)) / 2).cast("int"))
    return F.concat(dims, F.coalesce(F.try_element_at(letters, base), F.concat(F.lit("L"), F.translate(base, ".", "/"), F.lit(";"))))


def method_descriptor(params: Column, returns: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(params, type_descriptor), ""), F.lit(")"), type_descriptor(returns))


def method_key(owner: Column, name: Column, descriptor: Column) -> Column:
    return F.struct(dotted(owner).alias("owner"), name.alias("name"), descriptor.alias("descriptor"))


def reflected_key(declaring: Column, name: Column, params: Column, returns: Column) -> Column:
    return method_key(declaring, name, method_descriptor(params, returns))


def lambda_key(impl_class: Column, impl_name: Column, impl_signature: Column) -> Column:
    return method_key(impl_class, impl_name, impl_signature)
