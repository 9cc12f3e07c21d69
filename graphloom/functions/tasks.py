"""The two-operand task algebra of vertex programs as Column expressions; a result replaces the first operand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.scalars import FRACTION_BITS, safe_divide
from graphloom.operators import vectors as V
from graphloom.operators.shares import reconstruct


def add(a: Column, b: Column) -> Column:
    return a + b


def add_pair(a: Column, b: Column) -> Column:
    """Structs (value, count), added part by part; either may be public."""
    return F.struct((a["value"] + b["value"]).alias("value"), (a["count"] + b["count"]).alias("count"))


def min_with_parent(a: Column, b: Column) -> Column:
    """The struct (value, parent) of the smaller value; equal values keep the first."""
    return F.when(b["value"] < a["value"], b).otherwise(a)


def replace_parent(a: Column, parent: Column) -> Column:
    return F.struct(a["value"].alias("value"), parent.alias("parent"))


def add_with_replaced_parent(a: Column, weight: Column, parent: Column) -> Column:
    return F.struct((a["value"] + weight).alias("value"), parent.alias("parent"))


def divide(a: Column, b: Column) -> Column:
    return safe_divide(a, b)


def swap(a: Column, b: Column) -> Column:
    """The operands as a struct in the other order."""
    return F.struct(b.alias("first"), a.alias("second"))


def reveal(share0: Column, share1: Column, bits: int = FRACTION_BITS) -> Column:
    return reconstruct(share0, share1, bits)


def reveal_pair(a: Column, b: Column, bits: int = FRACTION_BITS) -> Column:
    """Structs of two shares each, revealed part by part."""
    return F.struct(reveal(a["first"], b["first"], bits).alias("first"), reveal(a["second"], b["second"], bits).alias("second"))


def vector_scale(v: Column, s0: Column, s1: Column) -> Column:
    return V.scaled(V.scaled(v, s0), s1)


def vector_add(a: Column, b: Column) -> Column:
    return V.added(a, b)


def masked(result: Column, operand: Column, mask: Column) -> Column:
    """The result where the mask holds, else the first operand as it was."""
    return F.when(mask, result).otherwise(operand)


def all_agree(flag: Column) -> Column:
    """Aggregate: whether every row's flag holds, as at a barrier."""
    return F.bool_and(flag)
