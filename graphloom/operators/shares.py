"""Additive shares in the ring of integers modulo 2**64, as plain arithmetic (no privacy is claimed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import FRACTION_BITS, decode_fixed, encode_fixed, from_ring, ring, ring_add, to_ring

# Fixed values of a linear congruential rule for reproducible first shares.
MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407


def first_share(vid: Column, k: Column, seed: int = 0) -> Column:
    big = lambda x: x.cast("decimal(38,0)")
    a = big(vid) * F.lit(str(MULTIPLIER)).cast("decimal(19,0)")
    b = big(k) * F.lit(str(INCREMENT)).cast("decimal(19,0)")
    return F.pmod(a.cast("decimal(38,0)") + b.cast("decimal(38,0)") + F.lit(seed).cast("decimal(38,0)"), ring()).cast("decimal(38,0)")


def split(df: DataFrame, keys: tuple[str, str] = ("vid", "k"), value: str = "x", bits: int = FRACTION_BITS, seed: int = 0) -> DataFrame:
    """``df`` with share0 and share1, which add up to the encoded value in the ring."""
    s0 = first_share(F.col(keys[0]), F.col(keys[1]), seed)
    return df.withColumn("share0", s0).withColumn("share1", F.pmod(to_ring(encode_fixed(F.col(value), bits)) - F.col("share0"), ring()).cast("decimal(38,0)"))


def reconstruct(a: Column, b: Column, bits: int = FRACTION_BITS) -> Column:
    return decode_fixed(from_ring(ring_add(a, b)), bits)


def ring_sum(x: Column) -> Column:
    """The sum of residues as a residue: up to 10**18 of them stay inside the decimal."""
    return F.pmod(F.sum(x.cast("decimal(20,0)")).cast("decimal(38,0)"), ring()).cast("decimal(38,0)")


def ring_scale(x: Column, by: int) -> Column:
    """A residue times a small public integer."""
    return F.pmod((x.cast("decimal(20,0)") * F.lit(by).cast("decimal(10,0)")).cast("decimal(38,0)"), ring()).cast("decimal(38,0)")
