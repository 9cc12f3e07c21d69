"""Scalar functions of the engine as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fractional bits of the fixed-point encoding; a parameter everywhere.
FRACTION_BITS = 16


def ring() -> Column:
    return F.lit("18446744073709551616").cast("decimal(38,0)")


def inverse_root(degree: Column) -> Column:
    """0 for degree 0, else (degree + 1) ** -0.5."""
    return F.when(degree == 0, F.lit(0.0)).otherwise(F.pow(degree + 1, F.lit(-0.5)))


def inverse_root_legacy(degree: Column) -> Column:
    """0 for degree 0, else degree ** -0.5."""
    return F.when(degree == 0, F.lit(0.0)).otherwise(F.pow(F.greatest(degree, F.lit(1)), F.lit(-0.5)))


def encode_fixed(x: Column, bits: int = FRACTION_BITS) -> Column:
    """Fixed point by truncation, as a signed long."""
    return (x * float(1 << bits)).cast("long")


def decode_fixed(x: Column, bits: int = FRACTION_BITS) -> Column:
    return x.cast("double") / float(1 << bits)


def to_ring(x: Column) -> Column:
    """A signed integer as its residue modulo 2**64."""
    return F.pmod(x.cast("decimal(38,0)"), ring())


def from_ring(x: Column) -> Column:
    """A residue as the signed long it stands for."""
    return F.when(x >= F.lit("9223372036854775808").cast("decimal(38,0)"), x - ring()).otherwise(x).cast("long")


def ring_add(a: Column, b: Column) -> Column:
    return F.pmod(a + b, ring()).cast("decimal(38,0)")


def next_power_of_two(n: Column) -> Column:
    """The least power of two that is at least n; 1 for n below 2."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double")))).cast("long")


def integer_log2(n: Column) -> Column:
    """The place of the highest bit; 0 for 0."""
    return F.when(n == 0, F.lit(0)).otherwise(F.length(F.bin(n)) - 1).cast("long")


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def tokens(text: Column, delimiters: str) -> Column:
    """The non-empty pieces between runs of any of the delimiters."""
    inside = "".join(f"\\{c}" if c in "\\]^-[" else c for c in delimiters)
    return F.filter(F.split(text, f"[{inside}]+"), lambda t: t != "")


def modulo_tile(vid: Column, tiles: int) -> Column:
    return F.pmod(vid, F.lit(tiles)).cast("long")


def merged_tile(tid: Column, factor: int) -> Column:
    return F.floor(tid / F.lit(factor)).cast("long")


def next_party(t: Column, parties: int) -> Column:
    return F.pmod(t + 1, F.lit(parties))


def previous_party(t: Column, parties: int) -> Column:
    return F.pmod(t - 1, F.lit(parties))


def megabytes(n: Column) -> Column:
    """Bytes as text in MB with two decimals, null for null; the double's exact value is rounded, ties to the even digit, as C's printf does.

    ``format_string`` rounds the double's shortest text and ties up; it writes only 2 ** 63 MB and more, and NaN.
    """
    x = n / F.lit(1048576.0)
    size, negative = F.abs(x), (x < 0) | ((x == 0) & x.cast("string").startswith("-"))
    # the fraction alone keeps all its digits in the text; the whole part is exact as a long
    cents = F.call_function("format_number", size - F.floor(size), F.lit("0.00")).cast("decimal(3,2)")
    exact = F.concat(F.when(negative, "-").otherwise(""), (F.floor(size).cast("decimal(19,0)") + cents).cast("string"), F.lit("MB"))
    return F.when(size < 2.0**63, exact).when(x.isNotNull(), F.format_string("%.2fMB", x))


def uniform(seed: int, low: float, high: float) -> Column:
    return F.rand(seed) * (high - low) + low


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def kernel_name(code: Column) -> Column:
    """Tag of a program family by its code: 0 edge-centric, 1 vertex-centric."""
    return F.when(code == 0, "edge_centric").when(code == 1, "vertex_centric").otherwise("unknown")
