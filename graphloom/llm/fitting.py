"""Bounded labelled samples for the classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int, max_chars: int, text: str = "text", label: str = "quality", key: str = "doc_id") -> list[tuple[str, int]]:
    """About ``bound`` (text, label) pairs of rows outside the held-out fifth, the same on every run.

    A hash range of the labels, sized from their exact count, picks the rows; ``max_chars`` bounds what
    a single training text may hold. Only this sample reaches the driver.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("__k"), F.col(label).alias("__y"))
    n = known.count()
    unit = F.xxhash64("__k", F.lit(29)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    picked = known.where(unit * n < bound).select("__k", "__y").distinct()
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("__k"), F.substring(text, 1, max_chars).alias("__t")).join(picked, "__k")
    return [(r["__t"], r["__y"]) for r in sorted(rows.collect(), key=lambda r: (r["__k"], r["__y"], r["__t"]))]
