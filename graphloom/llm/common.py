"""Shared pieces of the training-data operators: table access, word rules, hashing, staging."""

from __future__ import annotations

import binascii
import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.staging import shared_dir, staged  # noqa: F401

#: A word is a maximal run of characters other than ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"
#: A row is held out of every fit when crc32(doc_id as text) % HOLDOUT_MOD == 0.
HOLDOUT_MOD = 5


#: Rows of an Arrow batch: whole texts are kilobytes, so Spark's default of 10,000 rows holds tens of megabytes at each end.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def small_batches(spark: SparkSession) -> None:
    """Sets smaller Arrow batches where the session has Spark's default; results do not depend on it."""
    name, usual, rows = BATCH_ROWS
    if spark.conf.get(name, usual) == usual:
        spark.conf.set(name, rows)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, after which the worker, which Spark keeps for later tasks, gives free memory back."""

    @wraps(run)
    def released(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)

    return released


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_row(df: DataFrame, names: list[str] | None = None) -> Column:
    """Columns carried as one struct ``__row``, so that no name of theirs can clash with an operator's own."""
    return F.struct(*[df[f"`{c}`"].alias(c) for c in (df.columns if names is None else names)]).alias("__row")


def held_out(doc_id: Column) -> Column:
    """True for the rows whose crc32 remainder is 0; null ids count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HOLDOUT_MOD == 0, F.lit(True))


def held_out_py(doc_id: int) -> bool:
    return binascii.crc32(str(doc_id).encode()) % HOLDOUT_MOD == 0


def word_count(text: Column) -> Column:
    """Words of a text as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")
