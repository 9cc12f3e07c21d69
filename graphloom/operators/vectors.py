"""Vector and matrix operators on array columns and in long form; everything stays in the JVM but the dense fast path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Matrix = list[list[float]]


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def added_where(a: Column, b: Column, cond: Column) -> Column:
    """a + b where ``cond`` holds and b is there, else a."""
    return F.when(cond & b.isNotNull(), added(a, b)).otherwise(a)


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def relu_gate(g: Column, z: Column) -> Column:
    """g where z is positive, else 0."""
    return F.zip_with(g, z, lambda x, y: F.when(y > 0, x).otherwise(F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def row_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def softmax(v: Column) -> Column:
    """Shifted by the largest component, so that no exponential overflows."""
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / row_sum(e))


def one_hot(label: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: (j == label).cast("double"))


def argmax(v: Column) -> Column:
    """The first place of the largest component."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def matrix_column(w: Matrix) -> Column:
    """A small matrix as a literal, transposed: one array for each output component."""
    return F.array(*[F.array(*[F.lit(float(x)) for x in col]) for col in zip(*w)])


def times_matrix(v: Column, w: Matrix) -> Column:
    """The row vector ``v`` times ``w``, in the JVM."""
    return F.transform(matrix_column(w), lambda col: dot(v, col))


def times_matrix_dense(df: DataFrame, col: str, w: Matrix, out: str) -> DataFrame:
    """The same over whole Arrow batches in numpy, for wide layers; ``w`` is as large as the model, whatever the input."""
    weights = df.sparkSession.sparkContext.broadcast(np.array(w, float))
    names = [c for c in df.columns if c not in (col, out)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b[col].to_list()) if len(b) else np.empty((0, len(weights.value)))
            yield b[names].assign(**{out: list(x @ weights.value)})

    schema = ", ".join([*(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names), f"`{out}` array<double>"])
    return df.select(*names, col).mapInPandas(run, schema)


def long_form(df: DataFrame, col: str, keys: list[str], value: str = "value", digits: int | None = 6) -> DataFrame:
    """A row per component: keys, k and the value, rounded for comparison."""
    out = df.select(*keys, F.posexplode(col).alias("k", value))
    return out.withColumn(value, F.round(value, digits) + F.lit(0.0)) if digits is not None else out


def transposed(df: DataFrame) -> DataFrame:
    """A long-form matrix (i, j, w) with its indices swapped; nothing moves."""
    return df.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")


def matmul_long(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, w) of two long-form matrices: join on the inner index, sum the products."""
    left = a.select("i", F.col("j").alias("__m"), F.col("w").alias("__a"))
    right = b.select(F.col("i").alias("__m"), "j", F.col("w").alias("__b"))
    return left.join(right, "__m").groupBy("i", "j").agg(F.sum(F.col("__a") * F.col("__b")).alias("w"))


def sum_vectors(df: DataFrame, keys: list[str], col: str, width: int, extra: list[Column] | None = None) -> DataFrame:
    """Componentwise sums per key: one partial aggregate for each component, so hubs combine before the shuffle."""
    sums = [F.sum(F.col(col)[k]).alias(f"__{k}") for k in range(width)]
    grouped = df.groupBy(*keys).agg(*sums, *(extra or []))
    rest = [c for c in grouped.columns if not c.startswith("__")]
    return grouped.select(*rest, F.array(*[F.col(f"__{k}") for k in range(width)]).alias(col))


def outer_sums(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, i, j, w): per key the sum of the outer products of two vectors.

    Each task adds its rows up in numpy, so only one matrix per task and key is shuffled.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for t, g in b.groupby(key):
                m = np.stack(g[left].to_list()).T @ np.stack(g[right].to_list())
                held[t] = held[t] + m if t in held else m
        for t, m in held.items():
            i, j = np.indices(m.shape)
            yield pd.DataFrame({key: t, "i": i.ravel(), "j": j.ravel(), "w": m.ravel()})

    return df.select(key, left, right).mapInPandas(partial, f"{key} long, i long, j long, w double").groupBy(key, "i", "j").agg(F.sum("w").alias("w"))


def glorot_weights(rows: int, cols: int) -> Matrix:
    """Deterministic weights inside the Glorot limit, from an arithmetic rule that SQL can repeat."""
    limit = (6.0 / (rows + cols)) ** 0.5
    return [[limit * (2 * ((i * 31 + j * 17 + 7) % 101) / 100.0 - 1) for j in range(cols)] for i in range(rows)]
