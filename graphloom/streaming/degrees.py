"""Degrees of a growing edge stream, kept by Structured Streaming; the batch results stay in operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("weight", T.LongType())])


def edge_stream(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of edges as a stream."""
    return spark.readStream.schema(EDGE).parquet(path)


def streaming_degrees(edges: DataFrame) -> DataFrame:
    """(vid, out_degree, in_degree) so far, for update or complete mode."""
    ends = F.array(F.struct(F.col("src").alias("vid"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("vid"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return edges.select(F.explode(ends).alias("x")).groupBy("x.vid").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))
