"""What the two vector searches share: valid rows, and a grid of blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.llm import common


def finite(vec: Column) -> Column:
    """Neither null, empty nor with a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vec) > 0) & ~F.exists(vec.cast("array<double>"), bad), F.lit(False))


def numbered(df: DataFrame, id_col: str, vec: Column, query: Column, label: str) -> tuple[DataFrame, int, int]:
    """Staged rows (id, v, query, row) and how many there are, and queries. The number
    ``row`` is written with them, so that all who read it see the same."""
    held = df.select(F.col(id_col).alias("id"), vec.alias("v"), F.coalesce(query, F.lit(False)).alias("query")).where(F.col("id").isNotNull())
    held = common.stage(held.withColumn("row", F.monotonically_increasing_id()), label)
    n, q = held.agg(F.count(F.lit(1)), F.count_if("query")).first()
    return held, n, q


def matrix(col: pa.ChunkedArray, dtype) -> np.ndarray:
    """Rows of an array column that are equally long."""
    flat = pa.concat_arrays([c.flatten() for c in col.chunks]) if col.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(col), -1) if len(col) else np.zeros((0, 0), dtype)


def best(found: DataFrame, id_col: str, k: int) -> DataFrame:
    """The k best of each query row by (score descending, id)."""
    w = Window.partitionBy("qrow").orderBy(F.col("score").desc(), "id", "row")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def blocks_of(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))
