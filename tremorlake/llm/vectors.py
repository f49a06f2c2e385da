"""Embedding vectors as exact integers, shared by the operators on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm.common import find_on_workers

#: Integer components stay below this, so that products of vectors of up to 64 components fit 64 bits.
LIMIT = 1 << 27


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    find_on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def usable(vector: Column) -> Column:
    """Is it a vector without a null, NaN or infinite component?"""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def floored(vector: Column, scale: int) -> Column:
    """Components as integers floor(scale * x), x as double; one of ``LIMIT`` or more ends the job with a message."""
    def one(x: Column) -> Column:
        y = F.floor(x.cast("double") * F.lit(float(scale)))
        return F.when(F.abs(x.cast("double") * F.lit(float(scale))) < F.lit(float(LIMIT)), y.cast("int")).otherwise(
            F.raise_error(F.lit(f"a component times {scale} is not below {LIMIT}")).cast("int"))
    return F.transform(vector, one)


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """A list column without nulls as a matrix of 64-bit integers."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), dims)
