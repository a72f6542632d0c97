"""Shared by the operators: tables, workers' memory and bounded samples."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches; when they end, the worker, which Spark keeps for later tasks, gives back what it no longer needs."""
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not this C library
            pass


def unit_hash(col: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the column's value and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(col)), 11) / float(1 << 53)


def crc_mod(col: str, m: int) -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary")) % m

