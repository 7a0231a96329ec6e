"""Helpers that every corpus operator shares."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.plans.durable import ready, shared_dir, written

__all__ = ["ready", "released", "shared_dir", "table", "text_or_empty", "trim", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data; every operator also takes any other DataFrame."""
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def trim() -> None:
    """Gives freed memory of this process back."""
    pa.default_memory_pool().release_unused()
    malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if malloc_trim is not None:
        malloc_trim(0)


def released(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """Gives a task's memory back when it ends: Spark keeps Python workers, and their free memory would add up."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        trim()

    return run
