"""What all operators of the subpackage use: staged tables, and columns that go through."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from factweave.staging import released, small, work_dir, written  # noqa: F401  used throughout the subpackage


@contextmanager
def uncollected() -> Iterator[None]:
    """Without Python's search for cyclic garbage: for steps that make many small values and no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


@contextmanager
def batches_of(spark: SparkSession, most: int) -> Iterator[None]:
    """What is executed meanwhile hands Python batches of at most some `most` bytes (one row at least), not of 10,000 rows however long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


_loaders: list = []


def loader(cached):
    """Makes known a cached function whose values a Python worker holds from task to task."""
    _loaders.append(cached)
    return cached


def let_go(*but) -> None:
    """At the start of a task: a Python worker serves one stage after the other, so what the loaders other than `but` hold of earlier ones goes, and free memory, which the
    C library and Arrow keep, goes back to the system."""
    away = [x for x in _loaders if x not in but and x.cache_info().currsize]
    for x in away:
        x.cache_clear()
    if away:
        gc.collect()  # an encoder and its memo name each other
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def carried(keep: list[str] | None, *own: str) -> tuple[Column, list[Column]]:
    """The columns that go through an operator (doc_id unless named): as a struct _row, and as the columns to select from it at the end.

    One with the name of a result is called <name>_in, or <name>_in_in if that is taken too, and so on.
    """
    keep = ["doc_id"] if keep is None else keep
    taken, names = {*own, *(c.lower() for c in keep)}, {}
    for c in keep:
        names[c] = c
        if c.lower() in own:
            while names[c].lower() in taken:
                names[c] += "_in"
            taken.add(names[c].lower())
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()]).alias("_row")
    return row, [F.col(f"_row.`{n}`") for n in names.values()]
