"""What the operators share: scratch tables in the cluster's shared folder, ids and hashing."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from regolith.scratch import shared_dir, stored

__all__ = ["discard", "mixed", "refuse_clash", "released", "shared_dir", "small_batches", "stored", "table", "tidied"]


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables made by stored() that nothing will read again."""
    jvm = spark.sparkContext._jvm
    for t in tables:
        for f in {x.rsplit("/", 1)[0] for x in t.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


Batches = Iterator[pa.RecordBatch]


def released() -> None:
    """Gives memory that a Python worker no longer uses back to the system; workers are used again by later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


#: Settings of the batches that go to Python workers, with Spark's defaults: with whole texts in them, the JVM and the
#: worker hold a batch several times over, outside the heap.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def small_batches(spark: SparkSession) -> None:
    """Makes the session's batches for Python workers smaller, where they are as large as by default."""
    for name, (default, small) in BATCHES.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, small)


def tidied(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function for mapInArrow that leaves no unused memory in its worker when a partition ends."""

    @functools.wraps(run)
    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            released()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def refuse_clash(kept: list[str], made: list[str]) -> None:
    """Raises a ValueError if a column that stays has the name of one that is made (names differ by more than case)."""
    if both := {c.lower() for c in kept} & {c.lower() for c in made}:
        raise ValueError(f"columns {sorted(both)} are made here; rename those of the input")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
