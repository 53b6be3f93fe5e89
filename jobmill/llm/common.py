"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, scratch_path

#: White space of the contracts: the space and \x09-\x0D.
WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same lower-casing for Python strings: A-Z only.
TO_LOWER = str.maketrans(UPPER, LOWER)
#: A missing id orders after every real one.
NO_ID = 2**63 - 1


def lower_az(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: cuts the lineage,
    survives lost executors, and lets several consumers share the work."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    # shuffle files go when the driver's garbage is collected: the plans written before are garbage now
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for d in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(d)
        path.getFileSystem(conf).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has about ``max_bytes`` of text (at least one row):
    memory then follows the slice, not the number of rows in a batch."""
    for b in batches:
        if not b.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0)
        part = np.cumsum(n.to_numpy(zero_copy_only=False).astype(np.int64)) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            yield b.slice(a, z - a)


def each(texts: pa.Array, max_bytes: int = 4 << 20) -> Iterator[str | None]:
    """The texts of an array, made into Python strings about ``max_bytes`` at a time."""
    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(n) // max_bytes)) + 1).tolist(), len(texts)]
    for a, z in zip(cuts, cuts[1:]):
        yield from texts.slice(a, z - a).to_pylist()


def column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over an array of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def group_apart(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Group by ``keys`` under another name, so that a later join on the keys gets an
    exchange of its own on both sides: adaptive execution can split a hot key only then."""
    out = df.groupBy(F.struct(*keys).alias("_by")).agg(*aggs)
    return out.select(*[F.col("_by")[k].alias(k) for k in keys], *[c for c in out.columns if c != "_by"])


class Memo(dict):
    """A dictionary that fills itself by ``make`` and starts afresh at ``limit`` entries,
    so that a worker's memory does not grow with the words it has seen."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


__all__ = ["WS", "UPPER", "LOWER", "TO_LOWER", "NO_ID", "lower_az", "staged", "drop_staged",
           "slices", "each", "column", "mixed", "Memo", "read_table", "SparkSession"]
