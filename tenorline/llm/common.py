"""What the operators of this folder share: reading tables, shared storage, and Arrow helpers for tasks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder that has the package; a cluster also needs it installed or shipped with --py-files.
ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of one Arrow batch that Spark hands to Python; rows are not cut, a longer row is a batch of its own.
BATCH_BYTES = 2 << 20
#: Most bits of a Bloom filter (16 MB); with more keys than a fourth of that it would let too much through.
FILTER_BITS = 1 << 27


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of a data folder; Spark opens the path, so any file system that it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that a task never holds more than a few long texts at once, and let Python workers find this package."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where that is unset; on a cluster, a warehouse on local disks is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        if not spark.sparkContext.master.startswith("local") and base.startswith(("/", "file:")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a short lineage that outlives lost executors. (The default codec keeps direct buffers for each column of each file.)"""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of materialize() that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filter_of(keys: DataFrame, key: str) -> Broadcast | None:
    """A Bloom filter of a column of 64-bit hashes, two bits for a key, of bounded size; None if there are too many keys for one.

    keys: read twice, so best a table of materialize(). Words of bits are put together by a grouping; the driver only lays them side by side.
    """
    n = keys.count()
    if n > FILTER_BITS // 4:
        return None
    bits = min(FILTER_BITS, max(1 << 10, 1 << (16 * n).bit_length()))
    places = keys.select(F.explode(F.expr(f"array({key} & {bits - 1}L, shiftright({key}, 32) & {bits - 1}L)")).alias("at"))
    words = places.groupBy(F.expr("cast(shiftright(at, 6) as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("held")).toArrow()
    table = np.zeros(bits // 64, dtype=np.int64)
    table[words["word"].to_numpy()] = words["held"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(table)


def sifted(batches: Iterator[pa.RecordBatch], at: int, held: Broadcast, inside: bool = True) -> Iterator[pa.RecordBatch]:
    """In a task: the rows whose key, in column number at, a filter may hold, or (inside=False) those whose key it surely doesn't."""
    table = held.value
    for batch in batches:
        k = batch.column(at).to_numpy(zero_copy_only=False)
        found = np.ones(len(k), dtype=np.int64)
        for place in (k & (64 * len(table) - 1), k >> 32 & (64 * len(table) - 1)):
            found &= table[place >> 6] >> (place & 63)
        yield batch.filter(pa.array((found & 1 == 1) == inside))


def passed(rows: DataFrame, key: str, held: Broadcast | None) -> DataFrame:
    """The rows whose key a filter may hold. None may hold all keys."""
    if held is None:
        return rows
    at = rows.columns.index(key)
    return rows.mapInArrow(lambda batches: sifted(batches, at, held), rows.schema)


def unused(name: str, df: DataFrame) -> str:
    """name, with underscores behind it until df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each string; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that hashes of near values are unrelated."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
