"""The folder that driver and executors share, for tables between steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder in the warehouse where that is unset (in tests); on a cluster, a warehouse on local disks is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if not spark.sparkContext.master.startswith("local") and base.startswith(("/", "file:")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark's own."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of some paths that exist, in any file system that Spark knows."""
    return [p for p in paths if (at := _at(spark, p))[0].exists(at[1])]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    files, at = _at(spark, path)
    files.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file, in place of what is there."""
    files, at = _at(spark, path)
    out = files.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_csv(df: DataFrame, path: str, single: bool = True, order: list[str] | None = None) -> None:
    """Write df as CSV with a header, arrays and structs as JSON, in place of what is there. single: as one file, which one task sorts (order) and writes; else as a folder of parts."""
    spark = df.sparkSession
    df = df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "struct", "map"))})
    parts = f"{path}.parts"
    whole = df.repartition(1) if single else df
    writer = (whole.sortWithinPartitions(*order) if single and order else whole).write.mode("overwrite").option("header", True)
    writer.csv(parts if single else path)
    if single:
        files, at = _at(spark, path)
        made = [f.getPath() for f in files.listStatus(_at(spark, parts)[1]) if f.getPath().getName().startswith("part-")]
        files.delete(at, True)
        files.rename(made[0], at)
        delete(spark, parts)


class Scratch:
    """A folder of its own for the tables of one run, which the caller deletes when the results have been written."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
        self._tables = 0

    def path(self, name: str) -> str:
        """A new path in the folder."""
        self._tables += 1
        return f"{self.folder}/{self._tables}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read back."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self) -> None:
        """Delete all tables of the run."""
        delete(self.spark, self.folder)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        self.delete()
