"""Session bars of a stream of ticks.

A bar's event time is its start, read as UTC (Spark's watermarks need an instant), so a bar is closed once a bar that starts more than
the allowed delay later has been seen. Bars are the same aggregates as in a batch. Two sinks keep them, both exactly once over restarts:

- write_closed() appends each bar when it is closed: a file sink with a checkpoint; its log leaves out files of attempts that failed.
- write_current() writes the bars that each batch has changed to a folder of that batch's number, overwriting what an attempt left there;
  current() reads the latest version of each bar. So open bars can be read, too, and a replayed batch counts nothing twice.

State is a row for each open bar; rows for bars that are closed are late and are dropped, as Spark reports in the query's progress.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sessions import bucket_of_hour, bucket_start
from ..operators.bars import aggregates, row_order

_KEYS = ["root", "contract", "ts", "bucket"]


def instant(ts: str) -> Column:
    """A wall-clock time as the instant that shows it in UTC, whatever the session's zone."""
    return F.expr(f"make_timestamp(year({ts}), month({ts}), day({ts}), hour({ts}), minute({ts}), extract(second from {ts}), 'UTC')")


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table, a file or a folder that grows, as a stream; its columns are those it has now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def bucket_bars(ticks: DataFrame, delay: str = "6 hours") -> DataFrame:
    """Bars of a stream of ticks (columns as for bars.bucket_bars()), with closes: the instant by which they are closed. delay: how much later a bar may start and this one still take ticks."""
    rows = ticks.withColumn("bucket", bucket_of_hour(F.hour("ts"))).withColumn("start", bucket_start("ts", "bucket"))
    rows = rows.withColumn("closes", instant("start")).withWatermark("closes", delay)
    by = rows.groupBy("root", "contract", F.col("start").alias("bar"), "bucket", "closes").agg(*aggregates(ticks.columns, row_order(ticks)))
    return by.withColumnRenamed("bar", "ts")


def write_closed(made: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed bars to a folder until the source has no more for now."""
    return made.drop("closes").writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_current(made: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all bars that change, by batch, until the source has no more for now."""

    def save(df: DataFrame, batch: int) -> None:
        df.drop("closes").write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return made.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of each bar that write_current() has written."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in [*_KEYS, "batch"]]
    latest = rows.groupBy(*_KEYS).agg(F.max_by(F.struct(*values), "batch").alias("latest"))
    return latest.select(*_KEYS, "latest.*")
