"""Panels and events that grow by files: only the dates that new files touch are written again.

Tables are partitioned by root and trade date, and Spark overwrites the partitions that a refresh has rows of. A date's bars come from
all files that have minutes of it, old and new. A change of a bar changes the spreads of its times, and through the rolling score those of
the next rows of its root, so events are worked out from so many rows before the first touched time on, and written from that time to so
many rows after the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sessions import bar_date, bucket_of_hour, bucket_start
from ..operators import bars, chain, events
from ..sources.storage import existing


def _overwrite(df: DataFrame, path: str) -> None:
    """Write df by root and trade date, over the partitions that it has rows of."""
    df.repartition("root", "trade_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("root", "trade_date").parquet(path)


def _dated(minutes: DataFrame) -> DataFrame:
    """minutes with trade_date: that of their bars, which may have begun the day before."""
    placed = minutes.withColumn("_bucket", bucket_of_hour(F.hour("ts")))
    return placed.withColumn("trade_date", bar_date(bucket_start("ts", "_bucket"), F.col("_bucket"))).drop("_bucket")


def touched(minutes: DataFrame) -> DataFrame:
    """root, trade_date of minutes: a row for a day."""
    return _dated(minutes).select("root", "trade_date").distinct()


def refresh_panel(spark: SparkSession, minutes: DataFrame, dates: DataFrame, dim: DataFrame, path: str) -> None:
    """Write a panel's dates (root, trade_date) again, from all minutes; the first time, all of its dates."""
    # Files with statistics are read from the first touched day on only.
    span = dates.agg(F.min("trade_date"), F.max("trade_date")).first()
    if span[0] is None:
        return
    near = minutes.where(F.col("ts").between(F.date_sub(F.lit(span[0]), 1).cast("timestamp_ntz"), F.date_add(F.lit(span[1]), 1).cast("timestamp_ntz")))
    chosen = _dated(near).join(dates, ["root", "trade_date"], "left_semi")
    made = bars.bucket_bars(chosen.select(minutes.columns))
    panel = chain.assemble_panel(made, dim, check=False).withColumn("trade_date", bar_date(F.col("ts"), F.col("bucket")))
    _overwrite(panel, path)


def refresh_events(spark: SparkSession, panel_path: str, dates: DataFrame, path: str, keep, window: int = 20, **rules) -> None:
    """Write the strip's events (detect_events() with its rules) of dates and of the window rows after them again. keep(df, name): writes a frame and reads it back."""
    panel = spark.read.parquet(panel_path)
    by = Window.partitionBy("root").orderBy("ts")
    times = keep(panel.select("root", "ts", "trade_date").distinct().withColumn("n", F.row_number().over(by)), "times")  # a row for a bar's time
    ends = times.join(dates, ["root", "trade_date"], "left_semi").groupBy("root").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    ranged = keep(times.join(ends, "root").where(F.col("n").between(F.col("lo") - window, F.col("hi") + window)), "ranged")
    # Only partitions of these dates are read.
    first, last = ranged.agg(F.min("trade_date"), F.max("trade_date")).first()
    if first is None:
        return
    part = panel.where(F.col("trade_date").between(first, last)).join(ranged.select("root", "ts"), ["root", "ts"], "left_semi")
    found = events.detect_events(chain.multi_spreads(chain.chain(part), chain.grid(part)), window=window, **rules)
    # A date that is only in part among the rows to write keeps its others.
    fresh = found.join(ranged.where("n >= lo").select("root", "ts", "trade_date"), ["root", "ts"])
    whole = keep(fresh, "fresh")
    days = whole.select("root", "trade_date").distinct()
    if existing(spark, [path]):
        old = spark.read.parquet(path).join(days, ["root", "trade_date"], "left_semi").join(whole.select("root", "level", "ts"), ["root", "level", "ts"], "left_anti")
        whole = whole.unionByName(keep(old.select(whole.columns), "old"))
    _overwrite(whole, path)

