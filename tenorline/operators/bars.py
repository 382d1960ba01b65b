"""Bars of ticks or minutes: session buckets, days, calendar fill, statistics and validation.

Input rows: root, contract, ts (without zone), open, high, low, close, volume and, if there, open_interest. NaN is missing (see clean()).
First and last values skip nulls; of rows of one time the first is that of the first file (src_file), then of the first line (pos), where
these are there. All aggregates combine before the shuffle, whose key is (root, contract, bar).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sessions import bar_date, bucket_dim, bucket_of_hour, bucket_start, tick_date

PRICES = ["open", "high", "low", "close"]


def clean(df: DataFrame) -> DataFrame:
    """df with NaN and infinite values of double columns as null."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def aggregates(columns: list[str], order: Column) -> list[Column]:
    """The aggregates of a bar, of the columns there are; order: of its rows."""
    present = lambda c, f: f(F.col(c), F.when(F.col(c).isNotNull(), order))
    made = {
        "open": lambda: present("open", F.min_by), "high": lambda: F.max("high"), "low": lambda: F.min("low"), "close": lambda: present("close", F.max_by),
        "volume": lambda: F.coalesce(F.sum("volume"), F.lit(0).cast("double")), "open_interest": lambda: present("open_interest", F.max_by),
    }
    return [f().alias(c) for c, f in made.items() if c in columns]


def row_order(minutes: DataFrame) -> Column:
    """The order of minute rows: by time, then file, then place in it, as far as there are such columns."""
    more = [c for c in ("src_file", "pos") if c in minutes.columns]
    return F.struct("ts", *more) if more else F.col("ts")


def bucket_bars(minutes: DataFrame, order: Column | None = None) -> DataFrame:
    """One bar for each contract and session bucket that has rows: root, contract, ts (start), bucket and the columns there are."""
    rows = minutes.withColumn("bucket", bucket_of_hour(F.hour("ts")))
    rows = rows.withColumn("start", bucket_start("ts", "bucket"))
    return rows.groupBy("root", "contract", F.col("start").alias("bar"), "bucket").agg(*aggregates(minutes.columns, order if order is not None else row_order(minutes))).withColumnRenamed("bar", "ts")


def daily_bars(minutes: DataFrame, order: Column | None = None) -> DataFrame:
    """One bar for each contract and calendar day that has rows: root, contract, day and the columns there are."""
    return minutes.groupBy("root", "contract", F.to_date("ts").alias("day")).agg(*aggregates(minutes.columns, order if order is not None else row_order(minutes)))


def fill_calendar(daily: DataFrame) -> DataFrame:
    """Daily bars with a row for every calendar day from a contract's first to its last: no prices, volume 0."""
    spine = daily.groupBy("root", "contract").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("root", "contract", F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("day"))
    filled = spine.join(daily, ["root", "contract", "day"], "left")
    return filled.withColumn("volume", F.coalesce("volume", F.lit(0.0))) if "volume" in daily.columns else filled


def bucket_statistics(bars: DataFrame) -> DataFrame:
    """Ten rows, one for each bucket: label, session, hours, bars, coverage, volume and its share, average and deviation of closes."""
    total = bars.agg(F.count("*").alias("all_points"), F.sum("volume").alias("all_volume"))  # one row
    own = bars.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("volume").alias("av"), F.sum("volume").alias("tv"), F.avg("close").alias("ac"), F.stddev_samp("close").alias("cv"))
    dim = bucket_dim(bars.sparkSession).select("bucket", F.col("bucket_label").alias("label"), "session", F.col("n_hours").alias("duration_hours"))
    joined = dim.join(F.broadcast(own), "bucket", "left").join(F.broadcast(total))  # ten rows and one
    share = lambda x, whole: 100 * x / F.when(whole > 0, whole)
    return joined.select(
        "bucket", "label", "session", "duration_hours", F.coalesce("n", F.lit(0)).cast("long").alias("data_points"),
        F.coalesce(share(F.coalesce("n", F.lit(0)), F.col("all_points")), F.lit(0.0)).alias("coverage_pct"), F.col("av").alias("avg_volume"), F.coalesce("tv", F.lit(0.0)).alias("total_volume"),
        share(F.coalesce("tv", F.lit(0.0)), F.col("all_volume")).alias("volume_share_pct"), F.col("ac").alias("avg_close"), F.col("cv").alias("close_volatility"),
    )


def bucket_validation(minutes: DataFrame, bars: DataFrame) -> DataFrame:
    """For each root and trading date of the bars, whether volume, high and low agree with the minutes', and whether all buckets are there."""
    fine = minutes.groupBy("root", tick_date(F.col("ts")).alias("trade_date")).agg(F.sum("volume").alias("v"), F.max("high").alias("h"), F.min("low").alias("l"))
    coarse = bars.groupBy("root", bar_date(F.col("ts"), F.col("bucket")).alias("trade_date")).agg(
        F.sum("volume").alias("bv"), F.max("high").alias("bh"), F.min("low").alias("bl"), F.count_distinct("bucket").alias("n_buckets")
    )
    close = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= 1e-8 + 1e-5 * F.abs(F.col(b)), F.lit(False))
    return coarse.join(fine, ["root", "trade_date"], "left").select(
        "root", "trade_date", close("bv", "v").alias("volume_ok"), close("bh", "h").alias("high_ok"), close("bl", "l").alias("low_ok"), (F.col("n_buckets") == 10).alias("has_all_buckets")
    )
