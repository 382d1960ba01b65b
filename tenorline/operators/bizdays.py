"""Business days from a calendar and the data's own coverage, with an audit of every observed date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sessions import bar_date, days_to_expiry
from .chain import front_next_volume
from .ordered import quantiles


@dataclass(frozen=True)
class Coverage:
    """What a date needs to count: session buckets (US ones, or fewer on partial days, or near expiry), and volume; and how both sources combine."""

    min_total_buckets: int = 6
    min_us_buckets: int = 2
    partial_day_min_buckets: int = 4
    near_expiry_relax: int = 5
    policy: str = "calendar_only"
    method: str = "dynamic"
    percentile: float = 0.10
    #: (most days to expiry, percentile), in rising order; beyond the last, the last percentile over all.
    ranges: tuple[tuple[int, float], ...] = ((5, 0.30), (30, 0.20), (60, 0.10))


def _range_of(dte: Column, coverage: Coverage) -> Column:
    out = F.lit(len(coverage.ranges))
    for i in reversed(range(len(coverage.ranges))):
        out = F.when(dte <= coverage.ranges[i][0], i).otherwise(out)
    return out


def _by_rank(rows: DataFrame, keys: list[str], shares: Column, keep) -> DataFrame:
    """keys, threshold: one quantile of the volumes of each group, picked by rank."""
    return quantiles(rows, keys, "volume", F.array(shares), keep).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("quantile").alias("threshold"))


def volume_threshold(rows: DataFrame, coverage: Coverage, keep=None) -> DataFrame:
    """rows (root, volume, dte) with threshold: a quantile of a root's volumes, by ranges of days to expiry or one for all (no volumes: 0).

    keep(df, name): writes a frame and reads it back; with it, quantiles are picked by rank, and no task holds the different volumes of a root.
    """
    if coverage.method not in ("fixed", "dynamic"):
        raise ValueError(f"unknown method: {coverage.method}")
    if keep is not None:
        qs = [p for _, p in coverage.ranges] if coverage.method == "dynamic" else []
        rest = qs[-1] if qs else coverage.percentile
        numbered = rows.withColumn("_range", _range_of(F.col("dte"), coverage) if qs else F.lit(0))
        whole = _by_rank(numbered, ["root"], F.lit(rest), keep)
        if not qs:
            return rows.join(whole, F.col("root") == F.col("_root"), "left").drop("_root").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
        # Each range has a quantile of its own volumes; the last number stands for all volumes of the root.
        share = F.element_at(F.array(*map(F.lit, qs)), F.col("range") + 1)
        own = _by_rank(numbered.withColumnRenamed("_range", "range").where(F.col("range") < len(qs)), ["root", "range"], share, keep)
        every = own.unionByName(whole.withColumn("_range", F.lit(len(qs)))).withColumnsRenamed({"_root": "_r", "_range": "_of"})
        both = numbered.join(every, (F.col("root") == F.col("_r")) & (F.col("_range") == F.col("_of")), "left")
        return both.withColumn("threshold", F.coalesce("threshold", F.lit(0.0))).drop("_r", "_of", "_range")
    if coverage.method == "fixed":
        every = rows.groupBy("root").agg(F.coalesce(F.percentile("volume", F.lit(coverage.percentile)), F.lit(0.0)).alias("threshold"))
        return rows.join(every, "root", "left")
    q = [p for _, p in coverage.ranges]
    numbered = rows.withColumn("_range", _range_of(F.col("dte"), coverage))
    own = [F.percentile(F.when(F.col("_range") == i, F.col("volume")), F.lit(p)) for i, p in enumerate(q)] + [F.percentile("volume", F.lit(q[-1] if q else coverage.percentile))]
    every = numbered.groupBy("root").agg(F.array(*[F.coalesce(x, F.lit(0.0)) for x in own]).alias("_all"))
    return numbered.join(every, "root", "left").withColumn("threshold", F.element_at("_all", F.col("_range") + 1)).drop("_range", "_all")


def audit(pairs: DataFrame, buckets: DataFrame | None, calendar: DataFrame | None, coverage: Coverage, keep=None) -> DataFrame:
    """One row for each root and observed trading date: what was seen, what it takes, and whether the date is a business day.

    pairs: front_next(); buckets: root, ts, bucket, or None for daily data, where each row counts as one bucket and the US rule is off.
    """
    if coverage.policy not in ("calendar_only", "union_with_data", "intersection_strict"):
        raise ValueError(f"unknown policy: {coverage.policy}")
    rows = front_next_volume(pairs).withColumn("dte", days_to_expiry(F.col("front_expiry"), F.to_date("ts")))
    rows = volume_threshold(rows, coverage, keep)
    if buckets is None:
        rows = rows.withColumn("bucket", F.lit(None).cast("int")).withColumn("trade_date", F.to_date("ts"))
        seen, us, least_us = F.count("*"), F.lit(0).cast("long"), 0
        least, partial = max(1, coverage.min_total_buckets), max(1, coverage.partial_day_min_buckets)
    else:
        rows = rows.join(buckets.select("root", "ts", "bucket"), ["root", "ts"], "left")
        rows = rows.withColumn("trade_date", bar_date(F.col("ts"), F.col("bucket")))
        seen, us, least_us = F.count("bucket"), F.count_if(F.col("bucket") <= 7), coverage.min_us_buckets
        least, partial = coverage.min_total_buckets, coverage.partial_day_min_buckets
    by = rows.groupBy("root", F.col("trade_date").alias("date")).agg(
        seen.alias("total_buckets"), us.alias("us_buckets"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
        F.min("dte").cast("double").alias("min_dte"), F.min_by("threshold", F.when(F.col("threshold").isNotNull(), F.col("ts"))).alias("threshold"),
    )
    if calendar is None:
        by = by.withColumns({"_open": F.lit(None).cast("boolean"), "_partial": F.lit("")})
    else:
        by = by.join(calendar.select("date", F.col("is_trading_day").alias("_open"), F.col("partial_hours").alias("_partial")), "date", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    out = by.withColumns({
        "has_data": F.col("total_buckets") > 0,
        "calendar_closed": flag(~F.col("_open")),
        "calendar_open": ~flag(~F.col("_open")) & F.expr("weekday(date) < 5"),
        "is_partial_day": flag(F.col("_open") & (F.trim("_partial") != "")),
        "near_expiry_ok": flag(F.col("min_dte") <= coverage.near_expiry_relax),
        "volume_ok_flag": flag((F.col("threshold") <= 0) | (F.col("volume") >= F.col("threshold"))),
    })
    out = out.withColumn("required_buckets", F.when(F.col("is_partial_day"), partial).otherwise(least))
    out = out.withColumn("coverage_ok", (F.col("total_buckets") >= F.col("required_buckets")) | (F.lit(least_us > 0) & (F.col("us_buckets") >= least_us)) | F.col("near_expiry_ok"))
    out = out.withColumn("data_approved", F.col("has_data") & F.col("coverage_ok") & F.col("volume_ok_flag"))
    final = {"calendar_only": F.col("calendar_open"), "union_with_data": F.col("calendar_open") | F.col("data_approved"), "intersection_strict": F.col("calendar_open") & F.col("data_approved")}
    reason = (
        F.when(F.col("calendar_closed"), "calendar_closed").when(~F.col("has_data"), "no_data").when(~F.col("coverage_ok") & ~F.col("volume_ok_flag"), "coverage_and_volume_fail")
        .when(~F.col("coverage_ok"), "coverage_fail").when(~F.col("volume_ok_flag"), "volume_fail").otherwise("included")
    )
    return out.withColumns({"final_included": final[coverage.policy], "reason": reason, "policy": F.lit(coverage.policy)}).drop("_open", "_partial")


def business_days(audited: DataFrame) -> DataFrame:
    """The dates that an audit includes."""
    return audited.where("final_included").select("root", "date")
