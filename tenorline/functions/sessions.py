"""Intraday session buckets and trading dates, as expressions over wall-clock times without zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bucket, label, start hour, hours, session, expected volume (fixed values): seven hours of the US session, then late US, Asia and Europe.
BUCKETS = [
    (1, "09:00 - US Open", 9, 1, "US Regular", "Very High"),
    (2, "10:00 - US Morning", 10, 1, "US Regular", "Highest"),
    (3, "11:00 - US Late Morning", 11, 1, "US Regular", "Highest"),
    (4, "12:00 - US Midday", 12, 1, "US Regular", "High"),
    (5, "13:00 - US Early Afternoon", 13, 1, "US Regular", "High"),
    (6, "14:00 - US Late Afternoon", 14, 1, "US Regular", "Very High"),
    (7, "15:00 - US Close", 15, 1, "US Regular", "High"),
    (8, "Late US/After-Hours", 16, 5, "Late US", "Low-Medium"),
    (9, "Asia Session", 21, 6, "Asia", "Medium"),
    (10, "Europe Session", 3, 6, "Europe", "Medium-High"),
]


def bucket_of_hour(hour: Column) -> Column:
    """Bucket 1 to 10 of an hour; an hour outside 0 to 23 is an error, null stays null."""
    bad = F.raise_error(F.concat(F.lit("hour out of range: "), hour.cast("string"))).cast("int")
    return (
        F.when(hour.isNull(), F.lit(None).cast("int")).when((hour < 0) | (hour > 23), bad).when(hour.between(9, 15), hour - 8).when(hour.between(16, 20), 8)
        .when((hour >= 21) | (hour <= 2), 9).otherwise(10).cast("int")
    )


def bucket_dim(spark: SparkSession) -> DataFrame:
    """One row for each bucket, with its hours."""
    rows = [(b, label, start, n, session, [(start + i) % 24 for i in range(n)], expected) for b, label, start, n, session, expected in BUCKETS]
    return spark.createDataFrame(rows, "bucket int, bucket_label string, start_hour int, n_hours int, session string, hours array<int>, expected_volume string")


def bucket_info(bucket: Column, what: str) -> Column:
    """label, session or hours of a bucket; null stays null, and a bucket that isn't one is an error."""
    at = {"label": 1, "hours": 3, "session": 4}[what]
    known = F.element_at(F.create_map(*[F.lit(x) for b in BUCKETS for x in (b[0], b[at])]), bucket)
    bad = F.raise_error(F.concat(F.lit("unknown bucket: "), bucket.cast("string"))).cast("int" if what == "hours" else "string")
    return F.when(bucket.isNull(), F.lit(None)).when(bucket.between(1, len(BUCKETS)), known).otherwise(bad)


def bucket_start(ts: str, bucket: str) -> Column:
    """When a time's bucket began, by the wall clock: the Asia session of the small hours began the day before."""
    hour = f"case when {bucket} <= 7 then 8 + {bucket} when {bucket} = 8 then 16 when {bucket} = 9 then 21 else 3 end"
    return F.expr(f"cast(to_date({ts}) as timestamp_ntz) + make_dt_interval(case when {bucket} = 9 and hour({ts}) < 3 then -1 else 0 end, {hour})")


def bar_date(ts: Column, bucket: Column) -> Column:
    """Trading date of a bar: the Asia session belongs to the next day."""
    return F.date_add(F.to_date(ts), F.when(bucket == 9, 1).otherwise(0))


def tick_date(ts: Column) -> Column:
    """Trading date of a tick: from 21:00 on the next day's."""
    return F.date_add(F.to_date(ts), F.when(F.hour(ts) >= 21, 1).otherwise(0))


def days_to_expiry(expiry: Column, day: Column) -> Column:
    """Days from a date to an expiry, 0 when past; null without an expiry."""
    return F.when(expiry.isNotNull() & day.isNotNull(), F.greatest(F.datediff(expiry, day), F.lit(0)))


#: Upper ends of the cycle bins, in days; the last bin is open.
CYCLE = [5, 10, 15, 20, 25, 30, 40, 50, 60]


def cycle_bin(days: Column) -> Column:
    """Number of the right-closed bin of days to expiry, from 0; null for null."""
    out = F.when(days.isNull(), F.lit(None).cast("int"))
    for i, top in enumerate(CYCLE):
        out = out.when(days <= top, i)
    return out.otherwise(len(CYCLE)).cast("int")


def cycle_label(number: Column) -> Column:
    """Label of a cycle bin: 0-5, 6-10, ... 60+."""
    out = F.when(number == 0, f"0-{CYCLE[0]}")
    for i in range(1, len(CYCLE)):
        out = out.when(number == i, f"{CYCLE[i - 1] + 1}-{CYCLE[i]}")
    return out.when(number == len(CYCLE), f"{CYCLE[-1]}+")
