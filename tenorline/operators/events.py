"""Spread-widening events: changes, rolling scores, thresholds, cool-downs, alignment to business days, and summaries.

Rows are (root, level, ts, spread); windows go by rows of a root and level, null spreads included, as the grid of times gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sessions import bucket_info
from .ordered import in_chunks, next_value, reached

_SERIES = ["root", "level"]


def _rows(series: list[str] = _SERIES):
    return Window.partitionBy(*series).orderBy("ts")


def spread_change(spreads: DataFrame, series: list[str] = _SERIES) -> DataFrame:
    """spreads with change: the difference to the previous row, null if either is missing; rolls don't reset it."""
    return spreads.withColumn("change", F.col("spread") - F.lag("spread").over(_rows(series)))


def rolling_zscore(spreads: DataFrame, window: int = 30, min_periods: int | None = None, series: list[str] = _SERIES) -> DataFrame:
    """spreads with change and z: the change by mean and deviation of the last window rows, its own included, if enough of them have one."""
    least = min_periods or max(5, window // 2)
    w = _rows(series).rowsBetween(1 - window, 0)
    sd = F.stddev_samp("change").over(w)
    z = F.when(F.count("change").over(w) >= least, (F.col("change") - F.avg("change").over(w)) / F.when(sd > 0, sd))
    return spread_change(spreads, series).withColumn("z", z)


def rolling_zscore_in_chunks(spreads: DataFrame, window: int, min_periods: int | None, keep, chunk: int = 100_000) -> DataFrame:
    """As rolling_zscore(), for series of any length: chunks of rows are windows of their own, with the window rows before them as a halo. keep(df, name): writes a frame and reads it back."""
    return in_chunks(spreads, _SERIES, ["ts"], window, keep, chunk, lambda df, series: rolling_zscore(df, window, min_periods, series))


def detect_events(spreads: DataFrame, method: str = "zscore", window: int = 30, z_threshold: float = 1.5, abs_min: float | None = None, min_periods: int | None = None, keep=None) -> DataFrame:
    """spreads with change, z and event. zscore: z over its threshold (and the change over abs_min, if given); abs: change over abs_min; combined: either. keep: see rolling_zscore_in_chunks(), which is then used."""
    if method not in ("zscore", "abs", "combined"):
        raise ValueError(f"unknown method: {method}")
    if method != "zscore" and abs_min is None:
        raise ValueError(f"method {method} needs abs_min")
    scored = rolling_zscore(spreads, window, min_periods) if keep is None else rolling_zscore_in_chunks(spreads, window, min_periods, keep)
    high = F.coalesce(F.col("z") > z_threshold, F.lit(False))
    wide = F.coalesce(F.col("change") > F.lit(abs_min), F.lit(False))
    event = {"zscore": high if abs_min is None else high & wide, "abs": wide, "combined": high | wide}[method]
    return scored.withColumn("event", event)


def _cooled(events: DataFrame, place: Column, kind: str, keeps: str) -> DataFrame:
    """events with kept: a fold over a series' event places; each is held against the last one kept, so the order matters and ties don't arise."""
    at = events.withColumn("_place", place)
    fold = (
        f"aggregate(array_sort(collect_list(_place)), named_struct('last', cast(null as {kind}), 'kept', cast(array() as array<{kind}>)), "
        f"(s, x) -> if(s.last is null or {keeps}, named_struct('last', x, 'kept', array_append(s.kept, x)), s), s -> s.kept)"
    )
    kept = at.where("event").groupBy(*_SERIES).agg(F.expr(fold).alias("_kept")).select(*_SERIES, F.explode("_kept").alias("_place"), F.lit(True).alias("_yes"))
    return at.join(kept, [*_SERIES, "_place"], "left").withColumn("kept", F.coalesce("_yes", F.lit(False))).drop("_place", "_yes")


def cooldown_time(events: DataFrame, hours: float) -> DataFrame:
    """events with kept: events at least so many hours after the last kept one; no cool-down if hours is 0."""
    if not hours:
        return events.withColumn("kept", F.col("event"))
    return _cooled(events, F.col("ts"), "timestamp_ntz", f"x >= s.last + make_dt_interval(0, 0, 0, {hours * 3600})")


def cooldown_rows(events: DataFrame, rows: int) -> DataFrame:
    """events with kept: events more than so many rows after the last kept one; no cool-down if rows is 0 or less."""
    if not isinstance(rows, int):
        raise TypeError("rows must be an int")
    if rows <= 0:
        return events.withColumn("kept", F.col("event"))
    return _cooled(events, F.row_number().over(_rows()), "int", f"x - s.last > {rows}")


def cooldown_by_doubling(events: DataFrame, hours: float, keep, chunk: str = "month") -> DataFrame:
    """As cooldown_time(), for series of any number of events: each event points to the first one that is not suppressed by it, and pointers are doubled.

    keep(df, name): writes a frame and reads it back (storage.Scratch.keep). chunk: the unit of time by which series are cut into windows.
    """
    if not hours:
        return events.withColumn("kept", F.col("event"))
    rows = keep(events.where("event").select(*_SERIES, F.col("ts").alias("at")).distinct(), "events")
    end = F.expr(f"at + make_dt_interval(0, 0, 0, {hours * 3600})")
    unit = {"year": F.year("at"), "month": F.year("at") * 12 + F.month("at"), "day": F.datediff(F.to_date("at"), F.lit("1970-01-01").cast("date"))}[chunk]
    asked = rows.select(*_SERIES, end.alias("at"))
    following = next_value(asked, rows, _SERIES, unit).select(*_SERIES, F.col("at").alias("_end"), "next")
    pointers = keep(rows.withColumn("_end", end).join(following, [*_SERIES, "_end"], "left").select(*_SERIES, "at", "next"), "pointers")
    kept = reached(pointers, _SERIES, keep).select(*_SERIES, F.col("at").alias("ts"), F.lit(True).alias("_yes"))
    return events.join(kept, [*_SERIES, "ts"], "left").withColumn("kept", F.coalesce("_yes", F.lit(False)) & F.col("event")).drop("_yes")


def _of_root(events: DataFrame, business_days: DataFrame) -> tuple[Column, DataFrame]:
    """What tells roots apart in events, and _root, date of business days: by root if they have one, else the same days for all."""
    by = "root" in business_days.columns
    root = F.col("root") if by else F.lit("")
    return root, business_days.select(root.alias("_root"), "date").distinct()


def align_events(events: DataFrame, business_days: DataFrame, policy: str = "none") -> DataFrame:
    """events with aligned_ts. drop_closed: only rows of their root's business days; shift_next: moved to the root's next business day's same time, if there is one.

    Rows of a root without any business day stay as they are.
    """
    if policy not in ("none", "drop_closed", "shift_next"):
        raise ValueError(f"unknown policy: {policy}")
    if policy == "none":
        return events.withColumn("aligned_ts", F.col("ts"))
    root, days = _of_root(events, business_days)
    dated = events.withColumn("_on", F.to_date("ts")).withColumn("_root", root)
    if policy == "drop_closed":
        known = days.select("_root").distinct().withColumn("_has", F.lit(True))
        open_ = days.select("_root", F.col("date").alias("_on"), F.lit(True).alias("_open"))
        both = dated.join(known, "_root", "left").join(open_, ["_root", "_on"], "left")
        return both.where("_has is null or _open").withColumn("aligned_ts", F.col("ts")).drop("_on", "_root", "_has", "_open")
    # Forward as-of join: the next business day of each date that has events.
    following = next_value(dated.select("_root", F.col("_on").alias("at")), days.select("_root", F.col("date").alias("at")), ["_root"], F.year("at"))
    moved = dated.join(following.select("_root", F.col("at").alias("_on"), F.col("next").alias("_next")), ["_root", "_on"], "left")
    shift = F.expr("ts + make_dt_interval(datediff(coalesce(_next, _on), _on))")
    return moved.withColumn("aligned_ts", shift).drop("_on", "_next", "_root")


def business_day_gaps(events: DataFrame, business_days: DataFrame) -> DataFrame:
    """Kept events with gap: their root's business days since the last event on one; null for the first and for dates that are none."""
    root, days = _of_root(events, business_days)
    numbered = days.withColumn("pos", F.row_number().over(Window.partitionBy("_root").orderBy("date")) - 1)  # days, not rows of data
    placed = events.where("kept").withColumn("date", F.to_date("ts")).withColumn("_root", root).join(numbered, ["_root", "date"], "left").drop("_root")
    before = F.last("pos", ignorenulls=True).over(_rows().rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("gap", (F.col("pos") - before).cast("long"))


def event_summary(events: DataFrame, business_days: DataFrame | None = None, spreads: DataFrame | None = None) -> DataFrame:
    """One row for each kept event, at its aligned_ts if it has one: spread before and after, change, business days since the last one (null without business days).

    spreads: the whole series, where events lacks rows of it; a time that isn't in the series has no spreads.
    """
    moved = "aligned_ts" in events.columns
    if spreads is None and not moved:  # the row before an event is in the same table: no join
        before = events.select(*_SERIES, "ts", "spread", "kept").withColumn("spread_before", F.lag("spread").over(_rows())).where("kept")
    else:
        series = (events if spreads is None else spreads).select(*_SERIES, "ts", "spread").withColumn("spread_before", F.lag("spread").over(_rows()))
        before = events.where("kept").select(*_SERIES, F.col("aligned_ts" if moved else "ts").alias("ts"), "kept").join(series, [*_SERIES, "ts"], "left")
    dated = before.withColumn("gap", F.lit(None).cast("long")) if business_days is None else business_day_gaps(before, business_days)
    return dated.select("root", "level", "ts", "spread_before", F.col("spread").alias("spread_after"), (F.col("spread") - F.col("spread_before")).alias("change"), F.col("gap").alias("business_days_since_last"))


def bucket_event_summary(events: DataFrame) -> DataFrame:
    """Per root and bucket: label, session, periods, events, rate, average spreads and share of all events. events: kept, spread, bucket."""
    event_spread = F.when(F.col("kept"), F.col("spread"))
    by = events.where("bucket is not null").groupBy("root", "bucket").agg(
        F.count("*").alias("total_periods"), F.count_if("kept").alias("event_count"), F.avg("spread").alias("avg_spread"), F.avg(event_spread).alias("avg_event_spread"), F.stddev_samp(event_spread).alias("std_event_spread")
    )
    whole = F.sum("event_count").over(Window.partitionBy("root"))
    by = by.withColumns({"label": bucket_info(F.col("bucket"), "label"), "session": bucket_info(F.col("bucket"), "session")})
    return by.withColumn("event_rate_pct", F.bround(100 * F.col("event_count") / F.col("total_periods"), 2)).withColumn("event_share_pct", F.when(whole > 0, F.bround(100 * F.col("event_count") / whole, 2)).otherwise(0.0))


def preference_scores(events: DataFrame) -> DataFrame:
    """Per root and bucket: event rate by share of volume, the mean of scores set to 1. events: kept, volume, bucket."""
    by = events.where("bucket is not null").groupBy("root", "bucket").agg(F.avg(F.col("kept").cast("double")).alias("rate"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("v"))
    w = Window.partitionBy("root")
    share = F.col("v") / F.when(F.sum("v").over(w) > 0, F.sum("v").over(w))
    raw = by.withColumn("raw", F.col("rate") / F.when(share > 0, share).otherwise(0.0001))
    mean = F.avg("raw").over(w)
    return raw.select("root", "bucket", F.when(mean > 0, F.col("raw") / mean).otherwise(F.col("raw")).alias("score"))


def transition_matrix(events: DataFrame) -> DataFrame:
    """Per root, 10 by 10 shares of the next event's bucket after an event's; rows without transitions are 0. events: kept, bucket."""
    w = Window.partitionBy("root").orderBy("ts")
    steps = events.where("kept and bucket is not null").withColumn("to_bucket", F.lead("bucket").over(w)).where("to_bucket is not null")
    counts = steps.groupBy("root", F.col("bucket").alias("from_bucket"), "to_bucket").agg(F.count("*").alias("n"))
    cells = events.select("root").distinct().select("root", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("from_bucket")).withColumn("to_bucket", F.explode(F.sequence(F.lit(1), F.lit(10))))
    full = cells.join(counts, ["root", "from_bucket", "to_bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = F.sum("n").over(Window.partitionBy("root", "from_bucket"))
    return full.select("root", "from_bucket", "to_bucket", F.when(whole > 0, F.col("n") / whole).otherwise(0.0).alias("share"))
