"""From contract files to all results, by session buckets or days: named lazy frames, and their sink."""

from __future__ import annotations

import dataclasses
import itertools
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars, bizdays, calendars, chain, events, quality, strip
from ..sources import files
from ..sources.storage import write_csv, write_text
from .settings import Settings


Keep = Callable[[DataFrame, str], DataFrame]
#: Rows of a series from which on it is cut into chunks, and its events go by doubled pointers instead of a fold; the results are the same.
LONG = 50_000
_number = itertools.count()


def _coverage(days: dict) -> bizdays.Coverage:
    limits = days.get("volume_threshold") or {}
    ranges = tuple((int(r["max_days"]), float(r["percentile"])) for r in limits.get("dynamic_ranges") or [])
    known = {k: days[k] for k in ("min_total_buckets", "min_us_buckets", "partial_day_min_buckets", "near_expiry_relax") if k in days}
    more = {"ranges": ranges} if ranges else {}
    return bizdays.Coverage(policy=days.get("fallback_policy", "calendar_only"), method=limits.get("method", "dynamic"), percentile=limits.get("fixed_percentile", 0.10), **known, **more)


def _calendar(spark: SparkSession, s: Settings) -> DataFrame | None:
    paths = s.business_days["calendar_paths"]
    return files.load_calendars(spark, paths, s.business_days["calendar_hierarchy"]) if paths else None


def _detect(s: Settings, spreads: DataFrame, window: int, keep: Keep | None = None) -> DataFrame:
    return events.detect_events(spreads, s.spread["method"].lower(), window, s.spread["z_threshold"], s.spread["abs_min"], keep=keep)


def kept_in(spark: SparkSession, folder: str) -> Keep:
    """Writes a frame to a folder and reads it back, so that what is built on it doesn't start from the files again."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return keep


def _lazy(df: DataFrame, name: str) -> DataFrame:
    return df


def _dated(s: Settings, out: dict[str, DataFrame], marked: DataFrame, spread: DataFrame, pairs: DataFrame, buckets: DataFrame | None, calendar: DataFrame | None, kind: str, keep: Keep | None = None) -> DataFrame:
    """Events aligned to business days, then summarised; without a calendar there are no business days, and events stay where they are."""
    if calendar is None:
        out[f"{kind}_widening_summary"] = events.event_summary(marked)
        return events.align_events(marked, spread, "none")
    audited = bizdays.audit(pairs, buckets, calendar, _coverage(s.business_days), keep)
    days = bizdays.business_days(audited)
    aligned = events.align_events(marked, days, s.business_days["align_events"])
    out[f"business_days_audit_{kind}"] = audited
    out[f"{kind}_widening_summary"] = events.event_summary(aligned, days, spread)
    return aligned


def _fields(s: Settings) -> dict[str, str]:
    return {"price": s.data.get("price_field") or "close", "volume": s.data.get("volume_field") or "volume"}


def hourly(spark: SparkSession, s: Settings, keep: Keep = _lazy) -> dict[str, DataFrame]:
    """All results by session buckets. keep: what to do with the frames that most results share (see kept_in)."""
    root = s.products[0]
    minutes = files.contract_minutes(spark, s.data["minute_root"], root, s.data["timezone"], max_files=s.data.get("max_files"), skip_bad=True)
    panel = keep(chain.assemble_panel(keep(bars.bucket_bars(minutes), "bars"), chain.expiry_dim(files.contract_metadata(spark, s.metadata_path))), "panel")
    links, times = keep(chain.chain(panel, **_fields(s)), "chain"), chain.grid(panel)
    pairs, meta, calendar = chain.front_next(links, times), chain.panel_meta(panel), _calendar(spark, s)
    window = s.spread.get("window_buckets") or s.spread.get("window") or 30
    hours = s.spread.get("cool_down_hours") or 0

    def cool(e: DataFrame) -> DataFrame:
        """By time or rows; series with very many events take the way that holds none of them in a row (only if results are kept between steps)."""
        if not hours:
            return events.cooldown_rows(e, int(s.spread.get("cool_down_buckets") or 0))
        return events.cooldown_by_doubling(e, hours, new) if long else events.cooldown_time(e, hours)

    new = lambda df, name: keep(df, f"{name}-{next(_number)}")
    spread, strip_rows = chain.calendar_spread(pairs), keep(chain.multi_spreads(links, times), "strip")
    # Long series only show, and only matter, where frames are written between steps.
    long = keep is not _lazy and strip_rows.count() > LONG * (chain.DEPTH - 1)
    widening, many = cool(_detect(s, spread, window, new if long else None)), keep(cool(_detect(s, strip_rows, window, new if long else None)), "strip_events")
    raw = many.withColumn("event", F.col("kept"))
    sizes = keep(strip.magnitudes(strip_rows), "magnitudes")
    timing, cycles, wide = strip.event_timing(raw, links), strip.dominance_by_cycle(sizes, links), chain.strip_wide(strip_rows)
    out = {
        "hourly_panel": panel, "hourly_spread": spread, "multi_spreads": wide, "multi_spread_events": chain.strip_wide(many, "kept"), "spread_correlations": strip.spread_correlations(wide),
        "spread_signal_comparison": strip.compare_signals(raw), "spread_event_timing": timing, "spread_timing_summary": strip.timing_summary(timing, new if long else None), "spread_change_statistics": strip.change_statistics(strip_rows),
        "s1_vs_others_magnitude": sizes, "s1_dominance_by_cycle": cycles, "cross_spread_summary": strip.cross_spread_summary(cycles),
    }
    if s.strip_analysis["enabled"]:
        ends = panel.agg(F.to_date(F.min("ts")), F.greatest(F.max("expiry"), F.to_date(F.max("ts")))).first()
        days = calendars.open_days(spark, str(ends[0]), str(ends[1]), calendar)
        out["strip_spread_diagnostics"] = strip.strip_dominance(sizes, links, days, s.strip_analysis["dominance_ratio_threshold"], s.strip_analysis["expiry_window_business_days"])
        if s.strip_analysis["filter_expiry_dominance"]:
            widening = strip.filter_expiry_dominance(widening, out["strip_spread_diagnostics"], "kept")
    aligned = _dated(s, out, widening, spread, pairs, meta, calendar, "hourly", new if long else None)
    marked = aligned.join(meta, ["root", "ts"], "left").join(pairs.select("root", "ts", F.col("front_volume").alias("volume")), ["root", "ts"], "left")
    return out | {"hourly_widening": aligned, "bucket_summary": events.bucket_event_summary(marked), "preference_scores": events.preference_scores(marked), "transition_matrix": events.transition_matrix(marked)}


def daily(spark: SparkSession, s: Settings, keep: Keep = _lazy) -> dict[str, DataFrame]:
    """All results by days, of contracts of good quality; unknown limits of quality are an error."""
    root = s.products[0]
    minutes = files.contract_minutes(spark, s.data["minute_root"], root, s.data["timezone"], skip_bad=True)
    days = keep(bars.fill_calendar(keep(bars.daily_bars(minutes), "days")), "filled_days")
    own = {k: v for k, v in s.data_quality.items() if k not in ("filter_enabled", "trim_early_sparse", "enabled")}
    rules = quality.Quality(**own, enabled=s.data_quality.get("filter_enabled", True))
    kept = quality.keep(days, rules)
    kept = quality.trim(kept) if s.data_quality.get("trim_early_sparse") else kept
    panel = keep(chain.assemble_panel(kept.withColumn("ts", F.col("day").cast("timestamp_ntz")).drop("day"), chain.expiry_dim(files.contract_metadata(spark, s.metadata_path))), "daily_panel")
    links, times = chain.chain(panel, **_fields(s)), chain.grid(panel)
    pairs = chain.front_next(links, times)
    spread = chain.calendar_spread(pairs)
    window = s.spread.get("window") or s.spread.get("window_buckets") or 30
    widening = events.cooldown_rows(_detect(s, spread, window), int(s.spread.get("cool_down") or 0))
    found = quality.metrics(days, rules)
    out = {
        "panel_filtered": panel, "panel_full_filtered": panel, "spread_filtered": spread, "quality_metrics": found, "filtering_summary": quality.summary(found, rules),
        "liquidity_roll": chain.liquidity_signal(pairs, s.roll_rules.get("liquidity_threshold", 0.8), s.roll_rules.get("confirm_days", 1)),
    }
    return out | {"widening_filtered": _dated(s, out, widening, spread, pairs, None, _calendar(spark, s), "daily")}


#: Folder and file of each result that doesn't go to analysis under its own name as CSV (fixed values); {c} is the commodity.
PLACES = {
    "hourly_panel": "panels/hourly_panel.parquet", "hourly_spread": "roll_signals/hourly_spread.csv", "hourly_widening": "roll_signals/hourly_widening.csv",
    "multi_spreads": "roll_signals/multi_spreads.csv", "multi_spread_events": "roll_signals/multi_spread_events.csv",
    "panel_filtered": "panels/hg_panel_filtered.parquet", "panel_full_filtered": "panels/hg_panel_full_filtered.csv", "spread_filtered": "roll_signals/hg_spread_filtered.csv",
    "widening_filtered": "roll_signals/hg_widening_filtered.csv", "liquidity_roll": "roll_signals/hg_liquidity_roll_filtered.csv",
    "quality_metrics": "data_quality/{c}_quality_metrics.csv", "filtering_summary": "data_quality/{c}_filtering_summary.json",
}
#: Results that are only written if they have rows, and one whose CSV is a folder of parts, as it has a row for each bar.
_UNLESS_EMPTY, _PARTS = ("strip_spread_diagnostics",), ("panel_full_filtered",)
_ORDER = ["root", "ts", "date", "level", "spread", "level_a", "level_b", "bucket", "from_bucket", "to_bucket", "bin", "contract"]


def write(spark: SparkSession, results: dict[str, DataFrame], s: Settings) -> dict[str, str]:
    """Write all results and the settings under the output folder; returns the paths of what was written.

    Panels are Parquet by root; all else is one CSV file each, in order, but the full daily panel, which is a folder of parts. Reports on
    quality are left out if no contract was judged.
    """
    paths = {}
    commodity = s.data_quality.get("commodity", "HG")
    judged = "quality_metrics" not in results or not results["quality_metrics"].isEmpty()
    for name, df in results.items():
        path = f"{s.output_dir}/{PLACES.get(name, f'analysis/{name}.csv').format(c=commodity)}"
        if name in _UNLESS_EMPTY and df.isEmpty() or not judged and "data_quality/" in path:
            continue
        if path.endswith(".parquet"):
            df.write.mode("overwrite").partitionBy("root").parquet(path)
        elif path.endswith(".json"):
            write_text(spark, path, json.dumps(df.first().asDict(), indent=2))
        else:
            write_csv(df, path, name not in _PARTS, [c for c in _ORDER if c in df.columns])
        paths[name] = path
    kept = {k: v for k, v in dataclasses.asdict(s).items() if k in ("products", "data", "spread", "business_days", "output_dir", "metadata_path")}
    kept["business_days"] = {k: v for k, v in kept["business_days"].items() if k != "calendar_paths"}
    paths["run_settings"] = f"{s.output_dir}/analysis/run_settings.json"
    write_text(spark, paths["run_settings"], json.dumps(kept, indent=2, default=str))
    return paths
