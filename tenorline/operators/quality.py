"""Data quality of contracts: coverage, gaps and age, with reasons; filtering and trimming."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contracts import contract_year


@dataclass(frozen=True)
class Quality:
    """Limits: first contract year, least rows, longest gap in days, least coverage in percent; and the commodity whose contracts are judged."""

    cutoff_year: int = 2015
    min_data_points: int = 1000
    max_gap_days: int = 30
    min_coverage_percent: float = 30.0
    enabled: bool = True
    commodity: str = "HG"


def metrics(daily: DataFrame, rules: Quality) -> DataFrame:
    """One row for each judged contract: status, reasons, rows, span, coverage of business days, gaps, year."""
    w = Window.partitionBy("contract").orderBy("day")
    rows = daily.where(F.col("contract").startswith(rules.commodity)).withColumn("_before", F.lag("day").over(w))
    gap = F.datediff("day", "_before")
    wide = (gap > 5) & (gap > rules.max_gap_days)
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    by = rows.groupBy("contract").agg(
        F.count("*").alias("data_points"), F.min("day").alias("first"), F.max("day").alias("last"), F.coalesce(F.max(gap), F.lit(0)).alias("max_gap_days"),
        F.array_sort(F.collect_list(F.when(wide, F.struct(text("_before").alias("start"), text("day").alias("end"), gap.alias("days"))))).alias("gaps"),
    )
    raw = 100 * F.col("data_points") / (0.7 * (F.datediff("last", "first") + 1))
    by = by.withColumn("year", contract_year(F.col("contract"))).withColumn("_raw", raw)
    reasons = F.array_compact(F.array(
        F.when((F.col("year") > 0) & (F.col("year") < rules.cutoff_year), F.format_string(f"Contract year %d before cutoff {rules.cutoff_year}", "year")),
        F.when(F.col("data_points") < rules.min_data_points, F.format_string(f"Insufficient data points: %d < {rules.min_data_points}", "data_points")),
        F.when(F.size("gaps") > 0, F.format_string(f"Data gaps exceed {rules.max_gap_days} days: %d", F.size("gaps"))),
        F.when(F.col("_raw") < rules.min_coverage_percent, F.format_string(f"Coverage %.1f%% below {rules.min_coverage_percent:g}%%", "_raw")),
    ))
    return by.withColumn("reasons", reasons).select(
        "contract", F.when(F.size("reasons") > 0, "EXCLUDED").otherwise("INCLUDED").alias("status"), "reasons", "data_points",
        F.concat_ws(" to ", text("first"), text("last")).alias("date_range"), F.bround("_raw", 1).alias("coverage_percent"), "gaps", "max_gap_days", "year",
    )


def keep(daily: DataFrame, rules: Quality) -> DataFrame:
    """daily without contracts that are judged and excluded; other commodities pass."""
    if not rules.enabled:
        return daily
    out = metrics(daily, rules).where("status = 'EXCLUDED'").select("contract")
    return daily.join(out, "contract", "left_anti")


def summary(found: DataFrame, rules: Quality) -> DataFrame:
    """One row: commodity, contracts in all, excluded, included."""
    return found.agg(F.lit(rules.commodity).alias("commodity"), F.count("*").alias("total_contracts"), F.count_if(F.col("status") == "EXCLUDED").alias("excluded"), F.count_if(F.col("status") == "INCLUDED").alias("included"))


def trim(daily: DataFrame, rows: int = 20, most: int = 5) -> DataFrame:
    """daily from each contract's first day on which starts a run of so many rows without a gap over most days (the last run isn't tried); else all of it."""
    w = Window.partitionBy("contract").orderBy("day")
    marked = daily.withColumn("_gap", F.datediff("day", F.lag("day").over(w))).withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy("contract")))
    marked = marked.withColumn("_ahead", F.max("_gap").over(w.rowsBetween(1, rows - 1)))
    start = F.min(F.when((F.col("_ahead") <= most) & (F.col("_rn") <= F.col("_n") - rows), F.col("day"))).over(Window.partitionBy("contract"))
    return marked.withColumn("_start", start).where("_start is null or day >= _start").drop("_gap", "_rn", "_n", "_ahead", "_start")
