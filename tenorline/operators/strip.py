"""Analysis of the whole strip of spreads: correlations, signals, timing, dominance of the first spread, and its tie to expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sessions import cycle_bin, cycle_label, days_to_expiry
from .events import spread_change
from .ordered import quantiles

EPS = 1e-10


def spread_correlations(strip: DataFrame, depth: int = 12) -> DataFrame:
    """level_a, level_b, corr: Pearson's over times at which both spreads are there. strip: strip_wide()."""
    pairs = [(i, j) for i in range(1, depth) for j in range(1, depth)]
    upper = {(i, j): F.corr(f"S{i}", f"S{j}") for i, j in pairs if i <= j}
    by = strip.groupBy("root").agg(*[c.alias(f"c_{i}_{j}") for (i, j), c in upper.items()])
    cells = [F.struct(F.lit(i).alias("level_a"), F.lit(j).alias("level_b"), F.col(f"c_{min(i, j)}_{max(i, j)}").alias("corr")) for i, j in pairs]
    return by.select("root", F.inline(F.array(*cells)))


def compare_signals(events: DataFrame) -> DataFrame:
    """Per spread: events, share of all rows, means and deviations with and without event. events: detect_events() of the strip."""
    at = F.when(F.col("event"), F.col("spread"))
    by = events.groupBy("root", "level").agg(
        F.count_if("event").alias("event_count"), (100 * F.count_if("event") / F.count("*")).alias("detection_rate_pct"), F.avg("spread").alias("mean_spread"),
        F.stddev_samp("spread").alias("std_spread"), F.avg(at).alias("mean_event_spread"), F.stddev_samp(at).alias("std_event_spread"),
    )
    return by.withColumn("signal_to_noise", F.col("std_event_spread") / F.when(F.col("std_spread") > 0, F.col("std_spread")))


def event_timing(events: DataFrame, links: DataFrame) -> DataFrame:
    """Each event of the strip with its contract, and the front contract's days to expiry; events without either contract go."""
    own = links.select("root", "ts", F.col("k").alias("level"), "contract", "expiry")
    front = links.where("k = 1").select("root", "ts", F.col("contract").alias("f1_contract"), F.col("expiry").alias("f1_expiry"))
    both = events.where("event").join(own, ["root", "ts", "level"]).join(front, ["root", "ts"])
    return both.select("root", "ts", "level", "spread", "contract", "expiry", F.datediff("f1_expiry", F.to_date("ts")).alias("days_to_expiry"), "f1_contract", "f1_expiry")


def timing_summary(timing: DataFrame, keep=None) -> DataFrame:
    """Per spread: events and the distribution of the front contract's days to expiry at them. keep: see ordered.quantiles(), which then picks the quantiles by rank."""
    d = F.col("days_to_expiry")
    named = timing.withColumn("_level", F.concat(F.lit("S"), F.col("level").cast("string"))).drop("spread").withColumnRenamed("_level", "spread")
    plain = {"count": F.count("*"), "mean": F.avg(d), "std": F.stddev_samp(d)}
    by = lambda more: named.groupBy("root", "spread").agg(*[c.alias(n) for n, c in (plain | more).items()])
    shares = {"median": 0.5, "q25": 0.25, "q75": 0.75}
    if keep is None:
        return by({n: F.percentile(d, F.lit(q)) for n, q in shares.items()})
    picked = quantiles(named, ["root", "spread"], "days_to_expiry", F.array(*map(F.lit, shares.values())), keep)
    wide = picked.groupBy("root", "spread").agg(*[F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(n) for n, q in shares.items()])
    return by({}).join(wide, ["root", "spread"], "left")


def change_statistics(spreads: DataFrame) -> DataFrame:
    """Per spread: mean, deviation, mean size, largest and smallest of changes."""
    c = F.col("change")
    return spread_change(spreads).groupBy("root", "level").agg(F.avg(c).alias("mean_change"), F.stddev_samp(c).alias("std_change"), F.avg(F.abs(c)).alias("mean_abs_change"), F.max(c).alias("max_change"), F.min(c).alias("min_change"))


def magnitudes(spreads: DataFrame) -> DataFrame:
    """Per time: size of the first spread's change, median and mean of the others', their ratio, whether it dominates (over 2), its rank."""
    sized = spread_change(spreads).withColumn("size", F.abs("change"))
    by = sized.groupBy("root", "ts").agg(
        F.max(F.when(F.col("level") == 1, F.col("size"))).alias("s1_change"),
        F.array_sort(F.collect_list(F.when(F.col("level") > 1, F.col("size")))).alias("_others"),  # one for each level at most
    )
    n = F.size("_others")
    middle = F.expr("(_others[(size(_others) - 1) div 2] + _others[size(_others) div 2]) / 2")
    s1 = F.col("s1_change")
    above = F.size(F.filter("_others", lambda x: x > s1))
    equal = F.size(F.filter("_others", lambda x: x == s1)) + 1
    out = by.withColumns({
        "others_median": F.when(n > 0, middle), "others_mean": F.when(n > 0, F.aggregate("_others", F.lit(0.0), lambda a, x: a + x) / n),
        "rank_s1": F.when(s1.isNotNull(), above + (equal + 1) / 2),
    }).withColumn("dominance_ratio", s1 / (F.col("others_median") + EPS))
    return out.withColumn("s1_dominates", F.coalesce(F.col("dominance_ratio") > 2.0, F.lit(False))).drop("_others")


def dominance_by_cycle(sizes: DataFrame, links: DataFrame) -> DataFrame:
    """Per bin of days to the front contract's expiry: observations, how often and how far the first spread dominates."""
    front = links.where("k = 1").select("root", "ts", "expiry")
    rows = sizes.join(front, ["root", "ts"]).withColumn("bin", cycle_bin(days_to_expiry(F.col("expiry"), F.to_date("ts"))))
    return rows.groupBy("root", "bin").agg(
        F.count("*").alias("total_observations"), F.count_if("s1_dominates").alias("s1_dominance_count"), (100 * F.count_if("s1_dominates") / F.count("*")).alias("s1_dominance_rate_pct"),
        F.avg(F.when(F.col("s1_dominates"), F.col("dominance_ratio"))).alias("avg_dominance_ratio"), F.avg("s1_change").alias("avg_s1_change"), F.avg("others_median").alias("avg_others_median"),
    ).withColumn("cycle", cycle_label(F.col("bin")))


def _fixed(x: Column, digits: int) -> Column:
    """x with so many decimals, an exact tie to the even digit."""
    return F.format_string(f"%.{digits}f", F.when(x * 8 == F.floor(x * 8), F.bround(x, digits)).otherwise(x))  # doubles that are ties are eighths


def cross_spread_summary(cycles: DataFrame, significance: float = 10.0) -> DataFrame:
    """Five metrics, in words, of dominance_by_cycle(): the bin of the highest rate among those over the threshold (the first of equal ones), its rate and ratio, what that says."""
    rate = F.col("s1_dominance_rate_pct")
    peak = F.max_by(F.struct("cycle", rate.alias("rate"), F.col("avg_dominance_ratio").alias("ratio")), F.when(rate > significance, F.struct(rate, -F.col("bin"))))
    by = cycles.groupBy("root").agg(peak.alias("peak"))
    found, shown = F.col("peak").isNotNull(), _fixed(F.col("peak.rate"), 1)
    said = F.concat(F.lit("S1 shows peak dominance "), F.col("peak.cycle"), F.lit(" days before F1 expiry ("), shown, F.lit("% of periods)"))
    rows = [
        ("Peak dominance bucket", F.when(found, F.col("peak.cycle")).otherwise("None")), ("Peak dominance rate (%)", F.when(found, shown).otherwise("0.0")),
        ("Average dominance ratio at peak", F.when(found, F.coalesce(_fixed(F.col("peak.ratio"), 2), F.lit("nan"))).otherwise("N/A")),
        ("Interpretation", F.when(found, said).otherwise("No significant S1 dominance detected at any point in the cycle")),
        ("Suggests institutional rolling", F.when(found & (F.col("peak.rate") > 15), "Yes").otherwise("No")),
    ]
    return by.select("root", F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in rows])))


def cumulative_open_days(days: DataFrame) -> DataFrame:
    """days (date, is_open) with n_open: open days up to and with the date. Days of a calendar, not rows of data."""
    return days.withColumn("n_open", F.sum(F.col("is_open").cast("int")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def business_days_to_expiry(rows: DataFrame, days: DataFrame, date: str = "date", expiry: str = "expiry") -> DataFrame:
    """rows with bd_to_expiry: open days after date up to and with expiry; null without expiry, after it, or outside of days. Two equi-joins, no range join."""
    count = cumulative_open_days(days)
    at = lambda key, name: count.select(F.col("date").alias(f"_{key}"), F.col("n_open").alias(name))  # noqa: E731  a row for a day, which Spark broadcasts if its size allows
    both = rows.join(at("d", "_from"), F.col(date) == F.col("_d"), "left").join(at("e", "_to"), F.col(expiry) == F.col("_e"), "left")
    return both.withColumn("bd_to_expiry", F.when(F.col(expiry) >= F.col(date), F.col("_to") - F.col("_from"))).drop("_d", "_e", "_from", "_to")


def strip_dominance(sizes: DataFrame, links: DataFrame, days: DataFrame, threshold: float = 2.0, window: int = 18) -> DataFrame:
    """Per front contract and date: median changes, largest ratio, business days to expiry, and the class of the day. A group is a day's times of one root, whose medians are plain aggregates."""
    front = links.where("k = 1").select("root", "ts", F.col("contract").alias("front_contract"), "expiry")
    by = sizes.join(front, ["root", "ts"]).groupBy("root", "front_contract", F.to_date("ts").alias("date")).agg(
        F.percentile("s1_change", F.lit(0.5)).alias("s1_change"), F.percentile("others_median", F.lit(0.5)).alias("other_median_change"),
        F.coalesce(F.max("dominance_ratio"), F.lit(0.0)).alias("dominance_ratio"), F.max("expiry").alias("expiry"),
    )
    dated = business_days_to_expiry(by, days).withColumnRenamed("bd_to_expiry", "business_days_to_expiry")
    wins, near = F.col("dominance_ratio") >= threshold, F.coalesce(F.col("business_days_to_expiry") <= window, F.lit(False))
    return dated.withColumn("classification", F.when(wins & near, "expiry_dominance").when(wins, "broad_roll").otherwise("normal"))


def filter_expiry_dominance(events: DataFrame, classified: DataFrame, event: str = "event") -> DataFrame:
    """events with removed (an event on a date that is classed as expiry dominance), and those events cleared."""
    dates = classified.where("classification = 'expiry_dominance'").select("root", F.col("date").alias("_on")).distinct()
    both = events.withColumn("_day", F.to_date("ts")).alias("x").join(dates.alias("y"), (F.col("x.root") == F.col("y.root")) & (F.col("_day") == F.col("_on")), "left")
    gone: Column = F.col("_on").isNotNull() & F.col(f"x.{event}")
    return both.select("x.*", gone.alias("removed")).withColumn(event, F.col(event) & ~F.col("removed")).drop("_day")
