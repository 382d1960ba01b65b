"""The frames that most queries share, from a data folder: bars, panel, chain, spreads, events, business days."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars, bizdays, calendars, chain, events, quality, strip
from ..sources import adapters
from ..sources.storage import Scratch


class Market:
    """Lazy frames of one data folder; each is a plan, nothing runs before an action."""

    def __init__(self, spark: SparkSession, sf_dir: str, roots: int = 1):
        self.spark, self.sf_dir, self.roots = spark, sf_dir, roots

    @cached_property
    def minutes(self) -> DataFrame:
        """Ticks of one root, or of several, by user."""
        rows = adapters.table(self.spark, self.sf_dir, "events")
        return adapters.ticks_of(rows, F.concat(F.lit("E"), (F.col("user_id") % self.roots).cast("string")) if self.roots > 1 else F.lit("EV"))

    #: Tables that a query writes on its way; they live as long as its result is read from them.
    scratch = cached_property(lambda self: Scratch(self.spark))
    bars = cached_property(lambda self: bars.bucket_bars(self.minutes))
    expiry = cached_property(lambda self: adapters.tick_expiry(self.spark))
    panel = cached_property(lambda self: chain.assemble_panel(self.bars, self.expiry, check=False))
    links = cached_property(lambda self: chain.chain(self.panel))
    times = cached_property(lambda self: chain.grid(self.panel))
    pairs = cached_property(lambda self: chain.front_next(self.links, self.times))
    meta = cached_property(lambda self: chain.panel_meta(self.panel))
    spread = cached_property(lambda self: chain.calendar_spread(self.pairs))
    strip = cached_property(lambda self: chain.multi_spreads(self.links, self.times))
    strip_events = cached_property(lambda self: events.detect_events(self.strip, window=20))
    cooled = cached_property(lambda self: events.cooldown_time(events.detect_events(self.spread, window=20), 3.0))
    calendar = cached_property(lambda self: adapters.calendar(self.spark))
    days = cached_property(lambda self: calendars.open_days(self.spark, "2023-12-25", "2024-03-01", self.calendar))
    sizes = cached_property(lambda self: strip.magnitudes(self.strip))
    classified = cached_property(lambda self: strip.strip_dominance(self.sizes, self.links, self.days))

    def audit(self, policy: str = "calendar_only") -> DataFrame:
        """Business-day audit of the ticks' bars."""
        return bizdays.audit(self.pairs, self.meta, self.calendar, bizdays.Coverage(policy=policy))

    business_days = cached_property(lambda self: bizdays.business_days(self.audit()))

    @cached_property
    def marked(self) -> DataFrame:
        """Cooled events with bucket and front volume."""
        return self.cooled.join(self.meta, ["root", "ts"], "left").join(self.pairs.select("root", "ts", self.pairs["front_volume"].alias("volume")), ["root", "ts"], "left")

    trades = cached_property(lambda self: adapters.trades(self.spark, self.sf_dir))
    daily = cached_property(lambda self: bars.daily_bars(self.trades, order=self.trades["seq"]))
    rules = quality.Quality(cutoff_year=2010, min_data_points=300, max_gap_days=20, min_coverage_percent=60.0, commodity="L")
