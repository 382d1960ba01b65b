"""Panel, contract chain, calendar spreads and liquidity: long rows, one for each root, time and contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sessions import bucket_info

#: Contracts of the chain.
DEPTH = 12


def expiry_dim(metadata: DataFrame) -> DataFrame:
    """contract, expiry (and source columns, if there) of contract metadata; of a repeated contract the first row by line, or without that column the row of the earliest expiry."""
    order = Window.partitionBy("contract").orderBy(*([F.col("line")] if "line" in metadata.columns else []), "expiry")
    return metadata.where("contract is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "line")


def missing_expiry(bars: DataFrame, dim: DataFrame) -> list[str]:
    """The first ten contracts of bars that dim lacks."""
    return [r[0] for r in bars.select("contract").distinct().join(dim, "contract", "left_anti").orderBy("contract").limit(10).collect()]


def assemble_panel(bars: DataFrame, dim: DataFrame, check: bool = True) -> DataFrame:
    """bars with the expiry of their contracts; an error names contracts without one, or says that there are no bars."""
    if check and bars.isEmpty():
        raise ValueError("no bars for a panel")
    if check and (lost := missing_expiry(bars, dim)):
        raise ValueError(f"no expiry for contracts: {', '.join(lost)}")
    return bars.join(dim, "contract", "left")


def panel_meta(panel: DataFrame) -> DataFrame:
    """root, ts and the bucket, with its label and session, of the first contract, by name, that has one."""
    by = panel.groupBy("root", "ts").agg(F.min_by("bucket", F.when(F.col("bucket").isNotNull(), F.col("contract"))).alias("bucket"))
    return by.withColumns({"bucket_label": bucket_info(F.col("bucket"), "label"), "session": bucket_info(F.col("bucket"), "session")})


def grid(panel: DataFrame) -> DataFrame:
    """All times of each root, whether or not a contract is alive then."""
    return panel.select("root", "ts").distinct()


def chain(panel: DataFrame, depth: int = DEPTH, price: str = "close", volume: str = "volume") -> DataFrame:
    """The first contracts by expiry, then name, that have a price and haven't expired (on the day itself they still count): k from 1.

    price, volume: the columns of the panel that count as close and volume from here on.
    """
    if lost := {price, volume} - set(panel.columns):
        raise ValueError(f"the panel has no column {', '.join(sorted(lost))}")
    alive = panel.where(F.col(price).isNotNull() & (F.col("expiry") >= F.to_date("ts")))
    k = F.row_number().over(Window.partitionBy("root", "ts").orderBy("expiry", "contract"))
    return alive.select("root", "ts", "contract", F.col(price).alias("close"), F.col(volume).alias("volume"), "expiry", k.alias("k")).where(F.col("k") <= depth)


def chain_wide(links: DataFrame, times: DataFrame, depth: int = DEPTH, value: str = "contract", prefix: str = "F") -> DataFrame:
    """One row for each time, with the chain's values in columns; null where there are fewer contracts."""
    wide = links.groupBy("root", "ts").agg(*[F.max(F.when(F.col("k") == i, F.col(value))).alias(f"{prefix}{i}") for i in range(1, depth + 1)])
    return times.join(wide, ["root", "ts"], "left")


def front_next(links: DataFrame, times: DataFrame) -> DataFrame:
    """Front and next contract of each time, with their closes, volumes and expiries."""
    one = lambda i, c: F.max(F.when(F.col("k") == i, F.col(c)))
    both = [one(i, c).alias(f"{name}_{c}") for i, name in ((1, "front"), (2, "next")) for c in ("contract", "close", "volume", "expiry")]
    return times.join(links.where("k <= 2").groupBy("root", "ts").agg(*both), ["root", "ts"], "left")


def calendar_spread(pairs: DataFrame) -> DataFrame:
    """Next close minus front close of each time; null if either is missing."""
    return pairs.select("root", "ts", F.lit(1).alias("level"), (F.col("next_close") - F.col("front_close")).alias("spread"))


def multi_spreads(links: DataFrame, times: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Long strip: for each time and level i, close of contract i + 1 minus close of contract i, null rows included."""
    wide = chain_wide(links, times, depth, "close", "c")
    levels = F.array(*[F.struct(F.lit(i).alias("level"), (F.col(f"c{i + 1}") - F.col(f"c{i}")).alias("spread")) for i in range(1, depth)])
    return wide.select("root", "ts", F.inline(levels))


def strip_wide(spreads: DataFrame, value: str = "spread", depth: int = DEPTH, prefix: str = "S") -> DataFrame:
    """The strip with a column for each level."""
    return spreads.groupBy("root", "ts").agg(*[F.max(F.when(F.col("level") == i, F.col(value))).alias(f"{prefix}{i}") for i in range(1, depth)])


def liquidity_signal(pairs: DataFrame, alpha: float = 0.8, confirm: int = 1) -> DataFrame:
    """Whether the next contract's volume has come up to alpha times the front's, confirmed over so many rows (the first ones count as confirmed)."""
    now = F.coalesce((F.col("next_volume") >= alpha * F.col("front_volume")) & (F.col("front_volume") > 0), F.lit(False))
    signal = pairs.select("root", "ts", now.alias("signal"))
    if confirm <= 1:
        return signal
    w = Window.partitionBy("root").orderBy("ts")
    held = (F.min(F.col("signal").cast("int")).over(w.rowsBetween(1 - confirm, 0)) == 1) | (F.row_number().over(w) < confirm)
    return signal.select("root", "ts", held.alias("signal"))


def front_next_volume(pairs: DataFrame) -> DataFrame:
    """Volume of front and next contract together, and front_expiry; the volume is null if a contract that is there has none."""
    part = lambda name: F.when(F.col(f"{name}_contract").isNull(), 0.0).otherwise(F.col(f"{name}_volume"))
    return pairs.select("root", "ts", (part("front") + part("next")).alias("volume"), "front_expiry")
