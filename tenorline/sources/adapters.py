"""The shared test tables as ticks and minutes of dated contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calendars import classify


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks_of(events: DataFrame, root: Column | None = None) -> DataFrame:
    """Rows of events, a table or a stream, as ticks: contract by user, price is value, volume is the number in props; times are unique."""
    k = F.col("user_id") % 12
    price = F.col("value")
    contract = F.concat(F.lit("C"), F.lpad(k.cast("string"), 2, "0"))
    volume = F.regexp_extract("props", "([0-9]+)", 1).try_cast("double")
    return events.select((F.lit("EV") if root is None else root).alias("root"), contract.alias("contract"), "ts", *[price.alias(c) for c in ("open", "high", "low", "close")], volume.alias("volume"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ticks."""
    return ticks_of(table(spark, sf_dir, "events"))


def tick_expiry(spark: SparkSession) -> DataFrame:
    """Expiries of the contracts of ticks(), three days apart."""
    return spark.sql("select concat('C', lpad(cast(k as string), 2, '0')) as contract, date_add(date '2024-01-03', cast(3 * k as int)) as expiry from (select explode(sequence(0, 11)) as k)")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as trades of quarterly contracts, with the order of trades within a day: of the contract of its part, or, once that has expired, of the first that hasn't."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    # The first quarter whose end, on a 28th, isn't before the day.
    months = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 3 + F.when(F.dayofmonth("l_shipdate") > 28, 1).otherwise(0)
    k = F.greatest(F.col("l_partkey") % 24, F.ceil(months / 3))
    return table(spark, sf_dir, "lineitem").select(
        F.lit("LI").alias("root"), F.concat(F.lit("L"), F.lpad(k.cast("string"), 2, "0")).alias("contract"), F.col("l_shipdate").alias("ts"),
        *[price.alias(c) for c in ("open", "high", "low", "close")], F.col("l_quantity").alias("volume"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("seq"),
    )


def user_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract metadata from events, a line for each user, so that contracts repeat with other expiries: contract, expiry, line."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    k = F.col("user_id") % 12
    days = (3 * k + F.floor(F.col("user_id") / 12)).cast("int")
    return users.select(F.concat(F.lit("C"), F.lpad(k.cast("string"), 2, "0")).alias("contract"), F.date_add(F.lit("2024-01-03").cast("date"), days).alias("expiry"), F.col("user_id").alias("line"))


#: The note that an order's priority stands for.
NOTES = {"1-URGENT": "Closed", "2-HIGH": "Early close", "3-MEDIUM": " Open", "5-LOW": "FULL close"}
#: Names of days, by the order's key.
DAY_NAMES = ["New Year's", "Good Friday", "Memorial Day", "Independence Day", "Labor Day", "Thanksgiving", "Christmas", "Fair"]


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as lines of a calendar file, one for each order: date, holiday_name, session_note, partial_hours, status, line; dates repeat."""
    note = F.element_at(F.create_map(*[F.lit(x) for kv in NOTES.items() for x in kv]), F.col("o_orderpriority"))
    name = F.element_at(F.array(*map(F.lit, DAY_NAMES)), (F.col("o_orderkey") % len(DAY_NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("date"), name.alias("holiday_name"), note.alias("session_note"), F.when(note == "Early close", "09:00-13:00").alias("partial_hours"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("line"),
    )


def order_calendar(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    """A classified calendar of the days with orders of a status: the line of the smallest key for each."""
    lines = order_days(spark, sf_dir).where(F.col("status") == status)
    first = lines.groupBy("date").agg(F.min_by(F.struct("holiday_name", "session_note", "partial_hours"), "line").alias("x"))
    return classify(first.select("date", "x.*"))


#: Exceptional days of January 2024: date, holiday, note, hours.
EXCHANGE = [("2024-01-01", "New Year's Day", "Closed", ""), ("2024-01-15", "MLK Day", "Open", ""), ("2024-01-19", "Half day", "Early close", "09:00-13:00")]


def raw_calendar(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """Calendar rows as a file would have them."""
    return spark.createDataFrame(rows, "date string, holiday_name string, session_note string, partial_hours string").withColumn("date", F.col("date").cast("date"))


def calendar(spark: SparkSession, rows: list[tuple[str, str, str, str]] = EXCHANGE) -> DataFrame:
    """A classified calendar."""
    return classify(raw_calendar(spark, rows))
