"""Trading calendars: classification, merging, checking, open days and exchange holiday rules.

A calendar row is (date, holiday_name, session_note, partial_hours); only exceptional days are listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notes of days without trading; all notes a calendar may have (fixed values).
CLOSED = ["closed", "full close"]
NOTES = ["", "regular", "early close", "closed", "full close"]


def classify(calendar: DataFrame) -> DataFrame:
    """calendar with notes in their plain form (open is regular) and is_trading_day; an unknown note is an error, rows without date go."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in calendar.columns else F.lit("")
    note = F.lower(F.trim(text("session_note")))
    note = F.when(note == "open", "regular").otherwise(note)
    valid = F.when(note.isin(NOTES), note).otherwise(F.raise_error(F.concat(F.lit("unknown session_note: "), note)).cast("string"))
    rows = calendar.where("date is not null").select("date", text("holiday_name").alias("holiday_name"), valid.alias("session_note"), text("partial_hours").alias("partial_hours"))
    return rows.withColumn("is_trading_day", ~F.col("session_note").isin(CLOSED))


def merge(calendars: list[DataFrame], hierarchy: str = "override") -> DataFrame:
    """One row for a date. override: the first calendar that lists it; union: dates of any, open if all that list it are; intersection: dates of all.

    Texts are the first that aren't empty (override and intersection: the first calendar's).
    """
    if hierarchy not in ("override", "union", "intersection"):
        raise ValueError(f"unknown hierarchy: {hierarchy}")
    if not calendars:
        raise FileNotFoundError("no calendar")
    rows = reduce(DataFrame.unionByName, [c.withColumn("_p", F.lit(i)) for i, c in enumerate(calendars)])
    text = lambda c, always: F.coalesce(F.min_by(c, F.when(F.lit(always) | (F.col(c) != ""), F.col("_p"))), F.lit("")).alias(c)
    named = [text(c, hierarchy != "union") for c in ("holiday_name", "session_note", "partial_hours")]
    opened = F.min_by("is_trading_day", "_p") if hierarchy == "override" else F.bool_and("is_trading_day")
    out = rows.groupBy("date").agg(*named, opened.alias("is_trading_day"), F.count_distinct("_p").alias("_n"))
    return (out.where(F.col("_n") == len(calendars)) if hierarchy == "intersection" else out).drop("_n")


def lint(calendar: DataFrame) -> DataFrame:
    """level, message, date of what is wrong with a calendar: unknown notes (errors) and each further row of a date (warnings); rows without a date don't count."""
    rows = calendar.where("date is not null") if "session_note" in calendar.columns else calendar.where("date is not null").withColumn("session_note", F.lit(""))
    said = F.coalesce("session_note", F.lit(""))
    errors = rows.where(~F.lower(F.trim(said)).isin(NOTES)).select(F.lit("error").alias("level"), F.concat(F.lit("Unknown session_note value: '"), said, F.lit("'")).alias("message"), "date")
    more = rows.groupBy("date").agg(F.count("*").alias("n")).where("n > 1")
    return errors.unionAll(more.select(F.lit("warning").alias("level"), F.lit("Duplicate date").alias("message"), F.explode(F.expr("array_repeat(date, cast(n - 1 as int))")).alias("date")))


def difference(ours: DataFrame, theirs: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Closed days of a span of years that only one of two calendars has: date, kind (missing in ours, extra in ours)."""
    closed = lambda c: c.where(~F.col("is_trading_day") & F.year("date").between(first_year, last_year)).select("date").distinct()
    a, b = closed(ours), closed(theirs)
    return b.join(a, "date", "left_anti").withColumn("kind", F.lit("missing")).unionAll(a.join(b, "date", "left_anti").withColumn("kind", F.lit("extra")))


def open_days(spark: SparkSession, start: str, end: str, calendar: DataFrame | None = None) -> DataFrame:
    """date, is_open of every day of a span: as the calendar lists it, else open on weekdays."""
    return open_days_of(spark.sql(f"select date '{start}' as first, date '{end}' as last"), calendar)


def open_days_of(span: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """open_days() of the span in a row (first, last), which may come from data."""
    days = span.select(F.explode(F.expr("sequence(first, last, interval 1 day)")).alias("date"))
    weekday = F.expr("weekday(date) < 5")
    if calendar is None:
        return days.withColumn("is_open", weekday)
    return days.join(calendar.select("date", "is_trading_day"), "date", "left").select("date", F.coalesce("is_trading_day", weekday).alias("is_open"))


def _nth(year: Column, month: int, weekday: int, n: int) -> Column:
    """The nth weekday (0 is Monday) of a month; the last for n = -1."""
    if n < 0:
        last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
        return F.date_sub(last, F.pmod(F.weekday(last) - weekday, F.lit(7)))
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))


def easter(year: str) -> Column:
    """Easter Sunday of a column of years, by the anonymous Gregorian computus."""
    g, c = f"({year} % 19)", f"({year} div 100)"
    h = f"(({c} - {c} div 4 - (8 * {c} + 13) div 25 + 19 * {g} + 15) % 30)"
    i = f"({h} - {h} div 28 * (1 - 29 div ({h} + 1) * ((21 - {g}) div 11)))"
    j = f"(({year} + {year} div 4 + {i} + 2 - {c} + {c} div 4) % 7)"
    l_ = f"({i} - {j})"
    month = f"(3 + ({l_} + 40) div 44)"
    return F.expr(f"make_date({year}, cast({month} as int), cast({l_} + 28 - 31 * ({month} div 4) as int))")


#: Holidays on which an exchange may be open (fixed values); holiday_check() doesn't ask for them.
OPEN_HOLIDAYS = ["Martin Luther King Jr. Day", "Presidents' Day", "Juneteenth"]


def holiday_check(calendar: DataFrame, years: DataFrame) -> DataFrame:
    """years (year): year, holiday, date, status of each holiday that a calendar should list, by rule and moved off a weekend: found, misnamed or missing.

    A Saturday's holiday is observed on the Friday before, a Sunday's on the Monday after. Names count as equal if one begins with the other's
    first ten characters, without " Day".
    """
    rules = rules_of(years).where(~F.col("holiday").isin(OPEN_HOLIDAYS))
    day = F.dayofweek("date")
    observed = rules.withColumn("date", F.when(day == 7, F.date_sub("date", 1)).when(day == 1, F.date_add("date", 1)).otherwise(F.col("date")))
    listed = calendar.select("date", F.col("holiday_name").alias("_name"), F.lit(True).alias("_listed")).dropDuplicates(["date"])
    plain = lambda c: F.lower(F.replace(F.col(c), F.lit(" Day"), F.lit("")))
    status = F.when(F.col("_listed").isNull(), "missing").when(plain("_name").startswith(F.substring(plain("holiday"), 1, 10)), "found").otherwise("misnamed")
    return observed.join(listed, "date", "left").select("year", "holiday", "date", status.alias("status"))


def holiday_rules(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """year, holiday, date of a US exchange's regular holidays by their rules, before any move off a weekend."""
    return rules_of(spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year")))


def rules_of(years: DataFrame) -> DataFrame:
    """holiday_rules() of a table of years (year int), which may come from data."""
    y = F.col("year")
    fixed = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    rules = {
        "New Year's Day": fixed(1, 1), "Martin Luther King Jr. Day": _nth(y, 1, 0, 3), "Presidents' Day": _nth(y, 2, 0, 3), "Good Friday": F.date_sub(easter("year"), 2),
        "Memorial Day": _nth(y, 5, 0, -1), "Juneteenth": fixed(6, 19), "Independence Day": fixed(7, 4), "Labor Day": _nth(y, 9, 0, 1), "Thanksgiving": _nth(y, 11, 3, 4), "Christmas Day": fixed(12, 25),
    }
    return years.select("year", F.inline(F.array(*[F.struct(F.lit(k).alias("holiday"), d.alias("date")) for k, d in rules.items()])))
