"""Next values along an order, and chains of them, without a task that holds a whole series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_value(asked: DataFrame, values: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """keys, at, next: for each different (keys, at) of asked the least at of values with these keys that isn't below it; null without one.

    chunk: an expression of at that rises with it and cuts a series into stretches. Each is a window of its own, and what a
    stretch doesn't know is the first value of the next stretch that has any, which takes a row for each stretch.
    """
    both = asked.select(*keys, "at", F.lit(None).cast(dict(values.dtypes)["at"]).alias("_own")).unionByName(values.select(*keys, "at", F.col("at").alias("_own")))
    both = both.groupBy(*keys, "at").agg(F.max("_own").alias("_own"), F.count_if(F.col("_own").isNull()).alias("_asked")).withColumn("_chunk", chunk)
    inside = F.min("_own").over(Window.partitionBy(*keys, "_chunk").orderBy("at").rowsBetween(0, Window.unboundedFollowing))
    firsts = both.groupBy(*keys, "_chunk").agg(F.min("_own").alias("_first"))
    later = F.min("_first").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing))
    carry = firsts.select(*keys, "_chunk", later.alias("_carry"))
    found = both.withColumn("_inside", inside).where("_asked > 0").join(carry, [*keys, "_chunk"])
    return found.select(*keys, "at", F.coalesce("_inside", "_carry").alias("next"))


def numbered(df: DataFrame, keys: list[str], by: list[str], keep) -> DataFrame:
    """df with n, its place from 0 in its series (keys) in the order of by, which should tell a series' rows apart; without a window over a series.

    Rows are sorted by range, so a long series lies in several tasks, and written (keep(df, name)), which fixes their order; each task's rows of a
    series are counted, and these counts, a row for each task and series, give what lies before.
    """
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.repartitionByRange(tasks, *keys, *by).sortWithinPartitions(*keys, *by).withColumn("_at", F.monotonically_increasing_id())
    rows = keep(rows, "numbered").withColumn("_task", F.shiftright("_at", 33))
    counts = rows.groupBy(*keys, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_many"))
    before = F.coalesce(F.sum("_many").over(Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_task").alias("_of"), (before - F.col("_first")).alias("_shift"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("_task") == F.col("_of"))
    return rows.join(places, same).withColumn("n", F.col("_at") + F.col("_shift")).select(*df.columns, "n")


def quantiles(df: DataFrame, keys: list[str], value: str, qs: Column, keep) -> DataFrame:
    """keys, q, quantile: exact quantiles of the values that aren't null, with linear interpolation, picked by rank: no aggregate holds a group's values.

    qs: an array of shares, which may depend on the keys. Groups without values have no rows. Rows of one group and value, two numbers
    each, lie in one task.
    """
    rows = numbered(df.select(*keys, F.col(value).cast("double").alias("_value")).where("_value is not null"), keys, ["_value"], keep)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_many")).withColumn("q", F.explode(qs)).withColumn("_place", (F.col("_many") - 1) * F.col("q"))
    asked = sizes.withColumn("_end", F.explode(F.array(F.lit(0), F.lit(1))))
    asked = asked.select(*[F.col(k).alias(f"_{k}") for k in keys], "q", "_place", "_end", F.when(F.col("_end") == 0, F.floor("_place")).otherwise(F.ceil("_place")).cast("long").alias("_n"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("n") == F.col("_n"))
    end = lambda i: F.max(F.when(F.col("_end") == i, F.col("_value")))
    both = rows.join(asked, same).groupBy(*keys, "q").agg(end(0).alias("_a"), end(1).alias("_b"), F.first("_place").alias("_place"))
    return both.select(*keys, "q", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_place") - F.floor("_place"))).alias("quantile"))


def in_chunks(df: DataFrame, keys: list[str], by: list[str], halo: int, keep, chunk: int, work) -> DataFrame:
    """work(df, keys) of series that are cut into chunks of so many rows, each with the halo rows before it, so that a window that looks no further back is the same as over the whole series.

    work: a function that adds columns by windows over keys in the order of by; rows of halos are dropped from what it gives.
    """
    rows = numbered(df, keys, by, keep).withColumn("_chunk", F.floor(F.col("n") / chunk))
    # The last rows of a chunk belong to the next ones, too; a chunk shorter than the halo reaches over several.
    reach = F.floor((F.col("n") + halo) / chunk)
    rows = rows.withColumn("_in", F.explode(F.sequence(F.col("_chunk"), reach)))
    return work(rows, [*keys, "_in"]).where("_in = _chunk").drop("_in", "_chunk", "n")


def reached(pointers: DataFrame, keys: list[str], keep) -> DataFrame:
    """keys, at of the places that are reached from each series' first one along pointers (keys, at, next), by pointer doubling.

    Tables of steps of 1, 2, 4, ... are made until a step leads out of all series; then, from the longest on, what is reached so far
    takes a step of each length. A series with n places on its way takes some 2 log n equi-joins on (keys, at), whatever its length, and
    no row holds more than one place. keep(df, name): writes a frame and reads it back, as each is read several times.
    """
    step = keep(pointers.where("next is not null").select(*keys, "at", "next"), "step")
    first = pointers.groupBy(*keys).agg(F.min("at").alias("at"))
    seen, steps = keep(first, "reached"), [step]
    on = lambda a, b, left, right: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys]) & (a[left] == b[right])
    while True:
        a, b = steps[-1].alias("a"), steps[-1].alias("b")
        if seen.alias("a").join(steps[-1].alias("b"), on(_As("a"), _As("b"), "at", "at"), "left_semi").isEmpty():
            break
        twice = a.join(b, on(_As("a"), _As("b"), "next", "at")).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.at").alias("at"), F.col("b.next").alias("next"))
        steps.append(keep(twice, "step"))
    for step in reversed(steps[:-1]):
        further = seen.alias("a").join(step.alias("b"), on(_As("a"), _As("b"), "at", "at")).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("b.next").alias("at"))
        seen = keep(seen.unionByName(further), "reached")
    return seen


class _As:
    """Columns of an aliased frame."""

    def __init__(self, name: str) -> None:
        self.name = name

    def __getitem__(self, column: str) -> Column:
        return F.col(f"{self.name}.{column}")
