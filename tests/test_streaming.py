"""Streams cut at random, stopped and started again, give what the batch operators give."""

import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tenorline.operators import bars, events
from tenorline.sources import adapters
from tenorline.streaming import bars as stream_bars
from tenorline.streaming import cooldown

SF = "/root/testdata/sf0.001"
COLUMNS = ["root", "contract", "ts", "bucket", "open", "high", "low", "close", "volume"]


def rows(df, columns=COLUMNS):
    return sorted(tuple(r) for r in df.select(columns).collect())


def deal(table: pa.Table, folder, names):
    """A table's rows in order, as a file for each name, cut at random."""
    r = random.Random(4)
    cuts = [0, *sorted(r.sample(range(1, table.num_rows), len(names) - 1)), table.num_rows]
    for name, a, b in zip(names, cuts, cuts[1:]):
        pq.write_table(table.slice(a, b - a), folder / f"{name}.parquet")


def ticks_of(spark, folder):
    stream = stream_bars.read_stream(spark, str(folder), 1)
    return adapters.ticks_of(stream)


def test_bars_over_restarts(spark, tmp_path):
    """A stream that is stopped in the middle and goes on from its checkpoint counts nothing twice and loses nothing; closed bars are those of the batch."""
    table = pq.read_table(f"{SF}/events.parquet").sort_by("ts")
    inbox = tmp_path / "in"
    inbox.mkdir()
    half = table.num_rows // 2
    deal(table.slice(0, half), inbox, ["a", "b", "c"])
    for _ in range(2):  # the second time there is nothing new
        made = stream_bars.bucket_bars(ticks_of(spark, inbox))
        stream_bars.write_current(made, str(tmp_path / "now"), str(tmp_path / "c1")).awaitTermination()
        stream_bars.write_closed(made, str(tmp_path / "closed"), str(tmp_path / "c2")).awaitTermination()
    first = bars.bucket_bars(adapters.ticks_of(spark.createDataFrame(table.slice(0, half).to_pandas(), spark.read.parquet(f"{SF}/events.parquet").schema)))
    assert rows(stream_bars.current(spark, str(tmp_path / "now"))) == rows(first)
    deal(table.slice(half), inbox, ["d", "e"])
    made = stream_bars.bucket_bars(ticks_of(spark, inbox))
    stream_bars.write_current(made, str(tmp_path / "now"), str(tmp_path / "c1")).awaitTermination()
    stream_bars.write_closed(made, str(tmp_path / "closed"), str(tmp_path / "c2")).awaitTermination()
    want = bars.bucket_bars(adapters.ticks(spark, SF))
    assert rows(stream_bars.current(spark, str(tmp_path / "now"))) == rows(want)
    closed, last = rows(spark.read.parquet(str(tmp_path / "closed"))), want.agg(F.max("ts")).first()[0]
    assert closed == [r for r in rows(want) if r[2] <= last - dt.timedelta(hours=6)]


def test_a_batch_that_failed_is_replaced(spark, tmp_path):
    """What an attempt at a batch has left is overwritten by the next, not added to."""
    made = stream_bars.bucket_bars(adapters.ticks_of(stream_bars.read_stream(spark, f"{SF}/events.parquet")))
    bars.bucket_bars(adapters.ticks(spark, SF)).limit(5).write.parquet(str(tmp_path / "now" / "batch=0"))
    stream_bars.write_current(made, str(tmp_path / "now"), str(tmp_path / "c")).awaitTermination()
    assert rows(stream_bars.current(spark, str(tmp_path / "now"))) == rows(bars.bucket_bars(adapters.ticks(spark, SF)))


def test_late_ticks_are_dropped_and_counted(spark, tmp_path):
    """A tick of a bar that is closed changes nothing and shows in the progress; one within the delay counts."""
    table = pq.read_table(f"{SF}/events.parquet").sort_by("ts")
    inbox = tmp_path / "in"
    inbox.mkdir()
    day = dt.datetime(2024, 1, 20)
    early = table.filter(pa.array([t < day for t in table["ts"].to_pylist()]))
    deal(early, inbox, ["a", "b"])
    run = lambda: stream_bars.write_current(stream_bars.bucket_bars(ticks_of(spark, inbox)), str(tmp_path / "now"), str(tmp_path / "c"))
    run().awaitTermination()
    one = lambda t: pa.table({"event_id": [-1], "ts": [t], "user_id": [0], "event_type": ["late"], "value": [1e6], "props": ['{"k": 7}']}).cast(table.schema)
    pq.write_table(one(dt.datetime(2024, 1, 3, 10)), inbox / "c.parquet")
    query = run()
    query.awaitTermination()
    assert stream_bars.current(spark, str(tmp_path / "now")).where("high = 1e6").count() == 0
    assert sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]) == 1
    pq.write_table(one(early["ts"].to_pylist()[-1]), inbox / "d.parquet")
    run().awaitTermination()
    assert stream_bars.current(spark, str(tmp_path / "now")).where("high = 1e6").count() == 1


def test_cool_down_cut_at_random(spark, tmp_path):
    """Series in batches cut at random, with events out of order within the delay and a restart, keep the events of the batch operator."""
    r = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    made = sorted({(f"R{i % 2}", i % 3, start + dt.timedelta(minutes=r.randrange(40_000), microseconds=r.randrange(10**6))) for i in range(600)}, key=lambda x: x[2])
    given = [(*x, r.random() < 0.8) for x in made]
    mixed = [g for _, g in sorted((i + r.randrange(8), g) for i, g in enumerate(given))]
    inbox = tmp_path / "in"
    inbox.mkdir()
    table = pa.table({"root": [g[0] for g in mixed], "level": pa.array([g[1] for g in mixed], pa.int32()), "ts": pa.array([g[2] for g in mixed], pa.timestamp("us")), "event": [g[3] for g in mixed]})
    cut = table.num_rows // 3
    run = lambda: cooldown.write(cooldown.cooldown_time(stream_bars.read_stream(spark, str(inbox), 2), 5.0, "2 days"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    deal(table.slice(0, cut), inbox, "abcd")
    run()
    deal(table.slice(cut), inbox, "efghi")
    # A row far ahead, of a series of its own, lets the watermark pass all others.
    pq.write_table(pa.table({"root": ["end"], "level": pa.array([0], pa.int32()), "ts": pa.array([start + dt.timedelta(days=90)], pa.timestamp("us")), "event": [True]}), inbox / "z.parquet")
    run()
    batch = events.cooldown_time(spark.createDataFrame(given, "root string, level int, ts timestamp_ntz, event boolean"), 5.0).where("kept")
    got = spark.read.parquet(str(tmp_path / "out")).where("root <> 'end'")
    assert rows(got, ["root", "level", "ts"]) == rows(batch, ["root", "level", "ts"]) and got.count() > 50


def test_cool_down_of_long_series_to_the_last_event(spark, tmp_path):
    """Of a stream in order, all events are judged, the latest one of all, between two milliseconds, too; series of thousands of events take no call to the state for each."""
    r = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    given = sorted({("R", i % 2, start + dt.timedelta(seconds=r.randrange(2_000_000), microseconds=r.randrange(10**6))) for i in range(20_000)}, key=lambda x: x[2])
    end = given[-1][2] + dt.timedelta(hours=3)
    given += [("R", 0, end.replace(microsecond=500_250)), ("R", 1, end.replace(microsecond=500_750))]
    inbox = tmp_path / "in"
    inbox.mkdir()
    table = pa.table({"root": [g[0] for g in given], "level": pa.array([g[1] for g in given], pa.int32()), "ts": pa.array([g[2] for g in given], pa.timestamp("us")), "event": [True] * len(given)})
    for part in (table.slice(0, 15_000), table.slice(15_000)):  # the second time from the checkpoint
        pq.write_table(part, inbox / f"{part.num_rows}.parquet")
        cooldown.write(cooldown.cooldown_time(stream_bars.read_stream(spark, str(inbox)), 2.0), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    batch = events.cooldown_time(spark.createDataFrame([(*g, True) for g in given], "root string, level int, ts timestamp_ntz, event boolean"), 2.0).where("kept")
    got = rows(spark.read.parquet(str(tmp_path / "out")), ["root", "level", "ts"])
    assert got == rows(batch, ["root", "level", "ts"]) and [x[2].microsecond for x in got if x[2] > end - dt.timedelta(minutes=1)] == [500_250, 500_750]
