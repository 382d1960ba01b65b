"""Cases that the shared tables don't have: spikes, cool-downs, calendars, coverage, files, whole runs."""

import dataclasses
import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tenorline.functions.contracts import normalize_contract
from tenorline.functions.sessions import bucket_of_hour
from tenorline import cli
from tenorline.operators import bars, calendars, chain, events, quality, strip
from tenorline.plans import pipelines, upkeep
from tenorline.plans.settings import settings
from tenorline.sources import files, inventory
from tenorline.sources.storage import Scratch

MINUTE = "root string, contract string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def minutes(spark, n=3 * 1440, start=dt.datetime(2024, 1, 15), contract="HGH2024", seed=42, root="HG"):
    r, price, rows = random.Random(seed), 100.0, []
    for i in range(n):
        price += r.gauss(0, 0.1)
        rows.append((root, contract, start + dt.timedelta(minutes=i), price, price + 0.2, price - 0.2, price + 0.1, float(r.randrange(1, 100))))
    return spark.createDataFrame(rows, MINUTE)


def series(spark, values):
    rows = [("R", 1, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "root string, level int, ts timestamp_ntz, spread double")


def test_codes(spark):
    names = {"HGZ25.csv": "HGZ2025", "hg_z_2025.txt": "HGZ2025", "foo_HGZ9.parquet": "HGZ2009", "HGK2024-data.csv": "HGK2024", "HGZ99": "HGZ1999", "nothing": None}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", normalize_contract(F.col("n"), "HG").alias("c"))
    assert {r["n"]: r["c"] for r in df.collect()} == names


def test_bad_hour(spark):
    with pytest.raises(Exception, match="hour out of range"):
        spark.range(24, 25).select(bucket_of_hour(F.col("id"))).collect()


def test_bars_conserve(spark):
    fine = minutes(spark)
    made = bars.bucket_bars(fine)
    a, b = (x.agg(F.sum("volume"), F.max("high"), F.min("low")).first() for x in (fine, made))
    assert a[0] == pytest.approx(b[0]) and a[1:] == b[1:]
    assert bars.bucket_validation(fine, made).where("volume_ok and high_ok and low_ok").count() == bars.bucket_validation(fine, made).count()
    stats = bars.bucket_statistics(made).collect()
    assert len(stats) == 10 and sum(s["data_points"] for s in stats) == made.count() and sum(s["coverage_pct"] for s in stats) == pytest.approx(100)


def test_session_across_midnight(spark):
    made = bars.bucket_bars(minutes(spark, 360, dt.datetime(2024, 1, 3, 20, 30))).orderBy("ts").collect()
    assert [(r["ts"].hour, r["bucket"]) for r in made] == [(16, 8), (21, 9)]
    single = bars.bucket_bars(minutes(spark, 1, dt.datetime(2024, 1, 15, 10, 30)).select("root", "contract", "ts", "close", "volume")).collect()
    assert [r["bucket"] for r in single] == [2] and bars.bucket_bars(minutes(spark, 1).where("false")).count() == 0


def test_missing_values_of_bars(spark):
    t = dt.datetime(2024, 1, 15, 9)
    rows = [("R", "C", t, None, None, None, None, None), ("R", "C", t + dt.timedelta(minutes=1), 5.0, 6.0, 4.0, float("nan"), 2.0), ("R", "C", t + dt.timedelta(minutes=2), 7.0, 8.0, 3.0, 7.5, None)]
    r = bars.bucket_bars(bars.clean(spark.createDataFrame(rows, MINUTE))).first()
    assert (r["open"], r["high"], r["low"], r["close"], r["volume"]) == (5.0, 8.0, 3.0, 7.5, 2.0)


def test_spike_and_cool_down(spark):
    r = random.Random(1)
    flat = [0.05] * 100
    assert events.detect_events(series(spark, flat), window=20).where("event").count() == 0
    noise = [r.gauss(0, 0.01) for _ in range(100)]
    noise[50] += 0.1
    noise[51] += 0.3
    found = events.detect_events(series(spark, noise), window=20)
    at = dt.datetime(2024, 1, 1) + dt.timedelta(days=50)
    assert found.where(F.col("ts") == at).first()["event"]
    kept = events.cooldown_rows(found, 3).where("kept").orderBy("ts").collect()
    assert all((b["ts"] - a["ts"]).days > 3 for a, b in zip(kept, kept[1:])) and at in [k["ts"] for k in kept]
    strict = {x["ts"] for x in events.detect_events(series(spark, noise), window=20, z_threshold=2.0).where("event").collect()}
    assert strict <= {x["ts"] for x in found.where("event").collect()}
    noise[10:15] = [None] * 5
    gaps = events.detect_events(series(spark, noise), window=20)
    assert gaps.count() == 100 and gaps.where("spread is null and event").count() == 0
    with pytest.raises(ValueError, match="abs_min"):
        events.detect_events(series(spark, flat), "abs")
    with pytest.raises(TypeError):
        events.cooldown_rows(found, "3")


def test_gaps_over_a_weekend(spark):
    rows = [("R", 1, dt.datetime(2024, 1, d), 0.0, d in (5, 8)) for d in range(1, 11)]
    e = spark.createDataFrame(rows, "root string, level int, ts timestamp_ntz, spread double, kept boolean")
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in range(1, 11) if dt.date(2024, 1, d).weekday() < 5], "date date")
    assert [r["gap"] for r in events.business_day_gaps(e, days).orderBy("ts").collect()] == [None, 1]
    assert events.business_day_gaps(e, days.where("false")).where("gap is not null").count() == 0


def test_bad_choices(spark):
    with pytest.raises(FileNotFoundError):
        calendars.merge([])
    with pytest.raises(ValueError, match="hierarchy"):
        calendars.merge([], "all")
    for raw in ({"spread": {"method": "x"}}, {"business_days": {"align_events": "x"}}, {"business_days": {"volume_threshold": {"dynamic_ranges": [{"max_days": 5}, {"max_days": 5}]}}}):
        with pytest.raises(ValueError):
            settings(raw)


def test_strip_dominance_is_by_window(spark):
    links = spark.createDataFrame([("R", dt.datetime(2024, 1, d), "A" if d < 4 else "B", 1, dt.date(2024, 1, 5) if d < 4 else dt.date(2024, 2, 20)) for d in range(1, 7)], "root string, ts timestamp_ntz, contract string, k int, expiry date")
    sizes = spark.createDataFrame([("R", dt.datetime(2024, 1, d), 1.0, 0.1, 10.0) for d in range(1, 7)], "root string, ts timestamp_ntz, s1_change double, others_median double, dominance_ratio double")
    days = calendars.open_days(spark, "2024-01-01", "2024-02-28")
    got = {(r["front_contract"], r["classification"]) for r in strip.strip_dominance(sizes, links, days, 2.0, 3).collect()}
    assert ("A", "expiry_dominance") in got and ("B", "broad_roll") in got


def test_quality_of_sparse_contracts(spark):
    daily = [("R", f"HG{m}2020", dt.date(2020, 1, 1) + dt.timedelta(days=i * step), 1.0) for m, n, step in (("F", 60, 1), ("G", 10, 1), ("H", 30, 40)) for i in range(n)]
    df = spark.createDataFrame([*daily, ("R", "XXF2020", dt.date(2020, 1, 1), 1.0)], "root string, contract string, day date, close double")
    rules = quality.Quality(min_data_points=20)
    got = {r["contract"]: r for r in quality.metrics(df, rules).collect()}
    assert got["HGF2020"]["status"] == "INCLUDED" and got["HGG2020"]["reasons"] == ["Insufficient data points: 10 < 20"] and got["HGH2020"]["max_gap_days"] == 40 and len(got["HGH2020"]["gaps"]) == 29
    assert {r[0] for r in quality.keep(df, rules).select("contract").distinct().collect()} == {"HGF2020", "XXF2020"}


def write_contracts(spark, at):
    (at / "deep").mkdir()
    for i, code in enumerate(["HGF24", "HGG24", "HGH24"]):
        rows = minutes(spark, 14 * 1440 if i else 600, dt.datetime(2024, 1, 2), code, i).orderBy("ts").collect()
        head = "Timestamp,Open,high,l,last,Vol\n" if i == 1 else ""
        lines = "".join(f"{r['ts']},{r['open']},{r['high']},{r['low']},{r['close']},{r['volume']}\n" for r in rows[:: 7 if i else 1])
        (at / ("deep" if i else ".") / f"{code}.{'csv' if i else 'txt'}").write_text(head + lines + "junk,1,2,3,4,5\n")
    minutes(spark, 14 * 1440, dt.datetime(2024, 1, 2), "x", 9).where("minute(ts) % 10 = 0").withColumnsRenamed({"ts": "DateTime", "close": "c"}).drop("root", "contract").coalesce(1).write.parquet(str(at / "HGJ2024"))
    part = next((at / "HGJ2024").glob("part*.parquet"))
    part.rename(at / "HGJ2024.parquet")
    (at / "meta.csv").write_text("﻿root,contract,expiry_date,source,source_url\n" + "".join(f"HG,HG{m}2024,2024-0{k}-{d},x,y\n" for m, k, d in (("F", 1, "05"), ("G", 2, 26), ("H", 3, 26), ("J", 4, 26))))
    (at / "cal.csv").write_text("# comment\ndate,holiday_name,session_note,partial_hours\n2024-01-15,MLK,Early close,09:00-13:00\n2024-01-09,Odd,Closed,\nbad,,,\n")
    return settings({"data": {"minute_root": str(at)}, "metadata": {"contracts": str(at / "meta.csv")}, "output_dir": str(at / "out"), "business_days": {"calendar_paths": [str(at / "cal.csv"), str(at / "none.csv")]},
                     "spread": {"window_buckets": 20, "cool_down_hours": 3.0}, "data_quality": {"min_data_points": 5, "trim_early_sparse": True}})


def test_whole_runs_from_files(spark, tmp_path):
    s = write_contracts(spark, tmp_path)
    rows = files.contract_minutes(spark, str(tmp_path))
    assert {r[0]: r[1] for r in rows.groupBy("contract").count().collect()} == {"HGF2024": 600, "HGG2024": 2880, "HGH2024": 2880, "HGJ2024": 2016}
    hourly = pipelines.hourly(spark, s, pipelines.kept_in(spark, str(tmp_path / "work")))
    paths = pipelines.write(spark, hourly, s)
    out = tmp_path / "out"
    assert len(paths) >= 18 and (out / "roll_signals" / "hourly_spread.csv").is_file() and (out / "analysis" / "transition_matrix.csv").is_file() and paths["hourly_panel"] == f"{out}/panels/hourly_panel.parquet"
    saved = json.loads((out / "analysis" / "run_settings.json").read_text())
    assert "calendar_paths" not in saved["business_days"] and saved["products"] == ["HG"] and saved["spread"]["window_buckets"] == 20
    assert spark.read.parquet(paths["hourly_panel"]).where("expiry is null").count() == 0
    assert spark.read.option("header", True).csv(paths["hourly_spread"]).count() == hourly["hourly_spread"].count() > 100
    daily = pipelines.daily(spark, s, pipelines.kept_in(spark, str(tmp_path / "daily_work")))
    pipelines.write(spark, daily, s)
    quality_json = json.loads((out / "data_quality" / "HG_filtering_summary.json").read_text())
    assert quality_json == {"commodity": "HG", "total_contracts": 4, "excluded": 1, "included": 3} and (out / "data_quality" / "HG_quality_metrics.csv").is_file()
    assert (out / "roll_signals" / "hg_liquidity_roll_filtered.csv").is_file() and spark.read.option("header", True).csv(f"{out}/panels/hg_panel_full_filtered.csv").count() == daily["panel_filtered"].count()
    unjudged = {k: daily[k].where("false") if k == "quality_metrics" else daily[k] for k in ("quality_metrics", "filtering_summary")}
    assert list(pipelines.write(spark, unjudged, s)) == ["run_settings"]
    assert daily["panel_filtered"].select("contract").distinct().count() == 3 and daily["filtering_summary"].first()["excluded"] == 1
    closed = [r["date"] for r in hourly["business_days_audit_hourly"].where("calendar_closed").collect()]
    assert closed == [dt.date(2024, 1, 9)]


def test_runs_keep_shared_frames_and_take_other_fields(spark, tmp_path):
    """A run that writes and rereads what its results share gives the same rows; price_field and max_files take effect."""
    s = write_contracts(spark, tmp_path)
    plain, kept = pipelines.hourly(spark, s), pipelines.hourly(spark, s, pipelines.kept_in(spark, str(tmp_path / "work")))
    both = [sorted(map(tuple, x["hourly_spread"].select("ts", "spread").collect())) for x in (plain, kept)]
    assert both[0] == both[1] and (tmp_path / "work" / "panel").exists()
    by_open = pipelines.hourly(spark, dataclasses.replace(s, data=s.data | {"price_field": "open"}))
    opened = {r["ts"]: r["spread"] for r in by_open["hourly_spread"].collect()}
    assert any(v is not None and opened[t] != v for t, v in both[0]) and set(opened) == {t for t, _ in both[0]}
    one = files.contract_minutes(spark, s.data["minute_root"], "HG", max_files=1)
    assert one.select("src_file").distinct().count() == 1
    with pytest.raises(ValueError, match="no column settle"):
        pipelines.hourly(spark, dataclasses.replace(s, data=s.data | {"price_field": "settle"}))
    with pytest.raises(TypeError):
        pipelines.daily(spark, dataclasses.replace(s, data_quality={"no_such_limit": 1}))


def test_no_calendar_no_business_days(spark, tmp_path):
    s = write_contracts(spark, tmp_path)
    out = pipelines.hourly(spark, dataclasses.replace(s, business_days=s.business_days | {"calendar_paths": []}))
    assert "business_days_audit_hourly" not in out and out["hourly_widening_summary"].where("business_days_since_last is not null").count() == 0


def test_summary_follows_alignment(spark):
    """Events of closed days aren't summarised, or come at the day that they moved to, with the spreads of that day."""
    spreads = series(spark, [1.0, 2.0, 4.0, 8.0, 16.0])
    marked = spreads.withColumn("kept", F.dayofmonth("ts").isin(1, 2, 5))
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 3, 5)], "date date")
    got = lambda policy: [(r["ts"].day, r["spread_before"], r["spread_after"], r["business_days_since_last"]) for r in events.event_summary(events.align_events(marked, days, policy), days, spreads).orderBy("ts").collect()]
    assert got("drop_closed") == [(1, None, 1.0, None), (5, 8.0, 16.0, 2)]
    assert got("shift_next") == [(1, None, 1.0, None), (3, 2.0, 4.0, 1), (5, 8.0, 16.0, 1)]
    assert [r["business_days_since_last"] for r in events.event_summary(marked).collect()] == [None] * 3


def test_cross_spread_summary(spark):
    names = "root string, bin int, cycle string, s1_dominance_rate_pct double, avg_dominance_ratio double"
    low = [("A", 0, "0-5", 10.0, 3.0), ("A", 1, "6-10", 4.0, None)]
    high = [("B", 0, "0-5", 12.25, 2.125), ("B", 3, "16-20", 12.25, 9.0), ("B", 4, "21-25", 11.0, 9.0)]
    got = {(r["root"], r["metric"]): r["value"] for r in strip.cross_spread_summary(spark.createDataFrame(low + high, names)).collect()}
    assert got["A", "Peak dominance bucket"] == "None" and got["A", "Peak dominance rate (%)"] == "0.0" and got["A", "Average dominance ratio at peak"] == "N/A"
    assert got["A", "Interpretation"].startswith("No significant") and got["B", "Suggests institutional rolling"] == "No"
    assert got["B", "Interpretation"] == f"S1 shows peak dominance 0-5 days before F1 expiry ({12.25:.1f}% of periods)" and got["B", "Average dominance ratio at peak"] == f"{2.125:.2f}"


def test_first_rows_win(spark, tmp_path):
    """Of a repeated contract the first line of metadata counts, of minutes with one time the first line of the first file."""
    (tmp_path / "meta.csv").write_text("root,contract,expiry_date\nHG,HGH2024,2024-03-27\nHG,HGH2024,2024-01-01\n")
    assert [str(r["expiry"]) for r in chain.expiry_dim(files.contract_metadata(spark, str(tmp_path / "meta.csv"))).collect()] == ["2024-03-27"]
    head = "timestamp,open,high,low,close,volume\n"
    (tmp_path / "HGH2024_a.csv").write_text(head + '"2024-01-15 10:00:00","1","2","1","1.5","3"\n2024-01-15 10:00:00,5,6,5,5.5,1\n')
    (tmp_path / "HGH2024_b.csv").write_text(head + "2024-01-15 10:00:00,7,8,7,7.5,1\n")
    bar = bars.bucket_bars(files.contract_minutes(spark, str(tmp_path), "HG", extensions=("csv",))).first()
    assert (bar["open"], bar["close"], bar["volume"]) == (1.0, 7.5, 5.0)


def test_hierarchy_of_calendars(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="Searched"):
        files.load_hierarchy(spark, str(tmp_path), "Copper")
    (tmp_path / "cme_copper.csv").write_text("date,holiday_name,session_note,partial_hours\n2024-01-15,MLK,Closed,\n")
    (tmp_path / "global_futures.csv").write_text("date,holiday_name,session_note,partial_hours\n2024-01-15,MLK,Regular,\n2024-12-25,Christmas,Closed,\n")
    got = {str(r["date"]): r["is_trading_day"] for r in files.load_hierarchy(spark, str(tmp_path), "COPPER", "cme").collect()}
    assert got == {"2024-01-15": False, "2024-12-25": False}


def test_lint_report(tmp_path, spark, capsys):
    """Codes: errors in a file are 1, a file that is missing or can't be read 2, warnings alone 0; the last file with a code counts."""
    head = "date,holiday_name,session_note,partial_hours\n"
    (tmp_path / "bad.csv").write_text(head + "2024-01-01,x,Half,\nnone,x,Odd,\n")
    (tmp_path / "twice.csv").write_text("# comment\n" + head + "2024-01-01,x,Closed,\n2024-01-01,y,,\n")
    (tmp_path / "other.csv").write_text("day\n2024-01-01\n")
    run = lambda *names: cli.main(["cal-lint", *[str(tmp_path / n) for n in names], "--json", str(tmp_path / "out.json")])
    report = lambda: json.loads((tmp_path / "out.json").read_text())
    assert run("bad.csv") == 1 and report() == [{"level": "error", "message": "Unknown session_note value: 'Half'", "date": "2024-01-01"}]
    assert "ERROR: Unknown session_note value: 'Half' on 2024-01-01" in capsys.readouterr().out
    assert run("twice.csv") == 0 and report() == [{"level": "warning", "message": "Duplicate date", "date": "2024-01-01"}]
    assert run("none.csv") == 2 and report()[0]["message"].startswith("File not found") and report()[0]["date"] is None
    assert run("other.csv") == 2 and report()[0]["message"].startswith("Failed to read")
    assert run("none.csv", "bad.csv") == 1 and len(report()) == 2 and run("bad.csv", "none.csv", "twice.csv") == 2


def test_organise(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("HG_a.txt", "ZC_b.txt", "QQ_c.txt", "d.csv"):
        (tmp_path / "in" / n).write_text("x")
    got = inventory.organise(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert [(r["category"], r["symbol"]) for r in got.collect()] == [("copper", "HG"), ("corn", "ZC"), ("other", "UNKNOWN")]
    assert (tmp_path / "out" / "copper" / "HG_a.txt").exists() and (tmp_path / "in" / "d.csv").exists()


def test_missing_columns_and_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.contract_minutes(spark, str(tmp_path), extensions=())
    (tmp_path / "HGZ24.csv").write_text("timestamp,open,high\n2024-01-01,1,2\n")
    with pytest.raises(ValueError, match="Missing required columns"):
        files.contract_minutes(spark, str(tmp_path), extensions=("csv",))
    (tmp_path / "HGH24.csv").write_text("timestamp,open,high,low,close,volume\n2024-01-01,1,2,1,2,3\n")
    good = files.contract_minutes(spark, str(tmp_path), extensions=("csv",), skip_bad=True).collect()
    assert [r["contract"] for r in good] == ["HGH2024"]


def test_business_days_are_those_of_the_root(spark):
    """Each root's events go by its own days; a root without any, and events without days at all, stay as they are."""
    at = lambda root, d: (root, 1, dt.datetime(2024, 1, d, 10), 0.0, True)
    e = spark.createDataFrame([at("A", 4), at("A", 9), at("B", 4), at("B", 6), at("C", 6)], "root string, level int, ts timestamp_ntz, spread double, kept boolean")
    days = spark.createDataFrame([("A", dt.date(2024, 1, 9)), ("B", dt.date(2024, 1, 4)), ("B", dt.date(2024, 1, 5)), ("B", dt.date(2025, 3, 3))], "root string, date date")
    moved = {(r["root"], r["ts"].day): r["aligned_ts"] for r in events.align_events(e, days, "shift_next").collect()}
    assert moved == {("A", 4): dt.datetime(2024, 1, 9, 10), ("A", 9): dt.datetime(2024, 1, 9, 10), ("B", 4): dt.datetime(2024, 1, 4, 10), ("B", 6): dt.datetime(2025, 3, 3, 10), ("C", 6): dt.datetime(2024, 1, 6, 10)}
    assert sorted((r["root"], r["ts"].day) for r in events.align_events(e, days, "drop_closed").collect()) == [("A", 9), ("B", 4), ("C", 6)]
    assert sorted((r["root"], r["ts"].day, r["gap"]) for r in events.business_day_gaps(e, days).where("gap is not null").collect()) == []
    for policy in ("drop_closed", "shift_next"):
        none = events.align_events(e, days.where("false"), policy)
        assert none.count() == 5 and none.where("aligned_ts <> ts").count() == 0
    with pytest.raises(ValueError, match="policy"):
        events.align_events(e, days, "other")


@pytest.mark.parametrize("n,hours", [(3000, 5.0), (20_000, 1.0)])
def test_cool_down_by_doubling(spark, tmp_path, n, hours):
    """Pointers that are doubled keep what the fold keeps, for one long series and several short ones, with ends of months and years between."""
    e = spark.range(n).select(F.lit("R").alias("root"), F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(0).cast("int").alias("level"), F.expr("timestamp_ntz'2023-11-20 00:00:00' + make_dt_interval(0, 0, 0, cast(id * 601 as int))").alias("ts"), (F.xxhash64("id") % 3 != 0).alias("event"))
    with Scratch(spark, str(tmp_path / "run")) as run:
        got = sorted(map(tuple, events.cooldown_by_doubling(e, hours, run.keep).where("kept").select("level", "ts").collect()))
    assert not (tmp_path / "run").exists() and got == sorted(map(tuple, events.cooldown_time(e, hours).where("kept").select("level", "ts").collect())) and len(got) > 20


def test_upkeep_writes_only_what_a_file_touches(spark, tmp_path):
    """A panel and its events that grow by a file equal those of a whole run, and other dates' files stay as they are."""
    old = [minutes(spark, 12 * 1440, dt.datetime(2024, 1, 2), c, i).where("minute(ts) % 20 = 0") for i, c in enumerate(["HGH2024", "HGK2024"])]
    new = minutes(spark, 1440, dt.datetime(2024, 1, 6, 9), "HGN2024", 9).where("minute(ts) % 20 = 0")
    more = minutes(spark, 300, dt.datetime(2024, 1, 6, 9), "HGH2024", 5).where("minute(ts) % 20 = 10")
    dim = spark.createDataFrame([(c, dt.date(2024, m, 26)) for c, m in (("HGH2024", 3), ("HGK2024", 5), ("HGN2024", 7))], "contract string, expiry date")
    before, added = old[0].unionAll(old[1]), new.unionAll(more)
    every = before.unionAll(added)

    def run(name, steps):
        with Scratch(spark, str(tmp_path / f"{name}-run")) as scratch:
            for source, change in steps:
                dates = upkeep.touched(change)
                upkeep.refresh_panel(spark, source, dates, dim, str(tmp_path / name / "panel"))
                upkeep.refresh_events(spark, str(tmp_path / name / "panel"), dates, str(tmp_path / name / "events"), scratch.keep, 8)
        return [sorted(map(repr, spark.read.parquet(str(tmp_path / name / t)).select(c).collect())) for t, c in (("panel", ["contract", "ts", "open", "close", "volume", "expiry", "root", "trade_date"]), ("events", ["root", "level", "ts", "spread", "z", "event", "trade_date"]))]

    run("grown", [(before, before)])
    files_of = lambda: {p.name for p in (tmp_path / "grown").rglob("*.parquet")}
    first = files_of()
    grown, whole = run("grown", [(every, added)]), run("whole", [(every, every)])
    assert grown == whole
    kept = {p.parent.name for p in (tmp_path / "grown").rglob("*.parquet") if p.name in first}
    assert "trade_date=2024-01-03" in kept and "trade_date=2024-01-12" in kept and "trade_date=2024-01-06" not in kept and "trade_date=2024-01-07" not in kept
