"""Contract files of several layouts: none hides another, each is read once, bad ones are named."""

import datetime as dt
import logging

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tenorline.operators import bars
from tenorline.sources import adapters, files

SF = "/root/testdata/sf0.001"
HEAD = "timestamp,open,high,low,close,volume\n"


def parquet(path, time_name, volume_name, n, kind=float, stamp=dt.datetime(2024, 1, 15, 10)):
    values = {c: [kind(5)] * n for c in ("open", "high", "low", "close")}
    pq.write_table(pa.table({time_name: [stamp + dt.timedelta(minutes=i) for i in range(n)], **values, volume_name: [kind(2)] * n}), path)


def counts(df):
    return {r["contract"]: r["count"] for r in df.groupBy("contract").count().collect()}


def test_parquet_layouts_of_their_own(spark, tmp_path):
    """Other names and other types of a column in another file of the folder lose no rows."""
    parquet(tmp_path / "HGF2024.parquet", "timestamp", "volume", 3)
    parquet(tmp_path / "HGG2024.parquet", "datetime", "vol", 4)
    parquet(tmp_path / "HGH2024.pq", "timestamp", "volume", 5, int)
    parquet(tmp_path / "HGJ2024.parquet", "Time", "Volume", 6, str)
    got = files.contract_minutes(spark, str(tmp_path))
    assert counts(got) == {"HGF2024": 3, "HGG2024": 4, "HGH2024": 5, "HGJ2024": 6} and got.agg(F.sum("volume")).first()[0] == 36.0


def test_bad_files_are_named_and_left_out(spark, tmp_path, caplog):
    parquet(tmp_path / "HGF2024.parquet", "timestamp", "volume", 3)
    (tmp_path / "HGG2024.parquet").write_bytes(b"PAR1 no footer")
    (tmp_path / "HGJ2024.csv").write_text("timestamp,open\n2024-01-15,1\n")
    parquet(tmp_path / "HGK2024.parquet", "when", "volume", 3)
    with caplog.at_level(logging.WARNING):
        got = files.contract_minutes(spark, str(tmp_path), skip_bad=True)
    assert counts(got) == {"HGF2024": 3}
    for name in ("HGG2024.parquet", "HGJ2024.csv", "HGK2024.parquet"):
        assert any(name in r.getMessage() for r in caplog.records), name
    with pytest.raises(ValueError, match="HGG2024|HGJ2024|HGK2024"):
        files.contract_minutes(spark, str(tmp_path))


def test_only_the_first_files_are_opened(spark, tmp_path):
    for i, m in enumerate("FGHJ"):
        (tmp_path / f"HG{m}2024.csv").write_text(HEAD + f"2024-01-15 10:0{i}:00,1,2,1,2,3\n")
    (tmp_path / "HGZ2024.parquet").write_bytes(b"broken, and never opened")
    got = files.contract_minutes(spark, str(tmp_path), max_files=1)
    assert [p.rpartition("/")[2] for p in got.inputFiles()] == ["HGF2024.csv"] and got.count() == 1


def test_each_text_file_is_read_once(spark, tmp_path):
    """One scan for a layout, over files that no other scan has; files without header send no line to the driver."""
    for i in range(40):
        (tmp_path / f"HGF2024_{i}.csv").write_text("".join(f"2024-01-15 10:{i:02}:{j:02},{i},{i},{i},{i},{j}\n" for j in range(5)))
        (tmp_path / f"HGG2024_{i}.txt").write_text("\ufeffDateTime, o,h ,l,last,VOL,OI\r\n" + f'"2024-01-15 10:{i:02}:00", 1,2,1,2,3,4\r\njunk,,,,,,\r\n')
    got = files.contract_minutes(spark, str(tmp_path))
    assert counts(got) == {"HGF2024": 200, "HGG2024": 40} and got.agg(F.sum("open_interest")).first()[0] == 160.0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2 and "Join" not in plan and len(got.inputFiles()) == 80
    seen = files.layouts(files.contract_paths(spark, str(tmp_path))).where("not header").select("columns").distinct().collect()
    assert [r["columns"] for r in seen] == [files.BY_PLACE[:6]]


def test_lines_keep_their_order(spark, tmp_path):
    """Of many lines of one time the first and last of the file count, however Spark cuts it."""
    lines = [f"2024-01-15 10:00:00,{i},{i},{i},{i},1\n" for i in range(20_000)]
    (tmp_path / "HGF2024.csv").write_text(HEAD + "".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        bar = bars.bucket_bars(files.contract_minutes(spark, str(tmp_path))).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (bar["open"], bar["close"], bar["volume"]) == (0.0, 19_999.0, 20_000.0)


def test_paths_with_odd_characters(spark, tmp_path):
    folder = tmp_path / "a b [x] {y}%20"
    folder.mkdir()
    (folder / "HGF2024 (1).csv").write_text(HEAD + "2024-01-15 10:00:00,1,2,1,2,3\n")
    assert counts(files.contract_minutes(spark, str(tmp_path))) == {"HGF2024": 1}
    with pytest.raises(FileNotFoundError):
        files.contract_minutes(spark, str(tmp_path / "none"))


def test_layouts_of_the_shared_table(spark, tmp_path):
    """The ticks of a table, dealt over files of four layouts, give the bars of the table."""
    ticks = adapters.ticks(spark, SF).withColumn("contract", F.concat(F.lit("HG"), F.translate("contract", "C", "Z"))).where("contract <> 'x'")
    months = {i: f"HG{m}2024" for i, m in enumerate("FGHJKMNQUVXZ")}
    rows = [r.asDict() for r in ticks.withColumn("k", F.substring("contract", 4, 2).cast("int")).collect()]
    for k, code in months.items():
        own = [r for r in rows if r["k"] == k]
        if k % 4 == 0:
            pq.write_table(pa.table({c: [r[c] for r in own] for c in ("ts", "open", "high", "low", "close", "volume")}).rename_columns(["timestamp", "open", "high", "low", "close", "volume"]), tmp_path / f"{code}.parquet")
        elif k % 4 == 1:
            pq.write_table(pa.table({c: [r[c] for r in own] for c in ("volume", "close", "low", "high", "open", "ts")}).rename_columns(["vol", "c", "l", "h", "o", "datetime"]), tmp_path / f"{code}.pq")
        else:
            text = "".join(f"{r['ts']},{r['open']!r},{r['high']!r},{r['low']!r},{r['close']!r},{r['volume']}\n" for r in own)
            (tmp_path / f"{code}.csv").write_text((HEAD if k % 4 == 2 else "") + text)
    got = bars.bucket_bars(files.contract_minutes(spark, str(tmp_path)))
    want = bars.bucket_bars(ticks.withColumn("contract", F.element_at(F.create_map(*[F.lit(x) for k in months.items() for x in k]), F.substring("contract", 4, 2).cast("int"))))
    columns = ["contract", "ts", "bucket", "open", "high", "low", "close", "volume"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
