"""Ranks, quantiles, chunks and next values against plain versions: several series, nulls, ties, edges of chunks."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenorline.operators import events
from tenorline.operators.ordered import next_value, numbered, quantiles
from tenorline.sources.storage import Scratch


@pytest.fixture
def keep(spark, tmp_path):
    with Scratch(spark, str(tmp_path / "run")) as run:
        yield run.keep


def test_quantiles_by_rank(spark, keep):
    r = random.Random(1)
    groups = {"a": [r.gauss(0, 1) for _ in range(500)], "b": [1.0] * 40, "c": [3.0], "d": [], None: [1.0, 2.0], "e": [r.choice([0.0, 1.0, 7.5]) for _ in range(33)]}
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]]
    r.shuffle(rows)
    qs = [0.0, 0.1, 0.25, 0.5, 1.0]
    got = {(x["g"], x["q"]): x["quantile"] for x in quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", F.array(*map(F.lit, qs)), keep).collect()}
    want = {(g, q): float(np.quantile(vs, q)) for g, vs in groups.items() if vs for q in qs}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", F.array(F.lit(0.5)), keep).count() == 0


def test_places_in_series(spark, keep):
    df = spark.range(5000).select((F.col("id") % 3 % 2).alias("s"), (F.col("id") * 7919 % 5003).alias("v"))
    got = numbered(df, ["s"], ["v"], keep).collect()
    for s in (0, 1):
        own = sorted((x["v"], x["n"]) for x in got if x["s"] == s)
        assert [n for _, n in own] == list(range(len(own))) and own


@pytest.mark.parametrize("chunk", [3, 7, 50, 10_000])
def test_scores_at_every_edge_of_a_chunk(spark, keep, chunk):
    r = random.Random(chunk)
    start = dt.datetime(2024, 1, 1)
    rows = [("R", level, start + dt.timedelta(hours=i), None if r.random() < 0.1 else r.gauss(0, 1)) for level in (1, 2) for i in range(r.randrange(60, 140))]
    df = spark.createDataFrame(rows, "root string, level int, ts timestamp_ntz, spread double")
    columns = ["root", "level", "ts", "spread", "change", "z"]
    got, want = (sorted(map(tuple, x.select(columns).collect()), key=repr) for x in (events.rolling_zscore_in_chunks(df, 20, None, keep, chunk), events.rolling_zscore(df, 20)))
    assert got == want and any(x[-1] is not None for x in want)


def test_next_values_over_chunks(spark):
    r = random.Random(5)
    values = {k: sorted({r.randrange(3000) for _ in range(n)}) for k, n in (("x", 40), ("y", 3))}
    asked = [(k, r.randrange(-10, 3100)) for k in ("x", "y", "z") for _ in range(80)]
    give = lambda rows: spark.createDataFrame(rows, "k string, at long")
    got = {(x["k"], x["at"]): x["next"] for x in next_value(give(asked), give([(k, v) for k, vs in values.items() for v in vs]), ["k"], F.floor(F.col("at") / 100)).collect()}
    assert got == {(k, a): next((v for v in values.get(k, []) if v >= a), None) for k, a in asked}
