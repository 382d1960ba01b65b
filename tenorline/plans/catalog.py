"""All queries by name, each with the columns it returns, its plan over Market, and the SQL that DuckDB answers it with.

Columns are written "name" (as is), "name:l" (a 64-bit integer) or "name:r" (a double, rounded to 6 digits, as sums of doubles depend on their order).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contracts import MONTHS, contract_year, month_number, normalize_contract
from ..functions.sessions import bar_date, bucket_dim, bucket_of_hour, bucket_start, cycle_bin, cycle_label, days_to_expiry, tick_date
from ..operators import bars, bizdays, calendars, chain, events, quality, strip
from ..operators.ordered import quantiles
from ..sources import adapters
from ..sources.inventory import COMMODITIES, classify_files
from ..streaming import bars as stream_bars
from ..streaming import cooldown
from .market import Market
from .oracle import LABEL, SESSION, WITH

Plan = Callable[[Market], DataFrame]
_ALL: dict[str, tuple[str, Plan, str | None]] = {}


def _add(name: str, columns: str, plan: Plan, sql: str | None) -> None:
    _ALL[name] = (columns, plan, sql)


def _spark(columns: str, df: DataFrame) -> DataFrame:
    out = []
    for name, _, kind in (c.partition(":") for c in columns.split()):
        col = F.col(name)
        out.append({"": col, "l": col.cast("long"), "r": F.round(col.cast("double"), 6) + F.lit(0.0)}[kind].alias(name))
    return df.select(*out)


def _sql(columns: str, body: str) -> str:
    out = []
    for name, _, kind in (c.partition(":") for c in columns.split()):
        out.append({"": f'"{name}"', "l": f'CAST("{name}" AS BIGINT) AS "{name}"', "r": f'round(CAST("{name}" AS DOUBLE), 6) + 0.0 AS "{name}"'}[kind])
    return f"{WITH} SELECT {', '.join(out)} FROM {body}"


# Scalar functions, over ticks, parts and whole numbers.
_add("scan_ticks", "root contract ts close volume", lambda m: m.minutes, "(SELECT *, price AS close FROM ticks)")
_add("bucket_assign", "contract ts hour:l bucket:l", lambda m: m.minutes.withColumn("hour", F.hour("ts")).withColumn("bucket", bucket_of_hour(F.col("hour"))), "(SELECT *, h AS hour FROM stamped)")
_add("bucket_dim", "bucket:l bucket_label start_hour:l n_hours:l session ticks:l",
     lambda m: bucket_dim(m.spark).join(m.minutes.groupBy(bucket_of_hour(F.hour("ts")).alias("bucket")).agg(F.count("*").alias("ticks")), "bucket", "left"),
     f"(SELECT b AS bucket, {LABEL.format('b')} AS bucket_label, CASE WHEN b <= 7 THEN 8 + b WHEN b = 8 THEN 16 WHEN b = 9 THEN 21 ELSE 3 END AS start_hour, CASE WHEN b <= 7 THEN 1 WHEN b = 8 THEN 5 ELSE 6 END AS n_hours, "
     f"{SESSION.format('b')} AS session, n AS ticks FROM generate_series(1, 10) t(b) LEFT JOIN (SELECT bucket, count(*) AS n FROM stamped GROUP BY bucket) ON bucket = b)")  # fmt: skip
_add("bucket_start", "contract ts bucket:l bar", lambda m: m.minutes.withColumn("bucket", bucket_of_hour(F.hour("ts"))).withColumn("bar", bucket_start("ts", "bucket")), "started")
_add("trading_date", "contract ts tick_date bar_date", lambda m: m.minutes.select("contract", "ts", tick_date(F.col("ts")).alias("tick_date"), bar_date(F.col("ts"), bucket_of_hour(F.hour("ts"))).alias("bar_date")),
     "(SELECT *, CAST(ts AS DATE) + CASE WHEN h >= 21 THEN 1 ELSE 0 END AS tick_date, CAST(ts AS DATE) + CASE WHEN bucket = 9 THEN 1 ELSE 0 END AS bar_date FROM stamped)")
_add("days_to_expiry", "root ts dte:l", lambda m: m.pairs.select("root", "ts", days_to_expiry(F.col("front_expiry"), F.to_date("ts")).alias("dte")), "dated")
_add("cycle_bin", "contract ts days:l bin:l label",
     lambda m: m.minutes.join(m.expiry, "contract").withColumn("days", days_to_expiry(F.col("expiry"), F.to_date("ts"))).withColumn("bin", cycle_bin(F.col("days"))).withColumn("label", cycle_label(F.col("bin"))),
     "(SELECT *, ['0-5', '6-10', '11-15', '16-20', '21-25', '26-30', '31-40', '41-50', '51-60', '60+'][bin + 1] AS label FROM (SELECT *, "
     "CASE WHEN days <= 30 THEN greatest((days - 1) // 5, 0) WHEN days <= 60 THEN 6 + (days - 31) // 10 ELSE 9 END AS bin FROM "
     "(SELECT t.*, greatest(datediff('day', CAST(ts AS DATE), expiry), 0) AS days FROM ticks t JOIN expiry_dim USING (contract))))")  # fmt: skip


def _codes(m: Market) -> DataFrame:
    part = adapters.table(m.spark, m.sf_dir, "part")
    letter = F.substring(F.lit(MONTHS), (F.col("p_partkey") % 12 + 1).cast("int"), F.lit(1))
    raw = F.concat(F.when(F.col("p_partkey") % 3 == 0, "hg_").otherwise("HG"), letter, F.when(F.col("p_partkey") % 5 == 0, "2024").otherwise(F.lpad((F.col("p_size") % 100).cast("string"), 2, "0")), F.lit("-data.csv"))
    return part.select("p_partkey", raw.alias("raw")).withColumn("code", normalize_contract(F.col("raw"), "HG"))


_CODES = f"""(SELECT *, 'HG' || letter || CASE WHEN length(digits) = 4 THEN digits WHEN CAST(digits AS INTEGER) <= 79 THEN CAST(2000 + CAST(digits AS INTEGER) AS VARCHAR) ELSE CAST(1900 + CAST(digits AS INTEGER) AS VARCHAR) END AS code,
  CASE WHEN p_partkey % 3 = 0 THEN 'hg_' ELSE 'HG' END || letter || digits || '-data.csv' AS raw FROM (SELECT p_partkey, substr('{MONTHS}', CAST(p_partkey % 12 + 1 AS INTEGER), 1) AS letter, p_partkey % 12 + 1 AS month,
  CASE WHEN p_partkey % 5 = 0 THEN '2024' ELSE lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') END AS digits FROM part))"""
_add("contract_normalize", "p_partkey raw code", _codes, _CODES)
_add("contract_month", "p_partkey month:l", lambda m: _codes(m).withColumn("month", month_number(F.substring("code", 3, 1))), _CODES)
_add("contract_year", "p_partkey year:l", lambda m: _codes(m).withColumn("year", contract_year(F.concat(F.lit("HGZ"), F.regexp_extract("raw", "([0-9]+)-", 1)))),
     f"(SELECT *, CASE WHEN length(digits) = 4 THEN CAST(digits AS INTEGER) WHEN CAST(digits AS INTEGER) <= 30 THEN 2000 + CAST(digits AS INTEGER) ELSE 1900 + CAST(digits AS INTEGER) END AS year FROM {_CODES})")


def _files(m: Market) -> DataFrame:
    symbols = [*COMMODITIES, "XX"]
    symbol = F.element_at(F.array(*[F.lit(s) for s in symbols]), (F.col("p_partkey") % len(symbols) + 1).cast("int"))
    return classify_files(adapters.table(m.spark, m.sf_dir, "part").select("p_partkey", F.concat(symbol, F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".txt")).alias("filename")))


_LIST = ", ".join(f"('{s}', '{c}', '{n}')" for s, (c, n) in COMMODITIES.items())
_add("inventory", "p_partkey filename symbol commodity category", _files,
     f"(SELECT p_partkey, s || '_' || p_partkey || '.txt' AS filename, coalesce(t.symbol, 'UNKNOWN') AS symbol, coalesce(t.name, 'Unknown') AS commodity, coalesce(t.category, 'other') AS category "
     f"FROM (SELECT p_partkey, [{', '.join(repr(s) for s in [*COMMODITIES, 'XX'])}][p_partkey % {len(COMMODITIES) + 1} + 1] AS s FROM part) LEFT JOIN (VALUES {_LIST}) t(symbol, category, name) ON s = t.symbol)")  # fmt: skip

# Bars.
_BAR = "root contract ts bucket:l open high low close volume"
_add("bucket_ohlcv", _BAR, lambda m: m.bars, "bars")
_add("daily_ohlcv", "root contract day open high low close volume", lambda m: m.daily, "daily")
_add("daily_ohlcv_filled", "root contract day open high low close volume", lambda m: bars.fill_calendar(m.daily), "filled")
_add("bucket_statistics", "bucket:l label session duration_hours:l data_points:l coverage_pct:r avg_volume:r total_volume volume_share_pct:r avg_close:r close_volatility:r", lambda m: bars.bucket_statistics(m.bars),
     f"(SELECT b AS bucket, {LABEL.format('b')} AS label, {SESSION.format('b')} AS session, CASE WHEN b <= 7 THEN 1 WHEN b = 8 THEN 5 ELSE 6 END AS duration_hours, count(x.ts) AS data_points, 100.0 * count(x.ts) / (SELECT count(*) FROM bars) AS coverage_pct, avg(volume) AS avg_volume, "
     "coalesce(sum(volume), 0.0) AS total_volume, 100 * coalesce(sum(volume), 0.0) / (SELECT sum(volume) FROM bars) AS volume_share_pct, avg(close) AS avg_close, stddev_samp(close) AS close_volatility FROM generate_series(1, 10) t(b) LEFT JOIN bars x ON x.bucket = b GROUP BY b)")  # fmt: skip
_add("bucket_validation", "root trade_date volume_ok high_ok low_ok has_all_buckets", lambda m: bars.bucket_validation(m.minutes, m.bars),
     "(SELECT b.root, b.d AS trade_date, abs(b.v - t.v) <= 1e-8 + 1e-5 * abs(t.v) AS volume_ok, b.hi = t.hi AS high_ok, b.lo = t.lo AS low_ok, b.n = 10 AS has_all_buckets FROM "
     "(SELECT root, CAST(ts AS DATE) + CASE WHEN bucket = 9 THEN 1 ELSE 0 END AS d, sum(volume) AS v, max(high) AS hi, min(low) AS lo, count(DISTINCT bucket) AS n FROM bars GROUP BY 1, 2) b JOIN "
     "(SELECT root, CAST(ts AS DATE) + CASE WHEN h >= 21 THEN 1 ELSE 0 END AS d, sum(volume) AS v, max(price) AS hi, min(price) AS lo FROM stamped GROUP BY 1, 2) t ON b.root = t.root AND b.d = t.d)")  # fmt: skip

# Panel, chain, spreads, liquidity.
_add("expiry_dim", "contract expiry", lambda m: chain.expiry_dim(adapters.user_metadata(m.spark, m.sf_dir)),
     "(SELECT 'C' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS contract, CAST(DATE '2024-01-03' + CAST(3 * (user_id % 12) + user_id // 12 AS INTEGER) AS DATE) AS expiry FROM events "
     "QUALIFY row_number() OVER (PARTITION BY user_id % 12 ORDER BY user_id) = 1)")  # fmt: skip
_add("panel_assemble", _BAR + " expiry", lambda m: m.panel, "panel")
_add("panel_grid", "root ts", lambda m: m.times, "grid")
_add("panel_meta", "root ts bucket:l bucket_label session", lambda m: m.meta, f"(SELECT *, {LABEL.format('bucket')} AS bucket_label, {SESSION.format('bucket')} AS session FROM meta)")
_PAIR = "root ts " + " ".join(f"{n}_{c}" for n in ("front", "next") for c in ("contract", "close", "volume", "expiry"))
_add("front_next", _PAIR, lambda m: m.pairs, "pairs")
_add("contract_chain", "root ts " + " ".join(f"F{i}" for i in range(1, 13)), lambda m: chain.chain_wide(m.links, m.times),
     "(SELECT g.root, g.ts, " + ", ".join(f"max(CASE WHEN k = {i} THEN contract END) AS F{i}" for i in range(1, 13)) + " FROM grid g LEFT JOIN links l ON g.root = l.root AND g.ts = l.ts GROUP BY g.root, g.ts)")
_add("calendar_spread", "root ts spread", lambda m: m.spread, "strip WHERE level = 1")
_add("calendar_spread_open", "root ts spread", lambda m: chain.calendar_spread(chain.front_next(chain.chain(m.panel, price="open"), m.times)),
     "(SELECT g.root, g.ts, max(CASE WHEN k = 2 THEN open END) - max(CASE WHEN k = 1 THEN open END) AS spread FROM grid g LEFT JOIN (SELECT root, ts, open, row_number() OVER (PARTITION BY root, ts ORDER BY expiry, contract) AS k "
     "FROM panel WHERE open IS NOT NULL AND expiry >= CAST(ts AS DATE)) l ON g.root = l.root AND g.ts = l.ts GROUP BY g.root, g.ts)")  # fmt: skip
_add("multi_spreads", "root ts level:l spread", lambda m: m.strip, "strip")
_add("strip_wide", "root ts " + " ".join(f"S{i}" for i in range(1, 12)), lambda m: chain.strip_wide(m.strip), "(SELECT root, ts, " + ", ".join(f"max(CASE WHEN level = {i} THEN spread END) AS S{i}" for i in range(1, 12)) + " FROM strip GROUP BY root, ts)")
_add("front_volume", "root ts front_volume", lambda m: m.pairs, "pairs")
_add("front_next_volume", "root ts volume", lambda m: chain.front_next_volume(m.pairs), "pair_volume")
_SIGNAL = "(SELECT root, ts, coalesce(next_volume >= 0.8 * front_volume AND front_volume > 0, false) AS signal FROM pairs)"
_add("liquidity_signal", "root ts signal", lambda m: chain.liquidity_signal(m.pairs), _SIGNAL)
_add("liquidity_confirm", "root ts signal", lambda m: chain.liquidity_signal(m.pairs, confirm=3),
     f"(SELECT root, ts, min(CAST(signal AS INTEGER)) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1 OR row_number() OVER w < 3 AS signal FROM {_SIGNAL} WINDOW w AS (PARTITION BY root ORDER BY ts))")

# Events.
_EVENT = "root ts spread change:r z:r event"
_add("spread_change", "root level:l ts spread change:r", lambda m: events.spread_change(m.strip), "changed")
_add("rolling_zscore", "root level:l ts z:r", lambda m: events.rolling_zscore(m.strip, 20), "scored")
_add("spread_events_zscore", _EVENT, lambda m: events.detect_events(m.spread, window=20), "strip_events WHERE level = 1")
_add("spread_events_abs", _EVENT, lambda m: events.detect_events(m.spread, "abs", 20, abs_min=5.0), "(SELECT * REPLACE (coalesce(change > 5.0, false) AS event) FROM strip_events WHERE level = 1)")
_add("spread_events_combined", _EVENT, lambda m: events.detect_events(m.spread, "combined", 20, abs_min=5.0), "(SELECT * REPLACE (coalesce(z > 1.5, false) OR coalesce(change > 5.0, false) AS event) FROM strip_events WHERE level = 1)")
_add("multi_spread_events", "level:l " + _EVENT, lambda m: m.strip_events, "strip_events")
_add("cooldown_time", "root ts event kept", lambda m: m.cooled, "cooled")
_add("cooldown_rows", "root ts event kept", lambda m: events.cooldown_rows(events.detect_events(m.spread, window=20), 5),
     "(SELECT e.*, k.rn IS NOT NULL AS kept FROM strip_events e LEFT JOIN kept_rows k ON e.root = k.root AND e.rn = k.rn WHERE e.level = 1)")
_add("align_drop_closed", "root ts kept aligned_ts", lambda m: events.align_events(m.cooled, m.business_days, "drop_closed"), "(SELECT *, ts AS aligned_ts FROM cooled WHERE CAST(ts AS DATE) IN (SELECT date FROM business))")
_add("align_shift_next", "root ts kept aligned_ts", lambda m: events.align_events(m.cooled, m.business_days, "shift_next"),
     "(SELECT c.*, c.ts + to_days(CAST(coalesce((SELECT min(date) FROM business b WHERE b.date >= CAST(c.ts AS DATE)), CAST(c.ts AS DATE)) - CAST(c.ts AS DATE) AS INTEGER)) AS aligned_ts FROM cooled c)")
_add("business_day_gaps", "root ts gap:l", lambda m: events.business_day_gaps(m.cooled, m.business_days), "gaps")
_add("event_summary", "root ts spread_before spread_after change:r business_days_since_last:l", lambda m: events.event_summary(m.cooled, m.business_days),
     "(SELECT root, ts, spread_before, spread AS spread_after, spread - spread_before AS change, gap AS business_days_since_last FROM gaps)")
_ALIGNED = "(SELECT c.*, c.ts + to_days(CAST(coalesce((SELECT min(date) FROM business b WHERE b.date >= CAST(c.ts AS DATE)), CAST(c.ts AS DATE)) - CAST(c.ts AS DATE) AS INTEGER)) AS aligned_ts FROM cooled c)"
_add("event_summary_aligned", "root ts spread_before spread_after change:r business_days_since_last:l", lambda m: events.event_summary(events.align_events(m.cooled, m.business_days, "shift_next"), m.business_days, m.spread),
     f"(SELECT root, ts, spread_before, spread AS spread_after, spread - spread_before AS change, pos - last_value(pos IGNORE NULLS) OVER (PARTITION BY root ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS business_days_since_last FROM ("
     f"SELECT a.root, a.aligned_ts AS ts, s.spread, s.spread_before, n.pos FROM {_ALIGNED} a LEFT JOIN (SELECT *, lag(spread) OVER (PARTITION BY root ORDER BY ts) AS spread_before FROM strip WHERE level = 1) s ON s.root = a.root AND s.ts = a.aligned_ts "
     "LEFT JOIN numbered n ON a.root = n.root AND CAST(a.aligned_ts AS DATE) = n.date WHERE a.kept))")  # fmt: skip
_add("bucket_event_summary", "root bucket:l label session total_periods:l event_count:l event_rate_pct:r avg_spread:r avg_event_spread:r std_event_spread:r event_share_pct:r", lambda m: events.bucket_event_summary(m.marked),
     f"(SELECT *, {LABEL.format('bucket')} AS label, {SESSION.format('bucket')} AS session, round_even(100.0 * event_count / total_periods, 2) AS event_rate_pct, CASE WHEN sum(event_count) OVER (PARTITION BY root) > 0 "
     "THEN round_even(100.0 * event_count / sum(event_count) OVER (PARTITION BY root), 2) ELSE 0.0 END AS event_share_pct FROM (SELECT root, bucket, count(*) AS total_periods, "
     "count_if(kept) AS event_count, avg(spread) AS avg_spread, avg(spread) FILTER (WHERE kept) AS avg_event_spread, stddev_samp(spread) FILTER (WHERE kept) AS std_event_spread FROM marked WHERE bucket IS NOT NULL GROUP BY ALL))")  # fmt: skip
_add("preference_scores", "root bucket:l score:r", lambda m: events.preference_scores(m.marked),
     "(SELECT root, bucket, CASE WHEN avg(raw) OVER (PARTITION BY root) > 0 THEN raw / avg(raw) OVER (PARTITION BY root) ELSE raw END AS score FROM (SELECT root, bucket, rate / CASE WHEN v > 0 THEN v / sum(v) OVER (PARTITION BY root) ELSE 0.0001 END AS raw "
     "FROM (SELECT root, bucket, avg(CAST(kept AS DOUBLE)) AS rate, coalesce(sum(volume), 0.0) AS v FROM marked WHERE bucket IS NOT NULL GROUP BY ALL)))")  # fmt: skip
_add("transition_matrix", "root from_bucket:l to_bucket:l share:r", lambda m: events.transition_matrix(m.marked),
     "(SELECT root, from_bucket, to_bucket, CASE WHEN sum(n) OVER (PARTITION BY root, from_bucket) > 0 THEN n / sum(n) OVER (PARTITION BY root, from_bucket) ELSE 0.0 END AS share FROM (SELECT 'EV' AS root, f AS from_bucket, t AS to_bucket, "
     "coalesce((SELECT count(*) FROM (SELECT bucket, lead(bucket) OVER (PARTITION BY root ORDER BY ts) AS b FROM marked WHERE kept AND bucket IS NOT NULL) s WHERE s.bucket = f AND s.b = t), 0) AS n FROM generate_series(1, 10) x(f) CROSS JOIN generate_series(1, 10) y(t)))")  # fmt: skip
_add("spread_event_timing", "root ts level:l spread contract expiry days_to_expiry:l f1_contract f1_expiry", lambda m: strip.event_timing(m.strip_events, m.links), "timing")

_add("cooldown_doubling", "root level:l ts event kept", lambda m: events.cooldown_by_doubling(m.strip_events, 3.0, m.scratch.keep),
     """(WITH RECURSIVE e AS (SELECT root, level, ts FROM strip_events WHERE event), n AS (SELECT a.root, a.level, a.ts, min(b.ts) AS next_ts FROM e a JOIN e b ON a.root = b.root AND a.level = b.level AND b.ts >= a.ts + INTERVAL 3 HOUR GROUP BY ALL),
     k AS (SELECT root, level, min(ts) AS ts FROM e GROUP BY root, level UNION ALL SELECT n.root, n.level, n.next_ts FROM k JOIN n ON k.root = n.root AND k.level = n.level AND k.ts = n.ts)
     SELECT s.*, k.ts IS NOT NULL AS kept FROM strip_events s LEFT JOIN k ON s.root = k.root AND s.level = k.level AND s.ts = k.ts)""")  # fmt: skip

# Two roots, with business days of their own: the second root has none on each third date.
_two = lambda m: Market(m.spark, m.sf_dir, roots=2)
_own_days = lambda m: m.business_days.where("root = 'E0' or day(date) % 3 <> 0")
_OWN = "(SELECT DISTINCT root, date FROM business WHERE root = 'E0' OR dayofmonth(date) % 3 <> 0)"


def _two_sql(columns: str, body: str) -> str:
    return _sql(columns, body).replace("'EV' AS root", "'E' || CAST(user_id % 2 AS VARCHAR) AS root")


def _add_two(name: str, columns: str, plan: Plan, sql: str) -> None:
    _add(name, columns, lambda m: plan(_two(m)), sql)
    _TWO.add(name)


_TWO: set[str] = set()
_add_two("align_drop_closed_by_root", "root ts kept aligned_ts", lambda m: events.align_events(m.cooled, _own_days(m), "drop_closed"), f"(SELECT *, ts AS aligned_ts FROM cooled c WHERE EXISTS (SELECT 1 FROM {_OWN} b WHERE b.root = c.root AND b.date = CAST(c.ts AS DATE)))")
_add_two("align_shift_next_by_root", "root ts kept aligned_ts", lambda m: events.align_events(m.cooled, _own_days(m), "shift_next"),
     f"(SELECT c.*, c.ts + to_days(CAST(coalesce((SELECT min(date) FROM {_OWN} b WHERE b.root = c.root AND b.date >= CAST(c.ts AS DATE)), CAST(c.ts AS DATE)) - CAST(c.ts AS DATE) AS INTEGER)) AS aligned_ts FROM cooled c)")
_add_two("business_day_gaps_by_root", "root ts gap:l", lambda m: events.business_day_gaps(m.cooled, _own_days(m)),
     f"(SELECT e.*, e.pos - last_value(e.pos IGNORE NULLS) OVER (PARTITION BY root ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM (SELECT c.root, c.ts, n.pos FROM cooled c "
     f"LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY root ORDER BY date) AS pos FROM {_OWN}) n ON c.root = n.root AND CAST(c.ts AS DATE) = n.date WHERE c.kept) e)")  # fmt: skip
_add_two("spread_events_by_root", "root level:l ts spread change:r z:r event", lambda m: m.strip_events, "strip_events")


# Streams: the table is read as a stream, to the end of what it has now, into a sink of the run.
def _streamed(m: Market, write, read) -> DataFrame:
    made = stream_bars.bucket_bars(adapters.ticks_of(stream_bars.read_stream(m.spark, f"{m.sf_dir}/events.parquet")))
    write(made, path := m.scratch.path("bars"), m.scratch.path("checkpoint")).awaitTermination()
    return read(path)


def _stream_cooldown(m: Market) -> DataFrame:
    rows = stream_bars.read_stream(m.spark, f"{m.sf_dir}/events.parquet")
    rows = rows.select(F.lit("EV").alias("root"), (F.col("user_id") % 4).alias("level"), "ts", (F.col("event_type") == "error").alias("event"))
    cooldown.write(cooldown.cooldown_time(rows, 3.0), path := m.scratch.path("kept"), m.scratch.path("checkpoint")).awaitTermination()
    return m.spark.read.parquet(path)


_add("stream_bucket_ohlcv", _BAR, lambda m: _streamed(m, stream_bars.write_current, lambda path: stream_bars.current(m.spark, path)), "bars")
_add("stream_closed_bars", _BAR, lambda m: _streamed(m, stream_bars.write_closed, m.spark.read.parquet), "(SELECT * FROM bars WHERE ts <= (SELECT max(ts) FROM bars) - INTERVAL 6 HOUR)")
_add("stream_cooldown", "root level:l ts", _stream_cooldown,
     """(WITH RECURSIVE e AS (SELECT 'EV' AS root, user_id % 4 AS level, ts FROM events WHERE event_type = 'error'), n AS (SELECT a.level, a.ts, min(b.ts) AS next_ts FROM e a JOIN e b ON a.level = b.level AND b.ts >= a.ts + INTERVAL 3 HOUR GROUP BY ALL),
     k AS (SELECT root, level, min(ts) AS ts FROM e GROUP BY root, level UNION ALL SELECT 'EV', n.level, n.next_ts FROM k JOIN n ON k.level = n.level AND k.ts = n.ts) SELECT * FROM k)""")  # fmt: skip

_add("rolling_zscore_in_chunks", "root level:l ts change:r z:r", lambda m: events.rolling_zscore_in_chunks(m.strip, 20, None, m.scratch.keep, 64), "scored")
_add("volume_threshold_by_rank", "root ts volume dte:l threshold:r",
     lambda m: bizdays.volume_threshold(chain.front_next_volume(m.pairs).withColumn("dte", days_to_expiry(F.col("front_expiry"), F.to_date("ts"))), bizdays.Coverage(), m.scratch.keep), "limited")
_add("spread_timing_summary_by_rank", "root spread count:l median:r mean:r std:r q25:r q75:r", lambda m: strip.timing_summary(strip.event_timing(m.strip_events, m.links), m.scratch.keep),
     "(SELECT root, 'S' || level AS spread, count(*) AS count, quantile_cont(days_to_expiry, 0.5) AS median, avg(days_to_expiry) AS mean, stddev_samp(days_to_expiry) AS std, quantile_cont(days_to_expiry, 0.25) AS q25, quantile_cont(days_to_expiry, 0.75) AS q75 FROM timing GROUP BY 1, 2)")
_add("price_quantiles", "root contract q quantile:r", lambda m: quantiles(m.trades, ["root", "contract"], "close", F.array(*map(F.lit, (0.0, 0.05, 0.5, 0.95, 1.0))), m.scratch.keep),
     "(SELECT root, contract, CAST(q AS DOUBLE) AS q, quantile FROM (SELECT root, contract, unnest([0.0, 0.05, 0.5, 0.95, 1.0]) AS q, unnest(quantile_cont(price, [0.0, 0.05, 0.5, 0.95, 1.0])) AS quantile FROM trades GROUP BY root, contract))")

# The strip.
_add("spread_timing_summary", "root spread count:l median:r mean:r std:r q25:r q75:r", lambda m: strip.timing_summary(strip.event_timing(m.strip_events, m.links)),
     "(SELECT root, 'S' || level AS spread, count(*) AS count, quantile_cont(days_to_expiry, 0.5) AS median, avg(days_to_expiry) AS mean, stddev_samp(days_to_expiry) AS std, quantile_cont(days_to_expiry, 0.25) AS q25, quantile_cont(days_to_expiry, 0.75) AS q75 FROM timing GROUP BY 1, 2)")
_add("spread_correlations", "root level_a:l level_b:l corr:r", lambda m: strip.spread_correlations(chain.strip_wide(m.strip)),
     "(SELECT a.root, a.level AS level_a, b.level AS level_b, CASE WHEN count(a.spread + b.spread) > 1 THEN corr(a.spread, b.spread) END AS corr FROM strip a JOIN strip b ON a.root = b.root AND a.ts = b.ts GROUP BY 1, 2, 3)")
_add("spread_signal_comparison", "root level:l event_count:l detection_rate_pct:r mean_spread:r std_spread:r mean_event_spread:r std_event_spread:r signal_to_noise:r", lambda m: strip.compare_signals(m.strip_events),
     "(SELECT *, std_event_spread / nullif(std_spread, 0) AS signal_to_noise FROM (SELECT root, level, count_if(event) AS event_count, 100.0 * count_if(event) / count(*) AS detection_rate_pct, avg(spread) AS mean_spread, stddev_samp(spread) AS std_spread, "
     "avg(spread) FILTER (WHERE event) AS mean_event_spread, stddev_samp(spread) FILTER (WHERE event) AS std_event_spread FROM strip_events GROUP BY root, level))")  # fmt: skip
_add("spread_change_statistics", "root level:l mean_change:r std_change:r mean_abs_change:r max_change:r min_change:r", lambda m: strip.change_statistics(m.strip),
     "(SELECT root, level, avg(change) AS mean_change, stddev_samp(change) AS std_change, avg(abs(change)) AS mean_abs_change, max(change) AS max_change, min(change) AS min_change FROM changed GROUP BY root, level)")
_add("spread_magnitudes", "root ts s1_change:r others_median:r others_mean:r dominance_ratio:r s1_dominates rank_s1", lambda m: m.sizes,
     "(SELECT *, CASE WHEN s1_change IS NOT NULL THEN coalesce(len(list_filter(others, lambda x: x > s1_change)), 0) + (coalesce(len(list_filter(others, lambda x: x = s1_change)), 0) + 2) / 2 END AS rank_s1 FROM magnitudes)")
_CYCLE = "root bin:l cycle total_observations:l s1_dominance_count:l s1_dominance_rate_pct:r avg_dominance_ratio:r avg_s1_change:r avg_others_median:r"
_add("s1_dominance_by_cycle", _CYCLE, lambda m: strip.dominance_by_cycle(m.sizes, m.links), "labelled")
_add("cross_spread_summary", "root metric value", lambda m: strip.cross_spread_summary(strip.dominance_by_cycle(m.sizes, m.links)),
     "(SELECT root, unnest(['Peak dominance bucket', 'Peak dominance rate (%)', 'Average dominance ratio at peak', 'Interpretation', 'Suggests institutional rolling']) AS metric, unnest([coalesce(peak, 'None'), "
     "coalesce(printf('%.1f', most), '0.0'), coalesce(printf('%.2f', ratio), 'N/A'), coalesce('S1 shows peak dominance ' || peak || ' days before F1 expiry (' || printf('%.1f', most) || '% of periods)', 'No significant S1 dominance detected at any point in the cycle'), "
     "CASE WHEN most > 15 THEN 'Yes' ELSE 'No' END]) AS value FROM (SELECT root, arg_max(cycle, rate - bin * 1e-9) FILTER (WHERE rate > 10) AS peak, max(rate) FILTER (WHERE rate > 10) AS most, "
     "arg_max(avg_dominance_ratio, rate - bin * 1e-9) FILTER (WHERE rate > 10) AS ratio FROM (SELECT *, s1_dominance_rate_pct AS rate FROM labelled) GROUP BY root))")  # fmt: skip
_add("strip_dominance", "root front_contract date s1_change:r other_median_change:r dominance_ratio:r expiry business_days_to_expiry:l classification", lambda m: m.classified, "dominant")
_add("expiry_dominance_filter", "root ts event removed", lambda m: strip.filter_expiry_dominance(events.detect_events(m.spread, window=20), m.classified),
     "(SELECT e.root, e.ts, e.event AND d.date IS NULL AS event, e.event AND d.date IS NOT NULL AS removed FROM strip_events e LEFT JOIN (SELECT DISTINCT root, date FROM dominant WHERE classification = 'expiry_dominance') d ON e.root = d.root AND CAST(e.ts AS DATE) = d.date WHERE e.level = 1)")

# Calendars and business days.
_CAL = "date holiday_name session_note partial_hours is_trading_day"
_of = lambda m, status: adapters.order_calendar(m.spark, m.sf_dir, status)
_both = lambda m: [_of(m, "O"), _of(m, "F")]
_add("calendar_load", _CAL, lambda m: _of(m, "O"), "listed_o")
_add("calendar_classify", _CAL, lambda m: _of(m, "F"), "listed_f")
_add("calendar_override", _CAL, lambda m: calendars.merge(_both(m), "override"), "(SELECT * FROM listed_o UNION ALL SELECT * FROM listed_f WHERE date NOT IN (SELECT date FROM listed_o))")
_first = ", ".join(f"CASE WHEN coalesce(a.{c}, '') <> '' THEN a.{c} ELSE coalesce(b.{c}, '') END AS {c}" for c in ("holiday_name", "session_note", "partial_hours"))
_add("calendar_union", _CAL, lambda m: calendars.merge(_both(m), "union"),
     f"(SELECT coalesce(a.date, b.date) AS date, {_first}, coalesce(a.is_trading_day, true) AND coalesce(b.is_trading_day, true) AS is_trading_day FROM listed_o a FULL JOIN listed_f b ON a.date = b.date)")
_add("calendar_intersection", _CAL, lambda m: calendars.merge(_both(m), "intersection"), "(SELECT a.* REPLACE (a.is_trading_day AND b.is_trading_day AS is_trading_day) FROM listed_o a JOIN listed_f b ON a.date = b.date)")
_add("calendar_lint", "level message date", lambda m: calendars.lint(adapters.order_days(m.spark, m.sf_dir)),
     "(SELECT 'error' AS level, concat('Unknown session_note value: ', chr(39), note, chr(39)) AS message, date FROM order_days WHERE lower(trim(note)) NOT IN ('', 'regular', 'early close', 'closed', 'full close') "
     "UNION ALL SELECT 'warning', 'Duplicate date', date FROM (SELECT date, row_number() OVER (PARTITION BY date) AS n FROM order_days) WHERE n > 1)")  # fmt: skip
_add("calendar_diff", "date kind", lambda m: calendars.difference(*_both(m), 1996, 1999),
     "(SELECT x.* FROM (SELECT date, 'missing' AS kind FROM (SELECT date FROM listed_f WHERE NOT is_trading_day EXCEPT SELECT date FROM listed_o WHERE NOT is_trading_day) UNION ALL SELECT date, 'extra' FROM (SELECT date FROM listed_o WHERE NOT is_trading_day EXCEPT SELECT date FROM listed_f WHERE NOT is_trading_day)) x WHERE year(date) BETWEEN 1996 AND 1999)")
_add("open_days", "date is_open", lambda m: calendars.open_days_of(adapters.order_days(m.spark, m.sf_dir).agg(F.min("date").alias("first"), F.max("date").alias("last")), _of(m, "O")),
     "(SELECT CAST(d AS DATE) AS date, coalesce(is_trading_day, isodow(d) <= 5) AS is_open FROM (SELECT unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM order_days) LEFT JOIN listed_o ON date = CAST(d AS DATE))")
_add("bdays_to_expiry", "contract date bd_to_expiry:l", lambda m: strip.business_days_to_expiry(m.panel.select("contract", "expiry", F.to_date("ts").alias("date")).distinct(), m.days),
     "(SELECT p.contract, p.date, CASE WHEN p.expiry >= p.date THEN (SELECT count(*) FROM days d WHERE d.is_open AND d.date > p.date AND d.date <= p.expiry) END AS bd_to_expiry FROM (SELECT DISTINCT contract, expiry, CAST(ts AS DATE) AS date FROM panel) p)")
_YEARS = lambda m: adapters.order_days(m.spark, m.sf_dir).select(F.year("date").alias("year")).distinct()
_NTH = "(SELECT y, d, dayofmonth(d) AS dm, month(d) AS mo, isodow(d) AS w, d + 7 AS later FROM (SELECT y, CAST(unnest(generate_series(make_timestamp(y, 1, 1, 0, 0, 0), make_timestamp(y, 12, 31, 0, 0, 0), INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT DISTINCT year(date) AS y FROM order_days)))"
_RULES = [
    ("Martin Luther King Jr. Day", "mo = 1 AND w = 1 AND dm BETWEEN 15 AND 21"), ("Presidents'' Day", "mo = 2 AND w = 1 AND dm BETWEEN 15 AND 21"), ("Memorial Day", "mo = 5 AND w = 1 AND month(later) = 6"),
    ("Labor Day", "mo = 9 AND w = 1 AND dm <= 7"), ("Thanksgiving", "mo = 11 AND w = 4 AND dm BETWEEN 22 AND 28"), ("New Year''s Day", "mo = 1 AND dm = 1"), ("Juneteenth", "mo = 6 AND dm = 19"),
    ("Independence Day", "mo = 7 AND dm = 4"), ("Christmas Day", "mo = 12 AND dm = 25"),
    ("Good Friday", "d IN (DATE '1995-04-14', DATE '1996-04-05', DATE '1997-03-28', DATE '1998-04-10', DATE '1999-04-02', DATE '2000-04-21', DATE '2001-04-13')"),
]
_add("holiday_rules", "year:l holiday date", lambda m: calendars.rules_of(_YEARS(m)), "(" + " UNION ALL ".join(f"SELECT y AS year, '{n}' AS holiday, d AS date FROM {_NTH} WHERE {w}" for n, w in _RULES) + ")")
_add("holiday_check", "year:l holiday date status", lambda m: calendars.holiday_check(_of(m, "O"), _YEARS(m)),
     "(SELECT y AS year, holiday, o AS date, CASE WHEN c.date IS NULL THEN 'missing' WHEN starts_with(lower(replace(c.holiday_name, ' Day', '')), lower(left(replace(holiday, ' Day', ''), 10))) THEN 'found' ELSE 'misnamed' END AS status "
     "FROM (SELECT *, CASE isodow(d) WHEN 6 THEN d - 1 WHEN 7 THEN d + 1 ELSE d END AS o FROM ("
     + " UNION ALL ".join(f"SELECT y, '{n}' AS holiday, d FROM {_NTH} WHERE {w}" for n, w in _RULES if not n.startswith(("Martin", "Presidents", "June"))) + ")) LEFT JOIN listed_o c ON c.date = o)")
_add("volume_threshold", "root ts volume dte:l threshold", lambda m: bizdays.volume_threshold(chain.front_next_volume(m.pairs).withColumn("dte", days_to_expiry(F.col("front_expiry"), F.to_date("ts"))), bizdays.Coverage()), "limited")
_AUDIT = "root date total_buckets:l us_buckets:l volume min_dte threshold has_data calendar_closed calendar_open is_partial_day required_buckets:l near_expiry_ok coverage_ok volume_ok_flag data_approved reason final_included"
_add("business_days_audit", _AUDIT, lambda m: m.audit("union_with_data"), "(SELECT *, calendar_open OR data_approved AS final_included FROM approved)")
for _policy, _key, _cond in (("calendar_only", "bdays_calendar_only", "calendar_open"), ("union_with_data", "bdays_union", "calendar_open OR data_approved"), ("intersection_strict", "bdays_intersection", "calendar_open AND data_approved")):
    _add(_key, "root date", lambda m, p=_policy: bizdays.business_days(m.audit(p)), f"approved WHERE {_cond}")

# Quality of contracts.
_add("quality_metrics", "contract status reasons data_points:l first last coverage_percent:r gap_list gaps:l max_gap_days:l year:l",
     lambda m: quality.metrics(m.daily, m.rules).withColumns({"gap_list": F.array_join(F.transform("gaps", lambda g: F.concat(g["start"], F.lit(".."), g["end"])), "; ")}).withColumns({"first": F.substring("date_range", 1, 10), "last": F.substring("date_range", 15, 10), "reasons": F.array_join("reasons", "; "), "gaps": F.size("gaps")}),
     "(SELECT contract, CASE WHEN reasons <> '' THEN 'EXCLUDED' ELSE 'INCLUDED' END AS status, reasons, data_points, CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last, round_even(coverage, 1) AS coverage_percent, gap_list, wide AS gaps, max_gap_days, year FROM reasoned)")
_add("quality_summary", "commodity total_contracts:l excluded:l included:l", lambda m: quality.summary(quality.metrics(m.daily, m.rules), m.rules),
     "(SELECT 'L' AS commodity, count(*) AS total_contracts, count_if(reasons <> '') AS excluded, count_if(reasons = '') AS included FROM reasoned)")
_DAY = "root contract day open high low close volume"
_add("quality_filter", _DAY, lambda m: quality.keep(m.daily, m.rules), "daily WHERE contract NOT IN (SELECT contract FROM reasoned WHERE reasons <> '')")
_add("quality_trim", _DAY, lambda m: quality.trim(m.daily),
     "(SELECT t.*, min(CASE WHEN ahead <= 5 AND rn <= n - 20 THEN day END) OVER (PARTITION BY contract) AS start FROM (SELECT *, max(datediff('day', before, day)) OVER (PARTITION BY contract ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 19 FOLLOWING) AS ahead FROM gapped) t) WHERE start IS NULL OR day >= start")


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    columns, plan, _ = _ALL[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _spark(columns, plan(Market(spark, sf_dir)))

    run.__name__ = name
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(name) for name in _ALL}
ORACLE_SQL: dict[str, str] = {name: (_two_sql if name in _TWO else _sql)(columns, sql) for name, (columns, _, sql) in _ALL.items() if sql}
#: The whole way from ticks to events of the front spread.
FLAGSHIP = "spread_events_zscore"
