"""The shared frames as SQL for DuckDB, in the same names as in Market: common table expressions for the queries' oracles."""

from __future__ import annotations

from ..sources.adapters import DAY_NAMES, EXCHANGE, NOTES

BUCKET = "CASE WHEN h BETWEEN 9 AND 15 THEN h - 8 WHEN h BETWEEN 16 AND 20 THEN 8 WHEN h >= 21 OR h <= 2 THEN 9 ELSE 10 END"
START = (
    "CASE WHEN bucket = 9 AND h < 3 THEN date_trunc('day', ts) - INTERVAL 3 HOUR "
    "ELSE date_trunc('day', ts) + to_hours(CASE WHEN bucket <= 7 THEN 8 + bucket WHEN bucket = 8 THEN 16 WHEN bucket = 9 THEN 21 ELSE 3 END) END"
)


#: Label and session of a bucket.
LABEL = (
    "['09:00 - US Open', '10:00 - US Morning', '11:00 - US Late Morning', '12:00 - US Midday', '13:00 - US Early Afternoon', '14:00 - US Late Afternoon', '15:00 - US Close', "
    "'Late US/After-Hours', 'Asia Session', 'Europe Session'][{0}]"
)
SESSION = "CASE WHEN {0} <= 7 THEN 'US Regular' WHEN {0} = 8 THEN 'Late US' WHEN {0} = 9 THEN 'Asia' WHEN {0} = 10 THEN 'Europe' END"


def one(k: int, name: str) -> str:
    """Columns of the contract at place k."""
    return ", ".join(f"max(CASE WHEN l.k = {k} THEN l.{c} END) AS {name}_{c}" for c in ("contract", "close", "volume", "expiry"))


def rows(values: list[tuple]) -> str:
    """Calendar rows as SQL values."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"(DATE '{d}', {', '.join(map(quote, r))})" for d, *r in values)


def classified(name: str, values: list[tuple]) -> str:
    """A calendar as classify() gives it."""
    return (
        f"{name} AS (SELECT date, holiday_name, CASE WHEN note = 'open' THEN 'regular' ELSE note END AS session_note, partial_hours, note NOT IN ('closed', 'full close') AS is_trading_day "
        f"FROM (SELECT *, lower(trim(raw)) AS note FROM (VALUES {rows(values)}) t(date, holiday_name, raw, partial_hours)))"
    )


SERIES = "PARTITION BY root, level ORDER BY ts"
_DAYS = ", ".join("'" + n.replace("'", "''") + "'" for n in DAY_NAMES)
_CASE = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NOTES.items()) + " END"
WITH = f"""WITH RECURSIVE ticks AS (
  SELECT 'EV' AS root, 'C' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS contract, ts, value AS price, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS volume FROM events),
expiry_dim AS (SELECT 'C' || lpad(CAST(k AS VARCHAR), 2, '0') AS contract, CAST(DATE '2024-01-03' + CAST(3 * k AS INTEGER) AS DATE) AS expiry FROM generate_series(0, 11) t(k)),
stamped AS (SELECT *, {BUCKET} AS bucket FROM (SELECT *, hour(ts) AS h FROM ticks)),
started AS (SELECT *, {START} AS bar FROM stamped),
bars AS (SELECT s.root, s.contract, s.bar AS ts, s.bucket, arg_min(s.price, s.ts) AS open, max(s.price) AS high, min(s.price) AS low, arg_max(s.price, s.ts) AS close, sum(s.volume) AS volume
  FROM started s GROUP BY s.root, s.contract, s.bar, s.bucket),
panel AS (SELECT b.*, e.expiry FROM bars b LEFT JOIN expiry_dim e ON b.contract = e.contract),
links AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root, ts ORDER BY expiry, contract) AS k FROM panel WHERE close IS NOT NULL AND expiry >= CAST(ts AS DATE)) WHERE k <= 12),
grid AS (SELECT DISTINCT root, ts FROM panel),
pairs AS (SELECT g.root, g.ts, {one(1, "front")}, {one(2, "next")} FROM grid g LEFT JOIN links l ON g.root = l.root AND g.ts = l.ts GROUP BY g.root, g.ts),
meta AS (SELECT root, ts, arg_min(bucket, contract) AS bucket FROM panel GROUP BY root, ts),
strip AS (SELECT g.root, g.ts, n AS level, b.close - a.close AS spread FROM grid g CROSS JOIN generate_series(1, 11) t(n)
  LEFT JOIN links a ON a.root = g.root AND a.ts = g.ts AND a.k = n LEFT JOIN links b ON b.root = g.root AND b.ts = g.ts AND b.k = n + 1),
changed AS (SELECT *, spread - lag(spread) OVER ({SERIES}) AS change FROM strip),
scored AS (SELECT *, CASE WHEN n >= 10 THEN (change - m) / nullif(sd, 0) END AS z FROM (
  SELECT *, avg(change) OVER w AS m, stddev_samp(change) OVER w AS sd, count(change) OVER w AS n FROM changed WINDOW w AS ({SERIES} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))),
strip_events AS (SELECT *, coalesce(z > 1.5, false) AS event, row_number() OVER ({SERIES}) AS rn FROM scored),
ev AS (SELECT root, level, ts, rn FROM strip_events WHERE event AND level = 1),
after_time AS (SELECT a.root, a.level, a.ts, min(b.ts) AS next_ts FROM ev a JOIN ev b ON a.root = b.root AND b.ts >= a.ts + INTERVAL 3 HOUR GROUP BY a.root, a.level, a.ts),
kept_time AS (SELECT root, level, min(ts) AS ts FROM ev GROUP BY root, level UNION ALL SELECT n.root, n.level, n.next_ts FROM kept_time k JOIN after_time n ON k.root = n.root AND k.ts = n.ts),
after_rows AS (SELECT a.root, a.level, a.rn, min(b.rn) AS next_rn FROM ev a JOIN ev b ON a.root = b.root AND b.rn - a.rn > 5 GROUP BY a.root, a.level, a.rn),
kept_rows AS (SELECT root, level, min(rn) AS rn FROM ev GROUP BY root, level UNION ALL SELECT n.root, n.level, n.next_rn FROM kept_rows k JOIN after_rows n ON k.root = n.root AND k.rn = n.rn),
cooled AS (SELECT e.*, k.ts IS NOT NULL AS kept FROM strip_events e LEFT JOIN kept_time k ON e.root = k.root AND e.ts = k.ts WHERE e.level = 1),
marked AS (SELECT c.*, m.bucket, p.front_volume AS volume FROM cooled c LEFT JOIN meta m ON c.root = m.root AND c.ts = m.ts LEFT JOIN pairs p ON c.root = p.root AND c.ts = p.ts),
{classified("calendar", EXCHANGE)},
days AS (SELECT CAST(d AS DATE) AS date, coalesce(c.is_trading_day, isodow(d) <= 5) AS is_open FROM generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-03-01', INTERVAL 1 DAY) t(d) LEFT JOIN calendar c ON c.date = CAST(d AS DATE)),
opened AS (SELECT *, sum(CAST(is_open AS INTEGER)) OVER (ORDER BY date) AS n_open FROM days),
pair_volume AS (SELECT root, ts, front_expiry, CASE WHEN front_contract IS NULL THEN 0.0 ELSE front_volume END + CASE WHEN next_contract IS NULL THEN 0.0 ELSE next_volume END AS volume FROM pairs),
dated AS (SELECT *, CASE WHEN front_expiry IS NOT NULL THEN greatest(datediff('day', CAST(ts AS DATE), front_expiry), 0) END AS dte FROM pair_volume),
ranged AS (SELECT *, CASE WHEN dte <= 5 THEN 0 WHEN dte <= 30 THEN 1 WHEN dte <= 60 THEN 2 ELSE 3 END AS r FROM dated),
limits AS (SELECT root, coalesce(quantile_cont(volume, 0.3) FILTER (WHERE r = 0), 0.0) AS t0, coalesce(quantile_cont(volume, 0.2) FILTER (WHERE r = 1), 0.0) AS t1,
  coalesce(quantile_cont(volume, 0.1) FILTER (WHERE r = 2), 0.0) AS t2, coalesce(quantile_cont(volume, 0.1), 0.0) AS t3 FROM ranged GROUP BY root),
limited AS (SELECT g.*, CASE r WHEN 0 THEN t0 WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END AS threshold FROM ranged g JOIN limits USING (root)),
seen AS (SELECT l.root, CAST(l.ts AS DATE) + CASE WHEN m.bucket = 9 THEN 1 ELSE 0 END AS date, count(m.bucket) AS total_buckets, count_if(m.bucket <= 7) AS us_buckets,
  coalesce(sum(l.volume), 0.0) AS volume, CAST(min(l.dte) AS DOUBLE) AS min_dte, arg_min(l.threshold, l.ts) AS threshold
  FROM limited l LEFT JOIN meta m ON l.root = m.root AND l.ts = m.ts GROUP BY 1, 2),
flagged AS (SELECT s.*, s.total_buckets > 0 AS has_data, coalesce(NOT c.is_trading_day, false) AS calendar_closed, NOT coalesce(NOT c.is_trading_day, false) AND isodow(s.date) <= 5 AS calendar_open,
  coalesce(c.is_trading_day AND trim(c.partial_hours) <> '', false) AS is_partial_day, coalesce(s.min_dte <= 5, false) AS near_expiry_ok, coalesce(s.threshold <= 0 OR s.volume >= s.threshold, false) AS volume_ok_flag
  FROM seen s LEFT JOIN calendar c ON s.date = c.date),
required AS (SELECT *, CASE WHEN is_partial_day THEN 4 ELSE 6 END AS required_buckets FROM flagged),
covered AS (SELECT *, total_buckets >= required_buckets OR us_buckets >= 2 OR near_expiry_ok AS coverage_ok FROM required),
approved AS (SELECT *, has_data AND coverage_ok AND volume_ok_flag AS data_approved, CASE WHEN calendar_closed THEN 'calendar_closed' WHEN NOT has_data THEN 'no_data'
  WHEN NOT coverage_ok AND NOT volume_ok_flag THEN 'coverage_and_volume_fail' WHEN NOT coverage_ok THEN 'coverage_fail' WHEN NOT volume_ok_flag THEN 'volume_fail' ELSE 'included' END AS reason FROM covered),
business AS (SELECT root, date FROM approved WHERE calendar_open),
numbered AS (SELECT root, date, row_number() OVER (PARTITION BY root ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT root, date FROM business)),
gaps AS (SELECT e.*, e.pos - last_value(e.pos IGNORE NULLS) OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM (
  SELECT c.*, n.pos FROM (SELECT *, lag(spread) OVER ({SERIES}) AS spread_before FROM cooled) c LEFT JOIN numbered n ON c.root = n.root AND CAST(c.ts AS DATE) = n.date WHERE c.kept) e),
sizes AS (SELECT root, ts, max(CASE WHEN level = 1 THEN abs(change) END) AS s1_change, quantile_cont(abs(change), 0.5) FILTER (WHERE level > 1) AS others_median, avg(abs(change)) FILTER (WHERE level > 1) AS others_mean,
  list(abs(change)) FILTER (WHERE level > 1 AND change IS NOT NULL) AS others FROM changed GROUP BY root, ts),
magnitudes AS (SELECT *, s1_change / (others_median + 1e-10) AS dominance_ratio, coalesce(s1_change / (others_median + 1e-10) > 2.0, false) AS s1_dominates FROM sizes),
front AS (SELECT root, ts, contract AS front_contract, expiry FROM links WHERE k = 1),
cycles AS (SELECT root, bin, count(*) AS total_observations, count_if(s1_dominates) AS s1_dominance_count, 100.0 * count_if(s1_dominates) / count(*) AS s1_dominance_rate_pct,
  avg(dominance_ratio) FILTER (WHERE s1_dominates) AS avg_dominance_ratio, avg(s1_change) AS avg_s1_change, avg(others_median) AS avg_others_median FROM (
  SELECT m.*, CASE WHEN d <= 5 THEN 0 WHEN d <= 10 THEN 1 WHEN d <= 15 THEN 2 WHEN d <= 20 THEN 3 WHEN d <= 25 THEN 4 WHEN d <= 30 THEN 5 WHEN d <= 40 THEN 6 WHEN d <= 50 THEN 7 WHEN d <= 60 THEN 8 ELSE 9 END AS bin
  FROM (SELECT m.*, greatest(datediff('day', CAST(m.ts AS DATE), f.expiry), 0) AS d FROM magnitudes m JOIN front f ON m.root = f.root AND m.ts = f.ts) m) GROUP BY root, bin),
labelled AS (SELECT *, ['0-5', '6-10', '11-15', '16-20', '21-25', '26-30', '31-40', '41-50', '51-60', '60+'][bin + 1] AS cycle FROM cycles),
dominant AS (SELECT *, CASE WHEN dominance_ratio >= 2.0 AND coalesce(business_days_to_expiry <= 18, false) THEN 'expiry_dominance' WHEN dominance_ratio >= 2.0 THEN 'broad_roll' ELSE 'normal' END AS classification FROM (
  SELECT x.*, CASE WHEN x.expiry >= x.date THEN t.n_open - f.n_open END AS business_days_to_expiry FROM (
    SELECT m.root, f.front_contract, CAST(m.ts AS DATE) AS date, quantile_cont(s1_change, 0.5) AS s1_change, quantile_cont(others_median, 0.5) AS other_median_change, coalesce(max(dominance_ratio), 0.0) AS dominance_ratio, max(f.expiry) AS expiry
    FROM magnitudes m JOIN front f ON m.root = f.root AND m.ts = f.ts GROUP BY 1, 2, 3) x LEFT JOIN opened f ON f.date = x.date LEFT JOIN opened t ON t.date = x.expiry)),
timing AS (SELECT e.root, e.ts, e.level, e.spread, o.contract, o.expiry, datediff('day', CAST(e.ts AS DATE), f.expiry) AS days_to_expiry, f.front_contract AS f1_contract, f.expiry AS f1_expiry
  FROM strip_events e JOIN links o ON e.root = o.root AND e.ts = o.ts AND o.k = e.level JOIN front f ON e.root = f.root AND e.ts = f.ts WHERE e.event),
trades AS (SELECT 'LI' AS root, 'L' || lpad(CAST(greatest(l_partkey % 24, CAST(ceil(m / 3.0) AS BIGINT)) AS VARCHAR), 2, '0') AS contract, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS volume,
  row(l_orderkey, l_linenumber, l_extendedprice) AS seq FROM (SELECT *, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 3 + CASE WHEN dayofmonth(l_shipdate) > 28 THEN 1 ELSE 0 END AS m FROM lineitem)),
daily AS (SELECT root, contract, CAST(ts AS DATE) AS day, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(volume) AS volume FROM trades GROUP BY 1, 2, 3),
spans AS (SELECT root, contract, unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM daily GROUP BY 1, 2),
filled AS (SELECT s.root, s.contract, CAST(s.d AS DATE) AS day, b.open, b.high, b.low, b.close, coalesce(b.volume, 0.0) AS volume FROM spans s LEFT JOIN daily b ON s.contract = b.contract AND CAST(s.d AS DATE) = b.day),
gapped AS (SELECT *, lag(day) OVER (PARTITION BY contract ORDER BY day) AS before, row_number() OVER (PARTITION BY contract ORDER BY day) AS rn, count(*) OVER (PARTITION BY contract) AS n FROM daily),
measured AS (SELECT contract, count(*) AS data_points, min(day) AS first, max(day) AS last, coalesce(max(datediff('day', before, day)), 0) AS max_gap_days, count_if(datediff('day', before, day) > 20) AS wide, coalesce(string_agg(CAST(before AS VARCHAR) || '..' || CAST(day AS VARCHAR), '; ' ORDER BY day) FILTER (WHERE datediff('day', before, day) > 20), '') AS gap_list,
  CASE WHEN CAST(right(contract, 2) AS INTEGER) <= 30 THEN 2000 ELSE 1900 END + CAST(right(contract, 2) AS INTEGER) AS year FROM gapped GROUP BY contract),
judged AS (SELECT *, 100 * data_points / (0.7 * (datediff('day', first, last) + 1)) AS coverage FROM measured),
reasoned AS (SELECT *, concat_ws('; ', CASE WHEN year > 0 AND year < 2010 THEN 'Contract year ' || year || ' before cutoff 2010' END, CASE WHEN data_points < 300 THEN 'Insufficient data points: ' || data_points || ' < 300' END,
  CASE WHEN wide > 0 THEN 'Data gaps exceed 20 days: ' || wide END, CASE WHEN coverage < 60 THEN printf('Coverage %.1f%% below 60%%', coverage) END) AS reasons FROM judged),
order_days AS (SELECT CAST(o_orderdate AS DATE) AS date, [{_DAYS}][o_orderkey % {len(DAY_NAMES)} + 1] AS holiday_name, {_CASE} AS note, o_orderstatus AS status, o_orderkey AS line FROM orders),
listed AS (SELECT status, date, holiday_name, CASE lower(trim(coalesce(note, ''))) WHEN 'open' THEN 'regular' ELSE lower(trim(coalesce(note, ''))) END AS session_note, CASE note WHEN 'Early close' THEN '09:00-13:00' ELSE '' END AS partial_hours,
  lower(trim(coalesce(note, ''))) NOT IN ('closed', 'full close') AS is_trading_day FROM order_days QUALIFY row_number() OVER (PARTITION BY status, date ORDER BY line) = 1),
listed_o AS (SELECT * EXCLUDE (status) FROM listed WHERE status = 'O'),
listed_f AS (SELECT * EXCLUDE (status) FROM listed WHERE status = 'F')
"""
