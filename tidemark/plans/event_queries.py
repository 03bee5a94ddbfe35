"""Queries of event operators, as-of joins and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import asof, islands, near_join
from tidemark.operators import events as E
from tidemark.operators import features as X
from tidemark.operators import labels as L
from tidemark.operators import states as S
from tidemark.plans.inputs import bars, bars_sql, events, full_sql, points, r, runs_sql, table, trades

QUERIES: dict = {}
ORACLE: dict = {}
W = 43_200
SIDES = """a AS (SELECT user_id AS key, event_id, ts AS event_time FROM events WHERE event_type = 'view'),
    p AS (SELECT user_id AS key, event_id, ts AS event_time FROM events WHERE event_type = 'purchase')"""
GAP = "(epoch_us({0}) - epoch_us({1})) / 1000000.0"


def a(spark, sf):
    return points(spark, sf, "view")


def p(spark, sf):
    return points(spark, sf, "purchase")


def add(name, query, sql):
    QUERIES[name] = query
    ORACLE[name] = sql


def seq_sql(gap_from: str = "", lag: int = 0) -> str:
    return f"""WITH {SIDES},
    m AS (SELECT p.key, p.event_id, p.event_time, a.event_id AS first_id, {GAP.format('p.event_time', 'a.event_time')} AS gap_seconds,
      row_number() OVER (PARTITION BY p.event_id ORDER BY a.event_time DESC, a.event_id DESC) AS k FROM p
    JOIN a ON a.key = p.key AND a.event_time < p.event_time AND a.event_time >= p.event_time - INTERVAL {W} SECOND)
    SELECT key, event_id, event_time, first_id, gap_seconds FROM m WHERE k = 1 {gap_from}"""


add("c19_event_sequence", lambda s, d: E.sequence(a(s, d), p(s, d), W), seq_sql())
add("c25_sequence_in_bars", lambda s, d: E.sequence_in_bars(a(s, d), p(s, d), 12, 3600, 60), seq_sql("AND gap_seconds >= 3600"))
add(
    "c20_co_occurrence", lambda s, d: E.co_occurrence(a(s, d), p(s, d), W),
    f"""WITH {SIDES}, m AS (
      SELECT p.key, p.event_id, p.event_time, a.event_id AS other_id, row_number() OVER (PARTITION BY p.event_id
    ORDER BY a.event_time DESC, a.event_id DESC) AS k FROM p
    JOIN a ON a.key = p.key AND a.event_time <= p.event_time AND a.event_time >= p.event_time - INTERVAL {W} SECOND
      UNION ALL
      SELECT a.key, a.event_id, a.event_time, p.event_id, row_number() OVER (PARTITION BY a.event_id ORDER BY p.event_time DESC, p.event_id DESC)
    FROM a JOIN p ON a.key = p.key AND p.event_time < a.event_time AND p.event_time >= a.event_time - INTERVAL {W} SECOND)
    SELECT key, event_id, event_time, other_id FROM m WHERE k = 1""",
)
ABSENT = f"""WITH {SIDES} SELECT p.key, p.event_id, p.event_time FROM p WHERE NOT EXISTS (SELECT 1 FROM a
    WHERE a.key = p.key AND a.event_time <= p.event_time AND a.event_time >= p.event_time - INTERVAL {W} SECOND)"""
add("c21_event_absence", lambda s, d: E.absence(p(s, d), a(s, d), W), ABSENT)
add("c22_window_end", lambda s, d: E.window_end(a(s, d), W).select("key", "event_id", "event_time"), f"WITH {SIDES} SELECT key, event_id, event_time + INTERVAL {W} SECOND AS event_time FROM a")
add(
    "c24_not_followed", lambda s, d: E.not_followed(a(s, d), p(s, d), W),
    f"""WITH {SIDES} SELECT a.key, a.event_id, a.event_time + INTERVAL {W} SECOND AS event_time FROM a WHERE NOT EXISTS (SELECT 1 FROM p
    WHERE a.key = p.key AND p.event_time >= a.event_time AND p.event_time <= a.event_time + INTERVAL {W} SECOND)""",
)
add(
    "c23_event_count", lambda s, d: E.at_least(a(s, d), 2, W),
    f"""WITH {SIDES},
    m AS (SELECT key, event_id, event_time, count(*) OVER w AS n_events, first_value(event_id) OVER w AS first_id, first_value(event_time) OVER w AS first_time
    FROM a WINDOW w AS (PARTITION BY key ORDER BY event_time RANGE BETWEEN INTERVAL {W} SECOND PRECEDING AND CURRENT ROW))
    SELECT key, event_id, event_time, n_events, first_id, first_time FROM m WHERE n_events >= 2""",
)
add(
    "c28_lead_lag", lambda s, d: E.lead_lag(a(s, d), p(s, d), W, 7200),
    f"""WITH {SIDES} SELECT least(CAST(floor((epoch_us(p.event_time) - epoch_us(a.event_time) + {W}000000) / 7200000000.0) AS BIGINT), 11) AS bin, count(*) AS n
    FROM a JOIN p ON a.key = p.key AND abs(epoch_us(p.event_time) - epoch_us(a.event_time)) <= {W}000000 GROUP BY 1""",
)
add(
    "d03_event_frequency", lambda s, d: E.frequency(a(s, d), "2024-01-01", "2024-01-31", 21_600).select("bucket", "n", "total", r(F.col("per_day")).alias("per_day")),
    f"""WITH {SIDES}, g AS (SELECT range AS bucket FROM range(0, 120)),
    c AS (SELECT CAST(floor(epoch_us(event_time) / 21600000000.0) AS BIGINT) - CAST(epoch_us(TIMESTAMP '2024-01-01') / 21600000000 AS BIGINT) AS bucket, count(*) AS n
    FROM a WHERE event_time >= TIMESTAMP '2024-01-01' AND event_time < TIMESTAMP '2024-01-31' GROUP BY 1)

    SELECT g.bucket, coalesce(c.n, 0) AS n, CAST(sum(coalesce(c.n, 0)) OVER () AS BIGINT) AS total, round(sum(coalesce(c.n, 0)) OVER () / 30.0, 6) AS per_day
    FROM g LEFT JOIN c USING (bucket)""",
)
add(
    "d04_co_occurrence_lift", lambda s, d: E.co_occurrence_lift(a(s, d), p(s, d), W, "2024-01-01", "2024-01-31").select("a_near_b", "b_near_a", r(F.col("expected")).alias("expected"), r(F.col("lift")).alias("lift")),
    f"""WITH {SIDES}, n AS (SELECT key, (SELECT count(*) FROM a WHERE a.key = k.key) AS n_a, (SELECT count(*) FROM p WHERE p.key = k.key) AS n_b FROM (SELECT key FROM a UNION SELECT key FROM p) k),
    e AS (SELECT sum(n_a * (1 - exp(-n_b * 2.0 * {W} / (30 * 86400)))) AS expected FROM n),
    x AS (SELECT count(*) AS a_near_b FROM a WHERE EXISTS (SELECT 1 FROM p WHERE p.key = a.key AND p.event_time BETWEEN a.event_time - INTERVAL {W} SECOND AND a.event_time + INTERVAL {W} SECOND)),
    y AS (SELECT count(*) AS b_near_a FROM p WHERE EXISTS (SELECT 1 FROM a WHERE p.key = a.key AND a.event_time BETWEEN p.event_time - INTERVAL {W} SECOND AND p.event_time + INTERVAL {W} SECOND))
    SELECT a_near_b, b_near_a, round(expected, 6) AS expected, round(a_near_b / nullif(expected, 0), 6) AS lift FROM x, y, e""",
)
add(
    "d05_overlap", lambda s, d: E.overlap(a(s, d), W).select("key", "n", "n_close", r(F.col("mean_gap")).alias("mean_gap"), r(F.col("dispersion")).alias("dispersion")),
    f"""WITH {SIDES}, g AS (SELECT key, {GAP.format('event_time', 'lag(event_time) OVER (PARTITION BY key ORDER BY event_time, event_id)')} AS gap
    FROM a)

    SELECT key, count(*) AS n, count(*) FILTER (WHERE gap < {W}) AS n_close, round(avg(gap), 6) AS mean_gap, round(var_pop(gap) / nullif(avg(gap) * avg(gap), 0), 6) AS dispersion
    FROM g GROUP BY key""",
)
add(
    "d05_independent_count", lambda s, d: E.independent_count(a(s, d), W),
    f"""WITH RECURSIVE {SIDES}, walk AS (
      SELECT key, min(event_time) AS t, 1 AS n FROM a GROUP BY key
      UNION ALL
      SELECT w.key, (SELECT min(a.event_time) FROM a WHERE a.key = w.key AND a.event_time >= w.t + INTERVAL {W} SECOND) AS t, w.n + 1 FROM walk w
    WHERE EXISTS (SELECT 1 FROM a WHERE a.key = w.key AND a.event_time >= w.t + INTERVAL {W} SECOND)
    ) SELECT key, CAST(max(n) AS BIGINT) AS n_independent FROM walk GROUP BY key""",
)

# ---- as-of joins


def vol(s, d):
    return X.with_returns(bars(s, d)).withColumn("vol", X.realized_volatility(5))


def labelled(s, d):
    return S.trend_range(X.with_returns(bars(s, d)), "log_return", 5, 0.5)


def purchases(s, d):
    """Purchases as decisions on the instrument 'view'."""
    return p(s, d).select(F.lit("view").alias("symbol"), F.col("event_id").alias("event_key"), "event_time")


VOL = f"""{runs_sql()}, v AS (SELECT *, sqrt({full_sql('sum', 'log_return * log_return', 5)}) AS vol FROM b),
    q AS (SELECT 'view' AS symbol, event_id AS event_key, ts AS event_time FROM events WHERE event_type = 'purchase')"""
TREND = """s AS (SELECT symbol, available_time, CASE WHEN k < 5 THEN NULL WHEN p = 0 THEN 'range' WHEN abs(t) / p >= 0.5 THEN CASE
    WHEN t > 0 THEN 'up' ELSE 'down' END ELSE 'range' END AS state
    FROM (SELECT *, count(log_return) OVER w AS k, sum(log_return) OVER w AS t, sum(abs(log_return)) OVER w AS p FROM b
    WINDOW w AS (PARTITION BY symbol ORDER BY interval_start ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)))"""
ASOF = "SELECT q.event_key, q.event_time, x.available_time AS matched_time, {value} FROM q ASOF LEFT JOIN {source} x ON q.symbol = x.symbol AND q.event_time >= x.available_time"
add("c12_asof_value", lambda s, d: asof(purchases(s, d), vol(s, d), ["symbol"], "event_time", "available_time", "vol").select("event_key", "event_time", "matched_time", r(F.col("vol")).alias("vol")), f"WITH {VOL} {ASOF.format(value='round(x.vol, 6) AS vol', source='v')}")
add(
    "c11_asof_max_age", lambda s, d: asof(purchases(s, d), labelled(s, d), ["symbol"], "event_time", "available_time", "state", 1800).select("event_key", "event_time", "matched_time", F.coalesce("state", F.lit("unknown")).alias("state")),
    f"""WITH {VOL}, {TREND}, j AS ({ASOF.format(value='x.state', source='s')}) SELECT event_key, event_time, CASE
    WHEN epoch_us(event_time) - epoch_us(matched_time) <= 1800000000 THEN matched_time END AS matched_time, CASE
    WHEN epoch_us(event_time) - epoch_us(matched_time) <= 1800000000 THEN coalesce(state, 'unknown') ELSE 'unknown' END AS state FROM j""",
)
add("c13_volatility_at_entry", lambda s, d: L.volatility_at_entry(purchases(s, d), vol(s, d).where("vol is not null"), "vol").select("event_key", "matched_time", r(F.col("vol")).alias("vol")), f"""WITH {VOL},
    v2 AS (SELECT * FROM v WHERE vol IS NOT NULL), j AS ({ASOF.format(value='round(x.vol, 6) AS vol', source='v2')})
    SELECT event_key, matched_time, vol FROM j""")
add(
    "c14_gate_state", lambda s, d: asof(purchases(s, d), labelled(s, d).where("state is not null"), ["symbol"], "event_time", "available_time", "state").select("event_key", "state", F.coalesce(F.col("state") == "up", F.lit(False)).alias("gate_open")),
    f"""WITH {VOL}, {TREND}, s2 AS (SELECT * FROM s WHERE state IS NOT NULL), j AS ({ASOF.format(value='x.state', source='s2')})
    SELECT event_key, state, coalesce(state = 'up', false) AS gate_open FROM j""",
)
add(
    "b10_known_labels", lambda s, d: L.known_as_of(L.forward_return(purchases(s, d), bars(s, d), 60, 4), "2024-01-15").select("event_key", "known_at", r(F.col("label")).alias("label")),
    None,
)

ENTRY = f"""{VOL}, nb AS (SELECT *, row_number() OVER (PARTITION BY symbol, run_id ORDER BY interval_start) AS no FROM b), e0 AS (
  SELECT q.event_key, q.event_time, x.interval_start AS entry_start, x.open AS entry_open, x.run_id, x.no FROM q ASOF LEFT
    JOIN nb x ON q.symbol = x.symbol AND q.event_time <= x.interval_start
), entry AS (SELECT event_key, event_time, CASE WHEN ok THEN entry_start END AS entry_start, CASE WHEN ok THEN entry_open END AS entry_open, CASE
    WHEN ok THEN run_id END AS run_id, CASE WHEN ok THEN no END AS no FROM (SELECT *, entry_start < event_time + INTERVAL 1 HOUR AS ok FROM e0))"""
add("c16_entry_bar", lambda s, d: L.entry_bars(purchases(s, d), bars(s, d), 60).select("event_key", "event_time", "entry_start", r(F.col("entry_open")).alias("entry_open")), f"WITH {ENTRY} SELECT event_key, event_time, entry_start, round(entry_open, 6) AS entry_open FROM entry")
WIN = f"""{ENTRY}, win AS (SELECT e.*, x.close AS exit_close, x.interval_end AS exit_end, (SELECT max(y.available_time) FROM nb y
    WHERE y.symbol = 'view' AND y.run_id = e.run_id AND y.no BETWEEN e.no AND e.no + 3) AS known_max FROM entry e LEFT
    JOIN nb x ON x.symbol = 'view' AND x.run_id = e.run_id AND x.no = e.no + 3)"""
FWD = """SELECT event_key, {} known_at, round(label, 6) AS label FROM (SELECT event_key, event_time, exit_close / entry_open - 1 AS label, CASE
    WHEN exit_close IS NOT NULL THEN known_max END AS known_at FROM win)"""
add("e35_forward_return", lambda s, d: L.forward_return(purchases(s, d), bars(s, d), 60, 4).select("event_key", "event_time", "known_at", r(F.col("label")).alias("label")), f"WITH {WIN} {FWD.format('event_time,')}")
ORACLE["b10_known_labels"] = f"WITH {WIN} {FWD.format('')} WHERE known_at <= TIMESTAMP '2024-01-15'"


def barrier_sql(scale: str, extra: str = "") -> str:
    return f"""WITH {WIN}{extra}, w2 AS (SELECT win.*, {scale} AS sc FROM win {'LEFT JOIN ev ON ev.event_key = win.event_key' if extra else ''}),
    lim AS (SELECT *, entry_open * (1 + 0.5 * sc) AS hi, entry_open * (1 - 0.4 * sc) AS lo, exit_close IS NOT NULL AND sc > 0 AS good
    FROM w2),
    path AS (SELECT l.event_key, y.no - l.no AS step, y.open, y.low <= l.lo AS down, y.high >= l.hi AS up, l.lo, l.hi, y.available_time FROM lim l
    JOIN nb y ON y.symbol = 'view' AND y.run_id = l.run_id AND y.no BETWEEN l.no AND l.no + 3
    WHERE l.good),
    touch AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY step) AS k FROM path WHERE down OR up),
    t AS (SELECT event_key, step, CASE WHEN down THEN least(open, lo) ELSE greatest(open, hi) END AS price, CASE WHEN down THEN -1 ELSE 1 END AS side
    FROM touch WHERE k = 1),
    kn AS (SELECT p.event_key, max(p.available_time) AS touch_known FROM path p JOIN t ON t.event_key = p.event_key AND p.step <= t.step
    GROUP BY p.event_key)
    SELECT l.event_key, CASE WHEN good THEN round(coalesce(t.price, exit_close) / entry_open - 1, 6) END AS label, CASE
    WHEN good THEN coalesce(t.side, 0) END AS side, CASE
    WHEN good THEN coalesce(kn.touch_known, known_max) END AS known_at,
      {"CASE WHEN sc <= 0 THEN 'volatility is not positive' END" if extra else "CAST(NULL AS VARCHAR)"} AS problem
    FROM lim l LEFT JOIN t ON t.event_key = l.event_key LEFT JOIN kn ON kn.event_key = l.event_key"""


add("e36_triple_barrier", lambda s, d: L.triple_barrier(purchases(s, d), bars(s, d), 60, 4, 0.5, 0.4).select("event_key", r(F.col("label")).alias("label"), "side", "known_at", "problem"), barrier_sql("1"))


def scaled(s, d):
    ev = L.volatility_at_entry(purchases(s, d), vol(s, d), "vol")
    return L.triple_barrier(ev, bars(s, d), 60, 4, 0.5, 0.4, "vol").select("event_key", r(F.col("label")).alias("label"), "side", "known_at", "problem")


add("e37_scaled_triple_barrier", scaled, barrier_sql("ev.vol", f", ev AS ({ASOF.format(value='x.vol', source='v')})"))
add("e38_label_checks", lambda s, d: L.materialise_labels(L.forward_return(purchases(s, d), bars(s, d), 60, 4), purchases(s, d)), f"""WITH {WIN}
    SELECT count(*) AS n_events, count(*) AS n_labels, 0 AS n_missing, 0 AS n_repeated, 0 AS n_unasked, count(*) FILTER (WHERE exit_close IS NULL) AS n_null
    FROM win""")
add("f07_first_touch", lambda s, d: L.triple_barrier(purchases(s, d), bars(s, d), 60, 4, 0.5, 0.4).where("side <> 0").groupBy("side").agg(F.count("*").alias("n")), "SELECT side, count(*) AS n FROM (" + barrier_sql("1") + ") WHERE side <> 0 GROUP BY side")

# ---- latest rows


def visible(s, d):
    return trades(s, d).where("available_time + interval 60 seconds <= timestamp '2024-01-15 00:00:00'")


QUERIES["b06_visible_latest"] = lambda s, d: visible(s, d).groupBy("symbol").agg(F.max_by(F.struct("venue_trade_id", "price"), F.struct("available_time", "venue_trade_id")).alias("x")).select("symbol", "x.venue_trade_id", F.col("x.price").cast("double").alias("price"))
ORACLE["b06_visible_latest"] = """SELECT event_type AS symbol, arg_max(event_id, ts) AS venue_trade_id, arg_max(value, ts) AS price FROM events
    WHERE ts + INTERVAL 61 SECOND <= TIMESTAMP '2024-01-15' GROUP BY 1"""
QUERIES["f03_latest_per_key"] = lambda s, d: points(s, d, "click").groupBy("key").agg(F.max_by("event_id", F.struct("event_time", "event_id")).alias("event_id"), F.max("event_time").alias("event_time"))
ORACLE["f03_latest_per_key"] = "SELECT user_id AS key, arg_max(event_id, ts) AS event_id, max(ts) AS event_time FROM events WHERE event_type = 'click' GROUP BY 1"
QUERIES["f04_latest_event"] = lambda s, d: E.latest(events(s, d).select(F.col("user_id").alias("key"), F.date_trunc("day", "ts").alias("day"), "event_id", F.col("ts").alias("event_time"), "event_type"), ["key", "day"])
ORACLE["f04_latest_event"] = """SELECT user_id AS key, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS event_time, arg_max(event_type, (ts, event_id)) AS event_type
    FROM events GROUP BY 1, 2"""
QUERIES["b08_visible_events"] = lambda s, d: points(s, d, "view").withColumn("available_time", F.col("event_time") + F.expr("interval 90 seconds")).where("available_time <= timestamp '2024-01-15 00:00:00'").select("key", "event_id", "available_time")
ORACLE["b08_visible_events"] = "SELECT user_id AS key, event_id, ts + INTERVAL 90 SECOND AS available_time FROM events WHERE event_type = 'view' AND ts + INTERVAL 90 SECOND <= TIMESTAMP '2024-01-15'"
