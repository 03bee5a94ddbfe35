"""Queries of targets, sizing and routing over 4-hour bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as X
from tidemark.operators import states as S
from tidemark.operators import targets as G
from tidemark.plans.inputs import bars, full_sql, r, runs_sql, table

QUERIES: dict = {}
ORACLE: dict = {}
M = 240


def add(name, query, sql):
    QUERIES[name] = query
    ORACLE[name] = sql


def base(s, d):
    return X.with_returns(bars(s, d, M))


def out(df, *extra):
    return df.select("time", "instrument", r(F.col("target")).alias("target"), *extra)


B = runs_sql(M)
RUN = "(PARTITION BY symbol, run_id ORDER BY interval_start)"
MOM = f"""mom AS (SELECT interval_end AS time, symbol AS instrument, coalesce(sign(CASE
    WHEN count(log_return) OVER w = 6 THEN sum(log_return) OVER w END), 0) * 1.0 / count(*) OVER (PARTITION BY interval_end) AS target FROM b
    WINDOW w AS (PARTITION BY symbol, run_id ORDER BY interval_start ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"""
add("e39_time_series_momentum", lambda s, d: out(G.time_series_momentum(base(s, d), 6)), f"WITH {B}, {MOM} SELECT time, instrument, round(target, 6) AS target FROM mom")
TR = f"tr AS (SELECT interval_end AS time, symbol AS instrument, close / lag(close, 6) OVER {RUN} - 1 AS trail FROM b)"
XS = f"""{TR}, k AS (SELECT *, count(*) OVER (PARTITION BY time) AS m, row_number() OVER (PARTITION BY time
    ORDER BY trail DESC, instrument) AS best, row_number() OVER (PARTITION BY time ORDER BY trail, instrument) AS worst FROM tr
    WHERE trail IS NOT NULL), xs AS (SELECT time, instrument, CASE WHEN least(2, floor(m / 2)) = 0 THEN 0
    WHEN best <= least(2, floor(m / 2)) THEN 1.0 / (2 * least(2, floor(m / 2)))
    WHEN worst <= least(2, floor(m / 2)) THEN -1.0 / (2 * least(2, floor(m / 2))) ELSE 0 END AS target FROM k)"""
add("e40_cross_sectional_momentum", lambda s, d: out(G.cross_sectional_momentum(base(s, d), 6, 2)), f"WITH {B}, {XS} SELECT time, instrument, round(target, 6) AS target FROM xs")
add("e41_dual_momentum", lambda s, d: out(G.dual_momentum(base(s, d), 6, 5)), f"""WITH {B}, {TR},
    x AS (SELECT *, max(trail) OVER (PARTITION BY time) AS best, count(trail) OVER (PARTITION BY time) AS n FROM tr),
    y AS (SELECT *, count(*) FILTER (WHERE trail = best) OVER (PARTITION BY time) AS nb FROM x) SELECT time, instrument, CASE
    WHEN n = 5 AND nb = 1 AND trail = best AND best > 0 THEN 1.0 ELSE 0.0 END AS target FROM y""")
LATCH = """SELECT interval_end AS time, symbol AS instrument, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY symbol, run_id
    ORDER BY interval_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS target FROM m"""
DON = f"""m AS (SELECT *, CASE WHEN i > 6 AND close < lo THEN 0.0 WHEN i > 6 AND close > hi THEN 1.0 END AS mark
    FROM (SELECT *, row_number() OVER {RUN} AS i, max(high) OVER (PARTITION BY symbol, run_id
    ORDER BY interval_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS hi, min(low) OVER (PARTITION BY symbol, run_id
    ORDER BY interval_start ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS lo FROM b))"""
add("e42_donchian_breakout", lambda s, d: out(G.donchian_breakout(bars(s, d, M), 4, 6, M)), f"WITH {B}, {DON} {LATCH}")
Z = f"""m AS (SELECT *, CASE WHEN z IS NULL OR z > -0.2 THEN 0.0 WHEN z < -1 THEN 1.0 END AS mark
    FROM (SELECT *, (close - {full_sql('avg', 'close', 6)}) / nullif({full_sql('stddev_pop', 'close', 6)}, 0) AS z FROM b))"""
add("e43_zscore_reversion", lambda s, d: out(G.zscore_reversion(bars(s, d, M), 6, 1.0, 0.2, M)), f"WITH {B}, {Z} {LATCH}")


def states(s, d):
    return S.trend_range(base(s, d), "log_return", 5, 0.5).select(F.col("symbol").alias("instrument"), "available_time", "state")


STATES = """st AS (SELECT symbol AS instrument, interval_start, available_time, CASE WHEN k < 5 THEN NULL WHEN p = 0 THEN 'range'
    WHEN abs(t) / p >= 0.5 THEN CASE WHEN t > 0 THEN 'up' ELSE 'down' END ELSE 'range' END AS state
    FROM (SELECT *, count(log_return) OVER w AS k, sum(log_return) OVER w AS t, sum(abs(log_return)) OVER w AS p FROM b
    WINDOW w AS (PARTITION BY symbol ORDER BY interval_start ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)))"""
add("e44_conditioned", lambda s, d: out(G.conditioned(G.time_series_momentum(base(s, d), 6), states(s, d), ["up", "range"])), f"""WITH {B}, {MOM}, {STATES}
    SELECT m.time, m.instrument, round(CASE WHEN st.state IN ('up', 'range') THEN target ELSE 0 END, 6) AS target FROM mom m ASOF LEFT
    JOIN st ON m.instrument = st.instrument AND m.time >= st.available_time""")
add("e44_ensemble", lambda s, d: out(G.ensemble(G.time_series_momentum(base(s, d), 6), G.cross_sectional_momentum(base(s, d), 6, 2))), f"""WITH {B}, {MOM}, {XS}
    SELECT time, instrument, round(sum(target) / 2, 6) AS target FROM (SELECT * FROM mom UNION ALL SELECT * FROM xs) GROUP BY time, instrument""")
add("e44_negated_spot", lambda s, d: out(G.negated(G.time_series_momentum(base(s, d), 6), spot=True), "problem"), f"""WITH {B}, {MOM}
    SELECT time, instrument, CASE WHEN target <= 0 THEN round(-target, 6) END AS target, CASE
    WHEN target > 0 THEN 'negative target for spot' END AS problem FROM mom""")


def vols(s, d):
    return base(s, d).withColumn("vol", X.realized_volatility(5)).select(F.col("symbol").alias("instrument"), "available_time", "vol")


VOLS = f"vo AS (SELECT symbol AS instrument, available_time, sqrt({full_sql('sum', 'log_return * log_return', 5)}) AS vol FROM b)"
add(
    "e45_volatility_target", lambda s, d: out(G.volatility_target(G.time_series_momentum(base(s, d), 6), vols(s, d), 1.5, 1.2, 0.15, 0.5), "rules"),
    f"""WITH {B}, {MOM}, {VOLS}, j AS (SELECT m.*, vo.vol FROM mom m ASOF LEFT JOIN vo ON m.instrument = vo.instrument AND m.time >= vo.available_time),
    x AS (SELECT *, target * CASE WHEN vol > 0 THEN least(1.5 / vol, 1.2) ELSE 0 END AS x, vol > 0 AS has
    FROM j),
    y AS (SELECT *, greatest(least(x, 0.15), -0.15) AS y FROM x), g AS (SELECT *, sum(abs(y)) OVER (PARTITION BY time) AS gross FROM y)
    SELECT time, instrument, round(y * CASE WHEN gross > 0.5 THEN 0.5 / gross ELSE 1 END, 6) AS target, concat_ws(',', CASE
    WHEN target <> 0 AND NOT coalesce(has, false) THEN 'no_volatility' END, CASE WHEN target <> 0 AND has AND 1.5 / vol > 1.2 THEN 'leverage' END,
    CASE WHEN abs(x) > 0.15 THEN 'position' END, CASE WHEN target <> 0 AND gross > 0.5 THEN 'gross' END) AS rules FROM g""",
)


def equity(s, d):
    return base(s, d).where("symbol = 'view'").select(F.col("available_time").alias("time"), F.col("close").cast("double").alias("equity"))


add("e46_drawdown_control", lambda s, d: out(G.drawdown_control(G.time_series_momentum(base(s, d), 6), equity(s, d), 0.5, 0.25)), f"""WITH {B}, {MOM},
    e AS (SELECT available_time, 1 - close / max(close) OVER (ORDER BY available_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 0.5 AS deep
    FROM b WHERE symbol = 'view') SELECT m.time, m.instrument, round(target * CASE WHEN coalesce(deep, false) THEN 0.25 ELSE 1 END, 6) AS target
    FROM mom m ASOF LEFT JOIN e ON m.time >= e.available_time""")
TABLE, FALLBACK = {"up": {"trend": 0.8, "cash": 0.2}, "range": {"reversion": 1.0}}, {"cash": 1.0}


def routed(s, d):
    return G.route(states(s, d).select(F.col("instrument").alias("key"), F.col("available_time").alias("time"), "state"), TABLE, FALLBACK)


ROUTED = f"""{STATES},
    w(route, strategy, weight) AS (VALUES ('up', 'trend', 0.8::DOUBLE), ('up', 'cash', 0.2), ('up', 'reversion', 0.0), ('range', 'trend', 0.0), ('range', 'cash', 0.0), ('range', 'reversion', 1.0), ('', 'trend', 0.0), ('', 'cash', 1.0), ('', 'reversion', 0.0)),
    ro AS (SELECT instrument AS key, available_time AS time, strategy, weight FROM st JOIN w ON w.route = CASE
    WHEN state IN ('up', 'range') THEN state ELSE '' END)"""
add("c37_route", routed, f"WITH {B}, {ROUTED} SELECT * FROM ro")
add("e47_routing_cost", lambda s, d: G.routing_cost(routed(s, d), 0.001).select("key", "time", r(F.col("turnover")).alias("turnover"), r(F.col("cost")).alias("cost")), f"""WITH {B}, {ROUTED},
    st2 AS (SELECT *, abs(weight - coalesce(lag(weight) OVER (PARTITION BY key, strategy ORDER BY time), 0)) AS step FROM ro)
    SELECT key, time, round(sum(step), 6) AS turnover, round(sum(step) * 0.001, 6) AS cost FROM st2 GROUP BY key, time""")


def positions(s, d):
    a = G.time_series_momentum(base(s, d), 6).withColumn("strategy", F.lit("trend"))
    b = G.zscore_reversion(bars(s, d, M), 6, 1.0, 0.2, M).withColumn("strategy", F.lit("reversion"))
    return a.unionByName(b).withColumnRenamed("time", "at")


add(
    "c15_combine_targets", lambda s, d: out(G.combine(routed(s, d).withColumnRenamed("key", "instrument"), positions(s, d)), "latest_input"),
    f"""WITH {B}, {MOM}, {Z}, zz AS ({LATCH}), {ROUTED}, po AS (SELECT 'trend' AS strategy, instrument, time AS pat, target FROM mom UNION ALL
    SELECT 'reversion', instrument, time, target FROM zz),
    j AS (SELECT r.time, r.key AS instrument, r.weight, po.target, po.pat FROM ro r ASOF
    JOIN po ON r.strategy = po.strategy AND r.key = po.instrument AND r.time >= po.pat)
    SELECT time, instrument, round(sum(weight * target), 6) AS target, max(pat) AS latest_input FROM j GROUP BY time, instrument""",
)


def late(s, d):
    """Decisions every bar of an hour, to be executed on 4-hour bars."""
    return bars(s, d, 60).select(F.col("symbol").alias("instrument"), (F.col("interval_end") + F.expr("interval 5 minutes")).alias("time"), F.col("close").cast("double").alias("target"))


def late_sql() -> str:
    hourly = runs_sql(60).replace("bars0", "hb0").replace(" bars ", " hb ").replace("FROM bars", "FROM hb").replace("runs0", "hr0").replace("runs AS", "hr AS").replace("FROM runs", "FROM hr").replace("\nb AS", "\nh AS").replace("trades AS (", "htrades AS (").replace("FROM trades", "FROM htrades")
    return f"""{B}, {hourly}, la AS (SELECT symbol AS instrument, interval_end + INTERVAL 5 MINUTE AS time, close AS target FROM h),
    ex AS (SELECT la.*, b.interval_start AS exec_start FROM la ASOF LEFT JOIN b ON la.instrument = b.symbol AND la.time <= b.interval_start)"""


add("c17_execution_bar", lambda s, d: out(G.execution_bars(late(s, d), bars(s, d, M)), "exec_start"), f"WITH {late_sql()} SELECT time, instrument, round(target, 6) AS target, exec_start FROM ex")
add("c18_supersession", lambda s, d: out(G.supersede(G.execution_bars(late(s, d), bars(s, d, M))), "exec_start", "n_superseded"), f"""WITH {late_sql()},
    n AS (SELECT *, row_number() OVER (PARTITION BY instrument, exec_start
    ORDER BY time DESC) AS rn, count(*) OVER (PARTITION BY instrument, exec_start) - 1 AS n_superseded FROM ex WHERE exec_start IS NOT NULL)
    SELECT time, instrument, round(target, 6) AS target, exec_start, n_superseded FROM n WHERE rn = 1""")
add("e48_bar_signals", lambda s, d: G.bar_signals(base(s, d), [3, 5]).select("instrument", "available_time", "signal", r(F.col("value")).alias("value")), f"""WITH {B},
    v AS (SELECT *, sqrt({full_sql('sum', 'log_return * log_return', 3)}) AS v3, sqrt({full_sql('sum', 'log_return * log_return', 5)}) AS v5 FROM b),
    l AS (SELECT symbol AS instrument, available_time, 'log_return' AS signal, log_return AS value FROM v UNION ALL
    SELECT symbol, available_time, 'close', close FROM v UNION ALL SELECT symbol, available_time, 'vol_3', v3 FROM v UNION ALL
    SELECT symbol, available_time, 'vol_5', v5 FROM v) SELECT instrument, available_time, signal, round(value, 6) AS value FROM l
    WHERE value IS NOT NULL""")
add("b09_visible_signals", lambda s, d: G.bar_signals(base(s, d), [3]).where("available_time <= timestamp '2024-01-10 12:00:00' and signal = 'vol_3'").select("instrument", "available_time", r(F.col("value")).alias("value")), f"""WITH {B},
    v AS (SELECT symbol AS instrument, available_time, sqrt({full_sql('sum', 'log_return * log_return', 3)}) AS value FROM b)
    SELECT instrument, available_time, round(value, 6) AS value FROM v WHERE value IS NOT NULL AND available_time <= TIMESTAMP '2024-01-10 12:00:00'""")
add("c41_parameter_grid", lambda s, d: G.parameter_grid(table(s, d, "part").select(F.col("p_brand").alias("operator")).distinct(), table(s, d, "region").select(F.col("r_name").alias("strategy")), {"window": [5, 10], "cut": [0.5, 1.0, 1.5]}), """SELECT operator, strategy, w AS window, c AS cut
    FROM (SELECT DISTINCT p_brand AS operator FROM part), (SELECT r_name AS strategy
    FROM region), (VALUES (5.0::DOUBLE), (10.0::DOUBLE)) a(w), (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (1.5::DOUBLE)) b(c)""")
