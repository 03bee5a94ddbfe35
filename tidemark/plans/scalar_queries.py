"""Queries of the scalar functions over columns of the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as H
from tidemark.operators import features as X
from tidemark.operators import splits as P
from tidemark.plans.inputs import RUN, bars, bars_sql, r, runs_sql, table

QUERIES: dict = {}
ORACLE: dict = {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def orders(s, d):
    return table(s, d, "orders")


def texts(s, d):
    """Number texts of several shapes."""
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat_ws(".", k.cast("string"), F.lit("250"))).when(k % 4 == 1, F.concat(F.lit("-"), k.cast("string"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit("e3"))).otherwise(F.concat(F.lit("0"), k.cast("string")))
    return orders(s, d).select("o_orderkey", text.alias("text"))


TEXT = "t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey || '.250' WHEN 1 THEN '-' || o_orderkey WHEN 2 THEN o_orderkey || 'e3' ELSE '0' || o_orderkey END AS text FROM orders)"
add("h01_exact_decimal", lambda s, d: texts(s, d).select("o_orderkey", H.exact_decimal(F.col("text")).alias("x")).select("o_orderkey", F.col("x").cast("double").alias("value"), H.decimal_text(F.col("x")).alias("shown")), f"""WITH {TEXT}
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN CAST(text AS DOUBLE) END AS value, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey || '.25'
    WHEN 1 THEN text END AS shown FROM t""")
add("h02_quantized_return", lambda s, d: orders(s, d).select("o_orderkey", H.quantized_return(F.col("o_totalprice"), F.col("o_custkey") * 10 + 7, 6).alias("ret")), "SELECT o_orderkey, round_even(CAST(o_totalprice AS DOUBLE) / (o_custkey * 10 + 7) - 1, 6) AS ret FROM orders")
add("h03_canonical_json", lambda s, d: orders(s, d).select("o_orderkey", H.canonical_json({"status": F.col("o_orderstatus"), "key": F.col("o_orderkey")}).alias("json")), "SELECT o_orderkey, '{\"key\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}' AS json FROM orders")
add("h04_content_hash", lambda s, d: orders(s, d).select("o_orderkey", H.content_hash({"status": F.col("o_orderstatus"), "key": F.col("o_orderkey")}).alias("hash")), "SELECT o_orderkey, sha256('{\"key\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}') AS hash FROM orders")
add("h05_semver", lambda s, d: orders(s, d).select("o_orderkey", H.semver(F.concat_ws(".", (F.col("o_orderkey") % 3).cast("string"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise("7"))).alias("v")).select("o_orderkey", "v.major", "v.minor", "v.patch"), """SELECT o_orderkey,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 3 END AS major, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS minor, CASE
    WHEN o_orderkey % 5 <> 0 THEN 7 END AS patch FROM orders""")
add("h06_utc_time", lambda s, d: table(s, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")), "SELECT event_id, epoch_us(ts) AS us FROM events")
add("h07_strict_parse", lambda s, d: texts(s, d).select("o_orderkey", H.strict_int(F.col("text")).alias("as_int"), H.strict_bool(F.when(F.col("o_orderkey") % 2 == 0, "true").when(F.col("o_orderkey") % 3 == 0, "False").otherwise("yes")).cast("string").alias("as_bool")), f"""WITH {TEXT}
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN CAST(text AS BIGINT) END AS as_int, CASE WHEN o_orderkey % 2 = 0 THEN 'true'
    WHEN o_orderkey % 3 = 0 THEN 'false' END AS as_bool FROM t""")
add("h08_tick_scaling", lambda s, d: orders(s, d).select("o_orderkey", F.timestamp_micros(H.scaled(F.col("o_orderkey") * 1_000_000, 1000)).alias("t")), "SELECT o_orderkey, make_timestamp(o_orderkey * 1000000000) AS t FROM orders")
add("a03_time_unit", lambda s, d: orders(s, d).select("o_orderkey", H.ticks_to_time(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") * 1_000).otherwise(F.col("o_orderkey") * 1_000_000), F.when(F.col("o_orderkey") % 2 == 0, "2024-12-31").otherwise("2025-01-01").cast("date")).alias("t")), "SELECT o_orderkey, make_timestamp(o_orderkey * 1000000) AS t FROM orders")
add("h09_midnight", lambda s, d: table(s, d, "events").select("event_id", H.midnight(F.col("ts").cast("timestamp")).alias("day"), F.size(H.day_list(F.col("ts").cast("timestamp"), F.lit("2024-02-01").cast("timestamp"))).cast("long").alias("days_left")), """SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') + 1 AS days_left
    FROM events""")


def moved(s, d):
    w = Window.partitionBy("symbol", "run_id").orderBy("interval_start")
    b = X.with_returns(bars(s, d)).withColumn("tr", X.true_range())
    h, l = F.col("high").cast("double"), F.col("low").cast("double")
    return b.withColumn("dm", H.directional(h, l, F.lag(h).over(w), F.lag(l).over(w))).select("symbol", "interval_start", r(F.col("tr")).alias("tr"), r(F.col("dm.plus")).alias("plus"), r(F.col("dm.minus")).alias("minus"))


add("h10_true_range", moved, f"""WITH {runs_sql()},
    m AS (SELECT *, high - lag(high) OVER {RUN} AS up, lag(low) OVER {RUN} - low AS down, lag(close) OVER {RUN} AS c0 FROM b)
    SELECT symbol, interval_start, CASE WHEN c0 IS NOT NULL THEN round(greatest(high - low, abs(high - c0), abs(low - c0)), 6) END AS tr, round(CASE
    WHEN up > down AND up > 0 THEN up ELSE 0 END, 6) AS plus, round(CASE WHEN down > up AND down > 0 THEN down ELSE 0 END, 6) AS minus FROM m""")
add("h11_log_ratio", lambda s, d: orders(s, d).select("o_orderkey", r(F.log(F.col("o_totalprice") / (F.col("o_custkey") + 1))).alias("x")), "SELECT o_orderkey, round(ln(o_totalprice / (o_custkey + 1)), 6) AS x FROM orders")
add("h12_pi", lambda s, d: orders(s, d).select("o_orderkey", r(F.pi() * F.col("o_custkey"), 4).alias("x")), "SELECT o_orderkey, round(pi() * o_custkey, 4) AS x FROM orders")
add("h13_id_set", lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(H.id_set(F.collect_list("l_suppkey")).alias("ids")).select("l_orderkey", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")), "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS ids FROM lineitem GROUP BY 1")


def methods(s, d):
    text = H.method_text("quantile", {"window": F.col("o_custkey"), "cut": F.col("o_orderkey") % 7})
    return orders(s, d).select("o_orderkey", text.alias("text")).select("o_orderkey", "text", H.method_params(F.col("text"), "cut long, window long").alias("p")).select("o_orderkey", "text", F.col("p.params.cut").alias("cut"), F.col("p.params.window").alias("window"))


add("h14_method_text", methods, """SELECT o_orderkey, '{\"method\":\"quantile\",\"params\":{\"cut\":' || (o_orderkey % 7) || ',\"window\":' || o_custkey || '}}' AS text, o_orderkey % 7 AS cut, o_custkey AS window
    FROM orders""")


def spans(s, d):
    t = F.col("o_orderdate").cast("timestamp")
    later = [t + F.expr(f"interval {k} days") for k in (1, 5)]
    x = H.interval_array([(later[1], F.timestamp_micros(F.unix_micros(later[1]) + (F.col("o_custkey") % 3) * 86_400_000_000)), (t, later[0])])
    return orders(s, d).select("o_orderkey", F.explode(x).alias("x")).select("o_orderkey", "x.start", "x.end")


add("h15_interval_structs", spans, """SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS start, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY AS \"end\"
    FROM orders UNION ALL
    SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 5 DAY, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 5 DAY + (o_custkey % 3) * INTERVAL 1 DAY
    FROM orders WHERE o_custkey % 3 > 0""")
add("h16_map_lookup", lambda s, d: orders(s, d).select("o_orderkey", H.lookup({"F": "filled", "O": "open"}, F.col("o_orderstatus"), "other").alias("name")), "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'other' END AS name FROM orders")
add("h17_round_trip_cost", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", r(H.round_trip_cost(F.col("l_tax"), F.col("l_discount"), F.col("l_quantity"))).alias("cost")), "SELECT l_orderkey, l_linenumber, round(2 * (l_tax + l_discount) * l_quantity, 6) AS cost FROM lineitem")
add("h19_observable_time", lambda s, d: orders(s, d).select("o_orderkey", H.observable_time(F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderdate").cast("timestamp") + F.expr("interval 1 hour")), F.col("o_orderdate").cast("timestamp")).alias("t")), """SELECT o_orderkey,
    CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 HOUR ELSE CAST(o_orderdate AS TIMESTAMP) END AS t FROM orders""")
add("h20_gap_seconds", lambda s, d: table(s, d, "events").select("event_id", r(H.gap_seconds(F.col("ts").cast("timestamp"), F.lit("2024-01-01").cast("timestamp"))).alias("gap")), "SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0, 6) AS gap FROM events")
add("h21_sub_second_bucket", lambda s, d: table(s, d, "events").groupBy(H.bucket_number(F.col("ts").cast("timestamp"), 250_000).alias("bucket")).agg(F.count("*").alias("n")), "SELECT CAST(floor(epoch_us(ts) / 250000.0) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1")
add("h22_decision_grid", lambda s, d: P.decision_grid(bars(s, d), 6 * 3600, 86_400, 4 * 3600), f"""WITH {bars_sql()},
    e AS (SELECT symbol, min(interval_start) AS a, max(interval_end) AS z FROM bars GROUP BY 1)
    SELECT symbol, unnest(generate_series(a + INTERVAL 1 DAY, z - INTERVAL 4 HOUR, INTERVAL 6 HOUR)) AS decision_time FROM e""")
