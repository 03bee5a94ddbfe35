"""Streaming queries: each runs a stream over the events table to its end and returns what it wrote.

Windows are final up to the largest time less the delay. The stateful jobs read their input in four micro-batches, of
which each holds rows that are earlier than the latest of the batch before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.session import shared_folder
from tidemark.plans.inputs import bars, r, runs_sql, table
from tidemark.operators import features as X
from tidemark.operators import states as S
from tidemark.streaming import jobs as J

QUERIES: dict = {}
ORACLE: dict = {}
END = "(SELECT max(ts) FROM events)"


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def stream(s, d):
    schema = table(s, d, "events").schema
    e = s.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    return e.withColumn("event_time", F.col("ts").cast("timestamp"))


def run(df):
    return J.run_available(df, f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}")


def trades(s, d):
    return stream(s, d).select(F.col("event_type").alias("symbol"), F.col("event_id").alias("venue_trade_id"), F.col("event_id").alias("order_id"), "event_time", F.col("value").alias("price"), (F.get_json_object("props", "$.k").cast("double") + 1).alias("quantity"))


def points(s, d, kind):
    return stream(s, d).where(F.col("event_type") == kind).select(F.col("user_id").alias("key"), "event_id", "event_time")


add(
    "i01_stream_bars", lambda s, d: run(J.bars(trades(s, d), 60, "10 minutes")).select("symbol", "interval_start", *[r(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")], "trade_count"),
    f"""WITH b AS (SELECT event_type AS symbol, time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '1970-01-01') AS interval_start, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1) AS volume, count(*) AS trade_count
    FROM events GROUP BY 1, 2)
    SELECT * FROM b WHERE interval_start + INTERVAL 60 MINUTE <= {END} - INTERVAL 10 MINUTE""",
)


def checkpoints(s, d):
    e = table(s, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("event_time"))
    earlier = e.where("event_time <= timestamp '2024-01-15' and event_id % 90 <> 1")
    later = e.where("event_id % 70 <> 1")
    return J.unconfirmed(earlier, later, "2024-01-15").select("event_id", "problem")


add("i02_late_data_policy", checkpoints, """SELECT event_id, CASE WHEN event_id % 90 = 1 THEN 'future_confirmed' ELSE 'retracted' END AS problem
    FROM events WHERE ts <= TIMESTAMP '2024-01-15' AND (event_id % 90 = 1) <> (event_id % 70 = 1)""")
add("i03_stream_dedupe", lambda s, d: run(J.deduplicated(stream(s, d).select((F.col("user_id") * 10 + F.length("event_type")).alias("revision_id"), "event_time"), "revision_id", "event_time", "40 days")).select("revision_id"), "SELECT DISTINCT user_id * 10 + length(event_type) AS revision_id FROM events")
#: Rows of a file of a micro-batch, at least.
ROWS = 250_000


def batch_of(s, df, name, delay_s):
    """A table as a stream of four micro-batches, cut at equal times; some rows come a batch late, within the delay of what was seen."""
    path = f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"
    t = F.unix_micros("event_time")
    ends = df.agg(F.min(t).alias("a"), F.max(t).alias("z")).first()
    files = 1
    if ends.a is None:
        df.write.parquet(path)
    else:
        width = (ends.z - ends.a) // 4 + 1
        part = F.floor((t - ends.a) / F.lit(width))
        tail = part < F.floor((t - ends.a + F.lit(delay_s * 1_000_000)) / F.lit(width))
        df = df.withColumn("_part", F.least(part + F.when(tail & (F.col("order_id") % 3 == 0), 1).otherwise(0), F.lit(3)))
        sizes = {r["_part"]: r["count"] for r in df.groupBy("_part").count().collect()}  # of times and ids only
        files = max(1, min(sizes.get(k, 0) for k in range(4)) // ROWS)  # with so many rows, dealt in turn, no file is empty
        for k in range(4):  # files are read in the order in which they were written
            part = df.where(F.col("_part") == k).drop("_part")
            (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(path)
    return s.readStream.schema(df.drop("_part").schema).option("maxFilesPerTrigger", files).parquet(path)


def in_batches(s, d):
    e = table(s, d, "events").withColumn("event_time", F.col("ts").cast("timestamp"))
    e = e.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("order_id"), "event_time", F.col("value").alias("price"), (F.get_json_object("props", "$.k").cast("double") + 1).alias("quantity"))
    return batch_of(s, e, "trades", 6 * 3600)


def separated(s, d):
    """The trades in four micro-batches, some of them a batch late by up to six hours, dealt to what is on time for an hour's delay and what is not."""
    path = f"{shared_folder(s)}/separated-{uuid.uuid4().hex}"
    rows = in_batches(s, d)
    J.separate_late(rows, path, 60, "1 hour")
    return path, rows.schema


def late(s, d):
    path, schema = separated(s, d)
    return J.dealt_rows(s, path, "late", schema).select("symbol", F.col("order_id").alias("venue_trade_id"), F.window("event_time", "60 minutes")["start"].alias("interval_start"))


def bars_on_time(s, d):
    path, schema = separated(s, d)
    on_time = J.dealt_rows(s, path, "on_time", schema, streaming=True).withColumn("venue_trade_id", F.col("order_id"))
    return run(J.bars(on_time, 60, "1 hour")).select("symbol", "interval_start", *[r(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")], "trade_count")


BATCHES = """ends AS (SELECT epoch_us(min(ts)) AS a, (epoch_us(max(ts)) - epoch_us(min(ts))) // 4 + 1 AS width FROM events),
    parts AS (SELECT e.*, (epoch_us(ts) - a) // width AS part, (epoch_us(ts) - a + 21600000000) // width AS next_part FROM events e, ends),
    dealt AS (SELECT *, least(part + CASE WHEN part < next_part AND event_id % 3 = 0 THEN 1 ELSE 0 END, 3) AS batch, time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '1970-01-01') AS interval_start FROM parts),
    marks AS (SELECT b.batch, max(epoch_us(d.ts)) // 1000 * 1000 - 3600000000 AS mark FROM (SELECT DISTINCT batch FROM dealt) b JOIN dealt d ON d.batch < b.batch GROUP BY 1),
    told AS (SELECT d.*, coalesce(epoch_us(interval_start + INTERVAL 60 MINUTE) <= mark, false) AS late FROM dealt d LEFT JOIN marks USING (batch))"""
add("i01_late_rows", late, f"WITH {BATCHES} SELECT event_type AS symbol, event_id AS venue_trade_id, interval_start FROM told WHERE late")
add("i01_bars_on_time", bars_on_time, f"""WITH {BATCHES}, b AS (SELECT event_type AS symbol, interval_start, round(arg_min(value, ts), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, ts), 6) AS close,
    round(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1), 6) AS volume, count(*) AS trade_count FROM told WHERE NOT late GROUP BY 1, 2)
    SELECT * FROM b WHERE epoch_us(interval_start + INTERVAL 60 MINUTE) <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 FROM told WHERE NOT late)""")


DUE = "({0} <= date_trunc('millisecond', (SELECT max({0}) FROM {1})) - INTERVAL 6 HOUR)"
add("i04_stream_volume_bars", lambda s, d: run(J.volume_bars(in_batches(s, d), 500.0, "6 hours")), """WITH RECURSIVE t AS (SELECT event_type AS symbol, ts, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS q, row_number() OVER (PARTITION BY event_type
    ORDER BY ts, event_id) AS i FROM events), w AS (
  SELECT symbol, i, q AS held, 0 AS bar_no, q >= 500 AS closes, ts, price FROM t WHERE i = 1
  UNION ALL SELECT t.symbol, t.i, CASE WHEN w.closes THEN t.q ELSE w.held + t.q END, w.bar_no + CASE WHEN w.closes THEN 1 ELSE 0 END, CASE
    WHEN w.closes THEN t.q ELSE w.held + t.q END >= 500, t.ts, t.price FROM w
    JOIN t ON t.symbol = w.symbol AND t.i = w.i + 1)
SELECT symbol, CAST(bar_no AS INTEGER) AS bar_no, max(ts) AS last_time, arg_min(price, i) AS open, max(price) AS high, min(price) AS low, arg_max(price, i) AS close, max(held) AS volume, CAST(count(*) AS INTEGER) AS trade_count
    FROM w GROUP BY symbol, bar_no HAVING bool_or(closes) AND """ + DUE.format("max(ts)", "events").replace("max(max(ts))", "max(ts)"))
add("i05_stream_sequences", lambda s, d: J.latest_sequences(run(J.sequences(points(s, d, "view"), points(s, d, "purchase"), 43_200, "1 hour"))), """SELECT p.user_id AS key, p.event_id, p.ts AS event_time, arg_max(a.event_id, a.ts) AS first_id
    FROM events p JOIN events a ON a.event_type = 'view' AND a.user_id = p.user_id AND a.ts < p.ts AND a.ts >= p.ts - INTERVAL 43200 SECOND
    WHERE p.event_type = 'purchase' GROUP BY 1, 2, 3""")
add(
    "i06_stream_absences", lambda s, d: run(J.absences(points(s, d, "view"), points(s, d, "purchase"), 43_200, "1 hour")),
    """SELECT a.user_id AS key, a.event_id, a.ts AS event_time FROM events a WHERE a.event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events p
    WHERE p.event_type = 'purchase' AND p.user_id = a.user_id AND p.ts BETWEEN a.ts AND a.ts + INTERVAL 43200 SECOND)
    AND date_trunc('millisecond', a.ts) + INTERVAL 43200 SECOND < (SELECT least(max(ts) FILTER (WHERE event_type = 'view'), max(ts) FILTER (WHERE event_type = 'purchase'))
    FROM events) - INTERVAL 1 HOUR""",
)
add("i07_sliding_counts", lambda s, d: run(J.sliding_counts(points(s, d, "view"), "12 hours", "4 hours", "1 hour", 2)), f"""WITH w AS (SELECT user_id AS key, unnest(generate_series(time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 8 HOUR, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01'), INTERVAL 4 HOUR)) AS window_start
    FROM events WHERE event_type = 'view')
SELECT key, window_start, window_start + INTERVAL 12 HOUR AS window_end, count(*) AS n FROM w GROUP BY 1, 2
    HAVING count(*) >= 2 AND window_start + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events WHERE event_type = 'view') - INTERVAL 1 HOUR""")


def spans(s, d):
    return stream(s, d).where("event_type = 'view'").select(F.col("user_id").alias("key"), F.date_trunc("second", "event_time").alias("start"), ((F.col("event_id") % 24 + 1) * 3_600_000_000).alias("length_us"))


add("i08_session_clusters", lambda s, d: run(J.session_clusters(spans(s, d), "1 hour")), f"""WITH s AS (SELECT user_id AS key, CAST(date_trunc('second', ts) AS TIMESTAMP) AS start, CAST(date_trunc('second', ts) AS TIMESTAMP) + (event_id % 24 + 1) * INTERVAL 1 HOUR AS e, event_id
    FROM events WHERE event_type = 'view'), f AS (SELECT *, CASE WHEN start >= max(e) OVER (PARTITION BY key
    ORDER BY start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh
    FROM s),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY start, event_id) AS i
    FROM f)
SELECT key, min(start) AS cluster_start, max(e) AS cluster_end, count(*) AS n_spans FROM g GROUP BY key, i HAVING max(e) <= (SELECT max(start)
    FROM s) - INTERVAL 1 HOUR""")


def labels(s, d):
    b = S.trend_range(X.with_returns(bars(s, d)), "log_return", 5, 0.5)
    return batch_of(s, b.select("symbol", F.col("interval_start").alias("event_time"), F.unix_micros("interval_start").alias("order_id"), F.col("state").alias("label")), "labels", 6 * 3600)


add("i09_stream_state_switch", lambda s, d: run(J.state_switches(labels(s, d), "6 hours")), f"""WITH {runs_sql()}, s AS (SELECT symbol, interval_start,
    CASE WHEN k < 5 THEN NULL WHEN p = 0 THEN 'range' WHEN abs(t) / p >= 0.5 THEN CASE WHEN t > 0 THEN 'up' ELSE 'down' END ELSE 'range' END AS state
    FROM (SELECT *, count(log_return) OVER w AS k, sum(log_return) OVER w AS t, sum(abs(log_return)) OVER w AS p FROM b
    WINDOW w AS (PARTITION BY symbol ORDER BY interval_start ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))),
    p AS (SELECT *, lag(state) OVER (PARTITION BY symbol ORDER BY interval_start) AS f
    FROM s)
SELECT symbol, interval_start AS event_time, f AS from_state, state AS to_state FROM p WHERE f IS NOT NULL AND state IS NOT NULL AND f <> state AND """ + DUE.format("interval_start", "b"))


def closes(s, d, name):
    b = bars(s, d)
    return batch_of(s, b.select("symbol", F.col("interval_start").alias("event_time"), F.unix_micros("interval_start").alias("order_id"), F.col("close").cast("double").alias(name)), name, 6 * 3600)


add("i10_drawdown_alerts", lambda s, d: run(J.drawdown_alerts(closes(s, d, "equity"), 0.9, "6 hours")), f"""WITH {runs_sql()},
    p AS (SELECT symbol, interval_start, close, max(close) OVER (PARTITION BY symbol
    ORDER BY interval_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM b), q AS (SELECT *, 1 - close / peak > 0.9 AS deep
    FROM p), z AS (SELECT *, coalesce(lag(deep) OVER (PARTITION BY symbol ORDER BY interval_start), false) AS before
    FROM q)
SELECT symbol, interval_start AS event_time, close AS equity, peak FROM z WHERE deep AND NOT before AND """ + DUE.format("interval_start", "b"))
add("i11_zscore_latch", lambda s, d: run(J.zscore_latch(closes(s, d, "close"), 6, 1.0, 0.2, "6 hours")), f"""WITH {runs_sql()}, z AS (SELECT *, CASE
    WHEN count(close) OVER w = 6 THEN (close - avg(close) OVER w) / nullif(stddev_pop(close) OVER w, 0) END AS z FROM b
    WINDOW w AS (PARTITION BY symbol ORDER BY interval_start ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)), m AS (SELECT *, CASE
    WHEN z IS NULL OR z > -0.2 THEN 0.0 WHEN z < -1 THEN 1.0 END AS mark
    FROM z),
l AS (SELECT symbol, interval_start, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY symbol
    ORDER BY interval_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS target FROM m),
    c AS (SELECT *, coalesce(lag(target) OVER (PARTITION BY symbol ORDER BY interval_start), 0.0) AS before FROM l)
    SELECT symbol, interval_start AS event_time, target FROM c WHERE target <> before AND """ + DUE.format("interval_start", "b"))
