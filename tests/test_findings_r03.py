"""Cases of the third review: each failed before its finding was mended."""

import datetime as dt
import hashlib
import random
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from compare import plain, spark_rows, sql_rows
from pyspark.sql import functions as F

from tidemark.functions import ranks as K
from tidemark.functions.session import shared_folder
from tidemark.operators import features as X
from tidemark.operators import splits as P
from tidemark.operators import statistics as T
from tidemark.operators import universe as U
from tidemark.plans import catalogue, streaming_queries
from tidemark.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)


def test_members_tell_every_pair_of_manifests(spark):
    """a row a manifest, whose class and number of links give the pairs back."""
    rng = random.Random(1)
    rows = [(f"h{i}", rng.choice(["feature", "price", "other"]), rng.choice([1, 2, None]), 2024, rng.randrange(2), T0 + dt.timedelta(days=rng.randrange(4)) if rng.random() < 0.9 else None) for i in range(120)]
    m = spark.createDataFrame(rows, "content_hash string, kind string, dataset int, knowledge_cutoff int, snapshot int, until timestamp")
    pairs = {(r.feature_hash, r.price_hash) for r in U.pair_manifests(m).collect()}
    got = U.pair_members(m).collect()
    assert len(got) == len({r.content_hash for r in got}) == sum(r[1] != "other" for r in rows)
    links = Counter(x for pair in pairs for x in pair)
    assert all(r.n_links == links[r.content_hash] for r in got)
    same = lambda a, b: None not in (a.dataset, a.until, b.dataset, b.until) and a[2:5] == b[2:5] and a.until <= b.until
    assert pairs == {(a.content_hash, b.content_hash) for a in got for b in got if a.kind == "feature" and b.kind == "price" and same(a, b)}


def zero_bars(spark):
    """Eight bars, of which the fourth has a low of zero and the last a close of zero after an open of zero."""
    hour = lambda i: T0 + dt.timedelta(hours=i)
    rows = [("s", hour(i), hour(i + 1), o, h, low, c) for i, (o, h, low, c) in enumerate([(2.0, 4.0, 1.0, 3.0)] * 3 + [(2.0, 4.0, 0.0, 3.0)] + [(2.0, 4.0, 1.0, 3.0)] * 3 + [(0.0, 4.0, 0.0, 0.0), (2.0, 4.0, 1.0, 3.0)])]
    return X.with_returns(spark.createDataFrame(rows, "symbol string, interval_start timestamp, interval_end timestamp, open double, high double, low double, close double"))


@pytest.mark.parametrize(
    ("name", "add", "known"),
    [
        ("F2", lambda b: b.withColumn("value", X.parkinson_volatility(2)), [1, 2, 5, 6]),
        ("F3", lambda b: b.withColumn("value", X.garman_klass_volatility(2)), [1, 2, 5, 6]),
        ("F4", lambda b: X.add_corwin_schultz(b, 2, "value"), [2, 6]),
        ("F10", lambda b: X.add_yang_zhang(b, 2, "value"), [2, 5, 6]),
        ("log_return", lambda b: b.withColumn("value", F.col("log_return")), [1, 2, 3, 4, 5, 6]),
    ],
)
def test_windows_with_a_price_of_zero_are_null(spark, name, add, known):
    """not computable is null, and no window beside it is lost."""
    got = [r.value for r in add(zero_bars(spark)).orderBy("interval_start").collect()]
    assert [i for i, v in enumerate(got) if v is not None] == known


def events_in(folder, rows):
    """An events table, ``event_id, ts, value``, of views, beside the other tables' absence: only for queries of events."""
    con = duckdb.connect()
    values = ", ".join(f"({i}, TIMESTAMP '{t.isoformat(sep=' ')}', 1, 'view', {v!r}::DOUBLE, '{{\"k\": 1}}')" for i, t, v in rows)
    con.sql(f"COPY (SELECT * FROM (VALUES {values}) e(event_id, ts, user_id, event_type, value, props)) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


def sql_of(name, folder, table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    rel = con.sql(catalogue.ORACLE[name])
    cols = sorted(rel.columns)
    at = [list(rel.columns).index(c) for c in cols]
    return Counter(tuple(plain(row[i]) for i in at) for row in rel.fetchall()), cols


@pytest.mark.parametrize("name", ["e16_yang_zhang", "a01_trade_archive", "a01_trade_rejects", "a02_bar_archive", "a02_bar_rejects"])
def test_sql_states_the_rules_for_a_price_of_zero(spark, tmp_path, name):
    """A price of zero is not positive and its logarithm null, in the query and in its SQL; two months, ties in time."""
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=13 * i), 1.0 + i % 7) for i in range(6000)]
    rows = [(i, t, 0.0 if i in (5, 900, 1200, 3500, 5000) else v) for i, t, v in rows]
    rows += [(9000 + i, t, v + 1) for i, t, v in rows[:50]] if name.startswith("a02") else []
    d = events_in(tmp_path, rows)
    assert spark_rows(catalogue.QUERIES[name](spark, d)) == sql_of(name, d, "events")


def write_lines(folder, lines, orders):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * FROM (VALUES {lines}) t(l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_discount, l_shipdate)) TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    con.sql(f"COPY (SELECT * FROM (VALUES {orders}) t(o_orderkey, o_totalprice, o_orderdate)) TO '{folder}/orders.parquet' (FORMAT parquet)")
    con.sql(f"COPY (SELECT * FROM (VALUES (2, 3, 5.0), (4, 3, -5.0)) t(s_suppkey, s_nationkey, s_acctbal)) TO '{folder}/supplier.parquet' (FORMAT parquet)")
    for t in ("lineitem", "orders", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def test_edges_to_other_keys_are_told_on_both_sides(spark, tmp_path):
    """the line 77 million on exists once the table is large; then its edge crosses keys, in the query and in its SQL."""
    orders = ", ".join(f"({k}::BIGINT, 1.0::DOUBLE, TIMESTAMP '2000-01-0{1 + k % 5}')" for k in (0, 10, 770000, 770010, 3, 5))
    lines = ", ".join(f"({k}::BIGINT, {n}, 2::BIGINT, 1.0::DOUBLE, 0.05::DOUBLE, TIMESTAMP '2000-02-0{n}')" for k in (0, 10, 770000, 3, 5, 6) for n in (1, 2, 4))
    con = write_lines(tmp_path, lines, orders)
    got = Counter((r.problem, r.revision_id) for r in catalogue.QUERIES["c06_graph_problems"](spark, str(tmp_path)).collect())
    want = Counter(con.sql(catalogue.ORACLE["c06_graph_problems"]).fetchall())
    assert got == want
    assert got["crosses keys", 1] == 1


def test_a_mean_at_the_limit_does_not_depend_on_the_order(spark, tmp_path):
    """a mean discount of exactly five percent is not above it, whatever the doubles add up to."""
    given = [0.09, 0.01, 0.08, 0.02, 0.07, 0.03, 0.06, 0.04]
    for seed in range(5):
        random.Random(seed).shuffle(given)
        folder = tmp_path / str(seed)
        folder.mkdir()
        lines = ", ".join(f"({i}::BIGINT, 1, 2::BIGINT, 1.0::DOUBLE, {x}::DOUBLE, TIMESTAMP '2000-02-01')" for i, x in enumerate(given))
        con = write_lines(folder, lines, "(1::BIGINT, 1.0::DOUBLE, TIMESTAMP '2000-01-01')")
        got = Counter(tuple(r[c] for c in ("subject", "family", "reason", "gate_id")) for r in catalogue.QUERIES["a20_failure_log"](spark, str(folder)).collect())
        assert got == Counter(con.sql(catalogue.ORACLE["a20_failure_log"]).fetchall()) == Counter([("4", "3", "balance below zero", "balance")])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_visible_counts_over_pieces(spark):
    """a symbol is as many tasks as it has pieces, and no frame slides: both counts begin with the piece."""
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, T0 + dt.timedelta(seconds=rng.randrange(40_000))) for i in range(600)] + [("a", 1000, None), ("a", 1001, None)]
    got = K.visible_counts(spark.createDataFrame(rows, "symbol string, id int, event_time timestamp"), 3_600_000_000)
    assert "_piece" in plan_of(got).split("Window")[1] and "currentrow$()" in plan_of(got) and "specifiedwindowframe(RangeFrame, -" not in plan_of(got)
    seen = lambda s, t: sum(1 for s2, _, t2 in rows if s2 == s and (t2 is None if t is None else t2 is not None and t - dt.timedelta(hours=1) < t2 <= t))
    assert {r.id: r.n_visible for r in got.collect()} == {i: seen(s, t) for s, i, t in rows}


@pytest.mark.parametrize(("n", "k", "days"), [(23, 5, 3), (3, 5, 3), (40, 4, 1), (0, 3, 1), (12, 1, 2)])
def test_folds_are_found_without_ranking_all_spans(spark, n, k, days):
    """the folds of all spans in order, from the days in which folds begin."""
    rng = random.Random(n)
    rows = [(f"k{i:03d}", T0 + dt.timedelta(days=rng.randrange(days), hours=rng.randrange(3)), T0 + dt.timedelta(days=days + rng.randrange(3))) for i in range(n)]
    spans = spark.createDataFrame(rows, "key string, start timestamp, end timestamp")
    size, more = divmod(n, k)
    order = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    want = [f for f in range(k) for _ in range(size + (f < more))]
    assert {r.key: r.fold for r in P.fold_of(spans, k).collect()} == dict(zip(order, want, strict=True))
    roles = P.purged_k_fold(spans, k, 3600).collect()
    got = P.fold_summary(spans, k, 3600)
    assert "Sort" not in plan_of(got).replace("SortAggregate", "")  # grouping by fold and role sorted k rows a span
    assert {(r.fold, r.role): (r.n, r.first_key) for r in got.collect()} == {c: (len(keys), min(keys)) for c, keys in {(r.fold, r.role): [x.key for x in roles if (x.fold, x.role) == (r.fold, r.role)] for r in roles}.items()}


def test_overlap_lag_shuffles_spans_once(spark):
    """one exchange by key, no join; the lag equals that of all pairs."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        begin = rng.randrange(40)
        rows.append((i % 3, T0 + dt.timedelta(hours=begin), T0 + dt.timedelta(hours=begin + rng.randrange(6))))
    got = T.overlap_lag(spark.createDataFrame(rows, "k int, start timestamp, end timestamp"), ["k"], "start", "end")
    assert plan_of(got).count("Exchange") == 1 and "Join" not in plan_of(got)
    want = {}
    for k in range(3):
        mine = sorted(r[1:] for r in rows if r[0] == k)
        want[k] = max(sum(b[0] < a[1] for b in mine) - (i + 1) for i, a in enumerate(mine))
    assert {r.k: r.lag for r in got.collect()} == want


def test_null_percentile_shuffles_its_draws_once_and_without_keys(spark, monkeypatch):
    """in pieces of any size the ranks pair as in a plain sort; the labels of the draws meet the sides behind one shuffle, which has no keys."""
    monkeypatch.setattr(T, "SIDES", 7)
    monkeypatch.setattr(T, "DEALT", 5_000)
    rng = random.Random(5)
    pool = [(f"k{i}", rng.random() if rng.random() < 0.95 else None) for i in range(900)]
    seen = [(f"o{i}", rng.random(), rng.choice([1.0, -1.0, 0.5, None])) for i in range(400)]
    out = T.null_percentile(spark.createDataFrame(pool, "key string, label double"), spark.createDataFrame(seen, "key string, label double, side double"), 9, 3)
    h = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    sides = [s for _, s in sorted(((h(3, k), s) for k, _, s in seen), key=lambda p: p[0])]
    mean = lambda pairs: sum(s * v for s, v in pairs) / len(pairs)
    own = mean([(s, v) for _, v, s in seen if s is not None])
    draws = [[v for _, v in sorted((h(3, k, sim), v) for k, v in pool if v is not None)[:400]] for sim in range(9)]
    means = [mean([(s, v) for s, v in zip(sides, d, strict=True) if s is not None]) for d in draws]
    assert out.collect() == [(9, pytest.approx(100 * sum(m < own for m in means) / 9))]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # a single shuffle of the draws' labels, which carries digits, draw, hash and label
    assert plan.count("RepartitionByExpression [_d") == 1
    assert T.null_percentile(spark.createDataFrame(pool[:300], "key string, label double"), spark.createDataFrame(seen, "key string, label double, side double"), 4, 3).collect() == [(0, None)]
    assert T.null_percentile(spark.createDataFrame(pool, "key string, label double"), spark.createDataFrame([], "key string, label double, side double"), 4, 3).collect() == [(0, None)]


def test_coverage_compares_a_bounded_number_of_ids_a_task(spark, monkeypatch):
    """F16: tasks are told by the number of ids, repeated and null ones kept as they were."""
    monkeypatch.setattr(U, "IDS", 100)
    monkeypatch.setattr(U, "materialise", lambda df, name: df)
    raw = [*range(1000), 7, 2000, 2000, None]
    images = [*range(5, 1000), 3000, None]
    out = U.uncovered(spark.createDataFrame([(i,) for i in raw], "k long"), spark.createDataFrame([(i,) for i in images], "l long"), "k", "l")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and ", 21), REPARTITION_BY_NUM" in plan  # 2,001 ids, 100 a task
    want = Counter([(i, "raw without image") for i in [0, 1, 2, 3, 4, 2000, 2000, None]] + [(i, "image without raw") for i in [3000, None]])
    assert Counter(map(tuple, out.collect())) == want


def test_keyed_state_has_no_more_parts_than_cores(spark, tmp_path):
    """every part is a process in every micro-batch; waiting rows come back in order from several files and spans."""
    rows = spark.range(3000).select(F.concat(F.lit("s"), F.col("id") % 3).alias("symbol"), F.col("id").alias("order_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("event_time"), F.col("id").cast("double").alias("price"), F.lit(1.0).alias("quantity"))
    for k in range(3):
        rows.where(F.floor(F.col("order_id") / 1000) == k).repartition(2).write.mode("append").parquet(f"{tmp_path}/rows")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/rows")
    before = spark.conf.get(J.PARTS)
    spark.conf.set(J.PARTS, "24")
    try:
        out = J.run_available(J.volume_bars(source, 100.0, "5 minutes"), f"{tmp_path}/run")
        assert spark.conf.get(J.PARTS) == "24"
    finally:
        spark.conf.set(J.PARTS, before)
    got = {(r.symbol, r.bar_no): (r.open, r.high, r.low, r.close, r.trade_count) for r in out.collect()}
    last = 2999 - 300  # of the times that the watermark passes
    assert got == {(f"s{i}", b): (float(300 * b + i), float(300 * b + 297 + i), float(300 * b + i), float(300 * b + 297 + i), 100) for i in range(3) for b in range(10) if 300 * b + 297 + i <= last}
    parts = [p for p in (tmp_path / "run/checkpoint/state/0").iterdir() if p.name.isdigit()]
    assert len(parts) == min(24, spark.sparkContext.defaultParallelism)


@pytest.mark.parametrize("name", ["i04_stream_volume_bars", "i01_late_rows"])
def test_micro_batches_of_several_files_stay_whole(spark, monkeypatch, name):
    """a micro-batch is written by several tasks and still read as one."""
    monkeypatch.setattr(streaming_queries, "ROWS", 500)
    sf = "/root/testdata/sf0.01"
    written = []
    monkeypatch.setattr(streaming_queries, "shared_folder", lambda s: written.append(shared_folder(s)) or f"{written[-1]}/files-{name}")
    assert spark_rows(catalogue.QUERIES[name](spark, sf)) == sql_rows(catalogue.ORACLE[name], sf)
    assert len(list(Path(f"{written[0]}/files-{name}").glob("trades-*/*.parquet"))) > 8
