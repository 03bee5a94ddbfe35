"""Hand-computed cases."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators import bars as B
from tidemark.operators import events as E
from tidemark.operators import features as X
from tidemark.operators import labels as L
from tidemark.operators import revisions as R
from tidemark.operators import states as S
from tidemark.operators import statistics as T
from tidemark.operators import universe as U
from tidemark.plans.registry import causality
from tidemark.sources import sinks as K
from tidemark.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def minute_bars(spark, closes, gap_after=None):
    rows = []
    for i, c in enumerate(closes):
        m = i + (1 if gap_after is not None and i > gap_after else 0)
        rows.append(("s", at(m), at(m + 1), at(m + 1), c, c + 1, c - 1, c, 2.0, 2.0 * c, 1.0, 1))
    return spark.createDataFrame(rows, "symbol string, interval_start timestamp, interval_end timestamp, available_time timestamp, open double, high double, low double, close double, volume double, quote_volume double, taker_buy_base_volume double, trade_count long")


def points(spark, minutes, first_id=0):
    return spark.createDataFrame([(1, first_id + i, at(m)) for i, m in enumerate(minutes)], "key long, event_id long, event_time timestamp")


def test_runs_break_at_a_gap_and_windows_do_not_reach_over_it(spark):
    b = X.with_returns(minute_bars(spark, [10.0, 11.0, 12.0, 13.0, 14.0], gap_after=2)).withColumn("sma", X.moving_average("close", 2)).orderBy("interval_start").collect()
    assert [r.run_id for r in b] == [1, 1, 1, 2, 2]
    assert b[3].log_return is None and b[3].sma is None
    assert b[4].log_return == pytest.approx(math.log(14 / 13)) and b[4].sma == 13.5


def test_atr_seed_and_step(spark):
    out = X.atr(W.with_runs(minute_bars(spark, [10.0, 12.0, 11.0, 15.0])), 2).orderBy("interval_start").collect()
    # true ranges 3, 2, 5: seed (3 + 2) / 2, then (2.5 + 5) / 2
    assert [r.atr for r in out] == [None, None, pytest.approx(2.5), pytest.approx(3.75)]


def test_rsi_is_100_without_losses(spark):
    out = X.rsi(W.with_runs(minute_bars(spark, [1.0, 2.0, 3.0, 4.0])), 2).orderBy("interval_start").collect()
    assert [r.rsi for r in out] == [None, None, 100.0, 100.0]


def test_event_statistics_of_known_series(spark):
    a, b = points(spark, [0, 10, 20, 21, 50]), points(spark, [1, 12, 40], 100)
    counts = {r.bucket: r.n for r in E.frequency(a, "2024-01-01 00:00:00", "2024-01-01 01:00:00", 1200).collect()}
    assert counts == {0: 2, 1: 2, 2: 1}
    row = E.co_occurrence_lift(a, b, 120, "2024-01-01 00:00:00", "2024-01-01 01:00:00").first()
    assert (row.a_near_b, row.b_near_a) == (2, 2)
    assert sum(r.n for r in E.lead_lag(a, b, 300, 60).collect()) == 2
    assert E.sequence(a, b, 120).count() == 2


def test_asof_keeps_a_null_value(spark):
    left = spark.createDataFrame([("k", at(5))], "key string, t timestamp")
    right = spark.createDataFrame([("k", at(1), "old"), ("k", at(4), None)], "key string, u timestamp, v string")
    row = W.asof(left, right, ["key"], "t", "u", "v").first()
    assert row.v is None and row.matched_time == at(4)


def test_barrier_gap_comes_before_touch_and_both_sides_count_as_lower(spark):
    events = spark.createDataFrame([("s", 1, at(0)), ("s", 2, at(2))], "symbol string, event_key long, event_time timestamp")
    bars = minute_bars(spark, [10.0, 10.0, 10.0, 10.0], gap_after=2)
    out = {r.event_key: r for r in L.triple_barrier(events, bars, 1, 2, 0.05, 0.05).collect()}
    assert out[1].side == -1 and out[1].label == pytest.approx(-0.05)
    assert out[2].label is None and out[2].side is None


def test_heads_through_revisions_that_are_not_candidates(spark):
    rev = spark.createDataFrame([("k", i, at(0), at(0)) for i in (1, 2, 3)], "observation_key string, revision_id long, available_time timestamp, knowledge_time timestamp")
    edges = spark.createDataFrame([(3, 2, at(0)), (2, 1, at(0))], "revision_id long, superseded_revision_id long, knowledge_time timestamp")
    heads = R.maximal_heads(rev.where("revision_id <> 2"), edges)
    assert [r.revision_id for r in heads.collect()] == [3]


def test_listing_chain_stops_at_a_tie(spark):
    rows = [("s", at(0), "HALT"), ("s", at(1), "TRADING"), ("s", at(2), "ODD"), ("s", at(3), "HALT"), ("s", at(4), "TRADING"), ("s", at(4), "HALT")]
    chain = U.derive_chain(spark.createDataFrame(rows, "symbol string, observed_at timestamp, source_status string")).orderBy("valid_from").collect()
    assert [(r.valid_from, r.status) for r in chain] == [(at(1), "listed"), (at(3), "suspended")]


def test_volume_bars_take_the_closing_trade_whole(spark):
    rows = [("s", i, at(i), at(i), float(i + 1), q, True) for i, q in enumerate([3.0, 3.0, 5.0, 1.0])]
    trades = spark.createDataFrame(rows, "symbol string, venue_trade_id long, event_time timestamp, available_time timestamp, price double, quantity double, is_taker_buy boolean")
    out = B.volume_bars(trades, 5.0).orderBy("bar_no").collect()
    assert [(r.volume, r.open, r.close) for r in out] == [(6.0, 1.0, 2.0), (5.0, 3.0, 3.0)]


def test_normal_tail(spark):
    assert spark.range(1).select(T.normal_sf(F.lit(1.96)).alias("p")).first().p == pytest.approx(0.0249979, abs=1e-6)


def test_results_do_not_depend_on_order_or_partitions(spark):
    bars = minute_bars(spark, [float(10 + (7 * i) % 5) for i in range(40)])
    one = X.with_returns(bars).withColumn("v", X.realized_volatility(5)).select("interval_start", "v")
    two = X.with_returns(bars.orderBy(F.rand(3)).repartition(7)).withColumn("v", X.realized_volatility(5)).select("interval_start", "v")
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_null_percentile_ranks_draws_in_range_partitions(spark):
    import hashlib

    pool = spark.createDataFrame([(f"k{i}", float((i * 37) % 23) - 11) for i in range(60)] + [("none", None)], "key string, label double")
    observed = pool.where("key like 'k1%'").withColumn("side", F.when(F.crc32(F.col("key").cast("binary")) % 2 == 0, 1.0).otherwise(-1.0))
    out = T.null_percentile(pool, observed, 20, 7)
    assert "windowspecdefinition(sim" not in out._jdf.queryExecution().optimizedPlan().toString()

    def dealt(*parts):
        return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()

    seen = observed.collect()
    sides = [r.side for r in sorted(seen, key=lambda r: (dealt(7, r.key), r.key))]
    own = sum(r.side * r.label for r in seen)
    labels = [(r.key, r.label) for r in pool.collect() if r.label is not None]
    draws = [[v for _, v in sorted(labels, key=lambda x: (dealt(7, x[0], sim), x[0]))][: len(sides)] for sim in range(20)]  # noqa: B023
    sums = [sum(a * b for a, b in zip(sides, d, strict=True)) for d in draws]
    row = out.collect()[0]
    assert row.sims == 20 and row.percentile == pytest.approx(5 * (sum(m < own for m in sums) + 0.5 * sum(m == own for m in sums)))


def test_fittable_study_holds_no_fold_in_one_group(spark, sf):
    from tidemark.plans import catalogue

    plan = catalogue.QUERIES["j06_fittable_study"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan


REV = "observation_key string, revision_id long, available_time timestamp, knowledge_time timestamp"
EDGE = "revision_id long, superseded_revision_id long, knowledge_time timestamp"


def test_selection_equals_closure_on_random_graphs(spark):
    """Heads at one time, over a period, and of chosen candidates, against the closure of all paths."""
    rng = random.Random(4)
    revs, edges = [], []
    for k in range(30):
        ids = [100 * k + i for i in range(rng.randrange(1, 9))]
        revs += [(f"k{k}", i, at(rng.randrange(60)), at(rng.randrange(80))) for i in ids]
        edges += [(b, a, at(rng.randrange(80))) for n, b in enumerate(ids) for a in ids[:n] if rng.random() < 0.3]
    cut, start, end = at(60), at(10), at(50)
    known = [r for r in revs if r[3] <= cut]
    paths = {(a, b) for a, b, t in edges if t <= cut}
    while more := {(a, d) for a, b in paths for c, d in paths if b == c} - paths:
        paths |= more

    def heads(t):
        live = {r[1]: r[0] for r in known if r[2] <= t}
        return {i: k for i, k in live.items() if not any((j, i) in paths for j in live)}

    def answer(key, t):
        own = [i for i, k in heads(t).items() if k == key]
        return ("ABSENT", None) if not own else ("SELECTED", own[0]) if len(own) == 1 else ("CONFLICT", None)

    rows, links = spark.createDataFrame(revs, REV), spark.createDataFrame(edges, EDGE)
    for t in (at(20), at(45)):
        got = {r.observation_key: (r.status, r.revision_id) for r in R.select_at(rows, links, str(t), str(cut)).collect()}
        assert got == {k: answer(k, t) for k in {r[0] for r in revs}}
    spans = R.select_over(rows, links, str(start), str(end), str(cut)).collect()
    for minute in range(10, 50):
        got = {r.observation_key: (r.status, r.revision_id) for r in spans if r.valid_from <= at(minute) < r.valid_until}
        assert got == {r[0]: answer(r[0], at(minute)) for r in known}
    chosen = {r[1] for r in known if rng.random() < 0.5}
    got = {r.revision_id for r in R.maximal_heads(rows.where(F.col("revision_id").isin(*chosen)), links.where(F.col("knowledge_time") <= str(cut))).collect()}
    assert got == {i for i in chosen if not any((j, i) in paths for j in chosen)}


def test_a_long_chain_costs_linear_rows(spark):
    n = 10_000
    ids = spark.range(n)
    revs = ids.select(F.lit("k").alias("observation_key"), F.col("id").alias("revision_id"), (F.lit(T0) + F.make_dt_interval(secs=F.col("id"))).alias("available_time")).withColumn("knowledge_time", F.col("available_time"))
    edges = ids.where("id > 0").select(F.col("id").alias("revision_id"), (F.col("id") - 1).alias("superseded_revision_id"), F.lit(T0).alias("knowledge_time"))
    assert R.superseded_from(revs, edges).count() == n - 1
    assert [r.revision_id for r in R.maximal_heads(revs, edges).collect()] == [n - 1]
    assert R.graph_problems(revs, edges).count() == 0
    spans = R.select_over(revs, edges, str(at(0)), str(at(1)), "2025-01-01").orderBy("valid_from").collect()
    assert [r.revision_id for r in spans] == list(range(60))


def test_cycles_are_found_between_edges_that_lead_forward(spark):
    revs = spark.createDataFrame([("k", i, at(i), at(i)) for i in range(8)] + [("j", 9, at(1), at(1))], REV)
    pairs = [(1, 0), (2, 1), (1, 2), (4, 3), (5, 4), (3, 5), (7, 7), (6, 99), (6, 9)]
    got = {(r.problem, r.revision_id) for r in R.graph_problems(revs, spark.createDataFrame([(a, b, T0) for a, b in pairs], EDGE)).collect()}
    assert got == {("cycle", i) for i in (1, 2, 3, 4, 5, 7)} | {("dangling", 6), ("crosses keys", 6)}


def test_fingerprint_marks_nulls_and_types(spark):
    def print_(rows):
        r = R.fingerprint(spark.createDataFrame(rows, "a string, b string")).first()
        return r.n_rows, r.sum1, r.sum2

    rows = [[("x", None)], [(None, "x")], [("x", "")], [("x", "!")], [("x|", "y")], [("x", "|y")], [("x", "=y")], [("x", "y"), ("z", None)], [("x", None), ("z", "y")]]
    assert len({print_(r) for r in rows}) == len(rows)
    assert print_([("x", "y"), ("z", None)]) == print_([("z", None), ("x", "y")])


def test_a_batch_whose_writer_died_is_written_once(spark, tmp_path):
    root, batch = str(tmp_path), spark.range(10)
    batch.union(batch).withColumn("batch_id", F.lit("b1")).write.parquet(f"{root}/rows/folder={K._folder('b1')}")  # a writer that died before the ledger
    K.append_batch(spark.range(3), root, "b0")
    assert K.read_batches(spark, root).count() == 3
    assert K.append_batch(batch, root, "b1") == "written" and K.append_batch(batch.repartition(3), root, "b1") == "replayed"
    assert K.read_batches(spark, root).count() == 13 and K.read_batches(spark, root, ["b1"]).count() == 10
    with pytest.raises(K.Conflict):
        K.append_batch(spark.range(9), root, "b1")


def test_barriers_by_symbol_event_and_row(spark):
    one = minute_bars(spark, [10.0, 10.0, 10.0, 10.0])
    bars = one.union(one.withColumns({"symbol": F.lit("t"), "high": F.col("high") + 5, "low": F.col("open")}))
    events = spark.createDataFrame([("s", 1, at(0)), ("t", 1, at(0)), ("s", 1, at(0)), ("s", 1, at(1))], "symbol string, event_key long, event_time timestamp")
    out = sorted((r.symbol, r.event_time, r.side, round(r.label, 6)) for r in L.triple_barrier(events, bars, 1, 2, 0.3, 0.05).collect())
    assert out == [("s", at(0), -1, -0.05), ("s", at(0), -1, -0.05), ("s", at(1), -1, -0.05), ("t", at(0), 1, 0.3)]


def test_regimes_equal_counting(spark):
    rng = random.Random(2)
    rows = [("a" if rng.random() < 0.8 else "b", i, at(rng.randrange(600)), None if rng.random() < 0.1 else float(rng.randrange(9))) for i in range(400)]
    df = spark.createDataFrame(rows, "symbol string, id long, interval_end timestamp, x double")
    got = {r.id: r.state for r in S.quantile_regime(df, "x", [0.3, 0.7], ["low", "mid", "high"], 5, 3600).collect()}
    for symbol, i, t, x in rows:
        seen = [v for s, _, u, v in rows if s == symbol and v is not None and t - dt.timedelta(seconds=3600) < u <= t]
        less = sum(v < x for v in seen) if x is not None else 0
        want = None if x is None or len(seen) < 5 else ["low", "mid", "high"][sum(less >= max(1, math.ceil(c * len(seen))) for c in (0.3, 0.7))]
        assert got[i] == want


def test_running_maxima_over_range_partitions(spark):
    rng = random.Random(3)
    rows = [(i, None if rng.random() < 0.2 else rng.randrange(1000)) for i in range(300)]
    out = {r.i: r.top for r in T.running_max(spark.createDataFrame(rows, "i long, v long").repartition(5), [F.col("i")], F.col("v"), "top", 7).collect()}
    top = None
    for i, v in rows:
        top = v if top is None else max(top, v or 0)
        assert out[i] == top


def test_causality_catches_a_provider_that_looks_ahead(spark):
    bars = minute_bars(spark, [float(i) for i in range(20)])
    ahead = lambda b: b.select("symbol", F.col("available_time").alias("time"), F.lead("close").over(Window.partitionBy("symbol").orderBy("interval_start")).alias("value"))
    fair = lambda b: b.select("symbol", F.col("available_time").alias("time"), F.lag("close").over(Window.partitionBy("symbol").orderBy("interval_start")).alias("value"))
    assert causality(ahead, bars, str(at(10))).count() == 2 and causality(fair, bars, str(at(10))).count() == 0


def test_normal_functions(spark):
    from statistics import NormalDist

    z = spark.createDataFrame([(x / 4,) for x in range(-40, 41)] + [(None,), (float("nan"),)], "z double")
    for r in z.select("z", T.normal_sf(F.col("z")).alias("p")).collect():
        assert r.p is None if r.z is None or r.z != r.z else r.p == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), rel=1e-11)
    p = spark.createDataFrame([(x,) for x in (1e-9, 0.001, 0.02425, 0.3, 0.5, 0.97, 0.9999, 0.0, 1.0)], "p double")
    for r in p.select("p", T.normal_quantile(F.col("p")).alias("z")).collect():
        assert r.z is None if r.p in (0.0, 1.0) else r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-8)


def test_stateful_stream_waits_for_the_watermark(spark, tmp_path):
    """Three batches: order within the delay does not matter, rows beyond it are dropped, the rest waits."""
    schema = "symbol string, order_id long, event_time timestamp, label string"
    batches = [[("s", 2, at(12), "b"), ("s", 1, at(10), "a")], [("s", 4, at(30), "a"), ("s", 3, at(11), "c")], [("s", 6, at(60), "z"), ("s", 5, at(1), "late"), ("s", 7, at(31), "d")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = J.run_available(J.state_switches(stream, "5 minutes"), f"{tmp_path}/run").orderBy("event_time").collect()
    assert [(r.event_time, r.from_state, r.to_state) for r in out] == [(at(11), "a", "c"), (at(12), "c", "b"), (at(30), "b", "a"), (at(31), "a", "d")]


def test_long_stretches_of_other_revisions_take_a_logarithm_of_rounds(spark, monkeypatch):
    n, rounds = 5_000, []
    write = R.materialise
    monkeypatch.setattr(R, "materialise", lambda df, name: rounds.append(name) or write(df, name))
    ids = spark.range(n)
    revs = ids.select(F.lit("k").alias("observation_key"), F.col("id").alias("revision_id"), F.lit(T0).alias("available_time"), F.lit(T0).alias("knowledge_time"))
    edges = ids.where("id > 0").select(F.col("id").alias("revision_id"), (F.col("id") - 1).alias("superseded_revision_id"), F.lit(T0).alias("knowledge_time"))
    heads = R.maximal_heads(revs.where(F.col("revision_id").isin(0, 2500, n - 1)), edges)
    assert [r.revision_id for r in heads.collect()] == [n - 1] and rounds.count("links") <= 15
    circle = edges.union(spark.createDataFrame([(0, n - 1, T0)], EDGE))
    assert R.maximal_heads(revs.where("revision_id = 7"), circle).count() == 0
    assert R.maximal_heads(revs.where("revision_id = 7"), edges).count() == 1


def test_cycles_of_random_graphs_equal_the_closure(spark):
    rng = random.Random(11)
    arcs, base = set(), 0
    for n, m in [(1, 1), (2, 2), (5, 6), (8, 9), (12, 14), (20, 24), (30, 31), (6, 20)] * 2:  # one graph beside the other
        arcs |= {(base + rng.randrange(n), base + rng.randrange(n)) for _ in range(m)}
        base += n
    arcs |= {(base + i, base + i + 1) for i in range(300)} | {(base + 250, base + 40), (base + 200, base + 100), (base + 299, base + 270)}
    after = {}
    for a, b in arcs:
        after.setdefault(a, set()).add(b)

    def reaches_itself(v):
        seen, todo = set(), list(after.get(v, ()))
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += after.get(x, ())
        return v in seen

    got = sorted(r.v for r in R.on_cycles(spark.createDataFrame(sorted(arcs), "a long, v long")).collect())
    assert got == [v for v in range(base + 301) if reaches_itself(v)]


def test_one_cycle_of_a_long_chain_is_named_whole(spark):
    n = 3_000
    chain = spark.range(n).where("id > 0").select(F.col("id").alias("a"), (F.col("id") - 1).alias("v"))
    assert R.on_cycles(chain).count() == 0
    assert R.on_cycles(chain.union(spark.createDataFrame([(5, n - 10)], "a long, v long"))).agg(F.min("v"), F.max("v"), F.count("*")).first()[:] == (5, n - 10, n - 14)
