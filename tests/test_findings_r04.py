"""Cases of the fourth review: each failed before its finding was mended, unless it says otherwise."""

import datetime as dt
import random
from collections import Counter

import duckdb
import pytest
from test_findings_r03 import events_in

from tidemark.operators import universe as U
from tidemark.plans import catalogue

T0 = dt.datetime(2024, 1, 1)


def test_pairs_of_manifests_are_rows(spark, tmp_path):
    """every feature with every price of the same data, a row each; orders without a customer or date pair with none."""
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT i AS o_orderkey, CASE WHEN i % 17 > 0 THEN i % 3 + 50 * (i % 2) END AS o_custkey, CASE WHEN i % 5 > 0 THEN 'FOP'[i % 3 + 1] END AS o_orderstatus,
        CASE WHEN i % 19 > 0 THEN TIMESTAMP '2000-01-01' + INTERVAL 1 DAY * (i % 40) END AS o_orderdate FROM range(300) t(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)""")
    orders = con.sql(f"SELECT * FROM '{tmp_path}/orders.parquet'").fetchall()
    month = lambda o: (o[1] % 50, o[3].year, o[3].month)
    known = [o for o in orders if None not in (o[1], o[3])]
    want = Counter((a[0], b[0]) for a in known for b in known if a[2] == "F" and b[2] != "F" and month(a) == month(b) and b[3] >= a[3])
    hashes = dict(con.sql(f"SELECT sha256(CAST(o_orderkey AS VARCHAR)), o_orderkey FROM '{tmp_path}/orders.parquet'").fetchall())
    got = catalogue.QUERIES["c35_pair_manifests"](spark, str(tmp_path))
    assert Counter((hashes[r.feature_hash], hashes[r.price_hash]) for r in got.collect()) == want
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    assert Counter((hashes[a], hashes[b]) for a, b in con.sql(catalogue.ORACLE["c35_pair_manifests"]).fetchall()) == want


def test_many_manifests_of_the_same_data_are_dealt_to_shares(spark, monkeypatch):
    """pairs tell the number of tasks, and one data set's pairs are many tasks; each pair is made once, equal manifests are kept."""
    monkeypatch.setattr(U, "SIDE", 10)
    rng = random.Random(4)
    rows = [(f"h{i % 230}", rng.choice(["feature", "price", "other"]), rng.choice([1, 1, 1, 2, None]), 2024, 1, T0 + dt.timedelta(days=rng.randrange(9)) if rng.random() < 0.9 else None) for i in range(250)]
    rows += [("alone", "feature", 3, 2024, 1, T0)]
    got = U.pair_manifests(spark.createDataFrame(rows, "content_hash string, kind string, dataset int, knowledge_cutoff int, snapshot int, until timestamp"))
    fine = [r for r in rows if None not in (r[2], r[5])]
    want = Counter((a[0], b[0]) for a in fine for b in fine if a[1] == "feature" and b[1] == "price" and a[2:5] == b[2:5] and b[5] >= a[5])
    assert Counter((r.feature_hash, r.price_hash) for r in got.collect()) == want
    tasks = got.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert sum(tasks) == want.total() and sum(n > 0 for n in tasks) > 8 and max(tasks) < want.total() / 4


def test_manifests_without_a_pair(spark):
    """nothing to pair gives no rows, as before."""
    m = spark.createDataFrame([("a", "feature", 1, 2024, 1, T0)], "content_hash string, kind string, dataset int, knowledge_cutoff int, snapshot int, until timestamp")
    assert U.pair_manifests(m).collect() == []


@pytest.mark.parametrize("name", ["e14_parkinson", "e15_garman_klass"])
def test_ranges_of_a_price_of_zero_are_those_of_the_sql(spark, tmp_path, name):
    """infinite where a low is zero, NaN where the SQL is; NaN, null and infinity count as different."""
    rows = [(i, T0 + dt.timedelta(minutes=20 * i), 1.0 + i * i % 11) for i in range(300)]
    odd = {31: 0.0, 60: 0.0, 92: 0.0, **dict.fromkeys((120, 121, 122), 0.0), 151: -2.0, **dict.fromkeys((180, 181, 182), -3.0)}  # within, open, close, whole bar, signs
    rows = [(i, t, odd.get(i, v)) for i, t, v in rows if i // 3 not in (70, 71)]
    d = events_in(tmp_path, rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    want = {t: repr(v) for t, v in con.sql(f"SELECT interval_start, value FROM ({catalogue.ORACLE[name]})").fetchall()}
    assert {r.interval_start: repr(r.value) for r in catalogue.QUERIES[name](spark, d).collect()} == want
    assert {"inf", "nan", "None"} < set(want.values())
