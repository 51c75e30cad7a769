from collections import defaultdict
from datetime import datetime

import pytest

from voxloom.operators.skew import heavy_keys, skewed_key_profile

SCHEMA = "p string, k string, who string, at string, v double, n long"


def profile(spark, rows, partitions):
    df = spark.createDataFrame(rows, SCHEMA)
    return skewed_key_profile(df, ["p", "k"], distinct_col="who", time_col="at", mean_col="v", partitions=partitions)


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0], r[1]].append(r)
    out = {}
    for key, rs in groups.items():
        times = [datetime.fromisoformat(r[3].replace("Z", "+00:00")).timestamp() for r in rs if r[3]]
        values = [r[4] for r in rs if r[4] is not None]
        out[key] = (len(rs), len({r[2] for r in rs if r[2] is not None}), min(times, default=None), max(times, default=None), round(sum(values) / len(values), 9) if values else None)
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_matches_brute_force_with_a_hot_key(spark, partitions):
    rows = []
    for i in range(3000):
        hot = i % 3 == 0
        rows.append(("A" if hot else f"B{i % 40}", "x" if hot else None if i % 11 == 0 else f"k{i % 5}", None if i % 17 == 0 else ("U1" if i % 2 else f"U{i % 60}"), None if i % 23 == 0 else f"2026-03-{1 + i % 28:02d}T10:00:00+0{i % 3}:00", None if i % 19 == 0 else i % 10 / 10, i))
    rows += rows[:200]  # repeated rows count
    got = {(r.p, r.k): (r.mentions, r.n_distinct, r.first_at.timestamp() if r.first_at else None, r.last_at.timestamp() if r.last_at else None, round(r.mean_value, 9) if r.mean_value is not None else None) for r in profile(spark, rows, partitions).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:2] == want[k][:2]
        assert got[k][4] == pytest.approx(want[k][4], abs=1e-8)


def test_runs_are_carried_over_batches(spark):
    """Small batches: a key has one state for each partition that it touches, and the same result."""
    rows = [("A" if i % 4 else f"B{i % 9}", "x", f"U{i % 70:02d}" if i % 5 else None, f"2026-03-{1 + i % 28:02d}T10:00:00Z", i % 10 / 10, i) for i in range(900)]
    whole = {tuple(r) for r in profile(spark, rows, 3).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    small = {tuple(r) for r in profile(spark, rows, 3).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == whole and {r[:2] + (r[3],) for r in small} == {(*k, v[1]) for k, v in brute(rows).items()}


def test_empty_and_all_null(spark):
    assert profile(spark, [], 4).count() == 0
    (row,) = profile(spark, [(None, None, None, "no time", None, 1)] * 3, 4).collect()
    assert (row.mentions, row.n_distinct, row.first_at, row.last_at, row.mean_value) == (3, 0, None, None, None)


def test_heavy_keys_is_strict(spark):
    p = profile(spark, [("A", "x", "u", None, 1.0, 1)] * 1 + [("B", "y", "u", None, 1.0, 1)] * 99, 4)
    assert {(r.p, r.k) for r in heavy_keys(p, 100).collect()} == {("B", "y")}


def test_one_exchange_of_rows(spark):
    df = spark.createDataFrame([("A", "x", "u", "2026-03-01", 1.0, 1)], SCHEMA)
    plan = skewed_key_profile(df, ["p", "k"], distinct_col="who", time_col="at", mean_col="v", partitions=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and plan.count("hashpartitioning") == 1
