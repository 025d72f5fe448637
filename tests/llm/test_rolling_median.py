"""Rolling medians against plain loops: nulls, ties, repeated ids, dense and sparse blocks, broken values."""

import datetime as dt
import random

import numpy as np
import pytest

from lakeforge.llm.rolling_median import MOST, PersistentTree, medians, rolling_medians

KIND = "click_id long, ts timestamp_ntz, kind string, value double, n int, median2 string, id int, block long, role int, at string"
START = dt.datetime(2024, 3, 31, 0, 0)


def middle2(values):
    s = sorted(values)
    return s[(len(s) - 1) // 2] + s[len(s) // 2]


def cents(value):
    if value is None or value != value or abs(value) == float("inf"):
        return None
    return int(max(-MOST, min(MOST, np.floor(100 * value + 0.5))))


def brute(rows, minutes, least):
    best = {}
    for i, ts, kind, value in rows:
        if ts is not None:
            key = (ts, kind is not None, kind or "", cents(value) is not None, cents(value) or 0)
            if i not in best or key < best[i][0]:
                best[i] = (key, ts, kind, cents(value))
    out = {}
    for i, (_, ts, kind, own) in best.items():
        window = [c for _, t, k, c in best.values() if k == kind and ts - dt.timedelta(minutes=minutes) <= t <= ts and c is not None]
        if len(window) < least:
            out[i] = (kind, len(window), None, None, None)
            continue
        m = middle2(window)
        mad = middle2([abs(2 * c - m) for c in window])
        out[i] = (kind, len(window), m, mad, None if own is None else 2 * abs(2 * own - m) > 5 * mad)
    return out


def made(seed, count=500):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        ts = None if rng.random() < 0.03 else START + dt.timedelta(microseconds=rng.choice([rng.randrange(0, 10**11), rng.randrange(0, 50) * 360 * 60_000_000, rng.randrange(0, 4) * 10**6]))
        value = rng.choice([None, float("nan"), float("inf"), 1e300, 0.0, -3.105, rng.randrange(-50, 50) / 10, rng.lognormvariate(3, 1), rng.lognormvariate(3, 1)])
        rows.append((i, ts, rng.choice(["a", "a", "a", "b", None]), value))
    rows += rng.sample(rows, 30)
    rows += [(3, START, "z", 1.0), (None, START, "a", 2.0), (None, START, "a", 2.0), (-5, START - dt.timedelta(days=30000), "a", 1.0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("minutes, dense, packed", [(360, 1 << 17, 1 << 12), (360, 8, 1), (7, 1 << 17, 50), (60, 3, 1)])
def test_equals_loops(spark, minutes, dense, packed):
    rows = made(minutes + dense)
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, 4, "y") for r in rows], KIND).repartition(5)
    got = {r.click_id: tuple(r)[1:] for r in rolling_medians(df, minutes=minutes, dense_rows=dense, block_rows=packed).collect()}
    assert got == brute(rows, minutes, 5)


def test_zone_of_the_session_changes_nothing(spark):
    rows = made(5, 200)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # its clocks change in the rows' night
    try:
        df = spark.createDataFrame([(*r, 1, "x", 2, 3, 4, "y") for r in rows], KIND)
        got = {r.click_id: tuple(r)[1:] for r in rolling_medians(df).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == brute(rows, 360, 5)


def test_empty(spark):
    out = rolling_medians(spark.createDataFrame([], KIND))
    assert out.columns == ["click_id", "kind", "n", "median2", "mad4", "far"] and out.count() == 0


def test_one_value_and_one_time(spark):
    df = spark.createDataFrame([(i, START, "a", 1.5) for i in range(3000)], "click_id long, ts timestamp_ntz, kind string, value double")
    assert rolling_medians(df, dense_rows=100).distinct().drop("click_id").distinct().collect() == [("a", 3000, 300, 0, False)]


def test_versions_of_the_tree():
    rng = np.random.default_rng(2)
    for trial in range(60):
        n = int(rng.integers(1, 50))
        values, ranks = np.unique(rng.integers(-5, rng.integers(1, 60), n), return_inverse=True)
        weights = rng.integers(1, 4, n) if trial % 2 else np.ones(n, np.int64)
        tree = PersistentTree(ranks, weights)
        high = rng.integers(1, n + 1, 30)
        low = rng.integers(0, high)
        m2, d2 = medians(tree, values, low, high)
        for a, b, m, d in zip(low, high, m2, d2, strict=True):
            window = np.repeat(values[ranks[a:b]], weights[a:b]).tolist()
            assert m == middle2(window) and d == middle2([abs(2 * x - m) for x in window])
