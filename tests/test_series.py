"""Long series without a task that holds one: path search, greedy selection, order statistics and smoothing."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, indicators, orderstats, pathsearch, pieces, resample, selection, selectk, state
from tidemark.operators.machine import BreakoutState, step
from tidemark.operators.orderstats import Sliding, WaveletMatrix

T0 = datetime(2024, 1, 1)
BARS = "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, flag boolean"


def walk(n, seed, symbol="a", minutes=7, flags=0.0):
    rng = random.Random(seed)
    at, out = 100.0, []
    for i in range(n):
        at += rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0])
        out.append((symbol, T0 + timedelta(minutes=minutes * i), at, at + rng.choice([0.0, 0.5, 2.0]), at - rng.choice([0.0, 0.5, 2.0]), at, rng.random() < flags))
    return out


def test_numbers_and_counts_against_plain_ones(spark):
    rows = walk(700, 1) + walk(300, 2, "b", 61) + [("c", None, 1.0, 1.0, 1.0, 1.0, False), (None, T0, 1.0, 1.0, 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, BARS)
    got = {(r.symbol, r.bar_ts): r.n for r in pieces.numbered(df, ["symbol"], ["bar_ts"], "n").collect()}
    want = {(s, t): n for s in ("a", "b", "c", None) for n, t in enumerate(sorted((r[1] for r in rows if r[0] == s), key=str))}
    assert got == want
    points = [(s, T0 + timedelta(minutes=m)) for s in ("a", "b", "zz", None) for m in (-5, 0, 1, 7, 1441, 3000, 60 * 24 * 400)] + [("a", None)]
    found = pieces.rows_until(spark.createDataFrame(points, "symbol string, at timestamp_ntz"), df, ["symbol"], "at", "bar_ts", "n").collect()
    assert len(found) == len(points)
    for r in found:
        assert r.n == (None if r.at is None else sum(x[0] == r.symbol and x[1] is not None and x[1] <= r.at for x in rows))


@pytest.mark.parametrize("flags", [0.0, 0.01])
def test_path_search_against_a_walk_over_all_bars(spark, flags):
    """Paths from within a block to beyond several levels of the tree; levels that no bar reaches; times around all bars."""
    bars = walk(9000, 3, flags=flags) + walk(40, 4, "b", flags=flags)
    rng = random.Random(5)
    points = []
    for i in range(400):
        symbol = rng.choice("aaab") if i % 50 else "none"
        at = T0 + timedelta(minutes=rng.randint(-100, 7 * 9050 if symbol == "a" else 300))
        until = at + timedelta(minutes=rng.choice([0, 5, 100, 10_000, 1_000_000])) if i % 7 else None
        level = 100 + rng.uniform(-60, 60)
        points.append((symbol, i, at, until, None if i % 11 == 0 else level - rng.choice([1, 10, 60]), None if i % 13 == 0 else level + rng.choice([1, 10, 60])))
    df = spark.createDataFrame(points, "symbol string, i int, at timestamp_ntz, until timestamp_ntz, lo double, hi double")
    index = pathsearch.build(spark.createDataFrame(bars, BARS), "flag")
    assert len(index.levels) == 3
    for end in (None, "until"):
        got = {r.i: r for r in pathsearch.first_touch(df, index, "at", end, "lo", "hi").collect()}
        assert len(got) == len(points)
        for symbol, i, at, until, lo, hi in points:
            path = [b for b in bars if b[0] == symbol and b[1] > at and (end is None or (until is not None and b[1] <= until))]
            hit = next((n for n, b in enumerate(path) if (lo is not None and b[4] <= lo) or (hi is not None and b[3] >= hi) or b[6]), len(path) - 1)
            r = got[i]
            if not path:
                assert r.found is None and r.path_low is None and r.path_high is None
            else:
                assert (r.found.ts, r.found.close) == (path[hit][1], path[hit][5])
                assert (r.path_low, r.path_high) == (min(b[4] for b in path[: hit + 1]), max(b[3] for b in path[: hit + 1]))


def test_path_search_of_an_empty_table(spark):
    df = spark.createDataFrame([("a", 1, T0, 1.0)], "symbol string, i int, at timestamp_ntz, lo double")
    index = pathsearch.build(spark.createDataFrame([], BARS))
    assert [r.found for r in pathsearch.first_touch(df, index, "at", None, "lo").collect()] == [None]


def test_path_search_joins_few_rows_of_a_long_path(spark):
    """A level that only the last of 20 000 bars reaches: the rows of the tree that the path meets are counted by the plan's joins."""
    bars = [("a", T0 + timedelta(minutes=i), 10.0, 10.0, 10.0 if i < 19_999 else 1.0, 10.0, False) for i in range(20_000)]
    index = pathsearch.build(spark.createDataFrame(bars, BARS))
    df = spark.createDataFrame([("a", 1, T0, 5.0)], "symbol string, i int, at timestamp_ntz, lo double")
    found = pathsearch.first_touch(df, index, "at", None, "lo")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(index.levels) == 3 and plan.count("__node") > 0
    assert plan.count("path-level") == 0 and plan.count("Join LeftOuter") <= 2 * len(index.levels) + 2
    assert found.first().found.low == 1.0 and index.levels[0].agg(F.max(F.size("kids"))).first()[0] == pathsearch.FAN


def greedy(rows):
    """rows (key, start, end, i) kept by a walk along each key."""
    kept = []
    for key in {r[0] for r in rows}:
        until = fresh = None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or T0, r[3])):
            if fresh is None or until is None or (r[1] is not None and r[1] > until):
                kept.append(r[3])
                fresh, until = True, r[2]
    return sorted(kept)


@pytest.mark.parametrize("size", [5, 64, 4096])
def test_selection_against_a_walk(spark, size):
    """Many pieces, ends before starts, missing times, ties, null keys; one long event over many pieces."""
    rng = random.Random(size)
    rows = []
    for i in range(900):
        key = rng.choice(["a", "a", "a", "b", None]) if i else "c"
        at = T0 + timedelta(hours=rng.randint(0, 900))
        end = at + timedelta(hours=rng.choice([-2, 0, 1, 1, 2, 3, 30]))
        rows.append((key, None if i % 97 == 1 else at, None if i % 89 == 2 else end, i))
    rows.append(("a", T0 + timedelta(hours=300, minutes=1), T0 + timedelta(hours=700), 5000))
    df = spark.createDataFrame(rows, "k string, s timestamp_ntz, e timestamp_ntz, i int")
    got = selection.non_overlapping(df, ["k"], "s", "e", "i", size=size)
    assert got.columns == df.columns and sorted(r.i for r in got.collect()) == greedy(rows)
    assert selection.non_overlapping(df.limit(0), ["k"], "s", "e", "i", size=size).count() == 0


def test_wavelet_matrix_against_sorting():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 300):
        values = rng.integers(0, max(1, n // 3), n).astype(float)
        tree = WaveletMatrix(values)
        begin = rng.integers(0, n, 200)
        end = np.minimum(begin + rng.integers(1, n + 1, 200), n)
        k = np.array([rng.integers(0, b - a) for a, b in zip(begin, end)])
        assert tree.kth(begin, end, k).tolist() == [sorted(values[a:b])[i] for a, b, i in zip(begin, end, k)]
        at = rng.integers(0, n, 200)
        assert tree.below(begin, end, tree.rank[at]).tolist() == [int((values[a:b] < values[i]).sum()) for a, b, i in zip(begin, end, at)]


@pytest.mark.parametrize("window,least,size", [(5, 2, 8), (50, 10, 64), (300, 1, 16)])
def test_sliding_statistics_against_pandas(spark, window, least, size):
    rng = random.Random(window)
    values = [None if rng.random() < 0.1 else rng.choice([1.0, 2.5, 3.0, rng.random()]) for _ in range(700)]
    rows = [("a", T0 + timedelta(minutes=i * 17), v, i) for i, v in enumerate(values)] + [("b", T0, 1.0, 9999), ("c", T0, None, 9998)]
    df = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, v double, i int")
    items = {"rank": Sliding("v", window, least), "median": Sliding("v", window, least, 0.5), "p9": Sliding("v", window, least, 0.9)}
    got = orderstats.sliding(df, items, size=size)
    assert got.columns == [*df.columns, *items]
    got = {r.i: r for r in got.collect()}
    assert len(got) == len(rows) and got[9999].median == (1.0 if least == 1 else None) and got[9998].median is None
    x = pd.Series(values, dtype=float)
    for name, q in (("median", 0.5), ("p9", 0.9)):
        want = x.rolling(window, min_periods=least).quantile(q)
        assert all((got[i][name] is None) if np.isnan(w) else abs(got[i][name] - w) < 1e-12 for i, w in enumerate(want))
    for i, v in enumerate(values):
        seen = [w for w in values[max(0, i - window + 1) : i + 1] if w is not None]
        want = None if v is None or len(seen) < least else (sum(w < v for w in seen) + (sum(w == v for w in seen) + 1) / 2) / len(seen)
        assert (got[i]["rank"] is None) == (want is None) and (want is None or abs(got[i]["rank"] - want) < 1e-12)


@pytest.mark.parametrize("block,fan", [(2, 2), (3, 4), (256, 256)])
def test_smoothing_over_many_levels(spark, block, fan):
    """Over 256 * 256 rows with blocks of 256; five levels and more with small ones; nulls at the start and over whole groups."""
    n = 70_000 if block == 256 else 150
    rng = np.random.default_rng(block)
    x, z = rng.normal(10, 3, n), rng.normal(0, 1, n)
    x[rng.random(n) < 0.2] = np.nan
    x[:40] = np.nan
    z[n // 3 : 2 * n // 3] = np.nan
    ts = pd.Timestamp(T0) + pd.to_timedelta(np.arange(n) * 60, unit="s")
    frame = pd.DataFrame({"symbol": "a", "bar_ts": ts, "i": np.arange(n), "x": x, "z": z})
    df = spark.createDataFrame(frame).select("symbol", F.col("bar_ts").cast("timestamp_ntz").alias("bar_ts"), "i", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "xz"])
    got = indicators.smooth(df, {"ex": ("x", 0.05), "ez": ("z", 0.3)}, block=block, fan=fan).toPandas().sort_values("i")
    for source, name, a in (("x", "ex", 0.05), ("z", "ez", 0.3)):
        y, want = np.nan, []
        for v in frame[source]:
            y = v if np.isnan(y) else y if np.isnan(v) else a * v + (1 - a) * y
            want.append(y)
        assert np.allclose(got[name].to_numpy(float), want, rtol=1e-10, atol=1e-12, equal_nan=True)


@pytest.mark.parametrize("bins,buffer", [(2, 1), (4, 3), (1024, 10_000)])
def test_quantiles_against_numpy(spark, bins, buffer):
    """Ties, one value, extremes of the double range, infinities, missing values, null keys."""
    rng = random.Random(bins)
    groups = {
        "ties": [rng.choice([1.0, 2.0, 2.0, 7.5]) for _ in range(200)],
        "one": [3.0] * 50,
        "wide": [1e308, -1e308, 1e-308, 0.0, -0.5, 2.5, 1e300, 5e-324],
        "infinite": [float("inf"), 1.0, 2.0, 3.0, float("-inf")],
        "single": [4.0],
        None: [rng.random() for _ in range(111)],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("ties", None), ("ties", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    at = {"low": 0.01, "mid": 0.5, "p8": 0.8, "top": 1.0}
    got = {r.k: r for r in selectk.quantiles(df, ["k"], "v", at, bins, buffer).collect()}
    assert set(got) == {*groups, "none"} and all(got["none"][name] is None for name in at)
    for k, values in groups.items():
        for name, p in at.items():
            x = sorted(values)
            place = p * (len(x) - 1)
            low, high, rest = x[int(place)], x[min(int(place) + 1, len(x) - 1)], place - int(place)
            want = low if rest == 0 else (1 - rest) * low + rest * high
            assert got[k][name] == want or abs(got[k][name] - want) <= 1e-12 * abs(want)


@pytest.mark.parametrize("size", [7, 40, 1 << 16])
def test_kendall_against_all_pairs(spark, size):
    rng = random.Random(size)
    rows = [("a", float(rng.randint(0, 9)), rng.choice([rng.random(), 0.5])) for _ in range(120)] + [("b", float(i), -float(i)) for i in range(30)]
    rows += [("c", 1.0, float(i)) for i in range(9)] + [(None, float(i % 4), float(i % 3)) for i in range(25)] + [("a", None, 1.0), ("b", 1.0, float("nan"))]
    got = {r.k: r.tau for r in selectk.kendall(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y", size=size).collect()}
    for k in ("a", "b", "c", None):
        p = [(x, y) for key, x, y in rows if key == k and x is not None and y == y]
        sign = lambda v: (v > 0) - (v < 0)
        pairs = [(sign(u[0] - v[0]), sign(u[1] - v[1])) for i, u in enumerate(p) for v in p[:i]]
        below = (sum(s != 0 for s, _ in pairs) * sum(t != 0 for _, t in pairs)) ** 0.5
        assert got[k] is None if not below else abs(got[k] - sum(s * t for s, t in pairs) / below) < 1e-12


def _pool(spark, n=700):
    rng = random.Random(n)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.gauss(5, 2), rng.choice(["hi", "lo", "lo", "mid"])) for i in range(n)] + [("c", n, 7.0, "hi"), ("a", n + 1, None, "hi")]
    return rows, spark.createDataFrame(rows, "k string, i bigint, v double, g string")


@pytest.mark.parametrize("size", [50, 4096])
def test_bootstrap_has_the_moments_of_resampling(spark, size):
    rows, df = _pool(spark)
    got = resample.bootstrap(df, ["k"], "v", "i", 2000, seed=3, size=size).toPandas()
    assert len(got) == 4 * 2000 and set(got["run"]) == set(range(1, 2001))
    for k in ("a", "b", None):
        v = np.array([r[2] for r in rows if r[0] == k and r[2] is not None])
        mean = got.loc[got["k"].isna() if k is None else got["k"] == k, "mean"].to_numpy()
        error = v.std() / len(v) ** 0.5
        assert abs(mean.mean() - v.mean()) < 4 * error / 2000**0.5 and abs(mean.std() / error - 1) < 0.08
        assert len(np.unique(mean)) > 1900
    assert (got.loc[got["k"] == "c", "mean"] == 7.0).all()
    again = resample.bootstrap(df.repartition(7), ["k"], "v", "i", 2000, seed=3, size=size).toPandas()
    by = ["k", "run"]
    assert np.allclose(got.sort_values(by)["mean"], again.sort_values(by)["mean"], rtol=1e-12)


@pytest.mark.parametrize("size", [50, 4096])
def test_permutation_deals_the_labels(spark, size):
    """Sums of a dealing: the mean is 0, the variance that of drawing without replacement; each row is high equally often."""
    rows, df = _pool(spark)
    got = resample.permutation(df, ["k"], "g", "v", "i", "hi", "lo", 2000, seed=5, size=size).toPandas()
    assert set(got["k"].fillna("null")) == {"a", "b", "null"} and len(got) == 3 * 2000
    for k in ("a", "b", None):
        v = np.array([r[2] for r in rows if r[0] == k and r[2] is not None and r[3] != "mid"])
        h = sum(r[0] == k and r[3] == "hi" and r[2] is not None for r in rows)
        edge = got.loc[got["k"].isna() if k is None else got["k"] == k, "edge"].to_numpy()
        sd = v.std(ddof=1) * (1 / h + 1 / (len(v) - h)) ** 0.5
        assert abs(edge.mean()) < 4 * sd / 2000**0.5 and abs(edge.std() / sd - 1) < 0.08


def test_resampling_moves_no_row_for_each_run(spark):
    """The exchanges of 5 000 runs carry one number for each block and run at most."""
    df = spark.range(20_000).select(F.lit("a").alias("k"), F.col("id").alias("i"), F.rand(1).alias("v"))
    got = resample.bootstrap(df, ["k"], "v", "i", 5000)
    assert got.count() == 5000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence(1, 5000" not in plan and "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("piece,max_age", [(16, 8), (4096, 8), (16, 2)])
def test_breakout_events_against_the_machine(spark, monkeypatch, piece, max_age):
    """Breakouts inside open events, on closing bars and at the end, across pieces; missing flags."""
    monkeypatch.setattr(state, "PIECE", piece)
    rng = random.Random(max_age)
    rows = []
    for symbol, n in (("a", 500), ("b", 90), ("c", 1)):
        for i in range(n):
            low = 10 + rng.random()
            bar = (rng.choice([True, False, False, None]), rng.choice([True] + [False] * 9 + [None]), low, 11 + rng.random(), 11 + rng.random())
            rows.append((symbol, T0 + timedelta(minutes=30 * i), *bar))
    df = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, breakout boolean, exit_signal boolean, low double, open double, close double")
    want = {}
    for symbol in "abc":
        now = BreakoutState()
        for _, ts, *bar in [r for r in rows if r[0] == symbol]:
            now, label = step(now, *bar, max_age=max_age)
            want[symbol, ts] = (now.number, label, now.age)
    got = state.breakout_events(df, max_age)
    assert got.columns == [*df.columns, "event_no", "event_state", "event_age"]
    got = {(r.symbol, r.bar_ts): (r.event_no, r.event_state, r.event_age) for r in got.collect()}
    assert got == want and {label for _, label, _ in want.values()} >= {"opened", "open", "entered", "invalid", "expired", "none"}


def test_frames_over_pieces_of_a_long_series(spark):
    """More bars than a piece has: channels, means and ranks at the seams equal those of one window."""
    bars = walk(9000, 11)
    df = spark.createDataFrame([(*b[:6], float(i % 7)) for i, b in enumerate(bars)], "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double")
    rows = indicators.event_factors(indicators.base_indicators(df), short=8, long=24, rank_n=60)
    got = rows.select("bar_ts", "upper", "exit_low", "atr", "ret_long", "atr_rank").toPandas().sort_values("bar_ts").reset_index(drop=True)
    x = pd.DataFrame(bars, columns=["symbol", "bar_ts", "open", "high", "low", "close", "flag"])
    before = x["close"].shift()
    tr = pd.concat([x["high"] - x["low"], (x["high"] - before).abs(), (x["low"] - before).abs()], axis=1).max(axis=1)
    want = {
        "upper": x["high"].shift().rolling(20).max(),
        "exit_low": x["low"].shift().rolling(10).min(),
        "atr": tr.rolling(14).mean(),
        "ret_long": x["close"] / x["close"].shift(24) - 1,
    }
    assert len(got) == 9000
    for name, w in want.items():
        assert np.allclose(got[name].astype(float), w, equal_nan=True, rtol=1e-9, atol=1e-9)
    assert got["atr_rank"].notna().sum() == 9000 - 13 - 49


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_from_day_to_day(spark, direction, strict):
    """Matches on the same day, many days off, at equal times and missing; null keys meet null keys."""
    rng = random.Random(4)
    at = lambda: T0 + timedelta(hours=6 * rng.randint(0, 60))
    left = [(rng.choice(["a", "b", None, "none"]), at(), i) for i in range(200)]
    right = [(rng.choice(["a", "a", "b", None]), at(), rng.randint(0, 5)) for _ in range(25)]
    got = asof.asof(spark.createDataFrame(left, "symbol string, t timestamp_ntz, i int"), spark.createDataFrame(right, "symbol string, u timestamp_ntz, v int"), "t", "u", ["u", "v"], direction, strict)
    found = {r.i: (r.u, r.v) for r in got.collect()}
    assert len(found) == len(left)
    for symbol, t, i in left:
        if direction == "backward":
            want = max(((u, v) for s, u, v in right if s == symbol and (u < t or u == t and not strict)), default=(None, None))
        else:
            want = min(((u, v) for s, u, v in right if s == symbol and (u > t or u == t and not strict)), default=(None, None))
        assert found[i] == want


def test_set_and_reset_from_day_to_day(spark):
    rng = random.Random(9)
    rows = [(s, T0 + timedelta(hours=5 * i), rng.choice([True, None] + [False] * 8), rng.choice([True, None] + [False] * 12)) for s in ("a", "b", None) for i in range(150)]
    df = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, up boolean, down boolean")
    got = {(r.symbol, r.bar_ts): (r.on, r.on_first, r.on_age) for r in state.set_reset(df, F.col("up"), F.col("down"), "on").collect()}
    assert len(got) == len(rows)
    for symbol in ("a", "b", None):
        on, age = 0, None
        for _, ts, up, down in [r for r in rows if r[0] == symbol]:
            now = 0 if down else 1 if up else on
            age = None if not now else age + 1 if on else 0
            assert got[symbol, ts] == (now, now == 1 and on == 0, age)
            on = now
