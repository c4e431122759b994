"""Micro-fixtures of the engine's operators, and pandas re-computations of folds and draws."""

import math
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, bars, indicators, labels, ledger, metrics, quality, ranking, selection, selectk, state, stats, validate
from tidemark.operators.machine import BreakoutState, step

T0 = datetime(2024, 1, 1)
MIN = timedelta(minutes=1)


def at(minutes):
    return T0 + minutes * MIN


BAR = "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double"


def make_bars(spark, rows):
    return spark.createDataFrame([("A", at(60 * i), *map(float, r), 1.0) for i, r in enumerate(rows)], BAR)


def test_strict_resample_needs_all_minutes(spark):
    rows = [("A", at(i), 1.0 + i, 2.0 + i, 0.5, 1.5 + i, 1.0) for i in range(15)] + [("A", at(15 + i), 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(14)]
    df = spark.createDataFrame(rows, BAR.replace("bar_ts", "ts"))
    got = bars.resample_bars(df, "15 minutes", complete=15).collect()
    assert [(r.bar_ts, r.open, r.high, r.low, r.close, r.volume) for r in got] == [(at(15), 1.0, 16.0, 0.5, 15.5, 15.0)]


def test_missing_islands(spark):
    df = spark.createDataFrame([("A", at(m)) for m in (0, 3, 5)], "symbol string, bar_ts timestamp_ntz")
    assert sorted(tuple(r) for r in quality.missing_islands(df, 60).collect()) == [("A", at(1), at(2), 2), ("A", at(4), at(4), 1)]


def test_first_touch_tie(spark):
    df = make_bars(spark, [(100, 100, 100, 100), (100, 111, 89, 100)]).withColumn("up", F.lit(110.0)).withColumn("down", F.lit(90.0))
    for tie in ("ambiguous", "minus"):
        got = df.withColumn("t", labels.first_touch("up", "down", 1, tie)).orderBy("bar_ts").collect()
        assert [r.t for r in got] == [tie, "none"]


def test_non_overlapping(spark):
    rows = [("A", 1, at(0), at(60)), ("A", 2, at(30), at(120)), ("A", 3, at(61), at(180)), ("B", 4, at(0), at(5)), ("B", 5, at(5), at(9))]
    df = spark.createDataFrame(rows, "symbol string, i long, s timestamp_ntz, e timestamp_ntz")
    assert sorted(r.i for r in selection.non_overlapping(df, ["symbol"], "s", "e", "i").collect()) == [1, 3, 4]


def test_sequence_metrics(spark):
    df = spark.createDataFrame([("A", i, at(i), at(i + 1), p, p / 1000) for i, p in enumerate([100.0, -50.0, 25.0])], "symbol string, trade_id int, entry_time timestamp_ntz, exit_time timestamp_ntz, net_pnl double, ret double")
    got = metrics.trade_summary(df, ["symbol"], 1000.0).first()
    assert got.profit_factor == 2.5 and got.total_return == 0.075


@pytest.mark.parametrize("variant,want", [("a", math.inf), ("b", math.inf), ("d", 3.0)])
def test_profit_factor_without_losses(spark, variant, want):
    df = spark.createDataFrame([(1.0,), (2.0,)], "p double")
    assert df.agg(metrics.profit_factor("p", variant).alias("x")).first().x == want
    empty = spark.createDataFrame([(0.0,)], "p double").agg(metrics.profit_factor("p", variant).alias("x")).first().x
    assert empty == {"a": 0.0, "b": None, "d": 0.0}[variant]


def test_percentile_against_reference(spark):
    ref = spark.createDataFrame([("A", v) for v in (1.0, 2.0, None, 3.0)], "symbol string, r double")
    got = ranking.percentile_of(spark.createDataFrame([("A", 2.0)], "symbol string, v double"), ref, ["symbol"], "v", "r").first()
    assert round(got.pct, 2) == 66.67


def test_containment(spark):
    seg = spark.createDataFrame([("A", 1, at(0), at(240), 100.0)], "symbol string, segment_id int, segment_start timestamp_ntz, segment_end timestamp_ntz, start_price double")
    pts = spark.createDataFrame([("A", at(60), 110.0), ("A", at(300), 1.0)], "symbol string, ts timestamp_ntz, price double")
    got = {r.ts: r for r in asof.containment(pts, seg, "ts", "segment_start", "segment_end", ["segment_id", "segment_end", "start_price"]).collect()}
    assert got[at(60)].mapped and got[at(60)].segment_id == 1 and not got[at(300)].mapped and got[at(300)].segment_id is None


def test_liquidation_price(spark):
    df = spark.createDataFrame([(100.0, "LONG"), (100.0, "SHORT")], "p double, side string")
    assert [round(r.x, 6) for r in df.select(ledger.liquidation_price(F.col("p"), 10.0, F.col("side")).alias("x")).collect()] == [90.5, 109.5]


def test_unknown_side_raises(spark):
    df = spark.createDataFrame([(100.0, "UP")], "p double, side string")
    with pytest.raises(Exception, match="unknown side"):
        df.select(ledger.fill_price(F.col("p"), F.col("side"), 0.1, True)).collect()


@pytest.mark.parametrize("n,sizes", [(52, [11, 10, 10, 10, 11])])
def test_quintile_sizes(spark, n, sizes):
    df = spark.createDataFrame([("A", i, float(i)) for i in range(n)], "symbol string, i int, v double")
    got = ranking.quintiles(df, ["symbol"], "v", "i").groupBy("quintile").count().orderBy("quintile").collect()
    assert [r["count"] for r in got] == sizes
    cut = pd.qcut(pd.Series(range(n)).rank(method="first"), 5, labels=False).value_counts().sort_index()
    assert cut.tolist() == sizes
    assert ranking.quintiles(df.limit(49), ["symbol"], "v", "i").where("quintile is not null").count() == 0


def test_compounding(spark):
    df = spark.createDataFrame([("A", i, r) for i, r in enumerate([0.05, -0.02, 0.10, -0.30])], "symbol string, i int, ret double")
    got = ledger.compound(df, ["symbol"], ["i"], "ret", 1000.0).orderBy("i").collect()
    assert [round(r.balance_after, 6) for r in got] == [1050.0, 1029.0, 1131.9, 792.33]
    assert [round(r.balance_before, 6) for r in got] == [1000.0, 1050.0, 1029.0, 1131.9]
    wiped = ledger.compound(df.withColumn("ret", F.when(F.col("i") == 1, -1.0).otherwise(F.col("ret"))), ["symbol"], ["i"], "ret", 1000.0)
    assert [r.balance_after for r in wiped.orderBy("i").collect()][1:] == [0.0, 0.0, 0.0]


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "f string, p double")
    got = {r.f: round(r.q_value, 6) for r in stats.benjamini_hochberg(df, [], "p", "f").collect()}
    assert got == {"a": 0.03, "b": 0.04, "c": 0.04}


def test_p_value_of_an_edge_beyond_all_draws(spark):
    edges = spark.createDataFrame([("A", i, 0.0) for i in range(9)], "k string, run int, edge double")
    seen = spark.createDataFrame([("A", 1.0)], "k string, edge double")
    assert stats.p_values(edges, seen, ["k"]).first().p_value == 0.1


@pytest.mark.parametrize("n,block", [(1, 4), (4, 4), (57, 4), (600, 256)])
def test_smoothing_equals_pandas(spark, n, block):
    rng = random.Random(n)
    values = [rng.uniform(1, 9) if i == 0 or rng.random() > 0.1 else None for i in range(n)]
    df = spark.createDataFrame([("A", at(i), v, i) for i, v in enumerate(values)] + [("B", at(0), 5.0, 0)], "symbol string, bar_ts timestamp_ntz, close double, extra int")
    got = indicators.smooth(df, {"e": ("close", 0.2), "f": ("close", 0.5)}, block=block)
    rows = got.where("symbol = 'A'").orderBy("bar_ts").collect()
    y = None
    for v, r in zip(values, rows):
        y = v if y is None else y if v is None else 0.2 * v + 0.8 * y
        assert abs(r.e - y) < 1e-9
    if None not in values:
        want = pd.Series(values).ewm(alpha=0.5, adjust=False).mean().tolist()
        assert all(abs(r.f - w) < 1e-9 for r, w in zip(rows, want))
    blank = spark.createDataFrame([("C", at(i), 1.0 if i == 3 else None) for i in range(6)], "symbol string, bar_ts timestamp_ntz, close double")
    assert [r.e for r in indicators.smooth(blank, {"e": ("close", 0.2)}, block=2).orderBy("bar_ts").collect()] == [None] * 3 + [1.0] * 3
    assert got.where("symbol = 'B'").first().e == 5.0 and got.columns == [*df.columns, "e", "f"]


def test_labels_are_the_only_columns_that_look_ahead(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(120):
        o, c = rng.uniform(90, 110), rng.uniform(90, 110)
        rows.append((o, max(o, c) + rng.random(), min(o, c) - rng.random(), c))
    def run(k):
        out = indicators.event_factors(indicators.base_indicators(make_bars(spark, rows[:k])), short=4, long=12, rank_n=60)
        return {r.bar_ts: tuple(r) for r in out.collect()}
    whole, part = run(120), run(90)
    assert all(whole[t] == part[t] or all(a == b or abs(a - b) < 1e-9 for a, b in zip(whole[t][2:], part[t][2:]) if a is not None) for t in part)


def test_asof_directions_and_ties(spark):
    left = spark.createDataFrame([("A", at(m)) for m in (0, 5, 10, 15)], "symbol string, t timestamp_ntz")
    right = spark.createDataFrame([("A", at(5), 1), ("A", at(10), 2), ("A", at(10), 3)], "symbol string, u timestamp_ntz, v int")
    def run(**k):
        return [r.v for r in asof.asof(left, right, "t", "u", ["v"], **k).orderBy("t").collect()]
    assert run() == [None, 1, 3, 3]
    assert run(strict=True) == [None, None, 1, 3]
    assert run(direction="forward") == [1, 1, 2, None]
    assert run(direction="forward", strict=True) == [1, 2, None, None]


def test_target_and_stop_in_one_bar_is_a_stop(spark):
    df = make_bars(spark, [(100, 100, 100, 100), (100, 130, 80, 100), (100, 100, 100, 101)])
    e = spark.createDataFrame([("A", "x", at(0), 100.0, 120.0, 90.0), ("A", "y", at(60), 100.0, 120.0, 90.0)], "symbol string, event_id string, entry_time timestamp_ntz, entry_price double, target double, stop double")
    got = {r.event_id: (r.exit_reason, r.exit_price) for r in ledger.resolve_target_exits(e, df, 7200).collect()}
    assert got == {"x": ("stop", 90.0), "y": ("time", 101.0)}


def test_short_whose_price_falls_to_zero_gains_without_bound(spark):
    rows = [("SHORT", 0.1, 0.25, -1.0), ("SHORT", -1.0, -1.0, -1.0), ("LONG", 0.1, 0.25, -1.0), ("SHORT", 0.1, 0.25, -0.5), ("SHORT", None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, side string, fwd_ret_2 double, fwd_mfe_2 double, fwd_mae_2 double")
    got = [(r.dir_mfe_2, r.dir_mae_2) for r in labels.directional(df, [2]).orderBy("i").collect()]
    assert got == [(math.inf, 1 / 1.25 - 1), (math.inf, math.inf), (0.25, -1.0), (1.0, 1 / 1.25 - 1), (None, None)]


def test_leveraged_fold_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [("A", i, rng.uniform(-0.3, 0.3)) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, i int, ret double")
    got = [r.equity_after for r in ledger.leveraged_fold(df, ["symbol"], ["i"], "ret", {"m": [4, 2, 1]}, 100.0).orderBy("i").collect()]
    eq = peak = 100.0
    last = []
    for (_, _, r), have in zip(rows, got):
        x = 1 if eq < 0.8 * peak else 2 if sum(v <= 0 for v in last) >= 2 else 4
        eq *= 0.05 if r * x <= -0.95 else 1 + r * x
        peak, last = max(peak, eq), [*last, r][-3:]
        assert math.isclose(eq, have)


def test_leveraged_fold_goes_on_from_piece_to_piece(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.uniform(-0.3, 0.3)) for k in ("A", None) for i in range(50 if k else 21)]
    df = spark.createDataFrame(rows, "symbol string, i int, ret double")
    fold = lambda size: sorted(ledger.leveraged_fold(df, ["symbol"], ["i"], "ret", {"m": [4, 2, 1], "n": [2, 2, 2]}, 100.0, size=size).collect(), key=str)
    whole = fold(1000)
    assert len(whole) == 142 and fold(20) == whole
    assert ledger.leveraged_fold(df.where("i < 0"), ["symbol"], ["i"], "ret", {"m": [4, 2, 1]}, 100.0).count() == 0


@pytest.mark.parametrize("drift", [0.3, 0.0, -0.3])
def test_shuffled_drawdowns_in_buckets_equal_a_loop(spark, monkeypatch, drift):
    monkeypatch.setattr(stats, "BUCKET_ROWS", 8)
    rng = random.Random(3)
    rows = [(k, 3 * i, rng.gauss(drift, 1)) for k, n in (("A", 300), (None, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, id long, v double")
    got = {(r.symbol, r.run): (r.net, r.max_drawdown) for r in stats.shuffled_drawdowns(df, ["symbol"], "v", "id", 20.0, 4).collect()}
    assert len(got) == 8
    for (k, run), (net, deepest) in got.items():
        values = [v for s, _, v in rows if s == k]
        drawn = sorted(((((run * 48271 + i * 69621 + 12345) % stats.PRIME) * 40692 + run * 7919 + i) % stats.PRIME, i) for i in range(1, len(values) + 1))
        eq = peak = 20.0
        worst = 0.0
        for _, i in drawn:
            eq += values[i - 1]
            peak = max(peak, eq)
            worst = min(worst, eq / peak - 1)
        assert math.isclose(net, sum(values), abs_tol=1e-9) and math.isclose(deepest, worst, abs_tol=1e-9)


def test_breakout_machine():
    s = BreakoutState()
    seen = []
    for bar in [(True, False, 10, 9, 11), (False, False, 9, 10, 9.5), (False, False, 9.2, 9.3, 9.9), (False, False, 9, 9, 9), (True, False, 9, 9, 9), (False, True, 8, 9, 9)]:
        s, label = step(s, *bar)
        seen.append(label)
    assert seen == ["opened", "open", "entered", "none", "opened", "invalid"]


def test_draws_cover_their_range(spark):
    df = spark.range(1, 2001).select(stats.draw(F.col("id"), F.lit(7).cast("bigint"), F.lit(10).cast("bigint")).alias("d"))
    counts = [r["count"] for r in df.groupBy("d").count().collect()]
    assert len(counts) == 10 and min(counts) > 120


def test_fit_uses_only_its_rows(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "i int, f double")
    params = validate.fit(df.where("i < 50"), ["f"])
    z = validate.standardise(df.where("i >= 50"), ["i"], ["f"], params)
    assert z.select("z").distinct().count() == 1  # all lie beyond the upper bound


def test_walk_forward_windows(spark):
    df = spark.createDataFrame([(datetime(2023, 1, 15),), (datetime(2024, 12, 3),)], "t timestamp_ntz")
    got = [(r.window_id, str(r.train_start), str(r.test_start), str(r.test_end)) for r in validate.walk_forward(df, "t", 12, 3, 3).collect()]
    assert got[0] == (0, "2023-01-01", "2024-01-01", "2024-04-01") and len(got) == 4


def test_kendall_of_a_perfect_order(spark):
    df = spark.createDataFrame([("A", i, i * i) for i in range(6)], "k string, a int, b int")
    assert selectk.kendall(df, ["k"], "a", "b").first().tau == 1.0
