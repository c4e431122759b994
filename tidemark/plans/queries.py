"""Registered queries: each applies operators to the driver's tables; SQL oracles are in oracles.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, bars, indicators, labels, ledger, metrics, patterns, quality, ranking, selection, selectk, state, stats, studies, validate
from tidemark.plans.inputs import bars_of, table, ticks, trades
from tidemark.scratch import written

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ------------------------------------------------------------------ bars and quality


@query
def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(spark, sf_dir)


@query
def bars_left_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.resample_ticks(ticks(spark, sf_dir), "4 hours", label="open")


@query
def bars_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = bars.resample_ticks(ticks(spark, sf_dir), "1 hour", label="open").withColumnRenamed("bar_ts", "ts")
    return bars.resample_bars(hourly, "4 hours", complete=4)


@query
def bars_timeframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.timeframes(ticks(spark, sf_dir), {"1h": 3600, "4h": 14400, "1d": 86400})


@query
def bar_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.boundary_flags(ticks(spark, sf_dir), 15).select("event_id", "bar_start", "last_minute")


@query
def trade_period_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.period_keys(trades(spark, sf_dir).select("trade_id", "exit_time"), "exit_time").drop("exit_time")


@query
def monthly_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    m = t.groupBy("symbol", "exit_reason", "n_lines", F.date_format("exit_time", "yyyy-MM").alias("month")).agg(F.round(F.sum("net_pnl"), 4).alias("net"))
    return bars.month_spine(m, ["symbol", "exit_reason", "n_lines"], "month", ["net"])


@query
def month_end_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ledger.equity_curve(trades(spark, sf_dir), ["symbol"], ["exit_time", "trade_id"], "net_pnl", 1e6)
    e = e.groupBy("symbol", "exit_time").agg(F.max_by("equity", "trade_id").alias("equity"))
    return r6(bars.month_end_returns(e, ["symbol"], "exit_time", "equity"), "equity", "ret")


def _dirty(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = ticks(spark, sf_dir)
    again = t.where("event_id % 97 = 0").withColumn("price", F.col("price") + 1)
    return t.where("event_id % 53 <> 0"), again.where("event_id % 53 <> 0")


@query
def merge_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.merge_sources(list(_dirty(spark, sf_dir)), ["symbol", "ts"], "event_id")


@query
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _dirty(spark, sf_dir)
    return quality.duplicates(a.unionByName(b), ["symbol", "ts"])


@query
def invalid_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_of(spark, sf_dir).withColumn("high", F.when(F.hour("bar_ts") == 3, F.col("low") - 1).otherwise(F.col("high")))
    return quality.invalid_bars(b)


@query
def bar_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.gaps(bars_of(spark, sf_dir), 3600)


@query
def missing_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_islands(bars_of(spark, sf_dir), 3600)


@query
def price_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(quality.jumps(bars_of(spark, sf_dir), 0.5).select("symbol", "bar_ts", "close", "change"), "change")


@query
def robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.robust_outliers(bars_of(spark, sf_dir), window=48, least=24, scale=3.0)
    return r6(found.select("symbol", "bar_ts", "close", "median", "dev", "limit"), "median", "dev", "limit")


@query
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.completeness(bars_of(spark, sf_dir), 3)


@query
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.coverage(bars_of(spark, sf_dir), 28)


@query
def coverage_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = bars_of(spark, sf_dir).withColumn("file", F.concat(F.lit("part"), (F.day("bar_ts") % 3).cast("string")))
    files = files.groupBy("symbol", "file").agg(F.min("bar_ts").alias("start_ts"), F.max("bar_ts").alias("end_ts"))
    return quality.coverage_decision(files, "2024-01-10", 18)


@query
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_of(spark, sf_dir)
    expected = b.select("symbol").unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("symbol")))
    return quality.freshness(b, expected, "2024-01-30 12:00:00")


@query
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars_of(spark, sf_dir).withColumn("volume", F.when(F.col("volume") > 1, F.col("volume")))
    return r6(quality.column_profile(rows, ["open", "close", "volume"]), "missing_rate", "min", "p05", "p50", "p95", "max")


@query
def leak_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.no_overlap_guard(bars_of(spark, sf_dir), "bar_ts", "2024-01-02")


@query
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").withColumn("event_type", F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("event_type")))
    return quality.required_fields(t, ["event_id", "event_type", "value"])


@query
def stage_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    return quality.stage_inputs(t, 100, F.col("price") < 0, ["error", "click", "view", "none"])


@query
def ledger_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ledger.equity_curve(trades(spark, sf_dir), ["symbol"], ["exit_time", "trade_id"], "net_pnl", 1e6)
    t = t.withColumn("balance_after", F.col("equity")).withColumn("balance_before", F.col("equity") - F.col("net_pnl"))
    return quality.ledger_invariant(t, ["symbol"]).select("symbol", "passed")


@query
def execution_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_of(spark, sf_dir)
    t = b.where(F.hour("bar_ts") % 5 == 0).select("symbol", F.col("bar_ts").alias("execution_time"), F.when(F.hour("bar_ts") == 5, F.col("open") + 1).otherwise(F.col("open")).alias("entry_price"), F.hash("symbol").alias("trade_id"))
    return quality.execution_audit(t, b).select("symbol", "execution_time", "entry_is_open", "duplicate_entry")


@query
def baseline_fairness(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    return quality.baseline_fairness(t.where("net_pnl > 0"), t.where("net_pnl <= 0"), ["symbol", "side"])


@query
def ledger_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    other = t.where("trade_id % 7 <> 0").withColumn("net_pnl", F.when(F.col("trade_id") % 5 == 0, F.col("net_pnl") + 1).otherwise(F.col("net_pnl")))
    d = quality.ledger_diff(t.where("trade_id % 11 <> 0"), other, ["symbol", "trade_id"], "net_pnl")
    return d.groupBy("symbol", "kind").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ indicators, patterns, states


def signal_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.base_indicators(bars_of(spark, sf_dir))
    return patterns.trend_signals(rows)


@query
def base_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal_frame(spark, sf_dir)
    cols = ["tr", "atr", "upper", "exit_low", "ema_fast", "ema_slow", "volume_mean"]
    return r6(rows.select("symbol", "bar_ts", *cols, "breakout", "exit_signal"), *cols)


@query
def event_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.event_factors(signal_frame(spark, sf_dir), short=8, long=24, rank_n=60)
    cols = ["ret_short", "ret_long", "slow_slope", "ema_gap", "breakout_distance", "channel_width", "atr_rank", "volatility_ratio", "volume_z", "efficiency", "compression", "body", "upper_wick", "close_location"]
    return r6(rows.select("symbol", "bar_ts", *cols), *cols)


@query
def mean_reversion_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.mean_reversion(signal_frame(spark, sf_dir))
    cols = ["range_upper", "range_lower", "range_mid", "trend_strength", "deviation"]
    return r6(rows.select("symbol", "bar_ts", *cols), *cols)


@query
def wilder_rsi_adx(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.wilder(bars_of(spark, sf_dir))
    return r6(rows.select("symbol", "bar_ts", "rsi", "wilder_atr", "adx"), "rsi", "wilder_atr", "adx")


@query
def local_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["move_3", "move_6", "move_12", "to_swing_high", "to_swing_low"]
    return r6(indicators.local_trend(signal_frame(spark, sf_dir)).select("symbol", "bar_ts", *cols, "higher_highs", "lower_lows"), *cols)


@query
def volume_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.volume_features(bars_of(spark, sf_dir))
    return r6(rows.select("symbol", "bar_ts", "volume_vs_median", "volume_vs_mean"), "volume_vs_median", "volume_vs_mean")


@query
def pair_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(indicators.pair_ratio(bars_of(spark, sf_dir), "click", "view", n=48), "ratio", "z")


@query
def day_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.day_change(bars_of(spark, sf_dir), 24)
    return r6(rows.select("symbol", "bar_ts", "change_24h", "quote_volume_24h"), "change_24h", "quote_volume_24h")


@query
def regime_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.event_factors(signal_frame(spark, sf_dir), short=8, long=24, rank_n=60)
    return indicators.regimes(rows).select("symbol", "bar_ts", "trend_regime", "volatility_regime")


@query
def candle_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.candle_metrics(signal_frame(spark, sf_dir))
    return patterns.candle_events(rows).select("symbol", "bar_ts", "pattern")


@query
def hikkake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.hikkake(bars_of(spark, sf_dir)).select("symbol", "bar_ts", "inside", "hikkake_setup", "hikkake_confirm")


@query
def mean_reversion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.mean_reversion(signal_frame(spark, sf_dir))
    return patterns.mean_reversion_candidates(rows).select("symbol", "bar_ts", "candidate", "side")


@query
def entry_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patterns.hikkake(indicators.candle_metrics(signal_frame(spark, sf_dir)))
    modes = {"B0": F.col("breakout"), "B1": F.col("breakout") & patterns.strong_bar(), "B3": F.col("hikkake_confirm") & (F.col("ema_fast") > F.col("ema_slow"))}
    return patterns.entry_modes(rows, modes).select("symbol", "bar_ts", "entry_mode")


@query
def momentum_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.volume_features(indicators.wilder(bars_of(spark, sf_dir)))
    checks = [("rsi", F.col("rsi").between(50, 90)), ("adx", F.col("adx").between(5, 60)), ("volume", F.col("volume_vs_mean") >= 1.1)]
    rows = patterns.momentum_signal(rows, checks)
    return rows.groupBy("symbol", F.coalesce("reject_reason", F.lit("pass")).alias("reason")).agg(F.count("*").alias("n"))


@query
def breakout_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.set_reset(signal_frame(spark, sf_dir), F.col("breakout"), F.col("exit_signal"), "active")
    return rows.select("symbol", "bar_ts", "active", "active_first", "active_age")


@query
def trend_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.set_reset(signal_frame(spark, sf_dir), F.col("breakout"), F.col("exit_signal"), "active")
    out = state.segments(rows, "active")
    return r6(out, "segment_return", "run_up", "drawdown")


@query
def post_exit_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.set_reset(signal_frame(spark, sf_dir), F.col("breakout"), F.col("exit_signal"), "active")
    return state.post_exit_phase(rows, "active").select("symbol", "bar_ts", "bars_since_exit", "phase")


@query
def breakout_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.breakout_events(signal_frame(spark, sf_dir))
    return rows.groupBy("symbol", "event_state").agg(F.count("*").alias("n"), F.max("event_no").alias("events"))


@query
def losing_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    longest = state.longest_run(t, ["symbol"], ["exit_time", "trade_id"], F.col("net_pnl") <= 0, "longest_streak")
    many = state.loss_streaks(t, ["symbol"], ["exit_time", "trade_id"], "net_pnl").groupBy("symbol").agg(F.count("*").alias("n_streaks"), F.round(F.min("total"), 4).alias("worst_total"))
    return longest.join(many, "symbol", "left")


@query
def underwater(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ledger.equity_curve(trades(spark, sf_dir), ["symbol"], ["exit_time", "trade_id"], "net_pnl", 1e6)
    return state.underwater(e.withColumn("equity", F.round("equity", 2)), ["symbol"], ["exit_time", "trade_id"], "equity")


@query
def trading_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.trading_pause(trades(spark, sf_dir), ["symbol"], ["exit_time", "trade_id"], "net_pnl")
    return rows.groupBy("symbol", "paused").agg(F.count("*").alias("n"))


@query
def daily_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(state.daily_universe(bars_of(spark, sf_dir), 3), "quote_volume")


@query
def non_overlapping_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).select("symbol", "side", "trade_id", "entry_time", "exit_time")
    return selection.non_overlapping(t, ["symbol", "side"], "entry_time", "exit_time", "trade_id")


# ------------------------------------------------------------------ joins and labels


def _events(spark: SparkSession, sf_dir: str, signals: DataFrame | None = None) -> DataFrame:
    rows = (signal_frame(spark, sf_dir) if signals is None else signals).where("breakout and atr is not null")
    ident = F.concat_ws("_", "symbol", F.date_format("bar_ts", "yyyyMMddHH"))
    return rows.select(ident.alias("event_id"), "symbol", F.col("bar_ts").alias("signal_time"), "close", "atr", "ema_slow")


@query
def next_open_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("signal_time", F.expr("signal_time + interval 20 minutes"))
    return asof.next_open(e.select("event_id", "symbol", "signal_time"), bars_of(spark, sf_dir))


@query
def regime_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = patterns.trend_signals(indicators.base_indicators(bars_of(spark, sf_dir, "4 hours"), fast=5, slow=20, channel=10, exit_channel=5))
    four = indicators.regimes(four.withColumn("atr_rank", F.lit(None).cast("double"))).select("symbol", F.col("bar_ts").alias("regime_ts"), "trend_regime")
    return asof.regime_join(_events(spark, sf_dir).select("event_id", "symbol", "signal_time"), four, "signal_time", "regime_ts", ["trend_regime"])


@query
def path_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("until", F.expr("signal_time + interval 6 hours"))
    p = ticks(spark, sf_dir)
    rows = asof.interval_join(e.select("event_id", "symbol", "signal_time", "until"), p, "signal_time", "until", "ts", 14400, ["price"])
    return rows.groupBy("event_id").agg(F.count("*").alias("n"), F.max("price").alias("hi"), F.min("price").alias("lo"), F.max_by("price", "path_ts").alias("last"))


@query
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.set_reset(signal_frame(spark, sf_dir), F.col("breakout"), F.col("exit_signal"), "active")
    seg = state.segments(rows, "active").select("symbol", "segment_id", "segment_start", "segment_end", "start_price")
    t = ticks(spark, sf_dir).select("symbol", "event_id", "ts", "price")
    out = asof.containment(t, seg, "ts", "segment_start", "segment_end", ["segment_id", "segment_end", "start_price"])
    pos = F.expr("timestampdiff(SECOND, segment_start, ts)") / F.nullif(F.expr("timestampdiff(SECOND, segment_start, segment_end)"), F.lit(0))
    return out.select("symbol", "event_id", "mapped", "segment_id", F.round(pos, 6).alias("position"))


@query
def fallback_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumn("month", F.date_format("entry_time", "yyyy-MM"))
    # each trade against the partly filled ones of its month, else of all months
    out = asof.match_with_fallback(t.select("trade_id", "symbol", "side", "month"), t.where("exit_reason = 'P'"), ["symbol", "side", "month"], ["symbol", "side"], "net_pnl")
    return r6(out, "match_mean")


@query
def overlapping_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.overlap_counts(trades(spark, sf_dir), ["symbol", "side"], "entry_time", "exit_time")


@query
def portfolio_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ledger.equity_curve(trades(spark, sf_dir), ["symbol"], ["exit_time", "trade_id"], "net_pnl", 1e6)
    e = e.groupBy("symbol", "exit_time").agg((F.max_by("equity", "trade_id") / 1e6).alias("growth"))
    return r6(asof.portfolio_curve(e, "exit_time", "symbol", "growth"), "growth")


@query
def forward_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.forward_labels(bars_of(spark, sf_dir), [1, 4, 8])
    cols = [c for c in rows.columns if c.startswith("fwd_")]
    return r6(rows.select("symbol", "bar_ts", *cols), *cols)


@query
def directional_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.mean_reversion(signal_frame(spark, sf_dir))
    rows = patterns.mean_reversion_candidates(labels.forward_labels(rows, [8]))
    rows = labels.directional(rows, [8])
    return r6(rows.select("symbol", "bar_ts", "candidate", "side", "dir_ret_8", "dir_mfe_8", "dir_mae_8"), "dir_ret_8", "dir_mfe_8", "dir_mae_8")


@query
def first_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal_frame(spark, sf_dir).withColumn("up", F.col("close") + F.col("atr")).withColumn("down", F.col("close") - F.col("atr") / 2)
    rows = rows.withColumn("touch", labels.first_touch("up", "down", 8)).where("breakout")
    return rows.select("symbol", "bar_ts", "touch")


@query
def bars_to_reversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal_frame(spark, sf_dir)
    n = labels.bars_to_target(F.col("ema_slow"), F.col("close") < F.col("ema_slow"), 16)
    return rows.withColumn("bars_to_mean", n).withColumn("breakout_ahead", labels.any_ahead("breakout", 16)).select("symbol", "bar_ts", "bars_to_mean", "breakout_ahead")


@query
def path_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = ticks(spark, sf_dir).withColumn("high", F.col("price")).withColumn("low", F.col("price"))
    out = labels.path_windows(_events(spark, sf_dir), points, [3600, 14400, 28800], "signal_time", "close", ["symbol", "event_id"], 14400)
    out = labels.safety(out, [2, 5])
    return r6(out, "mfe", "mae")


# ------------------------------------------------------------------ ledger and metrics


@query
def trade_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("entry_price"), F.max("l_extendedprice").alias("exit_price"), F.sum("l_quantity").alias("quantity"))
    o = o.withColumn("side", F.when(F.col("l_orderkey") % 2 == 0, "LONG").otherwise("SHORT"))
    cols = ["entry_fill", "exit_fill", "fees", "slippage_cost", "gross_pnl", "net_pnl"]
    return o.select("l_orderkey", "entry_price", "exit_price", "quantity", "side").transform(ledger.costs, 0.00037, 0.00053).select("l_orderkey", *[F.round(c, 2 if c == "net_pnl" else 7).alias(c) for c in cols])


@query
def exit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(signal_frame(spark, sf_dir), "signals")
    e = asof.next_open(_events(spark, sf_dir, rows), rows, strict=True).where("execution_open is not null")
    e = e.select("event_id", "symbol", F.col("execution_time").alias("entry_time"), F.col("execution_open").alias("entry_price"), (F.col("execution_open") - F.col("atr")).alias("stop"))
    out = ledger.resolve_exits(e, rows, "exit_signal", "stop")
    return r6(out, "entry_price", "stop", "exit_price")


@query
def target_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "symbol", F.col("signal_time").alias("entry_time"), F.col("close").alias("entry_price"), (F.col("close") + F.col("atr")).alias("target"), (F.col("close") - F.col("atr") / 2).alias("stop"))
    return r6(ledger.resolve_target_exits(e, bars_of(spark, sf_dir), 8 * 3600), "entry_price", "target", "stop", "exit_price")


@query
def compounded_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).select("symbol", "side", "trade_id", "entry_time", "exit_time", "ret")
    out = ledger.backtest(t, ["symbol", "side"], "ret", 1000.0, "trade_id")
    return r6(out, "ret", "balance_before", "balance_after")


@query
def leveraged_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).select("symbol", "trade_id", "exit_time", "ret")
    out = ledger.leveraged_fold(t, ["symbol"], ["exit_time", "trade_id"], "ret", {"fixed": [3, 3, 3], "adaptive": [5, 2, 1]}, 1000.0)
    return out.groupBy("symbol", "mode").agg(F.count("*").alias("n"), F.count_if("liquidated").alias("n_liquidated"), F.round(F.max_by(F.log("equity_after"), F.struct("exit_time", "trade_id")), 4).alias("log_final"), F.round(F.avg("leverage"), 6).alias("mean_leverage"))


@query
def cost_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumn("fee_rate", F.col("total_fee") / F.col("notional"))
    out = ledger.stress(t).groupBy("symbol", "scenario").agg(F.round(F.avg("stressed_ret"), 8).alias("mean_ret"), F.count_if(F.col("stressed_ret") > 0).alias("n_wins"))
    return out


@query
def cost_multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.cost_multiples(trades(spark, sf_dir), [1, 1.5, 2])
    return r6(out.groupBy("symbol", "multiple").agg(metrics.profit_factor("adjusted_pnl", "b").alias("profit_factor"), F.sum("adjusted_pnl").alias("net")), "profit_factor").withColumn("net", F.round("net", 2))


@query
def trade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.trade_summary(trades(spark, sf_dir), ["symbol", "side"], 1e6)
    money = ["net", "gains", "losses", "avg_trade", "avg_win", "avg_loss", "best", "worst", "median_trade"]
    out = out.withColumns({c: F.round(c, 3) for c in money})
    return r6(out, "profit_factor", "geo_mean", "win_rate", "payoff", "total_return", "days", "annual_return")


@query
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ledger.equity_curve(trades(spark, sf_dir), ["symbol"], ["exit_time", "trade_id"], "net_pnl", 1e6)
    return r6(metrics.max_drawdown(e, ["symbol"], ["exit_time", "trade_id"], "equity"), "max_drawdown")


@query
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.concentration(trades(spark, sf_dir), ["symbol"], "net_pnl", "trade_id", [1, 5, 10]), "top_1_share", "top_5_share", "top_10_share")


@query
def quarterly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat(F.year("exit_time").cast("string"), F.lit("Q"), F.quarter("exit_time").cast("string"))
    out = metrics.period_summary(trades(spark, sf_dir), ["symbol"], q, ["exit_time", "trade_id"], 1e6)
    return r6(out, "period_return", "profit_factor", "win_rate", "max_drawdown").withColumn("net", F.round("net", 2))


@query
def grouping_sets_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    out = metrics.grouped_summary(t, [[], ["symbol"], ["side"], ["symbol", "side"], ["exit_reason"]], "net_pnl")
    return r6(out.withColumn("mean", F.round("mean", 3)).withColumn("median", F.round("median", 3)), "positive_rate", "profit_factor")


@query
def holding_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.holding_buckets(trades(spark, sf_dir), ["symbol"], [0, 48, 96, 144]).drop("counts")
    return out.withColumn("net", F.round("net", 2)).withColumn("mean", F.round("mean", 3))


@query
def exit_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.exit_reasons(trades(spark, sf_dir), ["symbol"])
    return r6(out.withColumn("net", F.round("net", 2)).withColumn("mean", F.round("mean", 3)), "win_rate", "mean_hours")


@query
def monthly_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumn("month", F.date_format("exit_time", "yyyy-MM"))
    return r6(metrics.monthly_correlation(t, "month", "n_lines", "net_pnl", 20), "corr")


@query
def value_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mix(trades(spark, sf_dir), ["symbol"], "exit_reason").drop("mix")


@query
def period_positive_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumn("month", F.date_format("exit_time", "yyyy-MM"))
    return r6(metrics.positive_rate(t, ["symbol"], "month", "net_pnl").withColumn("worst", F.round("worst", 2)), "positive_rate")


@query
def buy_and_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.buy_and_hold(bars_of(spark, sf_dir)), "buy_and_hold")


@query
def peak_to_trough(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ledger.equity_curve(trades(spark, sf_dir), ["symbol"], ["exit_time", "trade_id"], "net_pnl", 1e6)
    out = metrics.peak_to_trough(e, ["symbol"], ["exit_time", "trade_id"], "equity")
    return r6(out.withColumn("peak", F.round("peak", 2)).withColumn("trough", F.round("trough", 2)), "fall")


@query
def feature_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.feature_by_outcome(trades(spark, sf_dir), ["symbol"], ["n_lines", "total_fee"], "net_pnl")
    return r6(out.withColumn("mean", F.round("mean", 3)), "median")


@query
def top_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.top_rows(trades(spark, sf_dir), ["symbol"], "net_pnl", "trade_id", 5)
    return out.select("symbol", "trade_id", "rank_top", "rank_bottom")


@query
def reason_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.crosstab(trades(spark, sf_dir), "symbol", "exit_reason", ["F", "O", "P"])


# ------------------------------------------------------------------ ranking, statistics, validation


def _factor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with three factors and forward returns, as candidate events."""
    b = bars_of(spark, sf_dir)
    w = indicators.series()
    rows = labels.forward_labels(b, [1, 4, 8])
    rows = rows.withColumn("momentum", F.round(F.col("close") / F.lag("close", 6).over(w) - 1, 9)).withColumn("spread", F.round((F.col("high") - F.col("low")) / F.col("close"), 9))
    rows = rows.withColumn("activity", F.col("n_ticks").cast("double")).withColumn("month", F.date_format("bar_ts", "yyyy-MM"))
    return rows.withColumn("week", F.floor((F.dayofmonth("bar_ts") - 1) / 7).cast("int")).withColumn("event_id", F.concat_ws("_", "symbol", F.date_format("bar_ts", "yyyyMMddHH")))


@query
def factor_quintiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.quintiles(_factor_rows(spark, sf_dir), ["symbol"], "momentum", "event_id")
    out = metrics.quintile_summary(rows, ["symbol"], "quintile", 4)
    return r6(out, "mean_ret", "median_ret", "mean_mfe", "mean_mae", "positive_rate", "mfe_mae")


@query
def factor_monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.quintiles(_factor_rows(spark, sf_dir), ["symbol"], "momentum", "event_id")
    groups = metrics.quintile_summary(rows, ["symbol"], "quintile", 4)
    return r6(ranking.monotonicity(groups, ["symbol"], "quintile", "mean_ret"), "spread", "consistency")


@query
def score_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.ranks(_factor_rows(spark, sf_dir), ["symbol"], "activity", "event_id")
    rows = rows.withColumn("score_group", ranking.score_group(F.col("rank_pct")))
    return r6(rows.groupBy("symbol", "score_group").agg(F.count("*").alias("n"), F.avg("fwd_ret_4").alias("mean_ret")), "mean_ret")


@query
def reference_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _factor_rows(spark, sf_dir)
    out = ranking.percentile_of(rows.where("week = 4").select("symbol", "event_id", "spread"), rows.where("week < 4"), ["symbol"], "spread", "spread")
    return r6(out.select("event_id", "pct"), "pct")


@query
def rank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.ranks(_factor_rows(spark, sf_dir), ["symbol"], "momentum", "event_id").withColumnRenamed("rank_pct", "a").drop("rank_first", "rank_average")
    rows = ranking.ranks(rows, ["symbol"], "spread", "event_id").withColumnRenamed("rank_pct", "b")
    return r6(ranking.rank_overlap(rows, ["symbol"], "a", "b"), "overlap")


def _quantiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.quintiles(_factor_rows(spark, sf_dir), ["symbol"], "spread", "event_id").where("quintile is not null and fwd_ret_4 is not null")


@query
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quantiled(spark, sf_dir)
    seen = stats.observed_edge(rows, ["symbol"], "quintile", "fwd_ret_4", 5, 1).select("symbol", "edge")
    drawn = stats.permutation_edges(rows, ["symbol"], "quintile", "fwd_ret_4", "event_id", 5, 1, 200)
    p = stats.p_values(drawn, seen, ["symbol"])
    return r6(stats.benjamini_hochberg(p, [], "p_value", "symbol"), "edge", "p_value", "percentile", "q_value")


@query
def bootstrap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = stats.bootstrap_means(_quantiled(spark, sf_dir), ["symbol"], "fwd_ret_4", "event_id", 100)
    return r6(stats.distribution(draws, ["symbol"], "mean"), "mean", "p05", "p50", "p95", "positive_rate")


@query
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = stats.block_bootstrap(_quantiled(spark, sf_dir), ["symbol"], "week", "fwd_ret_4", 500)
    return r6(stats.distribution(draws, ["symbol"], "mean"), "mean", "p05", "p50", "p95", "positive_rate")


@query
def matched_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quantiled(spark, sf_dir)
    draws = stats.matched_baseline(rows.where("quintile = 5"), rows.where("quintile < 5"), ["symbol", "week"], ["symbol"], "fwd_ret_4", "event_id", "event_id", 100)
    return r6(stats.distribution(draws, ["symbol"], "mean"), "mean", "p05", "p50", "p95", "positive_rate")


@query
def random_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = stats.random_direction(_quantiled(spark, sf_dir), ["symbol"], "fwd_ret_4", "event_id", 100)
    return r6(stats.distribution(draws, ["symbol"], "mean"), "mean", "p05", "p50", "p95", "positive_rate")


@query
def order_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.shuffled_drawdowns(trades(spark, sf_dir), ["symbol"], "net_pnl", "trade_id", 1e6, 50)
    return r6(out.withColumn("net", F.round("net", 2)), "max_drawdown")


@query
def tail_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumn("month", F.date_format("exit_time", "yyyy-MM"))
    out = stats.tail_dependence(t, ["symbol"], "net_pnl", "trade_id", [1, 3, 5], "month")
    return out.withColumns({c: F.round(c, 2) for c in out.columns if c.startswith(("total", "without"))})


@query
def leave_block_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stats.leave_block_out(_quantiled(spark, sf_dir), ["symbol"], "week", "fwd_ret_4"), "mean", "without_best", "without_two_best", "worst_twice")


@query
def factor_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stats.correlations(_factor_rows(spark, sf_dir), ["symbol"], "momentum", "spread"), "pearson", "spearman")


@query
def monthly_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).groupBy("symbol", F.date_format("exit_time", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("net_pnl"), 2).alias("net"))
    return r6(selectk.kendall(t, ["symbol"], "n", "net"), "tau")


@query
def failure_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quantiled(spark, sf_dir)
    return r6(stats.failure_lift(rows, ["symbol"], F.col("quintile") == 5, F.col("fwd_mae_4") < -0.3), "base_rate", "risky_rate", "lift")


@query
def fit_transform_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _factor_rows(spark, sf_dir)
    params = validate.fit(rows.where("week < 2"), ["momentum", "spread", "activity"])
    z = validate.standardise(rows.where("week >= 2"), ["event_id"], ["momentum", "spread", "activity"], params)
    out = validate.family_scores(z, ["event_id"], {"momentum": ("trend", 1), "spread": ("risk", -1), "activity": ("trend", 1)})
    return r6(out, "score")


@query
def score_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(validate.thresholds(_factor_rows(spark, sf_dir), ["symbol"], "spread", [0.6, 0.8]), "q60", "q80")


@query
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.time_split(trades(spark, sf_dir), ["symbol"], ["entry_time", "trade_id"])
    return rows.groupBy("symbol", "split").agg(F.count("*").alias("n"), F.round(F.avg("net_pnl"), 4).alias("mean"))


@query
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    held = validate.in_windows(t, validate.walk_forward(t, "entry_time", 12, 3, 3), "entry_time")
    out = held.groupBy("window_id", "test_start", "part").agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret"), metrics.profit_factor("net_pnl", "b").alias("profit_factor"))
    return r6(out, "mean_ret", "profit_factor").withColumn("test_start", F.col("test_start").cast("string"))


@query
def edge_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.extreme_masks(_factor_rows(spark, sf_dir), ["symbol"], "spread", "event_id").where("fwd_ret_4 is not null")
    return r6(validate.stability(rows, ["symbol"], ["week", "month"], "fwd_ret_4"), "same_direction", "worst", "whole_edge")


@query
def decision_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.trade_summary(trades(spark, sf_dir), ["symbol", "side"], 1e6)
    rules = [(F.col("n_trades") < 100, "insufficient_sample"), (F.col("profit_factor") < 1, "reject"), ((F.col("profit_factor") > 1.2) & (F.col("win_rate") > 0.6), "advance")]
    return s.select("symbol", "side", validate.ladder(rules, "observe").alias("decision"))


@query
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks to strict bars, indicators, breakout events with age, forward labels and a quintile table."""
    rows = indicators.base_indicators(bars_of(spark, sf_dir))
    rows = state.set_reset(patterns.trend_signals(rows), F.col("breakout"), F.col("exit_signal"), "active")
    rows = labels.forward_labels(rows, [1, 4, 8]).withColumn("factor", F.round((F.col("close") - F.col("ema_slow")) / F.nullif(F.col("atr"), F.lit(0.0)), 9))
    rows = ranking.quintiles(rows, ["symbol"], "factor", "bar_ts", distinct=20)
    rows = labels.unpivot_labels(rows.where("quintile is not null"), ["symbol", "quintile"], [1, 4, 8])
    out = metrics.quintile_summary(rows, ["symbol", "horizon"], "quintile")
    return r6(out, "mean_ret", "median_ret", "mean_mfe", "mean_mae", "positive_rate", "mfe_mae")



# ------------------------------------------------------------------ masks, leverage, further tables


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.ranks(_factor_rows(spark, sf_dir), ["symbol"], "momentum", "event_id").withColumnRenamed("rank_pct", "m").drop("rank_first", "rank_average")
    return ranking.ranks(rows, ["symbol"], "spread", "event_id").withColumnRenamed("rank_pct", "s").drop("rank_first", "rank_average")


@query
def prototype_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"P0": F.lit(True), "P1": F.col("m") >= 0.8, "P2": F.col("s") <= 0.2, "P4": (F.col("m") >= 0.6) & (F.col("s") <= 0.4)}
    rows = patterns.masks(_scored(spark, sf_dir), named)
    return r6(rows.groupBy("symbol", "prototype").agg(F.count("*").alias("n"), F.avg("fwd_ret_4").alias("mean_ret")), "mean_ret")


@query
def path_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = [("s", 0.7, -1), ("m", 0.4, 1), ("activity", 2.0, 1)]
    rows = patterns.gates(_scored(spark, sf_dir), factors, {"G0": (0, 0), "G1": (1, 1), "G2": (2, 2), "G3": (3, 2)})
    return r6(rows.groupBy("gate", "accepted").agg(F.count("*").alias("n"), F.avg("fwd_mae_4").alias("mean_mae")), "mean_mae")


@query
def ablation_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patterns.ablation(_factor_rows(spark, sf_dir).where("fwd_ret_4 is not null"), [("spread", "spread", 0.4), ("activity", "activity", 0.4), ("momentum", "momentum", 0.4)])
    return r6(rows.groupBy("rule").agg(F.count("*").alias("n"), F.avg("fwd_ret_4").alias("mean_ret")), "mean_ret")


@query
def location_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.location_reasons(signal_frame(spark, sf_dir)).groupBy("location").agg(F.count("*").alias("n"))


@query
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.day_change(signal_frame(spark, sf_dir), 24).withColumn("atr_pct", F.col("atr") / F.col("close"))
    rows = patterns.quality_filter(rows, ["error"], 2500.0, 1.5)
    return rows.groupBy("symbol", F.coalesce("reason", F.lit("pass")).alias("reason")).agg(F.count("*").alias("n"))


@query
def signal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.candle_metrics(signal_frame(spark, sf_dir))
    score = patterns.score_signal(60.0, [(F.col("breakout"), 25.0), (F.col("close_location") >= 0.7, 10.0), (F.col("volume") > F.col("volume_mean"), 10.0), (F.col("exit_signal"), -70.0)])
    return rows.groupBy(score.alias("score")).agg(F.count("*").alias("n"))


@query
def longest_loss_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.longest_loss_values(trades(spark, sf_dir), ["symbol"], ["exit_time", "trade_id"], "net_pnl")
    return out.select("symbol", "run_length", F.round(F.aggregate("losses", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query
def recent_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.recent_losses(trades(spark, sf_dir), ["symbol"], ["exit_time", "trade_id"], "net_pnl")
    return rows.groupBy("symbol", "recent_losses").agg(F.count("*").alias("n"))


@query
def trailing_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("until", F.expr("signal_time + interval 24 hours")).withColumn("entry", F.col("close"))
    path = asof.interval_join(e.select("symbol", "event_id", "signal_time", "until", "entry"), bars_of(spark, sf_dir), "signal_time", "until", "bar_ts", 4 * 3600, ["high", "low"])
    return r6(state.trailing_stop(path, ["event_id"], "path_ts", "entry", 0.15, 0.2), "stop_level")


@query
def partial_take_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = QUERIES["exit_resolution"](spark, sf_dir)
    out = ledger.partial_take_profit(resolved, [(0.05, 0.5), (0.2, 0.5), (0.5, 0.25)])
    return r6(out.groupBy("target_pct", "fraction").agg(F.count_if("touched").alias("n_touched"), F.avg("blended_ret").alias("mean_ret")), "mean_ret")


@query
def liquidation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("o_orderkey") % 2 == 0, "LONG").otherwise("SHORT").alias("side")
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trade_id"), side, F.col("o_totalprice").alias("entry"))
    rows = t.withColumn("leverage", F.explode(F.array(*map(F.lit, [5.0, 10.0, 20.0]))))
    return r6(rows.withColumn("liquidation", ledger.liquidation_price(F.col("entry"), F.col("leverage"), F.col("side"))), "liquidation")


@query
def leverage_by_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal_frame(spark, sf_dir).withColumn("atr_pct", F.col("atr") / F.col("close"))
    rows = rows.withColumn("steps", ledger.volatility_leverage(F.col("atr_pct"), [(0.5, 20.0), (1.0, 10.0), (2.0, 5.0)], 1.0))
    rows = rows.withColumn("parity", ledger.risk_parity_leverage(10.0, 0.5, F.col("atr_pct"), 1.0, 30.0))
    return rows.where("atr is not null").groupBy("steps", "parity").agg(F.count("*").alias("n"))


@query
def marked_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_of(spark, sf_dir)
    t = b.where(F.hour("bar_ts") == 6).select("symbol", F.col("bar_ts").alias("entry_time"), F.expr("bar_ts + interval 5 hours").alias("exit_time"), F.col("close").alias("entry_price"), F.lit(2.0).alias("quantity"))
    out = ledger.mark_to_market(b, t, 1000.0)
    return r6(out.select("symbol", "bar_ts", "in_trade", "marked"), "marked")


@query
def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.trade_summary(trades(spark, sf_dir), ["side"], 1e6)
    return r6(metrics.metric_table(s, "side", ["LONG", "SHORT"], ["n_trades", "win_rate", "profit_factor"]), "LONG", "SHORT")


@query
def safety_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.extreme_masks(_factor_rows(spark, sf_dir), ["symbol"], "spread", "event_id")
    return r6(stats.edge_metrics(rows, ["symbol"], ["fwd_ret_4", "fwd_mfe_4", "fwd_mae_4"]), "edge")


@query
def horizon_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.extreme_masks(_factor_rows(spark, sf_dir), ["symbol"], "spread", "event_id")
    edges = stats.edge_metrics(rows, ["symbol"], ["fwd_ret_1", "fwd_ret_4", "fwd_ret_8"]).withColumn("horizon", F.substring_index("metric", "_", -1).cast("int"))
    return r6(validate.horizon_consistency(edges.select("symbol", "horizon", "edge"), ["symbol"]), "last_edge", "first_edge", "consistency")


@query
def eligible_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    evidence = [metrics.trade_summary(t, ["symbol"], 1e6).where("profit_factor > 1"), metrics.concentration(t, ["symbol"], "net_pnl", "trade_id", [1]).where("top_1_share < 0.5"), t.where("n_lines >= 8")]
    return validate.eligible(evidence, ["symbol"])


@query
def state_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.state_terciles(_factor_rows(spark, sf_dir), "spread", "spread_state")
    return rows.groupBy("symbol", "spread_state").agg(F.count("*").alias("n"))


@query
def event_cost_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised outcome of each event: the 4-bar return net of costs, and in units of risk."""
    rows = labels.forward_labels(signal_frame(spark, sf_dir), [4]).where("breakout and fwd_ret_4 is not null and atr is not null")
    net = F.col("fwd_ret_4") - 2 * (0.0004 + 0.0005)
    out = rows.select("symbol", "bar_ts", F.col("fwd_ret_4").alias("gross"), net.alias("net"), (net * F.col("close") / F.nullif(F.col("atr"), F.lit(0.0))).alias("r_multiple"))
    return r6(out, "gross", "net", "r_multiple")


@query
def buy_sell_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in the first table only, in both, and in the second only."""
    t = trades(spark, sf_dir)
    a, b = t.where("net_pnl > 0").select("symbol", "side", "exit_reason", "n_lines"), t.where("net_pnl <= 0").select("symbol", "side", "exit_reason", "n_lines")
    parts = [(a.distinct().exceptAll(b.distinct()), "first_only"), (a.intersect(b), "both"), (b.distinct().exceptAll(a.distinct()), "second_only")]
    out = None
    for df, name in parts:
        df = df.withColumn("part", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


# ------------------------------------------------------------------ studies


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.set_reset(signal_frame(spark, sf_dir), F.col("breakout"), F.col("exit_signal"), "active")


@query
def confirmation_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = signal_frame(spark, sf_dir).where("breakout and atr is not null")
    e = e.select(F.concat_ws("_", "symbol", F.date_format("bar_ts", "yyyyMMddHH")).alias("event_id"), "symbol", F.col("bar_ts").alias("signal_time"), F.col("high").alias("signal_high"), F.col("close").alias("entry"), "atr")
    found = studies.confirmed_entries(e, ticks(spark, sf_dir).withColumn("close", F.col("price")), 4 * 3600, 4 * 3600)
    return r6(studies.confirmation_cost(found, "entry", "atr"), "mean_wait_s", "mean_cost_r")


@query
def timing_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = studies.timing_modes(labels.forward_labels(_active(spark, sf_dir), [4]), "active", [0, 2, 4])
    return r6(rows.groupBy("timing").agg(F.count("*").alias("n"), F.avg("fwd_ret_4").alias("mean_ret")), "mean_ret")


@query
def pair_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = studies.pair_events(indicators.pair_ratio(bars_of(spark, sf_dir), "click", "view", n=48), 8)
    return r6(out, "ratio", "z", "fwd_ret_8", "fwd_mfe_8", "fwd_mae_8")


@query
def warm_up_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(studies.warm_up(bars_of(spark, sf_dir), [60, 120, 240], 48), "mean", "delta")


@query
def monthly_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(studies.monthly_proxy(_active(spark, sf_dir), "active"), "ret")


@query
def portfolio_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = trades(spark, sf_dir).groupBy(F.col("side").alias("component"), F.date_format("exit_time", "yyyy-MM").alias("month")).agg(F.avg("ret").alias("ret"))
    out = studies.portfolio_comparison(m, "LONG", "SHORT", 0.5)
    return r6(out, *[c for c in out.columns if c != "both_negative"])


@query
def best_and_worst_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = studies.best_and_worst_removed(trades(spark, sf_dir), ["symbol"], "net_pnl", "trade_id", 10)
    return r6(out.withColumn("net", F.round("net", 2)), "profit_factor")


@query
def cost_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = studies.cost_sensitivity(trades(spark, sf_dir), ["symbol"], {"none": 0, "base": 1, "double": 2, "triple": 3})
    return r6(out.withColumn("net", F.round("net", 2)), "profit_factor", "break_even")


@query
def risk_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = studies.risk_sweep(trades(spark, sf_dir), ["symbol"], ["exit_time", "trade_id"], "ret", [0.5, 1.0, 2.0], 1.0)
    return r6(out.withColumn("log_final", F.log("final")).drop("final"), "log_final", "max_drawdown")


@query
def leverage_stress_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumn("fee_rate", F.col("total_fee") / F.col("notional"))
    out = studies.leverage_stress_grid(t, ["symbol"], ["exit_time", "trade_id"], {"fixed": [3, 3, 3], "adaptive": [5, 2, 1]}, 1000.0)
    return out.withColumn("final", F.round(F.log("final"), 4))


@query
def weak_month_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumn("month", F.date_format("exit_time", "yyyy-MM"))
    m = lambda side: t.where(F.col("side") == side).groupBy("symbol", "month").agg(F.sum("net_pnl").alias("net"))
    return r6(studies.weak_month_overlap(m("LONG"), m("SHORT"), ["symbol"], "month", "net"), "positive_in_negative", "corr")


@query
def context_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = studies.context_events(signal_frame(spark, sf_dir), (F.col("ema_fast") > F.col("ema_slow")) & (F.col("close") > F.col("ema_slow")))
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg("entry_price"), 6).alias("mean_entry"), F.max("entry_time").alias("last_entry"))


@query
def holdout_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_of(spark, sf_dir)
    return studies.holdout_symbols(b, b.where("close > 400"), 3)
