"""Further registered queries, each next to its DuckDB oracle: event data sets, trackers, samplings, bootstraps of edges, plain joins
and single rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, bars, events, indicators, labels, ledger, metrics, orderstats, patterns, quality, ranking, resample, selection, state, stats, studies, validate
from tidemark.operators.stats import PRIME, draw_sql
from tidemark.plans.inputs import BARS, TICKS, TRADES, bars_of, bars_sql, ticks, trades
from tidemark.plans.oracles import ORACLE_SQL, ACTIVE, CANDLES, EVENTS, FACTORS, HIKKAKE, LABELS, MR, MRC, QS, ROWS, RUN, SCORED, SIG, WILDER, T, W, pf, r, rank_sql, recursive_mean, roll, signal_sql, sql
from tidemark.plans.queries import QUERIES, _active, _events, _factor_rows, _quantiled, _scored, query, r6, signal_frame
from tidemark.scratch import written

# ------------------------------------------------------------------ event data sets


def _candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.candle_metrics(signal_frame(spark, sf_dir))


def _fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as the finest path."""
    return ticks(spark, sf_dir).select("symbol", "ts", F.col("price").alias("high"), F.col("price").alias("low"))


@query
def directional_breakouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.directional_breakouts(indicators.mean_reversion(_candles(spark, sf_dir)))
    cols = ["stop", "risk", "strength", "signed_body", "side_location"]
    return r6(rows.select("symbol", "bar_ts", "side", *cols), *cols)


MRK = f"{MR}, {CANDLES.replace('candles AS', 'mrk AS').replace('FROM sig', 'FROM mr')}"
sql(
    "directional_breakouts",
    MRK,
    """, e AS (SELECT *, CASE WHEN close > range_upper THEN 1 ELSE -1 END AS d FROM mrk WHERE close > range_upper OR close < range_lower)
SELECT symbol, bar_ts, CASE WHEN d = 1 THEN 'LONG' ELSE 'SHORT' END AS side, round(CASE WHEN d = 1 THEN low ELSE high END, 6) AS stop, round(abs(close - CASE WHEN d = 1 THEN low ELSE high END) / nullif(close, 0), 6) AS risk,
  round(CASE WHEN d = 1 THEN close - range_upper ELSE range_lower - close END / nullif(atr, 0), 6) AS strength, round(CASE WHEN close >= open THEN body ELSE -body END * d, 6) AS signed_body,
  round(CASE WHEN d = 1 THEN close_location ELSE 1 - close_location END, 6) AS side_location FROM e""",
)


@query
def candle_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.candle_dataset(_candles(spark, sf_dir), [4, 8])
    cols = ["move_3", "to_swing_high", "volume_vs_mean", "dir_ret_4", "dir_mfe_8", "dir_mae_8"]
    return r6(rows.select("symbol", "bar_ts", "pattern", "side", "confirmed", *cols), *cols)


LABELLED = LABELS.replace("lab AS", "lc AS").replace("FROM bars", "FROM candles")
CANDLE_EVENTS = f"""{SIG}, {CANDLES}, {LABELLED}, c0 AS (SELECT *, lag(open) OVER {W} AS po, lag(close) OVER {W} AS pc, high - low >= 0.2 * atr AS big, lag(close, 3) OVER {W} AS c3,
  {roll('max', 'high', 20, 1)} AS sh, {roll('avg', 'volume', 20, 1)} AS vm,
  max(close) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS up3, min(close) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS down3 FROM lc),
cev AS (SELECT *, 'hammer' AS pattern, 'LONG' AS side FROM c0 WHERE big AND lower_wick >= 0.5 AND upper_wick <= 0.2 AND body > 0
UNION ALL SELECT *, 'shooting_star', 'SHORT' FROM c0 WHERE big AND upper_wick >= 0.5 AND lower_wick <= 0.2 AND body > 0
UNION ALL SELECT *, 'bullish_engulfing', 'LONG' FROM c0 WHERE big AND pc < po AND close > open AND open <= pc AND close >= po
UNION ALL SELECT *, 'bearish_engulfing', 'SHORT' FROM c0 WHERE big AND pc > po AND close < open AND open >= pc AND close <= po)"""
sql(
    "candle_dataset",
    CANDLE_EVENTS,
    """SELECT symbol, bar_ts, pattern, side, coalesce(CASE WHEN side = 'LONG' THEN up3 > high ELSE down3 < low END, false) AS confirmed, round((close - c3) / nullif(atr, 0), 6) AS move_3, round((sh - close) / nullif(atr, 0), 6) AS to_swing_high,
  round(volume / nullif(vm, 0), 6) AS volume_vs_mean, round(CASE WHEN side = 'SHORT' THEN -fwd_ret_4 ELSE fwd_ret_4 END, 6) AS dir_ret_4,
  round(CASE WHEN side = 'SHORT' THEN 1 / (1 + fwd_mae_8) - 1 ELSE fwd_mfe_8 END, 6) AS dir_mfe_8, round(CASE WHEN side = 'SHORT' THEN 1 / (1 + fwd_mfe_8) - 1 ELSE fwd_mae_8 END, 6) AS dir_mae_8 FROM cev""",
)


@query
def candle_target_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.candle_dataset(_candles(spark, sf_dir), [8])
    return r6(events.target_hits(rows, ["pattern", "side"], "dir_mfe_8", [0.01, 0.1, 0.2]), "hit_rate")


sql(
    "candle_target_hits",
    CANDLE_EVENTS,
    """, m AS (SELECT pattern, side, CASE WHEN side = 'SHORT' THEN 1 / (1 + fwd_mae_8) - 1 ELSE fwd_mfe_8 END AS f FROM cev)
SELECT pattern, side, target, count(*) AS n, round(avg((f >= target)::INT), 6) AS hit_rate FROM m CROSS JOIN (SELECT unnest([0.01::DOUBLE, 0.1, 0.2]) AS target) WHERE f IS NOT NULL GROUP BY ALL""",
)


@query
def entry_mode_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = {"B0": F.col("breakout"), "B1": F.col("breakout") & patterns.strong_bar(), "X": F.col("exit_signal")}
    out = events.entry_mode_study(_candles(spark, sf_dir), modes, _fine(spark, sf_dir), [3600, 14400], 14400)
    return r6(out, "mean_mfe", "mean_mae")


sql(
    "entry_mode_study",
    f"{SIG}, {CANDLES}",
    """, m AS (SELECT symbol, bar_ts, close, 'B0' AS entry_mode FROM candles WHERE breakout UNION ALL SELECT symbol, bar_ts, close, 'X' FROM candles WHERE exit_signal
UNION ALL SELECT symbol, bar_ts, close, 'B1' FROM candles WHERE breakout AND close > open AND body >= 0.35 AND upper_wick <= 0.3 AND close_location >= 0.7 AND volume >= volume_mean),
p AS (SELECT m.symbol, entry_mode, bar_ts, window_s, max(price) / any_value(close) - 1 AS f, min(price) / any_value(close) - 1 AS a FROM m CROSS JOIN (SELECT unnest([3600, 14400]) AS window_s)
  JOIN ticks t ON t.symbol = m.symbol AND t.ts >= bar_ts AND t.ts <= bar_ts + to_seconds(window_s) GROUP BY m.symbol, entry_mode, bar_ts, window_s)
SELECT symbol, entry_mode, window_s, count(*) AS n, round(avg(f), 6) AS mean_mfe, round(avg(a), 6) AS mean_mae FROM p GROUP BY ALL""",
)


@query
def candidate_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patterns.mean_reversion_candidates(indicators.mean_reversion(signal_frame(spark, sf_dir)))
    out = events.candidate_history(rows, F.col("trend_strength") <= 0.5)
    return out.select("event_id", "symbol", "candidate", "side", "year", "quarter", "month")


sql(
    "candidate_history",
    MRC,
    """SELECT symbol || '_' || strftime(bar_ts, '%Y%m%d%H') || '_' || candidate || '_' || side AS event_id, symbol, candidate, side, year(bar_ts)::INT AS year, year(bar_ts) || 'Q' || quarter(bar_ts) AS quarter, strftime(bar_ts, '%Y-%m') AS month
FROM mrc WHERE trend_strength <= 0.5""",
)


@query
def gate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"P0": F.lit(True), "P1": F.col("m") >= 0.8, "P2": F.col("s") <= 0.2}
    rows = events.gate_table(_scored(spark, sf_dir), named, ["m", "s"], {"G0": (0, 0), "G1": (1, 1), "G2": (2, 2)}, 0.5)
    return rows.select("event_id", "prototype", "gate", "accepted")


sql(
    "gate_table",
    SCORED,
    """, p AS (SELECT event_id, m, s, 'P0' AS prototype FROM sc UNION ALL SELECT event_id, m, s, 'P1' FROM sc WHERE m >= 0.8 UNION ALL SELECT event_id, m, s, 'P2' FROM sc WHERE s <= 0.2),
h AS (SELECT event_id, prototype, coalesce(m >= 0.5, false)::INT AS a, coalesce(s >= 0.5, false)::INT AS b FROM p)
SELECT event_id, prototype, 'G0' AS gate, true AS accepted FROM h UNION ALL SELECT event_id, prototype, 'G1', a >= 1 FROM h UNION ALL SELECT event_id, prototype, 'G2', a + b >= 2 FROM h""",
)


@query
def gate_downshift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A high-risk row (both rank shares in the upper half) gets half the leverage."""
    rows = _scored(spark, sf_dir).withColumn("risky", patterns.true((F.col("s") >= 0.5) & (F.col("activity") >= 2)))
    rows = rows.withColumn("leverage", ledger.gate_downshift(F.lit(4.0), F.col("risky"), 0.5))
    return rows.groupBy("symbol", "leverage").agg(F.count("*").alias("n"))


sql("gate_downshift", SCORED, "SELECT symbol, CASE WHEN coalesce(s >= 0.5 AND activity >= 2, false) THEN 2.0::DOUBLE ELSE 4.0 END AS leverage, count(*) AS n FROM sc GROUP BY ALL")


@query
def path_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.path_touches(_events(spark, sf_dir), _fine(spark, sf_dir), [3600, 14400, 28800], 0.5, 14400)


sql(
    "path_touches",
    EVENTS,
    """, h(horizon_s) AS (VALUES (3600), (14400), (28800)),
f AS (SELECT ev.event_id, min(ts) FILTER (price >= ev.close * 1.5) AS u, min(ts) FILTER (price <= ev.close * 0.5) AS d FROM ev JOIN ticks t ON t.symbol = ev.symbol AND t.ts > signal_time AND t.ts <= signal_time + INTERVAL 8 HOUR GROUP BY ev.event_id),
x AS (SELECT ev.event_id, horizon_s, u, d, coalesce(u <= signal_time + to_seconds(horizon_s), false) AS up_hit, coalesce(d <= signal_time + to_seconds(horizon_s), false) AS down_hit FROM ev CROSS JOIN h LEFT JOIN f USING (event_id))
SELECT event_id, horizon_s, CASE WHEN up_hit AND down_hit THEN CASE WHEN u < d THEN 'plus' WHEN d < u THEN 'minus' ELSE 'ambiguous' END WHEN up_hit THEN 'plus' WHEN down_hit THEN 'minus' ELSE 'none' END AS touch, up_hit, down_hit FROM x""",
)


@query
def compare_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "symbol", F.col("signal_time").alias("entry_time"), F.expr("signal_time + interval 6 hours").alias("exit_time"))
    coarse = bars_of(spark, sf_dir).select("symbol", F.col("bar_ts").alias("ts"), "high")
    out = events.compare_paths(e, _fine(spark, sf_dir), coarse, 14400)
    return r6(out.select("event_id", "fine_high", "coarse_high", "gap"), "gap")


sql(
    "compare_paths",
    EVENTS,
    """, f AS (SELECT ev.event_id, max(price) AS h FROM ev JOIN ticks t ON t.symbol = ev.symbol AND t.ts BETWEEN signal_time AND signal_time + INTERVAL 6 HOUR GROUP BY ev.event_id),
c AS (SELECT ev.event_id, max(high) AS h FROM ev JOIN bars b ON b.symbol = ev.symbol AND b.bar_ts BETWEEN signal_time AND signal_time + INTERVAL 6 HOUR GROUP BY ev.event_id)
SELECT event_id, f.h AS fine_high, c.h AS coarse_high, round(c.h / f.h - 1, 6) AS gap FROM ev LEFT JOIN f USING (event_id) LEFT JOIN c USING (event_id)""",
)


@query
def fast_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.volume_features(indicators.wilder(bars_of(spark, sf_dir)))
    return r6(events.fast_signals(rows, 52, 90, 1.1).select("symbol", "bar_ts", "rsi", "volume_vs_mean"), "rsi", "volume_vs_mean")


sql(
    "fast_signals",
    WILDER,
    f""", v AS (SELECT symbol, bar_ts, close, lag(high) OVER {W} AS ph, volume / nullif({roll('avg', 'volume', 20, 1)}, 0) AS vm FROM bars)
SELECT symbol, bar_ts, round(rsi, 6) AS rsi, round(vm, 6) AS volume_vs_mean FROM wilder JOIN v USING (symbol, bar_ts) WHERE close > ph AND vm >= 1.1 AND rsi BETWEEN 52 AND 90""",
)


@query
def hikkake_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patterns.hikkake(signal_frame(spark, sf_dir)).withColumn("valid", F.col("ema_fast") > F.col("ema_slow"))
    return events.hikkake_tracker(rows, "valid")


sql(
    "hikkake_tracker",
    f"{SIG}, {HIKKAKE}",
    f""", t AS (SELECT *, ema_fast > ema_slow AS valid, row_number() OVER {W} AS rn, lag(high) OVER {W} AS lvl FROM hik),
n AS (SELECT s.symbol, s.bar_ts, k.k, coalesce(x.valid, false) AS ok, x.high > s.lvl AS top, x.bar_ts AS hit_time FROM t s CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) k LEFT JOIN t x ON x.symbol = s.symbol AND x.rn = s.rn + k.k WHERE s.hikkake_setup AND s.valid),
o AS (SELECT *, CASE WHEN NOT ok THEN 'invalid' WHEN top THEN 'confirmed' END AS o FROM n)
SELECT symbol, bar_ts AS setup_time, arg_min(CASE WHEN o = 'confirmed' THEN hit_time END, k) FILTER (k = fk) AS confirm_time, coalesce(min(o) FILTER (k = fk), 'expired') AS outcome
FROM (SELECT *, min(k) FILTER (o IS NOT NULL) OVER (PARTITION BY symbol, bar_ts) AS fk FROM o) GROUP BY symbol, bar_ts""",
)


@query
def pullback_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.pullback_entries(_active(spark, sf_dir), "active")


sql(
    "pullback_entries",
    ACTIVE,
    f""", p AS (SELECT *, lag(open) OVER {W} AS po, lag(close) OVER {W} AS pc, sum(active_first::INT) OVER {RUN} AS run, CASE WHEN active_age >= 1 THEN (low < lag(low) OVER {W})::INT ELSE 0 END AS ll FROM act),
q AS (SELECT *, max(ll) OVER (PARTITION BY symbol, run ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) = 1 AS pulled FROM p WHERE active = 1)
SELECT symbol, min(bar_ts) AS entry_time, arg_min(close, bar_ts) AS entry_price, arg_min(active_age, bar_ts) AS age FROM q
WHERE active_age BETWEEN 2 AND 8 AND pulled AND pc < po AND close > open AND open <= pc AND close >= po AND ema_fast > ema_slow GROUP BY symbol, run""",
)

#: The event machine as a recursive query: one bar of each symbol a step.
sql(
    "breakout_events",
    f"""{SIG}, n AS (SELECT *, row_number() OVER {W} AS rn FROM sig),
m AS (SELECT symbol, rn, (breakout AND NOT exit_signal)::INT AS number, breakout AND NOT exit_signal AS open_now, 0 AS age, low AS last_low, false AS pulled, CASE WHEN breakout AND NOT exit_signal THEN 'opened' ELSE 'none' END AS label FROM n WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n.rn, m.number + (NOT m.open_now AND n.breakout AND NOT n.exit_signal)::INT,
    CASE WHEN NOT m.open_now THEN n.breakout AND NOT n.exit_signal ELSE NOT (n.exit_signal OR m.age + 1 > 8 OR (m.age + 1 >= 2 AND m.pulled AND n.close > n.open)) END,
    CASE WHEN m.open_now THEN m.age + 1 ELSE 0 END, n.low, CASE WHEN m.open_now THEN m.pulled OR n.low < m.last_low ELSE false END,
    CASE WHEN NOT m.open_now THEN CASE WHEN n.breakout AND NOT n.exit_signal THEN 'opened' ELSE 'none' END WHEN n.exit_signal THEN 'invalid' WHEN m.age + 1 > 8 THEN 'expired'
      WHEN m.age + 1 >= 2 AND m.pulled AND n.close > n.open THEN 'entered' ELSE 'open' END
  FROM m JOIN n ON n.symbol = m.symbol AND n.rn = m.rn + 1)""",
    "SELECT symbol, label AS event_state, count(*) AS n, max(number) AS events FROM m GROUP BY symbol, label",
)

# ------------------------------------------------------------------ samplings and bootstraps


@query
def matched_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).select("symbol", "side", "trade_id", "entry_time", "exit_time", "exit_reason")
    out = stats.matched_sampling(t.where("exit_reason = 'P'"), t, ["symbol", "side"], "trade_id", "entry_time", "exit_time", 10, 0.02)
    return out.groupBy("run", "filled").agg(F.count("*").alias("n"), F.sum("trade_id").alias("ids"))


sql(
    "matched_sampling",
    f"""{TRADES}, q AS (SELECT symbol, side, count(*) AS quota FROM trades WHERE exit_reason = 'P' GROUP BY ALL),
d AS (SELECT symbol, side, trade_id, entry_time, exit_time, run, {draw_sql('run', 'trade_id', str(PRIME))} AS r FROM trades CROSS JOIN (SELECT unnest(range(1, 11)) AS run)),
o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY entry_time, trade_id) AS rn FROM d WHERE r < {int(0.02 * PRIME)}),
k AS (SELECT run, rn, exit_time AS until, true AS kept FROM o WHERE rn = 1
  UNION ALL SELECT o.run, o.rn, CASE WHEN o.entry_time > k.until THEN o.exit_time ELSE k.until END, o.entry_time > k.until FROM k JOIN o ON o.run = k.run AND o.rn = k.rn + 1)""",
    """, x AS (SELECT o.*, coalesce(quota, 0) AS quota FROM o JOIN k USING (run, rn) LEFT JOIN q USING (symbol, side) WHERE kept),
y AS (SELECT *, row_number() OVER (PARTITION BY run, symbol, side ORDER BY r, trade_id) > quota AS filled FROM x),
l AS (SELECT run, (SELECT sum(quota) FROM q) - sum(h) AS lack FROM (SELECT run, symbol, side, least(count(*), any_value(quota)) AS h FROM y GROUP BY ALL) GROUP BY run),
z AS (SELECT y.*, lack, row_number() OVER (PARTITION BY run, filled ORDER BY r, trade_id) AS rest FROM y JOIN l USING (run))
SELECT run, filled, count(*) AS n, sum(trade_id)::BIGINT AS ids FROM z WHERE NOT filled OR rest <= lack GROUP BY run, filled""",
)


@query
def random_pool_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal_frame(spark, sf_dir)
    pool = studies.context_events(rows, F.col("ema_fast") > F.col("ema_slow")).where("atr is not null")
    pool = pool.select("symbol", F.concat_ws("_", "symbol", F.date_format("bar_ts", "yyyyMMddHH")).alias("event_id"), "entry_time", "entry_price", (F.col("entry_price") - F.col("atr")).alias("stop"))
    out = ledger.resolve_exits(pool, rows, "exit_signal", "stop")
    ret = F.avg(F.col("exit_price") / F.nullif(F.col("entry_price"), F.lit(0.0)) - 1)
    return r6(out.groupBy("symbol", "exit_reason").agg(F.count("*").alias("n"), ret.alias("mean_ret")), "mean_ret")


sql(
    "random_pool_exits",
    SIG,
    f""", o AS (SELECT symbol, bar_ts, lead(bar_ts) OVER {W} AS et, lead(open) OVER {W} AS ep, atr, ema_fast, ema_slow FROM sig),
e AS (SELECT symbol, bar_ts, et, ep, ep - atr AS stop FROM o WHERE ema_fast > ema_slow AND et IS NOT NULL AND atr IS NOT NULL),
z AS (SELECT symbol, max(bar_ts) AS lt, arg_max(close, bar_ts) AS lc FROM bars GROUP BY symbol),
u AS (SELECT e.*, f.bar_ts AS ft, coalesce(f.close, lc) AS c, coalesce(f.bar_ts, lt) AS until FROM e ASOF LEFT JOIN (SELECT * FROM sig WHERE exit_signal) f ON e.symbol = f.symbol AND e.et < f.bar_ts JOIN z ON z.symbol = e.symbol),
s AS (SELECT u.symbol, u.bar_ts, count(*) AS hits FROM u JOIN bars b ON b.symbol = u.symbol AND b.bar_ts > u.et AND b.bar_ts <= u.until AND b.low <= u.stop GROUP BY ALL)
SELECT symbol, CASE WHEN hits > 0 THEN 'stop' WHEN ft IS NOT NULL THEN 'signal' ELSE 'end_of_data' END AS exit_reason, count(*) AS n, round(avg(CASE WHEN hits > 0 THEN stop ELSE c END / nullif(ep, 0) - 1), 6) AS mean_ret
FROM u LEFT JOIN s USING (symbol, bar_ts) GROUP BY ALL""",
)


@query
def edge_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = stats.edge_bootstrap(_quantiled(spark, sf_dir), ["symbol"], "quintile", "fwd_ret_4", "event_id", 5, 1, 100)
    return r6(stats.distribution(draws, ["symbol"], "edge"), "mean", "p05", "p50", "p95", "positive_rate")


EDGE_DIST = "SELECT symbol, count(*) AS n_runs, round(avg(edge), 6) AS mean, round(quantile_cont(edge, 0.05), 6) AS p05, round(quantile_cont(edge, 0.5), 6) AS p50, round(quantile_cont(edge, 0.95), 6) AS p95, round(avg((edge > 0)::INT), 6) AS positive_rate FROM draws GROUP BY symbol"
sql(
    "edge_bootstrap",
    QS,
    f""", b AS (SELECT symbol, quintile, row_number() OVER (PARTITION BY symbol, quintile ORDER BY event_id) - 1 AS slot, count(*) OVER (PARTITION BY symbol, quintile) AS n, fwd_ret_4 AS v FROM qs WHERE quintile IN (1, 5)),
a AS (SELECT symbol, quintile, run, {draw_sql('run', 'slot', 'n')} AS slot FROM b CROSS JOIN (SELECT unnest(range(1, 101)) AS run)),
m AS (SELECT symbol, quintile, run, avg(v) AS mean FROM a JOIN b USING (symbol, quintile, slot) GROUP BY ALL),
draws AS (SELECT symbol, run, max(mean) FILTER (quintile = 5) - max(mean) FILTER (quintile = 1) AS edge FROM m GROUP BY symbol, run) {EDGE_DIST}""",
)


@query
def block_edge_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = stats.block_edge_bootstrap(_quantiled(spark, sf_dir), ["symbol"], "week", "quintile", "fwd_ret_4", 5, 1, 200)
    return r6(stats.distribution(draws, ["symbol"], "edge"), "mean", "p05", "p50", "p95", "positive_rate")


sql(
    "block_edge_bootstrap",
    QS,
    f""", k AS (SELECT symbol, week, sum(CASE WHEN quintile = 5 THEN fwd_ret_4 ELSE 0 END) AS s0, sum(CASE WHEN quintile = 1 THEN fwd_ret_4 ELSE 0 END) AS s1, count(*) FILTER (quintile = 5) AS c0, count(*) FILTER (quintile = 1) AS c1 FROM qs WHERE quintile IN (1, 5) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY week) - 1 AS slot, count(*) OVER (PARTITION BY symbol) AS n FROM k),
a AS (SELECT symbol, run, {draw_sql('run', 'slot', 'n')} AS slot FROM b CROSS JOIN (SELECT unnest(range(1, 201)) AS run)),
draws AS (SELECT symbol, run, sum(s0) / nullif(sum(c0), 0) - sum(s1) / nullif(sum(c1), 0) AS edge FROM a JOIN b USING (symbol, slot) GROUP BY symbol, run) {EDGE_DIST}""",
)


@query
def pnl_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumn("month", F.date_format("exit_time", "yyyy-MM"))
    out = stats.pnl_bootstrap(t, ["symbol"], "month", "net_pnl", 1e6, 0.9, 200)
    return r6(out.withColumn("mean_final", F.round("mean_final", 0)), "loss_rate", "ruin_rate")


sql(
    "pnl_bootstrap",
    TRADES,
    f""", x AS (SELECT symbol, strftime(exit_time, '%Y-%m') AS month, net_pnl, sum(net_pnl) OVER (PARTITION BY symbol, strftime(exit_time, '%Y-%m') ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS run FROM trades),
k AS (SELECT symbol, month, sum(net_pnl) AS s, min(run) AS low FROM x GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY month) - 1 AS slot, count(*) OVER (PARTITION BY symbol) AS n FROM k),
a AS (SELECT symbol, run, slot AS place, {draw_sql('run', 'slot', 'n')} AS slot FROM b CROSS JOIN (SELECT unnest(range(1, 201)) AS run)),
p AS (SELECT a.symbol, run, s, 1e6 + sum(s) OVER (PARTITION BY a.symbol, run ORDER BY place ROWS UNBOUNDED PRECEDING) - s + low AS lowest FROM a JOIN b USING (symbol, slot)),
e AS (SELECT symbol, run, 1e6 + sum(s) AS final, min(lowest) AS lowest FROM p GROUP BY symbol, run)
SELECT symbol, count(*) AS n_runs, round(avg((final < 1e6)::INT), 6) AS loss_rate, round(avg((lowest <= 9e5)::INT), 6) AS ruin_rate, round(avg(final), 0) AS mean_final FROM e GROUP BY symbol""",
)


@query
def subsample_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quantiled(spark, sf_dir)
    return r6(stats.subsample_test(rows.where("quintile = 5"), rows, ["symbol"], "fwd_ret_4", "event_id", 100), "mean", "mean_drawn", "share_below")


sql(
    "subsample_test",
    QS,
    f""", o AS (SELECT symbol, count(*) AS n, avg(fwd_ret_4) AS mean FROM qs WHERE quintile = 5 GROUP BY symbol), b AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY event_id) AS i, fwd_ret_4 AS v FROM qs),
d AS (SELECT *, {draw_sql('run', 'i', str(PRIME))} AS r FROM b CROSS JOIN (SELECT unnest(range(1, 101)) AS run)), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY r, i) AS rank FROM d),
m AS (SELECT symbol, run, avg(v) AS drawn, any_value(mean) AS mean FROM k JOIN o USING (symbol) WHERE rank <= n GROUP BY symbol, run)
SELECT symbol, round(any_value(mean), 6) AS mean, round(avg(drawn), 6) AS mean_drawn, round(avg((drawn < mean)::INT), 6) AS share_below FROM m GROUP BY symbol""",
)


@query
def top_removed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.top_removed_edges(_quantiled(spark, sf_dir), ["symbol"], "quintile", "fwd_ret_4", "event_id", 5, 1, [0.0, 0.01, 0.05])
    return r6(out.withColumn("removed", F.col("removed").cast("string")), "edge")


sql(
    "top_removed_edges",
    QS,
    """, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fwd_ret_4 DESC, event_id) / count(*) OVER (PARTITION BY symbol) AS p FROM qs)
SELECT symbol, removed::VARCHAR AS removed, count(*) FILTER (quintile = 5) AS n_high, count(*) FILTER (quintile = 1) AS n_low, round(avg(fwd_ret_4) FILTER (quintile = 5) - avg(fwd_ret_4) FILTER (quintile = 1), 6) AS edge
FROM k CROSS JOIN (SELECT unnest([0.0::DOUBLE, 0.01, 0.05]) AS removed) WHERE p > removed GROUP BY symbol, removed""",
)


@query
def reranked_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = {"all": F.lit(1), "without_week_1": F.when(F.col("week") == 1, 0).otherwise(1), "week_2_twice": F.when(F.col("week") == 2, 2).otherwise(1)}
    return r6(stats.reranked_edges(_factor_rows(spark, sf_dir), ["symbol"], cases, "spread", "fwd_ret_4", "event_id"), "edge")


sql(
    "reranked_edges",
    ROWS,
    """, l AS (SELECT symbol, event_id, spread, fwd_ret_4 AS v, scenario, unnest(range(1, 1 + CASE scenario WHEN 'all' THEN 1 WHEN 'without_week_1' THEN (week <> 1)::INT ELSE 1 + (week = 2)::INT END)) AS copy
  FROM fr CROSS JOIN (SELECT unnest(['all', 'without_week_1', 'week_2_twice']) AS scenario) WHERE spread IS NOT NULL AND fwd_ret_4 IS NOT NULL),
p AS (SELECT *, (row_number() OVER (PARTITION BY symbol, scenario ORDER BY spread, event_id, copy) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY symbol, scenario) AS share FROM l)
SELECT symbol, scenario, count(*) FILTER (share > 0.8) AS n_high, count(*) FILTER (share <= 0.2) AS n_low, round(avg(v) FILTER (share > 0.8) - avg(v) FILTER (share <= 0.2), 6) AS edge FROM p GROUP BY symbol, scenario""",
)


@query
def safety_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.extreme_masks(_factor_rows(spark, sf_dir).where("fwd_mae_4 is not null"), ["symbol"], "spread", "event_id")
    rows = rows.withColumn("liq_2x", F.col("fwd_mae_4") <= -(1 / 2 - 0.005))
    return r6(stats.safety_consistency(rows, {"liq_2x": -1, "fwd_mae_4": 1}, ["week", "symbol"]), "positive_share", "mean_edge")


sql(
    "safety_consistency",
    f"{ROWS}, fm AS (SELECT * FROM fr WHERE fwd_mae_4 IS NOT NULL), {rank_sql('fm', 'spread', 'ed', 'p')}",
    """, f AS (SELECT *, count(spread) OVER (PARTITION BY symbol) >= 30 AND p >= 0.8 AS t, count(spread) OVER (PARTITION BY symbol) >= 30 AND p <= 0.2 AS b FROM ed),
l AS (SELECT symbol, week, t, b, 'liq_2x' AS label, -((fwd_mae_4 <= -(1 / 2 - 0.005))::INT)::DOUBLE AS v FROM f WHERE t OR b UNION ALL SELECT symbol, week, t, b, 'fwd_mae_4', fwd_mae_4 FROM f WHERE t OR b),
g AS (SELECT label, 'all' AS scope, 'all' AS grp, t, b, v FROM l UNION ALL SELECT label, 'week', week::VARCHAR, t, b, v FROM l UNION ALL SELECT label, 'symbol', symbol, t, b, v FROM l),
e AS (SELECT label, scope, grp, avg(v) FILTER (t) - avg(v) FILTER (b) AS edge FROM g GROUP BY ALL)
SELECT label, scope, count(edge) AS n_groups, round(avg((edge > 0)::INT), 6) AS positive_share, round(avg(edge), 6) AS mean_edge FROM e GROUP BY label, scope""",
)


@query
def cross_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = {"momentum": ("trend", 1), "spread": ("range", 1), "activity": ("range", -1)}
    return r6(validate.cross_asset(_factor_rows(spark, sf_dir), F.col("symbol") == "click", ["event_id"], families, "fwd_ret_4", "event_id"), "edge")


sql(
    "cross_asset",
    ROWS,
    """, u AS (SELECT symbol, event_id, fwd_ret_4, 'momentum' AS factor, momentum AS x FROM fr UNION ALL SELECT symbol, event_id, fwd_ret_4, 'spread', spread FROM fr UNION ALL SELECT symbol, event_id, fwd_ret_4, 'activity', activity FROM fr),
b AS (SELECT factor, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM u WHERE symbol = 'click' GROUP BY factor),
p AS (SELECT factor, any_value(lo) AS lo, any_value(hi) AS hi, avg(least(greatest(x, lo), hi)) AS m, stddev_pop(least(greatest(x, lo), hi)) AS sd FROM u JOIN b USING (factor) WHERE symbol = 'click' AND x IS NOT NULL GROUP BY factor),
z AS (SELECT symbol, event_id, fwd_ret_4, factor, (least(greatest(x, lo), hi) - m) / nullif(sd, 0) AS z FROM u JOIN p USING (factor) WHERE x IS NOT NULL),
s AS (SELECT symbol, event_id, fwd_ret_4 AS v, CASE WHEN factor = 'momentum' THEN 'trend' ELSE 'range' END AS family, avg(z * CASE WHEN factor = 'activity' THEN -1 ELSE 1 END) AS score FROM z GROUP BY ALL),
k AS (SELECT *, (row_number() OVER (PARTITION BY symbol, family ORDER BY score, event_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY symbol, family) AS share FROM s WHERE score IS NOT NULL AND v IS NOT NULL),
e AS (SELECT symbol, family, count(*) AS n, symbol = 'click' AS discovery, avg(v) FILTER (share > 0.8) - avg(v) FILTER (share <= 0.2) AS edge FROM k GROUP BY symbol, family)
SELECT e.symbol, e.family, e.n, e.discovery, round(e.edge, 6) AS edge, sign(e.edge) = sign(d.edge) AS same_sign FROM e LEFT JOIN (SELECT family, edge FROM e WHERE discovery) d USING (family)""",
)

# ------------------------------------------------------------------ single rules and plain joins


@query
def unshifted_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars_of(spark, sf_dir).withColumn("range_high", indicators.rolling(F.max("high"), "high", 20)).withColumn("range_low", indicators.rolling(F.min("low"), "low", 20))
    return rows.select("symbol", "bar_ts", "range_high", "range_low")


sql("unshifted_channel", BARS, f"SELECT symbol, bar_ts, {roll('max', 'high', 20)} AS range_high, {roll('min', 'low', 20)} AS range_low FROM bars")


@query
def pieced_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels, returns and forward labels computed piece by piece, each with the rows around it that its frames reach."""

    def compute(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"upper": indicators.donchian(20, "upper"), "lower": indicators.donchian(20, "lower"), "ret_8": indicators.n_return(8)})
        return labels.forward_labels(rows, [8])

    cols = ["upper", "lower", "ret_8", "fwd_ret_8", "fwd_mfe_8", "fwd_mae_8"]
    return r6(indicators.in_pieces(bars_of(spark, sf_dir), compute, 20, 8, size=64).select("symbol", "bar_ts", *cols), *cols)


sql(
    "pieced_channels",
    f"{BARS}, {LABELS}",
    f"SELECT symbol, bar_ts, {roll('max', 'high', 20, 1)} AS upper, {roll('min', 'low', 20, 1)} AS lower, round(close / nullif(lag(close, 8) OVER {W}, 0) - 1, 6) AS ret_8, {r('fwd_ret_8, fwd_mfe_8, fwd_mae_8')} FROM lab",
)


@query
def strength_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.mean_reversion(signal_frame(spark, sf_dir))
    name = indicators.bucket(F.col("trend_strength"), [0.5, 1.0, 1.5, 2.5], ["<=0.5", "<=1", "<=1.5", "<=2.5", ">2.5"])
    return rows.groupBy("symbol", name.alias("bucket")).agg(F.count("*").alias("n"))


sql("strength_buckets", MR, "SELECT symbol, CASE WHEN trend_strength IS NULL THEN 'unknown' WHEN trend_strength <= 0.5 THEN '<=0.5' WHEN trend_strength <= 1 THEN '<=1' WHEN trend_strength <= 1.5 THEN '<=1.5' WHEN trend_strength <= 2.5 THEN '<=2.5' ELSE '>2.5' END AS bucket, count(*) AS n FROM mr GROUP BY ALL")


@query
def market_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumn("year", F.year("exit_time"))
    return bars.market_phase(t, "year", {1992: "bear", 1993: "bull", 1994: "bull", 1996: "range"}).groupBy("symbol", "phase").agg(F.count("*").alias("n"))


sql("market_phases", TRADES, "SELECT symbol, CASE year(exit_time) WHEN 1992 THEN 'bear' WHEN 1993 THEN 'bull' WHEN 1994 THEN 'bull' WHEN 1996 THEN 'range' ELSE 'unknown' END AS phase, count(*) AS n FROM trades GROUP BY ALL")


@query
def phase_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the phase of their bar, joined on symbol and time."""
    phases = state.post_exit_phase(_active(spark, sf_dir), "active").select("symbol", F.col("bar_ts").alias("signal_time"), "bars_since_exit", "phase")
    return _events(spark, sf_dir).select("event_id", "symbol", "signal_time").join(phases, ["symbol", "signal_time"], "left")


sql(
    "phase_join",
    ACTIVE,
    f""", x AS (SELECT *, CASE WHEN active = 0 AND lag(active) OVER {W} = 1 THEN rn END AS ex FROM act), y AS (SELECT *, CASE WHEN active = 0 THEN rn - last_value(ex IGNORE NULLS) OVER {RUN} END AS bars_since_exit FROM x)
SELECT symbol || '_' || strftime(bar_ts, '%Y%m%d%H') AS event_id, symbol, bar_ts AS signal_time, bars_since_exit,
  CASE WHEN active = 1 THEN 'held' WHEN bars_since_exit IS NULL THEN 'idle' WHEN bars_since_exit <= 4 THEN '0-4' WHEN bars_since_exit <= 16 THEN '5-16' WHEN bars_since_exit <= 64 THEN '17-64' ELSE 'idle' END AS phase FROM y WHERE breakout AND atr IS NOT NULL""",
)


@query
def exact_time_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    opens = bars_of(spark, sf_dir).select("symbol", F.col("bar_ts").alias("at"), "open")
    e = _events(spark, sf_dir).select("event_id", "symbol", F.expr("signal_time + interval 3 hours").alias("at"))
    return e.join(opens, ["symbol", "at"], "left")


sql("exact_time_lookup", EVENTS, 'SELECT event_id, ev.symbol, signal_time + INTERVAL 3 HOUR AS "at", b.open FROM ev LEFT JOIN bars b ON b.symbol = ev.symbol AND b.bar_ts = signal_time + INTERVAL 3 HOUR')


@query
def timeframe_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 4-hour row at or before each event, as a whole or not at all."""
    four = indicators.base_indicators(bars_of(spark, sf_dir, "4 hours"), fast=5, slow=20, channel=10, exit_channel=5)
    four = four.select("symbol", F.col("bar_ts").alias("tf_ts"), F.col("ema_fast").alias("tf_fast"), F.col("upper").alias("tf_upper"))
    out = asof.complete_asof(_events(spark, sf_dir).select("event_id", "symbol", "signal_time"), four, "signal_time", "tf_ts", ["tf_ts", "tf_fast", "tf_upper"])
    return r6(out, "tf_fast", "tf_upper")


sql(
    "timeframe_asof",
    f"{EVENTS}, {bars_sql('4 hours', 'b4')}, {signal_sql('b4', 's4', 5, 20, 10, 5)}",
    """SELECT event_id, ev.symbol, signal_time, CASE WHEN upper IS NOT NULL THEN s4.bar_ts END AS tf_ts, CASE WHEN upper IS NOT NULL THEN round(ema_fast, 6) END AS tf_fast, round(upper, 6) AS tf_upper
FROM ev ASOF LEFT JOIN s4 ON ev.symbol = s4.symbol AND ev.signal_time >= s4.bar_ts""",
)


@query
def timeframe_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long where the 4-hour and the hourly means agree upwards, short downwards, else none; and the events that pass a filter of
    direction, location, volume and candle."""
    four = indicators.ema(bars_of(spark, sf_dir, "4 hours"), {"a": 5, "b": 20}).select("symbol", F.col("bar_ts").alias("tf_ts"), "a", "b")
    rows = indicators.volume_features(patterns.location_reasons(_candles(spark, sf_dir)))
    rows = asof.asof(rows.select("symbol", "bar_ts", "ema_fast", "ema_slow", "location", "volume_vs_median", "body"), four, "bar_ts", "tf_ts", ["a", "b"])
    direction = F.when((F.col("a") > F.col("b")) & (F.col("ema_fast") > F.col("ema_slow")), "long").when((F.col("a") < F.col("b")) & (F.col("ema_fast") < F.col("ema_slow")), "short").otherwise("none")
    rows = rows.withColumn("direction", direction)
    checks = {"direction": F.col("direction") != "none", "location": F.col("location") != "", "volume": F.col("volume_vs_median") > 1, "candle": F.col("body").isNull() | (F.col("body") > 0.2)}
    rows = patterns.enhanced_checks(rows, checks)
    return rows.groupBy("symbol", "direction", "all_passed").agg(F.count("*").alias("n"))


def _near(c: str) -> str:
    return f"abs(close - {c}) / nullif(atr, 0) <= 0.35"


sql(
    "timeframe_direction",
    f"{SIG}, {CANDLES}, {bars_sql('4 hours', 'b4')}, {recursive_mean('e4', 'b4', {'a': ('close', 2 / 6), 'b': ('close', 2 / 21)})}",
    f""", v AS (SELECT *, volume / nullif({roll('median', 'volume', 20, 1)}, 0) AS vm FROM candles),
j AS (SELECT v.*, CASE WHEN e4.a > e4.b AND ema_fast > ema_slow THEN 'long' WHEN e4.a < e4.b AND ema_fast < ema_slow THEN 'short' ELSE 'none' END AS direction FROM v ASOF LEFT JOIN e4 ON v.symbol = e4.symbol AND v.bar_ts >= e4.bar_ts)
SELECT symbol, direction, direction <> 'none' AND coalesce(({_near('ema_fast')}), false) | coalesce(({_near('ema_slow')}), false) | coalesce(({_near('upper')}), false) | coalesce(({_near('exit_low')}), false)
  AND coalesce(vm > 1, false) AND (body IS NULL OR body > 0.2) AS all_passed, count(*) AS n FROM j GROUP BY ALL""".replace(") | coalesce(", ") OR coalesce(").replace("'none' AND coalesce(", "'none' AND (coalesce(").replace("false)\n  AND", "false))\n  AND"),
)


@query
def enhanced_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.volume_features(indicators.wilder(signal_frame(spark, sf_dir)))
    rows = rows.withColumn("atr_mean", indicators.rolling(F.avg("atr"), "atr", 20)).withColumn("quiet", (F.col("volume_vs_mean") < 0.8).cast("int"))
    checks = {
        "trend": F.col("close") >= 0.94 * F.col("ema_slow"),
        "volume": indicators.rolling(F.sum("quiet"), "quiet", 3) == 0,
        "volatility": F.col("atr") <= 2.5 * F.col("atr_mean"),
        "rsi": F.col("rsi").between(45, 90),
    }
    rows = patterns.enhanced_checks(rows, checks)
    return rows.groupBy("symbol", "all_passed", *[F.col("checks")[c].alias(c) for c in checks]).agg(F.count("*").alias("n"))


sql(
    "enhanced_filters",
    f"{WILDER}, {signal_sql('bars', 'sig')}",
    f""", v AS (SELECT sig.*, rsi, (volume / nullif({roll('avg', 'volume', 20, 1)}, 0) < 0.8)::INT AS quiet, {roll('avg', 'atr', 20)} AS am FROM sig JOIN (SELECT symbol AS ws, bar_ts AS wt, rsi FROM wilder) ON ws = symbol AND wt = bar_ts),
c AS (SELECT symbol, coalesce(close >= 0.94 * ema_slow, false) AS trend, coalesce({roll('sum', 'quiet', 3)} = 0, false) AS volume, coalesce(atr <= 2.5 * am, false) AS volatility, coalesce(rsi BETWEEN 45 AND 90, false) AS rsi FROM v)
SELECT symbol, trend AND volume AND volatility AND rsi AS all_passed, trend, volume, volatility, rsi, count(*) AS n FROM c GROUP BY ALL""",
)


@query
def family_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patterns.location_reasons(signal_frame(spark, sf_dir)).select("symbol", "bar_ts", "location")
    out = asof.explode_map(rows, "location", {"ema_fast": "mean", "ema_slow": "mean", "upper": "channel"}, ["ema_fast"], "family")
    return out.groupBy("symbol", "token", "family").agg(F.count("*").alias("n"))


sql(
    "family_map",
    SIG,
    f"""SELECT symbol, 'ema_slow' AS token, 'mean' AS family, count(*) AS n FROM sig WHERE {_near('ema_slow')} GROUP BY symbol UNION ALL SELECT symbol, 'upper', 'channel', count(*) FROM sig WHERE {_near('upper')} GROUP BY symbol
UNION ALL SELECT symbol, 'exit_low', 'unmapped', count(*) FROM sig WHERE {_near('exit_low')} GROUP BY symbol""",
)


@query
def semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with and without an accepted event of their symbol and exit month."""
    t = trades(spark, sf_dir).withColumn("month", F.date_format("exit_time", "yyyy-MM"))
    good = t.groupBy("symbol", "month").agg(F.avg((F.col("net_pnl") > 0).cast("double")).alias("w")).where("w > 0.5").select("symbol", "month")
    return t.join(good, ["symbol", "month"], "left_semi").select("trade_id", F.lit("accepted").alias("kind")).unionByName(t.join(good, ["symbol", "month"], "left_anti").select("trade_id", F.lit("rejected").alias("kind")))


sql(
    "semi_and_anti",
    TRADES,
    """, t AS (SELECT *, strftime(exit_time, '%Y-%m') AS month FROM trades), g AS (SELECT symbol, month FROM t GROUP BY ALL HAVING avg((net_pnl > 0)::INT) > 0.5)
SELECT trade_id, CASE WHEN g.symbol IS NULL THEN 'rejected' ELSE 'accepted' END AS kind FROM t LEFT JOIN g USING (symbol, month)""",
)


@query
def metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each event's symbol and month joined onto events, and the base-against-test comparison of the two sides."""
    t = trades(spark, sf_dir).withColumn("month", F.date_format("exit_time", "yyyy-MM"))
    side = t.groupBy("symbol", "month", "side").agg(F.avg("ret").alias("mean_ret"))
    base, test = (side.where(F.col("side") == s).select("symbol", "month", F.col("mean_ret").alias(n)) for s, n in (("LONG", "base"), ("SHORT", "test")))
    both = base.join(test, ["symbol", "month"]).withColumn("delta", F.col("test") - F.col("base"))
    return r6(t.select("trade_id", "symbol", "month").join(both, ["symbol", "month"], "left"), "base", "test", "delta")


sql(
    "metadata_join",
    TRADES,
    """, t AS (SELECT *, strftime(exit_time, '%Y-%m') AS month FROM trades), s AS (SELECT symbol, month, avg(ret) FILTER (side = 'LONG') AS a, avg(ret) FILTER (side = 'SHORT') AS b FROM t GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL)
SELECT trade_id, symbol, month, round(a, 6) AS base, round(b, 6) AS test, round(b - a, 6) AS delta FROM t LEFT JOIN s USING (symbol, month)""",
)


@query
def position_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("stop", ledger.stop_level(F.col("close"), F.col("atr"), 2.0, 0.3))
    e = e.withColumn("fixed", ledger.exposure("fixed", F.col("close"), leverage=2.0)).withColumn("risked", ledger.exposure("risk", F.col("close"), F.col("stop"), 3.0, 0.05))
    return r6(e.select("event_id", "stop", "fixed", "risked"), "stop", "risked")


sql(
    "position_sizes",
    EVENTS,
    """, s AS (SELECT *, close - least(2.0 * atr, 0.3 * close) AS stop FROM ev)
SELECT event_id, round(stop, 6) AS stop, 2.0::DOUBLE AS fixed, round(CASE WHEN abs(close - stop) / nullif(close, 0) > 0 THEN least(0.05 / (abs(close - stop) / close), 3.0) ELSE 0 END, 6) AS risked FROM s""",
)


@query
def liquidation_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearer of stop and liquidation price is the trigger, and a bar that reaches both liquidates."""
    rows = written(signal_frame(spark, sf_dir), "signals")
    e = _events(spark, sf_dir, rows).select("event_id", "symbol", F.col("signal_time").alias("entry_time"), F.col("close").alias("entry_price"), (F.col("close") - 2 * F.col("atr")).alias("stop"))
    out = ledger.resolve_liquidations(e, rows, "exit_signal", "stop", 3.0)
    return r6(out.select("event_id", "trigger", "exit_time", "exit_price", "exit_reason"), "trigger", "exit_price")


sql(
    "liquidation_exits",
    EVENTS,
    """, e AS (SELECT event_id, symbol, signal_time AS et, close - 2 * atr AS stop, close * (1 - (1 / 3.0::DOUBLE - 0.005)) AS liq FROM ev), z AS (SELECT symbol, max(bar_ts) AS lt, arg_max(close, bar_ts) AS lc FROM bars GROUP BY symbol),
u AS (SELECT e.*, greatest(stop, liq) AS trg, f.bar_ts AS ft, coalesce(f.close, lc) AS c, coalesce(f.bar_ts, lt) AS until FROM e ASOF LEFT JOIN (SELECT * FROM sig WHERE exit_signal) f ON e.symbol = f.symbol AND e.et < f.bar_ts JOIN z ON z.symbol = e.symbol),
h AS (SELECT event_id, arg_min(b.bar_ts, b.bar_ts) AS st, arg_min(b.low, b.bar_ts) AS lo FROM u JOIN bars b ON b.symbol = u.symbol AND b.bar_ts > u.et AND b.bar_ts <= u.until AND b.low <= trg GROUP BY event_id)
SELECT event_id, round(trg, 6) AS trigger, coalesce(st, until) AS exit_time, round(CASE WHEN lo <= liq THEN liq WHEN st IS NOT NULL THEN stop ELSE c END, 6) AS exit_price,
  CASE WHEN lo <= liq THEN 'liquidation' WHEN st IS NOT NULL THEN 'stop' WHEN ft IS NOT NULL THEN 'signal' ELSE 'end_of_data' END AS exit_reason FROM u LEFT JOIN h USING (event_id)""",
)


@query
def conversion_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = trades(spark, sf_dir).select("symbol", "side", "trade_id", "entry_time", "exit_time", F.when(F.col("trade_id") % 7 != 0, F.col("notional")).alias("entry_price"), F.when(F.col("n_lines") > 1, F.col("ret")).alias("stop"))
    kept = selection.non_overlapping(e.where("entry_price is not null and stop is not null"), ["symbol", "side"], "entry_time", "exit_time", "trade_id")
    return ledger.conversion_status(e, kept, "trade_id").groupBy("symbol", "status").agg(F.count("*").alias("n"))


sql(
    "conversion_status",
    f"""{TRADES}, e AS (SELECT *, trade_id % 7 = 0 AS no_price, n_lines <= 1 AS no_stop FROM trades), o AS (SELECT symbol, side, trade_id, entry_time, exit_time, row_number() OVER (PARTITION BY symbol, side ORDER BY entry_time, trade_id) AS rn FROM e WHERE NOT no_price AND NOT no_stop),
k AS (SELECT symbol, side, rn, exit_time AS until, true AS kept FROM o WHERE rn = 1
  UNION ALL SELECT o.symbol, o.side, o.rn, CASE WHEN o.entry_time > k.until THEN o.exit_time ELSE k.until END, o.entry_time > k.until FROM k JOIN o ON o.symbol = k.symbol AND o.side = k.side AND o.rn = k.rn + 1)""",
    """, x AS (SELECT trade_id, kept FROM o JOIN k USING (symbol, side, rn))
SELECT symbol, CASE WHEN no_price THEN 'missing_execution' WHEN no_stop THEN 'invalid_atr' WHEN kept THEN 'traded' ELSE 'ignored_due_to_position' END AS status, count(*) AS n FROM e LEFT JOIN x USING (trade_id) GROUP BY ALL""",
)


@query
def schema_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = [("event_id", "string"), ("signal_time", "timestamp_ntz"), ("close", "double"), ("atr", "float"), ("label", "string")]
    rows = _events(spark, sf_dir)
    found = quality.validate_schema(rows, contract)
    return found.join(F.broadcast(rows.agg(F.count("*").alias("n_rows"))))  # one row


sql("schema_contract", EVENTS, "SELECT field, type, status, (SELECT count(*) FROM ev) AS n_rows FROM (VALUES ('event_id', 'string', 'ok'), ('signal_time', 'timestamp_ntz', 'ok'), ('close', 'double', 'ok'), ('atr', 'float', 'is double'), ('label', 'string', 'missing')) x(field, type, status)")


@query
def state_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar with labels, once for each side."""
    rows = labels.forward_labels(signal_frame(spark, sf_dir), [8]).where("fwd_ret_8 is not null")
    rows = labels.directional(rows.withColumn("side", F.explode(F.array(F.lit("LONG"), F.lit("SHORT")))), [8])
    return r6(rows.groupBy("symbol", "side").agg(F.count("*").alias("n"), F.avg("dir_ret_8").alias("mean_ret"), F.avg("dir_mae_8").alias("mean_mae")), "mean_ret", "mean_mae")


sql(
    "state_pool",
    f"{BARS}, {LABELS}",
    """, s AS (SELECT symbol, 'LONG' AS side, fwd_ret_8 AS r, fwd_mae_8 AS a FROM lab WHERE fwd_ret_8 IS NOT NULL UNION ALL SELECT symbol, 'SHORT', -fwd_ret_8, 1 / (1 + fwd_mfe_8) - 1 FROM lab WHERE fwd_ret_8 IS NOT NULL)
SELECT symbol, side, count(*) AS n, round(avg(r), 6) AS mean_ret, round(avg(a), 6) AS mean_mae FROM s GROUP BY ALL""",
)


@query
def reversion_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of factors by whether a deviation went back to the mean or on within 8 bars."""
    rows = indicators.mean_reversion(signal_frame(spark, sf_dir))
    rows = labels.forward_labels(rows, [8]).where("abs(deviation) >= 1 and fwd_ret_8 is not null")
    back = F.when(F.col("deviation") > 0, F.col("fwd_ret_8") < 0).otherwise(F.col("fwd_ret_8") > 0)
    out = rows.withColumn("outcome", F.when(back, "reversion").otherwise("continuation")).groupBy("symbol", "outcome")
    return r6(out.agg(F.count("*").alias("n"), F.avg("trend_strength").alias("strength"), F.avg(F.abs("deviation")).alias("deviation"), F.avg("fwd_ret_8").alias("mean_ret")), "strength", "deviation", "mean_ret")


sql(
    "reversion_diagnostics",
    f"{MR}, {LABELS}",
    """, d AS (SELECT mr.*, fwd_ret_8 AS f, CASE WHEN CASE WHEN deviation > 0 THEN fwd_ret_8 < 0 ELSE fwd_ret_8 > 0 END THEN 'reversion' ELSE 'continuation' END AS outcome FROM mr JOIN lab USING (symbol, bar_ts) WHERE abs(deviation) >= 1 AND fwd_ret_8 IS NOT NULL)
SELECT symbol, outcome, count(*) AS n, round(avg(trend_strength), 6) AS strength, round(avg(abs(deviation)), 6) AS deviation, round(avg(f), 6) AS mean_ret FROM d GROUP BY ALL""",
)

# ------------------------------------------------------------------ summaries of events, modes and windows


def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.post_exit_phase(_active(spark, sf_dir), "active").select("symbol", "bar_ts", "phase")


PHASES = f"""{ACTIVE}, ph0 AS (SELECT *, CASE WHEN active = 0 AND lag(active) OVER {W} = 1 THEN rn END AS ex FROM act), ph1 AS (SELECT *, CASE WHEN active = 0 THEN rn - last_value(ex IGNORE NULLS) OVER {RUN} END AS since FROM ph0),
phases AS (SELECT symbol, bar_ts, CASE WHEN active = 1 THEN 'held' WHEN since IS NULL THEN 'idle' WHEN since <= 4 THEN '0-4' WHEN since <= 16 THEN '5-16' WHEN since <= 64 THEN '17-64' ELSE 'idle' END AS phase FROM ph1)"""
MRC_ONLY = MRC.removeprefix(SIG)


@query
def exit_window_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by symbol, side and the phase after an exit that they fall in."""
    rows = patterns.mean_reversion_candidates(labels.forward_labels(indicators.mean_reversion(signal_frame(spark, sf_dir)), [8]))
    rows = labels.directional(rows, [8]).join(_phases(spark, sf_dir).where("phase <> 'held'"), ["symbol", "bar_ts"])
    return r6(rows.groupBy("candidate", "symbol", "side", "phase").agg(F.count("*").alias("n"), F.avg("dir_ret_8").alias("mean_ret")), "mean_ret")


sql(
    "exit_window_candidates",
    f"{PHASES}{MRC_ONLY}, {LABELS}",
    """SELECT candidate, mrc.symbol, side, phase, count(*) AS n, round(avg(CASE WHEN side = 'SHORT' THEN -fwd_ret_8 ELSE fwd_ret_8 END), 6) AS mean_ret
FROM mrc JOIN lab USING (symbol, bar_ts) JOIN phases USING (symbol, bar_ts) WHERE phase <> 'held' GROUP BY candidate, mrc.symbol, side, phase""",
)


@query
def early_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.forward_labels(indicators.mean_reversion(_candles(spark, sf_dir)), [1, 4, 8])
    rows = labels.directional(events.directional_breakouts(rows), [1, 4, 8]).where("dir_ret_8 is not null")
    conditions = {
        "mfe_1_low": F.col("dir_mfe_1") < 0.02,
        "mfe_4_low": F.col("dir_mfe_4") < 0.05,
        "mae_1_deep": F.col("dir_mae_1") < -0.1,
        "reclaimed": F.col("dir_ret_1") < 0,
        "weak_body": F.col("signed_body") < 0.2,
        "weak_location": F.col("side_location") < 0.6,
        "thin_volume": F.col("volume") < F.col("volume_mean"),
        "far": F.col("strength") > 1,
    }
    return r6(events.early_failures(rows, conditions, F.col("dir_ret_8") < 0), "fail_rate", "other_rate")


sql(
    "early_failures",
    f"{MRK}, {LABELS}",
    """, e AS (SELECT m.*, CASE WHEN m.close > range_upper THEN 1 ELSE -1 END AS d, fwd_ret_1, fwd_mfe_1, fwd_mae_1, fwd_mfe_4, fwd_mae_4, fwd_ret_8 FROM mrk m JOIN lab l USING (symbol, bar_ts) WHERE (m.close > range_upper OR m.close < range_lower) AND fwd_ret_8 IS NOT NULL),
f AS (SELECT *, CASE WHEN d = 1 THEN fwd_mfe_1 ELSE 1 / (1 + fwd_mae_1) - 1 END AS f1, CASE WHEN d = 1 THEN fwd_mfe_4 ELSE 1 / (1 + fwd_mae_4) - 1 END AS f4, CASE WHEN d = 1 THEN fwd_mae_1 ELSE 1 / (1 + fwd_mfe_1) - 1 END AS a1, d * fwd_ret_8 < 0 AS failed FROM e),
c AS (SELECT CASE WHEN d = 1 THEN 'LONG' ELSE 'SHORT' END AS side, failed::INT AS failed, unnest([{'n': 'mfe_1_low', 'm': f1 < 0.02}, {'n': 'mfe_4_low', 'm': f4 < 0.05}, {'n': 'mae_1_deep', 'm': a1 < -0.1}, {'n': 'reclaimed', 'm': d * fwd_ret_1 < 0},
  {'n': 'weak_body', 'm': CASE WHEN close >= open THEN body ELSE -body END * d < 0.2}, {'n': 'weak_location', 'm': CASE WHEN d = 1 THEN close_location ELSE 1 - close_location END < 0.6}, {'n': 'thin_volume', 'm': volume < volume_mean},
  {'n': 'far', 'm': CASE WHEN d = 1 THEN close - range_upper ELSE range_lower - close END / nullif(atr, 0) > 1}]) AS x FROM f),
g AS (SELECT side AS direction, failed, x.n AS condition, coalesce(x.m, false) AS met FROM c UNION ALL SELECT 'ALL', failed, x.n, coalesce(x.m, false) FROM c)
SELECT condition, direction, count(*) FILTER (met) AS n, round(avg(failed) FILTER (met), 6) AS fail_rate, round(avg(failed) FILTER (NOT met), 6) AS other_rate FROM g GROUP BY condition, direction""",
)


@query
def high_risk_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the first gate does not accept."""
    rows = patterns.gates(_scored(spark, sf_dir), [("s", 0.7, -1)], {"G1": (1, 1)})
    return rows.where(~F.col("accepted")).select("event_id", "symbol")


sql("high_risk_mask", SCORED, "SELECT event_id, symbol FROM sc WHERE NOT coalesce(-s >= -0.7, false)")


@query
def segment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per trend segment the breakouts and ticks inside it."""
    seg = state.segments(_active(spark, sf_dir), "active").select("symbol", "segment_id", "segment_start", "segment_end")
    out = seg
    for points, at, name in ((_events(spark, sf_dir), "signal_time", "n_events"), (ticks(spark, sf_dir), "ts", "n_ticks")):
        held = asof.containment(points.select("symbol", at), seg, at, "segment_start", "segment_end", ["segment_id", "segment_end"]).where("mapped")
        out = out.join(held.groupBy("symbol", "segment_id").agg(F.count("*").alias(name)), ["symbol", "segment_id"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


SEGMENTS = f"""{ACTIVE}, sg0 AS (SELECT *, sum(active_first::INT) OVER {RUN} AS segment_id FROM act), sg AS (SELECT symbol, segment_id::BIGINT AS segment_id, min(bar_ts) AS segment_start, max(bar_ts) AS segment_end FROM sg0 WHERE active = 1 GROUP BY symbol, segment_id)"""
sql(
    "segment_events",
    SEGMENTS,
    """, e AS (SELECT s.symbol, segment_id, count(*) AS n FROM sg s JOIN sig x ON x.symbol = s.symbol AND x.bar_ts BETWEEN segment_start AND segment_end AND breakout AND atr IS NOT NULL GROUP BY ALL),
t AS (SELECT s.symbol, segment_id, count(*) AS n FROM sg s JOIN ticks x ON x.symbol = s.symbol AND x.ts BETWEEN segment_start AND segment_end GROUP BY ALL)
SELECT sg.symbol, sg.segment_id, segment_start, segment_end, coalesce(e.n, 0) AS n_events, coalesce(t.n, 0) AS n_ticks FROM sg LEFT JOIN e USING (symbol, segment_id) LEFT JOIN t USING (symbol, segment_id)""",
)


@query
def touches_in_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.touches_in_r(_pool(spark, sf_dir), [(0.5, 0.5), (1, 1), (2, 1)], 8)
    return rows.select("symbol", "bar_ts", "side", "target_r", "stop_r", "outcome", "bars")


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar with an ATR as a candidate of both sides, at risk of one ATR."""
    rows = signal_frame(spark, sf_dir).withColumn("risk", F.nullif(F.col("atr"), F.lit(0.0)))
    return rows.withColumn("side", F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))).alias("side")).transform(lambda df: df.withColumn("symbol", F.concat_ws("|", "symbol", "side")))


sql(
    "touches_in_r",
    SIG,
    f""", x AS (SELECT *, row_number() OVER {W} AS rn FROM sig), s AS (SELECT *, unnest(['LONG', 'SHORT']) AS side FROM x), m(target_r, stop_r) AS (VALUES (0.5::DOUBLE, 0.5::DOUBLE), (1, 1), (2, 1)),
h AS (SELECT s.symbol, s.bar_ts, s.side, target_r, stop_r, min(p.rn - s.rn) FILTER (CASE WHEN s.side = 'LONG' THEN p.high - s.close ELSE s.close - p.low END / nullif(s.atr, 0) >= target_r) AS u,
  min(p.rn - s.rn) FILTER (CASE WHEN s.side = 'LONG' THEN s.close - p.low ELSE p.high - s.close END / nullif(s.atr, 0) >= stop_r) AS d FROM s CROSS JOIN m LEFT JOIN x p ON p.symbol = s.symbol AND p.rn BETWEEN s.rn + 1 AND s.rn + 8 GROUP BY ALL)
SELECT symbol || '|' || side AS symbol, bar_ts, side, target_r, stop_r, CASE WHEN u IS NULL AND d IS NULL THEN 'none' WHEN u = d THEN 'ambiguous' WHEN d IS NULL OR u < d THEN 'target' ELSE 'stop' END AS outcome, least(u, d)::INT AS bars FROM h""",
)


@query
def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical event table: breakout bars with the next open, patterns, factors and labels under one id."""
    rows = indicators.event_factors(signal_frame(spark, sf_dir), short=8, long=24, rank_n=60)
    w = indicators.series()
    rows = rows.withColumns({"execution_time": F.lead("bar_ts").over(w), "execution_open": F.lead("open").over(w), "engulfing": patterns.bullish_engulfing()})
    rows = labels.forward_labels(rows, [4, 8]).where("breakout and atr is not null")
    cols = ["execution_open", "ret_short", "ema_gap", "volume_z", "fwd_ret_4", "fwd_mae_8"]
    rows = rows.select(F.concat_ws("_", "symbol", F.date_format("bar_ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("event_id"), "symbol", "execution_time", "engulfing", *cols)
    return r6(rows, *cols)


sql(
    "event_table",
    f"{FACTORS}, {LABELS}",
    f""", x AS (SELECT f.*, lead(bar_ts) OVER {W} AS et, lead(open) OVER {W} AS eo, coalesce(lag(close) OVER {W} < lag(open) OVER {W} AND close > open AND open <= lag(close) OVER {W} AND close >= lag(open) OVER {W}, false) AS engulfing FROM factors f)
SELECT symbol || '_' || strftime(bar_ts, '%Y-%m-%dT%H:%M:%S') AS event_id, symbol, et AS execution_time, engulfing, round(eo, 6) AS execution_open, round(ret_short, 6) AS ret_short, round(ema_gap, 6) AS ema_gap, round(volume_z, 6) AS volume_z,
  round(fwd_ret_4, 6) AS fwd_ret_4, round(fwd_mae_8, 6) AS fwd_mae_8 FROM x JOIN (SELECT symbol, bar_ts, fwd_ret_4, fwd_mae_8 FROM lab) l USING (symbol, bar_ts) WHERE breakout AND atr IS NOT NULL""",
)


@query
def leverage_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean return per fixed leverage and for a ladder of drawdown, recent losses and rank."""
    t = state.recent_losses(trades(spark, sf_dir), ["symbol"], ["exit_time", "trade_id"], "net_pnl", 5)
    curve = metrics.drawdowns(ledger.equity_curve(t, ["symbol"], ["exit_time", "trade_id"], "net_pnl", 1e6), ["symbol"], ["exit_time", "trade_id"], "equity")
    ladder = ledger.leverage_ladder(F.col("drawdown"), F.col("recent_losses"), F.lit(0.5), [(0.01, 1, 0.8, 5.0), (0.05, 3, 0.8, 3.0)], 1.0)
    modes = F.array(*[F.struct(F.lit(f"fixed_{x}").alias("mode"), F.lit(float(x)).alias("leverage")) for x in (1, 3, 10, 20)], F.struct(F.lit("ladder").alias("mode"), ladder.alias("leverage")))
    rows = curve.select("symbol", "ret", F.inline(modes))
    return r6(rows.groupBy("symbol", "mode").agg(F.count("*").alias("n"), F.avg("leverage").alias("mean_leverage"), F.avg(F.col("ret") * F.col("leverage")).alias("mean_ret")), "mean_leverage", "mean_ret")


sql(
    "leverage_modes",
    TRADES,
    f""", a AS (SELECT *, 1e6 + sum(net_pnl) OVER {T[:-1]} ROWS UNBOUNDED PRECEDING) AS eq, coalesce(sum((net_pnl <= 0)::INT) OVER {T[:-1]} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS losses FROM trades),
b AS (SELECT *, eq / max(eq) OVER {T[:-1]} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM a),
m AS (SELECT symbol, ret, unnest([{{'mode': 'fixed_1', 'x': 1.0::DOUBLE}}, {{'mode': 'fixed_3', 'x': 3.0}}, {{'mode': 'fixed_10', 'x': 10.0}}, {{'mode': 'fixed_20', 'x': 20.0}},
  {{'mode': 'ladder', 'x': CASE WHEN dd >= -0.01 AND losses <= 1 THEN 5.0::DOUBLE WHEN dd >= -0.05 AND losses <= 3 THEN 3.0 ELSE 1.0 END}}]) AS o FROM b)
SELECT symbol, o.mode AS mode, count(*) AS n, round(avg(o.x), 6) AS mean_leverage, round(avg(ret * o.x), 6) AS mean_ret FROM m GROUP BY ALL""",
)


@query
def strict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per symbol: trades, liquidations and their rate, counts by exit reason and the lowest compounded balance."""
    rows = written(signal_frame(spark, sf_dir), "signals")
    e = _events(spark, sf_dir, rows).select("event_id", "symbol", F.col("signal_time").alias("entry_time"), F.col("close").alias("entry_price"), (F.col("close") - 2 * F.col("atr")).alias("stop"))
    out = ledger.resolve_liquidations(e, rows, "exit_signal", "stop", 3.0).withColumn("ret", F.col("exit_price") / F.nullif(F.col("entry_price"), F.lit(0.0)) - 1)
    out = ledger.compound(out, ["symbol"], ["entry_time", "event_id"], "ret", 1000.0)
    of = lambda r: F.count_if(F.col("exit_reason") == r)
    found = out.groupBy("symbol").agg(F.count("*").alias("n_trades"), of("liquidation").alias("n_liquidated"), of("stop").alias("n_stop"), of("signal").alias("n_signal"), F.min("balance_after").alias("min_balance"))
    return r6(found.withColumn("liquidation_rate", F.col("n_liquidated") / F.col("n_trades")), "liquidation_rate", "min_balance")


sql(
    "strict_summary",
    EVENTS,
    """, e AS (SELECT event_id, symbol, signal_time AS et, close, close - 2 * atr AS stop, close * (1 - (1 / 3.0::DOUBLE - 0.005)) AS liq FROM ev), z AS (SELECT symbol, max(bar_ts) AS lt, arg_max(close, bar_ts) AS lc FROM bars GROUP BY symbol),
u AS (SELECT e.*, greatest(stop, liq) AS trg, f.bar_ts AS ft, coalesce(f.close, lc) AS c, coalesce(f.bar_ts, lt) AS until FROM e ASOF LEFT JOIN (SELECT * FROM sig WHERE exit_signal) f ON e.symbol = f.symbol AND e.et < f.bar_ts JOIN z ON z.symbol = e.symbol),
h AS (SELECT event_id, arg_min(b.low, b.bar_ts) AS lo FROM u JOIN bars b ON b.symbol = u.symbol AND b.bar_ts > u.et AND b.bar_ts <= u.until AND b.low <= trg GROUP BY event_id),
x AS (SELECT u.symbol, et, u.event_id, lo, liq, ft, CASE WHEN lo <= liq THEN liq WHEN lo IS NOT NULL THEN stop ELSE c END / nullif(u.close, 0) - 1 AS r FROM u LEFT JOIN h USING (event_id)),
y AS (SELECT *, 1000 * exp(sum(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY et, event_id ROWS UNBOUNDED PRECEDING)) AS b FROM x)
SELECT symbol, count(*) AS n_trades, count(*) FILTER (lo <= liq) AS n_liquidated, count(*) FILTER (lo > liq) AS n_stop, count(*) FILTER (lo IS NULL AND ft IS NOT NULL) AS n_signal, round(min(b), 6) AS min_balance, round(count(*) FILTER (lo <= liq) / count(*), 6) AS liquidation_rate FROM y GROUP BY symbol""",
)


@query
def prototype_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event summary by prototype and horizon, and by week, from the long form of the labels."""
    rows = patterns.masks(_scored(spark, sf_dir), {"P0": F.lit(True), "P1": F.col("m") >= 0.8, "P2": F.col("s") <= 0.2})
    long = labels.unpivot_labels(rows, ["prototype", "week"], [1, 4, 8]).where("fwd_ret is not null").withColumn("horizon", F.col("horizon").cast("string"))
    out = metrics.grouped_summary(long, [["prototype", "horizon"], ["prototype", "week"]], "fwd_ret")
    return r6(out.drop("profit_factor"), "mean", "median", "positive_rate")


sql(
    "prototype_horizons",
    SCORED,
    """, p AS (SELECT 'P0' AS prototype, * FROM sc UNION ALL SELECT 'P1', * FROM sc WHERE m >= 0.8 UNION ALL SELECT 'P2', * FROM sc WHERE s <= 0.2),
l AS (SELECT prototype, week::VARCHAR AS week, '1' AS horizon, fwd_ret_1 AS v FROM p UNION ALL SELECT prototype, week::VARCHAR, '4', fwd_ret_4 FROM p UNION ALL SELECT prototype, week::VARCHAR, '8', fwd_ret_8 FROM p)
SELECT CASE WHEN GROUPING(horizon) = 0 THEN 'prototype,horizon' ELSE 'prototype,week' END AS grouping, prototype, horizon, week, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(avg((v > 0)::INT), 6) AS positive_rate
FROM l WHERE v IS NOT NULL GROUP BY GROUPING SETS ((prototype, horizon), (prototype, week))""",
)


@query
def failure_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses by symbol, year, side and exit reason: how many, their sum and their share of all losses."""
    t = trades(spark, sf_dir).where("net_pnl <= 0").withColumn("year", F.year("exit_time").cast("string"))
    by = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("grp")) for c in ("symbol", "year", "side", "exit_reason")])
    rows = t.select("net_pnl", F.inline(by)).groupBy("dimension", "grp").agg(F.count("*").alias("n"), F.sum("net_pnl").alias("net"))
    whole = t.agg(F.sum("net_pnl").alias("all"))
    out = rows.join(F.broadcast(whole)).withColumn("share", F.col("net") / F.nullif(F.col("all"), F.lit(0.0))).drop("all")  # one row
    return r6(out.withColumn("net", F.round("net", 2)), "share")


sql(
    "failure_attribution",
    TRADES,
    """, t AS (SELECT * FROM trades WHERE net_pnl <= 0), l AS (SELECT 'symbol' AS dimension, symbol AS grp, net_pnl FROM t UNION ALL SELECT 'year', year(exit_time)::VARCHAR, net_pnl FROM t UNION ALL SELECT 'side', side, net_pnl FROM t UNION ALL SELECT 'exit_reason', exit_reason, net_pnl FROM t)
SELECT dimension, grp, count(*) AS n, round(sum(net_pnl), 2) AS net, round(sum(net_pnl) / (SELECT sum(net_pnl) FROM t), 6) AS share FROM l GROUP BY dimension, grp""",
)


@query
def failure_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst trades of each symbol and those of each side, as one table without repeats, with the label of their month."""
    t = trades(spark, sf_dir).withColumn("month", F.date_format("exit_time", "yyyy-MM"))
    worst = lambda k: metrics.top_rows(t, [k], "net_pnl", "trade_id", 5).where("rank_bottom <= 5").select("trade_id", "month", F.lit(k).alias("source"))
    cases = worst("symbol").unionByName(worst("side"), allowMissingColumns=True).groupBy("trade_id", "month").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    label = t.groupBy("month").agg(F.when(F.sum("net_pnl") > 0, "good").otherwise("bad").alias("label"))
    return cases.join(label, "month", "left")


sql(
    "failure_cases",
    TRADES,
    """, t AS (SELECT *, strftime(exit_time, '%Y-%m') AS month FROM trades),
c AS (SELECT trade_id, month, 'symbol' AS source FROM t QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY net_pnl, trade_id) <= 5 UNION ALL SELECT trade_id, month, 'side' FROM t QUALIFY row_number() OVER (PARTITION BY side ORDER BY net_pnl, trade_id) <= 5)
SELECT trade_id, c.month, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, any_value(label) AS label FROM c JOIN (SELECT month, CASE WHEN sum(net_pnl) > 0 THEN 'good' ELSE 'bad' END AS label FROM t GROUP BY month) l ON l.month = c.month GROUP BY trade_id, c.month""",
)


@query
def walk_forward_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-overlapping, compounded ledger of each walk-forward window's test part, side and size."""
    t = trades(spark, sf_dir).select("side", "trade_id", "entry_time", "exit_time", "ret")
    held = validate.in_windows(t, validate.walk_forward(t, "entry_time", 12, 3, 3), "entry_time").where("part = 'test'")
    kept = selection.non_overlapping(held.select("window_id", "side", "trade_id", "entry_time", "exit_time", "ret"), ["window_id", "side"], "entry_time", "exit_time", "trade_id")
    sized = kept.withColumn("size", F.explode(F.array(F.lit(1.0), F.lit(2.0)))).withColumn("sized_ret", F.col("size") * F.col("ret"))
    run = ["window_id", "side", "size"]
    out = metrics.drawdowns(ledger.compound(sized, run, ["entry_time", "trade_id"], "sized_ret", 1000.0), run, ["entry_time", "trade_id"], "balance_after")
    return r6(out.groupBy(*run).agg(F.count("*").alias("n"), F.max_by("balance_after", F.struct("entry_time", "trade_id")).alias("final"), F.min("drawdown").alias("max_drawdown")), "final", "max_drawdown")


sql(
    "walk_forward_ledger",
    f"""{TRADES}, s AS (SELECT date_trunc('month', min(entry_time)) AS a, date_trunc('month', max(entry_time)) AS b FROM trades),
w AS (SELECT row_number() OVER (ORDER BY t) - 1 AS window_id, t AS test_start FROM (SELECT unnest(generate_series(a + INTERVAL 12 MONTH, b - INTERVAL 2 MONTH, INTERVAL 3 MONTH)) AS t FROM s)),
o AS (SELECT window_id, side, trade_id, entry_time, exit_time, ret, row_number() OVER (PARTITION BY window_id, side ORDER BY entry_time, trade_id) AS rn FROM trades JOIN w ON entry_time >= test_start AND entry_time < test_start + INTERVAL 3 MONTH),
k AS (SELECT window_id, side, rn, exit_time AS until, true AS kept FROM o WHERE rn = 1
  UNION ALL SELECT o.window_id, o.side, o.rn, CASE WHEN o.entry_time > k.until THEN o.exit_time ELSE k.until END, o.entry_time > k.until FROM k JOIN o ON o.window_id = k.window_id AND o.side = k.side AND o.rn = k.rn + 1)""",
    """, x AS (SELECT o.*, size FROM o JOIN k USING (window_id, side, rn) CROSS JOIN (SELECT unnest([1.0::DOUBLE, 2.0]) AS size) WHERE kept),
y AS (SELECT *, 1000 * exp(sum(ln(1 + size * ret)) OVER (PARTITION BY window_id, side, size ORDER BY entry_time, trade_id ROWS UNBOUNDED PRECEDING)) AS b FROM x),
z AS (SELECT *, b / max(b) OVER (PARTITION BY window_id, side, size ORDER BY entry_time, trade_id ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM y)
SELECT window_id::INT AS window_id, side, size, count(*) AS n, round(arg_max(b, (entry_time, trade_id)), 6) AS final, round(min(dd), 6) AS max_drawdown FROM z GROUP BY window_id, side, size""",
)


@query
def yearly_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per symbol and year: trades, mean return, profit factor and whether the sample is large enough to judge."""
    rows = trades(spark, sf_dir).groupBy("symbol", F.year("exit_time").alias("year")).agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret"), metrics.profit_factor("net_pnl", "b").alias("profit_factor"))
    status = validate.ladder([(F.col("n") < 60, "insufficient_sample"), (F.col("profit_factor") < 1, "weak")], "ok")
    return r6(rows.withColumn("status", status), "mean_ret", "profit_factor")


sql(
    "yearly_check",
    TRADES,
    f""", y AS (SELECT symbol, year(exit_time)::INT AS year, count(*) AS n, avg(ret) AS mean_ret, {pf('net_pnl')} AS profit_factor FROM trades GROUP BY ALL)
SELECT symbol, year, n, round(mean_ret, 6) AS mean_ret, round(profit_factor, 6) AS profit_factor, CASE WHEN n < 60 THEN 'insufficient_sample' WHEN profit_factor < 1 THEN 'weak' ELSE 'ok' END AS status FROM y""",
)


# ------------------------------------------------------------------ long series


@query
def one_book_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trades as one run: the greedy choice of trades that do not overlap."""
    t = trades(spark, sf_dir).select(F.lit("all").alias("book"), "trade_id", "entry_time", "exit_time")
    return selection.non_overlapping(t, ["book"], "entry_time", "exit_time", "trade_id")


sql(
    "one_book_selection",
    f"""{TRADES}, k AS (SELECT arg_min(exit_time, trade_id) AS until, min(trade_id) AS trade_id FROM trades WHERE entry_time = (SELECT min(entry_time) FROM trades)
  UNION ALL SELECT n.exit_time, n.trade_id FROM k, LATERAL (SELECT exit_time, trade_id FROM trades t WHERE t.entry_time > k.until ORDER BY entry_time, trade_id LIMIT 1) n)""",
    "SELECT 'all' AS book, trade_id, entry_time, exit_time FROM k JOIN trades USING (trade_id)",
)


def _tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tick as a bar, the longest series that the tables give."""
    return ticks(spark, sf_dir).select("symbol", F.col("ts").alias("bar_ts"), "event_id", F.col("price").alias("close"))


TICK_BARS = f"{TICKS}, tb AS (SELECT symbol, ts AS bar_ts, event_id, price AS close, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS rn FROM ticks)"


@query
def long_percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks among the last 2 880 ticks."""
    rows = orderstats.sliding(_tick_bars(spark, sf_dir), {"rank": orderstats.Sliding("close", 2880, 50)}, ["bar_ts", "event_id"])
    return r6(rows.select("symbol", "event_id", "rank"), "rank")


sql(
    "long_percentile_rank",
    TICK_BARS,
    """, g AS (SELECT a.symbol, a.event_id, count(*) AS n, count(*) FILTER (b.close < a.close) AS less, count(*) FILTER (b.close = a.close) AS same
  FROM tb a JOIN tb b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 2879 AND a.rn GROUP BY ALL)
SELECT symbol, event_id, round(CASE WHEN n >= 50 THEN (less + (same + 1) / 2.0::DOUBLE) / n END, 6) AS rank FROM g""",
)


@query
def long_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks far from the median of the last 1 440."""
    found = quality.robust_outliers(_tick_bars(spark, sf_dir), window=1440, least=100, scale=1.5)
    return r6(found.select("symbol", "event_id", "close", "median", "dev", "limit"), "median", "dev", "limit")


_LONG = "OVER (PARTITION BY symbol ORDER BY bar_ts, event_id ROWS BETWEEN 1439 PRECEDING AND CURRENT ROW)"
sql(
    "long_robust_outliers",
    TICK_BARS,
    f""", m AS (SELECT *, CASE WHEN count(close) {_LONG} >= 100 THEN median(close) {_LONG} END AS med FROM tb),
d AS (SELECT *, abs(close / nullif(med, 0) - 1) AS dev FROM m),
l AS (SELECT *, CASE WHEN count(dev) {_LONG} >= 100 THEN median(dev) {_LONG} END AS spread FROM d)
SELECT symbol, event_id, close, round(med, 6) AS median, round(dev, 6) AS dev, round(coalesce(greatest(spread * 1.5, 0.02), 0.05), 6) AS "limit"
FROM (SELECT *, CASE WHEN spread IS NULL THEN 0.02 ELSE greatest(spread * 1.5, 0.02) END AS lim FROM l) WHERE dev > lim""",
)


# ------------------------------------------------------------------ thousands of runs


@query
def bootstrap_5000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of 5 000 resampled means of each symbol's trades. The generator is numpy's, which SQL can't repeat."""
    draws = resample.bootstrap(trades(spark, sf_dir), ["symbol"], "ret", "trade_id", 5000)
    return stats.distribution(draws, ["symbol"], "mean")


@query
def permutation_5000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values of the edge between the sides of each symbol's trades against 5 000 random labellings."""
    t = trades(spark, sf_dir)
    draws = resample.permutation(t, ["symbol"], "side", "ret", "trade_id", "LONG", "SHORT", 5000)
    return stats.p_values(draws, stats.observed_edge(t, ["symbol"], "side", "ret", "LONG", "SHORT").select("symbol", "edge"), ["symbol"])


# ------------------------------------------------------------------ base against test


PAIRS = [("P0", "P1"), ("P0", "P2"), ("P0", "P4"), ("P1", "P4")]


@query
def base_against_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of prototypes side by side: a self-join of their results through the table of pairs."""
    base = QUERIES["prototype_masks"](spark, sf_dir)
    pairs = F.broadcast(spark.createDataFrame(PAIRS, "base string, test string"))  # a fixed list
    a = base.select("symbol", F.col("prototype").alias("base"), F.col("n").alias("base_n"), F.col("mean_ret").alias("base_ret"))
    b = base.select("symbol", F.col("prototype").alias("test"), F.col("n").alias("test_n"), F.col("mean_ret").alias("test_ret"))
    out = a.join(pairs, "base").join(b, ["symbol", "test"], "left")
    out = out.withColumn("kept", F.coalesce("test_n", F.lit(0)) / F.col("base_n")).withColumn("gain", F.col("test_ret") - F.col("base_ret"))
    return r6(out.select("symbol", "base", "test", "base_n", "test_n", "kept", "gain"), "kept", "gain")


sql(
    "base_against_test",
    "m AS (" + ORACLE_SQL["prototype_masks"].strip() + "), x(base, test) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ")",
    """SELECT a.symbol, base, test, a.n AS base_n, b.n AS test_n, round(coalesce(b.n, 0) / a.n, 6) AS kept, round(b.mean_ret - a.mean_ret, 6) AS gain
FROM m a JOIN x ON a.prototype = x.base LEFT JOIN m b ON b.symbol = a.symbol AND b.prototype = x.test""",
)


# ------------------------------------------------------------------ event summaries

_SUMMARY = ["mean_ret", "positive_rate", "profit_factor", "contribution"]


def _summary_sql(keys: str, within: str, source: str, flags: str = "", names: str = "") -> str:
    return f""", s AS (SELECT {keys}, count(*) AS n_events, count(ret) AS n_valid, avg(ret) AS mean_ret, avg((ret > 0)::INT) AS positive_rate, {pf('ret')} AS profit_factor, sum(ret) AS t{flags} FROM {source} GROUP BY {keys})
SELECT {keys}, n_events, n_valid, round(mean_ret, 6) AS mean_ret, round(positive_rate, 6) AS positive_rate, round(profit_factor, 6) AS profit_factor, round(t / nullif(sum(t) OVER (PARTITION BY {within}), 0), 6) AS contribution{names} FROM s"""


@query
def phase_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by year and phase after an exit, with what follows in four bars."""
    rows = labels.forward_labels(state.post_exit_phase(_active(spark, sf_dir), "active"), [4]).withColumn("year", F.year("bar_ts"))
    found = metrics.event_summary(rows, ["symbol", "year", "phase"], "fwd_ret_4", ["symbol", "year"])
    return r6(found, *_SUMMARY)


sql(
    "phase_summary",
    f"{ACTIVE}, {LABELS}",
    f""", x AS (SELECT *, CASE WHEN active = 0 AND lag(active) OVER {W} = 1 THEN rn END AS ex FROM act), y AS (SELECT *, CASE WHEN active = 0 THEN rn - last_value(ex IGNORE NULLS) OVER {RUN} END AS b FROM x),
z AS (SELECT y.symbol, year(y.bar_ts)::INT AS year, lab.fwd_ret_4 AS ret, CASE WHEN active = 1 THEN 'held' WHEN b IS NULL THEN 'idle' WHEN b <= 4 THEN '0-4' WHEN b <= 16 THEN '5-16' WHEN b <= 64 THEN '17-64' ELSE 'idle' END AS phase FROM y JOIN lab USING (symbol, bar_ts))"""
    + _summary_sql("symbol, year, phase", "symbol, year", "z"),
)


@query
def candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by kind, symbol and side, with their regime's rate."""
    rows = labels.forward_labels(indicators.mean_reversion(signal_frame(spark, sf_dir)), [4])
    rows = patterns.mean_reversion_candidates(rows)
    found = metrics.event_summary(rows, ["symbol", "candidate", "side"], "fwd_ret_4", ["symbol"], {"calm_rate": F.col("trend_strength") <= 0.5})
    return r6(found, *_SUMMARY, "calm_rate")


sql(
    "candidate_summary",
    f"{MRC}, {LABELS}",
    ", z AS (SELECT mrc.symbol, candidate, side, fwd_ret_4 AS ret, coalesce(trend_strength <= 0.5, false) AS calm FROM mrc JOIN lab USING (symbol, bar_ts))"
    + _summary_sql("symbol, candidate, side", "symbol", "z", ", avg(calm::INT) AS calm_rate", ", round(calm_rate, 6) AS calm_rate"),
)


@query
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades by stage (entries of each order status) and mode (side): profit factor, contribution and rates."""
    t = trades(spark, sf_dir)
    found = metrics.event_summary(t, ["exit_reason", "side"], "net_pnl", [], {"win_rate_small": F.col("ret") > 0.02, "long_hold_rate": F.col("n_lines") >= 5})
    return found.withColumn("mean_ret", F.round("mean_ret", 3)).withColumns({c: F.round(c, 5) for c in ("positive_rate", "profit_factor", "contribution", "win_rate_small", "long_hold_rate")})


sql(
    "stage_summary",
    TRADES,
    f""", s AS (SELECT exit_reason, side, count(*) AS n_events, count(net_pnl) AS n_valid, avg(net_pnl) AS mean_ret, avg((net_pnl > 0)::INT) AS positive_rate, {pf('net_pnl')} AS profit_factor, sum(net_pnl) AS t,
  avg(coalesce(ret > 0.02, false)::INT) AS w, avg((n_lines >= 5)::INT) AS h FROM trades GROUP BY ALL)
SELECT exit_reason, side, n_events, n_valid, round(mean_ret, 3) AS mean_ret, round(positive_rate, 5) AS positive_rate, round(profit_factor, 5) AS profit_factor, round(t / nullif(sum(t) OVER (), 0), 5) AS contribution, round(w, 5) AS win_rate_small, round(h, 5) AS long_hold_rate FROM s""",
)
