"""DuckDB SQL for the registered queries, over common table expressions that repeat the inputs."""

from __future__ import annotations

from tidemark.operators.stats import PRIME, draw_sql
from tidemark.plans.inputs import BARS, TICKS, TRADES, bars_sql

ORACLE_SQL: dict[str, str] = {}


def sql(name: str, prefix: str, body: str) -> None:
    ORACLE_SQL[name] = f"WITH RECURSIVE {prefix}\n{body}" if prefix else body


def roll(agg: str, column: str, n: int, shift: int = 0, least: int | None = None) -> str:
    over = f"OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"
    return f"CASE WHEN count({column}) {over} >= {n if least is None else least} THEN {agg}({column}) {over} END"


def recursive_mean(name: str, source: str, items: dict[str, tuple[str, float]]) -> str:
    """y = a * x + (1 - a) * y before, from the first row of each symbol; a null x keeps y."""
    first = ", ".join(f"{x}::DOUBLE AS {y}" for y, (x, _) in items.items())
    step = ", ".join(f"CASE WHEN n.{x} IS NULL THEN e.{y} WHEN e.{y} IS NULL THEN n.{x} ELSE {a}::DOUBLE * n.{x} + {1 - a}::DOUBLE * e.{y} END" for y, (x, a) in items.items())
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS rn FROM {source}),
{name} AS (
  SELECT symbol, bar_ts, rn, {first} FROM {name}_n WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n.bar_ts, n.rn, {step} FROM {name} e JOIN {name}_n n ON n.symbol = e.symbol AND n.rn = e.rn + 1)"""


W = "(PARTITION BY symbol ORDER BY bar_ts)"


def signal_sql(bars: str, out: str, fast: int = 12, slow: int = 48, channel: int = 20, exit_channel: int = 10) -> str:
    return f"""{recursive_mean(f'{out}_e', bars, {'ema_fast': ('close', 2 / (fast + 1)), 'ema_slow': ('close', 2 / (slow + 1))})},
{out}_t AS (SELECT b.*, e.ema_fast, e.ema_slow, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
  FROM {bars} b JOIN {out}_e e USING (symbol, bar_ts) WINDOW w AS (PARTITION BY b.symbol ORDER BY b.bar_ts)),
{out}_i AS (SELECT *, {roll('avg', 'tr', 14)} AS atr, {roll('max', 'high', channel, 1)} AS upper, {roll('min', 'low', exit_channel, 1)} AS exit_low,
  {roll('avg', 'volume', channel, 1)} AS volume_mean FROM {out}_t),
{out} AS (SELECT *, coalesce(close > upper AND ema_fast > ema_slow, false) AS breakout,
  coalesce(close < exit_low OR ema_fast < ema_slow, false) AS exit_signal FROM {out}_i)"""


SIG = f"{BARS}, {signal_sql('bars', 'sig')}"
CANDLE = "body, upper_wick, lower_wick, close_location"
CANDLES = """candles AS (SELECT *, abs(close - open) / nullif(high - low, 0) AS body, (high - greatest(open, close)) / nullif(high - low, 0) AS upper_wick,
  (least(open, close) - low) / nullif(high - low, 0) AS lower_wick, (close - low) / nullif(high - low, 0) AS close_location FROM sig)"""


def r(columns: str) -> str:
    return ", ".join(f"round({c.strip()}, 6) AS {c.strip()}" for c in columns.split(","))


# ------------------------------------------------------------------ bars and quality

sql("bars_1h", BARS, "SELECT * FROM bars")
sql("bars_left_label", f"{TICKS}, {bars_sql('4 hours')}", "SELECT symbol, bar_ts - INTERVAL '4 hours' AS bar_ts, open, high, low, close, volume, n_ticks FROM bars")
sql(
    "bars_strict",
    BARS,
    """SELECT symbol, time_bucket(INTERVAL '4 hours', bar_ts - INTERVAL '1 hour') + INTERVAL '4 hours' AS bar_ts, arg_min(open, bar_ts) AS open,
  max(high) AS high, min(low) AS low, arg_max(close, bar_ts) AS close, sum(volume)::BIGINT AS volume, count(*) AS n_ticks
FROM bars GROUP BY symbol, time_bucket(INTERVAL '4 hours', bar_ts - INTERVAL '1 hour') HAVING count(*) = 4""",
)
sql(
    "bars_timeframes",
    f"{TICKS}, {bars_sql('1 hour', 'h1')}, {bars_sql('4 hours', 'h4')}, {bars_sql('1 day', 'd1')}",
    "SELECT '1h' AS tf, * FROM h1 UNION ALL SELECT '4h', * FROM h4 UNION ALL SELECT '1d', * FROM d1",
)
sql("bar_boundaries", "", "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts) AS bar_start, (minute(ts) + 1) % 15 = 0 AS last_minute FROM events")
sql(
    "trade_period_keys",
    TRADES,
    """SELECT trade_id, year(exit_time)::INT AS year, year(exit_time) || 'Q' || quarter(exit_time) AS quarter, strftime(exit_time, '%Y-%m') AS month,
  year(exit_time) = (SELECT year(max(exit_time)) FROM trades) AS partial_year FROM trades""",
)
sql(
    "monthly_spine",
    TRADES,
    """, m AS (SELECT symbol, exit_reason, n_lines, strftime(exit_time, '%Y-%m') AS month, round(sum(net_pnl), 4) AS net FROM trades GROUP BY ALL),
s AS (SELECT symbol, exit_reason, n_lines, strftime(unnest(generate_series(strptime(min(month) || '-01', '%Y-%m-%d'), strptime(max(month) || '-01', '%Y-%m-%d'), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM m GROUP BY symbol, exit_reason, n_lines)
SELECT symbol, exit_reason, n_lines, month, coalesce(net, 0) AS net FROM s LEFT JOIN m USING (symbol, exit_reason, n_lines, month)""",
)
EQUITY = f"{TRADES}, equity AS (SELECT *, 1e6 + sum(net_pnl) OVER (PARTITION BY symbol ORDER BY exit_time, trade_id) AS equity FROM trades)"
sql(
    "month_end_returns",
    EQUITY,
    """, m AS (SELECT symbol, strftime(exit_time, '%Y-%m') AS month, arg_max(equity, (exit_time, trade_id)) AS equity FROM equity GROUP BY ALL)
SELECT symbol, month, round(equity, 6) AS equity, round(equity / nullif(lag(equity) OVER (PARTITION BY symbol ORDER BY month), 0) - 1, 6) AS ret FROM m""",
)
DIRTY = f"""{TICKS}, a AS (SELECT * FROM ticks WHERE event_id % 53 <> 0),
b AS (SELECT symbol, ts, price + 1 AS price, volume, event_id FROM ticks WHERE event_id % 97 = 0 AND event_id % 53 <> 0)"""
sql(
    "merge_precedence",
    DIRTY,
    "SELECT symbol, ts, price, volume, event_id FROM (SELECT *, 0 AS s FROM a UNION ALL SELECT *, 1 FROM b) QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY s DESC, event_id DESC) = 1",
)
sql("duplicate_keys", DIRTY, "SELECT *, count(*) OVER (PARTITION BY symbol, ts) AS n_rows FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY n_rows > 1")
sql("invalid_bars", BARS, "SELECT * FROM (SELECT * REPLACE (CASE WHEN hour(bar_ts) = 3 THEN low - 1 ELSE high END AS high) FROM bars) WHERE low > least(open, close) OR high < greatest(open, close) OR least(open, high, low, close) <= 0 OR volume < 0")
GAPS = f"{BARS}, g AS (SELECT symbol, lag(bar_ts) OVER {W} AS prev_ts, bar_ts AS next_ts FROM bars)"
sql("bar_gaps", GAPS, "SELECT symbol, prev_ts, next_ts, (epoch(next_ts - prev_ts) / 3600 - 1)::BIGINT AS missing FROM g WHERE next_ts - prev_ts > INTERVAL 1 HOUR")
sql(
    "missing_islands",
    BARS,
    """, cal AS (SELECT symbol, unnest(generate_series(min(bar_ts), max(bar_ts), INTERVAL 1 HOUR)) AS bar_ts FROM bars GROUP BY symbol),
m AS (SELECT symbol, bar_ts FROM cal ANTI JOIN bars USING (symbol, bar_ts)),
i AS (SELECT *, bar_ts - to_hours(row_number() OVER (PARTITION BY symbol ORDER BY bar_ts)) AS island FROM m)
SELECT symbol, min(bar_ts) AS start_ts, max(bar_ts) AS end_ts, count(*) AS n_missing FROM i GROUP BY symbol, island""",
)
sql("price_jumps", BARS, f"SELECT symbol, bar_ts, close, round(close / nullif(lag(close) OVER {W}, 0) - 1, 6) AS change FROM bars QUALIFY abs(close / nullif(lag(close) OVER {W}, 0) - 1) > 0.5")
sql(
    "robust_outliers",
    BARS,
    f""", m AS (SELECT *, {roll('median', 'close', 48, 0, 24)} AS med FROM bars),
d AS (SELECT *, abs(close / nullif(med, 0) - 1) AS dev FROM m),
l AS (SELECT *, coalesce(greatest(({roll('median', 'dev', 48, 0, 24)}) * 3.0, 0.02), 0.05) AS lim, {roll('median', 'dev', 48, 0, 24)} AS spread FROM d)
SELECT symbol, bar_ts, close, round(med, 6) AS median, round(dev, 6) AS dev, round(lim, 6) AS "limit" FROM
  (SELECT * REPLACE (CASE WHEN spread IS NULL THEN 0.02 ELSE lim END AS lim) FROM l) WHERE dev > lim""",
)
sql("completeness", BARS, "SELECT symbol, count(*) AS total, count(*) FILTER (n_ticks >= 3) AS complete, count(*) FILTER (n_ticks < 3) AS incomplete, min(bar_ts) FILTER (n_ticks < 3) AS first_incomplete FROM bars GROUP BY symbol")
sql("coverage", BARS, "SELECT symbol, min(bar_ts) AS start_ts, max(bar_ts) AS end_ts, count(*) AS n_rows, date_diff('day', min(bar_ts)::DATE, max(bar_ts)::DATE)::INT AS days, CASE WHEN date_diff('day', min(bar_ts)::DATE, max(bar_ts)::DATE) >= 28 THEN 'ok' ELSE 'short' END AS status FROM bars GROUP BY symbol")
sql(
    "coverage_decision",
    BARS,
    """, f AS (SELECT symbol, 'part' || (day(bar_ts) % 3) AS file, min(bar_ts) AS s, max(bar_ts) AS e FROM bars GROUP BY ALL),
d AS (SELECT symbol, file, greatest(date_diff('day', greatest(s, TIMESTAMP '2024-01-10')::DATE, e::DATE), 0)::INT AS days_after FROM f)
SELECT symbol, max(days_after) AS days_after, arg_max(file, (days_after, file)) AS file, CASE WHEN max(days_after) >= 18 THEN 'use' ELSE 'blocked' END AS decision FROM d GROUP BY symbol""",
)
sql(
    "freshness",
    BARS,
    """, x AS (SELECT DISTINCT symbol FROM bars UNION SELECT r_name FROM region), l AS (SELECT symbol, max(bar_ts) AS last_ts FROM bars GROUP BY symbol),
h AS (SELECT x.symbol, last_ts, trunc(epoch(TIMESTAMP '2024-01-30 12:00:00' - last_ts) / 3600)::BIGINT AS hours_behind FROM x LEFT JOIN l USING (symbol))
SELECT *, CASE WHEN last_ts IS NULL THEN 'missing' WHEN hours_behind > 0 THEN 'stale' ELSE 'fresh' END AS status FROM h""",
)
sql(
    "column_profile",
    BARS,
    """, l AS (SELECT 'open' AS "column", open AS value FROM bars UNION ALL SELECT 'close', close FROM bars UNION ALL SELECT 'volume', CASE WHEN volume > 1 THEN volume END FROM bars)
SELECT "column", round(avg((value IS NULL)::INT), 6) AS missing_rate, round(min(value), 6) AS min, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM l GROUP BY "column" """,
)
sql("leak_guard", BARS, "SELECT count(*) AS n_rows, count(*) FILTER (bar_ts <= TIMESTAMP '2024-01-02') AS n_leaks, bool_and(bar_ts > TIMESTAMP '2024-01-02') AS passed FROM bars")
sql("required_fields", "", "SELECT 'event_id' AS field, count(*) FILTER (event_id IS NULL) AS n_blank FROM events UNION ALL SELECT 'event_type', count(*) FILTER (event_id % 11 = 0 OR event_type IS NULL OR event_type = '') FROM events UNION ALL SELECT 'value', count(*) FILTER (value IS NULL) FROM events")
sql(
    "stage_inputs",
    TICKS,
    """SELECT count(*) AS n_rows, count(*) FILTER (price < 0) AS n_forbidden, (4 - count(DISTINCT symbol) FILTER (symbol IN ('error', 'click', 'view', 'none')))::INT AS n_missing_symbols,
  CASE WHEN count(*) >= 100 AND count(*) FILTER (price < 0) = 0 AND count(DISTINCT symbol) FILTER (symbol IN ('error', 'click', 'view', 'none')) = 4 THEN 'pass' ELSE 'blocked' END AS status FROM ticks""",
)
sql("ledger_invariant", EQUITY, "SELECT symbol, max(abs(equity - (equity - net_pnl) - net_pnl)) <= 1e-8 AS passed FROM equity GROUP BY symbol")
sql("execution_audit", BARS, "SELECT symbol, bar_ts AS execution_time, NOT (hour(bar_ts) = 5) AS entry_is_open, false AS duplicate_entry FROM bars WHERE hour(bar_ts) % 5 = 0")
sql(
    "baseline_fairness",
    TRADES,
    """, a AS (SELECT symbol, side, count(*) AS n_target FROM trades WHERE net_pnl > 0 GROUP BY ALL), b AS (SELECT symbol, side, count(*) AS n_pool FROM trades WHERE net_pnl <= 0 GROUP BY ALL)
SELECT symbol, side, n_target, coalesce(n_pool, 0) AS n_pool, coalesce(n_pool, 0) > n_target AS fair FROM a LEFT JOIN b USING (symbol, side)""",
)
sql(
    "ledger_diff",
    TRADES,
    """, a AS (SELECT symbol, trade_id, net_pnl AS l FROM trades WHERE trade_id % 11 <> 0), b AS (SELECT symbol, trade_id, net_pnl + CASE WHEN trade_id % 5 = 0 THEN 1 ELSE 0 END AS r FROM trades WHERE trade_id % 7 <> 0)
SELECT symbol, CASE WHEN l IS NULL THEN 'right_only' WHEN r IS NULL THEN 'left_only' WHEN abs(l - r) > 1e-9 THEN 'differs' ELSE 'same' END AS kind, count(*) AS n FROM a FULL JOIN b USING (symbol, trade_id) GROUP BY ALL""",
)

# ------------------------------------------------------------------ indicators, patterns, states

sql("base_indicators", SIG, f"SELECT symbol, bar_ts, {r('tr, atr, upper, exit_low, ema_fast, ema_slow, volume_mean')}, breakout, exit_signal FROM sig")
FACTORS = f"""{SIG}, {CANDLES},
f0 AS (SELECT *, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret_1, abs(close - lag(close) OVER {W}) AS step FROM candles),
f1 AS (SELECT *, list(atr) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS l0 FROM f0),
f2 AS (SELECT *, list_filter(l0, lambda x: x IS NOT NULL) AS l FROM f1),
factors AS (SELECT *, close / nullif(lag(close, 8) OVER {W}, 0) - 1 AS ret_short, close / nullif(lag(close, 24) OVER {W}, 0) - 1 AS ret_long,
  (ema_slow - lag(ema_slow, 8) OVER {W}) / nullif(atr, 0) AS slow_slope, (ema_fast - ema_slow) / nullif(atr, 0) AS ema_gap, (close - upper) / nullif(atr, 0) AS breakout_distance,
  (upper - exit_low) / nullif(atr, 0) AS channel_width,
  CASE WHEN len(l) >= 50 AND atr IS NOT NULL THEN (len(list_filter(l, lambda x: x < atr)) + (len(list_filter(l, lambda x: x = atr)) + 1) / 2.0::DOUBLE) / len(l) END AS atr_rank,
  ({roll('stddev_samp', 'ret_1', 8)}) / nullif({roll('stddev_samp', 'ret_1', 24)}, 0) AS volatility_ratio,
  (volume - ({roll('avg', 'volume', 24)})) / nullif({roll('stddev_samp', 'volume', 24)}, 0) AS volume_z,
  abs(close - lag(close, 20) OVER {W}) / nullif({roll('sum', 'step', 20)}, 0) AS efficiency,
  (high - low) / nullif(lag(high - low) OVER {W}, 0) AS compression FROM f2)"""
sql("event_factors", FACTORS, f"SELECT symbol, bar_ts, {r('ret_short, ret_long, slow_slope, ema_gap, breakout_distance, channel_width, atr_rank, volatility_ratio, volume_z, efficiency, compression, body, upper_wick, close_location')} FROM factors")
MR = f"""{SIG}, mr0 AS (SELECT *, {roll('max', 'high', 32, 1)} AS range_upper, {roll('min', 'low', 32, 1)} AS range_lower FROM sig),
mr AS (SELECT *, (range_upper + range_lower) / 2 AS range_mid, abs(ema_fast - ema_slow) / nullif(atr, 0) AS trend_strength, (close - ema_fast) / nullif(atr, 0) AS deviation FROM mr0)"""
sql("mean_reversion_factors", MR, f"SELECT symbol, bar_ts, {r('range_upper, range_lower, range_mid, trend_strength, deviation')} FROM mr")
WILDER = f"""{BARS}, w0 AS (SELECT *, close - lag(close) OVER {W} AS d, high - lag(high) OVER {W} AS up, lag(low) OVER {W} - low AS down,
  greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS tr0 FROM bars),
w1 AS (SELECT symbol, bar_ts, greatest(d, 0.0 + d * 0) AS gain, greatest(-d, d * 0) AS loss, CASE WHEN d IS NOT NULL THEN tr0 END AS tr,
  CASE WHEN up IS NOT NULL THEN CASE WHEN up > down AND up > 0 THEN up ELSE 0 END END AS plus, CASE WHEN down IS NOT NULL THEN CASE WHEN down > up AND down > 0 THEN down ELSE 0 END END AS minus FROM w0),
{recursive_mean('w2', 'w1', {'ag': ('gain', 1 / 14), 'al': ('loss', 1 / 14), 'wilder_atr': ('tr', 1 / 14), 'pdm': ('plus', 1 / 14), 'mdm': ('minus', 1 / 14)})},
w3 AS (SELECT *, 100 * ag / nullif(ag + al, 0) AS rsi, 100 * pdm / nullif(wilder_atr, 0) AS pdi, 100 * mdm / nullif(wilder_atr, 0) AS mdi FROM w2),
w4 AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM w3),
{recursive_mean('w5', '(SELECT * EXCLUDE (rn) FROM w4)', {'adx': ('dx', 1 / 14)})},
wilder AS (SELECT w4.symbol, w4.bar_ts, rsi, wilder_atr, adx FROM w4 JOIN w5 USING (symbol, bar_ts))"""
sql("wilder_rsi_adx", WILDER, f"SELECT symbol, bar_ts, {r('rsi, wilder_atr, adx')} FROM wilder")
sql(
    "local_trend",
    SIG,
    f""", t AS (SELECT *, (high > lag(high) OVER {W})::INT AS hh, (low < lag(low) OVER {W})::INT AS ll, {roll('max', 'high', 20, 1)} AS sh, {roll('min', 'low', 20, 1)} AS sl,
  (close - lag(close, 3) OVER {W}) / nullif(atr, 0) AS move_3, (close - lag(close, 6) OVER {W}) / nullif(atr, 0) AS move_6, (close - lag(close, 12) OVER {W}) / nullif(atr, 0) AS move_12 FROM sig),
u AS (SELECT *, (sh - close) / nullif(atr, 0) AS to_swing_high, (close - sl) / nullif(atr, 0) AS to_swing_low FROM t)
SELECT symbol, bar_ts, {r('move_3, move_6, move_12, to_swing_high, to_swing_low')}, {roll('sum', 'hh', 20, 0, 1)}::BIGINT AS higher_highs, {roll('sum', 'll', 20, 0, 1)}::BIGINT AS lower_lows FROM u""",
)
sql("volume_features", BARS, f"SELECT symbol, bar_ts, round(volume / nullif({roll('median', 'volume', 20, 1)}, 0), 6) AS volume_vs_median, round(volume / nullif({roll('avg', 'volume', 20, 1)}, 0), 6) AS volume_vs_mean FROM bars")
sql(
    "pair_ratio",
    f"""{BARS}, p0 AS (SELECT 'click/view' AS symbol, a.bar_ts, a.close / nullif(b.close, 0) AS ratio FROM bars a JOIN bars b ON a.bar_ts = b.bar_ts AND a.symbol = 'click' AND b.symbol = 'view'),
{recursive_mean('p1', 'p0', {'m': ('ratio', 2 / 21)})}""",
    f", p AS (SELECT p0.symbol, p0.bar_ts, ratio, m FROM p0 JOIN p1 USING (bar_ts)) SELECT symbol, bar_ts, round(ratio, 6) AS ratio, round((ratio - lag(m) OVER {W}) / nullif({roll('stddev_samp', 'ratio', 48, 1, 32)}, 0), 6) AS z FROM p",
)
sql("day_change", BARS, f", q AS (SELECT *, close * volume AS q FROM bars) SELECT symbol, bar_ts, round(close / nullif(lag(close, 24) OVER {W}, 0) - 1, 6) AS change_24h, round(sum(q) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS quote_volume_24h FROM q")


def trend_sql(lag: int = 5) -> str:
    slope = f"ema_slow - lag(ema_slow, {lag}) OVER {W}"
    return f"CASE WHEN {slope} IS NULL THEN 'unknown' WHEN close > ema_slow AND {slope} > 0 THEN 'up' WHEN close < ema_slow AND {slope} < 0 THEN 'down' ELSE 'range' END AS trend_regime"


sql("regime_labels", FACTORS, f"SELECT symbol, bar_ts, {trend_sql()}, CASE WHEN atr_rank IS NULL THEN 'unknown' WHEN atr_rank <= 0.33 THEN 'low' WHEN atr_rank <= 0.67 THEN 'mid' ELSE 'high' END AS volatility_regime FROM factors")
sql(
    "candle_patterns",
    f"{SIG}, {CANDLES}",
    f""", c AS (SELECT *, lag(open) OVER {W} AS po, lag(close) OVER {W} AS pc, high - low >= 0.2 * atr AS big FROM candles)
SELECT symbol, bar_ts, 'hammer' AS pattern FROM c WHERE big AND lower_wick >= 0.5 AND upper_wick <= 0.2 AND body > 0
UNION ALL SELECT symbol, bar_ts, 'shooting_star' FROM c WHERE big AND upper_wick >= 0.5 AND lower_wick <= 0.2 AND body > 0
UNION ALL SELECT symbol, bar_ts, 'bullish_engulfing' FROM c WHERE big AND pc < po AND close > open AND open <= pc AND close >= po
UNION ALL SELECT symbol, bar_ts, 'bearish_engulfing' FROM c WHERE big AND pc > po AND close < open AND open >= pc AND close <= po""",
)
HIKKAKE = f"""h0 AS (SELECT *, coalesce(high < lag(high) OVER {W} AND low > lag(low) OVER {W}, false) AS inside FROM sig),
h1 AS (SELECT *, coalesce(lag(inside) OVER {W} AND high < lag(high) OVER {W} AND low < lag(low) OVER {W}, false) AS hikkake_setup FROM h0),
hik AS (SELECT *, coalesce(lag(hikkake_setup, 1) OVER {W} AND high > lag(high, 2) OVER {W}, false) OR coalesce(lag(hikkake_setup, 2) OVER {W} AND high > lag(high, 3) OVER {W}, false)
  OR coalesce(lag(hikkake_setup, 3) OVER {W} AND high > lag(high, 4) OVER {W}, false) AS hikkake_confirm FROM h1)"""
sql("hikkake", f"{SIG}, {HIKKAKE}", "SELECT symbol, bar_ts, inside, hikkake_setup, hikkake_confirm FROM hik")
MRC = f"""{MR}, c AS (SELECT *, lag(close) OVER {W} AS pc, lag(range_upper) OVER {W} AS pu, lag(range_lower) OVER {W} AS pl FROM mr WHERE true),
mrc AS (SELECT *, 'FB' AS candidate, 'SHORT' AS side FROM c WHERE trend_strength <= 1 AND pc > pu AND close < range_upper
UNION ALL SELECT *, 'FB', 'LONG' FROM c WHERE trend_strength <= 1 AND pc < pl AND close > range_lower
UNION ALL SELECT *, 'MR', 'SHORT' FROM c WHERE trend_strength <= 1 AND deviation >= 1
UNION ALL SELECT *, 'MR', 'LONG' FROM c WHERE trend_strength <= 1 AND deviation <= -1)"""
sql("mean_reversion_candidates", MRC, "SELECT symbol, bar_ts, candidate, side FROM mrc")
sql(
    "entry_modes",
    f"{SIG}, {HIKKAKE.replace('FROM sig', 'FROM candles')}, ".replace(f"{SIG}, ", f"{SIG}, {CANDLES}, ").rstrip(", "),
    """SELECT symbol, bar_ts, 'B0' AS entry_mode FROM hik WHERE breakout
UNION ALL SELECT symbol, bar_ts, 'B1' FROM hik WHERE breakout AND close > open AND body >= 0.35 AND upper_wick <= 0.3 AND close_location >= 0.7 AND volume >= volume_mean
UNION ALL SELECT symbol, bar_ts, 'B3' FROM hik WHERE hikkake_confirm AND ema_fast > ema_slow""",
)
sql(
    "momentum_rejects",
    WILDER,
    f""", v AS (SELECT symbol, bar_ts, volume / nullif({roll('avg', 'volume', 20, 1)}, 0) AS vm FROM bars)
SELECT symbol, CASE WHEN NOT coalesce(rsi BETWEEN 50 AND 90, false) THEN 'rsi' WHEN NOT coalesce(adx BETWEEN 5 AND 60, false) THEN 'adx' WHEN NOT coalesce(vm >= 1.1, false) THEN 'volume' ELSE 'pass' END AS reason, count(*) AS n
FROM wilder JOIN v USING (symbol, bar_ts) GROUP BY ALL""",
)
RUN = "(PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING)"
ACTIVE = f"""{SIG}, s0 AS (SELECT *, row_number() OVER {W} AS rn, coalesce(last_value(CASE WHEN exit_signal THEN 0 WHEN breakout THEN 1 END IGNORE NULLS) OVER {RUN}, 0) AS active FROM sig),
s1 AS (SELECT *, active = 1 AND coalesce(lag(active) OVER {W}, 0) = 0 AS active_first FROM s0),
act AS (SELECT *, CASE WHEN active = 1 THEN rn - last_value(CASE WHEN active_first THEN rn END IGNORE NULLS) OVER {RUN} END AS active_age FROM s1)"""
sql("breakout_state", ACTIVE, "SELECT symbol, bar_ts, active, active_first, active_age FROM act")
SEG = f"""{ACTIVE}, g0 AS (SELECT *, sum(active_first::INT) OVER {RUN} AS segment_id FROM act), g1 AS (SELECT * FROM g0 WHERE active = 1),
g2 AS (SELECT *, close / max(close) OVER (PARTITION BY symbol, segment_id ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM g1),
seg AS (SELECT symbol, segment_id::BIGINT AS segment_id, min(bar_ts) AS segment_start, max(bar_ts) AS segment_end, count(*) AS n_bars, arg_min(close, bar_ts) AS start_price,
  arg_max(close, bar_ts) AS end_price, min(dd) AS drawdown, max(high) AS top FROM g2 GROUP BY symbol, segment_id)"""
sql("trend_segments", SEG, "SELECT symbol, segment_id, segment_start, segment_end, n_bars, start_price, end_price, round(drawdown, 6) AS drawdown, round(end_price / start_price - 1, 6) AS segment_return, round(top / start_price - 1, 6) AS run_up FROM seg")
sql(
    "post_exit_phase",
    ACTIVE,
    f""", x AS (SELECT *, CASE WHEN active = 0 AND lag(active) OVER {W} = 1 THEN rn END AS ex FROM act),
y AS (SELECT *, CASE WHEN active = 0 THEN rn - last_value(ex IGNORE NULLS) OVER {RUN} END AS bars_since_exit FROM x)
SELECT symbol, bar_ts, bars_since_exit, CASE WHEN active = 1 THEN 'held' WHEN bars_since_exit IS NULL THEN 'idle' WHEN bars_since_exit <= 4 THEN '0-4' WHEN bars_since_exit <= 16 THEN '5-16' WHEN bars_since_exit <= 64 THEN '17-64' ELSE 'idle' END AS phase FROM y""",
)
T = "(PARTITION BY symbol ORDER BY exit_time, trade_id)"
sql(
    "losing_streaks",
    TRADES,
    f""", f AS (SELECT *, net_pnl <= 0 AS l, row_number() OVER {T} AS rn FROM trades), i AS (SELECT *, rn - row_number() OVER (PARTITION BY symbol, l ORDER BY exit_time, trade_id) AS isl FROM f),
s AS (SELECT symbol, isl, count(*) AS n, sum(net_pnl) AS total FROM i WHERE l GROUP BY symbol, isl)
SELECT t.symbol, coalesce(max(n), 0) AS longest_streak, nullif(count(*) FILTER (n >= 3), 0) AS n_streaks, round(min(total) FILTER (n >= 3), 4) AS worst_total FROM (SELECT DISTINCT symbol FROM trades) t LEFT JOIN s USING (symbol) GROUP BY t.symbol""",
)
sql(
    "underwater",
    EQUITY,
    f""", e AS (SELECT symbol, exit_time, trade_id, round(equity, 2) AS equity FROM equity),
p AS (SELECT *, max(equity) OVER {T[:-1]} ROWS UNBOUNDED PRECEDING) AS peak, lag(exit_time) OVER {T} AS prv, lead(exit_time) OVER {T} AS nxt, row_number() OVER {T} AS rn FROM e),
i AS (SELECT *, rn - row_number() OVER (PARTITION BY symbol, equity < peak ORDER BY exit_time, trade_id) AS isl FROM p),
g AS (SELECT symbol, isl, count(*) AS n, epoch(max(coalesce(nxt, exit_time)) - min(prv))::BIGINT AS sec FROM i WHERE equity < peak GROUP BY symbol, isl)
SELECT s.symbol, coalesce(max(n), 0) AS underwater_rows, coalesce(max(sec), 0) AS underwater_seconds FROM (SELECT DISTINCT symbol FROM e) s LEFT JOIN g USING (symbol) GROUP BY s.symbol""",
)


def last_n(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY exit_time, trade_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


sql(
    "trading_pause",
    TRADES,
    f""", q0 AS (SELECT *, 1e6 + sum(net_pnl) OVER {T[:-1]} ROWS UNBOUNDED PRECEDING) AS eq FROM trades), q AS (SELECT *, greatest(1e6, max(eq) OVER {T[:-1]} ROWS UNBOUNDED PRECEDING)) AS peak FROM q0),
a AS (SELECT *, CASE WHEN count(*) OVER {last_n(3)} = 3 AND sum((net_pnl > 0)::INT) OVER {last_n(3)} >= 2 THEN 0
  WHEN (count(*) OVER {last_n(5)} = 5 AND sum((net_pnl <= 0)::INT) OVER {last_n(5)} >= 4) OR (count(*) OVER {last_n(10)} = 10 AND (avg((net_pnl > 0)::INT) OVER {last_n(10)} < 0.25 OR sum(net_pnl) OVER {last_n(10)} < 0)) OR eq < 0.7 * peak THEN 1 END AS e FROM q),
b AS (SELECT symbol, coalesce(last_value(e IGNORE NULLS) OVER {T[:-1]} ROWS UNBOUNDED PRECEDING), 0) = 1 AS paused FROM a)
SELECT symbol, paused, count(*) AS n FROM b GROUP BY ALL""",
)
sql(
    "daily_universe",
    BARS,
    """, d AS (SELECT (bar_ts::DATE + 1) AS day, symbol, sum(close * volume) AS q FROM bars GROUP BY ALL)
SELECT day, symbol, round(q, 6) AS quote_volume, row_number() OVER (PARTITION BY day ORDER BY q DESC, symbol)::INT AS rank, row_number() OVER (PARTITION BY day ORDER BY q DESC, symbol) <= 3 AS member FROM d""",
)
sql(
    "non_overlapping_trades",
    f"""{TRADES}, o AS (SELECT symbol, side, trade_id, entry_time, exit_time, row_number() OVER (PARTITION BY symbol, side ORDER BY entry_time, trade_id) AS rn FROM trades),
k AS (SELECT symbol, side, rn, exit_time AS until, true AS kept FROM o WHERE rn = 1
  UNION ALL SELECT o.symbol, o.side, o.rn, CASE WHEN o.entry_time > k.until THEN o.exit_time ELSE k.until END, o.entry_time > k.until FROM k JOIN o ON o.symbol = k.symbol AND o.side = k.side AND o.rn = k.rn + 1)""",
    "SELECT o.symbol, o.side, trade_id, entry_time, exit_time FROM o JOIN k USING (symbol, side, rn) WHERE kept",
)

# ------------------------------------------------------------------ joins and labels

EVENTS = f"{SIG}, ev AS (SELECT symbol || '_' || strftime(bar_ts, '%Y%m%d%H') AS event_id, symbol, bar_ts AS signal_time, close, atr, ema_slow FROM sig WHERE breakout AND atr IS NOT NULL)"
sql(
    "next_open_execution",
    EVENTS,
    """, e AS (SELECT event_id, symbol, signal_time + INTERVAL 20 MINUTE AS signal_time FROM ev)
SELECT event_id, e.symbol, signal_time, bar_ts AS execution_time, open AS execution_open FROM e ASOF LEFT JOIN bars b ON e.symbol = b.symbol AND e.signal_time <= b.bar_ts""",
)
sql(
    "regime_asof",
    f"{EVENTS}, {bars_sql('4 hours', 'b4')}, {signal_sql('b4', 's4', 5, 20, 10, 5)}, g4 AS (SELECT symbol, bar_ts, {trend_sql()} FROM s4)",
    "SELECT event_id, ev.symbol, signal_time, coalesce(trend_regime, 'unknown') AS trend_regime FROM ev ASOF LEFT JOIN g4 ON ev.symbol = g4.symbol AND ev.signal_time >= g4.bar_ts",
)
sql("path_interval_join", EVENTS, "SELECT ev.event_id, count(*) AS n, max(price) AS hi, min(price) AS lo, arg_max(price, ts) AS last FROM ev JOIN ticks t ON t.symbol = ev.symbol AND t.ts BETWEEN signal_time AND signal_time + INTERVAL 6 HOUR GROUP BY ev.event_id")
sql(
    "containment_join",
    SEG,
    """, t AS (SELECT symbol, event_id, ts FROM ticks),
j AS (SELECT t.symbol, event_id, ts, segment_id, segment_start, segment_end, coalesce(ts <= segment_end, false) AS mapped FROM t ASOF LEFT JOIN seg ON t.symbol = seg.symbol AND t.ts >= seg.segment_start)
SELECT symbol, event_id, mapped, CASE WHEN mapped THEN segment_id END AS segment_id, CASE WHEN mapped THEN round(floor(epoch(ts - segment_start)) / nullif(epoch(segment_end - segment_start), 0), 6) END AS position FROM j""",
)
sql(
    "fallback_match",
    TRADES,
    """, e AS (SELECT trade_id, symbol, side, strftime(entry_time, '%Y-%m') AS month FROM trades), p AS (SELECT symbol, side, strftime(entry_time, '%Y-%m') AS month, net_pnl FROM trades WHERE exit_reason = 'P'),
a AS (SELECT symbol, side, month, count(*) AS n, avg(net_pnl) AS m FROM p GROUP BY ALL), b AS (SELECT symbol, side, count(*) AS n, avg(net_pnl) AS m FROM p GROUP BY ALL)
SELECT trade_id, symbol, side, month, CASE WHEN a.n > 0 THEN 'primary' WHEN b.n > 0 THEN 'fallback' ELSE 'unmatched' END AS match_kind, coalesce(a.n, b.n, 0) AS match_n, round(coalesce(a.m, b.m), 6) AS match_mean
FROM e LEFT JOIN a USING (symbol, side, month) LEFT JOIN b USING (symbol, side)""",
)
sql(
    "overlapping_pairs",
    TRADES,
    ", t AS (SELECT * FROM trades) SELECT x.symbol, x.side, count(*) AS n_pairs FROM t x JOIN t y ON x.symbol = y.symbol AND x.side = y.side AND x.trade_id < y.trade_id AND x.entry_time <= y.exit_time AND x.exit_time >= y.entry_time GROUP BY ALL",
)
sql(
    "portfolio_curve",
    f"{TRADES}, e0 AS (SELECT *, 1e6 + sum(net_pnl) OVER (PARTITION BY symbol ORDER BY exit_time, trade_id) AS equity FROM trades)",
    """, c AS (SELECT symbol, exit_time, arg_max(equity, trade_id) / 1e6 AS g FROM e0 GROUP BY ALL), s AS (SELECT DISTINCT symbol FROM c), t AS (SELECT DISTINCT exit_time FROM c),
x AS (SELECT t.exit_time, s.symbol, c.g FROM t CROSS JOIN s LEFT JOIN c ON c.symbol = s.symbol AND c.exit_time = t.exit_time),
y AS (SELECT exit_time, coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY exit_time ROWS UNBOUNDED PRECEDING), 1) AS g FROM x)
SELECT exit_time, round(avg(g), 6) AS growth, count(*) AS n_curves FROM y GROUP BY exit_time""",
)


def fwd(h: int, entry: str = "close") -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    full = f"count(*) {w} = {h}"
    return f"CASE WHEN {full} THEN lead(close, {h}) OVER {W} / {entry} - 1 END AS fwd_ret_{h}, CASE WHEN {full} THEN max(high) {w} / {entry} - 1 END AS fwd_mfe_{h}, CASE WHEN {full} THEN min(low) {w} / {entry} - 1 END AS fwd_mae_{h}"


FWD_COLUMNS = ", ".join(f"fwd_{x}_{h}" for h in (1, 4, 8) for x in ("ret", "mfe", "mae"))
LABELS = f"lab AS (SELECT *, {fwd(1)}, {fwd(4)}, {fwd(8)} FROM bars)"
sql("forward_labels", f"{BARS}, {LABELS}", f"SELECT symbol, bar_ts, {r(FWD_COLUMNS)} FROM lab")
sql(
    "directional_labels",
    f"{MRC}, {LABELS}",
    """, d AS (SELECT symbol, bar_ts, candidate, side, fwd_ret_8 AS r, fwd_mfe_8 AS f, fwd_mae_8 AS a FROM mrc JOIN lab USING (symbol, bar_ts))
SELECT symbol, bar_ts, candidate, side, round(CASE WHEN side = 'SHORT' THEN -r ELSE r END, 6) AS dir_ret_8, round(CASE WHEN side = 'SHORT' THEN 1 / (1 + a) - 1 ELSE f END, 6) AS dir_mfe_8, round(CASE WHEN side = 'SHORT' THEN 1 / (1 + f) - 1 ELSE a END, 6) AS dir_mae_8 FROM d""",
)
sql(
    "first_touch",
    SIG,
    f""", x AS (SELECT *, row_number() OVER {W} AS rn FROM sig), e AS (SELECT * FROM x WHERE breakout AND atr IS NOT NULL),
h AS (SELECT e.symbol, e.bar_ts, min(CASE WHEN x.high >= e.close + e.atr THEN x.rn END) AS u, min(CASE WHEN x.low <= e.close - e.atr / 2 THEN x.rn END) AS d
  FROM e LEFT JOIN x ON x.symbol = e.symbol AND x.rn BETWEEN e.rn + 1 AND e.rn + 8 GROUP BY ALL)
SELECT symbol, bar_ts, CASE WHEN u IS NULL AND d IS NULL THEN 'none' WHEN u = d THEN 'ambiguous' WHEN d IS NULL OR u < d THEN 'plus' ELSE 'minus' END AS touch FROM h
UNION ALL SELECT symbol, bar_ts, NULL FROM x WHERE breakout AND atr IS NULL""",
)
sql(
    "bars_to_reversion",
    SIG,
    f""", x AS (SELECT *, row_number() OVER {W} AS rn FROM sig)
SELECT e.symbol, e.bar_ts, min(CASE WHEN e.close < e.ema_slow THEN CASE WHEN x.high >= e.ema_slow THEN x.rn - e.rn END ELSE CASE WHEN x.low <= e.ema_slow THEN x.rn - e.rn END END) AS bars_to_mean, coalesce(bool_or(x.breakout), false) AS breakout_ahead
FROM x e LEFT JOIN x ON x.symbol = e.symbol AND x.rn BETWEEN e.rn + 1 AND e.rn + 16 GROUP BY e.symbol, e.bar_ts""",
)
sql(
    "path_windows",
    EVENTS,
    """, w(window_s) AS (VALUES (3600), (14400), (28800))
SELECT ev.symbol, ev.event_id, window_s, round(max(price) / any_value(ev.close) - 1, 6) AS mfe, round(min(price) / any_value(ev.close) - 1, 6) AS mae, count(*) AS n_points, arg_min(ts, (-price, ts)) AS mfe_time,
  min(price) / any_value(ev.close) - 1 <= -(1 / 2 - 0.005) AS liq_2x, NOT (min(price) / any_value(ev.close) - 1 <= -(1 / 2 - 0.005)) AS safe_2x,
  min(price) / any_value(ev.close) - 1 <= -(1 / 5 - 0.005) AS liq_5x, NOT (min(price) / any_value(ev.close) - 1 <= -(1 / 5 - 0.005)) AS safe_5x
FROM ev CROSS JOIN w JOIN ticks t ON t.symbol = ev.symbol AND t.ts >= signal_time AND t.ts <= signal_time + to_seconds(window_s) GROUP BY ev.symbol, ev.event_id, window_s""",
)

# ------------------------------------------------------------------ ledger and metrics

sql(
    "trade_costs",
    "",
    """WITH o AS (SELECT l_orderkey, min(l_extendedprice) AS a, max(l_extendedprice) AS b, sum(l_quantity) AS q, CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END AS s FROM lineitem GROUP BY l_orderkey),
f AS (SELECT *, a * (1 + s * 0.00053) AS ef, b * (1 - s * 0.00053) AS xf FROM o)
SELECT l_orderkey, round(ef, 7) AS entry_fill, round(xf, 7) AS exit_fill, round((ef + xf) * q * 0.00037, 7) AS fees, round((abs(ef - a) + abs(xf - b)) * q, 7) AS slippage_cost,
  round((xf - ef) * q * s, 7) AS gross_pnl, round((xf - ef) * q * s - (ef + xf) * q * 0.00037, 2) AS net_pnl FROM f""",
)
sql(
    "exit_resolution",
    EVENTS,
    """, e AS (SELECT event_id, ev.symbol, b.bar_ts AS entry_time, b.open AS entry_price, b.open - ev.atr AS stop FROM ev ASOF JOIN bars b ON ev.symbol = b.symbol AND ev.signal_time < b.bar_ts),
z AS (SELECT symbol, max(bar_ts) AS lt, arg_max(close, bar_ts) AS lc FROM bars GROUP BY symbol),
x AS (SELECT e.*, f.bar_ts AS ft, f.close AS fc FROM e ASOF LEFT JOIN (SELECT * FROM sig WHERE exit_signal) f ON e.symbol = f.symbol AND e.entry_time < f.bar_ts),
u AS (SELECT x.*, coalesce(ft, lt) AS until, lc FROM x JOIN z USING (symbol)),
s AS (SELECT u.event_id, min(b.bar_ts) AS st FROM u JOIN bars b ON b.symbol = u.symbol AND b.bar_ts > u.entry_time AND b.bar_ts <= u.until AND b.low <= u.stop GROUP BY u.event_id),
v AS (SELECT u.*, st, coalesce(st, until) AS exit_time FROM u LEFT JOIN s USING (event_id))
SELECT v.symbol, v.event_id, entry_time, round(entry_price, 6) AS entry_price, round(stop, 6) AS stop, exit_time, CASE WHEN st IS NOT NULL THEN 'stop' WHEN ft IS NOT NULL THEN 'signal' ELSE 'end_of_data' END AS exit_reason,
  round(CASE WHEN st IS NOT NULL THEN stop ELSE coalesce(fc, lc) END, 6) AS exit_price,
  (SELECT max(high) FROM bars b WHERE b.symbol = v.symbol AND b.bar_ts > v.entry_time AND b.bar_ts <= v.exit_time) AS path_high, (SELECT min(low) FROM bars b WHERE b.symbol = v.symbol AND b.bar_ts > v.entry_time AND b.bar_ts <= v.exit_time) AS path_low FROM v""",
)
sql(
    "target_exits",
    EVENTS,
    """, e AS (SELECT event_id, symbol, signal_time AS entry_time, close AS entry_price, close + atr AS target, close - atr / 2 AS stop FROM ev),
p AS (SELECT e.event_id, b.bar_ts, b.close, b.low <= e.stop AS s, b.high >= e.target AS t FROM e JOIN bars b ON b.symbol = e.symbol AND b.bar_ts > e.entry_time AND b.bar_ts <= e.entry_time + INTERVAL 8 HOUR),
h AS (SELECT event_id, min(bar_ts) FILTER (s OR t) AS ht, arg_min(s, bar_ts) FILTER (s OR t) AS hs, max(bar_ts) AS lt, arg_max(close, bar_ts) AS lc FROM p GROUP BY event_id)
SELECT e.event_id, symbol, entry_time, round(entry_price, 6) AS entry_price, round(target, 6) AS target, round(stop, 6) AS stop, coalesce(ht, lt) AS exit_time, round(CASE WHEN ht IS NULL THEN lc WHEN hs THEN stop ELSE target END, 6) AS exit_price,
  CASE WHEN lt IS NULL THEN 'no_path' WHEN ht IS NULL THEN 'time' WHEN hs THEN 'stop' ELSE 'target' END AS exit_reason FROM e LEFT JOIN h USING (event_id)""",
)
sql(
    "compounded_backtest",
    ORACLE_SQL["non_overlapping_trades"].removeprefix("WITH RECURSIVE ").rpartition("\nSELECT")[0],
    """, t AS (SELECT o.symbol, o.side, o.trade_id, o.entry_time, o.exit_time, ret, 1000 * exp(sum(ln(1 + ret)) OVER (PARTITION BY o.symbol, o.side ORDER BY o.entry_time, o.trade_id ROWS UNBOUNDED PRECEDING)) AS a
  FROM o JOIN k USING (symbol, side, rn) JOIN trades USING (trade_id) WHERE kept)
SELECT symbol, side, trade_id, entry_time, exit_time, round(ret, 6) AS ret, round(a, 6) AS balance_after, round(coalesce(lag(a) OVER (PARTITION BY symbol, side ORDER BY entry_time, trade_id), 1000), 6) AS balance_before FROM t""",
)
sql(
    "cost_stress",
    TRADES,
    """, c(scenario, drift, slip, fx) AS (VALUES ('base', 0, 0, 1), ('delay', 0.001, 0, 1), ('slippage', 0, 0.0005, 1), ('fees_x2', 0, 0, 2), ('liquidation', 0, 0, 1), ('all', 0.001, 0.0005, 2)),
s AS (SELECT symbol, scenario, ret - drift::DOUBLE - 2 * slip::DOUBLE - (fx::DOUBLE - 1) * (total_fee / notional) AS v FROM trades CROSS JOIN c)
SELECT symbol, scenario, round(avg(v), 8) AS mean_ret, count(*) FILTER (v > 0) AS n_wins FROM s GROUP BY ALL""",
)


def pf(v: str, empty: str = "NULL") -> str:
    gain, loss = f"coalesce(sum({v}) FILTER ({v} > 0), 0)", f"coalesce(sum({v}) FILTER ({v} < 0), 0)"
    return f"CASE WHEN {loss} < 0 THEN {gain} / -({loss}) WHEN {gain} > 0 THEN 'inf'::DOUBLE ELSE {empty} END"


sql("cost_multiples", TRADES, f", m(multiple) AS (VALUES (1.0::DOUBLE), (1.5), (2.0)), a AS (SELECT symbol, multiple, net_pnl - (multiple - 1) * total_fee AS v FROM trades CROSS JOIN m) SELECT symbol, multiple, round({pf('v')}, 6) AS profit_factor, round(sum(v), 2) AS net FROM a GROUP BY ALL")
sql(
    "trade_summary",
    TRADES,
    f""", s AS (SELECT symbol, side, count(*) AS n_trades, count(*) FILTER (net_pnl > 0) AS n_wins, count(*) FILTER (net_pnl <= 0) AS n_losses, sum(net_pnl) AS net, coalesce(sum(net_pnl) FILTER (net_pnl > 0), 0) AS gains, coalesce(sum(net_pnl) FILTER (net_pnl < 0), 0) AS losses,
  avg(net_pnl) AS avg_trade, avg(net_pnl) FILTER (net_pnl > 0) AS avg_win, avg(net_pnl) FILTER (net_pnl <= 0) AS avg_loss, max(net_pnl) AS best, min(net_pnl) AS worst, median(net_pnl) AS median_trade, {pf('net_pnl', '0')} AS profit_factor,
  exp(avg(ln(1 + ret)) FILTER (ret > -1)) - 1 AS geo_mean, epoch(max(exit_time) - min(entry_time)) / 86400.0 AS days FROM trades GROUP BY ALL)
SELECT symbol, side, n_trades, n_wins, n_losses, {', '.join(f'round({c}, 3) AS {c}' for c in 'net gains losses avg_trade avg_win avg_loss best worst median_trade'.split())}, round(profit_factor, 6) AS profit_factor, round(geo_mean, 6) AS geo_mean,
  round(n_wins / n_trades, 6) AS win_rate, round(avg_win / nullif(-avg_loss, 0), 6) AS payoff, round(net / 1e6, 6) AS total_return, round(days, 6) AS days, round(CASE WHEN net / 1e6 <= -1 THEN -1 ELSE pow(1 + net / 1e6, 365.25 / days) - 1 END, 6) AS annual_return FROM s""",
)
DD = f"{EQUITY}, dd AS (SELECT *, equity / max(equity) OVER {T[:-1]} ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM equity)"
sql("max_drawdown", DD, "SELECT symbol, round(min(drawdown), 6) AS max_drawdown, arg_min(exit_time, (drawdown, exit_time, trade_id)) AS trough_time FROM dd GROUP BY symbol")
sql(
    "concentration",
    TRADES,
    ", k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY net_pnl DESC, trade_id) AS rn FROM trades) SELECT symbol, "
    + ", ".join(f"round(coalesce(sum(net_pnl) FILTER (rn <= {n} AND net_pnl > 0), 0) / CASE WHEN sum(net_pnl) > 0 THEN sum(net_pnl) END, 6) AS top_{n}_share" for n in (1, 5, 10))
    + " FROM k GROUP BY symbol",
)
sql(
    "quarterly_summary",
    TRADES,
    f""", q AS (SELECT *, year(exit_time) || 'Q' || quarter(exit_time) AS period FROM trades), e AS (SELECT *, 1e6 + sum(net_pnl) OVER (PARTITION BY symbol, period ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS eq FROM q),
d AS (SELECT *, eq / greatest(1e6, max(eq) OVER (PARTITION BY symbol, period ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM e)
SELECT symbol, period, count(*) AS n_trades, round(sum(net_pnl), 2) AS net, round(sum(net_pnl) / 1e6, 6) AS period_return, round({pf('net_pnl')}, 6) AS profit_factor, round(avg((net_pnl > 0)::INT), 6) AS win_rate, round(least(min(dd), 0), 6) AS max_drawdown,
  CASE WHEN count(*) < 5 THEN 'insufficient_sample' ELSE 'ok' END AS status FROM d GROUP BY symbol, period""",
)
sql(
    "grouping_sets_summary",
    TRADES,
    f"""SELECT CASE WHEN grouping(symbol) = 0 AND grouping(side) = 0 THEN 'symbol,side' WHEN grouping(symbol) = 0 THEN 'symbol' WHEN grouping(side) = 0 THEN 'side' WHEN grouping(exit_reason) = 0 THEN 'exit_reason' ELSE 'all' END AS grouping,
  symbol, side, exit_reason, count(*) AS n, round(avg(net_pnl), 3) AS mean, round(median(net_pnl), 3) AS median, round(avg((net_pnl > 0)::INT), 6) AS positive_rate, round({pf('net_pnl')}, 6) AS profit_factor
FROM trades GROUP BY GROUPING SETS ((), (symbol), (side), (symbol, side), (exit_reason))""",
)
sql(
    "holding_buckets",
    TRADES,
    """, h AS (SELECT *, epoch(exit_time - entry_time) / 3600 AS h FROM trades)
SELECT symbol, CASE WHEN h < 48 THEN '[0,48)' WHEN h < 96 THEN '[48,96)' WHEN h < 144 THEN '[96,144)' ELSE '[144,)' END AS bucket, count(*) AS n, round(sum(net_pnl), 2) AS net, round(avg(net_pnl), 3) AS mean FROM h GROUP BY ALL""",
)
sql("exit_reasons", TRADES, "SELECT symbol, exit_reason, count(*) AS n, round(sum(net_pnl), 2) AS net, round(avg(net_pnl), 3) AS mean, round(avg((net_pnl > 0)::INT), 6) AS win_rate, round(avg(epoch(exit_time - entry_time) / 3600), 6) AS mean_hours FROM trades GROUP BY ALL")
sql("monthly_correlation", TRADES, "SELECT strftime(exit_time, '%Y-%m') AS month, count(*) AS n, round(corr(n_lines, net_pnl), 6) AS corr FROM trades GROUP BY ALL HAVING count(*) >= 20")
sql("value_mix", TRADES, ", c AS (SELECT symbol, exit_reason, count(*) AS n FROM trades GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, exit_reason) AS rn FROM c) SELECT symbol, count(*) AS n_distinct, arg_min(exit_reason, rn) AS dominant FROM k GROUP BY symbol")
sql("period_positive_rate", TRADES, ", s AS (SELECT symbol, strftime(exit_time, '%Y-%m') AS month, sum(net_pnl) AS s FROM trades GROUP BY ALL) SELECT symbol, count(*) AS n_periods, round(avg((s > 0)::INT), 6) AS positive_rate, round(min(s), 2) AS worst, arg_min(month, (s, month)) AS worst_period FROM s GROUP BY symbol")
sql("buy_and_hold", BARS, "SELECT symbol, arg_min(open, bar_ts) AS first_open, arg_max(close, bar_ts) AS last_close, round(arg_max(close, bar_ts) / arg_min(open, bar_ts) - 1, 6) AS buy_and_hold FROM bars GROUP BY symbol")
sql(
    "peak_to_trough",
    EQUITY,
    """, t AS (SELECT symbol, max(equity) AS peak, arg_max(exit_time, (equity, exit_time, trade_id)) AS peak_time FROM equity GROUP BY symbol)
SELECT e.symbol, round(any_value(peak), 2) AS peak, peak_time, round(min(equity), 2) AS trough, arg_min(exit_time, (equity, exit_time, trade_id)) AS trough_time, count(*) AS n_rows, round(min(equity) / any_value(peak) - 1, 6) AS fall FROM equity e JOIN t USING (symbol) WHERE exit_time >= peak_time GROUP BY e.symbol, peak_time""",
)
sql(
    "feature_by_outcome",
    TRADES,
    """, l AS (SELECT symbol, CASE WHEN net_pnl > 0 THEN 'win' ELSE 'loss' END AS outcome, 'n_lines' AS feature, n_lines::DOUBLE AS v FROM trades UNION ALL SELECT symbol, CASE WHEN net_pnl > 0 THEN 'win' ELSE 'loss' END, 'total_fee', total_fee FROM trades)
SELECT symbol, outcome, feature, count(v) AS n, round(avg(v), 3) AS mean, round(median(v), 6) AS median FROM l GROUP BY ALL""",
)
sql(
    "top_trades",
    TRADES,
    "SELECT symbol, trade_id, row_number() OVER (PARTITION BY symbol ORDER BY net_pnl DESC, trade_id)::INT AS rank_top, row_number() OVER (PARTITION BY symbol ORDER BY net_pnl, trade_id)::INT AS rank_bottom FROM trades QUALIFY rank_top <= 5 OR rank_bottom <= 5",
)
sql("reason_crosstab", TRADES, "SELECT symbol, count(*) FILTER (exit_reason = 'F') AS F, count(*) FILTER (exit_reason = 'O') AS O, count(*) FILTER (exit_reason = 'P') AS P FROM trades GROUP BY symbol")

# ------------------------------------------------------------------ ranking, statistics, validation

ROWS = f"""{BARS}, {LABELS},
fr AS (SELECT *, round(close / lag(close, 6) OVER {W} - 1, 9) AS momentum, round((high - low) / close, 9) AS spread, n_ticks::DOUBLE AS activity, strftime(bar_ts, '%Y-%m') AS month, ((day(bar_ts) - 1) // 7)::INT AS week,
  symbol || '_' || strftime(bar_ts, '%Y%m%d%H') AS event_id FROM lab)"""


def quintile_sql(source: str, value: str, tie: str, out: str) -> str:
    return f"""{out}_k AS (SELECT *, row_number() OVER (PARTITION BY symbol, {value} IS NULL ORDER BY {value}, {tie}) AS q_rn, count(*) OVER (PARTITION BY symbol, {value} IS NULL) AS q_n,
  dense_rank() OVER (PARTITION BY symbol, {value} IS NULL ORDER BY {value}) AS q_d FROM {source}),
{out} AS (SELECT *, CASE WHEN {value} IS NOT NULL AND q_n >= 50 AND max(q_d) OVER (PARTITION BY symbol, {value} IS NULL) >= 20 THEN greatest(1, ceil((q_rn - 1) * 5 / (q_n - 1)))::INT END AS quintile FROM {out}_k)"""


def quintile_table(source: str, h: int, keys: str = "symbol, quintile") -> str:
    return f"""SELECT {keys}, count(*) AS n, avg(fwd_ret_{h}) AS mean_ret, median(fwd_ret_{h}) AS median_ret, avg(fwd_mfe_{h}) AS mean_mfe, avg(fwd_mae_{h}) AS mean_mae, avg((fwd_ret_{h} > 0)::INT) AS positive_rate,
  avg(fwd_mfe_{h}) / nullif(-avg(fwd_mae_{h}), 0) AS mfe_mae FROM {source} WHERE quintile IS NOT NULL AND fwd_ret_{h} IS NOT NULL GROUP BY {keys}"""


QT = f"{ROWS}, {quintile_sql('fr', 'momentum', 'event_id', 'qm')}, qt AS ({quintile_table('qm', 4)})"
TABLE = "mean_ret, median_ret, mean_mfe, mean_mae, positive_rate, mfe_mae"
sql("factor_quintiles", QT, f"SELECT symbol, quintile, n, {r(TABLE)} FROM qt")
sql(
    "factor_monotonicity",
    QT,
    """, d AS (SELECT *, mean_ret - lag(mean_ret) OVER (PARTITION BY symbol ORDER BY quintile) AS d, last_value(mean_ret) OVER w - first_value(mean_ret) OVER w AS e FROM qt WINDOW w AS (PARTITION BY symbol ORDER BY quintile ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
g AS (SELECT symbol, count(*) AS n_groups, any_value(e) AS spread, count(*) FILTER (sign(d) * sign(e) < 0) AS violations FROM d GROUP BY symbol)
SELECT symbol, n_groups, round(spread, 6) AS spread, violations, round(1 - violations / nullif(n_groups - 1, 0), 6) AS consistency, CASE WHEN n_groups < 5 THEN 'insufficient_sample' WHEN violations = 0 THEN 'monotonic' WHEN violations = 1 THEN 'mostly_monotonic' ELSE 'not_monotonic' END AS status FROM g""",
)


def rank_sql(source: str, value: str, out: str, name: str) -> str:
    return f"{out} AS (SELECT *, CASE WHEN {value} IS NOT NULL THEN (rank() OVER (PARTITION BY symbol, {value} IS NULL ORDER BY {value}) + (count(*) OVER (PARTITION BY symbol, {value}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY symbol, {value} IS NULL) END AS {name} FROM {source})"


sql(
    "score_groups",
    f"{ROWS}, {rank_sql('fr', 'activity', 'ra', 'p')}",
    "SELECT symbol, CASE WHEN p IS NULL THEN 'invalid' WHEN p <= 0.2 THEN 'bottom20' WHEN p <= 0.4 THEN 'bottom40' WHEN p > 0.8 THEN 'top20' WHEN p >= 0.6 AND p < 0.8 THEN 'top40' ELSE 'middle20' END AS score_group, count(*) AS n, round(avg(fwd_ret_4), 6) AS mean_ret FROM ra GROUP BY ALL",
)
sql(
    "reference_percentile",
    ROWS,
    ", a AS (SELECT symbol, event_id, spread FROM fr WHERE week = 4), b AS (SELECT symbol, spread FROM fr WHERE week < 4) SELECT event_id, round(100.0::DOUBLE * count(*) FILTER (b.spread <= a.spread) / nullif(count(b.spread), 0), 6) AS pct FROM a LEFT JOIN b USING (symbol) GROUP BY event_id",
)
sql("rank_overlap", f"{ROWS}, {rank_sql('fr', 'momentum', 'r1', 'a')}, {rank_sql('r1', 'spread', 'r2', 'b')}", "SELECT symbol, count(*) FILTER (a >= 0.8) AS n_top, round(avg((b >= 0.8)::INT) FILTER (a >= 0.8), 6) AS overlap FROM r2 GROUP BY symbol")
QS = f"{ROWS}, {quintile_sql('fr', 'spread', 'event_id', 'qs0')}, qs AS (SELECT * FROM qs0 WHERE quintile IS NOT NULL AND fwd_ret_4 IS NOT NULL)"
DIST = "SELECT symbol, count(*) AS n_runs, round(avg(mean), 6) AS mean, round(quantile_cont(mean, 0.05), 6) AS p05, round(quantile_cont(mean, 0.5), 6) AS p50, round(quantile_cont(mean, 0.95), 6) AS p95, round(avg((mean > 0)::INT), 6) AS positive_rate FROM draws GROUP BY symbol"
sql(
    "random_baseline",
    QS,
    f""", seen AS (SELECT symbol, avg(fwd_ret_4) FILTER (quintile = 5) - avg(fwd_ret_4) FILTER (quintile = 1) AS edge FROM qs GROUP BY symbol),
pool AS (SELECT symbol, fwd_ret_4 AS v, row_number() OVER (PARTITION BY symbol ORDER BY event_id) AS slot, count(*) FILTER (quintile = 5) OVER (PARTITION BY symbol) AS nh FROM qs WHERE quintile IN (1, 5)),
dealt AS (SELECT *, {draw_sql('run', 'slot', str(PRIME))} AS r FROM pool CROSS JOIN (SELECT unnest(range(1, 201)) AS run)),
f AS (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY r, slot) <= nh AS first FROM dealt), e AS (SELECT symbol, run, avg(v) FILTER (first) - avg(v) FILTER (NOT first) AS drawn FROM f GROUP BY symbol, run),
p AS (SELECT symbol, any_value(edge) AS edge, count(*) AS n_runs, (count(*) FILTER (CASE WHEN edge >= 0 THEN drawn >= edge ELSE drawn <= edge END) + 1) / (count(*) + 1) AS p_value, 100.0::DOUBLE * count(*) FILTER (drawn <= edge) / count(*) AS percentile FROM e JOIN seen USING (symbol) GROUP BY symbol),
q AS (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, symbol) AS q FROM p)
SELECT symbol, round(edge, 6) AS edge, n_runs, round(p_value, 6) AS p_value, round(percentile, 6) AS percentile, round(least(1, min(q) OVER (ORDER BY p_value DESC, symbol DESC ROWS UNBOUNDED PRECEDING)), 6) AS q_value FROM q""",
)
sql(
    "bootstrap_mean",
    QS,
    f""", base AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY event_id) - 1 AS slot, count(*) OVER (PARTITION BY symbol) AS n, fwd_ret_4 AS v FROM qs),
asked AS (SELECT symbol, run, {draw_sql('run', 'slot', 'n')} AS slot FROM base CROSS JOIN (SELECT unnest(range(1, 101)) AS run)), draws AS (SELECT symbol, run, avg(v) AS mean FROM asked JOIN base USING (symbol, slot) GROUP BY symbol, run)
{DIST}""",
)
BLOCKS = f"{QS}, sums AS (SELECT symbol, week, sum(fwd_ret_4) AS s, count(*) AS c FROM qs GROUP BY symbol, week)"
sql(
    "block_bootstrap",
    BLOCKS,
    f""", base AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY week) - 1 AS slot, count(*) OVER (PARTITION BY symbol) AS n FROM sums),
asked AS (SELECT symbol, run, {draw_sql('run', 'slot', 'n')} AS slot FROM base CROSS JOIN (SELECT unnest(range(1, 501)) AS run)), draws AS (SELECT symbol, run, sum(s) / sum(c) AS mean FROM asked JOIN base USING (symbol, slot) GROUP BY symbol, run)
{DIST}""",
)
sql(
    "matched_baseline",
    QS,
    f""", base AS (SELECT symbol, week, row_number() OVER (PARTITION BY symbol, week ORDER BY event_id) - 1 AS slot, fwd_ret_4 AS v FROM qs WHERE quintile < 5), sizes AS (SELECT symbol, week, count(*) AS n FROM base GROUP BY ALL),
ev5 AS (SELECT symbol, week, row_number() OVER (PARTITION BY symbol ORDER BY event_id) AS i FROM qs WHERE quintile = 5),
asked AS (SELECT symbol, week, run, {draw_sql('run', 'i', 'n')} AS slot FROM ev5 JOIN sizes USING (symbol, week) CROSS JOIN (SELECT unnest(range(1, 101)) AS run)), draws AS (SELECT symbol, run, avg(v) AS mean FROM asked JOIN base USING (symbol, week, slot) GROUP BY symbol, run)
{DIST}""",
)
sql(
    "random_direction",
    QS,
    f""", base AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY event_id) AS i, fwd_ret_4 AS v FROM qs),
draws AS (SELECT symbol, run, avg(CASE WHEN {draw_sql('run', 'i', '2')} = 1 THEN v ELSE -v END) AS mean FROM base CROSS JOIN (SELECT unnest(range(1, 101)) AS run) GROUP BY symbol, run)
{DIST}""",
)
sql(
    "order_shuffle",
    TRADES,
    f""", base AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY trade_id) AS i, net_pnl AS v FROM trades),
x AS (SELECT *, {draw_sql('run', 'i', str(PRIME))} AS r FROM base CROSS JOIN (SELECT unnest(range(1, 51)) AS run)), y AS (SELECT *, 1e6 + sum(v) OVER (PARTITION BY symbol, run ORDER BY r, i ROWS UNBOUNDED PRECEDING) AS eq FROM x),
z AS (SELECT *, eq / greatest(1e6, max(eq) OVER (PARTITION BY symbol, run ORDER BY r, i ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM y)
SELECT symbol, run, round(sum(v), 2) AS net, round(least(min(dd), 0), 6) AS max_drawdown FROM z GROUP BY symbol, run""",
)
sql(
    "tail_dependence",
    TRADES,
    """, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY net_pnl DESC, trade_id) AS rn FROM trades), b AS (SELECT symbol, max(s) AS best FROM (SELECT symbol, strftime(exit_time, '%Y-%m') AS m, sum(net_pnl) AS s FROM trades GROUP BY ALL) GROUP BY symbol),
t AS (SELECT symbol, sum(net_pnl) AS total, sum(net_pnl) FILTER (rn > 1) AS w1, sum(net_pnl) FILTER (rn > 3) AS w3, sum(net_pnl) FILTER (rn > 5) AS w5 FROM k GROUP BY symbol)
SELECT symbol, round(total, 2) AS total, round(w1, 2) AS without_best_1, round(w3, 2) AS without_best_3, round(w5, 2) AS without_best_5, round(total - best, 2) AS without_best_block,
  CASE WHEN total <= 0 THEN 'negative' WHEN w1 <= 0 THEN 'one_trade' WHEN total - best <= 0 THEN 'one_block' ELSE 'robust' END AS status FROM t JOIN b USING (symbol)""",
)
sql(
    "leave_block_out",
    BLOCKS,
    """, h AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY s DESC, week) AS hi, row_number() OVER (PARTITION BY symbol ORDER BY s, week) AS lo FROM sums)
SELECT symbol, round(sum(s) / sum(c), 6) AS mean, round(sum(s) FILTER (hi > 1) / sum(c) FILTER (hi > 1), 6) AS without_best, round(sum(s) FILTER (hi > 2) / sum(c) FILTER (hi > 2), 6) AS without_two_best,
  round((sum(s) + sum(s) FILTER (lo = 1)) / (sum(c) + sum(c) FILTER (lo = 1)), 6) AS worst_twice FROM h GROUP BY symbol""",
)
sql(
    "factor_correlations",
    f"{ROWS}, nn AS (SELECT * FROM fr WHERE momentum IS NOT NULL AND spread IS NOT NULL), {rank_sql('nn', 'momentum', 'c1', 'a')}, {rank_sql('c1', 'spread', 'c2', 'b')}",
    "SELECT symbol, count(*) AS n, round(corr(momentum, spread), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM c2 GROUP BY symbol",
)
sql(
    "monthly_kendall",
    TRADES,
    """, m AS (SELECT symbol, count(*) AS n, round(sum(net_pnl), 2) AS net FROM trades GROUP BY symbol, strftime(exit_time, '%Y-%m')), i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n, net) AS i FROM m),
p AS (SELECT x.symbol, sign(y.n - x.n) AS sa, sign(y.net - x.net) AS sb FROM i x JOIN i y ON x.symbol = y.symbol AND x.i < y.i)
SELECT symbol, round(sum(sa * sb) / nullif(sqrt((count(*) FILTER (sa <> 0))::DOUBLE * (count(*) FILTER (sb <> 0))), 0), 6) AS tau FROM p GROUP BY symbol""",
)
sql(
    "failure_lift",
    QS,
    "SELECT symbol, round(avg((fwd_mae_4 < -0.3)::INT), 6) AS base_rate, round(avg((fwd_mae_4 < -0.3)::INT) FILTER (quintile = 5), 6) AS risky_rate, round(avg((fwd_mae_4 < -0.3)::INT) FILTER (quintile = 5) / nullif(avg((fwd_mae_4 < -0.3)::INT), 0), 6) AS lift FROM qs GROUP BY symbol",
)
sql(
    "fit_transform_scores",
    ROWS,
    """, l AS (SELECT event_id, week, unnest(['momentum', 'spread', 'activity']) AS factor, unnest([momentum, spread, activity]) AS v FROM fr),
b AS (SELECT factor, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM l WHERE week < 2 GROUP BY factor),
c AS (SELECT factor, lo, hi, CASE WHEN v IS NOT NULL THEN least(greatest(v, lo), hi) END AS c FROM l JOIN b USING (factor) WHERE week < 2),
p AS (SELECT factor, any_value(lo) AS lo, any_value(hi) AS hi, avg(c) AS m, stddev_pop(c) AS s FROM c GROUP BY factor),
z AS (SELECT event_id, factor, CASE WHEN v IS NOT NULL THEN (least(greatest(v, lo), hi) - m) / nullif(s, 0) END AS z FROM l JOIN p USING (factor) WHERE week >= 2)
SELECT event_id, CASE WHEN factor = 'spread' THEN 'risk' ELSE 'trend' END AS family, round(avg(z * CASE WHEN factor = 'spread' THEN -1 ELSE 1 END), 6) AS score, count(z) AS n_factors FROM z GROUP BY ALL""",
)
sql("score_thresholds", ROWS, "SELECT symbol, round(quantile_cont(spread, 0.6), 6) AS q60, round(quantile_cont(spread, 0.8), 6) AS q80 FROM fr GROUP BY symbol")
sql(
    "time_split",
    TRADES,
    """, p AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY entry_time, trade_id) - 1) / count(*) OVER (PARTITION BY symbol) AS p FROM trades)
SELECT symbol, CASE WHEN p < 0.6 THEN 'train' WHEN p < 0.8 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, round(avg(net_pnl), 4) AS mean FROM p GROUP BY ALL""",
)
sql(
    "walk_forward",
    TRADES,
    f""", s AS (SELECT date_trunc('month', min(entry_time)) AS a, date_trunc('month', max(entry_time)) AS b FROM trades),
w AS (SELECT row_number() OVER (ORDER BY t) - 1 AS window_id, t AS test_start FROM (SELECT unnest(generate_series(a + INTERVAL 12 MONTH, b - INTERVAL 2 MONTH, INTERVAL 3 MONTH)) AS t FROM s)),
h AS (SELECT window_id, test_start, CASE WHEN entry_time < test_start THEN 'train' ELSE 'test' END AS part, ret, net_pnl FROM trades JOIN w ON entry_time >= test_start - INTERVAL 12 MONTH AND entry_time < test_start + INTERVAL 3 MONTH)
SELECT window_id::INT AS window_id, strftime(test_start, '%Y-%m-%d') AS test_start, part, count(*) AS n, round(avg(ret), 6) AS mean_ret, round({pf('net_pnl')}, 6) AS profit_factor FROM h GROUP BY ALL""",
)
sql(
    "edge_stability",
    f"{ROWS}, {rank_sql('fr', 'spread', 'k1', 'p')}",
    """, k AS (SELECT *, p >= 0.8 AS t, p <= 0.2 AS b FROM k1 WHERE fwd_ret_4 IS NOT NULL), wh AS (SELECT symbol, avg(fwd_ret_4) FILTER (t) - avg(fwd_ret_4) FILTER (b) AS w FROM k GROUP BY symbol),
g AS (SELECT symbol, 'week' AS grouping, week::VARCHAR AS grp, avg(fwd_ret_4) FILTER (t) - avg(fwd_ret_4) FILTER (b) AS e FROM k GROUP BY ALL UNION ALL SELECT symbol, 'month', month, avg(fwd_ret_4) FILTER (t) - avg(fwd_ret_4) FILTER (b) FROM k GROUP BY ALL)
SELECT symbol, grouping, count(e) AS n_groups, round(avg((sign(e) = sign(w))::INT) FILTER (e IS NOT NULL), 6) AS same_direction, round(min(e), 6) AS worst, round(any_value(w), 6) AS whole_edge FROM g JOIN wh USING (symbol) GROUP BY symbol, grouping""",
)
sql(
    "decision_ladder",
    TRADES,
    f"SELECT symbol, side, CASE WHEN count(*) < 100 THEN 'insufficient_sample' WHEN {pf('net_pnl', '0')} < 1 THEN 'reject' WHEN {pf('net_pnl', '0')} > 1.2 AND avg((net_pnl > 0)::INT) > 0.6 THEN 'advance' ELSE 'observe' END AS decision FROM trades GROUP BY ALL",
)
sql(
    "flagship",
    f"""{SIG}, fl0 AS (SELECT sig.*, round((close - ema_slow) / nullif(atr, 0), 9) AS factor FROM sig), fl1 AS (SELECT *, {fwd(1)}, {fwd(4)}, {fwd(8)} FROM fl0), {quintile_sql('fl1', 'factor', 'bar_ts', 'fq')},
h1 AS ({quintile_table('fq', 1)}), h4 AS ({quintile_table('fq', 4)}), h8 AS ({quintile_table('fq', 8)})""",
    f"SELECT symbol, quintile, n, {r(TABLE)}, horizon FROM (SELECT *, 1 AS horizon FROM h1 UNION ALL SELECT *, 4 FROM h4 UNION ALL SELECT *, 8 FROM h8)",
)

# ------------------------------------------------------------------ masks, leverage, further tables

SCORED = f"{ROWS}, {rank_sql('fr', 'momentum', 'sc1', 'm')}, {rank_sql('sc1', 'spread', 'sc', 's')}"
sql(
    "prototype_masks",
    SCORED,
    """, u AS (SELECT symbol, 'P0' AS prototype, fwd_ret_4 FROM sc UNION ALL SELECT symbol, 'P1', fwd_ret_4 FROM sc WHERE m >= 0.8 UNION ALL SELECT symbol, 'P2', fwd_ret_4 FROM sc WHERE s <= 0.2 UNION ALL SELECT symbol, 'P4', fwd_ret_4 FROM sc WHERE m >= 0.6 AND s <= 0.4)
SELECT symbol, prototype, count(*) AS n, round(avg(fwd_ret_4), 6) AS mean_ret FROM u GROUP BY ALL""",
)
sql(
    "path_gates",
    SCORED,
    """, p AS (SELECT fwd_mae_4, coalesce(-s >= -0.7, false)::INT AS a, coalesce(m >= 0.4, false)::INT AS b, coalesce(activity >= 2, false)::INT AS c FROM sc),
u AS (SELECT 'G0' AS gate, true AS accepted, fwd_mae_4 FROM p UNION ALL SELECT 'G1', a >= 1, fwd_mae_4 FROM p UNION ALL SELECT 'G2', a + b >= 2, fwd_mae_4 FROM p UNION ALL SELECT 'G3', a + b + c >= 2, fwd_mae_4 FROM p)
SELECT gate, accepted, count(*) AS n, round(avg(fwd_mae_4), 6) AS mean_mae FROM u GROUP BY ALL""",
)
sql(
    "ablation_ladder",
    ROWS,
    """, x AS (SELECT * FROM fr WHERE fwd_ret_4 IS NOT NULL), c AS (SELECT quantile_cont(spread, 0.4) AS a, quantile_cont(activity, 0.4) AS b, quantile_cont(momentum, 0.4) AS d FROM x),
u AS (SELECT 'all' AS rule, fwd_ret_4 FROM x UNION ALL SELECT 'spread', fwd_ret_4 FROM x, c WHERE spread >= a UNION ALL SELECT 'activity', fwd_ret_4 FROM x, c WHERE spread >= a AND activity >= b UNION ALL SELECT 'momentum', fwd_ret_4 FROM x, c WHERE spread >= a AND activity >= b AND momentum >= d)
SELECT rule, count(*) AS n, round(avg(fwd_ret_4), 6) AS mean_ret FROM u GROUP BY rule""",
)
sql(
    "location_reasons",
    SIG,
    ", l AS (SELECT concat_ws(';', "
    + ", ".join(f"CASE WHEN abs(close - {c}) / nullif(atr, 0) <= 0.35 THEN '{c}' END" for c in ("ema_fast", "ema_slow", "upper", "exit_low"))
    + ") AS location FROM sig) SELECT location, count(*) AS n FROM l GROUP BY location",
)
sql(
    "quality_filter",
    SIG,
    """, q AS (SELECT *, sum(close * volume) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS qv FROM sig)
SELECT symbol, CASE WHEN symbol = 'error' THEN 'blacklist' WHEN NOT coalesce(qv >= 2500, false) THEN 'volume' WHEN NOT coalesce(atr / close <= 1.5, false) THEN 'volatility' ELSE 'pass' END AS reason, count(*) AS n FROM q GROUP BY ALL""",
)
sql(
    "signal_scores",
    f"{SIG}, {CANDLES}",
    "SELECT least(100, greatest(0, 60 + CASE WHEN breakout THEN 25 ELSE 0 END + CASE WHEN close_location >= 0.7 THEN 10 ELSE 0 END + CASE WHEN volume > volume_mean THEN 10 ELSE 0 END - CASE WHEN exit_signal THEN 70 ELSE 0 END))::DOUBLE AS score, count(*) AS n FROM candles GROUP BY ALL",
)
sql(
    "longest_loss_values",
    TRADES,
    f""", f AS (SELECT *, net_pnl <= 0 AS l, row_number() OVER {T} AS rn FROM trades), i AS (SELECT *, rn - row_number() OVER (PARTITION BY symbol, l ORDER BY exit_time, trade_id) AS isl FROM f),
s AS (SELECT symbol, isl, min(rn) AS first, count(*) AS n, sum(net_pnl) AS total FROM i WHERE l GROUP BY symbol, isl)
SELECT symbol, max(n) AS run_length, round(arg_max(total, (n, -first)), 3) AS total FROM s GROUP BY symbol""",
)
sql("recent_losses", TRADES, ", x AS (SELECT symbol, coalesce(sum((net_pnl <= 0)::INT) OVER (PARTITION BY symbol ORDER BY exit_time, trade_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS recent_losses FROM trades) SELECT symbol, recent_losses, count(*) AS n FROM x GROUP BY ALL")
sql(
    "trailing_stops",
    EVENTS,
    """, p AS (SELECT ev.event_id, ev.close AS entry, b.bar_ts, b.high, b.low, max(b.high) OVER (PARTITION BY ev.event_id ORDER BY b.bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
  FROM ev JOIN bars b ON b.symbol = ev.symbol AND b.bar_ts BETWEEN signal_time AND signal_time + INTERVAL 24 HOUR),
l AS (SELECT *, CASE WHEN top >= entry * 1.15 THEN greatest(entry, top * 0.8) END AS lvl FROM p)
SELECT event_id, min(bar_ts) FILTER (low <= lvl) AS stop_time, round(arg_min(lvl, bar_ts) FILTER (low <= lvl), 6) AS stop_level FROM l GROUP BY event_id""",
)
_EXITS = ORACLE_SQL["exit_resolution"].removeprefix("WITH RECURSIVE ")
sql(
    "partial_take_profit",
    f"{_EXITS.rpartition(chr(10) + 'SELECT v.symbol')[0]}, ex AS (SELECT v.symbol{_EXITS.rpartition(chr(10) + 'SELECT v.symbol')[2]})",
    """, g(t, f) AS (VALUES (0.05::DOUBLE, 0.5::DOUBLE), (0.2, 0.5), (0.5, 0.25)), h AS (SELECT t, f, coalesce(path_high >= entry_price * (1 + t), false) AS hit, exit_price / entry_price - 1 AS plain FROM ex CROSS JOIN g)
SELECT t AS target_pct, f AS fraction, count(*) FILTER (hit) AS n_touched, round(avg(CASE WHEN hit THEN f * t + (1 - f) * plain ELSE plain END), 6) AS mean_ret FROM h GROUP BY ALL""",
)
sql("liquidation_levels", TRADES, ", x(leverage) AS (VALUES (5.0::DOUBLE), (10.0), (20.0)), e AS (SELECT o_orderkey AS trade_id, CASE WHEN o_orderkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side, o_totalprice AS entry FROM orders) SELECT trade_id, side, entry, leverage, round(entry * (1 - CASE WHEN side = 'LONG' THEN 1 ELSE -1 END * (1 / leverage - 0.005::DOUBLE)), 6) AS liquidation FROM e CROSS JOIN x")
sql(
    "leverage_by_volatility",
    SIG,
    ", v AS (SELECT atr / close AS a FROM sig WHERE atr IS NOT NULL) SELECT CASE WHEN a <= 0.5 THEN 20.0 WHEN a <= 1 THEN 10.0 WHEN a <= 2 THEN 5.0 ELSE 1.0 END::DOUBLE AS steps, greatest(1, least(30, floor(5.0::DOUBLE / nullif(a, 0))))::DOUBLE AS parity, count(*) AS n FROM v GROUP BY ALL",
)
sql(
    "marked_equity",
    BARS,
    """, t AS (SELECT symbol, bar_ts AS entry_time, bar_ts + INTERVAL 5 HOUR AS exit_time, close AS entry_price FROM bars WHERE hour(bar_ts) = 6),
j AS (SELECT b.symbol, b.bar_ts, b.close, t.entry_price, coalesce(b.bar_ts <= t.exit_time, false) AS in_trade FROM bars b ASOF LEFT JOIN t ON b.symbol = t.symbol AND b.bar_ts >= t.entry_time)
SELECT symbol, bar_ts, in_trade, round(1000 + CASE WHEN in_trade THEN (close - entry_price) * 2 ELSE 0 END, 6) AS marked FROM j""",
)
sql(
    "metric_table",
    TRADES,
    f""", s AS (SELECT side, count(*)::DOUBLE AS n, count(*) FILTER (net_pnl > 0) / count(*) AS w, {pf('net_pnl', '0')} AS p FROM trades GROUP BY side), l AS (SELECT side, unnest(['n_trades', 'win_rate', 'profit_factor']) AS metric, unnest([n, w, p]) AS v FROM s)
SELECT metric, round(max(v) FILTER (side = 'LONG'), 6) AS "LONG", round(max(v) FILTER (side = 'SHORT'), 6) AS "SHORT" FROM l GROUP BY metric""",
)
EDGES = f"{ROWS}, {rank_sql('fr', 'spread', 'ed', 'p')}"


def edge_sql(columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT symbol, '{c}' AS metric, count({c}) FILTER (p >= 0.8) AS n_top, count({c}) FILTER (p <= 0.2) AS n_bottom, avg({c}) FILTER (p >= 0.8) - avg({c}) FILTER (p <= 0.2) AS edge FROM ed GROUP BY symbol" for c in columns)


sql("safety_edges", EDGES, f", e AS ({edge_sql(['fwd_ret_4', 'fwd_mfe_4', 'fwd_mae_4'])}) SELECT symbol, metric, n_top, n_bottom, round(edge, 6) AS edge FROM e")
sql(
    "horizon_consistency",
    EDGES,
    f""", e AS (SELECT symbol, split_part(metric, '_', 3)::INT AS h, edge FROM ({edge_sql(['fwd_ret_1', 'fwd_ret_4', 'fwd_ret_8'])})),
g AS (SELECT symbol, arg_max(edge, h) AS l, arg_min(edge, h) AS f, arg_max(h, (abs(edge), h)) AS best_horizon FROM e GROUP BY symbol)
SELECT symbol, round(l, 6) AS last_edge, round(f, 6) AS first_edge, best_horizon, round((SELECT avg((sign(e.edge) = sign(l))::INT) FROM e WHERE e.symbol = g.symbol), 6) AS consistency,
  CASE WHEN sign(f) <> sign(l) THEN 'reverses' WHEN abs(l) > abs(f) THEN 'grows' ELSE 'decays' END AS pattern FROM g""",
)
sql(
    "eligible_symbols",
    TRADES,
    f"""SELECT symbol FROM trades GROUP BY symbol HAVING {pf('net_pnl', '0')} > 1 AND max(net_pnl) / CASE WHEN sum(net_pnl) > 0 THEN sum(net_pnl) END < 0.5 AND bool_or(n_lines >= 8)""",
)
sql(
    "state_terciles",
    ROWS,
    """, c AS (SELECT symbol, quantile_cont(spread, 1.0::DOUBLE / 3) AS a, quantile_cont(spread, 2.0::DOUBLE / 3) AS b FROM fr GROUP BY symbol)
SELECT symbol, CASE WHEN spread IS NULL THEN 'unknown' WHEN spread <= a THEN 'low' WHEN spread <= b THEN 'mid' ELSE 'high' END AS spread_state, count(*) AS n FROM fr JOIN c USING (symbol) GROUP BY ALL""",
)
sql(
    "event_cost_outcomes",
    SIG,
    f", x AS (SELECT *, {fwd(4)} FROM sig), y AS (SELECT *, fwd_ret_4 - 2 * (0.0004::DOUBLE + 0.0005) AS net FROM x WHERE breakout AND fwd_ret_4 IS NOT NULL AND atr IS NOT NULL) SELECT symbol, bar_ts, round(fwd_ret_4, 6) AS gross, round(net, 6) AS net, round(net * close / nullif(atr, 0), 6) AS r_multiple FROM y",
)
sql(
    "buy_sell_set_operations",
    TRADES,
    """, a AS (SELECT DISTINCT symbol, side, exit_reason, n_lines FROM trades WHERE net_pnl > 0), b AS (SELECT DISTINCT symbol, side, exit_reason, n_lines FROM trades WHERE net_pnl <= 0)
SELECT *, 'first_only' AS part FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'both' FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'second_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)

# ------------------------------------------------------------------ studies

sql(
    "confirmation_cost",
    SIG,
    """, e AS (SELECT symbol || '_' || strftime(bar_ts, '%Y%m%d%H') AS event_id, symbol, bar_ts AS s, high, close, atr FROM sig WHERE breakout AND atr IS NOT NULL),
c AS (SELECT e.event_id, min(ts) AS ct, arg_min(price, ts) AS cp FROM e JOIN ticks t ON t.symbol = e.symbol AND t.ts > e.s AND t.ts <= e.s + INTERVAL 4 HOUR AND t.price > e.high GROUP BY e.event_id)
SELECT symbol, count(*) AS n, count(ct) AS n_confirmed, round(avg(floor(epoch(ct - s))), 6) AS mean_wait_s, round(avg((cp - close) / nullif(atr, 0)), 6) AS mean_cost_r FROM e LEFT JOIN c USING (event_id) GROUP BY symbol""",
)
sql(
    "timing_modes",
    ACTIVE,
    f""", l AS (SELECT *, {fwd(4)}, sum(active_first::INT) OVER {RUN} AS segment FROM act), i AS (SELECT * FROM l WHERE active = 1),
u AS (SELECT 'delay_' || active_age AS timing, fwd_ret_4 FROM i WHERE active_age IN (0, 2, 4)
  UNION ALL SELECT 'drawn', fwd_ret_4 FROM (SELECT *, row_number() OVER (PARTITION BY symbol, segment ORDER BY (epoch(bar_ts)::BIGINT * 48271) % 2147483629, bar_ts) AS rr FROM i) WHERE rr = 1)
SELECT timing, count(*) AS n, round(avg(fwd_ret_4), 6) AS mean_ret FROM u GROUP BY timing""",
)
_PAIR = f"""{BARS}, p0 AS (SELECT 'click/view' AS symbol, a.bar_ts, a.close / nullif(b.close, 0) AS ratio FROM bars a JOIN bars b ON a.bar_ts = b.bar_ts AND a.symbol = 'click' AND b.symbol = 'view'),
{recursive_mean('p1', 'p0', {'m': ('ratio', 2 / 21)})}, p AS (SELECT p0.symbol, p0.bar_ts, ratio, m FROM p0 JOIN p1 USING (bar_ts)),
pz AS (SELECT symbol, bar_ts, ratio, ratio AS high, ratio AS low, ratio AS close, (ratio - lag(m) OVER {W}) / nullif({roll('stddev_samp', 'ratio', 48, 1, 32)}, 0) AS z FROM p),
pl AS (SELECT *, {fwd(8)}, row_number() OVER {W} AS rn FROM pz)"""
sql(
    "pair_events",
    _PAIR,
    """, h AS (SELECT e.symbol, e.bar_ts, e.ratio, e.z, e.fwd_ret_8, e.fwd_mfe_8, e.fwd_mae_8, min(CASE WHEN x.ratio >= e.ratio * 1.005::DOUBLE THEN x.rn END) AS u, min(CASE WHEN x.ratio <= e.ratio * 0.995::DOUBLE THEN x.rn END) AS d
  FROM pl e LEFT JOIN pl x ON x.rn BETWEEN e.rn + 1 AND e.rn + 8 WHERE abs(e.z) >= 1.5 GROUP BY ALL)
SELECT symbol, bar_ts, round(ratio, 6) AS ratio, round(z, 6) AS z, round(fwd_ret_8, 6) AS fwd_ret_8, round(fwd_mfe_8, 6) AS fwd_mfe_8, round(fwd_mae_8, 6) AS fwd_mae_8,
  CASE WHEN u IS NULL AND d IS NULL THEN 'none' WHEN u = d THEN 'ambiguous' WHEN d IS NULL OR u < d THEN 'plus' ELSE 'minus' END AS touch, CASE WHEN z > 0 THEN 'SHORT' ELSE 'LONG' END AS side FROM h""",
)
sql(
    "warm_up_sweep",
    f"""{BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) AS back FROM bars),
wu AS (SELECT k.symbol || '|' || l AS symbol, bar_ts, close FROM k CROSS JOIN (SELECT unnest([60, 120, 240]) AS l) WHERE back <= l), {recursive_mean('we', 'wu', {'m': ('close', 2 / 49)})}""",
    """, z AS (SELECT split_part(symbol, '|', 1) AS symbol, split_part(symbol, '|', 2)::INT AS lookback, arg_max(m, bar_ts) AS m FROM we GROUP BY ALL)
SELECT symbol, lookback, round(m, 6) AS mean, round(m - arg_max(m, lookback) OVER (PARTITION BY symbol), 6) AS delta FROM z""",
)
sql(
    "monthly_proxy",
    ACTIVE,
    f""", a AS (SELECT *, coalesce(lag(active) OVER {W}, 0) AS prv, lead(open) OVER {W} AS no, lead(bar_ts) OVER {W} AS nt FROM act),
b AS (SELECT *, last_value(CASE WHEN active = 1 AND prv = 0 THEN no END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS en FROM a),
m AS (SELECT symbol, strftime(nt, '%Y-%m') AS month, sum(no / en - 1) AS ret, count(*) AS n FROM b WHERE active = 0 AND prv = 1 AND no IS NOT NULL AND en IS NOT NULL GROUP BY ALL)
SELECT symbol, month, round(ret, 6) AS ret, n, ret < 0 AS negative, ret <= quantile_cont(ret, 0.25) OVER (PARTITION BY symbol) AS weak FROM m""",
)
sql(
    "portfolio_comparison",
    TRADES,
    """, m AS (SELECT strftime(exit_time, '%Y-%m') AS month, coalesce(avg(ret) FILTER (side = 'LONG'), 0) AS a, coalesce(avg(ret) FILTER (side = 'SHORT'), 0) AS b FROM trades GROUP BY ALL), x AS (SELECT *, 0.5 * a + 0.5 * b AS mix FROM m)
SELECT """
    + ", ".join(f"round({f}({c}), 6) AS {n}_{c}" for c in ("a", "b", "mix") for n, f in (("total", "sum"), ("mean", "avg"), ("worst", "min")))
    + ", round(corr(a, b), 6) AS corr, round(avg((b > 0)::INT) FILTER (a < 0), 6) AS b_gains_when_a_loses, count(*) FILTER (a < 0 AND b < 0) AS both_negative FROM x",
)
sql(
    "best_and_worst_removed",
    TRADES,
    f""", k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY net_pnl DESC, trade_id) AS hi, row_number() OVER (PARTITION BY symbol ORDER BY net_pnl, trade_id) AS lo FROM trades),
u AS (SELECT symbol, 'all' AS scenario, net_pnl FROM k UNION ALL SELECT symbol, 'without_best', net_pnl FROM k WHERE hi > 10 UNION ALL SELECT symbol, 'worst_twice', net_pnl FROM k UNION ALL SELECT symbol, 'worst_twice', net_pnl FROM k WHERE lo <= 10)
SELECT symbol, scenario, count(*) AS n, round(sum(net_pnl), 2) AS net, round({pf('net_pnl')}, 6) AS profit_factor FROM u GROUP BY ALL""",
)
sql(
    "cost_sensitivity",
    TRADES,
    f""", x(scenario, m) AS (VALUES ('none', 0), ('base', 1), ('double', 2), ('triple', 3)), u AS (SELECT symbol, scenario, gross_pnl - m * total_fee AS v, gross_pnl, notional FROM trades CROSS JOIN x)
SELECT symbol, scenario, round(sum(v), 2) AS net, round({pf('v')}, 6) AS profit_factor, round(sum(gross_pnl) / sum(notional), 6) AS break_even FROM u GROUP BY ALL""",
)
sql(
    "risk_sweep",
    TRADES,
    """, x AS (SELECT symbol, exit_time, trade_id, risk, exp(sum(ln(1 + risk * ret)) OVER (PARTITION BY symbol, risk ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING)) AS eq FROM trades CROSS JOIN (SELECT unnest([0.5::DOUBLE, 1.0, 2.0]) AS risk)),
d AS (SELECT *, eq / max(eq) OVER (PARTITION BY symbol, risk ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM x)
SELECT symbol, risk, round(ln(arg_max(eq, (exit_time, trade_id))), 6) AS log_final, round(min(dd), 6) AS max_drawdown FROM d GROUP BY symbol, risk""",
)
sql(
    "weak_month_overlap",
    TRADES,
    """, m AS (SELECT symbol, strftime(exit_time, '%Y-%m') AS month, sum(net_pnl) FILTER (side = 'LONG') AS a, sum(net_pnl) FILTER (side = 'SHORT') AS b FROM trades GROUP BY ALL)
SELECT symbol, count(*) AS n_months, round(avg((b > 0)::INT) FILTER (a < 0), 6) AS positive_in_negative, count(*) FILTER (a < 0 AND b < 0) AS both_negative, round(corr(a, b), 6) AS corr FROM m WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY symbol""",
)
sql(
    "context_events",
    SIG,
    f", x AS (SELECT *, lead(bar_ts) OVER {W} AS et, lead(open) OVER {W} AS ep FROM sig) SELECT symbol, count(*) AS n, round(avg(ep), 6) AS mean_entry, max(et) AS last_entry FROM x WHERE ema_fast > ema_slow AND close > ema_slow AND et IS NOT NULL GROUP BY symbol",
)
sql("holdout_symbols", BARS, "SELECT symbol FROM bars GROUP BY symbol HAVING NOT bool_or(close > 400) ORDER BY symbol LIMIT 3")
