"""Indicators and factors over bars: window functions, and recursive smoothing as a block scan.

A frame of n bars gives a value only when n values lie in it, unless `least` says otherwise. Missing is null, never NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.orderstats import Sliding, sliding
from tidemark.operators.pieces import numbered, with_halo
from tidemark.operators.selectk import quantiles
from tidemark.scratch import written

#: Rows of a piece of the block scan, and pieces of a group of its next level.
SCAN_BLOCK, SCAN_FAN = 4096, 256


def series(ts: str = "bar_ts"):
    return Window.partitionBy("symbol").orderBy(ts)


def frame(n: int, shift: int = 0, ts: str = "bar_ts"):
    """The n rows that end `shift` rows before the current one."""
    return series(ts).rowsBetween(1 - n - shift, -shift)


def rolling(agg: Column, over: str | Column, n: int, shift: int = 0, least: int | None = None, ts: str = "bar_ts") -> Column:
    w = frame(n, shift, ts)
    return F.when(F.count(over).over(w) >= (n if least is None else least), agg.over(w))


def _scan(m: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running composition of the maps y -> m y + c, by doubling steps."""
    step = 1
    while step < len(m):
        c = np.concatenate([c[:step], m[step:] * c[:-step] + c[step:]])
        m = np.concatenate([m[:step], m[step:] * m[:-step]])
        step *= 2
    return m, c


def _starts(nodes: DataFrame, n: int, fan: int) -> DataFrame:
    """symbol, node, y0..: the value of each of n recurrences before each of nodes(symbol, node, m0, c0, h0, ..), null if it has not
    begun. A node's map is h + m (y - h) + c about its first value h, at which a recurrence begins, so a constant stays as it is; without
    a value it leaves y. Groups of `fan` nodes are composed to a node of the
    next level until one is left, and the starts are handed down again, so no row holds more than one group."""

    def grouped(level: DataFrame) -> DataFrame:
        node = F.struct("node", *[f"{x}{i}" for i in range(n) for x in "mch"])
        return level.groupBy("symbol", F.floor(F.col("node") / fan).alias("up")).agg(F.sort_array(F.collect_list(node)).alias("kids"))

    levels = [grouped(nodes)]
    top = nodes.agg(F.max("node").alias("top")).first().top or 0
    while top >= fan:
        levels[-1] = written(levels[-1], "smooth-level")
        start = "named_struct('m', 1D, 'c', 0D, 'h', cast(null as double))"
        step = "if(k.h{0} is null, s, if(s.h is null, named_struct('m', k.m{0}, 'c', k.c{0}, 'h', k.h{0}), named_struct('m', s.m * k.m{0}, 'c', k.h{0} - s.h + k.m{0} * (s.h + s.c - k.h{0}) + k.c{0}, 'h', s.h)))"
        composed = [F.expr(f"aggregate(kids, {start}, (s, k) -> {step.format(i)})").alias(f"z{i}") for i in range(n)]
        above = levels[-1].select("symbol", F.col("up").alias("node"), *composed)
        nodes = written(above.select("symbol", "node", *[F.col(f"z{i}.{x}").alias(f"{x}{i}") for i in range(n) for x in "mch"]), "smooth-level")
        levels.append(grouped(nodes))
        top //= fan
    found = levels[-1].withColumns({f"y{i}": F.lit(None).cast("double") for i in range(n)})
    for level in [*reversed(levels[:-1]), None]:
        after = "if(k.h{0} is null, s.y, k.h{0} + k.c{0} + if(s.y is null, 0D, k.m{0} * (s.y - k.h{0})))"
        seen = [F.expr(f"aggregate(kids, named_struct('y', y{i}, 'o', cast(array() as array<double>)), (s, k) -> named_struct('y', {after.format(i)}, 'o', concat(s.o, array(s.y))), s -> s.o)").alias(f"y{i}") for i in range(n)]
        below = found.select("symbol", F.expr("transform(kids, k -> k.node)").alias("node"), *seen)
        below = below.select("symbol", F.inline(F.arrays_zip("node", *[f"y{i}" for i in range(n)])))
        if level is not None:
            found = level.join(below.withColumnRenamed("node", "up"), ["symbol", "up"])
    return below


def smooth(rows: DataFrame, items: dict[str, tuple[str, float]], ts: str = "bar_ts", block: int = SCAN_BLOCK, fan: int = SCAN_FAN, place: str | None = None) -> DataFrame:
    """Adds y_t = a * x_t + (1 - a) * y_(t-1), y_1 = x_1, for each {name: (x, a)}; nulls of x leave y as it is. With `place`, that
    column holds the rows' places in their series, for in_pieces().

    The recurrence is affine, so a piece of rows maps its start to its end by one factor and one offset: pieces are folded in
    parallel, their maps are scanned over levels of `fan`, and the pieces are replayed from their starts.
    """
    n, weights, columns = len(items), [a for _, a in items.values()], [*rows.columns, *(["__i"] if place else [])]
    inputs = [f"__x{i}" for i in range(n)]
    placed = numbered(rows, ["symbol"], [ts], "__i").withColumns({c: F.col(x).cast("double") for c, (x, _) in zip(inputs, items.values(), strict=True)})
    placed = placed.withColumn("__node", F.floor(F.col("__i") / block))

    def in_order(table: pa.Table) -> pa.Table:
        return table.take(pa.array(np.argsort(table.column("__i").to_numpy())))

    def running(table: pa.Table, i: int, about: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(rows that a value or the start precedes, running factors, running offsets, value) of a recurrence about that value, by default
        its first one."""
        x = table.column(inputs[i]).to_numpy()
        given = ~np.isnan(x)
        begun = np.full(len(x), True)
        if about is None:
            begun, about = np.cumsum(given) > 0, float(x[given][0]) if given.any() else 0.0
        return begun, *_scan(np.where(given, 1 - weights[i], 1.0), np.where(given, weights[i] * (np.nan_to_num(x) - about), 0.0)), about

    empty = [F.lit(None).cast("double").alias(f"{x}{i}") for i in range(n) for x in "mch"]
    nodes = placed.select("symbol", F.col("__node").alias("node"), *empty).schema

    def fold(table: pa.Table) -> pa.Table:
        table = in_order(table)
        out = [table.column(c).slice(0, 1) for c in ("symbol", "__node")]
        for i in range(n):
            begun, m, c, first = running(table, i, None)
            out += [pa.array([m[-1]]), pa.array([c[-1]]), pa.array([first if begun[-1] else None], pa.float64())]
        return pa.Table.from_arrays(out, nodes.names)

    maps = placed.select("symbol", "__node", "__i", *inputs).groupBy("symbol", "__node").applyInArrow(fold, nodes)
    starts = _starts(written(maps, "smooth-pieces"), n, fan).withColumnRenamed("node", "__node")
    out_schema = placed.select(*[F.col(f"`{c}`") for c in columns], *[F.lit(None).cast("double").alias(name) for name in items]).schema

    def replay(table: pa.Table) -> pa.Table:
        table = in_order(table)
        out = [table.column(c) for c in columns]
        for i in range(n):
            start = table.column(f"y{i}").to_numpy()[0]
            begun, _, c, about = running(table, i, None if np.isnan(start) else float(start))
            out.append(pa.array(about + c, mask=~begun))
        return pa.Table.from_arrays(out, out_schema.names)

    out = placed.join(starts, ["symbol", "__node"]).groupBy("symbol", "__node").applyInArrow(replay, out_schema)
    return out.withColumnRenamed("__i", place) if place else out


def in_pieces(rows: DataFrame, compute: Callable[[DataFrame], DataFrame], before: int, after: int = 0, size: int = 4096, ts: str = "bar_ts", place: str | None = None) -> DataFrame:
    """compute(rows) over pieces of `size` rows of each symbol, for window operators whose frames reach at most `before` rows
    back and `after` ahead: a piece also gets the rows around it, so a long series is spread over tasks. `place` is a column of the rows'
    places, which goes; without one they are numbered."""
    if place is None:
        rows, place = numbered(rows, ["symbol"], [ts], "__i"), "__i"
    placed = with_halo(rows, place, max(size, before, after), before, after)
    placed = placed.withColumn("symbol", F.struct("symbol", "__piece")).drop(place, "__piece")
    return compute(placed).where("__own").withColumn("symbol", F.col("symbol.symbol")).drop("__own")


def ema(rows: DataFrame, spans: dict[str, int], value: str = "close", ts: str = "bar_ts", place: str | None = None) -> DataFrame:
    return smooth(rows, {name: (value, 2 / (n + 1)) for name, n in spans.items()}, ts, place=place)


def true_range(ts: str = "bar_ts") -> Column:
    before = F.lag("close").over(series(ts))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(n: int = 14, ts: str = "bar_ts") -> Column:
    """Simple mean of a column tr."""
    return rolling(F.avg("tr"), "tr", n, ts=ts)


def donchian(n: int, side: str, ts: str = "bar_ts") -> Column:
    """Extreme of the n bars before."""
    return rolling(F.max("high"), "high", n, 1, ts=ts) if side == "upper" else rolling(F.min("low"), "low", n, 1, ts=ts)


def n_return(n: int, ts: str = "bar_ts") -> Column:
    return F.col("close") / F.nullif(F.lag("close", n).over(series(ts)), F.lit(0.0)) - 1


def efficiency_ratio(n: int, ts: str = "bar_ts") -> Column:
    """Needs a column step = |close - close before|."""
    path = rolling(F.sum("step"), "step", n, ts=ts)
    return F.abs(F.col("close") - F.lag("close", n).over(series(ts))) / F.nullif(path, F.lit(0.0))


def zscore(value: str, n: int, ts: str = "bar_ts") -> Column:
    mean, std = rolling(F.avg(value), value, n, ts=ts), rolling(F.stddev_samp(value), value, n, ts=ts)
    return (F.col(value) - mean) / F.nullif(std, F.lit(0.0))


def candle_metrics(rows: DataFrame) -> DataFrame:
    """body, upper_wick, lower_wick and close_location as shares of the bar's range (null if it has none)."""
    size = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    return rows.withColumns(
        {
            "body": F.abs(F.col("close") - F.col("open")) / size,
            "upper_wick": (F.col("high") - F.greatest("open", "close")) / size,
            "lower_wick": (F.least("open", "close") - F.col("low")) / size,
            "close_location": (F.col("close") - F.col("low")) / size,
        }
    )


def base_indicators(bars: DataFrame, fast: int = 12, slow: int = 48, channel: int = 20, exit_channel: int = 10, atr_n: int = 14, ts: str = "bar_ts") -> DataFrame:
    """True range, ATR, shifted channels, exponential means and the shifted volume mean of one timeframe."""
    rows = ema(bars, {"ema_fast": fast, "ema_slow": slow}, ts=ts, place="__place")

    def framed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("tr", true_range(ts)).withColumns(
            {
                "atr": atr(atr_n, ts),
                "upper": donchian(channel, "upper", ts),
                "exit_low": donchian(exit_channel, "lower", ts),
                "volume_mean": rolling(F.avg("volume"), "volume", channel, 1, ts=ts),
            }
        )

    return in_pieces(rows, framed, max(channel, exit_channel, atr_n) + 1, ts=ts, place="__place")


def event_factors(rows: DataFrame, short: int = 16, long: int = 96, rank_n: int = 200, ts: str = "bar_ts") -> DataFrame:
    """Factors of a bar over base_indicators(): returns, slopes and gaps in ATR, ranks, ratios."""
    a = F.nullif(F.col("atr"), F.lit(0.0))
    rows = sliding(rows, {"atr_rank": Sliding("atr", rank_n, 50)}, [ts], place="__place")
    one = F.col("close") / F.nullif(F.lag("close").over(series(ts)), F.lit(0.0)) - 1

    def framed(rows: DataFrame) -> DataFrame:
        rows = candle_metrics(rows).withColumn("ret_1", one).withColumn("step", F.abs(F.col("close") - F.lag("close").over(series(ts))))
        rows = rows.withColumn("atr_pct", F.col("atr") / F.nullif(F.col("close"), F.lit(0.0)))
        return rows.withColumns(factors)

    factors = {
        "ret_short": n_return(short, ts),
        "ret_long": n_return(long, ts),
        "slow_slope": (F.col("ema_slow") - F.lag("ema_slow", short).over(series(ts))) / a,
        "ema_gap": (F.col("ema_fast") - F.col("ema_slow")) / a,
        "breakout_distance": (F.col("close") - F.col("upper")) / a,
        "channel_width": (F.col("upper") - F.col("exit_low")) / a,
        "volatility_ratio": rolling(F.stddev_samp("ret_1"), "ret_1", short, ts=ts) / F.nullif(rolling(F.stddev_samp("ret_1"), "ret_1", long, ts=ts), F.lit(0.0)),
        "volume_z": zscore("volume", long, ts),
        "efficiency": efficiency_ratio(20, ts),
        "compression": (F.col("high") - F.col("low")) / F.nullif(F.lag(F.col("high") - F.col("low")).over(series(ts)), F.lit(0.0)),
    }
    return in_pieces(rows, framed, max(short, long, 20) + 1, ts=ts, place="__place")


def mean_reversion(rows: DataFrame, n: int = 32, ts: str = "bar_ts") -> DataFrame:
    """Shifted range, its middle, trend strength and the deviation from the fast mean in ATR."""
    a = F.nullif(F.col("atr"), F.lit(0.0))
    rows = rows.withColumn("range_upper", donchian(n, "upper", ts)).withColumn("range_lower", donchian(n, "lower", ts))
    return rows.withColumns(
        {
            "range_mid": (F.col("range_upper") + F.col("range_lower")) / 2,
            "trend_strength": F.abs(F.col("ema_fast") - F.col("ema_slow")) / a,
            "deviation": (F.col("close") - F.col("ema_fast")) / a,
        }
    )


def wilder(rows: DataFrame, n: int = 14, ts: str = "bar_ts") -> DataFrame:
    """rsi, wilder_atr and adx of length n."""
    w = series(ts)
    diff = F.col("close") - F.lag("close").over(w)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    rows = rows.withColumns(
        {
            "__gain": F.greatest(diff, F.lit(0.0) + diff * 0),
            "__loss": F.greatest(-diff, diff * 0),
            "__tr": F.when(diff.isNotNull(), true_range(ts)),
            "__plus": F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)),
            "__minus": F.when(down.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)),
        }
    )
    a = 1 / n
    rows = smooth(rows, {"__ag": ("__gain", a), "__al": ("__loss", a), "wilder_atr": ("__tr", a), "__pdm": ("__plus", a), "__mdm": ("__minus", a)}, ts)
    pdi, mdi = 100 * F.col("__pdm") / F.nullif(F.col("wilder_atr"), F.lit(0.0)), 100 * F.col("__mdm") / F.nullif(F.col("wilder_atr"), F.lit(0.0))
    rows = rows.withColumn("rsi", 100 * F.col("__ag") / F.nullif(F.col("__ag") + F.col("__al"), F.lit(0.0)))
    rows = rows.withColumn("__dx", 100 * F.abs(pdi - mdi) / F.nullif(pdi + mdi, F.lit(0.0)))
    rows = smooth(rows, {"adx": ("__dx", a)}, ts)
    return rows.drop("__gain", "__loss", "__tr", "__plus", "__minus", "__ag", "__al", "__pdm", "__mdm", "__dx")


def local_trend(rows: DataFrame, n: int = 20, ts: str = "bar_ts") -> DataFrame:
    """Moves over 3, 6 and 12 bars in ATR, counts of higher highs and lower lows, prior swings and distances."""
    w, a = series(ts), F.nullif(F.col("atr"), F.lit(0.0))
    rows = rows.withColumns(
        {
            "__hh": (F.col("high") > F.lag("high").over(w)).cast("int"),
            "__ll": (F.col("low") < F.lag("low").over(w)).cast("int"),
            "swing_high": donchian(n, "upper", ts),
            "swing_low": donchian(n, "lower", ts),
        }
    )
    moves = {f"move_{k}": (F.col("close") - F.lag("close", k).over(w)) / a for k in (3, 6, 12)}
    rows = rows.withColumns(
        moves
        | {
            "higher_highs": F.sum("__hh").over(frame(n, 0, ts)),
            "lower_lows": F.sum("__ll").over(frame(n, 0, ts)),
            "to_swing_high": (F.col("swing_high") - F.col("close")) / a,
            "to_swing_low": (F.col("close") - F.col("swing_low")) / a,
        }
    )
    return rows.drop("__hh", "__ll")


def volume_features(rows: DataFrame, n: int = 20, ts: str = "bar_ts") -> DataFrame:
    """Volume against the median and mean of the n bars before."""
    w = frame(n, 1, ts)
    full = F.count("volume").over(w) >= n
    return rows.withColumn("volume_vs_median", F.when(full, F.col("volume") / F.nullif(F.percentile("volume", F.lit(0.5)).over(w), F.lit(0.0)))).withColumn(
        "volume_vs_mean", F.when(full, F.col("volume") / F.nullif(F.avg("volume").over(w), F.lit(0.0)))
    )


def pair_ratio(bars: DataFrame, left: str, right: str, span: int = 20, n: int = 96, least: int = 32, ts: str = "bar_ts") -> DataFrame:
    """z-score of the ratio of two symbols' closes against its own earlier exponential mean and deviation."""
    one = bars.where(F.col("symbol") == left).select(ts, F.col("close").alias("a"))
    two = bars.where(F.col("symbol") == right).select(ts, F.col("close").alias("b"))
    rows = one.join(two, ts).select(F.lit(f"{left}/{right}").alias("symbol"), ts, (F.col("a") / F.nullif(F.col("b"), F.lit(0.0))).alias("ratio"))
    rows = ema(rows, {"__mean": span}, "ratio", ts)
    mean = F.lag("__mean").over(series(ts))
    std = rolling(F.stddev_samp("ratio"), "ratio", n, 1, least, ts)
    return rows.withColumn("z", (F.col("ratio") - mean) / F.nullif(std, F.lit(0.0))).drop("__mean")


def day_change(rows: DataFrame, n: int = 96, ts: str = "bar_ts") -> DataFrame:
    """Change on n bars ago and quote volume of the last n bars."""
    rows = rows.withColumn("change_24h", n_return(n, ts)).withColumn("__q", F.col("close") * F.col("volume"))
    return rows.withColumn("quote_volume_24h", F.sum("__q").over(frame(n, 0, ts))).drop("__q")


def regimes(rows: DataFrame, lag: int = 5, low: float = 0.33, high: float = 0.67, ts: str = "bar_ts") -> DataFrame:
    """trend_regime from the close against the slow mean and its slope; volatility_regime from atr_rank."""
    slope = F.col("ema_slow") - F.lag("ema_slow", lag).over(series(ts))
    trend = F.when((F.col("close") > F.col("ema_slow")) & (slope > 0), "up").when((F.col("close") < F.col("ema_slow")) & (slope < 0), "down")
    trend = F.when(slope.isNull(), "unknown").otherwise(trend.otherwise("range"))
    vol = F.when(F.col("atr_rank").isNull(), "unknown").when(F.col("atr_rank") <= low, "low").when(F.col("atr_rank") <= high, "mid").otherwise("high")
    return rows.withColumn("trend_regime", trend).withColumn("volatility_regime", vol)


def bucket(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed buckets; null is unknown."""
    out = F.when(value.isNull(), "unknown")
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(value <= edge, label)
    return out.otherwise(labels[-1])


def state_terciles(rows: DataFrame, value: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """low / mid / high by the value's terciles within keys (default: each symbol)."""
    keys = keys or ["symbol"]
    cuts = quantiles(rows, keys, value, {"__a": 1 / 3, "__b": 2 / 3})
    out = rows.join(cuts, keys, "left")
    state = F.when(F.col(value).isNull(), "unknown").when(F.col(value) <= F.col("__a"), "low").when(F.col(value) <= F.col("__b"), "mid").otherwise("high")
    return out.withColumn(name, state).drop("__a", "__b")
