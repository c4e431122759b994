"""Event data sets: directional breakouts, candlestick events with labels, entry-mode studies, gate tables, and trackers of
setups inside a valid state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import asof, indicators, labels, patterns
from tidemark.operators.indicators import series
from tidemark.operators.patterns import true


def directional_breakouts(rows: DataFrame) -> DataFrame:
    """Breakouts over candle metrics and mean_reversion() columns, both ways, one row each: side, the bar's far end as the
    stop, risk (share of the close), strength in ATR, and body and close location as the side sees them."""
    up, down = true(F.col("close") > F.col("range_upper")), true(F.col("close") < F.col("range_lower"))
    rows = rows.where(up | down).withColumn("side", F.when(up, "LONG").otherwise("SHORT"))
    is_long = F.col("side") == "LONG"
    a, close = F.nullif(F.col("atr"), F.lit(0.0)), F.nullif(F.col("close"), F.lit(0.0))
    rows = rows.withColumn("stop", F.when(is_long, F.col("low")).otherwise(F.col("high")))
    return rows.withColumns(
        {
            "risk": F.abs(F.col("close") - F.col("stop")) / close,
            "strength": F.when(is_long, F.col("close") - F.col("range_upper")).otherwise(F.col("range_lower") - F.col("close")) / a,
            "signed_body": F.when(F.col("close") >= F.col("open"), F.col("body")).otherwise(-F.col("body")) * F.when(is_long, 1.0).otherwise(-1.0),
            "side_location": F.when(is_long, F.col("close_location")).otherwise(1 - F.col("close_location")),
        }
    )


def candle_dataset(rows: DataFrame, horizons: list[int], within: int = 3, ts: str = "bar_ts") -> DataFrame:
    """Candlestick events with their side, local trend, volume, directional labels, and whether one of the next `within`
    closes lies beyond the bar on the event's side. rows: candle metrics over base_indicators()."""
    rows = indicators.volume_features(indicators.local_trend(rows, ts=ts), ts=ts)
    w = labels.forward(ts, within)
    rows = labels.forward_labels(rows, horizons, ts=ts).withColumns({"__up": F.max("close").over(w), "__down": F.min("close").over(w)})
    rows = patterns.candle_events(rows, ts=ts)
    rows = rows.withColumn("side", F.when(F.col("pattern").isin("hammer", "bullish_engulfing"), "LONG").otherwise("SHORT"))
    confirmed = F.when(F.col("side") == "LONG", F.col("__up") > F.col("high")).otherwise(F.col("__down") < F.col("low"))
    return labels.directional(rows.withColumn("confirmed", true(confirmed)), horizons).drop("__up", "__down")


def target_hits(rows: DataFrame, keys: list[str], mfe: str, targets: list[float]) -> DataFrame:
    """Per key and target: events with a label and the share whose favourable excursion reaches the target."""
    options = F.array(*map(F.lit, map(float, targets)))
    long = rows.where(F.col(mfe).isNotNull()).withColumn("target", F.explode(options))
    return long.groupBy(*keys, "target").agg(F.count("*").alias("n"), F.avg((F.col(mfe) >= F.col("target")).cast("double")).alias("hit_rate"))


def entry_mode_study(rows: DataFrame, modes: dict[str, Column], fine: DataFrame, seconds: list[int], bucket_seconds: int, ts: str = "bar_ts") -> DataFrame:
    """Per symbol, entry mode and window: events and their mean excursions on the finer path(symbol, ts, high, low) from the
    bar's close on."""
    events = patterns.entry_modes(rows, modes).select("symbol", "entry_mode", F.col(ts).alias("entry_time"), F.col("close").alias("entry_price"))
    paths = labels.path_windows(events, fine, seconds, "entry_time", "entry_price", ["symbol", "entry_mode", "entry_time"], bucket_seconds)
    return paths.groupBy("symbol", "entry_mode", "window_s").agg(F.count("*").alias("n"), F.avg("mfe").alias("mean_mfe"), F.avg("mae").alias("mean_mae"))


def candidate_history(rows: DataFrame, keep: Column, ts: str = "bar_ts") -> DataFrame:
    """Candidate events that pass a state filter, with an id and their year, quarter and month."""
    rows = rows.where(true(keep)).withColumn("event_id", F.concat_ws("_", "symbol", F.date_format(ts, "yyyyMMddHH"), "candidate", "side"))
    quarter = F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))
    return rows.withColumns({"year": F.year(ts), "quarter": quarter, "month": F.date_format(ts, "yyyy-MM")})


def gate_table(rows: DataFrame, prototypes: dict[str, Column], ranks: list[str], gates: dict[str, tuple[int, int]], cut: float) -> DataFrame:
    """One row per event and prototype that it belongs to and gate: accepted if at least k of the first n rank shares
    reach the cut."""
    rows = patterns.masks(rows, prototypes)
    return patterns.gates(rows, [(c, cut, 1) for c in ranks], gates)


def path_touches(events: DataFrame, fine: DataFrame, seconds: list[int], share: float, bucket_seconds: int) -> DataFrame:
    """Per event(event_id, symbol, signal_time, close) and horizon: which of close * (1 +- share) the finer path(symbol, ts, high, low)
    reaches first: plus, minus, ambiguous (at one time) or none, and whether each was reached. One join at the longest
    horizon finds the two first times, from which every horizon's outcome follows."""
    spans = events.withColumn("__from", F.expr("signal_time + interval 1 microsecond")).withColumn("__to", F.expr(f"timestampadd(SECOND, {max(seconds)}, signal_time)"))
    path = asof.interval_join(spans, fine, "__from", "__to", "ts", bucket_seconds, ["high", "low"])
    up, down = F.col("high") >= F.col("close") * (1 + share), F.col("low") <= F.col("close") * (1 - share)
    first = path.groupBy("event_id").agg(F.min(F.when(up, F.col("path_ts"))).alias("u"), F.min(F.when(down, F.col("path_ts"))).alias("d"))
    rows = events.join(first, "event_id", "left").withColumn("horizon_s", F.explode(F.array(*map(F.lit, seconds))))
    end = F.expr("timestampadd(SECOND, horizon_s, signal_time)")
    rows = rows.withColumn("up_hit", F.coalesce(F.col("u") <= end, F.lit(False))).withColumn("down_hit", F.coalesce(F.col("d") <= end, F.lit(False)))
    both = F.when(F.col("u") < F.col("d"), "plus").when(F.col("d") < F.col("u"), "minus").otherwise("ambiguous")
    touch = F.when(F.col("up_hit") & F.col("down_hit"), both).when(F.col("up_hit"), "plus").when(F.col("down_hit"), "minus").otherwise("none")
    return rows.select("event_id", "horizon_s", touch.alias("touch"), "up_hit", "down_hit")


def compare_paths(trades: DataFrame, fine: DataFrame, coarse: DataFrame, bucket_seconds: int) -> DataFrame:
    """Per trade(event_id, symbol, entry_time, exit_time): the highest high of a finer and of a coarser path(symbol, ts, high) while it
    was held, and what the coarser one shows beyond the finer."""

    def highest(path: DataFrame, name: str) -> DataFrame:
        rows = asof.interval_join(trades, path, "entry_time", "exit_time", "ts", bucket_seconds, ["high"])
        return rows.groupBy("event_id").agg(F.max("high").alias(name))

    rows = trades.join(highest(fine, "fine_high"), "event_id", "left").join(highest(coarse, "coarse_high"), "event_id", "left")
    return rows.withColumn("gap", F.col("coarse_high") / F.nullif(F.col("fine_high"), F.lit(0.0)) - 1)


def fast_signals(rows: DataFrame, low: float = 55, high: float = 90, volume: float = 2.0, ts: str = "bar_ts") -> DataFrame:
    """Rows whose close tops the bar before, with that many times the mean volume and an RSI within bounds."""
    rows = rows.withColumn("__before", F.lag("high").over(series(ts)))
    hit = (F.col("close") > F.col("__before")) & (F.col("volume_vs_mean") >= volume) & F.col("rsi").between(low, high)
    return rows.where(true(hit)).drop("__before")


def hikkake_tracker(rows: DataFrame, valid: str, within: int = 3, ts: str = "bar_ts") -> DataFrame:
    """Setups of hikkake() while the column valid holds, each with the first of the next `within` bars whose high tops the inside
    bar's: symbol, setup_time, confirm_time and outcome (confirmed; invalid if valid ends first; expired)."""
    w = series(ts)
    rows = rows.withColumn("__level", F.lag("high").over(w))
    steps = []
    for k in range(1, within + 1):
        ok, top = true(F.lead(valid, k).over(w)), F.lead("high", k).over(w)
        steps.append(F.when(~ok, F.struct(F.lit(k).alias("k"), F.lit("invalid").alias("o"))).when(top > F.col("__level"), F.struct(F.lit(k).alias("k"), F.lit("confirmed").alias("o"))))
    rows = rows.withColumn("__x", F.coalesce(*steps)).withColumns({f"__t{k}": F.lead(ts, k).over(w) for k in range(1, within + 1)})
    rows = rows.where(F.col("hikkake_setup") & true(F.col(valid)))
    at = reduce(lambda a, k: a.when(F.col("__x.k") == k, F.col(f"__t{k}")), range(1, within + 1), F)
    return rows.select("symbol", F.col(ts).alias("setup_time"), F.when(F.col("__x.o") == "confirmed", at.otherwise(None)).alias("confirm_time"), F.coalesce("__x.o", F.lit("expired")).alias("outcome"))


def pullback_entries(rows: DataFrame, state: str, low: int = 2, high: int = 8, ts: str = "bar_ts") -> DataFrame:
    """The first bar of each run of a set_reset() state at an age of low..high bars that engulfs the bar before upwards in an upward
    trend, after a lower low since the run began."""
    w = series(ts)
    rows = rows.withColumns({"__engulfs": patterns.bullish_engulfing(ts), "__lower": F.when(F.col(f"{state}_age") >= 1, (F.col("low") < F.lag("low").over(w)).cast("int")).otherwise(0)})
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__run", F.sum(F.col(f"{state}_first").cast("int")).over(before)).where(F.col(state) == 1)
    inside = Window.partitionBy("symbol", "__run").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__pulled", F.max("__lower").over(inside) == 1)
    hit = F.col(f"{state}_age").between(low, high) & F.col("__pulled") & F.col("__engulfs") & (F.col("ema_fast") > F.col("ema_slow"))
    return rows.where(true(hit)).groupBy("symbol", "__run").agg(F.min(ts).alias("entry_time"), F.min_by("close", ts).alias("entry_price"), F.min_by(f"{state}_age", ts).alias("age")).drop("__run")


def early_failures(rows: DataFrame, conditions: dict[str, Column], failed: Column) -> DataFrame:
    """Per condition and side (and ALL): rows that meet it and their share of failures, against the share among the others."""
    long = rows.withColumn("__failed", failed.cast("double")).withColumn("__side", F.explode(F.array(F.lit("ALL"), F.col("side"))))
    met = F.array(*[F.struct(F.lit(n).alias("condition"), true(c).alias("met")) for n, c in conditions.items()])
    long = long.select("__side", "__failed", F.inline(met))
    rate = lambda m: F.avg(F.when(F.col("met") == m, F.col("__failed")))
    return long.groupBy("condition", F.col("__side").alias("direction")).agg(F.count_if("met").alias("n"), rate(True).alias("fail_rate"), rate(False).alias("other_rate"))


def touches_in_r(rows: DataFrame, multiples: list[tuple[float, float]], h: int, ts: str = "bar_ts") -> DataFrame:
    """Per row(side, close, risk) and (target, stop) in units of risk: what the next h bars reach first as the side sees it: target, stop, none
    or ambiguous (one bar reaches both), and after how many bars."""
    w = labels.forward(ts, h)
    rows = rows.withColumn("__path", F.collect_list(F.struct("high", "low")).over(w))
    sign = F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)
    options = F.array(*[F.struct(F.lit(float(a)).alias("target_r"), F.lit(float(b)).alias("stop_r")) for a, b in multiples])
    rows = rows.withColumn("__sign", sign).select("*", F.inline(options))
    reach = lambda x: (
        F.when(F.col("__sign") > 0, x["high"] - F.col("close")).otherwise(F.col("close") - x["low"]) / F.col("risk"),
        F.when(F.col("__sign") > 0, F.col("close") - x["low"]).otherwise(x["high"] - F.col("close")) / F.col("risk"),
    )

    def outcome(x: Column, i: Column) -> Column:
        gain, loss = reach(x)
        hit, lost = gain >= F.col("target_r"), loss >= F.col("stop_r")
        kind = F.when(hit & lost, "ambiguous").when(hit, "target").when(lost, "stop")
        return F.when(kind.isNotNull(), F.struct((i + 1).alias("bars"), kind.alias("outcome")))

    first = F.get(F.array_compact(F.transform("__path", outcome)), 0)
    rows = rows.withColumn("__x", first)
    return rows.withColumn("outcome", F.coalesce("__x.outcome", F.lit("none"))).withColumn("bars", F.col("__x.bars")).drop("__path", "__x", "__sign")
