"""Metrics of trades, curves and events: conditional aggregates over run keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(gain: Column, loss: Column, empty: str) -> Column:
    """gain / |loss|; without losses: inf if there are gains (0 or null otherwise), or the loss counts as 1."""
    if empty == "one":
        return gain / F.when(loss < 0, -loss).otherwise(1.0)
    none = F.when(gain > 0, F.lit(float("inf"))).otherwise(F.lit(None).cast("double") if empty == "null" else F.lit(0.0))
    return F.when(loss < 0, gain / -loss).otherwise(none)


def profit_factor(pnl: str | Column, variant: str = "a") -> Column:
    """Gains over losses. Variants: a, c (no losses: inf or 0), b (no losses: inf or null), d (a missing loss counts
    as 1)."""
    value = F.col(pnl) if isinstance(pnl, str) else pnl
    gain = F.coalesce(F.sum(F.when(value > 0, value)), F.lit(0.0))
    loss = F.coalesce(F.sum(F.when(value < 0, value)), F.lit(0.0))
    return _ratio(gain, loss, {"a": "zero", "b": "null", "c": "zero", "d": "one"}[variant])


def geometric_mean(ret: str) -> Column:
    return F.exp(F.avg(F.when(F.col(ret) > -1, F.log1p(F.col(ret))))) - 1


def annualised(total: Column, days: Column) -> Column:
    """Yearly growth of a total return over days; -1 if all is lost."""
    return F.when(total <= -1, -1.0).when(days > 0, F.pow(1 + total, 365.25 / days) - 1)


def trade_summary(trades: DataFrame, keys: list[str], start: float, variant: str = "a") -> DataFrame:
    """Counts, sums, rates and averages of net_pnl per run."""
    p = F.col("net_pnl")
    rows = trades.groupBy(*keys).agg(
        F.count("*").alias("n_trades"),
        F.count_if(p > 0).alias("n_wins"),
        F.count_if(p <= 0).alias("n_losses"),
        F.sum(p).alias("net"),
        F.sum(F.when(p > 0, p).otherwise(0.0)).alias("gains"),
        F.sum(F.when(p < 0, p).otherwise(0.0)).alias("losses"),
        F.avg(p).alias("avg_trade"),
        F.avg(F.when(p > 0, p)).alias("avg_win"),
        F.avg(F.when(p <= 0, p)).alias("avg_loss"),
        F.max(p).alias("best"),
        F.min(p).alias("worst"),
        F.percentile(p, F.lit(0.5)).alias("median_trade"),
        profit_factor("net_pnl", variant).alias("profit_factor"),
        geometric_mean("ret").alias("geo_mean"),
        F.min("entry_time").alias("first_entry"),
        F.max("exit_time").alias("last_exit"),
    )
    rows = rows.withColumn("win_rate", F.col("n_wins") / F.col("n_trades")).withColumn("payoff", F.col("avg_win") / F.nullif(-F.col("avg_loss"), F.lit(0.0)))
    rows = rows.withColumn("total_return", F.col("net") / start).withColumn("days", F.expr("timestampdiff(SECOND, first_entry, last_exit)") / 86400.0)
    return rows.withColumn("annual_return", annualised(F.col("total_return"), F.col("days"))).drop("first_entry", "last_exit")


def drawdowns(curve: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each row's fall below the running peak, from 0 down."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("drawdown", F.col(value) / F.nullif(F.max(value).over(w), F.lit(0.0)) - 1)


def max_drawdown(curve: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    rows = drawdowns(curve, keys, order, value).groupBy(*keys)
    return rows.agg(F.min("drawdown").alias("max_drawdown"), F.min_by(order[0], F.struct("drawdown", *order)).alias("trough_time"))


def concentration(trades: DataFrame, keys: list[str], pnl: str, tie: str, tops: list[int], base: str = "net") -> DataFrame:
    """Share of the best n trades in the net sum (net; null if not positive), or in the positive sum (positive)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(pnl), tie)
    rows = trades.withColumn("__rn", F.row_number().over(w))
    total = F.sum(pnl) if base == "net" else F.sum(F.when(F.col(pnl) > 0, F.col(pnl)))
    best = [(F.sum(F.when((F.col("__rn") <= n) & (F.col(pnl) > 0), F.col(pnl)).otherwise(0.0)) / F.when(total > 0, total)).alias(f"top_{n}_share") for n in tops]
    return rows.groupBy(*keys).agg(*best)


def period_summary(trades: DataFrame, keys: list[str], period: Column, order: list[str], start: float, least: int = 5) -> DataFrame:
    """Per run and period: trades, result, profit factor, drawdown inside the period from the starting balance, status."""
    rows = trades.withColumn("period", period)
    run = [*keys, "period"]
    w = Window.partitionBy(*run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__eq", start + F.sum("net_pnl").over(w))
    rows = rows.withColumn("__dd", F.col("__eq") / F.greatest(F.lit(float(start)), F.max("__eq").over(w)) - 1)
    out = rows.groupBy(*run).agg(
        F.count("*").alias("n_trades"),
        F.sum("net_pnl").alias("net"),
        (F.sum("net_pnl") / start).alias("period_return"),
        profit_factor("net_pnl", "b").alias("profit_factor"),
        F.avg((F.col("net_pnl") > 0).cast("double")).alias("win_rate"),
        F.least(F.min("__dd"), F.lit(0.0)).alias("max_drawdown"),
    )
    return out.withColumn("status", F.when(F.col("n_trades") < least, "insufficient_sample").otherwise("ok"))


def quintile_summary(rows: DataFrame, keys: list[str], quantile: str, horizon: int | None = None) -> DataFrame:
    """Per key and quintile: count and label statistics, of one horizon's columns or of the long form's."""
    ret, mfe, mae = (f"fwd_{x}" if horizon is None else f"fwd_{x}_{horizon}" for x in ("ret", "mfe", "mae"))
    return rows.where(F.col(quantile).isNotNull() & F.col(ret).isNotNull()).groupBy(*keys, quantile).agg(
        F.count("*").alias("n"),
        F.avg(ret).alias("mean_ret"),
        F.percentile(ret, F.lit(0.5)).alias("median_ret"),
        F.avg(mfe).alias("mean_mfe"),
        F.avg(mae).alias("mean_mae"),
        F.avg((F.col(ret) > 0).cast("double")).alias("positive_rate"),
        (F.avg(mfe) / F.nullif(-F.avg(mae), F.lit(0.0))).alias("mfe_mae"),
    )


def grouped_summary(rows: DataFrame, sets: list[list[str]], value: str) -> DataFrame:
    """Count, mean, median, rate and profit factor over several grouping sets in one pass; a column outside a row's set
    is null there, and `grouping` names the set."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    names = [",".join(s) or "all" for s in sets]
    keyed = F.explode(
        F.array(*[F.struct(F.lit(n).alias("grouping"), *[(F.col(c).cast("string") if c in s else F.lit(None).cast("string")).alias(c) for c in columns]) for n, s in zip(names, sets, strict=True)])
    )
    long = rows.select(F.col(value).alias("__v"), keyed.alias("__k")).select("__v", "__k.*")
    return long.groupBy("grouping", *columns).agg(
        F.count("__v").alias("n"),
        F.avg("__v").alias("mean"),
        F.percentile("__v", F.lit(0.5)).alias("median"),
        F.avg((F.col("__v") > 0).cast("double")).alias("positive_rate"),
        profit_factor("__v", "b").alias("profit_factor"),
    )


def holding_buckets(trades: DataFrame, keys: list[str], edges_hours: list[float]) -> DataFrame:
    """Per run and left-closed holding-time bucket: trades and result, and all counts as one JSON object."""
    hours = F.expr("timestampdiff(SECOND, entry_time, exit_time)") / 3600.0
    out = F
    for a, b in zip(edges_hours, edges_hours[1:], strict=False):
        out = out.when((F.col("__h") >= a) & (F.col("__h") < b), f"[{a:g},{b:g})")
    rows = trades.withColumn("__h", hours).withColumn("bucket", out.otherwise(f"[{edges_hours[-1]:g},)"))
    rows = rows.groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.sum("net_pnl").alias("net"), F.avg("net_pnl").alias("mean"))
    both = F.map_from_entries(F.sort_array(F.collect_list(F.struct("bucket", "n")).over(Window.partitionBy(*keys))))
    return rows.withColumn("counts", F.to_json(both))


def exit_reasons(trades: DataFrame, keys: list[str]) -> DataFrame:
    seconds = F.expr("timestampdiff(SECOND, entry_time, exit_time)")
    return trades.groupBy(*keys, "exit_reason").agg(
        F.count("*").alias("n"),
        F.sum("net_pnl").alias("net"),
        F.avg("net_pnl").alias("mean"),
        F.avg((F.col("net_pnl") > 0).cast("double")).alias("win_rate"),
        F.avg(seconds / 3600.0).alias("mean_hours"),
    )


def metric_table(summary: DataFrame, run: str, runs: list[str], metrics: list[str]) -> DataFrame:
    """Metrics as rows, runs as columns."""
    long = summary.select(run, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([run], metrics, "metric", "value")
    return long.groupBy("metric").pivot(run, runs).agg(F.first("value"))


def monthly_correlation(rows: DataFrame, month: str, x: str, y: str, least: int) -> DataFrame:
    out = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(month).agg(F.count("*").alias("n"), F.corr(x, y).alias("corr"))
    return out.where(F.col("n") >= least)


def mix(rows: DataFrame, keys: list[str], column: str, top: int = 3) -> DataFrame:
    """Per key: distinct values, the most frequent one, and the top shares as text."""
    counts = rows.groupBy(*keys, column).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), column))
    counts = counts.withColumn("share", F.col("n") / total).withColumn("rn", rank)
    text = F.when(F.col("rn") <= top, F.struct("rn", F.concat(F.col(column).cast("string"), F.lit(":"), F.format_number("share", 3)).alias("t")))
    out = counts.groupBy(*keys).agg(F.count("*").alias("n_distinct"), F.min_by(column, "rn").alias("dominant"), F.sort_array(F.collect_list(text)).alias("x"))
    return out.select(*keys, "n_distinct", "dominant", F.array_join(F.transform("x", lambda v: v["t"]), ",").alias("mix"))


def positive_rate(rows: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """Share of a key's periods whose sum is positive, and the worst period."""
    sums = rows.groupBy(*keys, period).agg(F.sum(value).alias("s"))
    return sums.groupBy(*keys).agg(
        F.count("*").alias("n_periods"), F.avg((F.col("s") > 0).cast("double")).alias("positive_rate"), F.min("s").alias("worst"), F.min_by(period, F.struct("s", period)).alias("worst_period")
    )


def buy_and_hold(bars: DataFrame, ts: str = "bar_ts") -> DataFrame:
    rows = bars.groupBy("symbol").agg(F.min_by("open", ts).alias("first_open"), F.max_by("close", ts).alias("last_close"))
    return rows.withColumn("buy_and_hold", F.col("last_close") / F.nullif(F.col("first_open"), F.lit(0.0)) - 1)


def peak_to_trough(curve: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each run's highest point, the lowest point after it, and the trades between."""
    top = curve.groupBy(*keys).agg(F.max(F.struct(F.col(value).alias("v"), *order)).alias("t")).select(*keys, F.col("t.v").alias("peak"), F.col(f"t.{order[0]}").alias("peak_time"))
    rows = curve.join(top, keys).where(F.col(order[0]) >= F.col("peak_time"))
    low = rows.groupBy(*keys).agg(F.first("peak").alias("peak"), F.first("peak_time").alias("peak_time"), F.min(F.struct(F.col(value).alias("v"), *order)).alias("b"), F.count("*").alias("n_rows"))
    return low.select(*keys, "peak", "peak_time", F.col("b.v").alias("trough"), F.col(f"b.{order[0]}").alias("trough_time"), "n_rows").withColumn("fall", F.col("trough") / F.nullif(F.col("peak"), F.lit(0.0)) - 1)


def feature_by_outcome(rows: DataFrame, keys: list[str], features: list[str], pnl: str) -> DataFrame:
    """Mean and median of each feature, by win and loss."""
    outcome = F.when(F.col(pnl) > 0, "win").otherwise("loss")
    long = rows.select(*keys, outcome.alias("outcome"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot([*keys, "outcome"], features, "feature", "value")
    return long.groupBy(*keys, "outcome", "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"))


def crosstab(rows: DataFrame, a: str, b: str, values: list) -> DataFrame:
    return rows.groupBy(a).pivot(b, values).agg(F.count(F.lit(1))).na.fill(0)


def top_rows(rows: DataFrame, keys: list[str], by: str, tie: str, k: int) -> DataFrame:
    """The k largest and k smallest rows of each key."""
    hi, lo = Window.partitionBy(*keys).orderBy(F.desc(by), tie), Window.partitionBy(*keys).orderBy(by, tie)
    out = rows.withColumn("rank_top", F.row_number().over(hi)).withColumn("rank_bottom", F.row_number().over(lo))
    return out.where((F.col("rank_top") <= k) | (F.col("rank_bottom") <= k))


def event_summary(rows: DataFrame, keys: list[str], ret: str, within: list[str], flags: dict[str, Column] | None = None) -> DataFrame:
    """Per group of events: their number, those with a return, mean return, positive rate, profit factor, the group's share of the summed
    returns of all groups with equal `within` columns (null where that sum is 0), and the rate of each flag."""
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n_events"),
        F.count(ret).alias("n_valid"),
        F.avg(ret).alias("mean_ret"),
        F.avg((F.col(ret) > 0).cast("double")).alias("positive_rate"),
        profit_factor(ret).alias("profit_factor"),
        F.sum(ret).alias("__sum"),
        *[F.avg(F.coalesce(flag, F.lit(False)).cast("double")).alias(name) for name, flag in (flags or {}).items()],
    )
    # one row a group
    whole = F.sum("__sum").over(Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0)))
    return found.withColumn("contribution", F.col("__sum") / F.nullif(whole, F.lit(0.0))).drop("__sum")
