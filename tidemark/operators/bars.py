"""Bars: resampling of ticks or finer bars, calendars and period keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_and_last(rows: DataFrame, ts: str = "ts", tie: str = "event_id") -> Column:
    """What orders rows for a first and a last price: their time, and at equal times their number, if they have one."""
    return F.struct(ts, tie) if tie in rows.columns else F.col(ts)


def _aggregates(o: str, h: str, low: str, c: str, v: str, ts: Column) -> list[Column]:
    return [
        F.min_by(o, ts).alias("open"),
        F.max(h).alias("high"),
        F.min(low).alias("low"),
        F.max_by(c, ts).alias("close"),
        F.sum(v).alias("volume"),
        F.count("*").alias("n_ticks"),
    ]


def _bar_end(label: str) -> Column:
    if label not in ("open", "close"):
        raise ValueError("label is open or close")
    return F.col("w.start" if label == "open" else "w.end").alias("bar_ts")


def resample_ticks(ticks: DataFrame, width: str, label: str = "close") -> DataFrame:
    """OHLCV bars of ticks(symbol, ts, price, volume), stamped at their start (open) or their end (close)."""
    rows = ticks.groupBy("symbol", F.window("ts", width).alias("w")).agg(*_aggregates("price", "price", "price", "price", "volume", first_and_last(ticks)))
    return rows.select("symbol", _bar_end(label), "open", "high", "low", "close", "volume", "n_ticks")


def resample_bars(bars: DataFrame, width: str, label: str = "close", complete: int | None = None) -> DataFrame:
    """Coarser bars from bars(symbol, ts, open, high, low, close, volume); with `complete`, only those made of exactly
    that many finer bars (a strict resample)."""
    rows = bars.groupBy("symbol", F.window("ts", width).alias("w")).agg(*_aggregates("open", "high", "low", "close", "volume", F.col("ts")))
    if complete is not None:
        rows = rows.where(F.col("n_ticks") == complete)
    return rows.select("symbol", _bar_end(label), "open", "high", "low", "close", "volume", "n_ticks")


def timeframes(ticks: DataFrame, widths: dict[str, int], label: str = "close") -> DataFrame:
    """Bars at several widths, {name: seconds}, from one scan, told apart by the column tf."""
    pairs = F.array(*[F.struct(F.lit(name).alias("tf"), F.lit(sec).cast("bigint").alias("sec")) for name, sec in widths.items()])
    rows = ticks.withColumn("x", F.explode(pairs)).withColumn("tf", F.col("x.tf")).withColumn("sec", F.col("x.sec"))
    start = F.expr("timestampadd(SECOND, cast(floor(timestampdiff(SECOND, timestamp_ntz'1970-01-01', ts) / sec) * sec as bigint), timestamp_ntz'1970-01-01')")
    rows = rows.withColumn("start", start).groupBy("symbol", "tf", "sec", "start").agg(*_aggregates("price", "price", "price", "price", "volume", first_and_last(ticks)))
    stamp = F.col("start") if label == "open" else F.expr("timestampadd(SECOND, sec, start)")
    return rows.select("symbol", "tf", stamp.alias("bar_ts"), "open", "high", "low", "close", "volume", "n_ticks")


def boundary_flags(rows: DataFrame, minutes: int, ts: str = "ts") -> DataFrame:
    """Adds bar_start (floor to the bar) and last_minute (the row lies in the bar's last minute)."""
    start = F.window(ts, f"{minutes} minutes")["start"]
    return rows.withColumn("bar_start", start).withColumn("last_minute", F.pmod(F.minute(ts) + 1, F.lit(minutes)) == 0)


def period_keys(rows: DataFrame, ts: str) -> DataFrame:
    """Adds year, quarter (2024Q1), month (2024-01) and partial_year (the year of the latest row)."""
    last = rows.agg(F.year(F.max(ts)).alias("__last"))
    out = rows.withColumn("year", F.year(ts)).withColumn("quarter", F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string")))
    out = out.withColumn("month", F.date_format(ts, "yyyy-MM"))
    return out.join(F.broadcast(last)).withColumn("partial_year", F.col("year") == F.col("__last")).drop("__last")  # one row


def month_spine(rows: DataFrame, keys: list[str], month: str, values: list[str]) -> DataFrame:
    """One row per key and calendar month between the key's first and last month; missing values are 0."""
    day = lambda c: F.to_date(F.concat(c, F.lit("-01")))
    span = rows.groupBy(*keys).agg(F.min(month).alias("__a"), F.max(month).alias("__b"))
    months = F.explode(F.sequence(day(F.col("__a")), day(F.col("__b")), F.expr("interval 1 month")))
    spine = span.select(*keys, months.alias("__m")).select(*keys, F.date_format("__m", "yyyy-MM").alias(month))
    out = spine.join(rows, [*keys, month], "left")
    return out.select(*keys, month, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def month_end_returns(curve: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Last value of each month and its change on the month before."""
    rows = curve.groupBy(*keys, F.date_format(ts, "yyyy-MM").alias("month")).agg(F.max_by(value, ts).alias(value))
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy("month"))
    return rows.withColumn("ret", F.col(value) / F.nullif(before, F.lit(0.0)) - 1)


def market_phase(rows: DataFrame, year: str, phases: dict[int, str], default: str = "unknown") -> DataFrame:
    out = F.lit(default)
    for y, phase in phases.items():
        out = F.when(F.col(year) == y, phase).otherwise(out)
    return rows.withColumn("phase", out)
