"""Structured Streaming forms of the bar, signal and event stages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.bars import first_and_last
from tidemark.operators.machine import BreakoutState, step


def bars(ticks: DataFrame, width: str, late: str) -> DataFrame:
    """Close-labelled bars of a tick stream; ticks later than the watermark are dropped."""
    rows = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
    order = first_and_last(ticks)
    rows = rows.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n_ticks"))
    return rows.select("symbol", F.col("w.end").alias("bar_ts"), "open", "high", "low", "close", "volume", "n_ticks")


def latest_quotes(ticks: DataFrame) -> DataFrame:
    """The last price of each symbol (update mode)."""
    return ticks.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("price", "ts").alias("price"))


def deduplicated(ticks: DataFrame, ident: str, late: str) -> DataFrame:
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark([ident])


def sessions(ticks: DataFrame, gap: str, late: str) -> DataFrame:
    """Runs of ticks of one symbol without a gap."""
    rows = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count("*").alias("n_ticks")).select("symbol", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n_ticks")


def price_alerts(ticks: DataFrame, limits: DataFrame) -> DataFrame:
    """Ticks above their symbol's limit; limits(symbol, limit) is a small static table."""
    return ticks.join(limits, "symbol").where("price > `limit`").select("symbol", "ts", "price", "limit")


_STATE = "number int, open boolean, age int, last_low double, pulled_back boolean"


def breakout_stream(signals: DataFrame, max_age: int = 8) -> DataFrame:
    """The breakout event machine over a stream of bars with breakout and exit_signal flags: symbol, bar_ts, event_no,
    event_state, one row per bar, with the batch operator's step. Bars of a batch are taken in time order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = BreakoutState(*state.get) if state.exists else BreakoutState()
        rows = pd.concat(list(batches)).sort_values("bar_ts")
        out = []
        for bar in zip(rows["breakout"], rows["exit_signal"], rows["low"], rows["open"], rows["close"], strict=True):
            now, label = step(now, *bar, max_age=max_age)
            out.append((now.number, label))
        state.update((now.number, now.open, now.age, now.last_low, now.pulled_back))
        yield pd.DataFrame({"symbol": key[0], "bar_ts": rows["bar_ts"].to_numpy(), "event_no": [n for n, _ in out], "event_state": [s for _, s in out]})

    schema = signals.select("symbol", "bar_ts", F.lit(0).alias("event_no"), F.lit("").alias("event_state")).schema
    return signals.groupBy("symbol").applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.NoTimeout)


def write_ledger(stream: DataFrame, path: str, checkpoint: str):
    """Exactly-once append of a stream to a ledger folder."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def sliding_day(ticks: DataFrame, late: str, length: str = "24 hours", slide: str = "15 minutes") -> DataFrame:
    """Volume, quote volume and change of each symbol over sliding windows."""
    rows = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", length, slide).alias("w"))
    rows = rows.agg(F.sum("volume").alias("volume"), F.sum(F.col("price") * F.col("volume")).alias("quote_volume"), F.min_by("price", "ts").alias("a"), F.max_by("price", "ts").alias("b"))
    return rows.select("symbol", F.col("w.end").alias("ts"), "volume", "quote_volume", (F.col("b") / F.nullif(F.col("a"), F.lit(0.0)) - 1).alias("change"))


def daily_ranking(ticks: DataFrame, late: str, sink):
    """Each closed day's quote volumes, handed to sink(batch, id), which may rank and store them (foreachBatch)."""
    rows = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", "1 day").alias("w")).agg(F.sum(F.col("price") * F.col("volume")).alias("quote_volume"))
    rows = rows.select("symbol", F.col("w.end").alias("day"), "quote_volume")
    return rows.writeStream.outputMode("append").foreachBatch(sink).trigger(availableNow=True)


def pause_stream(trades: DataFrame, start: float = 1e6, deepest: float = 0.3) -> DataFrame:
    """Paused or not after each closed trade(symbol, exit_time, trade_id, net_pnl), by the batch operator's rules: the state of a
    symbol is its last ten results, the flag, its balance and the balance's peak."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, paused, balance, peak = (list(state.get[0]), *state.get[1:]) if state.exists else ([], False, start, start)
        rows = pd.concat(list(batches)).sort_values(["exit_time", "trade_id"])
        flags = []
        for pnl in map(float, rows["net_pnl"]):
            last, balance = [*last, pnl][-10:], balance + pnl
            peak = max(peak, balance)
            losses, wins = (lambda n: sum(v <= 0 for v in last[-n:])), (lambda n: sum(v > 0 for v in last[-n:]))
            if len(last) >= 3 and wins(3) >= 2:
                paused = False
            elif len(last) >= 5 and losses(5) >= 4 or len(last) >= 10 and (wins(10) < 2.5 or sum(last) < 0) or balance < (1 - deepest) * peak:
                paused = True
            flags.append(paused)
        state.update((last, paused, balance, peak))
        yield pd.DataFrame({"symbol": key[0], "trade_id": rows["trade_id"].to_numpy(), "paused": flags})

    schema = trades.select("symbol", "trade_id", F.lit(True).alias("paused")).schema
    return trades.groupBy("symbol").applyInPandasWithState(run, schema, "last array<double>, paused boolean, balance double, peak double", "append", GroupStateTimeout.NoTimeout)
