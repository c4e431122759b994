"""State machines over streams, keyed by symbol, whose rows are taken in event-time order whatever order they arrive in.

A row waits in list state until the watermark has passed it; an event-time timer then takes all rows that are due, sorted, through a
pure step function, so a drained stream gives what the batch operator gives. What a machine is has in value state, so a query
restarts from its checkpoint. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine(NamedTuple):
    """A state machine: its first state, a step (state, row) -> (state, output rows), and, for what is to end without a further row,
    deadline(state) in microseconds (None: none) and expire(state, now) -> (state, output rows). Rows are dicts with `ts`
    in microseconds; states are named tuples of what JSON has."""

    start: Any
    step: Any
    deadline: Any = None
    expire: Any = None


class InOrder(StatefulProcessor):
    """Runs a machine over each key's rows in the order of (ts, tie)."""

    def __init__(self, machine: Machine, columns: list[str], key: str, tie: str | None, out: T.StructType):
        self.machine, self.columns, self.key, self.tie, self.out = machine, columns, key, tie, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts bigint, row string")
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = []
        for part in rows:
            values = zip(*(part[c].tolist() for c in self.columns), strict=True)
            found += [(ts, json.dumps(dict(zip(self.columns, v, strict=True)))) for ts, v in zip(part["event_micros"].tolist(), values, strict=True)]
        if found:
            self.waiting.appendList(found)
            self._wake(min(ts for ts, _ in found))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        state = self.machine.start
        if self.state.exists():
            state = type(state)(*json.loads(self.state.get()[0]))
        waiting = list(self.waiting.get())
        due, rest = [r for r in waiting if r[0] <= now], [tuple(r) for r in waiting if r[0] > now]
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self._wake(min(ts for ts, _ in rest))
        out = []
        rows = [json.loads(row) | {"ts": ts} for ts, row in due]
        for row in sorted(rows, key=lambda r: (r["ts"], r[self.tie] if self.tie else 0)):
            state, made = self.machine.step(state, row)
            out += made
        # a row that waits may still come before a deadline, so only what lies behind the watermark ends
        if self.machine.deadline:
            until = self.machine.deadline(state)
            if until is not None and until <= now:
                state, made = self.machine.expire(state, now)
                out += made
                until = self.machine.deadline(state)
            if until is not None:
                self._wake(until)
        self.state.update((json.dumps(state),))
        if out:
            yield self._frame(key[0], out)

    def _wake(self, ts: int) -> None:
        self.handle.registerTimer(-(-ts // 1000))

    def _frame(self, key: Any, rows: list[tuple]) -> pd.DataFrame:
        names = self.out.names
        columns = dict(zip([n for n in names if n != self.key], map(list, zip(*rows, strict=True)), strict=True)) | {self.key: [key] * len(rows)}
        frame = pd.DataFrame({n: pd.Series(columns[n], dtype=object) for n in names})
        for field in self.out:
            if isinstance(field.dataType, T.TimestampType):
                frame[field.name] = pd.to_datetime(frame[field.name].astype("Int64"), unit="us")
            elif isinstance(field.dataType, T.IntegralType):
                frame[field.name] = frame[field.name].astype("Int64")
        return frame

    def close(self) -> None:
        pass


def run(stream: DataFrame, machine: Machine, columns: list[str], out: str, late: str, ts: str = "bar_ts", key: str = "symbol", tie: str | None = None) -> DataFrame:
    """The machine's output rows (schema `out`, which has the key) over a stream with a timestamp column."""
    provider = stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass")
    if not provider.endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    schema = T.StructType.fromDDL(out)
    rows = stream.withWatermark(ts, late).withColumn("event_micros", F.unix_micros(ts))
    rows = rows.select(key, ts, "event_micros", *[c for c in columns if c not in (key, ts)])
    return rows.groupBy(key).transformWithStateInPandas(InOrder(machine, [c for c in columns if c != ts], key, tie, schema), schema, "Append", "EventTime")


# --------------------------------------------------------------------------- hikkake setups


class Hikkake(NamedTuple):
    before: tuple = ()  # (high, low, inside) of the last two bars, the last one first
    open: tuple = ()  # setups that wait: (setup_time, level, bars since, deadline)


def hikkake_machine(within: int = 3, patience: int = 86_400_000_000) -> Machine:
    """Setups while a bar is valid: invalid when valid ends, confirmed by a high above the inside bar's within that many bars, else
    expired; also when no bar has come for `patience` microseconds."""

    def step(state: Hikkake, bar: dict) -> tuple[Hikkake, list]:
        out, still = [], []
        for setup, level, n, _ in state.open:
            if not bar["valid"]:
                out.append((setup, None, "invalid"))
            elif bar["high"] > level:
                out.append((setup, bar["ts"], "confirmed"))
            elif n + 1 == within:
                out.append((setup, None, "expired"))
            else:
                still.append((setup, level, n + 1, bar["ts"] + patience))
        below = lambda high: bool(state.before) and bar["high"] < state.before[0][0] and high
        inside = below(bool(state.before) and bar["low"] > state.before[0][1])
        setup = below(bool(state.before) and bar["low"] < state.before[0][1] and state.before[0][2])
        if setup and bar["valid"]:
            still.append((bar["ts"], state.before[0][0], 0, bar["ts"] + patience))
        return Hikkake(((bar["high"], bar["low"], inside),), tuple(still)), out

    def deadline(state: Hikkake) -> int | None:
        return min((s[3] for s in state.open), default=None)

    def expire(state: Hikkake, now: int) -> tuple[Hikkake, list]:
        gone = [s for s in state.open if s[3] <= now]
        return state._replace(open=tuple(s for s in state.open if s[3] > now)), [(s[0], None, "expired") for s in gone]

    return Machine(Hikkake(), step, deadline, expire)


def hikkake_stream(bars: DataFrame, late: str, within: int = 3, patience_seconds: int = 86_400) -> DataFrame:
    """symbol, setup_time, confirm_time, outcome over a stream of bars(symbol, bar_ts, high, low, valid), as the batch tracker."""
    machine = hikkake_machine(within, patience_seconds * 1_000_000)
    return run(bars, machine, ["high", "low", "valid"], "symbol string, setup_time timestamp, confirm_time timestamp, outcome string", late)


# --------------------------------------------------------------------------- held state


class Held(NamedTuple):
    active: int = 0
    age: int = 0
    since: int | None = None  # bars since the last exit


def held_machine(edges: tuple[int, int, int] = (4, 16, 64)) -> Machine:
    """Held from a breakout until an exit signal (which wins), and the phase after the exit."""
    a, b, c = edges

    def step(state: Held, bar: dict) -> tuple[Held, list]:
        active = 0 if bar["exit_signal"] else 1 if bar["breakout"] else state.active
        age = state.age + 1 if active and state.active else 0
        since = None if active else 0 if state.active else None if state.since is None else state.since + 1
        if active:
            phase = "held"
        elif since is None or since > c:
            phase = "idle"
        else:
            phase = f"0-{a}" if since <= a else f"{a + 1}-{b}" if since <= b else f"{b + 1}-{c}"
        return Held(active, age, since), [(bar["ts"], active, age if active else None, since, phase)]

    return Machine(Held(), step)


def held_stream(bars: DataFrame, late: str, edges: tuple[int, int, int] = (4, 16, 64)) -> DataFrame:
    """symbol, bar_ts, active, active_age, bars_since_exit, phase over bars(symbol, bar_ts, breakout, exit_signal)."""
    out = "symbol string, bar_ts timestamp, active int, active_age int, bars_since_exit int, phase string"
    return run(bars, held_machine(edges), ["breakout", "exit_signal"], out, late)


# --------------------------------------------------------------------------- pauses


class Pause(NamedTuple):
    last: tuple = ()
    paused: bool = False
    balance: float = 0.0
    peak: float = 0.0


def pause_machine(start: float = 1e6, deepest: float = 0.3) -> Machine:
    """Paused by 4 losses of 5, under a quarter of wins or a negative sum in 10, or that deep a drawdown; resumed by 2 wins of 3."""

    def step(state: Pause, trade: dict) -> tuple[Pause, list]:
        pnl = float(trade["net_pnl"])
        last, balance = (*state.last, pnl)[-10:], state.balance + pnl
        peak = max(state.peak, balance)
        wins = lambda n: sum(v > 0 for v in last[-n:])
        paused = state.paused
        if len(last) >= 3 and wins(3) >= 2:
            paused = False
        elif len(last) >= 5 and 5 - wins(5) >= 4 or len(last) >= 10 and (wins(10) < 2.5 or sum(last) < 0) or balance < (1 - deepest) * peak:
            paused = True
        return Pause(last, paused, balance, peak), [(trade["trade_id"], paused)]

    return Machine(Pause(balance=start, peak=start), step)


def ordered_pause_stream(trades: DataFrame, late: str, start: float = 1e6, deepest: float = 0.3) -> DataFrame:
    """symbol, trade_id, paused over closed trades(symbol, exit_time, trade_id, net_pnl), in the order of (exit_time, trade_id)."""
    return run(trades, pause_machine(start, deepest), ["trade_id", "net_pnl"], "symbol string, trade_id bigint, paused boolean", late, "exit_time", tie="trade_id")
