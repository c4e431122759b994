"""The breakout event machine's step, shared by the batch operator, the stream and the tests."""

from __future__ import annotations

from typing import NamedTuple


class BreakoutState(NamedTuple):
    number: int = 0
    open: bool = False
    age: int = 0
    last_low: float | None = None
    pulled_back: bool = False


def step(state: BreakoutState, breakout: bool, exit_signal: bool, low: float, open_: float, close: float, max_age: int = 8) -> tuple[BreakoutState, str]:
    """The state after one bar and the bar's label: none, opened, open, entered, invalid or expired."""
    if not state.open:
        if breakout and not exit_signal:
            return BreakoutState(state.number + 1, True, 0, low, False), "opened"
        return state._replace(age=0), "none"
    age = state.age + 1
    if exit_signal:
        return BreakoutState(state.number, False, age), "invalid"
    if age > max_age:
        return BreakoutState(state.number, False, age), "expired"
    if age >= 2 and state.pulled_back and close > open_:
        return BreakoutState(state.number, False, age), "entered"
    lower = state.last_low is not None and low < state.last_low
    return BreakoutState(state.number, True, age, low, state.pulled_back or lower), "open"
