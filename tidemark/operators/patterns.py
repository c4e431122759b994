"""Pattern predicates, signals, filters and masks over indicator columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.indicators import frame, rolling, series


def true(condition: Column) -> Column:
    """A condition with null as false."""
    return F.coalesce(condition, F.lit(False))


def trend_signals(rows: DataFrame, ts: str = "bar_ts") -> DataFrame:
    """breakout and channel exit flags of base_indicators()."""
    return rows.withColumn("breakout", true((F.col("close") > F.col("upper")) & (F.col("ema_fast") > F.col("ema_slow")))).withColumn(
        "exit_signal", true((F.col("close") < F.col("exit_low")) | (F.col("ema_fast") < F.col("ema_slow")))
    )


def strong_bar(body: float = 0.35, upper: float = 0.30, location: float = 0.70) -> Column:
    shape = (F.col("close") > F.col("open")) & (F.col("body") >= body) & (F.col("upper_wick") <= upper) & (F.col("close_location") >= location)
    return true(shape & (F.col("volume") >= F.col("volume_mean")))


def bullish_engulfing(ts: str = "bar_ts") -> Column:
    o, c = F.lag("open").over(series(ts)), F.lag("close").over(series(ts))
    return true((c < o) & (F.col("close") > F.col("open")) & (F.col("open") <= c) & (F.col("close") >= o))


def bearish_engulfing(ts: str = "bar_ts") -> Column:
    o, c = F.lag("open").over(series(ts)), F.lag("close").over(series(ts))
    return true((c > o) & (F.col("close") < F.col("open")) & (F.col("open") >= c) & (F.col("close") <= o))


def hikkake(rows: DataFrame, within: int = 3, ts: str = "bar_ts") -> DataFrame:
    """inside (strict inside bar), hikkake_setup (the bar after it has a lower high and a lower low) and
    hikkake_confirm (a high above the inside bar's within that many bars after the setup)."""
    w = series(ts)
    rows = rows.withColumn("inside", true((F.col("high") < F.lag("high").over(w)) & (F.col("low") > F.lag("low").over(w))))
    setup = true(F.lag("inside").over(w) & (F.col("high") < F.lag("high").over(w)) & (F.col("low") < F.lag("low").over(w)))
    rows = rows.withColumn("hikkake_setup", setup)
    # the setup k bars back recorded the inside bar's high one bar earlier
    hits = [true(F.lag("hikkake_setup", k).over(w) & (F.col("high") > F.lag("high", k + 1).over(w))) for k in range(1, within + 1)]
    return rows.withColumn("hikkake_confirm", reduce(lambda a, b: a | b, hits))


def candle_events(rows: DataFrame, floor: float = 0.2, ts: str = "bar_ts") -> DataFrame:
    """One row per detected candle: hammer, shooting_star, bullish and bearish engulfing, with a floor on the range
    in ATR."""
    size = F.col("high") - F.col("low")
    big = size >= floor * F.col("atr")
    found = {
        "hammer": true(big & (F.col("lower_wick") >= 0.5) & (F.col("upper_wick") <= 0.2) & (F.col("body") > 0)),
        "shooting_star": true(big & (F.col("upper_wick") >= 0.5) & (F.col("lower_wick") <= 0.2) & (F.col("body") > 0)),
        "bullish_engulfing": bullish_engulfing(ts) & true(big),
        "bearish_engulfing": bearish_engulfing(ts) & true(big),
    }
    rows = rows.withColumns({f"__{n}": c for n, c in found.items()})
    names = F.array_compact(F.array(*[F.when(F.col(f"__{n}"), F.lit(n)) for n in found]))
    return rows.withColumn("pattern", F.explode(names)).drop(*[f"__{n}" for n in found])


def entry_modes(rows: DataFrame, modes: dict[str, Column]) -> DataFrame:
    """One row per bar and entry mode whose predicate holds."""
    names = F.array_compact(F.array(*[F.when(true(c), F.lit(n)) for n, c in modes.items()]))
    return rows.withColumn("entry_mode", F.explode(names))


def location_reasons(rows: DataFrame, near: float = 0.35) -> DataFrame:
    """Levels within `near` ATR of the close, joined by ;."""
    a = F.nullif(F.col("atr"), F.lit(0.0))
    levels = {"ema_fast": "ema_fast", "ema_slow": "ema_slow", "upper": "upper", "exit_low": "exit_low"}
    hits = [F.when(F.abs(F.col("close") - F.col(c)) / a <= near, F.lit(n)) for n, c in levels.items()]
    return rows.withColumn("location", F.concat_ws(";", F.array_compact(F.array(*hits))))


def mean_reversion_candidates(rows: DataFrame, weak: float = 1.0, far: float = 1.0, ts: str = "bar_ts") -> DataFrame:
    """Failed breakouts and deviations in weak trends, long and short, one row each."""
    w = series(ts)
    calm = F.col("trend_strength") <= weak
    found = [
        ("FB", "SHORT", calm & (F.lag("close").over(w) > F.lag("range_upper").over(w)) & (F.col("close") < F.col("range_upper"))),
        ("FB", "LONG", calm & (F.lag("close").over(w) < F.lag("range_lower").over(w)) & (F.col("close") > F.col("range_lower"))),
        ("MR", "SHORT", calm & (F.col("deviation") >= far)),
        ("MR", "LONG", calm & (F.col("deviation") <= -far)),
    ]
    rows = rows.withColumns({f"__{i}": true(c) for i, (_, _, c) in enumerate(found)})
    hits = F.array_compact(F.array(*[F.when(F.col(f"__{i}"), F.struct(F.lit(n).alias("candidate"), F.lit(s).alias("side"))) for i, (n, s, _) in enumerate(found)]))
    rows = rows.withColumn("__x", F.explode(hits)).drop(*[f"__{i}" for i in range(len(found))])
    return rows.withColumn("candidate", F.col("__x.candidate")).withColumn("side", F.col("__x.side")).drop("__x")


def momentum_signal(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """reject_reason: the first failing check (null counts as failing), or null if all pass."""
    out = F
    for name, passed in checks:
        out = out.when(~true(passed), name)
    return rows.withColumn("reject_reason", out.otherwise(None))


def rising_closes(n: int, ts: str = "bar_ts") -> Column:
    """n bullish bars with rising closes; needs columns bullish and rising."""
    return true(rolling(F.bool_and(F.col("bullish") & F.col("rising")), "close", n, ts=ts))


def score_signal(base: float, bonuses: list[tuple[Column, float]]) -> Column:
    """Base score plus bonuses, within 0 and 100."""
    total = F.lit(base)
    for hit, points in bonuses:
        total = total + F.when(true(hit), points).otherwise(0.0)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))


def quality_filter(rows: DataFrame, blacklist: list[str], least_volume: float, most_atr: float) -> DataFrame:
    """reason why a symbol's bar is not traded, or null."""
    reason = F.when(F.col("symbol").isin(blacklist), "blacklist").when(~true(F.col("quote_volume_24h") >= least_volume), "volume")
    return rows.withColumn("reason", reason.when(~true(F.col("atr_pct") <= most_atr), "volatility"))


def enhanced_checks(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """checks: map of name to passed, and all_passed."""
    parts = [x for n, c in checks.items() for x in (F.lit(n), true(c))]
    rows = rows.withColumn("checks", F.create_map(*parts))
    return rows.withColumn("all_passed", F.forall(F.map_values("checks"), lambda x: x))


def masks(rows: DataFrame, named: dict[str, Column], name: str = "prototype") -> DataFrame:
    """Long form: one row per row and mask that holds."""
    return rows.withColumn(name, F.explode(F.array_compact(F.array(*[F.when(true(c), F.lit(n)) for n, c in named.items()]))))


def gates(rows: DataFrame, factors: list[tuple[str, float, int]], needed: dict[str, tuple[int, int]]) -> DataFrame:
    """One row per row and gate: accepted if at least k of the gate's first n factors pass their threshold
    (factor, threshold, direction); gates with n = 0 accept all, a null factor does not pass."""
    passed = F.array(*[true(F.col(f) * d >= t * d).cast("int") for f, t, d in factors])
    options = F.array(*[F.struct(F.lit(g).alias("gate"), F.lit(n).alias("n"), F.lit(k).alias("k")) for g, (n, k) in needed.items()])
    rows = rows.withColumn("__p", passed).withColumn("__g", F.explode(options))
    hits = F.aggregate(F.slice("__p", 1, F.greatest(F.col("__g.n"), F.lit(1))), F.lit(0), lambda a, x: a + x)
    accepted = F.when(F.col("__g.n") == 0, True).otherwise(hits >= F.col("__g.k"))
    return rows.withColumn("gate", F.col("__g.gate")).withColumn("accepted", accepted).drop("__p", "__g")


def ablation(rows: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """Cumulative rule ladder: rule i keeps rows that pass the first i filters, each `column >= its quantile`."""
    cuts = rows.agg(*[F.percentile(c, F.lit(q)).alias(f"__c{i}") for i, (_, c, q) in enumerate(rules)])
    out, kept, steps = rows.join(F.broadcast(cuts)), F.lit(True), []  # one row of thresholds
    for i, (name, c, _) in enumerate(rules):
        kept = kept & true(F.col(c) >= F.col(f"__c{i}"))
        steps.append(F.when(kept, F.lit(name)))
    names = F.array_compact(F.array(F.lit("all"), *steps))
    return out.withColumn("rule", F.explode(names)).drop(*[f"__c{i}" for i in range(len(rules))])


def confirmed_within(flag: str, n: int, ts: str = "bar_ts") -> Column:
    """Whether a flag was set within the last n bars."""
    return true(F.max(F.col(flag).cast("int")).over(frame(n, 0, ts)) == 1)


def cross_up(a: str, b: str, ts: str = "bar_ts") -> Column:
    w = series(ts)
    return true((F.col(a) > F.col(b)) & (F.lag(a).over(w) <= F.lag(b).over(w)))
