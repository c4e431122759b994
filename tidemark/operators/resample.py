"""Thousands of resamples without a row for each row and run.

Rows are dealt in blocks of about SIZE by a hash of their id. How many draws of a run fall into each block is drawn first, for all blocks
of a group at once; then each block draws its own rows for all runs inside one task and returns one sum a run. What is
shuffled is a number for each block and run. Draws depend on the seed, the group, the block and the run alone, so a task that
is run again gives the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.pieces import null_safe_join
from tidemark.scratch import written

SIZE, CHUNK = 4096, 250


def _generator(*parts: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "big"))


def _blocks(rows: DataFrame, keys: list[str], value: str, ident: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows with __block, blocks with their sizes); rows without a value are left out."""
    base = rows.where(F.col(value).isNotNull()).select(*keys, F.col(ident).alias("__id"), F.col(value).cast("double").alias("__v"))
    counts = base.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("__blocks"))
    base = written(null_safe_join(base, counts, keys).withColumn("__block", F.pmod(F.xxhash64("__id"), F.col("__blocks"))).drop("__blocks"), "resample")
    return base, base.groupBy(*keys, "__block").agg(F.count("*").alias("__n"))


def _resampled(base: DataFrame, sizes: DataFrame, keys: list[str], n_runs: int, seed: int, shares: Callable, sums: Callable) -> DataFrame:
    """keys, run and __s: for each run the sum over blocks of sums(generator, values, draws). shares(generator, sizes, runs, table) gives
    the draws of each run in each block."""
    chunks = F.explode(F.sequence(F.lit(0), F.lit(-(-n_runs // CHUNK) - 1))).alias("__chunk")
    asked = sizes.select("*", chunks)
    draws_schema = asked.select(*keys, "__block", "__chunk", F.expr("cast(array() as array<bigint>)").alias("__draws")).schema

    def of_key(table: pa.Table) -> tuple:
        return tuple(str(table.column(k)[0].as_py()) for k in keys)

    def deal(table: pa.Table) -> pa.Table:
        table = table.sort_by("__block")
        chunk = table.column("__chunk")[0].as_py()
        runs = min(CHUNK, n_runs - chunk * CHUNK)
        rng = _generator(seed, of_key(table), chunk)
        drawn = shares(rng, table.column("__n").to_numpy(), runs, table)
        columns = [table.column(k) for k in keys] + [table.column("__block"), table.column("__chunk"), pa.array(list(drawn.T), pa.list_(pa.int64()))]
        return pa.Table.from_arrays(columns, draws_schema.names)

    dealt = written(asked.groupBy(*keys, "__chunk").applyInArrow(deal, draws_schema), "draws")
    lists = dealt.groupBy(*keys, "__block").agg(F.sort_array(F.collect_list(F.struct("__chunk", "__draws"))).alias("__chunks"))
    out_schema = base.select(*keys, F.lit(0).cast("bigint").alias("run"), F.lit(0.0).alias("__s")).schema

    def draw(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(left.column("__id").to_numpy(zero_copy_only=False), kind="stable")
        values = left.column("__v").to_numpy()[order]
        out = []
        for part in right.column("__chunks")[0].as_py():
            rng = _generator(seed, of_key(left), left.column("__block")[0].as_py(), part["__chunk"])
            out += [sums(rng, values, n) for n in part["__draws"]]
        columns = [pa.array([left.column(k)[0].as_py()] * len(out), left.schema.field(k).type) for k in keys]
        return pa.Table.from_arrays([*columns, pa.array(np.arange(1, len(out) + 1)), pa.array(out, pa.float64())], out_schema.names)

    by = [*keys, "__block"]
    found = base.groupBy(*by).cogroup(lists.groupBy(*by)).applyInArrow(draw, out_schema)
    return found.groupBy(*keys, "run").agg(F.sum("__s").alias("__s"))


def bootstrap(rows: DataFrame, keys: list[str], value: str, ident: str, n_runs: int = 5000, seed: int = 1, size: int = SIZE) -> DataFrame:
    """keys, run and mean: the mean of as many rows of each key as it has, drawn with replacement, in each of n_runs runs."""
    base, sizes = _blocks(rows, keys, value, ident, size)

    def shares(rng: np.random.Generator, n: np.ndarray, runs: int, table: pa.Table) -> np.ndarray:
        return rng.multinomial(n.sum(), n / n.sum(), runs)

    def sums(rng: np.random.Generator, values: np.ndarray, draws: int) -> float:
        return float(values[rng.integers(0, len(values), draws)].sum())

    found = _resampled(base, sizes, keys, n_runs, seed, shares, sums)
    totals = sizes.groupBy(*keys).agg(F.sum("__n").alias("__n"))
    return null_safe_join(found, totals, keys).select(*keys, "run", (F.col("__s") / F.col("__n")).alias("mean"))


def permutation(rows: DataFrame, keys: list[str], group: str, value: str, ident: str, high, low, n_runs: int = 5000, seed: int = 1, size: int = SIZE) -> DataFrame:
    """keys, run and edge: the mean of the high group less that of the low one when the labels are dealt anew among the rows of both, in
    each of n_runs runs. Keys that lack one of the groups are left out."""
    pool = rows.where(F.col(group).isin(high, low) & F.col(value).isNotNull())
    base, sizes = _blocks(pool, keys, value, ident, size)
    highs = pool.groupBy(*keys).agg(F.count_if(F.col(group) == high).alias("__high"), F.count("*").alias("__all"), F.sum(F.col(value).cast("double")).alias("__total"))
    highs = written(highs.where("__high > 0 and __high < __all"), "groups")
    sizes = null_safe_join(sizes, highs.select(*keys, "__high"), keys)

    def shares(rng: np.random.Generator, n: np.ndarray, runs: int, table: pa.Table) -> np.ndarray:
        # block by block: of what is left, how many of the high labels fall into this block
        left, rest, out = np.full(runs, table.column("__high")[0].as_py(), np.int64), int(n.sum()), []
        for m in n.tolist():
            out.append(rng.hypergeometric(left, rest - left, m) if m < rest else left.copy())
            left, rest = left - out[-1], rest - m
        return np.stack(out, 1)

    def sums(rng: np.random.Generator, values: np.ndarray, draws: int) -> float:
        return float(values[np.argpartition(rng.random(len(values)), draws)[:draws]].sum() if draws < len(values) else values.sum())

    found = _resampled(null_safe_join(base, highs.select(*keys), keys), sizes, keys, n_runs, seed, shares, sums)
    edge = F.col("__s") / F.col("__high") - (F.col("__total") - F.col("__s")) / (F.col("__all") - F.col("__high"))
    return null_safe_join(found, highs, keys).select(*keys, "run", edge.alias("edge"))
