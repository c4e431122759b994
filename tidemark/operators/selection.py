"""Greedy selection of events that do not overlap, by jumps instead of a walk along each run.

Each event knows the next one it admits, so a run is a forest of jumps, and what is kept is the chain that starts at the run's first
event. Events are cut in pieces of SIZE by their order; a task that holds one piece follows the jumps to where they leave
it, and pointer doubling over those exits finds, in as many rounds as the number of pieces has binary digits, where the chain enters
each piece. A run may have any length, and one run may hold all events.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.pieces import null_safe_join, numbered, rows_until
from tidemark.scratch import discard, written

SIZE = 1 << 16


def _exits(table: pa.Table) -> pa.Table:
    """Of each event of a piece the event beyond the piece that its jumps lead to."""
    at, to = (table.column(c).to_numpy() for c in ("__i", "__next"))
    order = np.argsort(at)
    first, out = int(at.min()), to[order].copy()
    for i in range(len(out) - 1, -1, -1):
        if out[i] < first + len(out):
            out[i] = out[out[i] - first]
    return table.take(pa.array(order)).set_column(table.schema.get_field_index("__next"), "__next", pa.array(out))


def _chain(table: pa.Table) -> pa.Table:
    """The events of a piece on the chain from the one at which it enters, none if it doesn't."""
    table = table.take(pa.array(np.argsort(table.column("__i").to_numpy())))
    at, to = (table.column(c).to_numpy() for c in ("__i", "__next"))
    entered = np.flatnonzero(table.column("__entry").to_numpy(zero_copy_only=False))
    kept, i = [], int(entered[0]) if len(entered) else len(at)
    while i < len(at):
        kept.append(i)
        i = int(to[i] - at[0])
    return table.take(pa.array(kept, pa.int64()))


def _entries(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys and __i of the events at which the chains enter their pieces."""
    node = [*keys, "__i"]
    graph = rows.select(*node, "__next", F.floor(F.col("__i") / size).alias("__piece"))
    out = graph.groupBy(*keys, "__piece").applyInArrow(_exits, graph.schema)
    exits = written(out.select(*node, "__next"), "exits")
    starts = exits.select(*keys).distinct().withColumn("__i", F.lit(0).cast("bigint"))
    targets = exits.select(*keys, F.col("__next").alias("__i")).unionByName(starts).distinct()
    jumps = [written(null_safe_join(exits, targets, node), "jumps")]
    # jumps[n] leads over 2 ** n pieces; what leaves the run meets no row and has no jump
    while True:
        last = jumps[-1]
        ahead = last.select(*keys, F.col("__i").alias("__next"), F.col("__next").alias("__far"))
        further = written(null_safe_join(last, ahead, [*keys, "__next"]).select(*node, F.col("__far").alias("__next")), "jumps")
        if further.isEmpty():
            discard(further)
            break
        jumps.append(further)
    found = starts
    for step in reversed(jumps):
        there = null_safe_join(step, found, node).select(*keys, F.col("__next").alias("__i"))
        found = written(found.unionByName(null_safe_join(there, exits.select(*node), node)), "entries")
    discard(exits, *jumps)
    return found


def non_overlapping(events: DataFrame, keys: list[str], start: str, end: str, tie: str, size: int = SIZE) -> DataFrame:
    """Greedy selection per run: an event stays only if it starts after the end of the last one kept. Events are taken by (start, tie);
    (start, tie) should tell a run's events apart. Events without a start come first, of which one alone stays, unless it has no
    end: an event without an end lets the next one start."""
    placed = numbered(events, keys, [start, tie])
    rows = rows_until(placed, placed, keys, end, start, "__next")
    later = F.col("__i") + 1
    rows = rows.withColumn("__next", F.greatest(F.coalesce("__next", later), later))
    if (placed.agg(F.max("__i").alias("m")).first().m or 0) >= size:
        rows = written(rows, "events")
        entry = _entries(rows, keys, size).withColumn("__entry", F.lit(True))
        rows = null_safe_join(rows, entry, [*keys, "__i"], "left").withColumn("__entry", F.coalesce("__entry", F.lit(False)))
    else:  # a run is one piece
        rows = rows.withColumn("__entry", F.col("__i") == 0)
    rows = rows.withColumn("__piece", F.floor(F.col("__i") / size))
    return rows.groupBy(*keys, "__piece").applyInArrow(_chain, rows.schema).select(*[F.col(f"`{c}`") for c in events.columns])
