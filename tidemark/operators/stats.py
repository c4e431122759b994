"""Random baselines, bootstraps, multiple testing, stress of edges.

Every draw is an integer function of (run, position) that SQL can repeat, so results do not depend on partitioning.
Runs are a generated dimension of fixed size; what is drawn from is aggregated to blocks or ranked first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.pieces import null_safe_join, numbered
from tidemark.scratch import discard, written

# Fixed values of the draw: multipliers below a prime under 2^31.
PRIME = 2147483629
RUN_STEP, SLOT_STEP, OFFSET = 48271, 69621, 12345
#: Rows of a bucket of a drawn order, most buckets of an order, and most rows that are broadcast.
BUCKET_ROWS, MOST_BUCKETS, SMALL = 1024, 1024, 200_000


def draw(run: Column, slot: Column, n: Column) -> Column:
    """0 .. n-1, from two rounds of a multiplicative generator."""
    x = F.pmod(run * RUN_STEP + slot * SLOT_STEP + OFFSET, F.lit(PRIME).cast("bigint"))
    x = F.pmod(x * 40692 + run * 7919 + slot, F.lit(PRIME).cast("bigint"))
    return F.pmod(x, n)


def draw_sql(run: str, slot: str, n: str) -> str:
    one = f"(({run})::BIGINT * {RUN_STEP} + ({slot})::BIGINT * {SLOT_STEP} + {OFFSET}) % {PRIME}"
    return f"((({one}) * 40692 + ({run}) * 7919 + ({slot})) % {PRIME}) % ({n})"


def runs(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("run", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))))


def observed_edge(rows: DataFrame, keys: list[str], group: str, value: str, high, low) -> DataFrame:
    """Mean of the value in the high group less that in the low group, and counts."""
    hi, lo = F.when(F.col(group) == high, F.col(value)), F.when(F.col(group) == low, F.col(value))
    return rows.groupBy(*keys).agg(F.count(hi).alias("n_high"), F.count(lo).alias("n_low"), (F.avg(hi) - F.avg(lo)).alias("edge"))


def permutation_edges(rows: DataFrame, keys: list[str], group: str, value: str, ident: str, high, low, n_runs: int) -> DataFrame:
    """Edge of each run when the high and low labels are dealt anew at random among the rows of both groups."""
    pool = rows.where(F.col(group).isin(high, low) & F.col(value).isNotNull())
    pool = pool.withColumn("slot", F.row_number().over(Window.partitionBy(*keys).orderBy(ident)).cast("bigint"))
    pool = pool.withColumn("n_high", F.count(F.when(F.col(group) == high, 1)).over(Window.partitionBy(*keys)))
    dealt = runs(pool.select(*keys, "slot", "n_high", F.col(value).alias("v")), n_runs)
    dealt = dealt.withColumn("r", draw(F.col("run"), F.col("slot"), F.lit(PRIME).cast("bigint")))
    rn = F.row_number().over(Window.partitionBy(*keys, "run").orderBy("r", "slot"))
    dealt = dealt.withColumn("first", rn <= F.col("n_high"))
    return dealt.groupBy(*keys, "run").agg((F.avg(F.when(F.col("first"), F.col("v"))) - F.avg(F.when(~F.col("first"), F.col("v")))).alias("edge"))


def p_values(edges: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the directional share of draws at least as extreme, +1 in both counts, and the observed edge's percentile."""
    rows = edges.withColumnRenamed("edge", "drawn").join(observed, keys)
    extreme = F.when(F.col("edge") >= 0, F.col("drawn") >= F.col("edge")).otherwise(F.col("drawn") <= F.col("edge"))
    return rows.groupBy(*keys).agg(
        F.first("edge").alias("edge"),
        F.count("*").alias("n_runs"),
        ((F.count_if(extreme) + 1) / (F.count("*") + 1)).alias("p_value"),
        (100.0 * F.count_if(F.col("drawn") <= F.col("edge")) / F.count("*")).alias("percentile"),
    )


def benjamini_hochberg(rows: DataFrame, keys: list[str], p: str, tie: str) -> DataFrame:
    """q values: p * m / rank, made monotone from the largest p down, at most 1. Rows are hypotheses, so
    without keys they are one group."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    rank = F.row_number().over(part.orderBy(p, tie))
    rows = rows.withColumn("__q", F.col(p) * F.count(p).over(part) / rank)
    down = part.orderBy(F.desc(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("q_value", F.least(F.lit(1.0), F.min("__q").over(down))).drop("__q")


def bootstrap_means(rows: DataFrame, keys: list[str], value: str, ident: str, n_runs: int) -> DataFrame:
    """Mean of each run's resample, with replacement, of a key's rows."""
    w = Window.partitionBy(*keys)
    base = rows.where(F.col(value).isNotNull()).select(*keys, (F.row_number().over(w.orderBy(ident)) - 1).cast("bigint").alias("slot"), F.count("*").over(w).alias("n"), F.col(value).alias("v"))
    asked = runs(base.select(*keys, "slot", "n"), n_runs)
    asked = asked.select(*keys, "run", draw(F.col("run"), F.col("slot"), F.col("n")).alias("slot"))
    # draws of one row within a run are counted before the join
    asked = asked.groupBy(*keys, "run", "slot").agg(F.count("*").alias("c"))
    return asked.join(base.select(*keys, "slot", "v"), [*keys, "slot"]).groupBy(*keys, "run").agg((F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("mean"))


def block_bootstrap(rows: DataFrame, keys: list[str], block: str, value: str, n_runs: int) -> DataFrame:
    """Mean of each run's resample of whole blocks; blocks are first summed, so a run only draws sums and counts."""
    sums = rows.where(F.col(value).isNotNull()).groupBy(*keys, block).agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    sums = sums.withColumn("slot", (F.row_number().over(w.orderBy(block)) - 1).cast("bigint")).withColumn("n", F.count("*").over(w))
    asked = runs(sums.select(*keys, "slot", "n"), n_runs)
    asked = asked.select(*keys, "run", draw(F.col("run"), F.col("slot"), F.col("n")).alias("slot"))
    drawn = asked.join(sums.select(*keys, "slot", "s", "c"), [*keys, "slot"])
    return drawn.groupBy(*keys, "run").agg((F.sum("s") / F.sum("c")).alias("mean"))


def distribution(edges: DataFrame, keys: list[str], value: str) -> DataFrame:
    q = lambda p: F.percentile(value, F.lit(p))
    return edges.groupBy(*keys).agg(
        F.count("*").alias("n_runs"),
        F.avg(value).alias("mean"),
        q(0.05).alias("p05"),
        q(0.5).alias("p50"),
        q(0.95).alias("p95"),
        F.avg((F.col(value) > 0).cast("double")).alias("positive_rate"),
    )


def matched_baseline(events: DataFrame, pool: DataFrame, keys: list[str], group: list[str], value: str, ident: str, pool_id: str, n_runs: int) -> DataFrame:
    """Per group and run: the mean of one pool row drawn for each event among those with the event's keys. Events that match
    nothing are left out."""
    w = Window.partitionBy(*keys)
    base = pool.where(F.col(value).isNotNull()).select(*keys, (F.row_number().over(w.orderBy(pool_id)) - 1).cast("bigint").alias("slot"), F.col(value).alias("v"))
    sizes = base.groupBy(*keys).agg(F.count("*").alias("n"))
    numbered = events.withColumn("i", F.row_number().over(Window.partitionBy(*group).orderBy(ident)).cast("bigint"))
    asked = runs(numbered.join(sizes, keys).select(*dict.fromkeys([*keys, *group]), "i", "n"), n_runs)
    asked = asked.withColumn("slot", draw(F.col("run"), F.col("i"), F.col("n")))
    asked = asked.groupBy(*dict.fromkeys([*keys, *group]), "run", "slot").agg(F.count("*").alias("c"))
    return asked.join(base, [*keys, "slot"]).groupBy(*group, "run").agg((F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("mean"), F.sum("c").alias("n_drawn"))


def random_direction(rows: DataFrame, keys: list[str], value: str, ident: str, n_runs: int) -> DataFrame:
    """Mean of each run in which every row's sign is drawn."""
    base = rows.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(ident)).cast("bigint"))
    signed = runs(base.select(*keys, "i", F.col(value).alias("v")), n_runs)
    sign = F.when(draw(F.col("run"), F.col("i"), F.lit(2).cast("bigint")) == 1, 1.0).otherwise(-1.0)
    return signed.groupBy(*keys, "run").agg(F.avg(sign * F.col("v")).alias("mean"))


def shuffled_drawdowns(trades: DataFrame, keys: list[str], value: str, ident: str, start: float, n_runs: int) -> DataFrame:
    """Per run: the trades in a drawn order, their final equity and deepest drawdown. ident is a number or a time, start is above 0.

    An order is cut into buckets by the drawn number, and what is shuffled of a bucket are its sums: they give the equity at its start, and
    the sums of its gains and losses bound all drawdowns in it. Only buckets that may hold the deepest one, or the peak before it,
    are put in order: first each run's most suspect one, then those that it doesn't rule out."""
    placed = numbered(trades.select(*keys, F.col(ident).alias("__id"), F.col(value).alias("v")), keys, ["__id"], "i")
    # few bytes, but a row for each run is made of them: all cores take part
    base = written(placed.drop("__id").repartition(2 * trades.sparkSession.sparkContext.defaultParallelism, "i"), "shuffled")
    discard(placed)
    groups = base.groupBy(*keys).agg(F.sum("v").alias("net"), F.least(F.ceil(F.count("*") / BUCKET_ROWS), F.lit(MOST_BUCKETS)).alias("m"))
    groups = written(groups, "groups")
    rows = null_safe_join(base.select(*keys, (F.col("i") + 1).alias("i"), F.coalesce("v", F.lit(0.0)).alias("v")), groups.drop("net"), keys)
    rows = runs(rows, n_runs).withColumn("r", draw(F.col("run"), F.col("i"), F.lit(PRIME).cast("bigint"))).withColumn("bucket", F.expr(f"r * m div {PRIME}"))
    run = [*keys, "run"]

    sums = rows.groupBy(*run, "bucket").agg(F.sum("v").alias("s"), F.sum(F.greatest("v", F.lit(0.0))).alias("up"), F.sum(F.least("v", F.lit(0.0))).alias("down"))
    w = Window.partitionBy(*run).orderBy("bucket")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("first", start + F.coalesce(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    # the peak in a bucket is at least `low` and at most `high`
    sums = sums.withColumn("low", F.greatest(F.lit(float(start)), F.max("first").over(upto))).withColumn("high", F.greatest(F.lit(float(start)), F.max(F.col("first") + F.col("up")).over(upto)))
    least, last = F.col("first") + F.col("down"), F.col("first") + F.col("s")
    sums = sums.withColumn("bound", F.when(least >= 0, least / F.col("high")).otherwise(least / F.col("low")) - 1)
    sums = sums.withColumn("seen", F.when(last >= 0, last / F.greatest(F.col("low"), last)).otherwise(last / F.col("high")) - 1)
    sums = written(sums, "buckets")

    def deepest(sums: DataFrame, target: Column) -> DataFrame:
        """run and dd, the deepest drawdown in the buckets where target holds."""
        marked = sums.withColumn("target", target)
        later = F.min(F.when(F.col("target"), F.col("low"))).over(w.rowsBetween(1, Window.unboundedFollowing))
        wanted = marked.withColumn("later", later).where("target or first + up > later").select(*run, "bucket", "first", "low", "target")
        wanted = written(wanted, "wanted")
        near = F.broadcast(wanted) if wanted.count() <= SMALL else wanted
        # one shuffle serves both windows, whose orders agree
        found = null_safe_join(rows.select(*run, "bucket", "r", "i", "v"), near, [*run, "bucket"]).repartition(*run)
        inside = Window.partitionBy(*run, "bucket").orderBy("r", "i").rowsBetween(Window.unboundedPreceding, 0)
        found = found.withColumn("eq", F.col("first") + F.sum("v").over(inside))
        peak = F.max("eq").over(Window.partitionBy(*run).orderBy("bucket", "r", "i").rowsBetween(Window.unboundedPreceding, 0))
        found = found.withColumn("dd", F.col("eq") / F.greatest("low", peak) - 1).where("target")
        return written(found.groupBy(*run).agg(F.min("dd").alias("dd")), "deepest")

    lowest = F.min_by("bucket", F.struct("bound", "bucket")).over(Window.partitionBy(*run))
    sums = sums.withColumn("lowest", lowest)
    one = deepest(sums, F.col("bucket") == F.col("lowest"))
    best = F.least(F.lit(0.0), F.col("one"), F.min("seen").over(Window.partitionBy(*run)))
    open_ = null_safe_join(sums, one.withColumnRenamed("dd", "one"), run).withColumn("best", best)
    two = deepest(open_, (F.col("bound") <= F.col("best") + 1e-9) & (F.col("bucket") != F.col("lowest")))
    discard(base)
    out = null_safe_join(one, two.withColumnRenamed("dd", "two"), run, "left")
    return null_safe_join(out, groups, keys).select(*run, "net", F.least("dd", "two", F.lit(0.0)).alias("max_drawdown"))


def tail_dependence(rows: DataFrame, keys: list[str], value: str, tie: str, tops: list[int], block: str) -> DataFrame:
    """Sums without the best n rows and without the best block, and a status."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    ranked = rows.withColumn("__rn", F.row_number().over(w))
    out = ranked.groupBy(*keys).agg(F.sum(value).alias("total"), *[F.sum(F.when(F.col("__rn") > n, F.col(value)).otherwise(0.0)).alias(f"without_best_{n}") for n in tops])
    blocks = rows.groupBy(*keys, block).agg(F.sum(value).alias("s")).groupBy(*keys).agg(F.max("s").alias("best_block"))
    out = out.join(blocks, keys).withColumn("without_best_block", F.col("total") - F.col("best_block")).drop("best_block")
    status = F.when(F.col("total") <= 0, "negative").when(F.col(f"without_best_{tops[0]}") <= 0, "one_trade").when(F.col("without_best_block") <= 0, "one_block")
    return out.withColumn("status", status.otherwise("robust"))


def leave_block_out(rows: DataFrame, keys: list[str], block: str, value: str) -> DataFrame:
    """Mean of a key without its best block, without its two best, and with its worst counted twice; from block sums."""
    sums = rows.where(F.col(value).isNotNull()).groupBy(*keys, block).agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("s"), block))
    worst = F.row_number().over(Window.partitionBy(*keys).orderBy("s", block))
    sums = sums.withColumn("hi", best).withColumn("lo", worst)
    mean = lambda w: F.sum(F.col("s") * w) / F.nullif(F.sum(F.col("c") * w), F.lit(0.0))
    without = lambda n: F.when(F.col("hi") > n, 1.0).otherwise(0.0)
    return sums.groupBy(*keys).agg(
        mean(F.lit(1.0)).alias("mean"),
        mean(without(1)).alias("without_best"),
        mean(without(2)).alias("without_two_best"),
        mean(F.when(F.col("lo") == 1, 2.0).otherwise(1.0)).alias("worst_twice"),
    )


def correlations(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pearson, and Spearman as the correlation of average ranks."""
    rows = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    part = Window.partitionBy(*keys)
    rank = lambda c: F.rank().over(part.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2
    rows = rows.withColumn("__a", rank(a)).withColumn("__b", rank(b))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(a, b).alias("pearson"), F.corr("__a", "__b").alias("spearman"))


def failure_lift(rows: DataFrame, keys: list[str], risky: Column, failed: Column) -> DataFrame:
    """Failure rate among risky rows over the base rate."""
    base, own = F.avg(failed.cast("double")), F.avg(F.when(risky, failed.cast("double")))
    return rows.groupBy(*keys).agg(base.alias("base_rate"), own.alias("risky_rate"), (own / F.nullif(base, F.lit(0.0))).alias("lift"))


def edge_metrics(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """For each value: mean in the top 20 % less that in the bottom 20 % (flag columns top20, bottom20), long form."""
    long = rows.select(*keys, "top20", "bottom20", *[F.col(v).cast("double").alias(v) for v in values]).unpivot([*keys, "top20", "bottom20"], values, "metric", "value")
    hi, lo = F.when(F.col("top20"), F.col("value")), F.when(F.col("bottom20"), F.col("value"))
    return long.groupBy(*keys, "metric").agg(F.count(hi).alias("n_top"), F.count(lo).alias("n_bottom"), (F.avg(hi) - F.avg(lo)).alias("edge"))


def matched_sampling(target: DataFrame, pool: DataFrame, bucket: list[str], ident: str, start: str, end: str, n_runs: int, share: float) -> DataFrame:
    """Per run: as many rows of the pool as the target has in each bucket, without two that overlap in time, and what a bucket
    lacks filled from the others. A run draws a share of the pool, takes those that do not overlap in the order of time (a sorted stream
    per run), and keeps each bucket's quota by the draw. run, ident, bucket columns and filled."""
    from tidemark.operators.selection import non_overlapping

    quotas = target.groupBy(*bucket).agg(F.count("*").alias("quota"))
    numbered = pool.withColumn("slot", F.row_number().over(Window.partitionBy(*bucket).orderBy(ident)).cast("bigint"))
    rows = runs(numbered.select(*bucket, ident, start, end, "slot"), n_runs).withColumn("r", draw(F.col("run"), F.col(ident).cast("bigint"), F.lit(PRIME).cast("bigint")))
    kept = non_overlapping(rows.where(F.col("r") < int(share * PRIME)), ["run"], start, end, ident)
    kept = kept.join(quotas, bucket, "left").withColumn("quota", F.coalesce("quota", F.lit(0)))
    kept = kept.withColumn("__rank", F.row_number().over(Window.partitionBy("run", *bucket).orderBy("r", ident))).withColumn("filled", F.col("__rank") > F.col("quota"))
    lack = kept.groupBy("run", *bucket).agg(F.least(F.count("*"), F.first("quota")).alias("held")).groupBy("run").agg(F.sum("held").alias("held"))
    lack = lack.join(F.broadcast(quotas.agg(F.sum("quota").alias("asked")))).select("run", (F.col("asked") - F.col("held")).alias("lack"))  # one row
    rest = kept.join(lack, "run").withColumn("__rest", F.row_number().over(Window.partitionBy("run", "filled").orderBy("r", ident)))
    return rest.where("not filled or __rest <= lack").select("run", ident, *bucket, "filled")


def edge_bootstrap(rows: DataFrame, keys: list[str], group: str, value: str, ident: str, high, low, n_runs: int) -> DataFrame:
    """Edge (mean of the high group less that of the low one) of each run, which resamples the rows within each group."""
    pool = rows.where(F.col(group).isin(high, low))
    means = bootstrap_means(pool, [*keys, group], value, ident, n_runs)
    hi, lo = F.max(F.when(F.col(group) == high, F.col("mean"))), F.max(F.when(F.col(group) == low, F.col("mean")))
    return means.groupBy(*keys, "run").agg((hi - lo).alias("edge"))


def block_edge_bootstrap(rows: DataFrame, keys: list[str], block: str, group: str, value: str, high, low, n_runs: int) -> DataFrame:
    """Edge of each run, which resamples whole blocks: from sums and counts of each group by block."""
    hi, lo = F.col(group) == high, F.col(group) == low
    v = F.col(value)
    sums = rows.where((hi | lo) & v.isNotNull()).groupBy(*keys, block).agg(
        *[F.sum(F.when(g, v).otherwise(0.0)).alias(f"s{i}") for i, g in enumerate((hi, lo))], *[F.count_if(g).alias(f"c{i}") for i, g in enumerate((hi, lo))]
    )
    w = Window.partitionBy(*keys)
    sums = sums.withColumn("slot", (F.row_number().over(w.orderBy(block)) - 1).cast("bigint")).withColumn("n", F.count("*").over(w))
    asked = runs(sums.select(*keys, "slot", "n"), n_runs)
    asked = asked.select(*keys, "run", draw(F.col("run"), F.col("slot"), F.col("n")).alias("slot"))
    drawn = asked.join(sums.select(*keys, "slot", "s0", "s1", "c0", "c1"), [*keys, "slot"])
    mean = lambda i: F.sum(f"s{i}") / F.nullif(F.sum(f"c{i}"), F.lit(0))
    return drawn.groupBy(*keys, "run").agg((mean(0) - mean(1)).alias("edge"))


def pnl_bootstrap(trades: DataFrame, keys: list[str], block: str, pnl: str, start: float, ruin: float, n_runs: int) -> DataFrame:
    """Per key: share of runs that end with a loss and of those whose balance ever falls to `ruin` of the start, and the mean of the
    final balances, when whole blocks of trades are drawn anew in each run. Blocks are reduced to their sum and lowest running sum
    first, so a run's path is that of its blocks."""
    order = Window.partitionBy(*keys, block).orderBy("exit_time", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    blocks = trades.withColumn("__run", F.sum(pnl).over(order)).groupBy(*keys, block).agg(F.sum(pnl).alias("s"), F.min("__run").alias("low"))
    w = Window.partitionBy(*keys)
    blocks = blocks.withColumn("slot", (F.row_number().over(w.orderBy(block)) - 1).cast("bigint")).withColumn("n", F.count("*").over(w))
    asked = runs(blocks.select(*keys, F.col("slot").alias("at"), "n"), n_runs)
    asked = asked.select(*keys, "run", "at", draw(F.col("run"), F.col("at"), F.col("n")).alias("slot"))
    path = Window.partitionBy(*keys, "run").orderBy("at")
    drawn = asked.join(blocks.select(*keys, "slot", "s", "low"), [*keys, "slot"])
    drawn = drawn.withColumn("lowest", start + F.sum("s").over(path.rowsBetween(Window.unboundedPreceding, 0)) - F.col("s") + F.col("low"))
    ends = drawn.groupBy(*keys, "run").agg((start + F.sum("s")).alias("final"), F.min("lowest").alias("lowest"))
    return ends.groupBy(*keys).agg(
        F.count("*").alias("n_runs"), F.avg((F.col("final") < start).cast("double")).alias("loss_rate"), F.avg((F.col("lowest") <= ruin * start).cast("double")).alias("ruin_rate"), F.avg("final").alias("mean_final")
    )


def subsample_test(rows: DataFrame, pool: DataFrame, keys: list[str], value: str, ident: str, n_runs: int) -> DataFrame:
    """Mean of each key's rows against draws of as many rows of its pool without replacement: the share of draws below it."""
    own = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    base = pool.where(F.col(value).isNotNull()).withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(ident)).cast("bigint"))
    dealt = runs(base.select(*keys, "i", F.col(value).alias("v")), n_runs).withColumn("r", draw(F.col("run"), F.col("i"), F.lit(PRIME).cast("bigint")))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "run").orderBy("r", "i"))).join(own, keys)
    draws = dealt.where("rank <= n").groupBy(*keys, "run").agg(F.avg("v").alias("drawn"), F.first("mean").alias("mean"))
    return draws.groupBy(*keys).agg(F.first("mean").alias("mean"), F.avg("drawn").alias("mean_drawn"), F.avg((F.col("drawn") < F.col("mean")).cast("double")).alias("share_below"))


def top_removed_edges(rows: DataFrame, keys: list[str], group: str, value: str, tie: str, high, low, shares: list[float]) -> DataFrame:
    """Edge when the best share of a key's values is left out, for each share (0: none)."""
    known = rows.where(F.col(value).isNotNull())
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), tie)) / F.count("*").over(Window.partitionBy(*keys))
    long = known.withColumn("__p", rank).withColumn("removed", F.explode(F.array(*map(F.lit, map(float, shares))))).where("__p > removed")
    return observed_edge(long, [*keys, "removed"], group, value, high, low)


def reranked_edges(rows: DataFrame, keys: list[str], scenarios: dict[str, Column], factor: str, value: str, tie: str) -> DataFrame:
    """Edge of the factor's top over its bottom fifth in each scenario's subset, ranked anew inside it. scenarios: name to the
    number of times a row counts (0: left out)."""
    times = F.array(*[F.struct(F.lit(n).alias("scenario"), c.cast("int").alias("times")) for n, c in scenarios.items()])
    long = rows.where(F.col(factor).isNotNull() & F.col(value).isNotNull()).withColumn("__s", F.explode(times)).where("__s.times > 0")
    long = long.select("*", F.col("__s.scenario").alias("scenario"), F.explode(F.sequence(F.lit(1), F.col("__s.times"))).alias("__copy"))
    part = Window.partitionBy(*keys, "scenario")
    share = (F.row_number().over(part.orderBy(factor, tie, "__copy")) - 0.5) / F.count("*").over(part)
    fifth = F.when(F.col("__share") > 0.8, 5).when(F.col("__share") <= 0.2, 1)
    return observed_edge(long.withColumn("__share", share).withColumn("__g", fifth), [*keys, "scenario"], "__g", value, 5, 1)


def safety_consistency(rows: DataFrame, labels: dict[str, int], scopes: list[str]) -> DataFrame:
    """Over rows with top20 and bottom20 flags: the edge of each label, turned so that more is safer (sign -1 for liquidations), over
    all rows, and the shares of each scope's groups in which it is positive."""
    cols = [F.struct(F.lit(n).alias("label"), (F.col(n).cast("double") * s).alias("v")) for n, s in labels.items()]
    groups = F.array(F.struct(F.lit("all").alias("scope"), F.lit("all").alias("grp")), *[F.struct(F.lit(s).alias("scope"), F.col(s).cast("string").alias("grp")) for s in scopes])
    long = rows.where("top20 or bottom20").select("top20", "bottom20", F.explode(groups).alias("g"), F.array(*cols).alias("l")).select("top20", "bottom20", "g.scope", "g.grp", F.inline("l").alias("label", "v"))
    hi, lo = F.avg(F.when(F.col("top20"), F.col("v"))), F.avg(F.when(F.col("bottom20"), F.col("v")))
    edges = long.groupBy("label", "scope", "grp").agg((hi - lo).alias("edge"))
    return edges.groupBy("label", "scope").agg(F.count("edge").alias("n_groups"), F.avg((F.col("edge") > 0).cast("double")).alias("positive_share"), F.avg("edge").alias("mean_edge"))
