"""Driver tables read as ticks, bars and a trade ledger, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1).cast("bigint").alias("volume"), "event_id"
    )


def bars_of(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    """Close-labelled bars of the ticks."""
    return bars.resample_ticks(ticks(spark, sf_dir), width, label="close")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trade_id")).agg(
        F.count("*").alias("n_lines"),
        F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("gross_pnl"),
        F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("total_fee"),
        F.sum("l_extendedprice").alias("notional"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trade_id"),
        F.col("o_orderpriority").alias("symbol"),
        F.when(F.col("o_orderkey") % 2 == 0, "LONG").otherwise("SHORT").alias("side"),
        F.col("o_orderdate").alias("entry_time"),
        F.col("o_orderstatus").alias("exit_reason"),
    )
    rows = orders.join(lines, "trade_id")
    rows = rows.withColumn("exit_time", F.expr("entry_time + make_dt_interval(cast(n_lines as int))"))
    return rows.withColumn("net_pnl", F.col("gross_pnl") - F.col("total_fee")).withColumn("ret", F.col("net_pnl") / F.nullif(F.col("notional"), F.lit(0.0)))


#: DuckDB: the same inputs as common table expressions.
TICKS = "ticks AS (SELECT event_type AS symbol, ts, value AS price, 1::BIGINT AS volume, event_id FROM events)"


def bars_sql(width: str = "1 hour", name: str = "bars") -> str:
    return f"""{name} AS (
  SELECT symbol, time_bucket(INTERVAL '{width}', ts) + INTERVAL '{width}' AS bar_ts, arg_min(price, ts) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, ts) AS close, sum(volume)::BIGINT AS volume, count(*) AS n_ticks
  FROM ticks GROUP BY ALL)"""


BARS = f"{TICKS}, {bars_sql()}"

TRADES = """lines AS (
  SELECT l_orderkey AS trade_id, count(*) AS n_lines, sum(l_extendedprice * l_discount) AS gross_pnl,
         sum(l_extendedprice * l_tax) AS total_fee, sum(l_extendedprice) AS notional
  FROM lineitem GROUP BY l_orderkey),
trades AS (
  SELECT o_orderkey AS trade_id, o_orderpriority AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side,
         o_orderdate AS entry_time, o_orderdate + to_days(n_lines::INT) AS exit_time, o_orderstatus AS exit_reason,
         n_lines, gross_pnl, total_fee, notional, gross_pnl - total_fee AS net_pnl, (gross_pnl - total_fee) / notional AS ret
  FROM orders JOIN lines ON o_orderkey = trade_id)"""
