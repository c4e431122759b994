"""Tables that streams keep: bars that are replaced while they develop, and rankings frozen for a day.

A micro-batch writes only folders named by its number, overwriting what an attempt before it left, so each batch counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


# --------------------------------------------------------------------------- developing bars


def upsert(stream: DataFrame, path: str, mode: str = "update"):
    """A writer that keeps each micro-batch's rows as versions of their keys: with bars in update mode a bar's row is written anew
    each time it develops. start() it with a checkpoint."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return stream.writeStream.outputMode(mode).foreachBatch(keep)


def latest(spark: SparkSession, path: str, keys: list[str], order: str | None = None) -> DataFrame:
    """The last version of each key: the highest `order` if there is such a column, then the last batch."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    by = [*([F.desc(order)] if order else []), F.desc("batch")]
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return rows.withColumn("__rn", rn).where("__rn = 1").drop("__rn", "batch")


def compact(spark: SparkSession, path: str, to: str, keys: list[str], order: str | None = None) -> None:
    """The latest versions as a table of their own."""
    latest(spark, path, keys, order).write.mode("overwrite").parquet(to)


def on_boundary(bar_ts, minutes: int = 15):
    """Whether a close-labelled bar ends a bar of that many minutes, so that a strategy on it may act; others only develop."""
    return F.unix_timestamp(bar_ts) % (60 * minutes) == 0


# --------------------------------------------------------------------------- the daily universe


def rank_days(days: DataFrame, path: str):
    """A writer for closed days (symbol, day, quote_volume; append mode): the ranking of each day, one frozen folder a day. All of
    a day's symbols close with the same watermark, so they are in one micro-batch."""

    def freeze(batch: DataFrame, number: int) -> None:
        rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("quote_volume"), "symbol"))
        ranked = batch.withColumn("rank", rank).withColumn("day", F.to_date("day"))
        ranked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    return days.writeStream.outputMode("append").foreachBatch(freeze)


def join_universe(ticks: DataFrame, ranking: str, path: str, top: int):
    """A writer that gives each tick the rank that its symbol has in the ranking frozen for the tick's UTC date, and member (rank up
    to `top`); rows go to path/ranked. Ticks whose date has no ranking yet wait in path/waiting and are tried again with the next
    batch; once a later date is ranked theirs will never come, and they get no rank."""
    schema = ticks.schema

    def attach(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/waiting/batch={number - 1:012d}"
        rows = batch.unionByName(spark.read.schema(schema).parquet(before)) if number and _exists(spark, before) else batch
        rows = rows.withColumn("__day", F.to_date("ts"))
        ranked = f"{path}/ranked/batch={number:012d}"
        if not _exists(spark, ranking):
            rows.drop("__day").write.mode("overwrite").parquet(f"{path}/waiting/batch={number:012d}")
            return
        table = spark.read.parquet(ranking).select("symbol", F.to_date("day").alias("__day"), "rank")
        days = table.select("__day").distinct().withColumn("__known", F.lit(True))
        rows = rows.join(F.broadcast(days), "__day", "left").join(F.broadcast(table.agg(F.max("__day").alias("__last"))))  # one row
        ready = F.col("__known") | (F.col("__day") < F.col("__last"))
        rows = rows.withColumn("__ready", F.coalesce(ready, F.lit(False))).join(table, ["symbol", "__day"], "left")
        rows = rows.withColumn("member", F.coalesce(F.col("rank") <= top, F.lit(False)))
        names = [F.col(f"`{c}`") for c in schema.names]
        rows.where("__ready").select(*names, "rank", "member").write.mode("overwrite").parquet(ranked)
        rows.where("not __ready").select(*names).write.mode("overwrite").parquet(f"{path}/waiting/batch={number:012d}")

    return ticks.writeStream.outputMode("append").foreachBatch(attach)
