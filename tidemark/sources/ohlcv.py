"""Sources and sinks of bars, ledgers, run logs and streams. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)
_CSV = "timestamp string, open double, high double, low double, close double, volume double"
_KLINE = "open_ms bigint, open double, high double, low double, close double, volume double"
LEDGER_SCHEMA = "run_id string, symbol string, trade_id bigint, side string, entry_time timestamp_ntz, exit_time timestamp_ntz, entry_price double, exit_price double, quantity double, fees double, gross_pnl double, net_pnl double, balance_before double, balance_after double, exit_reason string"
RUN_LOG_SCHEMA = "run_id string, stage string, started timestamp_ntz, data_layer string, config_hash string, data_hash string, seed bigint, n_rows bigint, status string, note string, version string"


def _finish(rows: DataFrame, start: str | None, end: str | None) -> DataFrame:
    rows = rows.where("ts is not null")
    if start:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        rows = rows.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return rows.select("symbol", "ts", "open", "high", "low", "close", "volume")


def _last_of_each(rows: DataFrame) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(F.desc("__order")))
    return rows.withColumn("__rn", rn).where("__rn = 1").drop("__rn", "__order")


def _file_symbol() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)


def read_csv(spark: SparkSession, path: str | list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """OHLCV files with a header; the symbol is the file's stem. Rows without a time go, of repeated times the last in
    the file stays, start and end are inclusive."""
    rows = spark.read.schema(_CSV).option("header", True).csv(path)
    rows = rows.select(_file_symbol().alias("symbol"), F.expr("try_to_timestamp(timestamp)").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume", F.monotonically_increasing_id().alias("__order"))
    return _finish(_last_of_each(rows.where("ts is not null")), start, end)


def read_klines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files without a header whose first columns are epoch milliseconds and OHLCV; malformed rows go."""
    rows = spark.read.schema(_KLINE).option("mode", "PERMISSIVE").csv(path)
    ts = F.expr("timestampadd(MILLISECOND, open_ms, timestamp_ntz'1970-01-01')")
    rows = rows.select(_file_symbol().alias("symbol"), ts.alias("ts"), "open", "high", "low", "close", "volume")
    return rows.dropna()


def write_days(rows: DataFrame, path: str) -> None:
    """Bars partitioned by day."""
    rows.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(path)


def _first_of_each(rows: DataFrame) -> DataFrame:
    """Of rows with an equal symbol and time the one that comes first: by its file's name, then by its place in it."""
    rn = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy("__file", "__row"))
    return rows.withColumn("__rn", rn).where("__rn = 1").drop("__rn", "__file", "__row")


def _days(spark: SparkSession, path: str, repeats: bool) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if repeats else rows.withColumns({"__file": F.col("_metadata.file_name"), "__row": F.col("_metadata.row_index")})


def read_days(spark: SparkSession, path: str, start: str, end: str, repeats: bool = False) -> DataFrame:
    """Only the days touched by [start, end] are read; of repeated times the first stays. With `repeats` all stay, for rows such as ticks,
    of which several may have one time."""
    rows = _days(spark, path, repeats).where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    rows = rows.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return rows if repeats else _first_of_each(rows)


def read_days_of(spark: SparkSession, path: str, positions: DataFrame, start: str, end: str, repeats: bool = False) -> DataFrame:
    """The bars of the days that positions(symbol, start, end) of their symbols touch, first of repeated times (with `repeats`, all). The
    days reach the scan as a filter on its partitions while the query runs, so no other day's files are opened."""
    touched = positions.where(F.col(start) <= F.col(end)).select("symbol", F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("day"))
    touched = touched.distinct()
    rows = _days(spark, path, repeats).join(touched, ["symbol", "day"], "left_semi")
    return rows if repeats else _first_of_each(rows)


def append_new(spark: SparkSession, new: DataFrame, path: str) -> int:
    """Appends the rows beyond each symbol's latest one and returns how many."""
    have = spark.read.parquet(path).groupBy("symbol").agg(F.max("ts").alias("__last"))
    fresh = new.join(have, "symbol", "left").where(F.col("__last").isNull() | (F.col("ts") > F.col("__last"))).drop("__last")
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def file_inventory(spark: SparkSession, path: str, schema: str, ts: str, cut: str) -> DataFrame:
    """Per file: rows, first and last time, rows after a cut."""
    rows = spark.read.schema(schema).parquet(path)
    late = F.col(ts) > F.lit(cut).cast("timestamp_ntz")
    return rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n_rows"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count_if(late).alias("n_after"))


def write_outputs(outputs: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """One folder per named output of a study."""
    for name, df in outputs.items():
        df.write.mode("overwrite").option("header", True).format(form).save(f"{path}/{name}")


def append_ledger(rows: DataFrame, path: str, schema: str = LEDGER_SCHEMA) -> None:
    """Appends rows in exactly the declared columns and types; a missing column fails."""
    declared = T.StructType.fromDDL(schema)
    rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in declared]).write.mode("append").parquet(path)


def append_universe(rows: DataFrame, path: str) -> None:
    """Appends (ts, symbols) snapshots as JSON lines, by day."""
    rows.groupBy("ts").agg(F.sort_array(F.collect_set("symbol")).alias("symbols")).withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def fingerprint(rows: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: rows, xor and sum of row hashes."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.agg(F.count("*").alias("n_rows"), F.bit_xor(h).alias("xor_hash"), F.sum(h.cast("decimal(38,0)")).alias("sum_hash"))


def manifest(rows: DataFrame, name: str, layer: str, ts: str = "ts") -> DataFrame:
    """One row that describes a dataset; a discovery layer is never eligible for out-of-sample use."""
    out = rows.agg(F.count("*").alias("n_rows"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count_distinct("symbol").alias("n_symbols"))
    return out.select(F.lit(name).alias("name"), F.lit(layer).alias("data_layer"), "*", (F.lit(layer) != "discovery").alias("oos_eligible"))


def decode_messages(raw: DataFrame) -> DataFrame:
    """symbol, ts, price, volume, is_closed from JSON messages in `value`: book tickers (s, b, a, E) give the mid price, klines
    (s, k.t, k.c, k.v, k.x) the close. Works on a batch or a stream; others give null symbols and go."""
    schema = "s string, b string, a string, E bigint, k struct<t: bigint, c: string, v: string, x: boolean>"
    m = raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")
    kline = F.col("k").isNotNull()
    ms = F.when(kline, F.col("k.t")).otherwise(F.col("E"))
    price = F.when(kline, F.col("k.c").cast("double")).otherwise((F.col("b").cast("double") + F.col("a").cast("double")) / 2)
    return m.select(
        F.col("s").alias("symbol"),
        F.timestamp_millis(ms).alias("ts"),
        price.alias("price"),
        F.coalesce(F.col("k.v").cast("double"), F.lit(0.0)).alias("volume"),
        F.when(kline, F.col("k.x")).alias("is_closed"),
    ).where("symbol is not null and price is not null")
