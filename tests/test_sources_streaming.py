"""Sources, sinks and streams: exact round trips, and streams compared with batch results."""

import os
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, events, indicators, patterns, state
from tidemark.plans.inputs import bars_of, ticks, trades
from tidemark.plans.registry import ORACLE_SQL, QUERIES
from tidemark.sources import ohlcv
from tidemark.streaming import live, stateful, tables

SF = "/root/testdata/sf0.001"


def test_csv_scan(spark, tmp_path):
    (tmp_path / "ABC.csv").write_text("timestamp,open,high,low,close,volume\n2024-01-01 00:00:00,1,2,0.5,1.5,10\n2024-01-01 00:00:00,1,2,0.5,1.7,11\n,1,1,1,1,1\n2024-01-02 00:00:00,2,3,1,2,5\n")
    got = ohlcv.read_csv(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.symbol, r.ts, r.close) for r in got] == [("ABC", datetime(2024, 1, 1), 1.7), ("ABC", datetime(2024, 1, 2), 2.0)]
    assert ohlcv.read_csv(spark, str(tmp_path), start="2024-01-02", end="2024-01-02").count() == 1


def test_kline_scan(spark, tmp_path):
    (tmp_path / "X.csv").write_text("1704067200000,1,2,0.5,1.5,10,extra\nbad,1,1,1,1,1\n")
    got = ohlcv.read_klines(spark, str(tmp_path)).collect()
    assert [(r.symbol, r.ts, r.close) for r in got] == [("X", datetime(2024, 1, 1), 1.5)]


def _rows(spark):
    return ticks(spark, SF).select("symbol", "ts", *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], F.col("volume").cast("double").alias("volume"))


def test_days_are_pruned(spark, tmp_path):
    path = str(tmp_path / "days")
    ohlcv.write_days(_rows(spark), path)
    got = ohlcv.read_days(spark, path, "2024-01-05 06:00:00", "2024-01-06 12:00:00")
    want = _rows(spark).where("ts between timestamp_ntz'2024-01-05 06:00:00' and timestamp_ntz'2024-01-06 12:00:00'")
    assert got.count() == want.count()
    assert "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def _scans(df):
    """(formatted plan as it ran, files opened by its partitioned scan)."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    files = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if name.startswith("Scan parquet") and "open" in node.simpleString(1000):
            files.append(node.metrics().get("numFiles").get().value())
        inner = [node.plan()] if "QueryStage" in name else []
        children = node.children()
        for child in [*inner, *[children.apply(i) for i in range(children.size())]]:
            walk(child)

    walk(plan)
    return text, files


def test_only_days_that_positions_touch_are_read(spark, tmp_path):
    path = str(tmp_path / "days")
    ohlcv.write_days(_rows(spark).coalesce(1), path)
    days = [x for x in os.listdir(path) if x.startswith("day=")]
    assert len(days) > 20
    held = spark.createDataFrame([("click", datetime(2024, 1, 5, 22), datetime(2024, 1, 6, 2)), ("view", datetime(2024, 1, 9), datetime(2024, 1, 9, 1)), ("view", datetime(2024, 1, 20), datetime(2024, 1, 3))], "symbol string, a timestamp_ntz, b timestamp_ntz")
    held.write.parquet(str(tmp_path / "held"))
    got = ohlcv.read_days_of(spark, path, spark.read.parquet(str(tmp_path / "held")), "a", "b")
    text, files = _scans(got)
    assert "dynamicpruning" in text.lower() and files == [3]
    want = _rows(spark).where("symbol = 'click' and to_date(ts) in ('2024-01-05', '2024-01-06') or symbol = 'view' and to_date(ts) = '2024-01-09'")
    assert sorted((r.symbol, r.ts) for r in got.collect()) == sorted((r.symbol, r.ts) for r in want.collect())


def test_the_first_of_repeated_times_stays(spark, tmp_path):
    ts = datetime(2024, 1, 1, 5)
    rows = [("a", ts, float(i), 1.0, 1.0, 1.0, 1.0) for i in range(50)]
    ohlcv.write_days(spark.createDataFrame(rows, ohlcv.BAR_SCHEMA).coalesce(1), str(tmp_path / "d"))
    assert [r.open for r in ohlcv.read_days(spark, str(tmp_path / "d"), "2024-01-01", "2024-01-02").collect()] == [0.0]


@pytest.mark.parametrize("name", ["bars_of_held_days", "day_partitions"])
def test_ticks_with_one_time_all_stay(spark, tmp_path, name):
    again = spark.read.parquet(f"{SF}/events.parquet").where("event_id % 3 = 0").withColumns({"event_id": F.col("event_id") + 1_000_000, "value": F.col("value") + 1})
    spark.read.parquet(f"{SF}/events.parquet").unionByName(again).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.sql(ORACLE_SQL[name])
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_append_new_only(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = _rows(spark)
    rows.where("ts < timestamp_ntz'2024-01-10'").write.parquet(path)
    n = ohlcv.append_new(spark, rows, path)
    assert n == rows.where("ts >= timestamp_ntz'2024-01-10'").count() and spark.read.parquet(path).count() == rows.count()
    assert ohlcv.append_new(spark, rows, path) == 0


def test_ledger_sink_enforces_its_schema(spark, tmp_path):
    path = str(tmp_path / "ledger")
    row = spark.createDataFrame([("r", 1)], "run_id string, seed int").selectExpr("run_id", "'s' stage", "null started", "'d' data_layer", "'h' config_hash", "'h' data_hash", "seed", "1 n_rows", "'ok' status", "'' note", "'1' version")
    ohlcv.append_ledger(row, path, ohlcv.RUN_LOG_SCHEMA)
    ohlcv.append_ledger(row, path, ohlcv.RUN_LOG_SCHEMA)
    assert spark.read.parquet(path).count() == 2 and dict(spark.read.parquet(path).dtypes)["seed"] == "bigint"
    with pytest.raises(Exception):
        ohlcv.append_ledger(row.drop("note"), path, ohlcv.RUN_LOG_SCHEMA)


def test_fingerprint_ignores_order(spark):
    rows = _rows(spark)
    assert ohlcv.fingerprint(rows).first() == ohlcv.fingerprint(rows.repartition(5)).first()
    assert ohlcv.fingerprint(rows).first() != ohlcv.fingerprint(rows.withColumn("close", F.col("close") + 1)).first()


def test_inventory_manifest_universe(spark, tmp_path):
    path = str(tmp_path / "x")
    rows = _rows(spark)
    ohlcv.write_outputs({"a": rows, "b": rows.limit(3)}, path)
    got = ohlcv.file_inventory(spark, f"{path}/b", rows.schema.simpleString()[7:-1].replace(":", " "), "ts", "2024-01-01").agg({"n_rows": "sum"}).first()[0]
    assert got == 3
    assert not ohlcv.manifest(rows, "n", "discovery").first().oos_eligible
    ohlcv.append_universe(rows.select("ts", "symbol").limit(5), f"{path}/u")
    assert spark.read.json(f"{path}/u").count() >= 1


def test_message_decoding(spark):
    raw = spark.createDataFrame([('{"s":"A","b":"1","a":"3","E":1704067200000}',), ('{"s":"A","k":{"t":1704067260000,"c":"5","v":"7","x":true}}',), ("junk",)], "value string")
    assert [(r.symbol, r.price, r.is_closed) for r in ohlcv.decode_messages(raw).orderBy("ts").collect()] == [("A", 2.0, None), ("A", 5.0, True)]


def _stream(spark, rows, tmp_path, files=4):
    path = str(tmp_path / "in")
    rows.repartitionByRange(files, "ts").write.parquet(path)
    for i, name in enumerate(sorted(x for x in os.listdir(path) if x.startswith("part-"))):
        os.utime(f"{path}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))  # files arrive in time order
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streamed_bars_equal_batch(spark, tmp_path):
    t = ticks(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    flush = spark.createDataFrame([("zz", datetime(2024, 3, 1), 1.0, 1, -1)], t.schema)
    got = _drain(live.bars(_stream(spark, t.unionByName(flush), tmp_path), "4 hours", "2 days"), "streamed_bars", "append")
    want = bars.resample_ticks(t, "4 hours")
    assert {tuple(r) for r in got.where("symbol <> 'zz'").collect()} == {tuple(r) for r in want.collect()}


def test_streamed_quotes_and_dedup(spark, tmp_path):
    t = ticks(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    twice = t.unionByName(t)
    got = _drain(live.deduplicated(_stream(spark, twice, tmp_path, 1), "event_id", "40 days"), "dedup", "append")
    assert got.count() == t.count()
    quotes = _drain(live.latest_quotes(_stream(spark, t, tmp_path / "q")), "quotes", "complete")
    want = t.groupBy("symbol").agg(F.max_by("price", "ts").alias("p")).collect()
    assert {r.symbol: r.price for r in quotes.collect()} == {r.symbol: r.p for r in want}


def test_streamed_breakouts_equal_batch(spark, tmp_path):
    rows = patterns.trend_signals(indicators.base_indicators(bars_of(spark, SF), fast=3, slow=8, channel=5, exit_channel=5))
    rows = rows.select("symbol", "bar_ts", "open", "high", "low", "close", "breakout", "exit_signal")
    want = {(r.symbol, r.bar_ts): (r.event_no, r.event_state) for r in state.breakout_events(rows).collect()}
    path = str(tmp_path / "sig")
    for i, part in enumerate(("bar_ts < timestamp_ntz'2024-01-12'", "bar_ts >= timestamp_ntz'2024-01-12'")):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/*")
    got = _drain(live.breakout_stream(stream), "breakouts", "append")
    assert {(r.symbol, r.bar_ts): (r.event_no, r.event_state) for r in got.collect()} == want


def test_streamed_sessions_and_sliding_windows_equal_batch(spark, tmp_path):
    t = ticks(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    flush = spark.createDataFrame([("zz", datetime(2024, 4, 1), 1.0, 1, -1)], t.schema)
    both = t.unionByName(flush)
    got = _drain(live.sessions(_stream(spark, both, tmp_path / "s"), "3 hours", "2 days"), "sessions", "append")
    want = t.groupBy("symbol", F.session_window("ts", "3 hours").alias("w")).count().select("symbol", "w.start", "w.end", "count")
    assert {tuple(r) for r in got.where("symbol <> 'zz'").collect()} == {tuple(r) for r in want.collect()}
    got = _drain(live.sliding_day(_stream(spark, both, tmp_path / "d"), "2 days", "24 hours", "12 hours"), "sliding", "append")
    w = t.groupBy("symbol", F.window("ts", "24 hours", "12 hours").alias("w")).agg(F.sum("volume").alias("v"), F.min_by("price", "ts").alias("a"), F.max_by("price", "ts").alias("b"))
    want = {(r.symbol, r.w.end): (r.v, round(r.b / r.a - 1, 9)) for r in w.collect()}
    assert {(r.symbol, r.ts): (r.volume, round(r.change, 9)) for r in got.where("symbol <> 'zz'").collect()} == want


def test_streamed_daily_ranking_and_alerts(spark, tmp_path):
    t = ticks(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    flush = spark.createDataFrame([("zz", datetime(2024, 4, 1), 1.0, 1, -1)], t.schema)
    days = []
    q = live.daily_ranking(_stream(spark, t.unionByName(flush), tmp_path / "r"), "2 days", lambda batch, i: days.extend(batch.collect())).start()
    q.awaitTermination(120)
    want = t.groupBy("symbol", F.window("ts", "1 day").alias("w")).agg(F.sum(F.col("price") * F.col("volume")).alias("v"))
    assert {(r.symbol, r.day): round(r.quote_volume, 6) for r in days if r.symbol != "zz"} == {(r.symbol, r.w.end): round(r.v, 6) for r in want.collect()}
    limits = spark.createDataFrame([("click", 60.0)], "symbol string, limit double")
    alerts = _drain(live.price_alerts(_stream(spark, t, tmp_path / "a"), limits), "alerts", "append")
    assert alerts.count() == t.where("symbol = 'click' and price > 60").count() > 0


def test_streamed_pauses_equal_batch_and_ledger_is_appended_once(spark, tmp_path):
    rows = trades(spark, SF).select("symbol", "trade_id", "exit_time", F.when(F.col("trade_id") % 5 < 3, -F.abs("net_pnl") * 40).otherwise(F.col("net_pnl")).alias("net_pnl"))
    want = {r.trade_id: r.paused for r in state.trading_pause(rows, ["symbol"], ["exit_time", "trade_id"], "net_pnl").collect()}
    path = str(tmp_path / "t")
    for i, part in enumerate(("exit_time < timestamp'1995-01-01'", "exit_time >= timestamp'1995-01-01'")):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    for i in (0, 1):
        name = next(x for x in os.listdir(f"{path}/{i}") if x.startswith("part-"))
        os.utime(f"{path}/{i}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    got = {r.trade_id: r.paused for r in _drain(live.pause_stream(stream()), "pauses", "append").collect()}
    assert got == want and len(set(want.values())) == 2
    for _ in range(2):
        live.write_ledger(stream(), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()


def _in_turns(spark, rows, ts, folder, cuts):
    """A stream of files, split at the cut times, with each part's rows out of order, then a row of another symbol far ahead."""
    path = str(folder)
    os.makedirs(path)
    bounds = [None, *cuts, None]
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        part = rows.where((F.col(ts) >= F.lit(a)) if a else F.lit(True)).where((F.col(ts) < F.lit(b)) if b else F.lit(True))
        part.orderBy(F.xxhash64(ts, "symbol")).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
        for name in os.listdir(f"{path}/{i}"):
            os.utime(f"{path}/{i}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    return lambda files: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/{files}")


def _finish(spark, rows, ts):
    """One row of symbol zz in the year 2100, so that the watermark passes all others."""
    return rows.unionByName(rows.limit(1).withColumn("symbol", F.lit("zz")).withColumn(ts, F.lit("2100-01-01").cast("timestamp")))


def _append(df, path, checkpoint):
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(180)


CUTS = ["2024-01-08", "2024-01-16", "2024-01-17 12:00:00"]


def test_streamed_hikkake_setups_equal_batch_after_a_restart(spark, tmp_path):
    rng = random.Random(8)
    made = [(s, datetime(2024, 1, 1) + timedelta(hours=h), 50 + rng.random() * 9, 50 - rng.random() * 9, rng.random() < 0.9) for s in "abc" for h in range(400)]
    rows = patterns.hikkake(spark.createDataFrame(made, "symbol string, bar_ts timestamp_ntz, high double, low double, valid boolean"))
    want = {tuple(r) for r in events.hikkake_tracker(rows, "valid").collect()}
    assert {r[3] for r in want} == {"confirmed", "invalid", "expired"}
    given = rows.select("symbol", F.col("bar_ts").cast("timestamp").alias("bar_ts"), "high", "low", "valid")
    stream = _in_turns(spark, _finish(spark, given, "bar_ts"), "bar_ts", tmp_path / "in", CUTS)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    hold = lambda files: stateful.hikkake_stream(stream(files), "9 days", patience_seconds=40 * 86_400)
    _append(hold("[0-1]"), out, check)
    first = spark.read.parquet(out).count()
    assert 0 < first < len(want)
    _append(hold("*"), out, check)  # the same query again, with what came meanwhile
    got = spark.read.parquet(out).where("symbol <> 'zz'").selectExpr("symbol", "cast(setup_time as timestamp_ntz)", "cast(confirm_time as timestamp_ntz)", "outcome").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_a_setup_expires_without_a_further_bar(spark, tmp_path):
    """Bars of one symbol stop after a setup; the other symbol's bars move the watermark beyond its deadline."""
    at = lambda h: datetime(2024, 1, 1, h)
    rows = [("a", at(0), 10.0, 5.0, True), ("a", at(1), 9.0, 6.0, True), ("a", at(2), 8.0, 5.5, True), ("b", at(23), 1.0, 1.0, True)]
    df = spark.createDataFrame(rows, "symbol string, bar_ts timestamp, high double, low double, valid boolean")
    stream = _in_turns(spark, df, "bar_ts", tmp_path / "in", ["2024-01-01 03:00:00"])
    got = _drain(stateful.hikkake_stream(stream("*"), "1 hour", patience_seconds=4 * 3600), "expired_setups", "append").collect()
    assert [(r.symbol, r.setup_time, r.confirm_time, r.outcome) for r in got] == [("a", at(2), None, "expired")]


def test_streamed_held_states_equal_batch(spark, tmp_path):
    rows = patterns.trend_signals(indicators.base_indicators(bars_of(spark, SF), fast=3, slow=8, channel=5, exit_channel=5))
    rows = state.set_reset(rows, F.col("breakout"), F.col("exit_signal"), "active")
    want = {(r.symbol, r.bar_ts): (r.active, r.active_age, r.bars_since_exit, r.phase) for r in state.post_exit_phase(rows, "active").collect()}
    given = rows.select("symbol", F.col("bar_ts").cast("timestamp").alias("bar_ts"), "breakout", "exit_signal")
    stream = _in_turns(spark, _finish(spark, given, "bar_ts"), "bar_ts", tmp_path / "in", CUTS)
    got = _drain(stateful.held_stream(stream("*"), "9 days"), "held", "append").where("symbol <> 'zz'").collect()
    assert len(got) == len(want) and {(r.symbol, r.bar_ts): (r.active, r.active_age, r.bars_since_exit, r.phase) for r in got} == want


def test_streamed_pauses_take_trades_in_their_order(spark, tmp_path):
    rows = trades(spark, SF).select("symbol", "trade_id", F.col("exit_time").cast("timestamp").alias("exit_time"), F.when(F.col("trade_id") % 5 < 3, -F.abs("net_pnl") * 40).otherwise(F.col("net_pnl")).alias("net_pnl"))
    want = {r.trade_id: r.paused for r in state.trading_pause(rows, ["symbol"], ["exit_time", "trade_id"], "net_pnl").collect()}
    stream = _in_turns(spark, _finish(spark, rows, "exit_time"), "exit_time", tmp_path / "in", ["1994-01-01", "1996-06-01"])
    got = _drain(stateful.ordered_pause_stream(stream("*"), "3000 days"), "ordered_pauses", "append").where("symbol <> 'zz'").collect()
    assert {r.trade_id: r.paused for r in got} == want and len(got) == len(want)


def test_developing_bars_are_replaced(spark, tmp_path):
    """Ticks out of order over files: every bar develops over several batches, late ticks replace it, and the last versions are the
    batch bars; a batch that is tried again counts once."""
    t = ticks(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    path = tmp_path / "in"
    for i in range(4):
        t.where(F.col("event_id") % 4 == i).coalesce(1).write.parquet(f"{path}/{i}")
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    kept = str(tmp_path / "kept")
    tables.upsert(live.bars(stream, "4 hours", "60 days"), kept).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(180)
    versions = spark.read.option("basePath", kept).parquet(f"{kept}/batch=*")
    want = {tuple(r) for r in bars.resample_ticks(t, "4 hours").collect()}
    assert versions.count() > len(want)
    assert {tuple(r) for r in tables.latest(spark, kept, ["symbol", "bar_ts"]).collect()} == want
    again = versions.where("batch = 1").drop("batch")
    again.write.mode("overwrite").parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("overwrite").parquet(f"{kept}/batch=000000000001")
    assert {tuple(r) for r in tables.latest(spark, kept, ["symbol", "bar_ts"]).collect()} == want
    tables.compact(spark, kept, str(tmp_path / "compact"), ["symbol", "bar_ts"])
    assert spark.read.parquet(str(tmp_path / "compact")).count() == len(want)


def test_bars_sent_again_keep_the_last(spark, tmp_path):
    """Closed bars that arrive twice: the higher sequence number stays, whichever batch brings it."""
    rows = [("a", datetime(2024, 1, 1, 0, 15), 1.0, 5), ("a", datetime(2024, 1, 1, 0, 15), 2.0, 9), ("a", datetime(2024, 1, 1, 0, 20), 3.0, 6), ("a", datetime(2024, 1, 1, 0, 15), 4.0, 7)]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, "symbol string, bar_ts timestamp, close double, seq bigint").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("symbol string, bar_ts timestamp, close double, seq bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    kept = str(tmp_path / "kept")
    tables.upsert(stream, kept, "append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    got = tables.latest(spark, kept, ["symbol", "bar_ts"], "seq").withColumn("acts", tables.on_boundary("bar_ts")).orderBy("bar_ts").collect()
    assert [(r.close, r.acts) for r in got] == [(2.0, True), (3.0, False)]


def test_ticks_get_the_universe_frozen_for_their_day(spark, tmp_path):
    t = ticks(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    flush = spark.createDataFrame([("zz", datetime(2024, 4, d), 1.0, 1, -d) for d in (1, 2)], t.schema)
    ranking, joined = str(tmp_path / "ranking"), str(tmp_path / "joined")
    days = lambda rows: rows.withWatermark("ts", "2 days").groupBy("symbol", F.window("ts", "1 day").alias("w")).agg(F.sum(F.col("price") * F.col("volume")).alias("quote_volume")).select("symbol", F.col("w.end").alias("day"), "quote_volume")
    ticks_in = _in_turns(spark, t.unionByName(flush), "ts", tmp_path / "in", ["2024-01-10", "2024-01-20", "2024-02-10", "2024-04-02"])

    def turn(files):
        """Ticks first: those of days without a ranking wait."""
        for writer, check in ((tables.join_universe(ticks_in(files), ranking, joined, 3), "join"), (tables.rank_days(days(ticks_in(files)), ranking), "rank")):
            writer.option("checkpointLocation", f"{tmp_path}/{check}").trigger(availableNow=True).start().awaitTermination(180)

    turn("[0-1]")
    turn("[0-2]")
    turn("[0-3]")
    turn("*")
    got = {r.event_id: (r["rank"], r.member) for r in spark.read.parquet(f"{joined}/ranked/*").collect()}
    daily = state.daily_universe(t.select("symbol", F.col("ts").alias("bar_ts"), F.col("price").alias("close"), "volume"), 3)
    want = t.join(daily, (daily.symbol == t.symbol) & (daily.day == F.to_date("ts")), "left").select("event_id", "rank", "member").collect()
    want = {r.event_id: (r["rank"], bool(r.member)) for r in want}
    assert {i: x for i, x in got.items() if i >= 0} == want
    assert spark.read.parquet(f"{joined}/ranked/*").count() == len(got) and len({r for r, _ in want.values()}) > 3
