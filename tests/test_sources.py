"""Sources, merging, universes and streaming state."""

import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import candles, hours
from tidemark.operators import quality, universe
from tidemark.sources import files, market, payloads
from tidemark.sources.schemas import TABLES
from tidemark.streaming import state


def test_canonicalize_strict_and_lenient(spark):
    raw = spark.createDataFrame(
        [("X", "A", "1m", 1704067200000, "1", "2", "0.5", "oops")],
        "exchange string, inst_id string, bar string, ts long, open string, high string, low string, close string",
    )
    with pytest.raises(ValueError, match="volume"):
        market.canonicalize(raw, "candles")
    row = market.canonicalize(raw, "candles", strict=False).first()
    assert row.timestamp == datetime(2024, 1, 1) and row.open == 1.0 and row.close is None
    assert row.volume is None


def test_bars_must_be_multiples():
    assert market.check_bar("open_interest", "15m") == 15
    with pytest.raises(ValueError):
        market.check_bar("open_interest", "7m")


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(i, i % 3, 1.0) for i in range(9)], "k int, part int, v double")
    b = spark.createDataFrame([(i, i % 3, 2.0) for i in range(4, 12)], "k int, part int, v double")
    for rows in (a, b, b):
        market.upsert_partitions(spark, rows, path, ["k"], ["part"])
    got = {r.k: r.v for r in spark.read.parquet(path).collect()}
    assert got == {**{i: 1.0 for i in range(4)}, **{i: 2.0 for i in range(4, 12)}}


def test_upsert_leaves_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0)], "k int, part int, v double")
    market.upsert_partitions(spark, a, path, ["k"], ["part"])
    before = sorted(p.name for p in (tmp_path / "t" / "part=2").iterdir())
    market.upsert_partitions(spark, a.where("part = 1"), path, ["k"], ["part"])
    assert before == sorted(p.name for p in (tmp_path / "t" / "part=2").iterdir())


@pytest.mark.parametrize("header", [True, False])
def test_csv_with_and_without_header(spark, tmp_path, header):
    lines = ["1704067200000,8,0.0001", "1704096000000,8,bad"]
    if header:
        lines.insert(0, "calc_time,funding_interval_hours,last_funding_rate")
    f = tmp_path / "BTCUSDT-fundingRate.csv"
    f.write_text("\n".join(lines))
    raw = files.read_csv_archive(spark, str(f), "funding_rates")
    rows = files.csv_funding(raw, files.symbol_from_path()).orderBy("timestamp").collect()
    assert [r.funding_rate for r in rows] == [0.0001, None]
    assert rows[0].instrument_id == "BTCUSDT" and rows[0].funding_interval_hours == 8


def test_taker_rows_are_sell_then_buy(spark):
    df = spark.createDataFrame([("A", ["1704067200000", "3", "5"])], "instrument_id string, row array<string>")
    row = payloads.rows_to_taker(df).first()
    assert (row.sell_volume, row.buy_volume, row.net_buy_volume) == (3.0, 5.0, 2.0)


def test_liquidation_ids_are_stable(spark):
    detail = {"ts": "1704067200000", "side": "sell", "posSide": "long", "bkPx": "10", "sz": "2"}
    msg = json.dumps({"instId": "A", "details": [detail, {"side": "buy"}]})
    df = spark.createDataFrame([(msg,), (msg,)], "payload string")
    rows = payloads.build_liquidations(df).collect()
    assert len(rows) == 2 and len({r.liquidation_id for r in rows}) == 1
    assert len(rows[0].liquidation_id) == 24 and rows[0].bankruptcy_loss is None


def test_account_rows_keep_exact_decimals(spark):
    df = spark.createDataFrame(
        [("7", "A", "0.1", "12345678901234567890.123456789012345678", "1704067200000")],
        "tradeId string, instId string, fillSz string, fillPx string, fillTime string",
    )
    row = payloads.account_rows(df, "private_fills", "me").first()
    assert str(row.fill_price) == "12345678901234567890.123456789012345678"
    assert json.loads(row.raw_json)["tradeId"] == "7"


def test_continuity_and_coverage(spark):
    bars = candles(spark, range(100, 110), minutes=1)
    broken = bars.where(F.minute("timestamp") != 5)
    at = datetime(2024, 1, 1)
    assert quality.validate_periodic(bars, at, at + timedelta(minutes=10), 1).count() == 0
    bad = quality.validate_periodic(broken, at, at + timedelta(minutes=10), 1).first()
    assert "broken_step" in bad.violations
    cover = quality.coverage_intervals(broken, 1).orderBy("start_time").collect()
    assert [(r.start_time.minute, r.end_time.minute) for r in cover] == [(0, 5), (6, 10)]
    holes = quality.missing_intervals(
        quality.coverage_intervals(broken, 1), at, at + timedelta(minutes=12)
    ).orderBy("start_time").collect()
    assert [(r.start_time.minute, r.end_time.minute) for r in holes] == [(5, 6), (10, 12)]


def test_overlapping_cover_leaves_no_false_holes(spark):
    t = hours(10)
    rows = [("X", "A", t[0], t[6]), ("X", "A", t[1], t[2]), ("X", "A", t[7], t[8])]
    cover = spark.createDataFrame(
        rows, "venue string, instrument_id string, start_time timestamp_ntz, end_time timestamp_ntz"
    )
    got = quality.missing_intervals(cover, t[0], t[9]).orderBy("start_time").collect()
    assert [(r.start_time.hour, r.end_time.hour) for r in got] == [(6, 7), (8, 9)]


def snapshots(spark):
    fields = TABLES["instrument_snapshots"]
    rows = []
    for day, names in ((1, "ABC"), (2, "AB")):
        for i, n in enumerate(names):
            rows.append(
                {"venue": "X", "instrument_id": n, "timestamp": datetime(2024, 1, day), "state": "live",
                 "instrument_type": "SWAP", "settle_currency": "USDT", "contract_type": "linear",
                 "list_time": datetime(2023, 1, 1) if n != "B" else None, "volume_usd_24h": float(i + day)}
            )
    return spark.createDataFrame([tuple(r.get(f) for f in fields.names) for r in rows], fields)


def test_universe_never_sees_the_future(spark):
    snap = universe.snapshot_at(snapshots(spark), datetime(2024, 1, 1, 12))
    assert snap.count() == 3
    top = universe.select_universe(snap, datetime(2024, 1, 1, 12), top_n=2).orderBy("rank").collect()
    assert [r.instrument_id for r in top] == ["C", "A"]


def test_lifecycle_ends_at_first_missing_snapshot(spark):
    life = {r.instrument_id: r for r in universe.rebuild_lifecycle(snapshots(spark)).collect()}
    assert life["C"].valid_to == datetime(2024, 1, 2)
    assert life["C"].valid_to_source == "first_missing_snapshot" and life["C"].confidence == "inferred"
    assert life["B"].valid_from_source == "first_seen" and life["A"].valid_to is None


def events(spark, rows):
    return spark.createDataFrame(
        rows, "instrument_id string, exchange_ts timestamp_ntz, received_at timestamp_ntz, value double, source string"
    )


def test_late_and_lower_ranked_messages_lose(spark):
    t = hours(4)
    df = events(spark, [
        ("A", t[2], t[2], 2.0, "websocket"), ("A", t[1], t[3], 1.0, "websocket"), ("A", t[2], t[3], 9.0, "rest"),
        ("B", None, t[1], 5.0, "rest"),
    ])
    got = {r.instrument_id: r.value for r in state.latest_state(df).collect()}
    assert got == {"A": 2.0, "B": 5.0}


def test_snapshots_go_stale(spark):
    t0 = datetime(2024, 1, 1)
    df = events(spark, [("A", None, t0, 1.0, "rest"), ("A", None, t0 + timedelta(minutes=5), 2.0, "rest")])
    rows = state.minute_snapshots(df, columns=["value"]).orderBy("timestamp").collect()
    assert [r.status for r in rows] == ["fresh", "fresh", "fresh", "stale", "stale", "fresh"]
    assert [r.value for r in rows] == [1.0] * 5 + [2.0]


def test_stream_state_equals_batch_state(spark, tmp_path):
    t = hours(6)
    rows = [("A", t[i % 5], t[i % 6], float(i), "websocket" if i % 2 else "rest") for i in range(20)]
    rows += [("B", t[i % 3], t[i % 6], float(-i), "rest") for i in range(10)]
    df = events(spark, rows)
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def keep(batch, epoch):
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(str(tmp_path / "out"))

    q = (
        state.stream_latest_state(stream, "1 day").writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    last = out.groupBy("instrument_id").agg(F.max_by("order_time", "epoch").alias("order_time"))
    batch = state.latest_state(df).select("instrument_id", F.col("exchange_ts").cast("timestamp").alias("order_time"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))


def test_last_written_row_wins(spark, tmp_path):
    """An unconfirmed bar, then a lower confirmed correction: the correction is read."""
    path = str(tmp_path)
    for close, confirm in ((200.0, 0), (100.5, 1)):
        bar = candles(spark, [close]).withColumns({"venue": F.lit("SIM"), "confirm": F.lit(confirm)})
        market.write_market(market.canonicalize(bar, "candles", strict=False), path, "candles")
    got = market.read_market(spark, path, "candles").collect()
    assert [(r.close, r.confirm) for r in got] == [(100.5, 1)]


def test_clean_candles_takes_the_later_bar(spark):
    early = candles(spark, [200.0]).withColumn("arrival", F.lit(0))
    late = candles(spark, [100.5]).withColumn("arrival", F.lit(1))
    got = market.clean_candles(early.unionByName(late), order=["arrival"]).collect()
    assert [r.close for r in got] == [100.5]


def test_upsert_order_beats_arrival(spark, tmp_path):
    path = str(tmp_path / "t")
    for rows in ([(1, 0, 5, 1.0)], [(1, 0, 3, 9.0)], [(2, 0, 1, 7.0), (2, 0, 2, 4.0)]):
        df = spark.createDataFrame(rows, "k int, part int, seq int, v double")
        market.upsert_partitions(spark, df, path, ["k"], ["part"], ["seq"])
    assert {r.k: r.v for r in spark.read.parquet(path).collect()} == {1: 1.0, 2: 4.0}


def test_instrument_types(spark):
    names = ["BTC-USD-SWAP", "BTC-USD-SWAP#OLD#1", "BTC-USD-240329", "BTC-USD-240329#OLD#2", "BTC-USDT"]
    df = spark.createDataFrame([(n,) for n in names], "i string")
    got = [r.k for r in df.select(files.instrument_kind(F.col("i")).alias("k")).collect()]
    assert got == ["SWAP", "SWAP", "FUTURES", "FUTURES", "FUTURES"]


def test_silent_keys_turn_stale(spark):
    rows = [("A", datetime(2024, 1, 1, 0, 0), 1.0), ("B", datetime(2024, 1, 1, 0, 10), 2.0)]
    e = spark.createDataFrame(rows, "instrument_id string, received_at timestamp_ntz, value double")
    got = state.minute_snapshots(e, columns=["value"]).where("instrument_id = 'A'").orderBy("timestamp").collect()
    assert len(got) == 11 and [r.status for r in got[:3]] == ["fresh"] * 3 and got[-1].status == "stale"
    until = datetime(2024, 1, 1, 0, 30)
    assert state.minute_snapshots(e, columns=["value"], until=until).where("instrument_id = 'B'").count() == 21


def test_release_deletes_stage_tables(spark, tmp_path):
    from tidemark import session

    df = session.materialize(spark.range(5).toDF("x"))
    folder = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert df.count() == 5 and folder.exists()
    kept = session._STAGES[spark.sparkContext.applicationId]
    session._STAGES[spark.sparkContext.applicationId] = [str(folder)]
    assert session.release(spark) == 1 and not folder.exists()
    session._STAGES[spark.sparkContext.applicationId] = [p for p in kept if p != str(folder)]


def test_landed_trades_are_not_a_file_per_symbol(spark, tmp_path):
    from tidemark import session
    from tidemark.queries import REGISTRY

    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), i, "view", i + 0.5) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.coalesce(2).write.parquet(str(tmp_path / "events.parquet"))
    folder = Path(session.shared_folder(spark).removeprefix("file://"))
    before = set(folder.glob("csv-*"))
    got = REGISTRY["csv_aggregate_trades"].run(spark, str(tmp_path)).collect()
    assert {(r.instrument_id, r.price) for r in got} == {(f"U{i}", i + 0.5) for i in range(40)}
    (landed,) = set(folder.glob("csv-*")) - before
    assert len(list(landed.rglob("part-*"))) <= 2


class _State:
    """What a group's state offers to its function."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.mark, self.timeout = None, False, False, 0, None

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False

    def getCurrentWatermarkMs(self):
        return self.mark

    def setTimeoutTimestamp(self, at):
        self.timeout = at


def test_instruments_of_a_bucket_keep_their_own_state():
    import pandas as pd

    t = [pd.Timestamp(x) for x in hours(30)]

    def call(held, rows, mark):
        held.mark, held.hasTimedOut = mark, not rows
        columns = ["instrument_id", "order_time", "priority", "received_at", "value"]
        chunks = [pd.DataFrame([r], columns=columns) for r in rows]  # a group may come in several chunks
        found = [r for part in state._keep_newest((0,), iter(chunks), held, 3_600_000) for r in part.itertuples(index=False)]
        return {r.instrument_id: (r.order_time, None if pd.isna(r.value) else r.value) for r in found}

    held = _State()
    first = [("A", t[5], 0, t[5], 1.0), ("B", t[9], 1, t[9], None), ("A", t[4], 1, t[9], 7.0), ("B", t[9], 1, t[9], 2.0)]
    assert call(held, first, 0) == {"A": (t[5], 1.0), "B": (t[9], 2.0)}
    # A is late, B is told the same again: neither changes.
    assert call(held, [("A", t[4], 1, t[9], 8.0), ("B", t[9], 1, t[9], 2.0)], 0) == {}
    millis = int(t[8].timestamp() * 1000)
    assert call(held, [("C", t[20], 0, t[20], 3.0)], millis) == {"C": (t[20], 3.0)}
    assert held.get[0] == ["B", "C"] and held.timeout == int(t[10].timestamp() * 1000)
    assert call(held, [], int(t[29].timestamp() * 1000)) == {} and not held.exists
