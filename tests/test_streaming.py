"""Streams equal their batch forms."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from quotemill.model import SERIES
from quotemill.operators import analysis as A
from quotemill.operators import quotes as Q
from quotemill.operators import signals as S
from quotemill.sources.tape import tape
from quotemill.streaming import quotes as stream
from quotemill.streaming import state


def drain(df, spark, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    spark.streams_done = [*getattr(spark, "streams_done", []), q.lastProgress]
    return spark.table(name)


def feed(spark, tmp_path, df, files=3):
    df.repartition(files).write.parquet(str(tmp_path / "feed"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))


def test_latest_stream_equals_batch(spark, tmp_path):
    quotes = tape(spark, "/root/testdata/sf0.001")
    got = drain(stream.latest(feed(spark, tmp_path, quotes)), spark, "latest_stream", "complete")
    assert {r.id for r in got.collect()} == {r.id for r in Q.latest(quotes).collect()}


def test_dedupe_stream(spark, tmp_path):
    at = datetime(2026, 1, 1)
    rows = [(i, 1, 1, "three_way", "f", "p", None, None, None, "1", Decimal(2), at + timedelta(minutes=i // 2)) for i in range(6)]
    schema = "id long, event_id long, bookmaker_id long, market_type string, market_period string, market_phase string, market_line string, market_rules string, market_specifier string, outcome string, odds decimal(18,6), observed_at timestamp"
    got = drain(stream.dedupe(feed(spark, tmp_path, spark.createDataFrame(rows, schema))), spark, "dedupe_stream", "append")
    assert got.count() == 3


def test_captures_carry_their_time(spark, tmp_path):
    (tmp_path / "drop").mkdir()
    (tmp_path / "drop" / "a.json").write_text('{"items": []}')
    got = drain(stream.watch_captures(spark, str(tmp_path / "drop")), spark, "captures_stream", "append").first()
    assert got.payload == '{"items": []}'
    assert got.observed_at is not None


def by_files(spark, folder, parts):
    """A stream of ``parts`` (data frames), a batch each, in their order."""
    import time

    for i, df in enumerate(parts):
        df.coalesce(1).write.parquet(f"{folder}/{i:03d}")
        time.sleep(0.02)  # the order of files is that of their times
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_signal_stream_equals_batch_whatever_the_order(spark, tmp_path, seed=1):
    """Rows up to an hour late; signals expire by timers where no sweep looks at them again; state falls to zero."""
    rng, t0 = random.Random(seed), datetime(2026, 1, 1, 10, 0, 0)
    at = [t0 + timedelta(seconds=s) for s in sorted(rng.sample(range(6 * 3600), 40))]
    start = {e: t0 + timedelta(minutes=rng.randrange(-180, 60), seconds=rng.randrange(60)) if e % 3 else None for e in range(9)}
    c, m, life = [], [], []
    for t in at:
        for e in range(9):
            for line in (None, "2.5"):
                kind = rng.choice("CCMNNN")
                if kind == "C":
                    c.append((e, line, t, start[e], float(rng.randrange(5))))
                if kind in "CM":
                    m.append((e, line, t, start[e]))
            if rng.random() < 0.05:
                life.append((e, t + timedelta(seconds=rng.randrange(-90, 90)), rng.choice(["finished", "live", "postponed_or_canceled"])))
    life += [(e, at[-1] + timedelta(minutes=2), "finished") for e in range(9) if not start[e]]
    end = t0 + timedelta(days=9)
    c.append((99, None, end, None, 1.0))  # moves the watermark past all else
    m.append((99, None, end, None))
    candidates = spark.createDataFrame(c, "event_id long, line string, sweep_ts timestamp, start_time timestamp, edge double")
    evaluated = spark.createDataFrame(m, "event_id long, line string, sweep_ts timestamp, start_time timestamp")
    lifecycle = spark.createDataFrame(life, "event_id long, updated_at timestamp, lifecycle string")
    key = ["event_id", "line"]
    log = state.signal_log(candidates, evaluated, lifecycle, key).cache()
    rows = sorted(log.collect(), key=lambda r: r.us + rng.randrange(3_500_000_000))
    lots = [rows[i : i + 250] for i in range(0, len(rows) - 2, 250)] + [rows[-2:]]
    source = by_files(spark, tmp_path / "log", [spark.createDataFrame(x, log.schema) for x in lots])
    got = drain(state.signals(source, key, 3, 60, 24, "1 hour"), spark, f"signals_{seed}", "append")
    ticks = spark.createDataFrame([(t0.replace(minute=0) + timedelta(minutes=i - 300),) for i in range(2400)], "sweep_ts timestamp")
    starts = spark.createDataFrame([(e, s) for e, s in start.items()], "event_id long, start_time timestamp")
    want = S.history(S.signals(candidates, evaluated, ticks, starts, lifecycle, key, 3), key)
    plain = lambda df: sorted(((r.event_id, r.line, r.sweep_ts, r.history_event, r.edge, r.status) for r in df.filter("event_id < 99").collect()), key=str)
    assert plain(got) == plain(want)
    assert {r.history_event for r in got.collect()} == {"created", "reactivated", "edge_peak", "resolved", "expired"}
    progress = spark.streams_done[-1]["stateOperators"][0]
    assert 0 < progress["numRowsTotal"] <= 5  # what is left is the last event's own


def test_movement_stream_equals_batch(spark, tmp_path):
    rng, t0 = random.Random(3), datetime(2026, 1, 1)
    rows = []
    for i in range(900):
        t = t0 + timedelta(minutes=rng.randrange(600))
        market = ("totals", "full_time", "pre_match", rng.choice([None, "2.5"]), None, None)
        rows.append((i, rng.randrange(6), rng.randrange(2), rng.choice([1, 2, None]), *market, rng.choice(["OVER", "UNDER"]), Decimal(rng.randrange(110, 400)) / 100, t, t - timedelta(minutes=rng.choice([0, 0, 30, 90]))))
    names = "id long, event_id long, bookmaker_id long, provider_id long, market_type string, market_period string, market_phase string, market_line string, market_rules string, market_specifier string, outcome string, odds decimal(18,6), observed_at timestamp, quote_time timestamp"
    df = spark.createDataFrame(rows, names)
    rng.shuffle(rows)
    source = by_files(spark, tmp_path / "quotes", [spark.createDataFrame(rows[i : i + 300], names) for i in range(0, 900, 300)])
    last = {}

    def keep(batch, number):
        for r in batch.collect():
            last[tuple(r[k] for k in SERIES)] = tuple(r)

    q = state.movements(source).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    want = A.movements(df)
    assert sorted(last.values(), key=str) == sorted(map(tuple, want.select(*state.movements(source).columns).collect()), key=str)
    assert sum(r.order_violation for r in want.collect()) > 0 and sum(r.detected for r in want.collect()) > 0
