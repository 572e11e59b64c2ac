"""Tables by day: pruned inserts and clean-ups."""

import os
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quotemill.operators import daily

KEY = ["event_id", "line", "observed_at"]
SCHEMA = "id long, event_id long, line string, observed_at timestamp"
AT = datetime(2026, 1, 10, 12, tzinfo=UTC)


def rows(*days, first=0):
    """Three series a day, one without a line."""
    return [(first + 3 * i + j, j, None if j == 1 else "2.5", AT + timedelta(days=d)) for i, d in enumerate(days) for j in range(3)]


def files(folder):
    return {str(p.relative_to(folder)): os.stat(p).st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def ids(spark, folder):
    return sorted(r.id for r in spark.read.parquet(str(folder)).collect())


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_absent_equals_a_set(spark, tmp_path, most):
    folder = str(tmp_path / "t")
    old, new = rows(0, 1, 2, 3), rows(2, 3, 4, first=100) + [(200, 1, "2.5", AT + timedelta(days=2)), (201, 1, "", AT), (202, None, None, AT), (203, 1, None, None)]
    daily.append_days(spark.createDataFrame([*old, (50, 1, None, None)], SCHEMA), folder, "observed_at")
    batch = spark.createDataFrame(new, SCHEMA)
    got = daily.absent(daily.stored(spark, folder, batch), batch, KEY, "observed_at", most)
    known = {r[1:] for r in [*old, (50, 1, None, None)]}
    assert sorted(r.id for r in got.collect()) == sorted(r[0] for r in new if r[1:] not in known)
    assert got.columns == ["id", "event_id", "line", "observed_at"]


def test_insert_is_repeatable(spark, tmp_path):
    folder = str(tmp_path / "t")
    for batch in (rows(0, 1), rows(0, 1), rows(1, 2, first=10), rows(1, 2, first=20) + rows(5, first=30), []):
        daily.insert_absent(spark.createDataFrame(batch, SCHEMA), folder, KEY, "observed_at")
    assert ids(spark, folder) == [0, 1, 2, 3, 4, 5, 13, 14, 15, 30, 31, 32]
    assert spark.read.parquet(folder).filter("event_id = 1 and line is null").count() == 4


def test_history_is_pruned_and_not_shuffled(spark, tmp_path):
    folder = str(tmp_path / "t")
    daily.append_days(spark.createDataFrame(rows(*range(20)), SCHEMA), folder, "observed_at")
    batch = spark.createDataFrame(rows(3), SCHEMA)
    plan = daily.absent(daily.stored(spark, folder, batch), batch, KEY, "observed_at")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [" in scan and "2026-01-13" in scan.split("PartitionFilters: ")[1]
    known = plan[plan.index("FileScan") - 600 : plan.index("FileScan")]
    assert "BroadcastHashJoin" in known and "hashpartitioning" not in known
    with pytest.raises(ValueError, match="part of the key"):
        daily.absent(batch, batch, ["event_id"], "observed_at")


def test_many_days_are_a_range(spark, monkeypatch):
    monkeypatch.setattr(daily, "NAMED_DAYS", 2)
    batch = spark.createDataFrame(rows(0, 3, 6) + [(99, 0, None, None)], SCHEMA)
    table = batch.withColumn(daily.DAY, daily.day_of("observed_at")).unionByName(
        spark.createDataFrame(rows(1, 7, -1), SCHEMA).withColumn(daily.DAY, daily.day_of("observed_at"))
    )
    assert table.filter(daily.touched(batch, "observed_at")).count() == 9 + 1 + 3
    only = spark.createDataFrame([(99, 0, None, None)], SCHEMA)
    assert table.filter(daily.touched(only, "observed_at")).count() == 1


def test_clean_removes_days_and_rewrites_one(spark, tmp_path):
    folder = tmp_path / "t"
    spread = [(i, i % 3, None, AT + timedelta(hours=6 * i)) for i in range(20)]  # until the 15th, 06:00
    daily.append_days(spark.createDataFrame([*spread, (99, 0, None, None)], SCHEMA).coalesce(1), str(folder), "observed_at")
    limit = daily.limit_of(3, AT + timedelta(days=5, hours=1))  # the 12th, 13:00
    before = files(folder)
    found = daily.expired(spark, str(folder), "observed_at", limit)
    assert found.agg(F.sum("rows")).first()[0] == sum(r[3] < limit for r in spread) == 9
    assert files(folder) == before  # a dry run
    assert daily.clean(spark, str(folder), "observed_at", limit) == 9
    assert ids(spark, folder) == [r[0] for r in spread if r[3] >= limit] + [99]
    after = files(folder)
    later = {f for f in before if f.split("/")[0] not in {f"_day=2026-01-1{d}" for d in (0, 1, 2)}}
    assert later and all(after[f] == before[f] for f in later) and not any("2026-01-11" in f for f in after)
    assert daily.clean(spark, str(folder), "observed_at", limit) == 0 and files(folder) == after


def test_clean_to_the_end_of_a_day(spark, tmp_path):
    folder = str(tmp_path / "t")
    daily.append_days(spark.createDataFrame(rows(0, 1), SCHEMA), folder, "observed_at")
    # nothing of the 10th is left, though it is the day of the limit
    assert daily.clean(spark, folder, "observed_at", AT + timedelta(hours=1)) == 3
    assert ids(spark, folder) == [3, 4, 5]


def test_clear_keeps_rows_and_running_runs(spark, tmp_path):
    folder = str(tmp_path / "t")
    runs = [(1, "a", AT - timedelta(days=30)), (2, None, AT - timedelta(days=30)), (3, "c", AT - timedelta(days=2)), (4, "d", None), (5, "e", AT - timedelta(days=29))]
    daily.append_days(spark.createDataFrame(runs, "id long, source_payload string, finished_at timestamp"), folder, "finished_at")
    before = files(folder)
    assert daily.clear(spark, folder, "finished_at", "source_payload", daily.limit_of(14, AT)) == 2
    assert {r.id: r.source_payload for r in spark.read.parquet(folder).collect()} == {1: None, 2: None, 3: "c", 4: "d", 5: None}
    kept = {f: t for f, t in before.items() if "2025-12" not in f}
    assert len(kept) >= 2 and kept.items() <= files(folder).items()
    assert daily.clear(spark, folder, "finished_at", "source_payload", daily.limit_of(14, AT)) == 0
