"""Ingestion end to end, trust decisions, audit, logs."""

import json
import logging
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quotemill.functions.aliases import LEAGUE_ALIASES, TEAM_ALIASES, TOKEN_ALIASES
from quotemill.operators import counters as C
from quotemill.operators import mappings as M
from quotemill.operators import operations as O
from quotemill.operators import sinks
from quotemill.plans import ingestion
from quotemill.sources import feeds, registry
from quotemill.streaming import observe

T0 = datetime(2026, 1, 1)


def dirty():
    row = {"bookmaker": "Good", "sport": "football", "league": "L", "home_team": "Manchester United", "away_team": "Liverpool", "start_time": "2026-09-01T20:00:00+00:00", "observed_at": "2026-08-27T10:00:00+00:00", "odds": {"1": 2.15, "X": 3.45, "2": 3.2}}
    return [
        row, row | {"bookmaker": "Empty", "home_team": ""}, row | {"bookmaker": "Naive", "observed_at": "2026-08-27T10:01:00"},
        row | {"bookmaker": "Low", "odds": {"1": 0.95, "X": 3, "2": 4}}, row | {"bookmaker": "Ghost", "home_team": "Nobody", "away_team": "None"},
    ]


def test_dirty_file_keeps_the_valid_row(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps(dirty()))
    records = feeds.flat_quotes(spark, str(tmp_path / "f.json")).withColumn("id", F.monotonically_increasing_id())
    events = spark.createDataFrame([("event-1", "football", "L", "Manchester United", "Liverpool", datetime(2026, 9, 1, 20, 10)), ("event-2", "football", "Cup", "Manchester United", "Liverpool", datetime(2026, 9, 1, 20, 5))], "id string, sport string, league string, home_team string, away_team string, start_time timestamp")
    out = ingestion.ingest(records, lambda r: ingestion.known_events(r, events), "run-1", F.current_timestamp())
    run = out.run.first()
    assert (run.records_received, run.records_accepted, run.records_rejected, run.status) == (5, 1, 4, "partial")
    snaps = out.snapshots.collect()
    assert {(s.event_id, s.bookmaker_name) for s in snaps} == {("event-1", "Good")}
    assert {s.outcome: s.odds for s in snaps} == {"1": Decimal("2.15"), "X": Decimal("3.45"), "2": Decimal("3.2")}
    reasons = {p.source: p.rejection_reason for p in out.payloads.collect()}
    assert len(reasons) == 5 and reasons["Good"] is None
    assert [reasons[k].split(":")[0] for k in ("Empty", "Naive", "Low", "Ghost")] == ["structural", "semantic", "semantic", "identity"]


def test_ingestion_against_a_catalogue(spark, tmp_path):
    row = dirty()[0]
    first = [row | {"bookmaker": "One"}, row | {"bookmaker": "Two", "home_team": "Man Utd", "away_team": "Liverpool FC"}, row | {"bookmaker": "Blank", "home_team": " "}]
    second = [row | {"bookmaker": "Two", "home_team": "Man. United", "start_time": "2026-09-01T20:05:00+00:00"}]
    log, events = None, []
    for n, rows in enumerate((first, second)):
        (tmp_path / f"{n}.json").write_text(json.dumps(rows))
        records = feeds.flat_quotes(spark, str(tmp_path / f"{n}.json")).withColumn("id", F.monotonically_increasing_id())
        resolve = ingestion.Catalogue(log, TEAM_ALIASES | LEAGUE_ALIASES, TOKEN_ALIASES)
        out = ingestion.ingest(records, resolve, f"run-{n}", F.current_timestamp())
        events += [s.event_id for s in out.snapshots.select("event_id", "bookmaker_name").distinct().collect()]
        sinks.append(resolve.entries, str(tmp_path / "catalogue"))
        log = spark.read.parquet(str(tmp_path / "catalogue"))
    assert len(events) == 3 and len(set(events)) == 1
    assert {r.name for r in log.filter("kind = 'team'").collect()} == {"manchester united", "liverpool"}


def test_movements_are_appended_once(spark, tmp_path):
    row = (1, 2, "three_way", "f", "p", None, None, None, "1", Decimal("2.2"), Decimal("1.1"), T0, T0 + timedelta(minutes=3))
    schema = "event_id long, bookmaker_id long, market_type string, market_period string, market_phase string, market_line string, market_rules string, market_specifier string, outcome string, previous_odds decimal(18,6), current_odds decimal(18,6), previous_observed_at timestamp, current_observed_at timestamp"
    found = spark.createDataFrame([row, row], schema)
    first = sinks.new_movements(found.limit(0), found)
    assert first.count() == 1
    sinks.append(first, str(tmp_path / "m"))
    assert sinks.new_movements(spark.read.parquet(str(tmp_path / "m")), found).count() == 0


def test_decisions_by_hand(spark):
    log = spark.createDataFrame([("k", 1, "SUSPECT", False, "x", None, None)], "key string, seq int, trust_state string, override boolean, target string, rejection_reason string, rejected_at timestamp")
    keys = spark.createDataFrame([("k",), ("missing",)], "key string")
    now = F.lit(T0)
    verified = log.unionByName(M.decide(log, keys, ["key"], M.VERIFIED, now))
    assert [r.trust_state for r in O.mapping_view(verified, ["key"], "seq", ("SUSPECT", "REJECTED")).collect()] == ["VERIFIED"]
    rejected = M.decide(verified, keys, ["key"], M.REJECTED, now, "wrong club").first()
    assert (rejected.rejection_reason, rejected.rejected_at) == ("wrong club", T0)
    with pytest.raises(ValueError, match="reason"):
        M.decide(log, keys, ["key"], M.REJECTED, now)
    methods = spark.createDataFrame([("fuzzy",), ("exact",), ("unknown",)], "m string").select(M.trust_of(F.col("m")).alias("t"))
    assert [r.t for r in methods.collect()] == ["UNVERIFIED", "VERIFIED", "VERIFIED"]


def test_countries_references_and_kickoffs(spark):
    comps = spark.createDataFrame([(1, "England"), (2, "Engleska"), (3, "Wales"), (4, None)], "id long, country string")
    known = spark.createDataFrame([(10, 1), (11, 4)], "team_id long, competition_id long")
    asked = spark.createDataFrame([(10, 2), (10, 3), (10, 4), (11, 3), (12, 3)], "team_id long, competition_id long")
    got = {(r.team_id, r.competition_id) for r in M.country_compatible(asked, known, comps).collect()}
    assert got == {(10, 2), (10, 4), (11, 3), (12, 3)}
    schema = "id long, reference_provider string, reference_provider_id string"
    entities = spark.createDataFrame([(1, None, None), (2, "r", "5"), (3, None, None), (4, None, None)], schema)
    claims = spark.createDataFrame([(1, "r", "5"), (2, "r", "6"), (3, "r", "7"), (4, "r", "8"), (1, "r", "8")], schema)
    assert {(r.id, r.reference_provider_id) for r in M.promotable(entities, claims).collect()} == {(3, "7")}
    events = spark.createDataFrame([(1, T0, "a", None), (2, T0, "a", "ref"), (3, T0, None, None)], "id long, start_time timestamp, start_time_provider string, reference_provider string")
    late = T0 + timedelta(hours=1)
    seen = spark.createDataFrame([(1, "b", late, 1), (1, "a", late, 2), (2, "a", late, 1), (3, "ref", late, 1)], "event_id long, provider_id string, start_time timestamp, seq int")
    out = {r.id: (r.start_time, r.reference_provider) for r in M.synced_kickoffs(events, seen, "ref").collect()}
    assert out == {1: (late, None), 2: (T0, "ref"), 3: (late, "ref")}


def test_audit_codes(spark):
    ev = spark.createDataFrame([(1, "s", 1, 1, 2, T0), (2, "s", 1, 1, 2, T0)], "id long, sport string, competition_id long, home_team_id long, away_team_id long, start_time timestamp")
    ent = "id long, sport string, canonical_name string, country string, identity_status string, reference_provider string"
    teams = spark.createDataFrame([(i, "s", f"t{i}", None, st, None) for i, st in ((1, "PROVISIONAL"), (2, "CONFLICT"), (3, "PROVISIONAL"), (4, "PROVISIONAL"))], ent)
    comps = spark.createDataFrame([(1, "s", "Cup", None, "PROVISIONAL", None), (2, "s", "Cup", "England", "PROVISIONAL", None)], ent)
    maps = "source string, source_id string, target_id long, trust_state string"
    tables = {
        "events": ev, "teams": teams, "competitions": comps,
        "team_mappings": spark.createDataFrame([("a", "1", 3, "VERIFIED"), ("a", "1", 1, "SUSPECT"), ("a", "2", 2, "REJECTED")], maps),
        "competition_mappings": spark.createDataFrame([], maps),
    }
    got = {r.code: (r.severity, r.n) for r in C.audit(tables).collect()}
    assert got == {
        "duplicate-canonical-events": ("ERROR", 1), "orphan-provisional-teams": ("WARNING", 2), "gc-safe-provisional-teams": ("INFO", 1),
        "protected-orphan-teams": ("WARNING", 1), "conflicting-teams": ("ERROR", 1), "orphan-provisional-competitions": ("WARNING", 1),
        "gc-safe-provisional-competitions": ("INFO", 1), "unresolved-team_mappings": ("ERROR", 1), "rejected-team_mappings": ("WARNING", 1),
        "multiple-reference-ids-team_mappings": ("ERROR", 1), "countryless-competition-collisions": ("WARNING", 1),
    }


def test_collectors_due(spark):
    runs = spark.createDataFrame([("a", T0)], "source string, started_at timestamp")
    made = [registry.Collector(n, "p", "1", lambda c: c, 7200) for n in ("a", "b")]
    assert [c.source for c in registry.due(made, runs, F.lit(T0 + timedelta(hours=1)))] == ["b"]
    assert len(registry.due(made, runs, F.lit(T0 + timedelta(hours=2)))) == 2
    one = registry.collect(made[0], runs)
    assert registry.all_records([one, one]).count() == 2


def test_logs_and_counters():
    record = logging.makeLogRecord({"msg": "run.done", "levelname": "INFO", "name": "q", "rows": 5})
    assert json.loads(observe.JsonLines().format(record))["rows"] == 5
    m = observe.Metrics()
    m.record({"status": "partial", "records_received": 5, "records_accepted": 1, "records_rejected": 4}, {"semantic": 2})
    assert m.snapshot()["rejected.semantic"] == 2


def test_alias_tables():
    assert (len(TEAM_ALIASES), len(TOKEN_ALIASES), len(LEAGUE_ALIASES)) == (67, 2, 22)
