"""Golden values and small cases of the quote operators."""

import random
import statistics
from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quotemill.functions import text as T
from quotemill.model import Freshness, Settings
from quotemill.operators import analysis as A
from quotemill.operators import identity as I
from quotemill.operators import operations as O
from quotemill.operators import quotes as Q
from quotemill.operators import reports as R
from quotemill.operators import signals as S
from quotemill.operators import validation as V
from quotemill.plans.detection import as_log, detect

T0 = datetime(2026, 1, 1, 12)
SCHEMA = (
    "id long, event_id long, bookmaker_id long, provider_id long, market_type string, market_period string, market_phase string, "
    "market_line string, market_rules string, market_specifier string, outcome string, odds decimal(18,6), observed_at timestamp_ntz, "
    "source_timestamp timestamp_ntz, quote_time timestamp_ntz"
)


def now():
    return F.lit(T0).cast("timestamp_ntz")


def quotes(spark, rows):
    """(id, bookmaker, outcome, odds, minutes before T0[, more])."""
    out = []
    for id_, book, outcome, odds, ago, *more in rows:
        x = dict(more[0]) if more else {}
        at = T0 - timedelta(minutes=ago)
        out.append((
            id_, x.get("event", 1), book, x.get("provider"), x.get("type", "three_way"), "full_time", x.get("phase", "pre_match"), x.get("line"), None, None,
            outcome, Decimal(str(odds)), x.get("observed", at), None, at,
        ))
    return spark.createDataFrame(out, SCHEMA)


def market(spark, one, x, two):
    return quotes(spark, [(1, 1, "1", one, 0), (2, 2, "X", x, 0), (3, 3, "2", two, 0)])


@pytest.mark.parametrize(("prices", "surebet"), [((2.20, 3.75, 3.60), True), ((2.00, 3.20, 3.20), False)])
def test_surebet_or_not(spark, prices, surebet):
    r = A.arbitrage(A.best_odds(market(spark, *prices))).first()
    assert r.is_surebet is surebet
    assert (r.profit_percent > 0) is surebet


def test_profit_of_a_known_margin(spark):
    r = A.arbitrage(A.best_odds(market(spark, 2, 4, 5))).first()
    assert r.margin == pytest.approx(0.95)
    assert r.profit_percent == pytest.approx(5.263, abs=1e-3)
    shares = [x.stake_percent for x in A.stakes(A.best_odds(market(spark, 2, 4, 5))).collect()]
    assert sum(shares) == pytest.approx(100)


def test_missing_and_extra_outcomes_are_not_evaluated(spark):
    missing = A.arbitrage(A.best_odds(quotes(spark, [(1, 1, "1", 2, 0), (2, 1, "X", 3, 0)]))).first()
    assert (missing.evaluated, missing.missing_outcomes, missing.margin) == (False, "2", None)
    extra = quotes(spark, [(1, 1, "1", 3, 0), (2, 1, "X", 4, 0), (3, 1, "2", 4, 0), (4, 1, "other", 9, 0)])
    assert not A.arbitrage(A.best_odds(extra)).first().evaluated
    odd = quotes(spark, [(1, 1, "1", 3, 0, {"type": "moneyline"})])
    assert A.arbitrage(odd).count() == 0
    assert [r.market_type for r in A.unsupported_types(odd).collect()] == ["moneyline"]


def test_best_price_tie_goes_to_the_smallest_bookmaker(spark):
    assert A.best_odds(quotes(spark, [(1, 5, "1", 2, 0), (2, 3, "1", 2, 0), (3, 4, "1", 1.9, 0)])).first().bookmaker_id == 3


def test_freshness_and_coherence(spark):
    policy = Freshness(60 * 60, 30 * 60, 10)
    rows = quotes(spark, [(1, 1, "1", 2, 0), (2, 2, "1", 2, 29), (3, 3, "1", 2, 61), (4, 1, "1", 2, 0, {"event": 2}), (5, 2, "1", 2, 31, {"event": 2})])
    assert {r.id for r in A.coherent(rows, policy, now()).collect()} == {1, 2}
    by = {r.event_id: r for r in A.freshness_summary(rows, policy, now()).collect()}
    assert (by[1].stale_sources, by[1].reason) == ("3", None)
    assert by[2].reason == "observation-spread-too-large"
    old = A.freshness_summary(quotes(spark, [(1, 1, "1", 2, 90)]), policy, now()).first()
    assert (old.reason, old.is_valid) == ("no-fresh-snapshots", False)
    ahead = quotes(spark, [(1, 1, "1", 2, -1)])
    assert A.coherent(ahead, policy, now()).count() == 0
    assert A.coherent(quotes(spark, [(1, 1, "1", 2, -0.1)]), policy, now()).count() == 1


def test_outliers_at_the_threshold(spark):
    rows = quotes(spark, [(1, 1, "1", 2.0, 0), (2, 2, "1", 2.0, 0), (3, 3, "1", 2.3, 0), (4, 4, "1", 1.7, 0)])
    assert {r.id for r in A.outliers(rows).collect()} == {3, 4}
    assert {r.id for r in A.value_gaps(rows).collect()} == {3}
    assert A.outliers(quotes(spark, [(1, 1, "1", 2, 0), (2, 2, "1", 3, 0)])).count() == 0


def test_exact_medians_without_lists(spark, capsys):
    rng, rows = random.Random(8), []
    for g in range(30):
        rows += [(g, Decimal(rng.randrange(100, 130)) / 100) for _ in range(rng.randrange(1, 40))] + [(g, None)]
    df = spark.createDataFrame(rows + [(99, None)], "g int, odds decimal(18,6)")
    got = {r.g: (r.n, r.median) for r in A.medians(df, ["g"]).collect()}
    of = {g: [o for x, o in rows if x == g and o is not None] for g in range(30)}
    assert got == {g: (len(v), statistics.median(v)) for g, v in of.items()}
    A.medians(df, ["g"]).explain()
    assert "collect_list" not in capsys.readouterr().out


def test_lag_of_five_minutes(spark):
    r = A.bookmaker_lag(quotes(spark, [(1, 1, "1", 2, 0), (2, 2, "1", 2, 5), (3, 3, "1", 2, 1)])).collect()
    assert [(x.id, x.lag_seconds) for x in r] == [(2, 300.0)]


def test_movement_halves(spark):
    r = A.movements(quotes(spark, [(1, 1, "1", 2.20, 3), (2, 1, "1", 1.10, 0)])).first()
    assert r.change_percent == pytest.approx(-50)
    assert r.detected


def test_movement_flags_disorder_instead_of_failing(spark):
    rows = quotes(spark, [(1, 1, "1", 2.2, 3, {"observed": T0}), (2, 1, "1", 1.1, 0, {"observed": T0 - timedelta(minutes=9)})])
    r = A.movements(rows).first()
    assert r.order_violation
    assert not r.detected


def test_movement_compares_one_provider_however_far_back(spark):
    rows = quotes(spark, [(1, 1, "1", 3, 9, {"provider": 1}), (2, 1, "1", 2, 5, {"provider": 2}), (3, 1, "1", 4, 0, {"provider": 1})])
    r = A.movements(rows).first()
    assert (r.previous_odds, r.current_odds) == (3, 4)
    unknown = quotes(spark, [(1, 1, "1", 3, 9), (2, 1, "1", 2, 5, {"provider": 2}), (3, 1, "1", 4, 0)])
    assert A.movements(unknown).first().previous_odds == 3


def test_latest_ignores_late_arrivals_and_keeps_phases_apart(spark):
    rows = quotes(spark, [(1, 1, "1", 2, 0), (2, 1, "1", 3, 10), (3, 1, "1", 4, 5, {"phase": "live"})])
    assert {r.id for r in Q.latest(rows).collect()} == {1, 3}


def test_latest_plan_limits_before_the_shuffle(spark):
    plan = Q.latest(quotes(spark, [(1, 1, "1", 2, 0)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_first_reading_wins_and_inserts_are_idempotent(spark):
    rows = quotes(spark, [(1, 1, "1", 2, 0), (2, 1, "1", 9, 0), (3, 1, "1", 2, 1)])
    assert {r.id for r in Q.first_wins(rows).collect()} == {1, 3}
    assert Q.insert_if_absent(Q.first_wins(rows), rows).count() == 0
    assert {r.id for r in Q.insert_if_absent(rows.limit(0), rows).collect()} == {1, 3}


def test_latest_equals_brute_force(spark):
    rng = random.Random(3)
    raw = [(i, rng.randrange(3), rng.choice("1X2"), round(rng.uniform(1.1, 5), 2), rng.randrange(20)) for i in range(200)]
    want = {}
    for r in raw:
        k = (r[1], r[2])
        if k not in want or (-r[4], r[0]) > (-want[k][4], want[k][0]):
            want[k] = r
    assert {r.id for r in Q.latest(quotes(spark, raw)).collect()} == {r[0] for r in want.values()}


def test_reports(spark):
    rows = market(spark, 2, 4, 5)
    top = R.opportunity_report(rows, Freshness(), now()).collect()
    assert [r.kind for r in top] == ["SUREBET"]
    moves = A.movements(quotes(spark, [(1, 1, "1", 2.20, 3), (2, 1, "1", 1.10, 0)]))
    assert R.movement_report(moves).first().elapsed == "3m00s"
    assert R.console_breakdown(rows, Freshness(), now()).first()["X"] == Decimal("4")
    assert R.text_lines(moves, {"bookmaker_id": 4, "outcome": 3}).first().line == "1    1"


def test_detection_cycle(spark):
    rows = market(spark, 2.2, 3.75, 3.6).unionByName(quotes(spark, [(9, 1, "1", 2, 0, {"event": 2})]))
    s = detect(rows, now(), Settings())
    assert [(r.signal_type, r.event_id) for r in s.candidates.collect()] == [("SUREBET", 1)]
    assert [(r.signal_type, r.event_id) for r in s.evaluated.collect()] == [("SUREBET", 1)]
    assert detect(rows, now(), Settings(), touched=spark.createDataFrame([(2,)], "event_id long")).candidates.count() == 0
    found, seen = as_log(s, now())
    assert found.first().sweep_ts == seen.first().sweep_ts == T0
    over = spark.createDataFrame([(1, "finished")], "event_id long, lifecycle string")
    assert detect(rows, now(), Settings(), over).candidates.count() == 0


# ---------------------------------------------------------------- validation


def record(**x):
    base = dict(source="s", sport="football", league="l", home_team="a", away_team="b", start_time="2026-01-01T10:00:00Z",
                observed_at="2026-01-01T09:00:00+01:00", source_timestamp=None, market_type="three_way", odds={"1": "2", "X": "3", "2": "4"})
    return base | x


RAW = (
    "source string, sport string, league string, home_team string, away_team string, start_time string, observed_at string, "
    "source_timestamp string, market_type string, odds map<string,string>"
)


@pytest.mark.parametrize(
    ("change", "stage", "codes"),
    [
        ({}, None, []),
        ({"home_team": " "}, "structural", ["missing-home-team"]),
        ({"home_team": "", "away_team": ""}, "structural", ["missing-home-team", "missing-away-team", "same-home-away-team"]),
        ({"home_team": "A "}, None, []),
        ({"home_team": "B "}, "structural", ["same-home-away-team"]),
        ({"market_type": None, "odds": {}}, "structural", ["missing-market", "missing-odds"]),
        ({"odds": None}, "structural", ["missing-odds"]),
        ({"observed_at": "2026-01-01T09:00:00"}, "semantic", ["naive-observed-at"]),
        ({"odds": {"1": "0.95", "X": "3", "2": "4"}}, "semantic", ["invalid-odds-value"]),
        ({"odds": {"1": "1.0", "X": "3", "2": "NaN"}}, "semantic", ["invalid-odds-value", "invalid-odds-value"]),
        ({"odds": {"1": "x", "X": "3", "2": "4"}}, "semantic", ["invalid-odds-type"]),
        ({"odds": {"1": "2", "X": "3"}}, "semantic", ["invalid-three-way-outcomes"]),
        ({"odds": {"OVER": "2"}, "market_type": "totals"}, None, []),
    ],
)
def test_validation(spark, change, stage, codes):
    r = V.validate(spark.createDataFrame([record(**change)], RAW)).first()
    assert (r.stage, r.errors) == (stage, codes)


def test_warning_and_reason(spark):
    r = V.validate(spark.createDataFrame([record(odds={"1": "1001", "X": "3", "2": "4"})], RAW)).first()
    assert (r.is_valid, r.warnings) == (True, ["suspiciously-high-odds"])
    bad = V.validate(spark.createDataFrame([record(home_team="", league="")], RAW))
    text = bad.select(V.rejection_reason(F.col("stage"), F.col("errors")).alias("r")).first().r
    assert text == "structural: missing-league, missing-home-team"


# ---------------------------------------------------------------- signals


def machine(kinds):
    """State machine of one identity, event by event: what the fold must equal."""
    status, episode, peak, out = None, 0, None, []
    for kind, edge, over in kinds:
        event = None
        if kind == "C":
            if status != "ACTIVE":
                event, episode, peak = "created" if status is None else "reactivated", episode + 1, edge
            elif edge > peak:
                event, peak = "edge_peak", edge
            status = "ACTIVE"
        elif status == "ACTIVE" and kind == "M":
            status, event = "RESOLVED", "resolved"
        elif status == "ACTIVE" and kind == "N" and over:
            status, event = "EXPIRED", "expired"
        out.append((status, event, peak if status else None))
    return out


def sweep_data(seed, identities=40, sweeps=15):
    """Rows a state machine reads: for each identity and sweep what was found (C), looked at in vain (M) or
    not looked at (N), and whether the event was over. Sweeps lie hours to days apart."""
    rng, at = random.Random(seed), [T0]
    while len(at) < sweeps:
        at.append(at[-1] + timedelta(minutes=rng.choice([1, 30, 700, 3000])))
    return [
        (i, at[s], k, float(rng.randrange(1, 6)) if k == "C" else None, rng.random() < 0.3)
        for i in range(identities)
        for s, k in enumerate(rng.choice("CMN") for _ in range(sweeps))
    ]


def logs(spark, rows, starts=()):
    """The append logs of such rows; an event is over by its statuses, which change between sweeps, or late."""
    c = [(i, None, t, e) for i, t, k, e, _ in rows if k == "C"]
    m = [(i, None, t) for i, t, k, _, _ in rows if k in "CM"]
    life = [(i, t - timedelta(seconds=20), "finished" if over else "live") for i, t, _, _, over in rows]
    return (
        spark.createDataFrame(c, "event_id long, line string, sweep_ts timestamp, edge double"), spark.createDataFrame(m, "event_id long, line string, sweep_ts timestamp"),
        spark.createDataFrame([(t,) for t in {r[1] for r in rows}], "sweep_ts timestamp"),
        spark.createDataFrame(list(starts), "event_id long, start_time timestamp"), spark.createDataFrame(life, "event_id long, updated_at timestamp, lifecycle string"),
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_signals_equal_the_state_machine(spark, seed):
    rows = sweep_data(seed)
    starts = [(i, T0 + timedelta(hours=i * 7)) for i in range(20)]
    ttl = timedelta(hours=3)
    rows = [(i, t, k, e, over or (i < 20 and T0 + timedelta(hours=i * 7) < t - ttl)) for i, t, k, e, over in rows]
    plain = [(*r[:4], r[4] and not (r[0] < 20 and T0 + timedelta(hours=r[0] * 7) < r[1] - ttl)) for r in rows]
    key = ["event_id", "line"]
    c, m, sweeps, begun, life = logs(spark, plain, starts)
    found = S.signals(c.union(c), m, sweeps, begun, life, key, 3)
    want, state, active = set(), {}, {t: [0, 0, False] for t in {r[1] for r in rows}}
    first = min(r[1] for r in rows if r[2] == "C")
    for i in range(40):
        own = [r for r in rows if r[0] == i]
        while own and own[0][2] != "C":
            own = own[1:]
        for r, (status, event, peak) in zip(own, machine([x[2:] for x in own]), strict=True):
            if event:
                want.add((i, r[1], event, r[3], status))
            state[i] = (status, peak)
            active[r[1]][0] += status == "ACTIVE" or event == "expired"
            active[r[1]][1] += status == "ACTIVE"
    got = [(r.event_id, r.sweep_ts, r.history_event, r.edge, r.status) for r in S.history(found, key).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r.event_id: (r.status, r.peak_edge) for r in S.current(found, key).collect()} == state
    counts = {r.sweep_ts: (r.active_before_expiry, r.active_after) for r in S.active_counts(found, sweeps).collect()}
    assert counts == {t: (a, b) for t, (a, b, _) in active.items() if t >= first}


def test_peak_is_not_regained(spark):
    rows = [(1, T0 + timedelta(minutes=i), "C", e, False) for i, e in enumerate((10.0, 8.0, 9.0))]
    found = S.signals(*logs(spark, rows), ["event_id", "line"], 3)
    assert [r.found_event for r in found.orderBy("sweep_ts").collect()] == ["created", None, None]


def test_signals_of_nothing_and_without_a_grid(spark, capsys):
    none = [x.filter("false") for x in logs(spark, sweep_data(1, 2, 2))]
    found = S.signals(*none, ["event_id", "line"], 3)
    assert [x.count() for x in (found, S.history(found, ["event_id"]), S.current(found, ["event_id"]), S.active_counts(found, none[2]))] == [0] * 4
    found.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_unevaluated_candidates_are_reported(spark):
    c = spark.createDataFrame([(1, T0), (2, T0)], "event_id long, sweep_ts timestamp")
    assert [r.event_id for r in S.check_sweeps(c, c.filter("event_id = 1"), ["event_id"]).collect()] == [2]


# ---------------------------------------------------------------- identity


def test_name_functions():
    assert T.comparison_key("  Ｕnited   STRASSE ß") == "united strasse ss"
    assert T.bookmaker_key("Bet-365 (UK)") == "bet365uk"
    assert T.common_subsequence("manchester united", "man united") == 10
    assert T.token_sort_ratio("manchester united", "man united") == pytest.approx(74.07, abs=0.01)
    assert T.token_sort_ratio("Barcelona FC", "FC Barcelona") == 100


def test_marks_keep_names_apart(spark):
    want = {
        "arsenal": "|", "arsenal u21": "21|age:21", "arsenal m21": "21|age:21", "barcelona b": "|group:b,reserve", "real 2 ii 10": "2/10|reserve",
        "lyon zene": "|women", "lyon žene w": "|women", "group a": "|group:a", "a group": "|", "": "|", "u u1x 3": "1/3|",
    }
    rows = spark.createDataFrame([(k,) for k in want], "k string").select("k", T.marks(F.col("k")).alias("m")).collect()
    assert {r.k: r.m for r in rows} == want
    ratio = T.ratio_udf()
    pairs = [("engleska 1", "engleska 3", False), ("real madrid", "real madrid", True), ("manchester unitd", "manchester united", True), ("arsenal", "arsenal u21", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean").select("want", T.alike(F.col("a"), F.col("b"), ratio("a", "b")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_country_key(spark):
    want = {" Engleska ": "england", "Juzna  Koreja": "south korea", "Narnia": "narnia", "": "", None: ""}
    rows = spark.createDataFrame([(n,) for n in want], "n string").select("n", T.country_key(F.col("n")).alias("k")).collect()
    assert {r.n: r.k for r in rows} == want


def test_token_expansion(spark):
    df = spark.createDataFrame([("man utd",), ("utd",), ("",)], "k string")
    got = [r[0] for r in df.select(T.expand_tokens(F.col("k"), {"utd": "united"})).collect()]
    assert got == ["man united", "united", ""]
    assert [r[0] for r in df.select(T.expand_tokens(F.col("k"), {})).collect()] == ["man utd", "utd", ""]


def test_canonical_line(spark):
    rows = spark.createDataFrame([("2.50",), ("2.5",), ("100",), ("-1",)], "x string").select(T.canonical_line(F.col("x")).alias("y"))
    assert [r.y for r in rows.collect()] == ["2.5", "2.5", "100", "-1"]


def test_name_cascade(spark):
    pool = spark.createDataFrame(
        [("s", "Manchester United"), ("s", "Arsenal"), ("s", "Arsenal U21"), ("s", "Rovers Alpha"), ("s", "Rovers Alphb")], "scope string, canonical_name string"
    )
    aliases = spark.createDataFrame([("Man Utd", "MANCHESTER UNITED"), ("Gunners", "The Gunners")], "alias string, target string")
    asked = ["man utd", "arsenal", "Manchester Unitd", "Arsenal U23", "Rovers Alph", "Nobody", "Gunners"]
    names = spark.createDataFrame([("s", n) for n in asked], "scope string, name string")
    got = {r.name: (r.canonical_name, r.method) for r in I.normalize_names(names, pool, aliases).collect()}
    assert got["man utd"] == ("Manchester United", "alias")
    assert got["arsenal"] == ("Arsenal", "exact")
    assert got["Manchester Unitd"] == ("Manchester United", "fuzzy")
    assert got["Arsenal U23"] == (None, "unknown")
    assert got["Rovers Alph"] == (None, "ambiguous")
    assert got["Nobody"] == (None, "unknown")
    assert got["Gunners"] == ("The Gunners", "alias")


def fixture(seq, source, home, away, minutes=0, league="Premier", country="England", event=None):
    return (seq, seq, "football", source, league, country, home, away, T0 + timedelta(minutes=minutes), event)


FIXTURE = (
    "id long, seq long, sport string, source string, league string, country string, home_team string, away_team string, "
    "start_time timestamp, source_event_id string"
)


def resolved(spark, *rows):
    return {r.id: r for r in I.resolve_records(spark.createDataFrame(list(rows), FIXTURE)).collect()}


def test_resolver_joins_sources_and_keeps_others_apart(spark):
    r = resolved(
        spark,
        fixture(1, "a", "Arsenal", "Chelsea"), fixture(2, "b", "ARSENAL", "Chelsea", 10), fixture(3, "c", "Arsenal", "Chelsea", 45),
        fixture(4, "d", "Arsenal U21", "Chelsea U21"), fixture(5, "e", "Arsenal", "Chelsea", country="Wales"),
        fixture(6, "f", "", "Chelsea"), fixture(7, "f", "Arsenal", "Arsenal"), fixture(8, "b", "ARSENAL", "Chelsea", 10),
    )
    assert r[1].event_id == r[2].event_id == r[8].event_id
    assert len({r[i].event_id for i in (1, 3, 4, 5)}) == 4
    assert (r[6].event_id, r[6].resolution) == (None, "missing-team-name")
    assert r[7].resolution == "home-equals-away"


def test_resolver_uses_the_fixture_as_context(spark):
    r = resolved(spark, fixture(1, "a", "Sabah Masazir", "Neftchi Baku"), fixture(2, "b", "Sabah", "Neftchi Baku", 5))
    assert r[2].resolution == "resolved-by-fixture-context"
    assert r[2].event_id == r[1].event_id


WIDE = FIXTURE + ", competition_source_id string, home_source_id string, away_source_id string"


def wide(seq, source, home, away, minutes=0, league="Premier", country="England", event=None, ids=(None, None, None)):
    return (*fixture(seq, source, home, away, minutes, league, country, event), *ids)


def with_entries(spark, *rows, **options):
    out, entries = I.resolve(spark.createDataFrame(list(rows), WIDE), **options)
    return {r.id: r for r in out.collect()}, entries.collect()


def targets(entries, kind, **match):
    return [e.target for e in entries if e.kind == kind and all(e[k] == v for k, v in match.items())]


def test_recycled_event_id_turns_suspect(spark):
    r, log = with_entries(spark, wide(1, "a", "Arsenal", "Chelsea", event="7"), wide(2, "a", "Leeds", "Fulham", 600, event="7"), wide(3, "a", "Leeds", "Fulham", 600, event="7"))
    assert r[1].event_id != r[2].event_id == r[3].event_id
    assert [e.state for e in log if e.kind == "event-id"] == ["VERIFIED", "SUSPECT", "VERIFIED"]  # the last doesn't count any more


def test_similar_names_make_new_identities(spark):
    r, log = with_entries(
        spark, wide(1, "a", "Crvena Zvezda Beograd", "Partizan"), wide(2, "b", "Crvena Zvezda Belgrade", "Vojvodina", 900),
        wide(3, "b", "Crvena Zvezda Belgrade", "Vojvodina", 900),
    )
    teams = {e.name: e.target for e in log if e.kind == "team"}
    assert teams["crvena zvezda beograd"] != teams["crvena zvezda belgrade"]
    assert [e.state for e in log if e.kind == "team-name" and e.name == "crvena zvezda belgrade"][0] == "UNVERIFIED"
    assert 85 <= r[2].confidence < 100


def test_source_ids_are_reused_and_drift_turns_suspect(spark):
    ids = ("L", "H", "A")
    r, log = with_entries(
        spark, wide(1, "a", "Manchester United", "Chelsea", ids=ids), wide(2, "a", "Manchester Utd", "Chelsea", 2000, ids=ids),
        wide(3, "a", "Leeds", "Chelsea", 4000, ids=ids),
    )
    home = targets(log, "team-id", name="H")
    assert home[0] == home[1]  # the name has changed a little: by id it is the same
    assert [e.method for e in log if e.kind == "team-id" and e.name == "H" and e.state == "SUSPECT"] == ["id-drift"]
    assert len({r[i].event_id for i in (1, 2, 3)}) == 3


def test_a_club_in_two_competitions_is_one_team(spark):
    _, log = with_entries(
        spark, wide(1, "a", "Arsenal", "Chelsea"), wide(2, "a", "Arsenal", "Leeds", 3000, league="Cup"), wide(3, "a", "Arsenal", "Penarth", 3000, country="Wales"),
    )
    teams = [(e.context, e.target) for e in log if e.kind == "team" and e.name == "arsenal"]
    assert len(teams) == 3 and len({t for _, t in teams}) == 2  # another country's is another club


def test_the_catalogue_goes_on_where_it_ended(spark):
    rows = [wide(1, "a", "Arsenal", "Chelsea", event="7"), wide(2, "b", "Leeds", "Fulham", 5), wide(3, "a", "Sabah Masazir", "Neftchi", 900), wide(4, "c", "Sabah", "Neftchi", 905)]
    rows += [wide(5, "b", "Arsenal", "Chelsea", 10), wide(6, "a", "Arsenal", "Chelsea", 3, event="7"), wide(7, "c", "Sabah", "Neftchi", 5000)]
    whole, log = with_entries(spark, *rows)
    first, entries = with_entries(spark, *rows[:4])
    kinds = f"sport string, lot string, no long, {I.ENTRY}"
    second, more = with_entries(spark, *rows[4:], catalogue=spark.createDataFrame(entries, kinds))
    assert {i: r.event_id for i, r in whole.items()} == {i: r.event_id for i, r in [*first.items(), *second.items()]}
    assert sorted(map(str, log)) == sorted(map(str, [*entries, *more]))
    assert {e.lot for e in log} == {"england"} and whole[4].resolution == "resolved-by-fixture-context"
    mapped = {(e.name, e.target) for e in log if e.kind == "team-name" and e.source == "c"}
    assert len({t for n, t in mapped if n == "sabah"}) == 1  # what the fixture taught holds later


def test_decisions_by_hand_count(spark):
    rows = [wide(1, "a", "Arsenal", "Chelsea"), wide(2, "b", "Gunners", "Leeds", 3000)]
    _, entries = with_entries(spark, *rows)
    arsenal = targets(entries, "team", name="arsenal")[0]
    comp = targets(entries, "competition")[0]
    by_hand = [*map(tuple, entries), ("football", "england", 999, "team-name", "b", "gunners", "|", comp, arsenal, "VERIFIED", "manual", None)]
    kinds = f"sport string, lot string, no long, {I.ENTRY}"
    r, more = with_entries(spark, wide(3, "b", "Gunners", "Chelsea", 5), catalogue=spark.createDataFrame(by_hand, kinds))
    first, _ = with_entries(spark, *rows)
    assert r[3].event_id == first[1].event_id


def test_reference_ids_and_kickoffs(spark):
    rows = [wide(1, "a", "Arsenal", "Chelsea"), wide(2, "ref", "Arsenal", "Chelsea", 10, ids=("L", "1", "2")), wide(3, "b", "Arsenal", "Chelsea", 20), wide(4, "ref", "Arsenal", "Spurs", 4000, ids=("L", "9", "3"))]
    r, log = with_entries(spark, *rows, reference="ref")
    assert r[1].event_id == r[2].event_id == r[3].event_id
    assert [(e.source, e.at - T0.replace(tzinfo=UTC).timestamp()) for e in log if e.kind == "kickoff"] == [("ref", 600.0)]
    same_name = {e.target for e in log if e.kind == "team" and e.name == "arsenal"}
    assert len(same_name) == 2  # the reference provider says that these are two
    assert {(e.context, e.name) for e in log if e.kind == "reference"} >= {("team", "1"), ("team", "9"), ("competition", "L")}


def test_token_aliases(spark):
    r, _ = with_entries(spark, wide(1, "a", "Manchester United", "Leeds"), wide(2, "b", "Manchester Utd", "LEEDS FC"), tokens={"utd": "united"}, aliases={"Leeds FC": "Leeds"})
    assert r[1].event_id == r[2].event_id and r[2].confidence == 100


def test_countries_run_apart_only_if_nothing_crosses(spark):
    rows = [wide(1, "a", "Arsenal", "Chelsea"), wide(2, "a", "Real", "Betis", country="Spain")]
    assert {e.lot for e in with_entries(spark, *rows)[1]} == {"england", "spain"}
    assert {e.lot for e in with_entries(spark, *rows, wide(3, "b", "Real", "Betis", country=None))[1]} == {""}
    crossing = [wide(1, "a", "Arsenal", "Chelsea", ids=(None, "7", None)), wide(2, "a", "Arsenal", "Betis", country="Spain", ids=(None, "7", None))]
    assert {e.lot for e in with_entries(spark, *crossing)[1]} == {""}


def test_guarded_mapping_log(spark):
    rows = [("k", 1, "UNVERIFIED", False, "x"), ("k", 2, "SUSPECT", False, "x"), ("k", 3, "VERIFIED", False, "y"), ("k", 4, "VERIFIED", True, "z"), ("q", 1, "UNVERIFIED", False, "a"), ("q", 2, "VERIFIED", False, "b")]
    log = spark.createDataFrame(rows, "key string, seq int, trust_state string, override boolean, target string")
    frozen = ("SUSPECT", "REJECTED")
    assert {r.key: r.target for r in O.mapping_view(log, ["key"], "seq", frozen).collect()} == {"k": "z", "q": "b"}
    assert {r.key: r.target for r in O.mapping_view(log.filter("seq < 4"), ["key"], "seq", frozen).collect()} == {"k": "x", "q": "b"}


# ---------------------------------------------------------------- operations

RUNS = "id long, source string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, source_payload string, error_type string"


def test_provider_health_streak_and_staleness(spark):
    states = ["success", "failed", "failed"]
    rows = [(i, "s", T0 - timedelta(hours=3 - i), T0, s, None if s == "success" else "p", None) for i, s in enumerate(states)]
    r = O.provider_health(spark.createDataFrame(rows, RUNS), now()).first()
    assert (r.consecutive_failures, r.last_status, r.last_fresh_at, r.is_stale) == (2, "failed", None, True)
    many = [(i, "s", T0 - timedelta(minutes=i), T0, "failed", None, None) for i in range(80)]
    assert O.provider_health(spark.createDataFrame(many, RUNS), now()).first().consecutive_failures == 50


def test_running_payload_is_kept(spark):
    rows = [(1, "s", T0 - timedelta(days=30), None, "running", "p", None), (2, "s", T0 - timedelta(days=30), T0 - timedelta(days=29), "success", "p", None)]
    out = {r.id: r.source_payload for r in O.cleared_payloads(spark.createDataFrame(rows, RUNS), 14, now()).collect()}
    assert out == {1: "p", 2: None}
    states = {r.id: (r.status, r.error_type) for r in O.recover_stale(spark.createDataFrame(rows, RUNS), now()).collect()}
    assert states == {1: ("failed", "process_interrupted"), 2: ("success", None)}


def test_orphans_use_an_equi_join(spark):
    teams = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    events = spark.createDataFrame([(1, 1, 2)], "id long, home_team_id long, away_team_id long")
    out = O.orphan_teams(teams, events)
    assert [r.id for r in out.collect()] == [3]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_merge_repoints_to_the_survivor(spark):
    events = spark.createDataFrame([(1, "k"), (2, "k"), (3, "z")], "id long, key string")
    snaps = spark.createDataFrame([(2,), (2,), (1,)], "event_id long")
    m = O.survivors(events, snaps, ["key"])
    assert {r.id: r.survivor_id for r in m.collect()} == {1: 2, 2: 2}
    assert sorted(r.event_id for r in O.repoint(snaps, "event_id", m).collect()) == [2, 2, 2]


def test_sources_due(spark):
    runs = spark.createDataFrame([(1, "a", T0 - timedelta(hours=1), T0, "success", None, None)], RUNS)
    sources = spark.createDataFrame([("a", 4000), ("b", 4000)], "source string, min_interval_seconds int")
    assert [r.source for r in O.sources_due(runs, sources, now()).collect()] == ["b"]


def test_offsets_of_timestamps(spark):
    has = ["2026-01-01T10:00:00Z", "2026-01-01T10:00:00+01", "2026-01-01 10:00-0330", "2026-01-01T10:00:00.123+05:30", "2026-01-01T10:00:00+05:30:15", "20260101T1000-05"]
    hasn = ["2026-01-01T10:00:00", "2026-01-01", "2026-01-01 10:00", "20260101T1000", "2026-01-01T10:00:00.123", ""]
    df = spark.createDataFrame([(x,) for x in has + hasn + [None]], "t string")
    assert [r.n for r in df.select(V.naive("t").alias("n")).collect()] == [False] * len(has) + [True] * len(hasn) + [False]


def test_ids_tell_parts_apart(spark):
    rows = spark.createDataFrame([("x", None), (None, "x"), ("x|y", "z"), ("x", "y|z"), ("x", "null")], "a string, b string")
    ids = [r.i for r in rows.select(I.stable_id("team", F.col("a"), F.col("b")).alias("i")).collect()]
    assert len(set(ids)) == 5 and all(len(i) == len("team-") + 32 for i in ids)
    assert len({I._new_id("t", *p) for p in [("x", None), (None, "x"), ("x|y", "z"), ("x", "y|z"), ("x", "None")]}) == 5


def test_keys_of_names_outside_ascii(spark):
    names = ["Bet365", "Ｂｅｔ３６５", "Café  Bar", "Café Bar", "STRASSE", "Straße", None, " a\tb "]
    df = spark.createDataFrame([(n,) for n in names * 2], "n string")
    got = {(r.n, r.c, r.b) for r in T.with_key(T.with_key(df, "n", "c"), "n", "b", "bookmaker").collect()}
    assert got == {(n, T.comparison_key(n), T.bookmaker_key(n)) for n in names}
    assert T.with_key(df, "n", "c").count() == 16


def _fixture(i, **k):
    base = {"id": i, "seq": i, "sport": "football", "source": "s", "league": "Premier League", "country": "", "home_team": "Leeds", "away_team": "Everton", "start_time": T0}
    base |= {c: None for c in ("source_event_id", "competition_source_id", "home_source_id", "away_source_id")}
    return base | k


_FIXTURE = "id long, seq long, sport string, source string, league string, country string, home_team string, away_team string, start_time timestamp, source_event_id string, competition_source_id string, home_source_id string, away_source_id string"


def _resolved(spark, rows, **options):
    found, entries = I.resolve(spark.createDataFrame([tuple(r.values()) for r in rows], _FIXTURE), **options)
    return {r.id: r for r in found.collect()}, [r for r in entries.collect()]


def test_a_drifted_id_is_not_trusted(spark):
    rows = [_fixture(1, home_team="Manchester United", home_source_id="H"), _fixture(2, home_team="Leeds", home_source_id="H", source_event_id="E2", start_time=T0 + timedelta(days=1))]
    _, log = _resolved(spark, rows)
    state = {(e.kind, e.name): e.state for e in sorted(log, key=lambda e: e.no)}
    assert state["team-id", "H"] in ("SUSPECT", "UNVERIFIED") and any(e.kind == "team-id" and e.state == "SUSPECT" for e in log)
    assert state["team-name", "leeds"] == "UNVERIFIED" and state["event-id", "E2"] == "UNVERIFIED" and state["team-name", "everton"] == "VERIFIED"
    assert [e.state for e in log if e.kind == "team" and e.name == "leeds"] == ["UNVERIFIED"]


def test_reference_ids_keep_competitions_apart(spark):
    rows = [_fixture(1, competition_source_id="L1", country=""), _fixture(2, competition_source_id="L2", start_time=T0 + timedelta(days=2))]
    found, log = _resolved(spark, rows, reference="s")
    assert len({e.target for e in log if e.kind == "competition"}) == 2 and found[1].event_id != found[2].event_id
    assert len({e.target for e in _resolved(spark, rows)[1] if e.kind == "competition"}) == 1


def test_a_name_outside_its_context_counts_by_hand_only(spark):
    entry = lambda no, kind, name, target, method, context="": ("football", "", no, kind, "s", name, "|", context, target, "VERIFIED", method, None)
    for method, used in (("manual", True), ("exact", False)):
        log = [entry(0, "competition", "elsewhere", "c0", "unknown", "spain"), entry(1, "team", "leeds united", "t1", "unknown", "c0"), entry(2, "team-name", "leeds", "t1", method)]
        catalogue = spark.createDataFrame(log, f"sport string, lot string, no long, {I.ENTRY}")
        _, new = _resolved(spark, [_fixture(1)], catalogue=catalogue)
        assert any(e.kind == "team" and e.target == "t1" for e in new) == used
