"""Merging, nearest events and digest trees against plain Python."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quotemill.operators import identity as I
from quotemill.operators import merging as G
from quotemill.plans.coverage import _duplicated
from quotemill.plans.queries import QUERIES
from quotemill.sources import landing

T0 = datetime(2026, 1, 1)


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_pairs(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)] + [(400, 400 + i) for i in range(1, 50)] + [(5, 5)]
    u = Union()
    for a, b in pairs:
        u.join(a, b)
    want = {x: u.find(x) for p in pairs for x in p if u.find(x) != x}
    assert {r.id: r.label for r in G.connected(spark.createDataFrame(pairs, "a long, b long")).collect()} == want
    assert G.connected(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def by_hand(comps, teams, events, ids):
    """A union-find over all identities, until a pass changes nothing."""
    c, t, e = Union(), Union(), Union()
    rows = {r.id: r for r in events}
    moved = True
    while moved:
        moved = False
        seen = {}
        def one(u, kind, key, x):
            nonlocal moved
            if None not in key:
                moved |= u.join(seen.setdefault((kind, *key), x), x)
        for r in comps:
            one(c, "c", (r.sport, r.country, r.name), r.id)
        for r in teams:
            one(t, "t", (None if r.competition_id is None else c.find(r.competition_id), r.name), r.id)
        for r in events:
            one(e, "e", (c.find(r.competition_id), t.find(r.home_team_id), t.find(r.away_team_id), r.start_time), r.id)
        for r in ids:
            x = rows[r.event_id]
            one(e, "se", (r.source, r.source_event_id), x.id)
            one(c, "sc", (r.source, r.source_event_id), x.competition_id)
            one(t, "sh", (r.source, r.source_event_id), x.home_team_id)
            one(t, "sa", (r.source, r.source_event_id), x.away_team_id)
    return {(k, x.id, u.find(x.id)) for k, u, all_ in (("competition", c, comps), ("team", t, teams), ("event", e, events)) for x in all_ if u.find(x.id) != x.id}


def test_merged_identities_equal_a_union_find(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["merged_identities"](spark, sf)
    want = by_hand(*[x.collect() for x in _duplicated(spark, sf)])
    assert {tuple(r) for r in got.collect()} == want
    assert {k for k, _, _ in want} == {"competition", "team", "event"}


@pytest.mark.parametrize("seed", [3, 4])
def test_merging_cascades(spark, seed):
    """Small worlds in which one merge leads to the next."""
    rng = random.Random(seed)
    comps = spark.createDataFrame([(i, "f", rng.choice(["", "x"]), f"n{rng.randrange(5)}") for i in range(8)] + [(8, "f", None, "n1")], "id long, sport string, country string, name string")
    teams = spark.createDataFrame([(i, rng.randrange(9), f"t{rng.randrange(12)}") for i in range(60)] + [(60, None, "t1"), (61, 1, None)], "id long, competition_id long, name string")
    events = spark.createDataFrame([(i, rng.randrange(9), rng.randrange(60), rng.randrange(60), T0 + timedelta(days=rng.randrange(2))) for i in range(80)], "id long, competition_id long, home_team_id long, away_team_id long, start_time timestamp")
    ids = spark.createDataFrame([(rng.choice("ab"), rng.choice([None, *range(40)]), rng.randrange(80)) for _ in range(14)], "source string, source_event_id int, event_id long")
    got = G.merged(comps, teams, events, ids)
    assert {tuple(r) for r in got.collect()} == by_hand(comps.collect(), teams.collect(), events.collect(), ids.collect())


def test_each_kind_is_resolved_once(spark, monkeypatch):
    """A chain over all kinds costs no rounds: ids are in several groups, name parts are null, events have ids twice."""
    comps = [(1, "f", "", "a"), (2, "f", "", "a"), (3, "f", "", "b"), (3, "f", "", "c"), (4, "f", "", "c"), (5, "f", "", "b"), (None, "f", "", "a")]
    teams = [(10, 1, "x"), (11, 2, "x"), (12, 4, "y"), (13, 5, "y"), (14, 77, "x"), (15, None, "x"), (11, 4, "y")]
    events = [(20, 1, 10, 12, T0), (21, 2, 11, 13, T0), (22, 3, 14, 15, T0), (23, 5, 13, 14, T0), (24, 1, 10, 12, T0 + timedelta(days=1))]
    ids = [("p", "1", 24), ("p", "1", 22), ("q", "1", 22), ("q", "1", 23), ("q", None, 20), ("p", "9", 99)]
    made = [
        spark.createDataFrame(comps, "id long, sport string, country string, name string"), spark.createDataFrame(teams, "id long, competition_id long, name string"),
        spark.createDataFrame(events, "id long, competition_id long, home_team_id long, away_team_id long, start_time timestamp"), spark.createDataFrame(ids, "source string, source_event_id string, event_id long"),
    ]
    calls, own = [], G.connected
    monkeypatch.setattr(G, "connected", lambda pairs: calls.append(1) or own(pairs))
    got = {(r.kind, r.id): r.survivor_id for r in G.merged(*made).collect()}
    assert len(calls) == 3
    assert got == {
        ("competition", 2): 1, ("competition", 3): 1, ("competition", 4): 1, ("competition", 5): 1, ("team", 11): 10, ("team", 12): 10, ("team", 13): 10, ("team", 14): 10, ("team", 15): 10,
        ("event", 21): 20, ("event", 22): 20, ("event", 23): 20, ("event", 24): 20,
    }


def test_nearest_event(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    events = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(10)), (3, "a", at(30)), (4, "a", at(30)), (5, "b", at(5)), (6, None, at(0))], "event_id long, k string, start_time timestamp")
    asked = {1: ("a", 4), 2: ("a", 5), 3: ("a", 6), 4: ("a", 29), 5: ("a", 0), 6: ("b", 50), 7: ("c", 0), 8: ("a", 12), 9: ("a", -3), 10: ("a", 19)}
    records = spark.createDataFrame([(i, k, at(m), "x") for i, (k, m) in asked.items()], "id long, k string, start_time timestamp, event_name string")
    got = {r.id: (r.event_id, r.result) for r in I.nearest_by_time(records, events, ["k"], 1200).collect()}
    none, tie = (None, "no-event-match"), (None, "ambiguous-event")
    assert got == {1: (1, "matched"), 2: tie, 3: (2, "matched"), 4: tie, 5: (1, "matched"), 6: none, 7: none, 8: (2, "matched"), 9: (1, "matched"), 10: (2, "matched")}


def test_digest_tree(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), rng.choice([None, "x", "y"]), rng.choice([None, "x", "y"])) for _ in range(300)]
    make = lambda x: spark.createDataFrame(x, "i int, a string, b string").repartition(3)
    root = lambda x: tuple(landing.digest(make(x)).first())
    assert root(rows) == root(rng.sample(rows, len(rows))) and root(rows)[0] == 300
    assert len({root(x) for x in ([(1, "x", None)], [(1, None, "x")], [(1, "x", None)] * 2, [(1, "null", None)], [])}) == 5
    new = rows[5:] + [(99, "q", None)] * 2 + rows[:1]
    got = Counter({(r.i, r.a, r.b): r.copies for r in landing.difference(make(rows), make(new)).collect()})
    want = Counter(new)
    want.subtract(Counter(rows))
    assert got == {k: n for k, n in want.items() if n}
    a, b = landing.tree(make(rows)), landing.tree(make(rows[1:]))
    assert landing.unequal_leaves(a, b).count() == 1 and landing.unequal_leaves(a, a).count() == 0
    assert landing.tree(make(rows)).filter("level = 2").agg(F.sum("rows")).first()[0] == 300
