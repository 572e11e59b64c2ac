"""Every registered query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from quotemill.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7)
    if isinstance(v, decimal.Decimal):
        return str(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = duck.sql(ORACLE_SQL[name])
    assert cols == sorted(rel.columns)
    at = [list(rel.columns).index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert got == want


def similarity(a, b):
    """2 x longest common subsequence / both lengths, in percent, by the textbook table."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return 200 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_only_these_have_no_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"fuzzy_names", "resolved_fixtures", "merged_identities"}


def test_fuzzy_names_equal_all_pairs(spark):
    names = sorted({r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").collect()})
    pool = {n.lower() for n in names}
    got = {r.name: r for r in QUERIES["fuzzy_names"](spark, SF).collect()}
    asked = sorted({n[:-1] for n in names})
    assert sorted(got) == asked
    for name in asked:
        r, key = got[name], " ".join(name.lower().split())
        if key in pool:
            assert (r.method, r.canonical_name.lower(), r.confidence) == ("exact", key, 100)
            continue
        scores = sorted(((similarity(key, n), n) for n in pool), reverse=True)
        want = "unknown" if scores[0][0] < 80 else "ambiguous" if scores[0][0] - scores[1][0] < 5 else "fuzzy"
        assert (r.method, r.confidence) == (want, pytest.approx(scores[0][0] if scores[0][0] >= 75 else 0))
        assert r.canonical_name is None if want != "fuzzy" else r.canonical_name.lower() == scores[0][1]


def test_resolved_fixtures_equal_their_natural_key(spark):
    """Teams of other numbers are never alike, so a fixture is its two teams and its day."""
    events = {r.event_id: (r.user_id % 12, r.ts.date()) for r in spark.read.parquet(f"{SF}/events.parquet").collect()}
    got = {r.id: r for r in QUERIES["resolved_fixtures"](spark, SF).collect()}
    assert set(got) == set(events)
    assert all((r.resolution, r.confidence) == ("resolved", 100) for r in got.values())
    assert len({(events[i], r.event_id) for i, r in got.items()}) == len(set(events.values())) == len({r.event_id for r in got.values()})


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
