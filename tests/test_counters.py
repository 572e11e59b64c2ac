"""Counters and the audit in one pass."""

import random
from collections import Counter

from pyspark.sql import functions as F

from quotemill.operators import counters as C
from quotemill.operators import operations as O

EVENT = "id long, sport string, competition_id long, home_team_id long, away_team_id long, start_time long, identity_status string"
ENTITY = "id long, sport string, canonical_name string, country string, identity_status string, reference_provider string"
MAPPING = "source string, source_id string, target_id long, trust_state string, resolution_method string"


def made(seed, n=300):
    """Rows with nulls in any column, one hot team and repeated rows."""
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    states = ["PROVISIONAL", "CONFLICT", "REFERENCE", None]
    some = lambda top: pick(None, 1, 1, *range(1, top))
    events = [(i, pick("s", "t", None), some(6), some(40), some(40), some(4), pick(*states)) for i in range(n)]
    entity = lambda top: [(pick(i, i, i, 3, None), pick("s", "t", None), pick("a", "b", "c", None), pick("", None, "x"), pick(*states), pick(None, None, "ref")) for i in range(top)]
    maps = [(pick("p", "q", None), pick("1", "2", "3", None), some(60), pick("VERIFIED", "SUSPECT", "REJECTED", "UNVERIFIED", "ODD", None), pick("exact", None)) for _ in range(n)]
    return {"events": events, "teams": entity(60), "competitions": entity(9), "team_mappings": maps, "competition_mappings": [m for m in maps if m[2] and m[2] < 9]}


def frames(spark, rows):
    schema = {"events": EVENT, "teams": ENTITY, "competitions": ENTITY}
    return {k: spark.createDataFrame(v, schema.get(k, MAPPING)) for k, v in rows.items()}


def expected_counters(rows):
    out = Counter()
    null = lambda x: "(null)" if x is None else x
    for name, rs in rows.items():
        out[f"table_counts.{name}"] += len(rs)
        for r in rs:
            if name.endswith("mappings"):
                out[f"trust_states.{name}.{null(r[3])}"] += 1
                out[f"resolution_methods.{name}.{null(r[4])}"] += 1
            else:
                out[f"identity_states.{name}.{null(r[6 if name == 'events' else 4])}"] += 1
    used = {"teams": {x for e in rows["events"] for x in e[3:5]}, "competitions": {e[2] for e in rows["events"]}}
    for what, ids in used.items():
        out[f"orphan_counts.{what}"] += sum(r[0] is None or r[0] not in ids for r in rows[what])
    return {k: n for k, n in out.items() if n}


def expected_audit(rows):
    out = {"duplicate-canonical-events": ("ERROR", sum(n > 1 for n in Counter(e[1:6] for e in rows["events"]).values()))}
    out["conflicting-events"] = ("ERROR", sum(e[6] == "CONFLICT" for e in rows["events"]))
    used = {"teams": {x for e in rows["events"] for x in e[3:5]}, "competitions": {e[2] for e in rows["events"]}}
    for what, ids in used.items():
        guarded = {m[2] for m in rows[what[:-1] + "_mappings"] if m[3] != "UNVERIFIED"} - {None}
        orphans = [r for r in rows[what] if r[4] == "PROVISIONAL" and (r[0] is None or r[0] not in ids)]
        safe = [r for r in orphans if r[5] is None and r[0] not in guarded]
        out |= {
            f"orphan-provisional-{what}": ("WARNING", len(orphans)), f"gc-safe-provisional-{what}": ("INFO", len(safe)),
            f"protected-orphan-{what}": ("WARNING", len(orphans) - len(safe)), f"conflicting-{what}": ("ERROR", sum(r[4] == "CONFLICT" for r in rows[what])),
        }
    for name in ("team_mappings", "competition_mappings"):
        waiting = [m[3] for m in rows[name] if m[3] in ("UNVERIFIED", "SUSPECT")]
        out[f"unresolved-{name}"] = ("ERROR" if "SUSPECT" in waiting else "WARNING", len(waiting))
        out[f"rejected-{name}"] = ("WARNING", len({m[0] for m in rows[name] if m[3] == "REJECTED"}))
        targets = {}
        for m in rows[name]:
            targets.setdefault(m[:2], set()).add(m[2])
        out[f"multiple-reference-ids-{name}"] = ("ERROR", sum(len(t - {None}) > 1 for t in targets.values()))
    names = {}
    for r in rows["competitions"]:
        if r[1] is not None and r[2] is not None:
            names.setdefault((r[1], r[2]), []).append(r)
    hit = lambda rs: any(not a[3] and any(None not in (a[0], b[0]) and a[0] != b[0] for b in rs) for a in rs)
    out["countryless-competition-collisions"] = ("WARNING", sum(hit(rs) for rs in names.values()))
    return {k: v for k, v in out.items() if v[1]}


def test_equal_plain_python(spark):
    for seed in range(3):
        rows = made(seed)
        t = frames(spark, rows)
        assert {r.counter: r.n for r in C.counters(t).collect()} == expected_counters(rows)
        assert {r.code: (r.severity, r.n) for r in C.audit(t).collect()} == expected_audit(rows)


def test_empty_tables(spark):
    t = {k: df.limit(0) for k, df in frames(spark, made(1, 5)).items()}
    assert C.counters(t).collect() == [] and C.audit(t).collect() == []
    only = frames(spark, made(1, 5))
    diff = {r.counter: r.delta for r in O.counter_diff(C.counters(t), C.counters(only)).collect()}
    assert diff["table_counts.events"] == 5


def test_each_table_is_scanned_once(spark, tmp_path):
    for name, df in frames(spark, made(2)).items():
        df.write.parquet(str(tmp_path / name))
    names = ["events", "teams", "competitions", "team_mappings", "competition_mappings"]
    t = {n: spark.read.parquet(str(tmp_path / n)).withColumn("unused", F.lit("x" * 9)) for n in names}
    for out in (C.counters(t), C.audit(t)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == len(names)
        assert plan.count("hashpartitioning") == 2 and "Join" not in plan


def test_one_view_by_several_names_is_scanned_once(spark, tmp_path):
    rows = made(4)
    rows["competition_mappings"] = rows["team_mappings"]
    for name, df in frames(spark, rows).items():
        df.write.parquet(str(tmp_path / name))
    t = {n: spark.read.parquet(str(tmp_path / n)) for n in ("events", "teams", "competitions", "team_mappings")}
    out = C.audit({**t, "competition_mappings": t["team_mappings"]})
    plan = out._jdf.queryExecution().executedPlan().toString()
    # nothing is sorted to be counted: that would be all facts of all tables
    assert plan.count("FileScan parquet") == 4 and "SortAggregate" not in plan
    assert {r.code: (r.severity, r.n) for r in out.collect()} == expected_audit(rows)


def test_keys_of_several_columns_are_told_apart(spark):
    rows = [("a", "b"), ("a1:b", None), ("a", None), (None, "a"), ("", None), (None, ""), (None, None), ("-", None), ("a-", "b")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(C._key(["x", "y"])).distinct().count() == len(rows)
