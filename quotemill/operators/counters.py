"""Counts over all tables of identities in one pass.

Each row becomes the facts that it is evidence of (a state, a key that it has, an entity that it refers to); facts of all
tables are one union, counted by key and then by finding. Every table is scanned once, whatever the number of findings, and only counts
and flags of a key are shuffled. Keys of any frequency are counted before they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mappings import REJECTED, SUSPECT, UNVERIFIED

PROVISIONAL, CONFLICT = "PROVISIONAL", "CONFLICT"
#: Mappings that protect an identity are all but those of this state; an entity's tables by its mappings' name.
ENTITIES = {"team_mappings": "teams", "competition_mappings": "competitions"}
#: Columns of events that refer to an entity.
ROLES = {"home_team_id": "teams", "away_team_id": "teams", "competition_id": "competitions"}


def _key(columns: list[str]) -> Column:
    """Columns as one text, each with its length before it; nulls are values, and nothing that a text holds makes two keys one."""
    each = [F.col(f"`{c}`").cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in each])


def _told(target: Column | None) -> list[Column]:
    """A target as 128 bits: smallest and largest numbers are kept in place by a hash aggregate, those of texts by sorting all facts."""
    null = F.lit(None).cast("long")
    return [(null if target is None else F.when(target.isNotNull(), F.xxhash64(F.lit(i), target.cast("string")))).alias(f"target{i}") for i in (1, 2)]


def _fact(kind: str, name: str, key: Column | None = None, state: Column | str | None = None, flag: Column | None = None, target: Column | None = None, where: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    state = F.lit(state) if isinstance(state, str) else state
    one = F.struct(
        F.lit(kind).alias("kind"), F.lit(name).alias("name"), (none if key is None else key.cast("string")).alias("key"), (none if state is None else state.cast("string")).alias("state"),
        (F.lit(None).cast("boolean") if flag is None else flag).alias("flag"), *_told(target),
    )
    return one if where is None else F.when(where, one)


def _facts(df: DataFrame, facts: list[Column]) -> DataFrame:
    return df.select(F.inline(F.array(*facts))).filter("kind is not null")


def _roles(df: DataFrame) -> list[Column]:
    return [_fact("entity", what, F.col(c), "used", where=F.col(c).isNotNull()) for c, what in ROLES.items() if c in df.columns]


def counters(tables: dict[str, DataFrame]) -> DataFrame:
    """(counter, n) of ``teams``, ``competitions``, ``events`` and mappings by name: rows of each table, and by trust state,
    resolution method and identity status where a table has that column (``(null)`` apart), and teams and
    competitions that no event refers to. What counts nothing isn't listed; ``operations.counter_diff`` takes it as 0."""
    by = {"trust_state": "trust_states", "resolution_method": "resolution_methods", "identity_status": "identity_states"}
    parts = []
    for name, df in tables.items():
        facts = [_fact("table_counts", name)]
        facts += [_fact(kind, name, F.coalesce(F.col(c).cast("string"), F.lit("(null)"))) for c, kind in by.items() if c in df.columns]
        if name == "events":
            facts += _roles(df)
        elif name in ENTITIES.values() and "events" in tables:
            facts.append(_fact("entity", name, F.col("id"), "own"))
        parts.append(_facts(df, facts))
    keyed = reduce(DataFrame.unionByName, parts).groupBy("kind", "name", "key").agg(
        F.count("*").alias("n"), F.count_if(F.col("state") == "own").alias("own"), F.max(F.col("state") == "used").alias("used")
    )
    entity = F.col("kind") == "entity"
    counter = F.when(entity, F.concat_ws(".", F.lit("orphan_counts"), "name")).otherwise(F.concat_ws(".", "kind", "name", "key"))
    n = F.when(~entity, F.col("n")).when(~F.coalesce("used", F.lit(False)), F.col("own")).otherwise(F.lit(0))
    return keyed.groupBy(counter.alias("counter")).agg(F.sum(n).alias("n")).filter("n > 0")


def _audit_facts(name: str, df: DataFrame) -> list[Column]:
    """Facts of a row of the table ``name``; mappings that go by several names have these with commas between."""
    status, trust, facts = F.col("identity_status"), F.col("trust_state"), []
    if name == "events":
        facts += [_fact("double", name, _key(["sport", "competition_id", "home_team_id", "away_team_id", "start_time"])), *_roles(df)]
        if "identity_status" in df.columns:
            facts.append(_fact("conflict", name, where=status == CONFLICT))
    elif name in ENTITIES.values():
        held = F.col("reference_provider").isNotNull() if "reference_provider" in df.columns else F.lit(False)
        facts.append(_fact("entity", name, F.col("id"), status, held))
        if name == "competitions":
            named = F.col("sport").isNotNull() & F.col("canonical_name").isNotNull()
            facts.append(_fact("collision", name, _key(["sport", "canonical_name"]), flag=F.coalesce(F.col("country"), F.lit("")) == "", target=F.col("id"), where=named))
    elif name.endswith("_mappings"):
        facts.append(_fact("unresolved", name, state=trust, where=trust.isin(UNVERIFIED, SUSPECT)))
        # one finding a decision: of a source and sport, for one reason, at one time
        decision = [c for c in ("source", "sport", "rejection_reason", "rejected_at") if c in df.columns]
        facts.append(_fact("rejected", name, _key(decision) if decision else None, where=trust == REJECTED))
        if {"source_id", "target_id"} <= set(df.columns):
            facts.append(_fact("clash", name, _key(["source", "source_id"]), target=F.col("target_id")))
        for one in name.split(","):
            if one in ENTITIES and "target_id" in df.columns:
                guards = F.coalesce(trust != UNVERIFIED, F.lit(True)) & F.col("target_id").isNotNull()
                facts.append(_fact("entity", ENTITIES[one], F.col("target_id"), "guarded", where=guards))
    return facts


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(code, severity, n): every finding of the identity audit that has rows.

    ``tables``: events, teams, competitions (with identity_status), and the mapping views
    team, competition, event, team_id, competition_id by name ``<name>_mappings``, those of ids
    with source, sport, source_id and target_id. Views that are one DataFrame are scanned and counted once.
    """
    views: dict[int, list[str]] = {}
    for name, df in tables.items():
        views.setdefault(id(df), []).append(name)
    parts = []
    for names in views.values():
        df = tables[names[0]]
        if len(names) > 1 and all(n.endswith("_mappings") for n in names):
            parts.append(_facts(df, _audit_facts(",".join(names), df)))
        else:
            parts += [_facts(df, facts) for n in names if (facts := _audit_facts(n, df))]
    state, flag = F.col("state"), F.coalesce("flag", F.lit(False))
    keyed = reduce(DataFrame.unionByName, parts).groupBy("kind", "name", "key").agg(
        F.count("*").alias("n"), F.count_if((state == PROVISIONAL) & ~flag).alias("free"), F.count_if((state == PROVISIONAL) & flag).alias("held"),
        F.count_if(state == CONFLICT).alias("conflict"), F.coalesce(F.max(state == "used"), F.lit(False)).alias("used"), F.coalesce(F.max(state == "guarded"), F.lit(False)).alias("guarded"),
        F.coalesce(F.max(state == SUSPECT), F.lit(False)).alias("suspect"), F.max(flag).alias("any"), F.coalesce((F.min("target1") != F.max("target1")) | (F.min("target2") != F.max("target2")), F.lit(False)).alias("several"),
    )
    orphan = F.when(~F.col("used"), F.col("free") + F.col("held")).otherwise(0)
    safe = F.when(~F.col("used") & ~F.col("guarded"), F.col("free")).otherwise(0)
    found = keyed.groupBy("kind", "name").agg(
        F.sum("n").alias("n"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("doubles"), F.sum(orphan).alias("orphans"), F.sum(safe).alias("safe"), F.sum("conflict").alias("conflicts"),
        F.max("suspect").alias("suspect"), F.count_if("several").alias("several"), F.count_if(F.col("several") & F.col("any")).alias("collisions"),
    )
    found = found.withColumn("name", F.explode(F.split("name", ",")))
    name = F.col("name")

    def one(kind: str, code: Column, severity: Column | str, n: Column) -> Column:
        severity = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(F.col("kind") == kind, F.struct(code.alias("code"), severity.alias("severity"), n.cast("long").alias("n")))

    findings = F.array(
        one("double", F.lit("duplicate-canonical-events"), "ERROR", F.col("doubles")),
        one("conflict", F.concat(F.lit("conflicting-"), name), "ERROR", F.col("n")),
        one("entity", F.concat(F.lit("orphan-provisional-"), name), "WARNING", F.col("orphans")),
        one("entity", F.concat(F.lit("gc-safe-provisional-"), name), "INFO", F.col("safe")),
        one("entity", F.concat(F.lit("protected-orphan-"), name), "WARNING", F.col("orphans") - F.col("safe")),
        one("entity", F.concat(F.lit("conflicting-"), name), "ERROR", F.col("conflicts")),
        one("unresolved", F.concat(F.lit("unresolved-"), name), F.when(F.col("suspect"), "ERROR").otherwise("WARNING"), F.col("n")),
        one("rejected", F.concat(F.lit("rejected-"), name), "WARNING", F.col("keys")),
        one("clash", F.concat(F.lit("multiple-reference-ids-"), name), "ERROR", F.col("several")),
        one("collision", F.lit("countryless-competition-collisions"), "WARNING", F.col("collisions")),
    )
    return found.select(F.inline(F.filter(findings, lambda x: x.isNotNull()))).filter("n > 0")
