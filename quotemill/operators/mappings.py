"""Trust in identities: states, decisions by hand, reference promotion, kickoff authority.

Mappings are logs of writes; ``operations.mapping_view`` says which entry holds. The
functions here append entries or compare views; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import country_key

VERIFIED, UNVERIFIED, SUSPECT, REJECTED = "VERIFIED", "UNVERIFIED", "SUSPECT", "REJECTED"


def trust_of(method: Column) -> Column:
    """What a way of resolving is worth: guesses stay unverified."""
    return F.when(method.isin("fuzzy", "ambiguous"), UNVERIFIED).otherwise(VERIFIED)


def decide(log: DataFrame, keys: DataFrame, key: list[str], state: str, at: Column, reason: str | None = None) -> DataFrame:
    """Log entries of a decision by hand on existing mappings: verifying clears a
    quarantine, rejecting needs a reason. Keys without a mapping give no entry."""
    if state == REJECTED and not (reason or "").strip():
        raise ValueError("a rejection needs a reason")
    w = Window.partitionBy(*key).orderBy(F.desc("seq"))
    last = log.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").join(keys.select(*key).distinct(), key, "left_semi")
    out = last.withColumns({"trust_state": F.lit(state), "override": F.lit(True), "seq": F.col("seq") + 1})
    if "rejection_reason" in log.columns:
        out = out.withColumns({"rejection_reason": F.lit(reason).cast("string"), "rejected_at": F.when(F.lit(state == REJECTED), at)})
    return out.select(*log.columns)


def listing(views: dict[str, DataFrame], states: tuple[str, ...] = (SUSPECT, REJECTED)) -> DataFrame:
    """Mappings that wait for, or were refused by, a person: (mapping, trust_state, key, target).
    {name: view with columns key_text, target_text, trust_state}."""
    out = None
    for name, view in views.items():
        one = view.filter(F.col("trust_state").isin(*states)).select(F.lit(name).alias("mapping"), "trust_state", "key_text", "target_text")
        out = one if out is None else out.unionByName(one)
    return out


def drifted(id_mappings: DataFrame, seen: DataFrame, key: list[str], similar: Column) -> DataFrame:
    """Verified id mappings whose newly seen name (``name``) is not like the verified one
    (``verified_name``): they turn suspect. ``similar`` compares the two."""
    return suspected(id_mappings.join(seen, key), similar)


def suspected(both: DataFrame, similar: Column) -> DataFrame:
    """``drifted`` of mappings that have the newly seen name beside them, row by row."""
    return both.filter(F.col("trust_state") == VERIFIED).filter(~similar).withColumn("trust_state", F.lit(SUSPECT))


def country_compatible(candidates: DataFrame, team_competitions: DataFrame, competitions: DataFrame) -> DataFrame:
    """(team_id, competition_id) pairs whose country fits: it is unknown on either side, or
    the team is known in a competition of the same country."""
    land = competitions.select(F.col("id").alias("competition_id"), country_key(F.col("country")).alias("land"))
    known = team_competitions.join(land, "competition_id").filter("land <> ''").select("team_id", F.col("land").alias("_land")).distinct()
    placed = candidates.join(land, "competition_id", "left").withColumn("land", F.coalesce("land", F.lit("")))
    any_known = known.select("team_id").distinct().withColumn("_any", F.lit(True))
    fits = known.withColumn("_fits", F.lit(True)).withColumnRenamed("_land", "land")
    out = placed.join(any_known, "team_id", "left").join(fits, ["team_id", "land"], "left")
    return out.filter((F.col("land") == "") | F.col("_any").isNull() | F.col("_fits")).select("team_id", "competition_id")


def promotable(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """Entities that may take a reference id: it is claimed once, no other entity holds it and
    the entity has none yet. ``claims`` (id, reference_provider, reference_provider_id)."""
    ref = ["reference_provider", "reference_provider_id"]
    held = entities.filter("reference_provider_id is not null").select("id", *ref)
    once = claims.withColumn("_n", F.count("*").over(Window.partitionBy(*ref))).filter("_n = 1").drop("_n")
    free = once.join(held.select(*ref), ref, "left_anti")
    return free.join(held.select("id"), "id", "left_anti").join(entities.select("id"), "id", "left_semi")


def synced_kickoffs(events: DataFrame, sightings: DataFrame, reference: str) -> DataFrame:
    """Events with the start time of the last sighting that had the authority to move it: the
    reference provider, the event's own reference, or without one the provider that set it.

    ``sightings`` (event_id, provider_id, start_time, seq)."""
    s = sightings.select("event_id", F.col("provider_id").alias("_p"), F.col("start_time").alias("_t"), "seq")
    both = events.join(s, F.col("id") == F.col("event_id"))
    may = (
        (F.col("_p") == reference)
        | (F.col("reference_provider") == F.col("_p"))
        | (F.col("reference_provider").isNull() & (F.col("start_time_provider").isNull() | (F.col("start_time_provider") == F.col("_p"))))
    )
    last = both.filter(may & (F.col("_t") != F.col("start_time"))).groupBy("id").agg(F.max_by(F.struct("_t", "_p"), "seq").alias("m"))
    out = events.join(last, "id", "left")
    moved = F.col("m").isNotNull()
    return out.withColumns(
        {
            "start_time": F.when(moved, F.col("m._t")).otherwise(F.col("start_time")),
            "start_time_provider": F.when(moved, F.col("m._p")).otherwise(F.col("start_time_provider")),
            "reference_provider": F.when(moved & (F.col("m._p") == reference), F.lit(reference)).otherwise(F.col("reference_provider")),
        }
    ).drop("m")


def backfilled(rows: DataFrame, column: str, lookup: DataFrame, on: str, value: str) -> DataFrame:
    """``column`` filled from a lookup where it is null (the smallest of several values)."""
    found = lookup.groupBy(F.col(on).alias("_k")).agg(F.min(value).alias("_v"))
    return rows.join(found, F.col(on) == F.col("_k"), "left").withColumn(column, F.coalesce(column, "_v")).drop("_k", "_v")
