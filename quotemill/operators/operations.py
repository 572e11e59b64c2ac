"""Operational queries: runs and health, retention, identity audit, clean-up, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRUST_STATES = ("VERIFIED", "UNVERIFIED", "SUSPECT", "REJECTED")
STREAK_RUNS = 50

# ------------------------------------------------------------- runs and health


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of every source."""
    w = Window.partitionBy("source").orderBy(F.desc("started_at"), F.desc("id"))
    return runs.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def run_view(log: DataFrame) -> DataFrame:
    """Runs from an append log of starts and finishes: the last entry of an id holds."""
    w = Window.partitionBy("id").orderBy(F.desc("seq"))
    return log.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "seq")


def recover_stale(runs: DataFrame, now: Column, stale_minutes: int = 60) -> DataFrame:
    """Runs that have been running too long are failed, with the reason."""
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(stale_minutes)))
    return (
        runs.withColumn("_stale", F.coalesce(stale, F.lit(False)))
        .withColumn("error_type", F.when(F.col("_stale"), F.lit("process_interrupted")).otherwise(F.col("error_type")))
        .withColumn("finished_at", F.when(F.col("_stale"), now).otherwise(F.col("finished_at")))
        .withColumn("status", F.when(F.col("_stale"), F.lit("failed")).otherwise(F.col("status")))
        .drop("_stale")
    )


def provider_health(runs: DataFrame, now: Column, window_hours: int = 24, stale_hours: int = 24) -> DataFrame:
    """Per source: last run, last success, last fresh capture, window totals, trailing
    failures among the newest 50 runs, staleness. A success without a payload (nothing new
    was captured) is a success but leaves the source stale."""
    order = F.struct("started_at", "id")
    good = F.col("status").isin("success", "partial")
    recent = F.col("started_at") >= now - F.make_dt_interval(hours=F.lit(window_hours))
    # a source's newest runs alone are ranked; the limit is pushed below the shuffle
    w = Window.partitionBy("source").orderBy(F.desc("started_at"), F.desc("id"))
    newest = runs.select("source", "status", "started_at", "id").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= STREAK_RUNS)
    streak = newest.groupBy(F.col("source").alias("_source")).agg(
        F.coalesce(F.min(F.when(F.col("status") != "failed", F.col("_rn"))) - 1, F.count("*")).cast("long").alias("consecutive_failures")
    )
    out = runs.groupBy("source").agg(
        F.max("started_at").alias("last_run_at"),
        F.max_by("status", order).alias("last_status"),
        F.max(F.when(good, F.col("started_at"))).alias("last_success_at"),
        F.max(F.when(good & F.col("source_payload").isNotNull(), F.col("started_at"))).alias("last_fresh_at"),
        F.count_if(recent).alias("runs_in_window"),
        F.count_if(recent & (F.col("status") == "failed")).alias("failures_in_window"),
    )
    out = out.join(streak, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    stale = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_fresh_at").cast("timestamp"))) / 1e6
    return out.withColumns(
        {
            "failure_rate": F.coalesce(F.try_divide(F.col("failures_in_window").cast("double"), F.col("runs_in_window").cast("double")), F.lit(0.0)),
            "staleness_seconds": stale,
        }
    ).withColumn("is_stale", F.coalesce(F.col("staleness_seconds") > stale_hours * 3600, F.lit(True)))


def sources_due(runs: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Sources (source, min_interval_seconds) whose last run lies far enough back."""
    last = runs.groupBy("source").agg(F.max("started_at").alias("_last"))
    waited = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("_last").cast("timestamp"))) / 1e6
    return sources.join(last, "source", "left").filter(F.col("_last").isNull() | (waited >= F.col("min_interval_seconds"))).drop("_last")


# ------------------------------------------------------------- upserts as logs


def upsert_last(log: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Last write by arrival wins."""
    w = Window.partitionBy(*key).orderBy(F.desc(seq))
    return log.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def mapping_view(log: DataFrame, key: list[str], seq: str, frozen: tuple[str, ...]) -> DataFrame:
    """Guarded upserts: once a key reached a ``frozen`` trust state, later automatic writes
    don't count; a write by hand (``override``) always does.

    The entry that holds is the newest one that no freeze came before since the last
    override: the first frozen entry from the last override on, or else the newest.
    """
    w = Window.partitionBy(*key).orderBy(seq)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    era = F.sum(F.col("override").cast("int")).over(upto)
    stop = F.col("trust_state").isin(*frozen)
    own = Window.partitionBy(*key, "_era").orderBy(seq)
    out = log.withColumn("_era", era).withColumn("_before", F.max(stop.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    out = out.filter(F.coalesce(F.col("_before"), F.lit(0)) == 0)
    return upsert_last(out, key, seq).drop("_era", "_before")


# ------------------------------------------------------------- retention


def retention_counts(tables: dict[str, tuple[DataFrame, str, int]], now: Column) -> DataFrame:
    """(table_name, expired): rows older than each table's days. {name: (rows, time, days)}."""
    out = None
    for name, (df, at, days) in tables.items():
        one = df.filter(F.col(at) < now - F.make_dt_interval(days=F.lit(days))).agg(F.count("*").alias("expired")).select(F.lit(name).alias("table_name"), "expired")
        out = one if out is None else out.unionByName(one)
    return out


def retained(df: DataFrame, at: str, days: int, now: Column) -> DataFrame:
    """What a clean-up keeps (an unknown time is kept)."""
    return df.filter(~F.coalesce(F.col(at) < now - F.make_dt_interval(days=F.lit(days)), F.lit(False)))


def cleared_payloads(runs: DataFrame, days: int, now: Column) -> DataFrame:
    """Source payloads of old finished runs become null; a running run keeps its own."""
    old = F.coalesce(F.col("finished_at") < now - F.make_dt_interval(days=F.lit(days)), F.lit(False))
    return runs.withColumn("source_payload", F.when(old, F.lit(None)).otherwise(F.col("source_payload")))


# ------------------------------------------------------------- orphans and audit


def orphan_teams(teams: DataFrame, events: DataFrame) -> DataFrame:
    """Teams in no event, home or away: one equi anti join against both roles."""
    used = events.select(F.col("home_team_id").alias("id")).union(events.select(F.col("away_team_id"))).distinct()
    return teams.join(used, "id", "left_anti")


def orphan_competitions(competitions: DataFrame, events: DataFrame) -> DataFrame:
    return competitions.join(events.select(F.col("competition_id").alias("id")).distinct(), "id", "left_anti")


def trust_counts(mappings: DataFrame, key: str) -> DataFrame:
    """Mappings of each target by trust state, unknown states apart."""
    state = F.col("trust_state")
    return mappings.groupBy(key).agg(
        *[F.count_if(state == s).alias(s.lower()) for s in TRUST_STATES],
        F.count_if(~state.isin(*TRUST_STATES) | state.isNull()).alias("unknown_state"),
    )


def cleanup_candidates(orphans: DataFrame, counts: DataFrame, referenced: DataFrame) -> DataFrame:
    """Provisional orphans with the reasons that protect them; without one, they may go.

    ``orphans`` (id, reference_provider, ...), ``counts`` from trust_counts keyed id,
    ``referenced`` (id): still used by an event at the time of the recheck.
    """
    used = referenced.select("id").distinct().withColumn("_used", F.lit(True))
    out = orphans.join(counts, "id", "left").join(used, "id", "left")
    n = {s: F.coalesce(F.col(s), F.lit(0)) for s in ("verified", "suspect", "rejected", "unknown_state")}
    reasons = F.filter(
        F.array(
            F.when(F.col("_used"), "referenced-by-event"),
            F.when(F.col("reference_provider").isNotNull(), "reference-identity"),
            F.when(n["verified"] > 0, "verified-mapping"),
            F.when(n["suspect"] > 0, "suspect-mapping"),
            F.when(n["rejected"] > 0, "rejected-mapping"),
            F.when(n["unknown_state"] > 0, "unknown-trust-state"),
        ),
        lambda x: x.isNotNull(),
    )
    return out.withColumn("protection_reasons", F.array_join(reasons, ",")).withColumn("safe_to_delete", F.size(reasons) == 0).drop("_used")


def duplicate_groups(events: DataFrame, key: list[str]) -> DataFrame:
    """Keys with more than one event, with the ids in order."""
    return events.groupBy(*key).agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids")
    ).filter("n > 1")


def reference_id_conflicts(mappings: DataFrame, key: list[str], target: str) -> DataFrame:
    """Source ids that point to more than one target."""
    return mappings.groupBy(*key).agg(F.count_distinct(target).alias("targets")).filter("targets > 1")


def countryless_collisions(competitions: DataFrame) -> DataFrame:
    """Names that a competition without a country shares with others of its sport."""
    none = F.coalesce(F.col("country"), F.lit("")) == ""
    # an id once, however often it comes; of a name, then, only counts are left
    ids = competitions.filter("id is not null and sport is not null and canonical_name is not null").groupBy("sport", "canonical_name", "id").agg(F.max(none).alias("none"))
    counted = ids.groupBy("sport", "canonical_name").agg(F.count("*").alias("all"), F.count_if("none").alias("countryless")).filter("countryless > 0 and all > 1")
    # an only one without a country is no other of its own
    others = F.when(F.col("countryless") == 1, F.col("all") - 1).otherwise(F.col("all"))
    return counted.select("sport", "canonical_name", others.alias("others"), "countryless")


# ------------------------------------------------------------- merging, inspection


def survivors(duplicates: DataFrame, snapshots: DataFrame, key: list[str]) -> DataFrame:
    """(id, survivor_id): of each group of duplicate events, the one with the most
    snapshots survives; of equals, the smallest id."""
    n = snapshots.groupBy("event_id").agg(F.count("*").alias("_n"))
    ranked = duplicates.join(n, F.col("id") == F.col("event_id"), "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    w = Window.partitionBy(*key).orderBy(F.desc("_n"), "id")
    return ranked.withColumn("survivor_id", F.first("id").over(w)).withColumn("_g", F.count("*").over(Window.partitionBy(*key))).filter("_g > 1").select("id", "survivor_id")


def repoint(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``rows`` with merged ids replaced by their survivors'."""
    m = mapping.select(F.col("id").alias("_old"), F.col("survivor_id").alias("_new"))
    return rows.join(m, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def cross_provider_events(events: DataFrame, mappings: DataFrame) -> DataFrame:
    """Events whose teams both or either are known to two or more sources."""
    sides = events.select("id", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    known = mappings.select("team_id", "source").distinct()  # a source may map a team many times
    found = sides.join(known, "team_id").groupBy("id").agg(F.collect_set("source").alias("s"))
    return found.select(
        "id", F.size("s").cast("long").alias("sources"), F.array_join(F.sort_array("s"), ",").alias("source_names")
    ).filter("sources >= 2")


def event_listing(events: DataFrame, teams: DataFrame) -> DataFrame:
    """Events with the names of both teams."""
    home = teams.select(F.col("id").alias("home_team_id"), F.col("canonical_name").alias("home_name"))
    away = teams.select(F.col("id").alias("away_team_id"), F.col("canonical_name").alias("away_name"))
    return events.join(home, "home_team_id").join(away, "away_team_id").withColumn("display_name", F.concat_ws(" vs ", "home_name", "away_name"))


def team_scope(events: DataFrame, teams: DataFrame) -> DataFrame:
    """Teams with each competition that they play in."""
    plays = events.select("competition_id", F.explode(F.array("home_team_id", "away_team_id")).alias("id")).distinct()
    return teams.join(plays, "id")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def counter_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counters that changed, with both values (missing is 0)."""
    b = before.select("counter", F.col("n").alias("before"))
    a = after.select("counter", F.col("n").alias("after"))
    out = b.join(a, "counter", "full_outer").select("counter", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return out.withColumn("delta", F.col("after") - F.col("before")).filter("delta <> 0")


def update_frequency(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Prices of two captures on the same key: changed and unchanged, per bookmaker."""
    a = first.select(*key, F.col("odds").alias("_a"))
    both = a.join(second.select(*key, F.col("odds").alias("_b")), key)
    return both.groupBy("bookmaker_id").agg(
        F.count("*").alias("common"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed")
    )


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """Runs by provider, signals by type and status, and the like."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def most_common(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values; of equals, the smallest first."""
    return counts_by(df, column).orderBy(F.desc("n"), column).limit(n)


def events_of(events: DataFrame, sport: str | None = None) -> DataFrame:
    return events if sport is None else events.filter(F.col("sport") == sport)


def event_detail(event_id, events: DataFrame, teams: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One event with its teams' names and, for each market it has quotes in, how many, from
    how many bookmakers and since when. Markets are told apart by their whole identity."""
    from ..model import MARKET

    one = event_listing(events.filter(F.col("id") == event_id), teams)
    own = snapshots.filter(F.col("event_id") == event_id).groupBy("event_id", *MARKET).agg(
        F.count("*").alias("snapshots"), F.count_distinct("bookmaker_id").alias("bookmakers"),
        F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at"),
    )
    return one.join(own, F.col("id") == F.col("event_id"), "left").drop("event_id")
