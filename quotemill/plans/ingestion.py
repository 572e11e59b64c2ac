"""One ingestion run: validate, resolve, explode to snapshots, audit, summarise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import MARKET
from ..operators import identity as I
from ..operators import sinks
from ..operators import validation as V


@dataclass(frozen=True)
class Ingested:
    snapshots: DataFrame  # one row an outcome of an accepted record
    payloads: DataFrame  # one row a record, accepted or not, with the reason
    run: DataFrame  # one row: counts and status


def known_events(records: DataFrame, events: DataFrame) -> DataFrame:
    """Resolution against a fixed list of events (id, sport, league, home_team, away_team,
    start_time): event_id and resolution for each record id; nothing is created."""
    named, pool = records.withColumn("start_time", F.try_to_timestamp("start_time")), events.withColumn("event_id", F.col("id"))
    for c, out in (("sport", "s"), ("league", "l"), ("home_team", "h"), ("away_team", "a")):
        named, pool = T.with_key(named, c, out), T.with_key(pool, c, out)
    named, pool = named.select("id", *"slha", "start_time"), pool.select("event_id", *"slha", "start_time")
    return I.match_by_time(named, pool, ["s", "l", "h", "a"], 1800).select("id", "event_id", F.col("result").alias("resolution"))


class Catalogue:
    """``resolve`` of an ingestion run against the identity catalogue: records may create
    identities. ``entries`` are then what to append to the catalogue; ``aliases`` and ``tokens``
    are configuration (see ``functions.aliases``), never looked up unasked."""

    #: Columns of feeds and what resolution calls them.
    FIELDS = {"source_home_team_id": "home_source_id", "source_away_team_id": "away_source_id", "source_competition_id": "competition_source_id"}

    def __init__(self, log: DataFrame | None = None, aliases: dict[str, str] | None = None, tokens: dict[str, str] | None = None, reference: str | None = None):
        self.log, self.aliases, self.tokens, self.reference = log, aliases, tokens, reference
        self.entries: DataFrame | None = None

    def __call__(self, records: DataFrame) -> DataFrame:
        provider = F.coalesce("provider_id", "source") if "provider_id" in records.columns else F.col("source")
        named = records.withColumnsRenamed({k: v for k, v in self.FIELDS.items() if k in records.columns})
        named = named.withColumns({"source": provider, "start_time": F.try_to_timestamp(F.col("start_time").cast("string"))})
        if "seq" not in named.columns:
            named = named.withColumn("seq", F.col("id"))
        found, self.entries = I.resolve(named, self.log, self.aliases, self.tokens, self.reference)
        return found.select("id", "event_id", "resolution")


def ingest(records: DataFrame, resolve, run_id: str, now, complete: bool = True) -> Ingested:
    """``records`` as feeds and flat files give them, with an ``id`` for each.

    ``resolve``: records -> (id, event_id, resolution); it sees only valid records.
    """
    judged = V.validate(records)
    found = resolve(judged.filter("is_valid").select(*records.columns)).select(F.col("id").alias("_id"), "event_id", "resolution")
    seen = judged.join(found, F.col("id") == F.col("_id"), "left").drop("_id")
    unknown = F.col("is_valid") & F.col("event_id").isNull()
    reason = F.when(unknown, F.concat(F.lit("identity: "), F.coalesce("resolution", F.lit("no-event-match")))).otherwise(
        V.rejection_reason(F.col("stage"), F.col("errors"))
    )
    seen = seen.withColumns({"_accepted": F.col("is_valid") & F.col("event_id").isNotNull(), "_reason": reason})
    run = F.lit(run_id)
    payloads = sinks.audit_payloads(seen.select(*records.columns, "_accepted", "_reason"), run, F.col("_accepted"), F.col("_reason"), now)
    good = seen.filter("_accepted")
    at, source_at = F.try_to_timestamp("observed_at"), F.try_to_timestamp("source_timestamp")
    have = set(records.columns)
    snapshots = T.with_key(good, "source", "bookmaker_key", "bookmaker").select(
        "event_id", F.col("source").alias("bookmaker_name"), "bookmaker_key",
        *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in MARKET],
        F.explode("odds").alias("outcome", "_price"), at.alias("observed_at"), source_at.alias("source_timestamp"), run.alias("collector_run_id"),
    ).withColumn("odds", F.col("_price").cast("decimal(18,6)")).drop("_price").withColumn("quote_time", F.coalesce("source_timestamp", "observed_at"))
    totals = seen.agg(
        F.count("*").alias("records_received"), F.count_if("_accepted").alias("records_accepted"), F.count_if(~F.col("_accepted")).alias("records_rejected")
    )
    status = V.run_status(F.col("records_accepted"), F.col("records_rejected"), F.lit(0), F.lit(complete), F.lit(False))
    return Ingested(snapshots, payloads, totals.select(run.alias("id"), "*", status.alias("status")))
