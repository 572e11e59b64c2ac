"""One detection cycle over every event and market at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import MARKET, Settings
from ..operators import analysis as A
from ..operators.quotes import latest


@dataclass(frozen=True)
class Sweep:
    """What a cycle found, and what it was able to look at: only of the latter can it be
    said that a condition is gone."""

    candidates: DataFrame  # type, event, market, outcome, edge, details
    evaluated: DataFrame  # type, event, market, outcome
    movements: DataFrame


KEY = ["signal_type", "event_id", *MARKET, "outcome"]


def detect(
    quotes: DataFrame, now: Column, settings: Settings, status: DataFrame | None = None, touched: DataFrame | None = None
) -> Sweep:
    """Surebets, value gaps and movements of the open events. Movements use the whole
    history; freshness would hide the very readings they compare. ``touched`` (event_id) limits a cycle to the events
    that its ingestion brought something for."""
    if touched is not None:
        quotes = quotes.join(touched.select("event_id").distinct(), "event_id", "left_semi")
    if status is not None:
        quotes = A.open_events(quotes, status)
    usable = A.coherent(latest(A.supported(quotes)), settings.freshness, now)
    markets = A.arbitrage(A.best_odds(usable)).filter("evaluated")
    none = F.lit(None).cast("string")
    sure = markets.filter("is_surebet").select(
        F.lit("SUREBET").alias("signal_type"), "event_id", *MARKET, none.alias("outcome"), F.col("profit_percent").alias("edge"),
        F.to_json(F.struct("margin")).alias("details"),
    )
    gaps = A.value_gaps(usable, settings.min_value_gap_percent, settings.min_bookmakers)
    # several bookmakers may be off in one outcome: its signal is that of the widest gap
    widest = gaps.groupBy("event_id", *MARKET, "outcome").agg(
        F.max("deviation_percent").alias("edge"),
        F.to_json(F.max_by(F.struct("bookmaker_id", "odds", "median"), F.struct("deviation_percent", -F.col("bookmaker_id")))).alias("details"),
    )
    gap = widest.select(F.lit("VALUE_GAP").alias("signal_type"), "event_id", *MARKET, "outcome", "edge", "details")
    seen = markets.select(F.lit("SUREBET").alias("signal_type"), "event_id", *MARKET, none.alias("outcome")).unionByName(
        A.value_gap_evaluated(usable, settings.min_bookmakers).select(F.lit("VALUE_GAP").alias("signal_type"), "event_id", *MARKET, "outcome")
    )
    moves = A.movements(quotes, settings.movement_percent, settings.movement_window_seconds)
    return Sweep(sure.unionByName(gap), seen, moves)


def as_log(sweep: Sweep, at: Column) -> tuple[DataFrame, DataFrame]:
    """The sweep's rows for the append logs that ``signals.signals`` reads: candidates
    and evaluated keys, each with the time of the sweep."""
    return sweep.candidates.withColumn("sweep_ts", at), sweep.evaluated.withColumn("sweep_ts", at)
