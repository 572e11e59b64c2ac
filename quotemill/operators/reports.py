"""Reports: tables first, text last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import elapsed
from ..model import MARKET, Freshness
from . import analysis as A
from .quotes import latest


def opportunity_report(
    quotes: DataFrame, policy: Freshness, now: Column, min_profit: float = 1.0, min_gap: float = 15.0, least: int = 3
) -> DataFrame:
    """Surebets of at least ``min_profit`` percent and value gaps, the largest edge first."""
    usable = A.coherent(latest(quotes), policy, now)
    sure = A.arbitrage(A.best_odds(usable)).filter("evaluated and is_surebet").filter(F.col("profit_percent") >= min_profit)
    none = F.lit(None)
    sure = sure.select(
        F.lit("SUREBET").alias("kind"), "event_id", *MARKET, none.cast("string").alias("outcome"),
        none.cast("long").alias("bookmaker_id"), F.col("profit_percent").alias("edge"),
    )
    gaps = A.value_gaps(usable, min_gap, least).select(
        F.lit("VALUE_GAP").alias("kind"), "event_id", *MARKET, "outcome", "bookmaker_id", F.col("deviation_percent").alias("edge")
    )
    return sure.unionByName(gaps).orderBy(F.desc("edge"), "kind", "event_id", *MARKET, "outcome", "bookmaker_id")


def movement_report(moves: DataFrame) -> DataFrame:
    """Detected movements, the largest first, with the time they took."""
    out = moves.filter("detected").withColumn("elapsed", elapsed(F.col("elapsed_seconds")))
    return out.orderBy(F.desc(F.abs("change_percent")), "event_id", *MARKET, "bookmaker_id", "outcome")


def console_breakdown(quotes: DataFrame, policy: Freshness, now: Column) -> DataFrame:
    """Three-way markets: best price of each outcome, margin and profit on one row an event."""
    best = A.best_odds(A.coherent(latest(quotes), policy, now)).filter("market_type = 'three_way' and market_phase = 'pre_match'")
    wide = best.groupBy("event_id").pivot("outcome", ["1", "X", "2"]).agg(F.first("odds"))
    margin = A.arbitrage(best).select("event_id", "margin", "profit_percent")
    return wide.join(margin, "event_id", "left")


def text_lines(report: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Fixed-width text: each column cut to its width and filled up."""
    cells = [F.rpad(F.substring(F.coalesce(F.col(c).cast("string"), F.lit("-")), 1, w), w, " ") for c, w in widths.items()]
    return report.select(F.rtrim(F.concat_ws(" ", *cells)).alias("line"))
