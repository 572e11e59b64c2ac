"""Quote history: appends without duplicates, latest readings, histories, markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import MARKET, SERIES

#: The analytic clock first, then the ingest clock, then the row: a total order.
NEWEST = ("quote_time", "observed_at", "id")


def newest() -> list[Column]:
    return [F.col(c).desc() for c in NEWEST]


def with_quote_time(quotes: DataFrame) -> DataFrame:
    """The time a price was true: the source's own, or else when it was seen."""
    return quotes.withColumn("quote_time", F.coalesce("source_timestamp", "observed_at"))


def explode_outcomes(records: DataFrame) -> DataFrame:
    """One row an outcome from a map of outcome to price."""
    return records.select("*", F.explode("odds").alias("outcome", "price")).drop("odds").withColumnRenamed("price", "odds")


def market_equal(a: DataFrame, b: DataFrame) -> Column:
    """Null-safe equality of two market identities; planned as an equi-join."""
    out = F.lit(True)
    for c in MARKET:
        out = out & a[c].eqNullSafe(b[c])
    return out


def first_wins(quotes: DataFrame, arrival: str = "id") -> DataFrame:
    """One reading for each series and observed_at: the first to arrive, whatever its price."""
    w = Window.partitionBy(*SERIES, "observed_at").orderBy(arrival)
    return quotes.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def insert_if_absent(existing: DataFrame, batch: DataFrame, arrival: str = "id") -> DataFrame:
    """Rows of ``batch`` to append: new readings only, null-safe on the whole identity."""
    fresh = first_wins(batch, arrival).alias("n")
    known = existing.select(*SERIES, "observed_at").alias("k")
    same = F.lit(True)
    for c in [*SERIES, "observed_at"]:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}"))
    return fresh.join(known, same, "left_anti")


def latest(quotes: DataFrame) -> DataFrame:
    """The newest reading of every series."""
    return last_readings(quotes, 1).drop("reading")


def last_readings(quotes: DataFrame, n: int = 2) -> DataFrame:
    """The newest ``n`` readings of every series; ``reading`` 1 is the newest."""
    w = Window.partitionBy(*SERIES).orderBy(*newest())
    return quotes.withColumn("reading", F.row_number().over(w)).filter(F.col("reading") <= n)


def last_two_same_provider(quotes: DataFrame) -> DataFrame:
    """The newest reading of each series and the one before it from the same provider
    (an unknown provider matches an unknown one), however far back that lies."""
    w = Window.partitionBy(*SERIES).orderBy(*newest())
    lead = quotes.withColumn("_p", F.first("provider_id").over(w)).filter(F.col("provider_id").eqNullSafe(F.col("_p")))
    return last_readings(lead.drop("_p"), 2)


def with_provider(quotes: DataFrame, runs: DataFrame) -> DataFrame:
    """Readings with the provider of the run that brought them; a reading without a run stays."""
    own = runs.select(F.col("id").alias("_run"), "provider_id")
    return quotes.join(own, F.col("collector_run_id") == F.col("_run"), "left").drop("_run")


def distinct_markets(quotes: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Markets that have quotes, of the given events if any are given."""
    if events is not None:
        quotes = quotes.join(events.select("event_id").distinct(), "event_id", "left_semi")
    return quotes.select(*MARKET).distinct()


def history(quotes: DataFrame, first: int | None = None) -> DataFrame:
    """Each series in the order of time, numbered; only its first readings if asked."""
    w = Window.partitionBy(*SERIES).orderBy("observed_at", "id")
    out = quotes.withColumn("position", F.row_number().over(w))
    return out if first is None else out.filter(F.col("position") <= first)


def analysis_time(quotes: DataFrame) -> DataFrame:
    """One row: the newest quote time, the clock of a replay."""
    return quotes.agg(F.max("quote_time").alias("analysis_time"))
