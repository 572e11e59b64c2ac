"""Freshness, best prices, arbitrage, outliers, lag and movement.

Each function is one plan over all events and markets. Ratios that meet a threshold
are compared by cross-multiplication of decimals, so equality never depends on rounding.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import MARKET, REQUIRED_OUTCOMES, TERMINAL, Freshness
from .quotes import last_two_same_provider, latest

GROUP = ["event_id", *MARKET]


def required(market_type: Column) -> Column:
    """The outcomes that a market of this type needs, sorted; null if unsupported."""
    out = F.lit(None).cast("array<string>")
    for kind, outcomes in REQUIRED_OUTCOMES.items():
        out = F.when(market_type == kind, F.array(*[F.lit(o) for o in sorted(outcomes)])).otherwise(out)
    return out


def supported(quotes: DataFrame) -> DataFrame:
    return quotes.filter(F.col("market_type").isin(*REQUIRED_OUTCOMES))


def unsupported_types(quotes: DataFrame) -> DataFrame:
    """Market types that detection skips, each once."""
    return quotes.filter(~F.col("market_type").isin(*REQUIRED_OUTCOMES)).select("market_type").distinct()


def open_events(quotes: DataFrame, status: DataFrame) -> DataFrame:
    """Without the events whose last reported lifecycle is terminal."""
    over = status.filter(F.col("lifecycle").isin(*TERMINAL)).select("event_id")
    return quotes.join(over, "event_id", "left_anti")


# ------------------------------------------------------------- freshness


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def with_freshness(quotes: DataFrame, policy: Freshness, now: Column, group: list[str] | None = None) -> DataFrame:
    """Adds age_seconds, is_fresh (the row's own age) and group_valid (its market's fresh
    rows lie close enough together)."""
    group = group or GROUP
    w = Window.partitionBy(*group)
    age = (_micros(now) - _micros(F.col("quote_time"))) / 1e6
    fresh = (age >= -policy.skew) & (age <= policy.max_age)
    at = F.when(F.col("is_fresh"), _micros(F.col("quote_time")))
    spread = (F.max(at).over(w) - F.min(at).over(w)) / 1e6
    return (
        quotes.withColumns({"age_seconds": age, "is_fresh": fresh})
        .withColumn("_spread", spread)
        .withColumn("group_valid", F.coalesce(F.col("_spread") <= policy.max_spread, F.lit(False)))
        .drop("_spread")
    )


def coherent(quotes: DataFrame, policy: Freshness, now: Column) -> DataFrame:
    """Fresh rows of coherent markets."""
    return with_freshness(quotes, policy, now).filter("is_fresh and group_valid").drop("age_seconds", "is_fresh", "group_valid")


def freshness_summary(quotes: DataFrame, policy: Freshness, now: Column, group: list[str] | None = None) -> DataFrame:
    """Per market: counts, spread, the stale bookmakers and why it can't be used."""
    group = group or GROUP
    age = (_micros(now) - _micros(F.col("quote_time"))) / 1e6
    fresh = (age >= -policy.skew) & (age <= policy.max_age)
    at = F.when(fresh, _micros(F.col("quote_time")))
    out = quotes.groupBy(*group).agg(
        F.count("*").alias("snapshots"),
        F.count_if(fresh).alias("fresh"),
        ((F.max(at) - F.min(at)) / 1e6).alias("spread_seconds"),
        F.collect_set(F.when(~fresh, F.col("bookmaker_id")).cast("string")).alias("stale_sources"),
    ).withColumn("stale_sources", F.array_join(F.sort_array("stale_sources"), ","))
    reason = (
        F.when(F.col("snapshots") == 0, "no-snapshots")
        .when(F.col("fresh") == 0, "no-fresh-snapshots")
        .when(F.col("spread_seconds") > policy.max_spread, "observation-spread-too-large")
    )
    return out.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())


# ------------------------------------------------------------- best price, arbitrage


def best_odds(quotes: DataFrame) -> DataFrame:
    """The highest price of every outcome; of equals, the smallest bookmaker's."""
    w = Window.partitionBy(*GROUP, "outcome").orderBy(F.desc("odds"), "bookmaker_id", "id")
    return quotes.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def arbitrage(best: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Per market: margin over its required outcomes, profit and whether every outcome
    is there. Markets of unsupported types are left out.

    ``evaluated``: the outcomes are exactly the required ones (one more disqualifies).
    """
    group = group or GROUP
    need = required(F.col("market_type"))
    # one value an outcome, so the aggregate is partial before the shuffle and the sum has a fixed order
    codes = sorted({o for kind in REQUIRED_OUTCOMES.values() for o in kind})
    out = supported(best).groupBy(*group).agg(
        *[F.max(F.when(F.col("outcome") == c, F.lit(1.0) / F.col("odds").cast("double"))).alias(f"_{c}") for c in codes],
        *[F.max(F.col("outcome") == c).alias(f"_has_{c}") for c in codes],
        F.count_if(~F.col("outcome").isin(*codes) | F.col("outcome").isNull()).alias("_strange"),
    )
    if "market_type" not in group:
        raise ValueError("a market's type is part of its identity")
    names = F.array_compact(F.array(*[F.when(F.col(f"_has_{c}"), F.lit(c)) for c in codes]))
    margin = sum((F.when(F.array_contains(need, F.lit(c)), F.coalesce(f"_{c}", F.lit(0.0))).otherwise(F.lit(0.0)) for c in codes), F.lit(0.0))
    missing = F.array_except(need, names)
    return (
        out.withColumn("missing_outcomes", F.array_join(missing, ","))
        .withColumn("evaluated", (F.size(missing) == 0) & (F.size(F.array_except(names, need)) == 0) & (F.col("_strange") == 0))
        .withColumn("margin", F.when(F.size(missing) == 0, margin))
        .withColumn("is_surebet", F.col("margin") < 1)
        .withColumn("profit_percent", F.when(F.col("is_surebet"), (1 / F.col("margin") - 1) * 100).when(F.col("margin").isNotNull(), F.lit(0.0)))
        .drop("_strange", *[f"_{c}" for c in codes], *[f"_has_{c}" for c in codes])
    )


def stakes(best: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Best prices with the share of the stake that each outcome of a whole market takes."""
    group = group or GROUP
    margins = arbitrage(best, group).filter("margin is not null").select(*group, "margin")
    return _on(best.filter(F.array_contains(required(F.col("market_type")), F.col("outcome"))), margins, group).withColumn(
        "stake_percent", (1 / F.col("odds").cast("double")) / F.col("margin") * 100
    )


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on null-safe equality of ``keys``; the right side's copies are dropped."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(other[f"_r_{k}"])
    return left.join(other, cond, how).drop(*[f"_r_{k}" for k in keys])


def surebets(quotes: DataFrame, policy: Freshness, now: Column) -> DataFrame:
    """Latest, fresh and coherent quotes -> best prices -> evaluated markets, with
    ``is_surebet``: both what was found and what was looked at."""
    return arbitrage(best_odds(coherent(latest(quotes), policy, now))).filter("evaluated")


def surebet_legs(quotes: DataFrame, policy: Freshness, now: Column) -> DataFrame:
    """The legs of each surebet as an array of structs."""
    best = best_odds(coherent(latest(quotes), policy, now))
    found = arbitrage(best).filter("evaluated and is_surebet").select(*GROUP, "margin", "profit_percent")
    legs = _on(stakes(best).drop("margin"), found, GROUP)
    leg = F.struct("outcome", "bookmaker_id", "odds", F.col("stake_percent"), "quote_time")
    return legs.groupBy(*GROUP, "margin", "profit_percent").agg(F.array_sort(F.collect_list(leg)).alias("legs"))


# ------------------------------------------------------------- outliers


def medians(quotes: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Per outcome: number of quotes and exact median, the mean of the middle two if even. Quotes are counted by
    value before they meet; the middle ones are order statistics of the running counts."""
    group = group or [*GROUP, "outcome"]
    counted = quotes.filter("odds is not null").groupBy(*group, "odds").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*group).orderBy("odds")
    upto = counted.withColumn("_u", F.sum("_c").over(w)).withColumn("n", F.sum("_c").over(Window.partitionBy(*group)))
    low = F.min(F.when(F.col("_u") >= F.floor((F.col("n") + 1) / 2), F.col("odds")))
    high = F.min(F.when(F.col("_u") >= F.floor(F.col("n") / 2) + 1, F.col("odds")))
    return upto.groupBy(*group, "n").agg(((low + high) * F.lit("0.5").cast("decimal(2,1)")).cast("decimal(24,6)").alias("median"))


def outliers(quotes: DataFrame, percent: float = 15.0, least: int = 3) -> DataFrame:
    """Quotes that lie ``percent`` or more from the median of at least ``least``."""
    group = [*GROUP, "outcome"]
    both = _on(quotes, medians(quotes).filter(F.col("n") >= least), group)
    gap = F.col("odds") - F.col("median")
    limit = F.lit(Decimal(str(percent))).cast("decimal(8,4)")
    return both.filter(F.abs(gap) * F.lit(100) >= limit * F.col("median")).withColumn(
        "deviation_percent", gap.cast("double") / F.col("median").cast("double") * 100
    )


def value_gaps(quotes: DataFrame, percent: float = 15.0, least: int = 3) -> DataFrame:
    """Outliers above the median."""
    return outliers(quotes, percent, least).filter("odds > median")


def value_gap_evaluated(quotes: DataFrame, least: int = 3) -> DataFrame:
    """Outcomes that had enough quotes to be judged."""
    return medians(quotes).filter(F.col("n") >= least).select(*GROUP, "outcome", "n")


# ------------------------------------------------------------- lag, movement


def bookmaker_lag(quotes: DataFrame, seconds: float = 120) -> DataFrame:
    """Quotes that trail the newest of their outcome by at least ``seconds``."""
    w = Window.partitionBy(*GROUP, "outcome")
    newest = F.max("quote_time").over(w)
    out = quotes.withColumns({"_n": F.count("*").over(w), "newest_quote_time": newest})
    lag = (_micros(F.col("newest_quote_time")) - _micros(F.col("quote_time"))) / 1e6
    return out.withColumn("lag_seconds", lag).filter((F.col("_n") >= 2) & (F.col("lag_seconds") >= seconds)).drop("_n")


def movements(quotes: DataFrame, percent: float = 10.0, window_seconds: float = 24 * 3600) -> DataFrame:
    """The last two readings of each series from one provider, compared.

    ``clock_regression``: the quote times run backwards. ``order_violation``: the
    reading that is newer by quote time was observed earlier; such a pair is flagged
    and not detected, where raising would end the whole sweep.
    """
    pair = last_two_same_provider(quotes)
    key = ["event_id", "bookmaker_id", *MARKET, "outcome"]
    side = F.struct("odds", "observed_at", "quote_time", "id")
    both = pair.groupBy(*key).agg(
        F.max(F.when(F.col("reading") == 1, side)).alias("c"), F.max(F.when(F.col("reading") == 2, side)).alias("p")
    ).filter("p is not null")
    return compared(both, key, percent, window_seconds)


def compared(both: DataFrame, key: list[str], percent: float, window_seconds: float) -> DataFrame:
    """Movements from the last two readings of each series, ``c`` and ``p`` before it (odds, observed_at, quote_time, id)."""
    elapsed = (_micros(F.col("c.quote_time")) - _micros(F.col("p.quote_time"))) / 1e6
    change = F.col("c.odds") - F.col("p.odds")
    limit = F.lit(Decimal(str(percent))).cast("decimal(8,4)")
    out = both.select(
        *key,
        F.col("p.odds").alias("previous_odds"), F.col("c.odds").alias("current_odds"),
        F.col("p.observed_at").alias("previous_observed_at"), F.col("c.observed_at").alias("current_observed_at"),
        (change.cast("double") / F.col("p.odds").cast("double") * 100).alias("change_percent"),
        elapsed.alias("elapsed_seconds"),
        (elapsed < 0).alias("clock_regression"),
        (F.col("c.observed_at") < F.col("p.observed_at")).alias("order_violation"),
        (F.abs(change) * F.lit(100) >= limit * F.col("p.odds")).alias("_large"),
    )
    inside = (F.col("elapsed_seconds") >= 0) & (F.col("elapsed_seconds") <= window_seconds)
    return out.withColumn("detected", F.col("_large") & inside & ~F.col("order_violation")).drop("_large")
