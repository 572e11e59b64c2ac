"""Row validation in two stages, with reasons.

Raw rows carry text: numbers and timestamps are judged before any cast, because a cast
loses whether a timestamp named its offset. Semantic checks only run on rows without a
structural error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A time of day and its offset: Z, or hours with or without minutes and seconds.
OFFSET = r"[T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?\s?(Z|z|[+-]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?)$"
HIGH_ODDS = 1000


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")).rlike(r"^\s*$")


def _codes(*pairs: tuple[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in pairs]), lambda x: x.isNotNull())


def naive(c: str) -> Column:
    """A timestamp text without an offset (null is not naive)."""
    return F.col(c).isNotNull() & ~F.col(c).rlike(OFFSET)


def validate(raw: DataFrame) -> DataFrame:
    """``raw`` with text columns source, sport, league, home_team, away_team, start_time,
    observed_at, source_timestamp, market_type and odds MAP<STRING, STRING> -> adds
    errors and warnings (arrays of codes), stage and is_valid."""
    same = F.lower(F.trim(F.coalesce("home_team", F.lit("")))) == F.lower(F.trim(F.coalesce("away_team", F.lit(""))))
    structural = _codes(
        ("missing-source", _blank("source")), ("missing-sport", _blank("sport")), ("missing-league", _blank("league")),
        ("missing-home-team", _blank("home_team")), ("missing-away-team", _blank("away_team")),
        ("same-home-away-team", same), ("missing-market", F.col("market_type").isNull()),
        ("missing-odds", F.coalesce(F.size("odds"), F.lit(0)) <= 0),
    )
    # entries by key, so the order of codes doesn't depend on the order of the map
    entries = F.array_sort(F.map_entries("odds"))

    def price(v: Column) -> Column:
        return v.try_cast("double")

    def exact(v: Column) -> Column:  # 1.00000000000000001 is more than 1
        return v.try_cast("decimal(38,28)")

    def per_entry(e: Column) -> Column:
        number = price(e["value"])
        finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
        low = F.coalesce(exact(e["value"]) <= F.lit(1).cast("decimal(38,28)"), number <= 1.0)
        return _codes(
            ("missing-outcome", F.trim(e["key"]) == ""),
            ("invalid-odds-type", number.isNull()),
            ("invalid-odds-value", number.isNotNull() & (~finite | low)),
        )

    keys = F.array_sort(F.map_keys("odds"))
    three = F.array(F.lit("1"), F.lit("2"), F.lit("X"))
    semantic = F.concat(
        F.flatten(F.transform(entries, per_entry)),
        _codes(
            ("invalid-three-way-outcomes", (F.col("market_type") == "three_way") & (keys != three)),
            ("naive-source-timestamp", naive("source_timestamp")),
            ("naive-observed-at", naive("observed_at")),
            ("naive-start-time", naive("start_time")),
        ),
    )
    high = F.filter(entries, lambda e: F.coalesce(price(e["value"]) > HIGH_ODDS, F.lit(False)) & (price(e["value"]) < float("inf")))
    warnings = F.transform(high, lambda e: F.lit("suspiciously-high-odds"))
    out = raw.withColumn("_s", structural)
    sound = F.size("_s") == 0
    nothing = F.array().cast("array<string>")
    return (
        out.withColumn("errors", F.when(sound, semantic).otherwise(F.col("_s")))
        .withColumn("warnings", F.when(sound, warnings).otherwise(nothing))
        .withColumn("stage", F.when(~sound, "structural").when(F.size("errors") > 0, "semantic"))
        .withColumn("is_valid", F.col("stage").isNull())
        .drop("_s")
    )


def rejection_reason(stage: Column, codes: Column) -> Column:
    """``stage: code, code``; null for accepted rows."""
    return F.when(stage.isNotNull(), F.concat(stage, F.lit(": "), F.array_join(codes, ", ")))


def rejections_by_stage(payloads: DataFrame) -> DataFrame:
    """Counts by what stands before the colon of the reason."""
    return (
        payloads.filter(~F.col("accepted"))
        .groupBy(F.substring_index("rejection_reason", ":", 1).alias("stage")).agg(F.count("*").alias("rejected"))
    )


def run_status(accepted: Column, rejected: Column, audit_failures: Column, complete: Column, aborted: Column) -> Column:
    """How a collector run ended."""
    return (
        F.when(aborted, F.when(accepted > 0, "partial").otherwise("failed"))
        .when((accepted == 0) & (rejected > 0), "failed")
        .when((rejected > 0) | (audit_failures > 0) | ~complete, "partial")
        .otherwise("success")
    )


def run_metrics(runs: DataFrame) -> DataFrame:
    """acceptance_rate (0 when nothing came) and duration_seconds (null while running)."""
    took = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return runs.withColumn(
        "acceptance_rate", F.coalesce(F.try_divide(F.col("records_accepted").cast("double"), F.col("records_received").cast("double")), F.lit(0.0))
    ).withColumn("duration_seconds", took)
