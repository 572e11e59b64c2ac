"""The quote tape: events of the test tables read as price observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tape_of(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    two_sided = ~F.col("event_type").isin("view", "click", "purchase")
    outcome = F.create_map(*[F.lit(x) for x in ("view", "1", "click", "X", "purchase", "2", "signup", "OVER", "error", "UNDER")])
    odds = F.lit("1.01").cast("decimal(18,4)") + F.col("value").cast("decimal(12,2)") * F.lit("0.01").cast("decimal(4,2)")
    return (
        events.select(
            F.col("event_id").alias("id"),
            (F.col("user_id") % 40).alias("event_id"),
            (k % 8).cast("long").alias("bookmaker_id"),
            (k % 3).cast("long").alias("provider_id"),
            F.when(two_sided, F.lit("totals")).otherwise(F.lit("three_way")).alias("market_type"),
            F.lit("full_time").alias("market_period"),
            F.lit("pre_match").alias("market_phase"),
            F.when(two_sided, F.when(F.col("event_id") % 2 == 0, "2.5").otherwise("3.5")).alias("market_line"),
            F.lit(None).cast("string").alias("market_rules"),
            F.lit(None).cast("string").alias("market_specifier"),
            outcome[F.col("event_type")].alias("outcome"),
            odds.cast("decimal(18,4)").alias("odds"),
            F.col("ts").cast("timestamp_ntz").alias("observed_at"),
            F.when(k % 4 == 0, F.lit(None)).otherwise(F.col("ts").cast("timestamp_ntz") - F.make_dt_interval(mins=k)).alias("source_timestamp"),
        )
        .withColumn("quote_time", F.coalesce("source_timestamp", "observed_at"))
    )


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape_of(table(spark, sf_dir, "events"))
