"""The quote feed as a stream: the same transformations, with state where batch has windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MARKET, SERIES

NULLABLE = ["market_line", "market_rules", "market_specifier", "provider_id"]


def watch_captures(spark: SparkSession, folder: str, archive: str | None = None) -> DataFrame:
    """Drop folder of capture files: observed when written; archived when parsed."""
    reader = spark.readStream.format("text").option("wholetext", True)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder).select(F.col("value").alias("payload"), F.col("_metadata.file_modification_time").alias("observed_at"))


def dedupe(quotes: DataFrame, watermark: str = "7 days") -> DataFrame:
    """First reading of a series at a time wins. Null parts of the identity are equal."""
    keyed = quotes.withColumns({f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in MARKET})
    keys = [c for c in SERIES if c not in MARKET] + [f"_{c}" for c in MARKET] + ["observed_at"]
    return keyed.withWatermark("observed_at", watermark).dropDuplicatesWithinWatermark(keys).drop(*[f"_{c}" for c in MARKET])


def latest(quotes: DataFrame) -> DataFrame:
    """The newest reading of every series so far (update or complete mode). A late reading
    can't replace a newer one: the order is that of quote time, not of arrival."""
    order = F.struct("quote_time", "observed_at", "id")
    return quotes.groupBy(*SERIES).agg(F.max_by(F.struct("id", "odds", "quote_time", "provider_id"), order).alias("r")).select(*SERIES, "r.*")

