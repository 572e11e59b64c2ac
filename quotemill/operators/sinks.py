"""Appending results: whole batches in one commit, duplicates left out, audits kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import MARKET

TRANSITION = ["event_id", "bookmaker_id", *MARKET, "outcome", "previous_odds", "current_odds", "previous_observed_at", "current_observed_at"]


def append(df: DataFrame, folder: str, by: list[str] | None = None) -> None:
    """All rows of a batch, or none: one job commit."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(folder)


def new_movements(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Movements whose whole transition isn't known yet, each once."""
    once, known = found.dropDuplicates(TRANSITION).alias("n"), existing.select(*TRANSITION).alias("k")
    same = F.lit(True)
    for c in TRANSITION:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}"))
    return once.join(known, same, "left_anti")


def audit_payloads(records: DataFrame, run_id: Column, accepted: Column, reason: Column, at: Column) -> DataFrame:
    """Every record as it came, with what became of it."""
    return records.select(
        run_id.alias("collector_run_id"), "source", F.to_json(F.struct(*[c for c in records.columns if not c.startswith("_")])).alias("payload"),
        accepted.alias("accepted"), reason.alias("rejection_reason"), at.alias("received_at"),
    )
