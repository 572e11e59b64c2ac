"""Collectors: what a feed is called, how it is parsed, and when it is due."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..operators.operations import sources_due


@dataclass(frozen=True)
class Collector:
    """``parse``: captures (payload, observed_at) -> records."""

    source: str
    provider_id: str
    parser_version: str
    parse: Callable[[DataFrame], DataFrame]
    min_interval_seconds: int = 0


@dataclass(frozen=True)
class Collection:
    collector: Collector
    captures: DataFrame
    records: DataFrame
    complete: bool = True


def collect(collector: Collector, captures: DataFrame, complete: bool = True) -> Collection:
    return Collection(collector, captures, collector.parse(captures), complete)


def due(collectors: list[Collector], runs: DataFrame, now: Column) -> list[Collector]:
    """The collectors whose last run lies at least their interval back (a handful of rows)."""
    spark = runs.sparkSession
    table = spark.createDataFrame([(c.source, c.min_interval_seconds) for c in collectors], "source string, min_interval_seconds int")
    names = {r.source for r in sources_due(runs, table, now).collect()}
    return [c for c in collectors if c.source in names]


def all_records(collections: list[Collection]) -> DataFrame:
    out = collections[0].records
    for c in collections[1:]:
        out = out.unionByName(c.records, allowMissingColumns=True)
    return out
