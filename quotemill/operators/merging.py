"""Merging of duplicate identities to a fixpoint.

Teams, competitions and events that are found to be one make others one: competitions of one name share their
teams' scope, equal teams make equal events, and events that a source calls by one id have the same teams and
competition. What an event's id says of its teams and competition doesn't depend on labels, so merges lead one way only:
competitions, then teams, then events, each resolved once. Of a kind, the groups of equal keys are contracted to their
smallest ids first; chains are resolved among these. The smallest id of a group survives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def connected(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) -> (id, label): of each id but the smallest of its group, that smallest. Every node is linked to the smallest
    of its neighbours, its larger and its smaller ones in turn, so that paths halve; a hub's links become a star's."""
    edges = cut(pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # larger neighbours go to the smallest neighbour, or the node itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # smaller neighbours, and the node, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = cut(small.distinct())
        if new.count() == edges.count() and new.join(edges, ["a", "b"], "left_anti").isEmpty():  # both are distinct
            return new.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label"))
        edges = new


def _starred(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (id, ...) that have all of ``by``: each id with ``m``, the smallest of those that agree with it."""
    known = rows.select("id", *by).dropna()
    return known.join(known.groupBy(*by).agg(F.min("id").alias("m")), by).select("id", "m")


def _resolved(ids: DataFrame, keyed: DataFrame, by: list[str], called: list[DataFrame]) -> DataFrame:
    """(id, label) of those of ``ids`` that aren't the smallest of their group: ``keyed`` (id, ...) are one if they agree in
    ``by``, ``called`` (id, source, source_event_id) if they do in source and id."""
    stars = cut(_starred(keyed.join(ids, "id", "left_semi"), by))
    first = cut(stars.groupBy("id").agg(F.min("m").alias("l")).filter("l < id"))
    known = first.withColumnRenamed("id", "a")
    # rows of one id in several groups join these; ids that a source gives join the groups of what they name
    pairs = stars.join(stars.groupBy("id").agg(F.min("m").alias("l"), F.max("m").alias("_most")).filter("l < _most").drop("_most"), "id").select(F.col("m").alias("a"), F.col("l").alias("b"))
    for one in called:
        own = one.join(ids, "id", "left_semi").dropna().distinct().withColumnRenamed("id", "a").join(known, "a", "left")
        own = own.select("source", "source_event_id", F.coalesce("l", "a").alias("id")).distinct()
        pairs = pairs.unionByName(_starred(own, ["source", "source_event_id"]).select(F.col("id").alias("a"), F.col("m").alias("b")))
    moved = cut(connected(pairs))
    if moved.isEmpty():
        return first.select("id", F.col("l").alias("label"))
    # a group's smallest id may move too
    to = moved.select(F.col("id").alias("l"), F.col("label").alias("_to"))
    of_groups = first.join(to, "l", "left").select("id", F.coalesce("_to", "l").alias("label"))
    return cut(of_groups.unionByName(moved.join(first, "id", "left_anti").select("id", "label")))


def merged(competitions: DataFrame, teams: DataFrame, events: DataFrame, event_ids: DataFrame) -> DataFrame:
    """(kind, id, survivor_id) of all identities that go: ``competitions`` (id, sport, country, name), ``teams`` (id,
    competition_id, name), ``events`` (id, competition_id, home_team_id, away_team_id, start_time), ``event_ids``
    (source, source_event_id, event_id).

    Competitions are one if sport, country and name agree; teams if name and competition do; events if competition,
    teams and start do, or a source has one id for them, which also makes their teams and competitions one.
    Names are compared as they are: pass comparison keys. Null parts agree with nothing."""
    ids = {k: df.select("id").dropna().distinct() for k, df in (("competition", competitions), ("team", teams), ("event", events))}
    parts = {"competition_id": "competition", "home_team_id": "team", "away_team_id": "team"}
    mentioned = event_ids.select("source", "source_event_id", F.col("event_id").alias("id")).dropna().join(events.select("id", *parts), "id")
    mentioned = cut(mentioned)  # events that a source has an id for, with their parts
    called = lambda column: mentioned.select(F.col(column).alias("id"), "source", "source_event_id")

    def labelled(df: DataFrame, column: str, kind: str) -> DataFrame:
        """``column`` as labels; an id that its table doesn't have is null."""
        known = ids[kind].join(moved[kind], "id", "left").select(F.col("id").alias(column), F.coalesce("label", "id").alias("_is"))
        return df.join(known, column, "left").withColumn(column, F.col("_is")).drop("_is")

    moved = {"competition": _resolved(ids["competition"], competitions, ["sport", "country", "name"], [called("competition_id")])}
    scoped = labelled(teams.select("id", "competition_id", "name"), "competition_id", "competition")
    moved["team"] = _resolved(ids["team"], scoped, ["competition_id", "name"], [called("home_team_id"), called("away_team_id")])
    named = events.select("id", *parts, "start_time")
    for column, kind in parts.items():
        named = labelled(named, column, kind)
    moved["event"] = _resolved(ids["event"], named, [*parts, "start_time"], [called("id")])
    rows = [labels.select(F.lit(k).alias("kind"), "id", F.col("label").alias("survivor_id")) for k, labels in moved.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
