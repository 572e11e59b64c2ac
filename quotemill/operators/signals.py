"""Stateful signals as intervals: a fold over an append log of sweeps instead of updates in place.

Every sweep appends what it found (candidates) and what it looked at (evaluated keys). A finding
holds until its key is found again, or until what ends it: the first sweep that evaluated the
key and didn't find it (RESOLVED), or before that, the first sweep at which the key's event was over (EXPIRED).
A sweep that didn't look at a key says nothing about it, and so makes no row: the rows are the
findings and the first evaluation after each, whatever the number of sweeps. Gaps, endings,
episodes and peaks are window expressions along a key; "the first sweep after" is an as-of merge by
days. A batch over the whole log, a re-run and a stream agree.

Nulls in a key are equal. Findings repeated in a sweep are one, with the largest edge. A candidate counts as
evaluated. Without a start an event isn't late; a sweep at which a key was looked at can't expire it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .merging import cut

ACTIVE, RESOLVED, EXPIRED = "ACTIVE", "RESOLVED", "EXPIRED"
TERMINAL = ("finished", "postponed_or_canceled")


def check_sweeps(candidates: DataFrame, evaluated: DataFrame, key: list[str]) -> DataFrame:
    """Candidates whose key was not evaluated in their sweep: must be empty."""
    seen = evaluated.select(*key, "sweep_ts", F.lit(1).alias("_of")).unionByName(candidates.select(*key, "sweep_ts", F.lit(2).alias("_of")))
    return seen.groupBy(*key, "sweep_ts").agg(F.min("_of").alias("_of")).filter("_of = 2").drop("_of")


def findings(candidates: DataFrame, evaluated: DataFrame, key: list[str]) -> DataFrame:
    """(key, sweep_ts, edge, next_ts, next_found): the findings of each key, with when it was next found or,
    if that comes first, next looked at in vain. Keys that were never found drop out."""
    edge = candidates.schema["edge"].dataType
    log = candidates.select(*key, "sweep_ts", "edge", F.lit(True).alias("found")).unionByName(
        evaluated.select(*key, "sweep_ts", F.lit(None).cast(edge).alias("edge"), F.lit(False).alias("found"))
    )
    w = Window.partitionBy(*key).orderBy("sweep_ts")
    once = log.groupBy(*key, "sweep_ts").agg(F.max("edge").alias("edge"), F.bool_or("found").alias("found"))
    # of a run of vain looks only the first can end anything
    edges = once.withColumn("_after", F.lag("found").over(w)).filter("found or _after")
    return edges.withColumn("next_ts", F.lead("sweep_ts").over(w)).withColumn("next_found", F.lead("found").over(w)).filter("found").drop("found", "_after")


def around(times: DataFrame, sweeps: DataFrame) -> DataFrame:
    """For each distinct time ``at`` the last sweep before it, the first at or after it, and the first after it.

    An as-of merge by days: times meet the sweeps of their own day, and where these don't reach, the
    nearest day that has any. No task holds more than a day's times, or a row a day."""
    both = times.select("at", F.lit(False).alias("_s")).unionByName(sweeps.select(F.col("sweep_ts").alias("at"), F.lit(True).alias("_s")))
    rows = both.filter("at is not null").groupBy("at").agg(F.bool_or("_s").alias("_s")).withColumn("_day", F.to_date("at"))
    sweep = F.when(F.col("_s"), F.col("at"))
    ahead, back = (Window.partitionBy("_day").orderBy(o("at")).rowsBetween(Window.unboundedPreceding, -1) for o in (F.desc, F.asc))
    near = rows.withColumn("_next", F.last(sweep, ignorenulls=True).over(ahead)).withColumn("_last", F.last(sweep, ignorenulls=True).over(back))
    days = rows.groupBy("_day").agg(F.min(sweep).alias("_first"), F.max(sweep).alias("_final"))
    # a row a day: bounded by the calendar
    later, sooner = (Window.orderBy(o("_day")).rowsBetween(Window.unboundedPreceding, -1) for o in (F.desc, F.asc))
    days = days.select("_day", F.last("_first", ignorenulls=True).over(later).alias("_first"), F.last("_final", ignorenulls=True).over(sooner).alias("_final"))
    after = F.coalesce("_next", "_first")
    return near.join(days, "_day").select(
        "at", F.coalesce("_last", "_final").alias("before"), F.when(F.col("_s"), F.col("at")).otherwise(after).alias("from_at"), after.alias("after")
    )


def _first_over(found: DataFrame, sweeps: DataFrame, starts: DataFrame, lifecycle: DataFrame, ttl_hours: int) -> DataFrame:
    """``found`` with ``over_at``: the first sweep after the finding at which its event had started more than
    the TTL ago, or its last status known by then was terminal. ``lifecycle`` (event_id, updated_at, lifecycle)."""
    kind = found.schema["sweep_ts"].dataType
    by_event = Window.partitionBy("event_id").orderBy("updated_at")
    known = lifecycle.groupBy("event_id", F.col("updated_at").cast(kind).alias("updated_at")).agg(F.max("lifecycle").alias("lifecycle"))
    ended = known.withColumn("_until", F.lead("updated_at").over(by_event)).filter(F.col("lifecycle").isin(*TERMINAL)).select("event_id", F.col("updated_at").alias("_since"), "_until")
    begun = starts.groupBy("event_id").agg(F.min("start_time").cast(kind).alias("_start"))
    late = F.greatest("sweep_ts", F.col("_start") + F.make_dt_interval(hours=F.lit(ttl_hours)))
    rows = found.join(begun, "event_id", "left").withColumn("_late", F.when(F.col("_start").isNotNull(), late)).drop("_start")
    times = [rows.select(F.col("_late").alias("at")), rows.select(F.col("sweep_ts").alias("at")), ended.select(F.col("_since").alias("at")), ended.select(F.col("_until").alias("at"))]
    near = cut(around(times[0].unionByName(times[1]).unionByName(times[2]).unionByName(times[3]), sweeps))

    def looked_up(df: DataFrame, at: str, what: str, out: str) -> DataFrame:
        return df.join(near.select(F.col("at").alias(at), F.col(what).alias(out)), at, "left")

    rows = looked_up(looked_up(rows, "_late", "after", "_ttl"), "sweep_ts", "after", "_next")
    # what the terminal statuses are in terms of sweeps: from the first to the last sweep that each holds at
    held = looked_up(looked_up(ended, "_since", "from_at", "_from"), "_until", "before", "_to")
    held = held.withColumn("_to", F.when(F.col("_until").isNotNull(), F.col("_to")).otherwise(F.lit("9999-12-31").cast(kind))).filter("_from <= _to")
    # the first of them, in order, that still holds at a later sweep than the finding
    spans = held.select("event_id", F.struct("_from", "_to").alias("_span"), F.col("_to").alias("_at"))
    both = rows.withColumns({"_span": F.lit(None).cast(spans.schema["_span"].dataType), "_at": F.col("sweep_ts"), "_is": F.lit(1)}).unionByName(
        spans.withColumn("_is", F.lit(0)), allowMissingColumns=True
    )
    # backwards in time; at equal times the finding first, which wants a later sweep
    onward = Window.partitionBy("event_id").orderBy(F.desc("_at"), F.desc("_is")).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_hit", F.last(F.when(F.col("_is") == 0, F.col("_span")), ignorenulls=True).over(onward)).filter("_is = 1")
    closed = F.when(F.col("_hit").isNotNull() & F.col("_next").isNotNull(), F.greatest("_hit._from", "_next"))
    return both.withColumn("over_at", F.least("_ttl", closed)).drop("_span", "_at", "_is", "_hit", "_ttl", "_next", "_late")


def signals(
    candidates: DataFrame, evaluated: DataFrame, sweeps: DataFrame, starts: DataFrame, lifecycle: DataFrame, key: list[str], ttl_hours: int
) -> DataFrame:
    """A row for each finding: key, sweep_ts, edge, found_event (created, reactivated, edge_peak or null), ended_at
    and ended_as (null while it holds or was found again), status after it, episode, peak_edge so far in
    the episode. ``key`` has event_id; ``sweeps`` (sweep_ts) are all that ran; ``starts`` (event_id, start_time)."""
    # read many times below; what precedes it can be a whole detection
    found = _first_over(cut(findings(candidates, evaluated, key)), sweeps, starts, lifecycle, ttl_hours)
    expired = F.col("over_at").isNotNull() & (F.col("next_ts").isNull() | (F.col("over_at") < F.col("next_ts")))
    resolved = F.col("next_ts").isNotNull() & ~F.col("next_found")
    rows = found.withColumn("ended_as", F.when(expired, EXPIRED).when(resolved, RESOLVED)).withColumn("ended_at", F.when(expired, F.col("over_at")).when(resolved, F.col("next_ts")))
    w = Window.partitionBy(*key).orderBy("sweep_ts")
    first = F.row_number().over(w) == 1
    rows = rows.withColumn("_first", first).withColumn("_open", F.col("_first") | F.lag("ended_as").over(w).isNotNull())
    rows = rows.withColumn("episode", F.sum(F.col("_open").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*key, "episode").orderBy("sweep_ts")
    rows = rows.withColumn("peak_edge", F.max("edge").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_before", F.max("edge").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    event = F.when(F.col("_first"), "created").when(F.col("_open"), "reactivated").when(F.col("edge") > F.col("_before"), "edge_peak")
    return rows.select(*key, "sweep_ts", "edge", event.alias("found_event"), "ended_at", "ended_as", F.coalesce("ended_as", F.lit(ACTIVE)).alias("status"), "episode", "peak_edge")


def current(rows: DataFrame, key: list[str]) -> DataFrame:
    """State after the last sweep: status, first and last finding, peak of the current episode."""
    last = F.max_by(F.struct("status", "episode", "peak_edge"), "sweep_ts")
    state = rows.groupBy(*key).agg(F.min("sweep_ts").alias("first_seen_at"), F.max("sweep_ts").alias("last_seen_at"), last.alias("_s"))
    return state.select(*key, "first_seen_at", "last_seen_at", "_s.status", "_s.episode", "_s.peak_edge")


def history(rows: DataFrame, key: list[str]) -> DataFrame:
    """What is recorded of a signal: (key, sweep_ts, history_event, edge, status)."""
    none = F.lit(None).cast(rows.schema["edge"].dataType)
    found = F.when(F.col("found_event").isNotNull(), F.struct("sweep_ts", F.col("found_event").alias("history_event"), "edge", F.lit(ACTIVE).alias("status")))
    ended = F.when(F.col("ended_as").isNotNull(), F.struct(F.col("ended_at").alias("sweep_ts"), F.lower("ended_as").alias("history_event"), none.alias("edge"), F.col("ended_as").alias("status")))
    return rows.select(*key, F.inline(F.array(found, ended))).filter("history_event is not null")


def active_counts(rows: DataFrame, sweeps: DataFrame) -> DataFrame:
    """Per sweep from the first finding on: signals that were active before its expiry ran, and after.

    Openings and endings are counted a sweep; running sums go by days, and over the days."""
    begin = F.col("found_event").isin("created", "reactivated")
    plus = F.when(begin, F.struct("sweep_ts", F.lit(1).alias("d"), F.lit(0).alias("x")))
    minus = F.when(F.col("ended_as").isNotNull(), F.struct(F.col("ended_at").alias("sweep_ts"), F.lit(-1).alias("d"), (F.col("ended_as") == EXPIRED).cast("int").alias("x")))
    changes = rows.select(F.inline(F.array(plus, minus))).filter("sweep_ts is not null").unionByName(sweeps.select("sweep_ts", F.lit(0).alias("d"), F.lit(0).alias("x")))
    each = changes.groupBy("sweep_ts").agg(F.sum("d").alias("d"), F.sum("x").alias("x"), F.max(F.abs("d")).alias("_any")).withColumn("_day", F.to_date("sweep_ts"))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    days = each.groupBy("_day").agg(F.sum("d").alias("_d"), F.max("_any").alias("_a"))
    days = days.select("_day", F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_d"), F.coalesce(F.max("_a").over(before), F.lit(0)).alias("_a"))
    upto = Window.partitionBy("_day").orderBy("sweep_ts").rowsBetween(Window.unboundedPreceding, 0)
    out = each.withColumn("_n", F.sum("d").over(upto)).withColumn("_begun", F.max("_any").over(upto)).join(days, "_day").filter(F.greatest("_begun", "_a") > 0)
    after = F.col("_n") + F.col("_d")
    return out.select("sweep_ts", (after + F.col("x")).alias("active_before_expiry"), after.alias("active_after"))

