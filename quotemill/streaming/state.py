"""Streams that keep state with an end: signals that expire by timers, and the newest readings of a series.

Both keep their state in RocksDB (``rocksdb`` sets it for a session), so it is bounded by disk and
checkpointed by changes; a lost executor's state is read back from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model import SERIES, TERMINAL
from ..operators.signals import ACTIVE, EXPIRED, RESOLVED
from ..workers import importable


def rocksdb(spark: SparkSession) -> None:
    """The state store that streams with timers need; a setting of the session."""
    importable()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _utc(micros: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)


# ------------------------------------------------------------- signals


def signal_log(candidates: DataFrame, evaluated: DataFrame, lifecycle: DataFrame, key: list[str]) -> DataFrame:
    """One stream of what happens to an event's signals, from three: candidates and evaluated keys (key, sweep_ts,
    start_time of the event, edge of candidates) and statuses (event_id, updated_at, lifecycle).

    Times are carried as UTC milliseconds and microseconds, so nothing depends on a worker's zone."""
    name = F.to_json(F.struct(*[k for k in key if k != "event_id"]), {"ignoreNullFields": "false"})
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    cols = lambda at, kind, name, edge, start, life: [
        "event_id", F.col(at).cast("timestamp").alias("at"), micros(at).alias("us"), F.lit(kind).alias("kind"), name.alias("name"), edge.cast("double").alias("edge"),
        start.alias("start_us"), life.alias("lifecycle"),
    ]
    null = lambda kind: F.lit(None).cast(kind)
    found = candidates.select(*cols("sweep_ts", "C", name, F.col("edge"), micros("start_time"), null("string")))
    seen = evaluated.select(*cols("sweep_ts", "M", name, null("double"), micros("start_time"), null("string")))
    told = lifecycle.select(*cols("updated_at", "S", null("string"), null("double"), null("long"), F.col("lifecycle")))
    return found.unionByName(seen).unionByName(told)


class Signals(StatefulProcessor):
    """The signals of an event. Rows wait until the watermark has passed them and are then taken in order of
    time, so the order in which they come doesn't matter. Expiry has a clock of its own: its ticks
    are the moments at which a sweep would have found the event over, whether there is one or not."""

    def __init__(self, ttl_hours: float, tick_seconds: int, keep_hours: float) -> None:
        self.ttl, self.tick, self.keep = int(ttl_hours * 3_600_000_000), tick_seconds * 1_000_000, int(keep_hours * 3_600_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.event = handle.getValueState("event", "start_us long, over_us long, last_us long")
        self.signals = handle.getMapState("signals", "name string", "status string, episode int, peak double, found_us long")
        self.waiting = handle.getListState("waiting", "us long, kind string, name string, edge double, start_us long, lifecycle string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = [(r.us, r.kind, r.name, r.edge, r.start_us, r.lifecycle) for r in rows]
        if new:
            self.waiting.appendList(new)
            for at in {-(-r[0] // 1000) for r in new}:
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        # all that the watermark has passed is taken at once; the timers that come after find nothing to do
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        rows = [*self.waiting.get()] if self.waiting.exists() else []
        if not rows and not self.event.exists():
            return iter(())
        due = sorted((tuple(r) for r in rows if r[0] <= now), key=lambda r: (r[0], r[1] != "S", r[1], r[2] or ""))
        later = [tuple(r) for r in rows if r[0] > now]
        start, over, last = self.event.get() if self.event.exists() else (None, None, None)
        live = {k[0]: list(v) for k, v in self.signals.iterator()} if self.signals.exists() else {}
        out: list[tuple] = []

        def ends(found: int) -> int | None:
            """The first tick after a finding at which the event is over."""
            late = start is not None and (max(found, start + self.ttl) // self.tick + 1) * self.tick
            told = over is not None and max(-(-over // self.tick), found // self.tick + 1) * self.tick
            return min((x for x in (late, told) if x is not False), default=None)

        def expire(limit: int) -> None:
            for name, s in live.items():
                at = ends(s[3]) if s[0] == ACTIVE else None
                if at is not None and at < limit:
                    s[0] = EXPIRED
                    out.append((name, at, "expired", None, EXPIRED, s[1], s[2]))

        done: set = set()
        for us, kind, name, edge, begins, lifecycle in due:
            expire(us)
            last = us if last is None else max(last, us)
            start = begins if start is None else start
            if kind == "S":
                over = (over if over is not None else us) if lifecycle in TERMINAL else None
                continue
            if kind == "M" and (us, name) in done:
                continue  # found in the same sweep
            s = live.get(name)
            if kind == "C":
                again = (us, name) in done
                done.add((us, name))
                if s is None or s[0] != ACTIVE:
                    event = "created" if s is None else "reactivated"
                    s = live[name] = [ACTIVE, 1 if s is None else s[1] + 1, edge, us]
                    out.append((name, us, event, edge, ACTIVE, s[1], s[2]))
                else:
                    if edge is not None and (s[2] is None or edge > s[2]):
                        s[2] = edge
                        if not again:
                            out.append((name, us, "edge_peak", edge, ACTIVE, s[1], s[2]))
                    s[3] = us
            elif s is not None and s[0] == ACTIVE:
                s[0] = RESOLVED
                out.append((name, us, "resolved", None, RESOLVED, s[1], s[2]))
        expire(now + 1)

        events = [Row(event_id=key[0], name=n, sweep_ts=_utc(at), history_event=e, edge=x, status=st, episode=ep, peak_edge=p) for n, at, e, x, st, ep, p in out]
        active = [s[3] for s in live.values() if s[0] == ACTIVE]
        if not later and not active and last is not None and now >= last + self.keep:
            for state in (self.event, self.signals, self.waiting):
                state.clear()
            return iter(events)
        if later:
            self.waiting.put(later)
        elif rows:
            self.waiting.clear()
        self.event.update((start, over, last))
        for name, s in live.items():
            self.signals.updateValue((name,), tuple(s))
        following = [x for x in map(ends, active) if x is not None and x > now]
        if not active and last is not None:
            following.append(last + self.keep)
        for at in {-(-x // 1000) for x in following}:
            self.handle.registerTimer(at)
        return iter(events)


def signals(log: DataFrame, key: list[str], ttl_hours: float = 3, tick_seconds: int = 60, keep_hours: float = 24, delay: str = "1 hour") -> DataFrame:
    """Signal history (key, sweep_ts, history_event, edge, status, episode, peak_edge) from a ``signal_log``.

    Equals ``operators.signals.history`` over the whole log with the ticks as sweeps, however
    late within ``delay`` rows come; rows later than that are dropped by the watermark. An event's state goes
    ``keep_hours`` after its last row if nothing of it is active: a finding after that is a new signal."""
    rocksdb(log.sparkSession)
    kinds = {"event_id": dict(log.dtypes)["event_id"]}
    schema = f"event_id {kinds['event_id']}, name string, sweep_ts timestamp, history_event string, edge double, status string, episode int, peak_edge double"
    rows = log.withWatermark("at", delay).groupBy("event_id").transformWithState(Signals(ttl_hours, tick_seconds, keep_hours), schema, "append", "EventTime")
    rest = [k for k in key if k != "event_id"]
    return rows.select("event_id", *[F.get_json_object("name", f"$.{k}").alias(k) for k in rest], "sweep_ts", "history_event", "edge", "status", "episode", "peak_edge")


# ------------------------------------------------------------- newest readings and movements


class Newest(StatefulProcessor):
    """The two newest readings that each provider has of a series. State that nothing was written to for the TTL goes."""

    def __init__(self, ttl_days: float) -> None:
        self.ttl = int(ttl_days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        reading = ", ".join(f"{p}_{x}" for p in "cp" for x in ("quote_us long", "observed_us long", "id long", "odds decimal(18,6)"))
        self.readings = handle.getMapState("readings", "provider string", reading, ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = {k[0]: [tuple(v[:4]), tuple(v[4:])] for k, v in self.readings.iterator()} if self.readings.exists() else {}
        before, changed = self.pair(known), set()
        for r in rows:
            own = known.setdefault(r.provider, [])
            pair = sorted({*(x for x in own if x[2] is not None), (r.quote_us, r.observed_us, r.id, r.odds)}, reverse=True)[:2]
            if pair != [x for x in own if x[2] is not None]:
                known[r.provider] = [*pair, *[(None,) * 4] * (2 - len(pair))]
                changed.add(r.provider)
        for p in changed:
            self.readings.updateValue((p,), known[p][0] + known[p][1])
        pair = self.pair(known)
        if pair is not None and pair != before:
            c, p = pair
            yield Row(series=key[0], c_id=c[2], c_odds=c[3], c_quote=c[0], c_observed=c[1], p_id=p[2], p_odds=p[3], p_quote=p[0], p_observed=p[1])

    @staticmethod
    def pair(known: dict) -> tuple | None:
        """The newest reading of all and its provider's one before it, if there is one."""
        if not known:
            return None
        c, p = max((v for v in known.values()), key=lambda v: v[0][:3])
        return None if p[2] is None else (c, p)


def movements(quotes: DataFrame, percent: float = 10.0, window_seconds: float = 24 * 3600, ttl_days: float = 7) -> DataFrame:
    """The movement of a series whenever its last two readings of one provider change, with
    ``clock_regression`` and ``order_violation`` as in ``operators.analysis.movements``: readings are ordered by
    their own times, not by arrival, and what was emitted last for a series is what the batch form says."""
    from ..operators.analysis import compared

    rocksdb(quotes.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in quotes.schema}
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    series = F.to_json(F.struct(*SERIES), {"ignoreNullFields": "false"})
    rows = quotes.select(
        series.alias("series"), F.coalesce(F.concat(F.lit("p"), F.col("provider_id").cast("string")), F.lit("")).alias("provider"), micros("quote_time").alias("quote_us"),
        micros("observed_at").alias("observed_us"), F.col("id").cast("long").alias("id"), F.col("odds").cast("decimal(18,6)").alias("odds"),
    )
    side = lambda p: f"{p}_id long, {p}_odds decimal(18,6), {p}_quote long, {p}_observed long"
    pairs = rows.groupBy("series").transformWithState(Newest(ttl_days), f"series string, {side('c')}, {side('p')}", "update", "ProcessingTime")
    read = F.from_json("series", ", ".join(f"`{c}` {kinds[c]}" for c in SERIES))
    time = lambda c, like: F.timestamp_micros(F.col(c)).cast(kinds[like])
    both = pairs.select(read.alias("s"), *[
        F.struct(F.col(f"{p}_odds").cast(kinds["odds"]).alias("odds"), time(f"{p}_observed", "observed_at").alias("observed_at"), time(f"{p}_quote", "quote_time").alias("quote_time"), F.col(f"{p}_id").alias("id")).alias(p)
        for p in "cp"
    ]).select("s.*", "c", "p")
    return compared(both, SERIES, percent, window_seconds)

