"""Identity: bookmakers, names, events; set-based where it can be, sequential where it must.

Names resolve in steps: aliases and exact names are joins, and names left over meet only
candidates of their own scope and marks. Records that may create identities depend on what
came before them: their distinct keys run in order through a ``Resolver``, which is a fold
over an append log, the identity catalogue. It starts from the log so far and its own entries
are the next part of the log. What can't depend on each other runs apart: sports, and the
countries of a sport whose competitions all name one.

False merges are worse than duplicates: what is ambiguous or merely similar makes a new,
unverified identity.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..workers import importable
from .fuzzy import similar

# ------------------------------------------------------------- joins


def stable_id(kind: str, *parts: Column) -> Column:
    """Deterministic id of a new entity from its natural key: the same on every retry. 128 bits of a
    hash of the parts as JSON, so nulls, and separators within parts, make other ids."""
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, 32))


def resolve_bookmakers(feed: DataFrame, bookmakers: DataFrame, mappings: DataFrame) -> DataFrame:
    """``feed`` (provider_id, source_bookmaker_id, name) with bookmaker_id and method: the
    provider's mapping, else the normalised name, else a new identity; never fuzzy."""
    m = mappings.select(F.col("provider_id").alias("_p"), F.col("source_bookmaker_id").alias("_s"), F.col("bookmaker_id").alias("_mapped"))
    b = T.with_key(bookmakers, "canonical_name", "_key", "bookmaker").groupBy("_key").agg(F.min("bookmaker_id").alias("_named"))
    out = feed.join(m, (F.col("provider_id") == F.col("_p")) & (F.col("source_bookmaker_id") == F.col("_s")), "left")
    out = T.with_key(out, "name", "_nk", "bookmaker").withColumnRenamed("_nk", "_k").join(b, F.col("_k") == F.col("_key"), "left")
    return out.select(
        *feed.columns,
        F.coalesce("_mapped", "_named", stable_id("bookmaker", F.col("_k"))).alias("bookmaker_id"),
        F.when(F.col("_mapped").isNotNull(), "mapping").when(F.col("_named").isNotNull(), "name").otherwise("new").alias("method"),
    )


def prioritised(feed: DataFrame, mappings: DataFrame, key: list[str], context: str) -> DataFrame:
    """The mapping of a key in its own context, or else one without a context that was set by hand."""
    specific = mappings.select(*key, F.col(context), F.col("target_id").alias("_specific"))
    generic = mappings.filter((F.col(context) == "") & (F.col("resolution_method") == "manual")).select(*key, F.col("target_id").alias("_generic"))
    return feed.join(specific, [*key, context], "left").join(generic, key, "left").withColumn(
        "target_id", F.coalesce("_specific", "_generic")
    ).drop("_specific", "_generic")


def match_by_time(records: DataFrame, events: DataFrame, key: list[str], tolerance: int) -> DataFrame:
    """The event of the same key whose start lies within ``tolerance`` seconds; more than
    one is ambiguous and matches none.

    Starts are bucketed by the tolerance and a record probes its bucket and both
    neighbours, so the join is an equi-join however dense the calendar is.
    """
    def seconds(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp")) / 1e6

    e = events.select(
        *[F.col(k).alias(f"_{k}") for k in key], F.col("event_id").alias("_event"), seconds("start_time").alias("_at"),
        F.floor(seconds("start_time") / tolerance).alias("_bucket"),
    )
    probe = records.select("id", *key, seconds("start_time").alias("_t")).withColumn(
        "_probe", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("_t") / tolerance) + d))
    )
    cond = (F.col("_probe") == F.col("_bucket")) & (F.abs(F.col("_t") - F.col("_at")) <= tolerance)
    for k in key:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    hits = probe.join(e, cond).groupBy("id").agg(F.count("*").alias("_n"), F.min("_event").alias("_found"))
    return records.join(hits, "id", "left").withColumns(
        {
            "event_id": F.when(F.col("_n") == 1, F.col("_found")),
            "result": F.when(F.col("_n") == 1, "matched").when(F.col("_n") > 1, "ambiguous-event").otherwise("no-event-match"),
        }
    ).drop("_n", "_found")


def nearest_by_time(records: DataFrame, events: DataFrame, key: list[str], tolerance: int) -> DataFrame:
    """The event of the same key that starts nearest to a record, within ``tolerance`` seconds. Two events at the same
    distance, before and after or at one time, are ambiguous and match none.

    A two-sided as-of merge: records and events of a key in order of time, each record with the last event up to it and the
    first from it on. Nothing is fanned out, however dense the calendar is."""
    at = F.unix_micros(F.col("start_time").cast("timestamp")).alias("at")
    starts = events.select(*key, at, "event_id").groupBy(*key, "at").agg(F.count("*").alias("n"), F.min("event_id").alias("event_id"))
    hit = F.struct("at", "n", "event_id").alias("hit")
    asked = records.select("id", *key, at)
    both = asked.withColumn("hit", F.lit(None).cast(starts.select(hit).schema["hit"].dataType)).unionByName(starts.select(F.lit(None).cast(asked.schema["id"].dataType).alias("id"), *key, "at", hit))
    # at equal times the event comes first, in either direction
    upto, onward = (Window.partitionBy(*key).orderBy(o("at"), F.desc(F.col("hit").isNotNull())).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc, F.desc))
    sides = both.withColumn("b", F.last("hit", ignorenulls=True).over(upto)).withColumn("a", F.last("hit", ignorenulls=True).over(onward)).filter("hit is null")
    before, after = F.col("at") - F.col("b.at"), F.col("a.at") - F.col("at")
    least, limit = F.least(before, after), int(tolerance * 1_000_000)
    best = F.when(F.coalesce(before, after + 1) <= F.coalesce(after, before), F.col("b")).otherwise(F.col("a"))
    tie = (before == after) & (before > 0) | (best["n"] > 1)
    found = sides.filter(least <= limit).select(F.col("id").alias("_id"), best["event_id"].alias("_e"), F.coalesce(tie, F.lit(False)).alias("_tie"))
    out = records.join(found, F.col("id").eqNullSafe(F.col("_id")), "left")
    result = F.when(F.col("_tie"), "ambiguous-event").when(F.col("_e").isNotNull(), "matched").otherwise("no-event-match")
    return out.withColumn("event_id", F.when(~F.col("_tie"), F.col("_e"))).withColumn("result", result).drop("_id", "_e", "_tie")


def normalize_names(
    names: DataFrame, pool: DataFrame, aliases: DataFrame, threshold: float = 80.0, margin: float = 5.0, tokens: dict[str, str] | None = None
) -> DataFrame:
    """``names`` (scope, name) against ``pool`` (scope, canonical_name): adds canonical_name,
    confidence and method (alias, exact, fuzzy, ambiguous or unknown).

    ``tokens`` replaces single words first; then ``aliases`` (alias, target) outrank exact
    names. Only names of equal marks are alike, and only the distinct names that joins left over are compared, by an exact
    similarity join; the confidence of an unknown name is 0 unless its best is within ``margin`` of the threshold.
    """
    key, block = T.comparison_key_udf(), T.marks
    asked = names.select("scope", "name").distinct().withColumn("key", T.expand_tokens(key("name"), tokens or {}))
    known = pool.withColumn("key", key("canonical_name")).groupBy("scope", "key").agg(F.min("canonical_name").alias("canonical"))
    given = aliases.select(key("alias").alias("key"), F.col("target").alias("target")).withColumn("tkey", key("target"))
    target = F.col("k.canonical")
    step = (
        asked.join(given, "key", "left").alias("a")
        .join(known.alias("k"), (F.col("a.scope") == F.col("k.scope")) & (F.coalesce("a.tkey", "a.key") == F.col("k.key")), "left")
        .select(
            F.col("a.scope").alias("scope"), "a.name", F.col("a.key").alias("key"),
            F.coalesce(target, F.col("a.target")).alias("canonical_name"),
            F.when(F.col("a.target").isNotNull(), "alias").when(target.isNotNull(), "exact").alias("method"),
        )
    )
    left = step.filter("method is null").select("scope", "name", "key").withColumn("block", block(F.col("key")))
    against = known.withColumn("block", block(F.col("key")))
    # a second best counts if it is within the margin of a best that reaches the threshold
    scored = similar(left, against, threshold - margin).join(known.select("scope", F.col("key").alias("other"), "canonical"), ["scope", "other"])
    best = scored.groupBy("scope", "key").agg(F.max(F.struct("score", "canonical")).alias("b"), F.sort_array(F.collect_list("score"), False).alias("s"))
    best = best.select("scope", "key", "b", F.try_element_at("s", F.lit(2)).alias("second"))
    fuzzy = left.join(best, ["scope", "key"], "left").select(
        "scope", "name", F.coalesce("b.score", F.lit(0.0)).alias("score"), F.col("b.canonical").alias("found"),
        F.when(F.coalesce("b.score", F.lit(0.0)) < threshold, "unknown")
        .when(F.col("b.score") - F.col("second") < margin, "ambiguous").otherwise("fuzzy").alias("method"),
    )
    settled = step.filter("method is not null").select("scope", "name", "canonical_name", F.lit(100.0).alias("confidence"), "method")
    rest = fuzzy.select("scope", "name", F.when(F.col("method") == "fuzzy", F.col("found")).alias("canonical_name"), F.col("score").alias("confidence"), "method")
    return names.join(settled.unionByName(rest), ["scope", "name"], "left")


def owned_by_one(pool: DataFrame, scope: list[str]) -> DataFrame:
    """Names that exactly one entity of the scope carries."""
    return pool.groupBy(*scope, "canonical_name").agg(F.min("id").alias("id"), F.count_distinct("id").alias("_n")).filter("_n = 1").drop("_n")


def context_score(home: Column, away: Column, home_trusted: Column, away_trusted: Column) -> Column:
    """Confidence that a record is the event it would be at this time: with one side certain,
    90 is enough of the other; two names of 85 each need a certain side or a mean of 90."""
    certain = (home_trusted & (home == 100)) | (away_trusted & (away == 100))
    mean = (home + away) / 2
    return F.when((home < 0) | (away < 0), None).when(
        (home >= 85) & (away >= 85) & (certain | (mean >= 90)), mean
    ).when(((home == 100) & (away == 0)) | ((home == 0) & (away == 100)), F.lit(90.0))


# ------------------------------------------------------------- in order

VERIFIED, UNVERIFIED, SUSPECT, REJECTED = "VERIFIED", "UNVERIFIED", "SUSPECT", "REJECTED"
#: An entry of the catalogue. ``kind``: competition, team (once a competition it plays in), event, kickoff,
#: reference, or what a mapping maps: <competition|team>-name, <competition|team>-id, event-id.
ENTRY = "kind string, source string, name string, marks string, context string, target string, state string, method string, at double"
_FIELDS = [x.split()[0] for x in ENTRY.split(", ")]


def _new_id(kind: str, *parts: object) -> str:
    return f"{kind}-" + hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:32]


@dataclass(frozen=True)
class Name:
    key: str
    marks: str


@dataclass
class Resolver:
    """One sport's identities (or one country's of it) as a fold over the catalogue's entries.

    Competitions and teams are found by a verified source id, if the name is still like the
    verified one (else the mapping turns suspect and is frozen); by a verified name of their
    context, or of none; by the exact name, if one entity of the scope has it; for teams also by
    an exact name that one team of the sport has, in a compatible country and without another
    reference id. A name that is merely similar, or ambiguous, makes a new unverified identity; an
    unknown one a new verified one.
    """

    sport: str = ""
    threshold: float = 85.0
    margin: float = 5.0
    tolerance: int = 1800
    reference: str | None = None  # the provider whose ids and kickoffs have authority
    competitions: dict[str, tuple[Name, str]] = field(default_factory=dict)  # id -> name, country
    teams: dict[str, Name] = field(default_factory=dict)
    plays: dict[str, set[str]] = field(default_factory=dict)  # competition -> teams
    lands: dict[str, set[str]] = field(default_factory=dict)  # team -> known countries
    by_key: dict[tuple[str, str], set[str]] = field(default_factory=dict)  # (kind, key) -> ids
    names: dict[tuple, list] = field(default_factory=dict)  # (kind, source, key, context) -> [target, state, method]
    ids: dict[tuple, list] = field(default_factory=dict)  # (kind, source, id) -> [target, state, name]
    events: dict[str, list] = field(default_factory=dict)  # id -> [competition, home, away, start, provider]
    of_pair: dict[tuple, list[str]] = field(default_factory=dict)  # (competition, home, away) -> events
    of_competition: dict[str, list[str]] = field(default_factory=dict)
    references: dict[tuple, str] = field(default_factory=dict)  # (kind, id of the reference provider) -> target
    referenced: dict[str, str] = field(default_factory=dict)  # target -> id of the reference provider
    log: list[dict] = field(default_factory=list)

    # -- the log

    def apply(self, e: dict) -> None:
        """One entry. Frozen mappings change by hand only."""
        kind, target, state = e["kind"], e["target"], e["state"]
        by_hand = e["method"] == "manual"
        if kind == "competition":
            self.competitions[target] = (Name(e["name"], e["marks"]), e["context"])
            self.by_key.setdefault((kind, e["name"]), set()).add(target)
        elif kind == "team":
            self.teams.setdefault(target, Name(e["name"], e["marks"]))
            self.by_key.setdefault((kind, self.teams[target].key), set()).add(target)
            self.plays.setdefault(e["context"], set()).add(target)
            land = self.competitions[e["context"]][1] if e["context"] in self.competitions else ""
            if land:
                self.lands.setdefault(target, set()).add(land)
        elif kind == "event":
            home, away = e["name"].split(" ", 1)
            self.events[target] = [e["context"], home, away, e["at"], e["source"]]
            self.of_pair.setdefault((e["context"], home, away), []).append(target)
            self.of_competition.setdefault(e["context"], []).append(target)
        elif kind == "kickoff":
            self.events[target][3:] = [e["at"], e["source"]]
        elif kind == "reference":
            self.references[(e["context"], e["name"])], self.referenced[target] = target, e["name"]
        elif kind.endswith("-name"):
            known = self.names.get((kind, e["source"], e["name"], e["context"]))
            if known is None or known[1] == UNVERIFIED or by_hand:
                self.names[(kind, e["source"], e["name"], e["context"])] = [target, state, e["method"]]
        else:
            known = self.ids.get((kind, e["source"], e["name"]))
            if known is None or known[1] not in (SUSPECT, REJECTED) or by_hand:
                self.ids[(kind, e["source"], e["name"])] = [target, state, Name(e["context"], e["marks"])]

    def write(self, kind: str, source: str, name: str, target: str, state: str, method: str, marks: str = "", context: str = "", at: float | None = None) -> None:
        e = dict(zip(_FIELDS, (kind, source, name, marks, context, target, state, method, at), strict=True))
        self.apply(e)
        self.log.append(e)

    # -- names

    def alike(self, a: Name, b: Name) -> bool:
        return a.key == b.key or (a.marks == b.marks and T.token_sort_ratio(a.key, b.key) >= self.threshold)

    def similarity(self, a: Name, b: Name) -> float:
        return 100.0 if a.key == b.key else T.token_sort_ratio(a.key, b.key) if a.marks == b.marks else 0.0

    def mapped(self, kind: str, source: str, source_id, name: Name, context: str) -> tuple[str | None, bool]:
        """The target of a verified mapping, and whether the source's id is suspect. An id that now has another
        name turns suspect, and what is written of the record is then unverified. Outside its context
        a name counts only as mapped by hand."""
        m = self.ids.get((f"{kind}-id", source, source_id)) if source_id is not None else None
        if m and m[1] == VERIFIED:
            if self.alike(name, m[2]):
                return m[0], False
            self.write(f"{kind}-id", source, source_id, m[0], SUSPECT, "id-drift", m[2].marks, m[2].key)
        suspect = bool(m) and m[1] != UNVERIFIED
        for where in dict.fromkeys((context, "")):
            m = self.names.get((f"{kind}-name", source, name.key, where))
            if m and m[1] == VERIFIED and (where == context or m[2] == "manual"):
                return m[0], suspect
        return None, suspect

    def settle(self, name: Name, pool: dict[str, Name]) -> tuple[str | None, float, str]:
        """(target, confidence, method) of a name among a scope's entities."""
        same = [i for i, n in pool.items() if n.key == name.key]
        if len(same) == 1:
            return same[0], 100.0, "exact"
        if same:
            return None, 100.0, "ambiguous"
        scores = sorted((self.similarity(name, n) for n in pool.values()), reverse=True)
        if not scores or scores[0] < self.threshold:
            return None, scores[0] if scores else 0.0, "unknown"
        return None, scores[0], "ambiguous" if len(scores) > 1 and scores[0] - scores[1] < self.margin else "fuzzy"

    def learn(self, kind: str, source: str, source_id, name: Name, context: str, target: str, state: str, method: str) -> None:
        self.write(f"{kind}-name", source, name.key, target, state, method, name.marks, context)
        if source_id is not None:
            self.write(f"{kind}-id", source, source_id, target, state, method, name.marks, name.key)
            if source == self.reference and state == VERIFIED and (kind, source_id) not in self.references and target not in self.referenced:
                self.write("reference", source, source_id, target, state, method, context=kind)

    def contradicted(self, target: str, source: str, source_id) -> bool:
        """Whether the reference provider knows the target by another id."""
        return source == self.reference and source_id is not None and self.referenced.get(target, source_id) != source_id

    def elsewhere(self, name: Name, source: str, source_id, country: str) -> str | None:
        """The one team of the sport with this name, if its countries and reference id allow it."""
        found = []
        for t in self.by_key.get(("team", name.key), ()):
            lands = self.lands.get(t, set())
            if (not country or not lands or country in lands) and not self.contradicted(t, source, source_id):
                found.append(t)
        return found[0] if len(found) == 1 else None

    # -- records

    def competition(self, r: dict, country: str) -> tuple[str, float, str]:
        name, source, source_id = Name(r["league_key"], r["league_marks"]), r["source"], r.get("competition_source_id")
        target, suspect = self.mapped("competition", source, source_id, name, country)
        lands = {i: n for i, (n, land) in self.competitions.items() if not country or not land or country == land}
        if target is not None and not self.contradicted(target, source, source_id):
            score, method = 100.0, "mapping"
        else:
            target, score, method = self.settle(name, {i: n for i, n in lands.items() if not self.contradicted(i, source, source_id)})
        state = UNVERIFIED if suspect or method in ("fuzzy", "ambiguous") else VERIFIED
        if target is None:
            apart = () if method == "unknown" and name.key not in {n.key for n in lands.values()} else (source, source_id, len(self.log))
            target = _new_id("competition", self.sport, name.key, country, *apart)
            self.write("competition", source, name.key, target, state, method, name.marks, country)
        self.learn("competition", source, source_id, name, country, target, state, method)
        return target, score if method != "unknown" else 100.0, state

    def team(self, r: dict, side: str, comp: str, country: str) -> tuple[str, float, str]:
        name, source, source_id = Name(r[f"{side}_key"], r[f"{side}_marks"]), r["source"], r.get(f"{side}_source_id")
        target, suspect = self.mapped("team", source, source_id, name, comp)
        scope = {t: self.teams[t] for t in self.plays.get(comp, ())}
        if target is not None and not self.contradicted(target, source, source_id):
            score, method = 100.0, "mapping"
        else:
            target, score, method = self.settle(name, {t: n for t, n in scope.items() if not self.contradicted(t, source, source_id)})
            if target is None and method != "ambiguous" and (known := self.elsewhere(name, source, source_id, country)):
                target, score, method = known, 100.0, "exact"
        if target is None:
            apart = () if method == "unknown" and name.key not in {n.key for n in scope.values()} else (source, source_id, len(self.log))
            target = _new_id("team", self.sport, comp, name.key, *apart)
        state = UNVERIFIED if suspect or method in ("fuzzy", "ambiguous") else VERIFIED
        if target not in self.plays.get(comp, ()):
            self.write("team", source, self.teams.get(target, name).key, target, state, method, self.teams.get(target, name).marks, comp)
        self.learn("team", source, source_id, name, comp, target, state, method)
        return target, score if method != "unknown" else 100.0, state

    def sides(self, r: dict, event: str) -> list[float]:
        """How well a record's teams fit those of an event: 100 by id, -1 if the id says otherwise."""
        comp, *teams = self.events[event][:3]
        out = []
        for side, team in zip(("home", "away"), teams, strict=True):
            source_id, name = r.get(f"{side}_source_id"), Name(r[f"{side}_key"], r[f"{side}_marks"])
            m = self.ids.get(("team-id", r["source"], source_id)) if source_id is not None else None
            n = self.names.get(("team-name", r["source"], name.key, comp))
            if m and m[1] == VERIFIED and self.alike(name, m[2]):
                out.append(100.0 if m[0] == team else -1.0)
            elif n and n[1] == VERIFIED:
                out.append(100.0 if n[0] == team else -1.0)
            else:
                out.append(self.similarity(name, self.teams[team]))
        return out

    def by_context(self, r: dict, comp: str, at: float) -> tuple[str, float] | None:
        """The one event of a competition at this time whose teams both fit."""
        found = []
        for event in self.of_competition.get(comp, ()):
            if abs(self.events[event][3] - at) > self.tolerance:
                continue
            low, high = sorted(self.sides(r, event))
            if low == 100:
                return None  # the plain way finds it
            if low >= self.threshold and (high == 100 or (low + high) / 2 >= 90):
                found.append(((low + high) / 2, event))
            elif low >= 0 and high == 100:
                found.append((90.0, event))
        found.sort(key=lambda x: (-x[0], x[1]))
        clear = found and (len(found) == 1 or found[0][0] - found[1][0] >= self.margin)
        return (found[0][1], found[0][0]) if clear else None

    def fits(self, r: dict, event: str, country: str) -> bool:
        """Whether an event that an id names can still be the one of the record."""
        land = self.competitions[self.events[event][0]][1] if self.events[event][0] in self.competitions else ""
        return (not country or not land or country == land) and min(self.sides(r, event)) >= self.threshold

    def sync(self, r: dict, event: str, at: float) -> None:
        """The kickoff moves with the reference provider, or, without one, with who set it."""
        start, provider = self.events[event][3:]
        if at != start and (r["source"] == self.reference or (provider == r["source"] and provider != self.reference)):
            self.write("kickoff", r["source"], "", event, VERIFIED, "kickoff", at=at)

    def resolve(self, r: dict) -> tuple[str | None, float, str]:
        """(event id, confidence, how) of one record."""
        if not r["home_key"] or not r["away_key"]:
            return None, 0.0, "missing-team-name"
        if r["same"]:
            return None, 0.0, "home-equals-away"
        source, at, country, event_id = r["source"], float(r["start"]), r["land"], r.get("source_event_id")
        m = self.ids.get(("event-id", source, event_id)) if event_id is not None else None
        if m and m[1] == VERIFIED and m[0] in self.events:
            if self.fits(r, m[0], country):
                self.sync(r, m[0], at)
                return m[0], 100.0, "resolved"
            self.write("event-id", source, event_id, m[0], SUSPECT, "recycled-id")
        comp, c_score, c_state = self.competition(r, country)
        if c_state == VERIFIED and (hit := self.by_context(r, comp, at)):
            event, score = hit
            for side, team in zip(("home", "away"), self.events[event][1:3], strict=True):
                self.learn("team", source, r.get(f"{side}_source_id"), Name(r[f"{side}_key"], r[f"{side}_marks"]), comp, team, VERIFIED, "fixture-context")
            if event_id is not None:
                self.write("event-id", source, event_id, event, VERIFIED, "fixture-context")
            self.sync(r, event, at)
            return event, score, "resolved-by-fixture-context"
        home, h_score, h_state = self.team(r, "home", comp, country)
        away, a_score, a_state = self.team(r, "away", comp, country)
        near = [e for e in self.of_pair.get((comp, home, away), ()) if abs(self.events[e][3] - at) <= self.tolerance]
        if len(near) == 1:
            event = near[0]
            self.sync(r, event, at)
        else:  # none, or two that can't be told apart
            event = _new_id("event", comp, home, away, int(at), len(near))
            if event not in self.events:
                self.write("event", source, f"{home} {away}", event, VERIFIED, "new", context=comp, at=at)
        trusted = h_state == a_state == c_state == VERIFIED
        if event_id is not None:
            self.write("event-id", source, event_id, event, VERIFIED if trusted else UNVERIFIED, "resolved")
        return event, min(h_score, a_score, c_score), "resolved"


KEY = ["sport", "source", "league", "country", "home_team", "away_team", "start_time", "source_event_id", "competition_source_id", "home_source_id", "away_source_id"]
_OUT = f"_k string, sport string, lot string, no long, event_id string, confidence double, resolution string, {ENTRY}"


def distinct_fixtures(records: DataFrame, aliases: dict[str, str] | None, tokens: dict[str, str] | None) -> tuple[DataFrame, DataFrame]:
    """``records`` with a hash of their ``KEY`` as _k, and the distinct keys with their first seq, start (seconds), land and,
    for league, home and away, the comparison key and marks."""
    importable()
    for c in KEY:
        if c not in records.columns:
            records = records.withColumn(c, F.lit(None).cast("string"))
    key = T.comparison_key_udf()
    whole = {key_text: target for key_text, target in (aliases or {}).items()}
    folded = {T.comparison_key(k): T.comparison_key(v) for k, v in whole.items()}
    hashed = records.withColumn("_k", F.sha2(F.to_json(F.struct(*KEY), {"ignoreNullFields": "false"}), 256))
    firsts = hashed.groupBy("_k", *KEY).agg(F.min("seq").alias("seq"))
    firsts = firsts.withColumns(
        {
            "start": F.unix_micros(F.col("start_time").cast("timestamp")) / 1e6, "land": T.country_key(F.col("country")),
            "same": F.coalesce(F.trim("home_team") == F.trim("away_team"), F.lit(False)),
        }
    )
    for c in ("league", "home", "away"):
        plain = T.expand_tokens(key(c if c == "league" else f"{c}_team"), {T.comparison_key(k): T.comparison_key(v) for k, v in (tokens or {}).items()})
        firsts = firsts.withColumn(f"{c}_key", plain).withColumn(f"{c}_key", F.coalesce(T.lookup(folded, F.col(f"{c}_key")), F.col(f"{c}_key")))
        firsts = firsts.withColumn(f"{c}_marks", T.marks(F.col(f"{c}_key")))
    return hashed, firsts


def resolve(
    records: DataFrame, catalogue: DataFrame | None = None, aliases: dict[str, str] | None = None, tokens: dict[str, str] | None = None,
    reference: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``records`` (id, seq and the columns of ``KEY``, of which ids may be missing) ->
    (id, event_id, confidence, resolution) and the entries to append to the ``catalogue`` (sport, lot, no, ``ENTRY``).

    Distinct keys run in the order of ``seq``: what a record finds depends on those before it.
    A lot is a sport, or a country of a sport all of whose competitions, old and new, name their
    country and none of whose source ids occurs in two; so one task holds the distinct fixtures and
    the catalogue of a lot, not its quotes. Both results come from one run: persist or write the first use.
    """
    spark = records.sparkSession
    hashed, firsts = distinct_fixtures(records, aliases, tokens)
    if catalogue is None:
        catalogue = spark.createDataFrame([], f"sport string, lot string, no long, {ENTRY}")
    ids = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), "source", F.col(c).alias("name")) for c in KEY[-4:]]))
    crossing = firsts.select("sport", "land", ids.alias("i")).filter("i.name is not null").groupBy("sport", "i").agg(F.count_distinct("land").alias("n"))
    mixed = (
        firsts.groupBy("sport").agg(F.max(F.col("land") == "").alias("m"))
        .union(catalogue.groupBy("sport").agg(F.max((F.col("lot") == "") | ((F.col("kind") == "competition") & (F.col("context") == "")))))
        .union(crossing.groupBy("sport").agg(F.max(F.col("n") > 1))).groupBy("sport").agg(F.max("m").alias("mixed"))
    )
    lot = F.when(F.col("mixed"), "").otherwise(F.col("land"))
    dealt = firsts.join(mixed, "sport").withColumn("lot", lot)
    known = catalogue.withColumnRenamed("lot", "land").join(mixed, "sport").withColumn("lot", lot).drop("mixed")
    dealt, known = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (dealt.drop("mixed"), known))  # attributes of their own

    def run(pdf: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        sport, place = (pdf if len(pdf) else old).iloc[0][["sport", "lot"]]
        resolver, out = Resolver(sport or "", reference=reference), []
        plain = lambda x: x.astype(object).where(x.notna(), None).to_dict("records")
        for e in plain(old.sort_values(["no", "land"])):
            resolver.apply(e)
        for r in plain(pdf.sort_values(["seq", "_k"])):
            out.append({"_k": r["_k"], **dict(zip(("event_id", "confidence", "resolution"), resolver.resolve(r), strict=True))})
        last = int(old["no"].max()) + 1 if len(old) else 0
        entries = [{"sport": sport, "lot": place, "no": last + i, **e} for i, e in enumerate(resolver.log)]
        return pd.DataFrame(out + entries, columns=[x.split()[0] for x in _OUT.split(", ")])

    done = dealt.groupBy("sport", "lot").cogroup(known.groupBy("sport", "lot")).applyInPandas(run, _OUT)
    found = done.filter("_k is not null").select("_k", "event_id", "confidence", "resolution")
    entries = done.filter("_k is null").select("sport", "lot", "no", *_FIELDS)
    return hashed.select("id", "_k").join(found, "_k", "left").select("id", "event_id", "confidence", "resolution"), entries


def resolve_records(records: DataFrame, aliases: dict[str, str] | None = None, **options) -> DataFrame:
    """The first result of ``resolve``: id, event_id, confidence, resolution."""
    return resolve(records, aliases=aliases, **options)[0]
