"""Identity of a whole batch by joins over the catalogue: no group holds a sport, and nothing runs in order.

``identity.resolve`` lets every record see what those before it created, so a lot is one task. Here a batch is one
moment: each record is judged by the catalogue as it was before, in stages that are equi joins: source event ids,
competitions, the fixture as context, teams, events. What the batch itself creates meets on natural keys:

* equal new names of a scope are one entity, so are equal new fixtures whose starts all lie within the tolerance;
* a new name that is similar to an earlier new one (by ``seq``) is another, unverified entity;
* names that come with one new source id are one entity if alike; the later ones are suspect if not.

So the result doesn't depend on partitions or their order, and batches may have any size. For a single record it is
what ``identity.Resolver`` says. Entries have the catalogue's form and either way may go on from the other's.

Nulls: a null sport, source or country is the empty one; a null source id is none; a null start makes no event
("missing-start"). Repeated rows are one key. An empty batch gives no entries. Columns beyond ``KEY`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import scratch
from .fuzzy import similar
from .identity import _FIELDS, ENTRY, REJECTED, SUSPECT, UNVERIFIED, VERIFIED, distinct_fixtures, stable_id

THRESHOLD, MARGIN, TOLERANCE = 85.0, 5.0, 1800
#: Entries of a record are numbered in this order.
_KINDS = ("competition", "competition-name", "competition-id", "team", "team-name", "team-id", "reference", "event", "event-id", "kickoff")


def _cut(df: DataFrame) -> DataFrame:
    """A stage's result as a table in the shared folder: later stages read it several times, and its size is known."""
    path = scratch(df.sparkSession, "staged") + "/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ------------------------------------------------------------- what the catalogue says


def _holding(entries: DataFrame, key: list[str], ends: Column) -> DataFrame:
    """The entry that holds of each key: from the last one by hand on, the first for which ``ends`` is true, else the last."""
    hand = F.max(F.when(F.col("method") == "manual", F.col("at_no"))).over(Window.partitionBy(*key))
    row = F.struct("target", "state", "method", "marks", "context")
    since = entries.withColumn("_hand", hand).filter(F.col("_hand").isNull() | (F.col("at_no") >= F.col("_hand"))).withColumn("_ends", ends)
    held = F.coalesce(F.min_by(F.when(F.col("_ends"), row), F.when(F.col("_ends"), F.col("at_no"))), F.max_by(row, "at_no"))
    return since.groupBy(*key).agg(held.alias("m")).select(*key, *[F.col(f"m.{c}").alias(f"m_{c}") for c in ("target", "state", "method", "marks", "context")])


@dataclass
class Known:
    """The catalogue as tables; ``names`` and ``ids`` hold the entry of each key that counts."""

    competitions: DataFrame  # sport, id, key, marks, land, ref
    teams: DataFrame  # sport, id, key, marks, lands, ref
    plays: DataFrame  # sport, scope (competition), id
    names: DataFrame  # sport, kind, source, key, place, m_*
    ids: DataFrame  # sport, kind, source, sid, m_* (m_context is the name's key)
    events: DataFrame  # sport, event, comp, home, away, e_start, e_provider
    references: DataFrame  # sport, kind, sid, target


def known(catalogue: DataFrame) -> Known:
    base = catalogue.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("sport", "source", "marks", "context")}).withColumn("at_no", F.struct("no", F.coalesce("lot", F.lit(""))))
    of = lambda k: base.filter(F.col("kind") == k)
    name = F.struct("name", "marks", "context")
    refs = of("reference").groupBy("sport", F.col("context").alias("kind"), F.col("name").alias("sid")).agg(F.max_by("target", "at_no").alias("target"))
    held = of("reference").groupBy("sport", F.col("context").alias("kind"), F.col("target").alias("id")).agg(F.max_by("name", "at_no").alias("ref"))
    comps = of("competition").groupBy("sport", F.col("target").alias("id")).agg(F.max_by(name, "at_no").alias("n"))
    comps = comps.select("sport", "id", F.col("n.name").alias("key"), F.col("n.marks").alias("marks"), F.col("n.context").alias("land"))
    plays = of("team").select("sport", F.col("context").alias("scope"), F.col("target").alias("id")).distinct()
    lands = plays.join(comps.filter("land <> ''").select("sport", F.col("id").alias("scope"), "land"), ["sport", "scope"]).groupBy("sport", "id").agg(F.collect_set("land").alias("lands"))
    teams = of("team").groupBy("sport", F.col("target").alias("id")).agg(F.min_by(name, "at_no").alias("n"))
    teams = teams.select("sport", "id", F.col("n.name").alias("key"), F.col("n.marks").alias("marks")).join(lands, ["sport", "id"], "left")
    with_ref = lambda df, k: df.join(held.filter(F.col("kind") == k).drop("kind"), ["sport", "id"], "left")
    mapped = base.withColumnsRenamed({"name": "key"})
    names = _holding(mapped.filter(F.col("kind").endswith("-name")).withColumn("place", F.col("context")), ["sport", "kind", "source", "key", "place"], F.col("state") != UNVERIFIED)
    ids = _holding(mapped.filter(F.col("kind").endswith("-id")), ["sport", "kind", "source", "key"], F.col("state").isin(SUSPECT, REJECTED)).withColumnRenamed("key", "sid")
    made = F.when(F.col("kind") == "event", F.struct("name", "context"))
    events = base.filter(F.col("kind").isin("event", "kickoff")).groupBy("sport", F.col("target").alias("event")).agg(
        F.max_by(made, F.when(F.col("kind") == "event", F.col("at_no"))).alias("e"), F.max_by(F.struct("at", "source"), "at_no").alias("k")
    ).filter("e is not null")
    pair = F.split("e.name", " ", 2)
    events = events.select(
        "sport", "event", F.col("e.context").alias("comp"), pair[0].alias("home"), pair[1].alias("away"), F.col("k.at").alias("e_start"), F.col("k.source").alias("e_provider"),
    )
    return Known(*map(_cut, (with_ref(comps, "competition"), with_ref(teams, "team"), plays, names, ids, events, refs)))


# ------------------------------------------------------------- names


def _ratio(where: Column, a: str, b: str) -> Column:
    """The similarity of two keys where it is asked for, else 100."""
    return T.ratio_udf()(F.when(where, F.col(a)).otherwise(""), F.when(where, F.coalesce(F.col(b), F.lit(""))).otherwise(""))


def _like(df: DataFrame, out: str, key: str, marks: str, other: str, other_marks: str) -> DataFrame:
    """Whether two names are the same or alike; null if there is no other."""
    near = F.coalesce((F.col(key) != F.col(other)) & (F.col(marks) == F.col(other_marks)), F.lit(False))
    score = df.withColumn("_score", _ratio(near, key, other))
    return score.withColumn(out, F.when(F.col(other).isNotNull(), (F.col(key) == F.col(other)) | (near & (F.col("_score") >= THRESHOLD)))).drop("_score")


def _contradicted(reference: str | None, ref: str) -> Column:
    """Whether the reference provider knows an entity by another id than the record's."""
    if reference is None:
        return F.lit(False)
    return (F.col("source") == reference) & F.col("sid").isNotNull() & F.coalesce(F.col(ref) != F.col("sid"), F.lit(False))


def _mapped(asked: DataFrame, kind: str, k: Known, entities: DataFrame, reference: str | None) -> DataFrame:
    """asked (aid, sport, source, sid, key, marks, place, ...) with target (of a mapping that counts), suspect, drifted
    (the target that the id had), and m_state, the state of the id's mapping."""
    ids = k.ids.filter(F.col("kind") == f"{kind}-id").select("sport", "source", "sid", F.col("m_target").alias("_it"), "m_state", F.col("m_context").alias("_ik"), F.col("m_marks").alias("_im"))
    names = k.names.filter((F.col("kind") == f"{kind}-name") & (F.col("m_state") == VERIFIED))
    own = names.select("sport", "source", "key", "place", F.col("m_target").alias("_own"))
    hand = names.filter((F.col("place") == "") & (F.col("m_method") == "manual")).select("sport", "source", "key", F.col("m_target").alias("_hand"))
    out = asked.join(ids, ["sport", "source", "sid"], "left").join(own, ["sport", "source", "key", "place"], "left").join(hand, ["sport", "source", "key"], "left")
    out = _like(out, "_same", "key", "marks", "_ik", "_im")
    by_id = (F.col("m_state") == VERIFIED) & F.col("_same")
    drifted = (F.col("m_state") == VERIFIED) & ~F.col("_same")
    target = F.when(by_id, F.col("_it")).otherwise(F.coalesce("_own", "_hand"))
    out = out.withColumns(
        {
            "target": target, "drifted": F.when(drifted, F.col("_it")), "was": F.when(drifted, F.col("_ik")), "was_marks": F.when(drifted, F.col("_im")),
            "suspect": F.coalesce(drifted | (~by_id & (F.col("m_state") != UNVERIFIED)), F.lit(False)),
        }
    ).drop("_it", "_ik", "_im", "_own", "_hand", "_same")
    held = entities.select("sport", F.col("id").alias("target"), F.col("ref").alias("_ref"))
    out = out.join(held, ["sport", "target"], "left")
    return out.withColumn("target", F.when(~_contradicted(reference, "_ref"), F.col("target"))).drop("_ref")


def _similar(asked: DataFrame, pool: DataFrame, threshold: float) -> DataFrame:
    """``similar`` on names that are made once; none of it where nothing is asked."""
    asked = _cut(asked)
    if asked.isEmpty():
        return asked.select("scope", "key", F.col("key").alias("other"), F.lit(0.0).alias("score"))
    return _cut(similar(asked, _cut(pool), threshold))


def _settled(asked: DataFrame, pool: DataFrame, scope: list[str], fits: Column, reference: str | None) -> DataFrame:
    """asked without a target against the entities of its scope that fit (``pool``: *scope, id, key, marks, ref, p_land):
    aid, target, score, method, and taken: whether an entity of the scope has the name, be it contradicted or not."""
    place = lambda df: df.withColumn("_scope", F.to_json(F.struct(*scope)))
    asked, pool = place(asked), place(pool)
    p = pool.select(F.col("_scope").alias("p_scope"), F.col("key").alias("p_key"), F.col("id").alias("p_id"), F.col("ref").alias("p_ref"), "p_land")
    may = ~_contradicted(reference, "p_ref")
    same = asked.join(p, (F.col("_scope") == F.col("p_scope")) & (F.col("key") == F.col("p_key"))).filter(fits)
    same = same.groupBy("aid").agg(F.count_distinct(F.when(may, F.col("p_id"))).alias("n"), F.min(F.when(may, F.col("p_id"))).alias("one"))
    names = lambda df: df.select(F.col("_scope").alias("scope"), F.col("marks").alias("block"), "key").distinct()
    near = _similar(names(asked), names(pool), THRESHOLD - MARGIN).withColumnsRenamed({"scope": "_scope"})
    scored = asked.join(near, ["_scope", "key"]).join(p, (F.col("_scope") == F.col("p_scope")) & (F.col("other") == F.col("p_key"))).filter(fits & may)
    top = scored.select("aid", "p_id", "score").distinct().withColumn("_rn", F.row_number().over(Window.partitionBy("aid").orderBy(F.desc("score"), "p_id"))).filter("_rn <= 2")
    top = top.groupBy("aid").agg(F.max("score").alias("best"), F.max(F.when(F.col("_rn") == 2, F.col("score"))).alias("second"))
    out = asked.select("aid").join(same, "aid", "left").join(top, "aid", "left")
    n, best = F.coalesce("n", F.lit(0)), F.coalesce("best", F.lit(0.0))
    method = F.when(n == 1, "exact").when(n > 1, "ambiguous").when(best < THRESHOLD, "unknown").when(F.col("best") - F.col("second") < MARGIN, "ambiguous").otherwise("fuzzy")
    return out.select(
        "aid", F.when(n == 1, F.col("one")).alias("target"), F.when((n > 0) | (best < THRESHOLD), 100.0).otherwise(best).alias("score"), method.alias("method"), F.col("n").isNotNull().alias("taken"),
    )


def _rivals(fresh: DataFrame, scope: list[str], fits: Column) -> DataFrame:
    """New names that are similar to an earlier new one of their scope: aid, rival (the score). ``fits`` compares land and o_land."""
    named = fresh.withColumn("_scope", F.to_json(F.struct(*scope)))
    one = named.select(F.col("_scope").alias("scope"), F.col("marks").alias("block"), "key").distinct()
    pairs = _similar(one, one, THRESHOLD).withColumnsRenamed({"scope": "_scope", "score": "o_score"})
    firsts = named.groupBy("_scope", F.col("key").alias("other"), F.col("land").alias("o_land")).agg(F.min("seq").alias("o_seq"))
    met = named.join(pairs, ["_scope", "key"]).join(firsts, ["_scope", "other"])
    return met.filter(fits & (F.struct("o_seq", "other") < F.struct("seq", "key"))).groupBy("aid").agg(F.max("o_score").alias("rival"))


def _leads(done: DataFrame) -> DataFrame:
    """Names that come with one source id which the catalogue doesn't vouch for: the first one leads. Those alike are the same, others suspect."""
    w = Window.partitionBy("sport", "source", "sid").orderBy("seq", "key", "aid")
    open_ = F.col("sid").isNotNull() & (F.col("m_state").isNull() | (F.col("m_state") == UNVERIFIED))
    lead = F.when(open_, F.first(F.struct("key", "marks", "target", "state")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = done.withColumn("_l", lead).withColumns({"_lk": F.col("_l.key"), "_lm": F.col("_l.marks")})
    out = _like(out, "_same", "key", "marks", "_lk", "_lm")
    follows = F.coalesce((F.col("_l.state") == VERIFIED) & (F.col("_lk") != F.col("key")), F.lit(False))
    joins, apart = follows & F.col("_same"), follows & ~F.col("_same")
    return out.withColumns(
        {
            "target": F.when(joins, F.col("_l.target")).otherwise(F.col("target")), "method": F.when(joins, "mapping").otherwise(F.col("method")),
            "score": F.when(joins, 100.0).otherwise(F.col("score")), "state": F.when(joins, VERIFIED).when(apart, UNVERIFIED).otherwise(F.col("state")),
            "drifted": F.when(apart, F.col("_l.target")).otherwise(F.col("drifted")), "was": F.when(apart, F.col("_lk")).otherwise(F.col("was")),
            "was_marks": F.when(apart, F.col("_lm")).otherwise(F.col("was_marks")),
        }
    ).drop("_l", "_lk", "_lm", "_same")


def _of_one_reference(fresh: DataFrame, natural: list[str], reference: str | None) -> DataFrame:
    """Adds ``apart``: the reference provider has another id for the same new name than the first that claims it."""
    if reference is None:
        return fresh.withColumn("apart", F.lit(False))
    claims = (F.col("source") == reference) & F.col("sid").isNotNull() & (F.col("method") == "unknown") & ~F.col("taken")
    first = F.min_by(F.when(claims, F.col("sid")), F.when(claims, F.struct("seq", "sid"))).over(Window.partitionBy(*natural))
    return fresh.withColumn("_first", first).withColumn("apart", F.coalesce(claims & (F.col("_first") != F.col("sid")), F.lit(False))).drop("_first")


def _numbered(asked: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct askings with their first seq and an id of their own."""
    one = asked.groupBy(*cols).agg(F.min("seq").alias("seq"))
    return one.withColumn("aid", F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256))


def _competitions(asked: DataFrame, k: Known, reference: str | None) -> DataFrame:
    asked = _numbered(asked.withColumn("place", F.col("land")), ["sport", "source", "sid", "key", "marks", "land", "place"])
    found = _cut(_mapped(asked, "competition", k, k.competitions, reference))
    left = found.filter("target is null").drop("target")
    fits = (F.col("land") == "") | (F.col("p_land") == "") | (F.col("land") == F.col("p_land"))
    settled = _cut(left.join(_settled(left, k.competitions.withColumnRenamed("land", "p_land"), ["sport"], fits, reference), "aid"))
    fresh = settled.filter("target is null")
    # a name without a country is that of the only country that it is new in
    w = Window.partitionBy("sport", "key")
    lo, hi = (f(F.when((F.col("land") != "") & (F.col("method") == "unknown"), F.col("land"))).over(w) for f in (F.min, F.max))
    fresh = fresh.withColumn("home", F.when((F.col("land") == "") & (lo == hi), lo).otherwise(F.col("land")))
    unknown = fresh.filter("method = 'unknown'")
    rivals = _rivals(unknown, ["sport"], (F.col("land") == "") | (F.col("o_land") == "") | (F.col("land") == F.col("o_land")))
    fresh = _of_one_reference(fresh, ["sport", "key", "home"], reference).join(rivals, "aid", "left")
    plain = (F.col("method") == "unknown") & ~F.col("taken") & ~F.col("apart")
    new = F.when(plain, stable_id("competition", F.col("sport"), F.col("key"), F.col("home"))).otherwise(
        stable_id("competition", F.col("sport"), F.col("key"), F.col("land"), F.col("source"), F.col("sid"))
    )
    return _answered(found, settled, fresh.withColumns({"target": new, "context": F.col("home")}))


def _teams(asked: DataFrame, k: Known, reference: str | None) -> DataFrame:
    asked = _numbered(asked.withColumn("place", F.col("scope")), ["sport", "source", "sid", "key", "marks", "land", "scope", "place"])
    found = _cut(_mapped(asked, "team", k, k.teams, reference))
    left = found.filter("target is null").drop("target")
    pool = k.plays.join(k.teams, ["sport", "id"]).withColumn("p_land", F.lit(""))
    settled = left.join(_settled(left, pool, ["sport", "scope"], F.lit(True), reference), "aid")
    # the one team of the sport with this name, if its countries and reference id allow it
    t = k.teams.select("sport", "key", F.col("id").alias("p_id"), "lands", F.col("ref").alias("p_ref"))
    open_ = settled.filter("target is null and method <> 'ambiguous'").select("aid", "sport", "key", "land", "source", "sid")
    may = ((F.col("land") == "") | F.col("lands").isNull() | F.array_contains("lands", F.col("land"))) & ~_contradicted(reference, "p_ref")
    where = open_.join(t, ["sport", "key"]).groupBy("aid").agg(F.count_if(may).alias("_n"), F.min(F.when(may, F.col("p_id"))).alias("_one"))
    one = F.coalesce(F.col("_n") == 1, F.lit(False))
    settled = _cut(
        settled.join(where, "aid", "left").withColumns(
            {"target": F.when(one, F.col("_one")).otherwise(F.col("target")), "method": F.when(one, "exact").otherwise(F.col("method")), "score": F.when(one, 100.0).otherwise(F.col("score"))}
        ).withColumn("elsewhere", F.col("_n").isNotNull()).drop("_n", "_one")
    )
    fresh = settled.filter("target is null")
    # a name that is new in several competitions of one country is one team
    w = Window.partitionBy("sport", "key", "_new")
    lo, hi = (f(F.when(F.col("land") != "", F.col("land"))).over(w) for f in (F.min, F.max))
    fresh = fresh.withColumn("_new", (F.col("method") == "unknown") & ~F.col("elsewhere"))
    fresh = fresh.withColumn("_at", F.when((F.col("land") == "") & (lo == hi), lo).otherwise(F.col("land")))
    first = F.min_by("scope", F.struct("seq", "scope")).over(Window.partitionBy("sport", "key", "_at", "_new"))
    fresh = fresh.withColumn("home", F.when(F.col("_new"), first).otherwise(F.col("scope"))).drop("_new", "_at")
    rivals = _rivals(fresh.filter("method = 'unknown'"), ["sport", "scope"], F.lit(True))
    fresh = _of_one_reference(fresh, ["sport", "key", "home"], reference).join(rivals, "aid", "left")
    plain = (F.col("method") == "unknown") & ~F.col("taken") & ~F.col("apart")
    new = F.when(plain, stable_id("team", F.col("sport"), F.col("home"), F.col("key"))).otherwise(
        stable_id("team", F.col("sport"), F.col("scope"), F.col("key"), F.col("source"), F.col("sid"))
    )
    return _answered(found, settled, fresh.withColumns({"target": new, "context": F.col("scope")}))


def _answered(found: DataFrame, settled: DataFrame, fresh: DataFrame) -> DataFrame:
    """All askings with target, score, method, state, context (of a new entity) and made."""
    cols = [*found.columns, "score", "method", "context", "made"]
    none = F.lit(None).cast("string")
    by_map = found.filter("target is not null").withColumns({"score": F.lit(100.0), "method": F.lit("mapping"), "context": none, "made": F.lit(False)})
    by_name = settled.filter("target is not null").withColumns({"context": none, "made": F.lit(False)})
    rival = F.col("rival").isNotNull() & (F.col("method") == "unknown")
    new = fresh.withColumns({"score": F.when(rival, F.col("rival")).otherwise(F.col("score")), "method": F.when(rival, "fuzzy").otherwise(F.col("method")), "made": F.lit(True)})
    out = reduce(DataFrame.unionByName, [d.select(*cols) for d in (by_map, by_name, new)])
    guess = F.col("suspect") | F.col("method").isin("fuzzy", "ambiguous")
    return _cut(_leads(out.withColumn("state", F.when(guess, UNVERIFIED).otherwise(VERIFIED))))


# ------------------------------------------------------------- events


def _sides(pairs: DataFrame, k: Known) -> DataFrame:
    """pairs (_k, event, sport, source, comp, home, away, and the record's names and ids) with low and high: how well
    each of its teams fits the event's. 100 by id or mapping, -1 if those say otherwise, else the names' similarity."""
    each = pairs.select(
        "_k", "event", "sport", "source", F.col("comp").alias("place"),
        F.inline(F.array(*[F.struct(F.col(f"{s}_key").alias("key"), F.col(f"{s}_marks").alias("marks"), F.col(f"{s}_source_id").alias("sid"), F.col(s).alias("team")) for s in ("home", "away")])),
    )
    ids = k.ids.filter("kind = 'team-id'").filter(F.col("m_state") == VERIFIED).select("sport", "source", "sid", F.col("m_target").alias("_it"), F.col("m_context").alias("_ik"), F.col("m_marks").alias("_im"))
    names = k.names.filter("kind = 'team-name'").filter(F.col("m_state") == VERIFIED).select("sport", "source", "key", "place", F.col("m_target").alias("_nt"))
    teams = k.teams.select("sport", F.col("id").alias("team"), F.col("key").alias("_tk"), F.col("marks").alias("_tm"))
    out = each.join(ids, ["sport", "source", "sid"], "left").join(names, ["sport", "source", "key", "place"], "left").join(teams, ["sport", "team"], "left")
    out = _like(out, "_same", "key", "marks", "_ik", "_im")
    said = F.when(F.col("_same"), F.col("_it")).otherwise(F.col("_nt"))
    near = F.coalesce(said.isNull() & (F.col("key") != F.col("_tk")) & (F.col("marks") == F.col("_tm")), F.lit(False))
    score = F.when(said.isNotNull(), F.when(said == F.col("team"), 100.0).otherwise(-1.0)).when(F.col("key") == F.col("_tk"), 100.0).when(near, _ratio(near, "key", "_tk")).otherwise(0.0)
    # both sides of a pair; two equal sides count as well
    return out.withColumn("_s", score).groupBy("_k", "event").agg(F.min("_s").alias("low"), F.max("_s").alias("high"))


def _by_id(firsts: DataFrame, k: Known) -> DataFrame:
    """Records whose source event id is verified: _k, event, fits (whether it can still be the one)."""
    ids = k.ids.filter("kind = 'event-id'").filter(F.col("m_state") == VERIFIED).select("sport", "source", F.col("sid").alias("source_event_id"), F.col("m_target").alias("event"))
    hit = firsts.join(ids, ["sport", "source", "source_event_id"]).join(k.events, ["sport", "event"])
    lands = k.competitions.select("sport", F.col("id").alias("comp"), F.col("land").alias("_land"))
    sides = _sides(hit, k)
    placed = hit.join(lands, ["sport", "comp"], "left").withColumn("_ok", (F.col("land") == "") | (F.coalesce("_land", F.lit("")) == "") | (F.col("land") == F.col("_land")))
    return _cut(placed.join(sides, ["_k", "event"]).select("_k", "event", (F.col("_ok") & (F.col("low") >= THRESHOLD)).alias("fits"), "e_start", "e_provider"))


def _by_context(records: DataFrame, k: Known) -> DataFrame:
    """The one event of a record's competition at its time whose teams both fit: _k, event, score, home, away. Where an
    event is certain by both sides, none: the plain way finds it."""
    slot = lambda c: F.floor(F.col(c) / TOLERANCE)
    events = k.events.withColumn("slot", slot("e_start"))
    probes = records.withColumn("slot", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: slot("start") + d)))
    near = _cut(probes.join(events, ["sport", "comp", "slot"]).filter(F.abs(F.col("start") - F.col("e_start")) <= TOLERANCE))
    mean = (F.col("low") + F.col("high")) / 2
    score = F.when((F.col("low") >= THRESHOLD) & ((F.col("high") == 100) | (mean >= 90)), mean).when((F.col("low") >= 0) & (F.col("high") == 100), 90.0)
    scored = near.join(_sides(near, k), ["_k", "event"]).withColumn("score", score)
    plain = scored.filter("low = 100").select("_k").distinct()
    w = Window.partitionBy("_k").orderBy(F.desc("score"), "event")
    top = scored.filter("score is not null").join(plain, "_k", "left_anti").withColumn("_rn", F.row_number().over(w)).filter("_rn <= 2")
    best = top.groupBy("_k").agg(F.max("score").alias("best"), F.max(F.when(F.col("_rn") == 2, F.col("score"))).alias("second"), F.min_by(F.struct("event", "home", "away", "e_start", "e_provider"), "_rn").alias("b"))
    clear = best.filter(F.col("second").isNull() | (F.col("best") - F.col("second") >= MARGIN))
    return _cut(clear.select("_k", F.col("best").alias("score"), "b.*"))


def _events(records: DataFrame, k: Known) -> DataFrame:
    """records (_k, sport, source, seq, start, comp, home, away) with event, made, e_start and e_provider."""
    at = k.events.select("sport", "comp", "home", "away", "event", "e_start", "e_provider")
    hits = records.select("_k", "sport", "comp", "home", "away", "start").join(at, ["sport", "comp", "home", "away"]).filter(F.abs(F.col("start") - F.col("e_start")) <= TOLERANCE)
    hits = hits.groupBy("_k").agg(F.count("*").alias("near"), F.min(F.struct("event", "e_start", "e_provider")).alias("h"))
    out = records.join(hits, "_k", "left").withColumn("near", F.coalesce("near", F.lit(0)))
    # new fixtures of a pair: starts in a chain of gaps within the tolerance, if the whole chain is
    pair = ["sport", "comp", "home", "away", "near"]
    after = F.lag("start").over(Window.partitionBy(*pair).orderBy("start", "_k"))
    out = out.withColumn("_gap", F.coalesce(F.col("start") - after > TOLERANCE, F.lit(True)).cast("int"))
    out = out.withColumn("_chain", F.sum("_gap").over(Window.partitionBy(*pair).orderBy("start", "_k").rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy(*pair, "_chain")
    whole = (F.max("start").over(w) - F.min("start").over(w) <= TOLERANCE) & (F.col("near") == 0)
    own = F.struct("start", "source")
    first = F.min_by(own, F.struct("seq", "_k")).over(w)
    alone = F.min_by(own, F.struct("seq", "_k")).over(Window.partitionBy(*pair, "start"))
    out = out.withColumn("_a", F.when(whole, first).otherwise(alone))
    fresh = stable_id("event", F.col("comp"), F.col("home"), F.col("away"), F.col("_a.start").cast("long"), F.col("near"))
    one = F.col("near") == 1
    return _cut(
        out.withColumns(
            {
                "made": ~one, "event": F.when(one, F.col("h.event")).otherwise(fresh), "e_start": F.when(one, F.col("h.e_start")).otherwise(F.col("_a.start")),
                "e_provider": F.when(one, F.col("h.e_provider")).otherwise(F.col("_a.source")),
            }
        ).drop("near", "h", "_gap", "_chain", "_a")
    )


# ------------------------------------------------------------- the batch


def _entry(df: DataFrame, kind: str, name, target, state, method, marks="", context="", at=None) -> DataFrame:
    """Rows of the log; texts are columns, except where given as Column."""
    c = lambda x: x if isinstance(x, Column) else F.col(x) if x else F.lit("")
    return df.select(
        "sport", F.col("land").alias("lot"), "seq", F.lit(kind).alias("kind"), "source", c(name).alias("name"), c(marks).alias("marks"), c(context).alias("context"), c(target).alias("target"),
        c(state).alias("state"), c(method).alias("method"), (F.lit(None) if at is None else F.col(at)).cast("double").alias("at"),
    )


def _learned(df: DataFrame, kind: str) -> list[DataFrame]:
    """What is written of answered names: drifted ids, names, ids."""
    return [
        _entry(df.filter("drifted is not null"), f"{kind}-id", "sid", "drifted", F.lit(SUSPECT), F.lit("id-drift"), "was_marks", "was"),
        _entry(df, f"{kind}-name", "key", "target", "state", "method", "marks", "place"),
        _entry(df.filter("sid is not null"), f"{kind}-id", "sid", "target", "state", "method", "marks", "key"),
    ]


def _claims(df: DataFrame, kind: str, k: Known, reference: str | None) -> list[DataFrame]:
    """Ids of the reference provider that nothing holds yet, on entities that hold none: the first of a batch on either side."""
    if reference is None:
        return []
    held = k.references.filter(F.col("kind") == kind)
    open_ = df.filter((F.col("source") == reference) & F.col("sid").isNotNull() & (F.col("state") == VERIFIED))
    open_ = open_.join(held.select("sport", "sid"), ["sport", "sid"], "left_anti").join(held.select("sport", "target"), ["sport", "target"], "left_anti")
    by = lambda c: F.row_number().over(Window.partitionBy("sport", c).orderBy("seq", "aid"))
    first = open_.withColumn("_a", by("sid")).withColumn("_b", by("target")).filter("_a = 1 and _b = 1")
    return [_entry(first, "reference", "sid", "target", "state", "method", context=F.lit(kind))]


def resolve(
    records: DataFrame, catalogue: DataFrame | None = None, aliases: dict[str, str] | None = None, tokens: dict[str, str] | None = None,
    reference: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """As ``identity.resolve``, for a batch that is one moment: (id, event_id, confidence, resolution) and the entries to append.

    ``seq`` (from 0 to 2^58) says which of a batch's names and claims is the first; the entries' numbers follow it."""
    spark = records.sparkSession
    if catalogue is None:
        catalogue = spark.createDataFrame([], f"sport string, lot string, no long, {ENTRY}")
    hashed, firsts = distinct_fixtures(records, aliases, tokens)
    firsts = _cut(firsts.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("sport", "source", "land", "league_key", "home_key", "away_key")}))
    k = known(catalogue)
    bad = F.when((F.col("home_key") == "") | (F.col("away_key") == ""), "missing-team-name").when(F.col("same"), "home-equals-away").when(F.col("start").isNull(), "missing-start")
    refused = firsts.withColumn("resolution", bad).filter("resolution is not null")
    good = firsts.filter(bad.isNull())

    by_id = _by_id(good, k)
    kept = good.join(by_id.filter("fits").drop("fits"), "_k")
    recycled = good.join(by_id.filter("not fits").select("_k", "event"), "_k")
    rest = good.join(by_id.filter("fits"), "_k", "left_anti")

    asked = rest.select("sport", "source", F.col("competition_source_id").alias("sid"), F.col("league_key").alias("key"), F.col("league_marks").alias("marks"), "land", "seq")
    comps = _competitions(asked, k, reference)
    answer = comps.select("sport", "source", F.col("sid").alias("_sid"), F.col("key").alias("league_key"), "land", F.col("target").alias("comp"), F.col("score").alias("c_score"), F.col("state").alias("c_state"))
    rest = _cut(rest.join(answer, ["sport", "source", "league_key", "land"]).filter(F.col("_sid").eqNullSafe(F.col("competition_source_id"))).drop("_sid"))

    sure = rest.filter(F.col("c_state") == VERIFIED)
    context = _by_context(sure, k)
    in_context = rest.join(context, "_k")
    rest = rest.join(context, "_k", "left_anti")

    side = lambda df, s, team=None: df.select(
        "_k", "sport", "source", F.col(f"{s}_source_id").alias("sid"), F.col(f"{s}_key").alias("key"), F.col(f"{s}_marks").alias("marks"), "land", F.col("comp").alias("scope"), "seq",
        *([F.col(team).alias("target")] if team else []),
    )
    teams = _teams(side(rest, "home").unionByName(side(rest, "away")), k, reference)
    for s in ("home", "away"):
        answer = teams.select(
            "sport", "source", F.col("sid").alias("_sid"), F.col("key").alias(f"{s}_key"), "land", F.col("scope").alias("comp"),
            F.col("target").alias(s), F.col("score").alias(f"{s}_score"), F.col("state").alias(f"{s}_state"),
        )
        rest = rest.join(answer, ["sport", "source", f"{s}_key", "land", "comp"]).filter(F.col("_sid").eqNullSafe(F.col(f"{s}_source_id"))).drop("_sid")
    trusted = (F.col("c_state") == VERIFIED) & (F.col("home_state") == VERIFIED) & (F.col("away_state") == VERIFIED)
    rest = _events(rest, k).withColumns({"trust": F.when(trusted, VERIFIED).otherwise(UNVERIFIED), "score": F.least("home_score", "away_score", "c_score")})

    # -- the log
    seen = F.lit("fixture-context")
    placed = side(in_context, "home", "home").unionByName(side(in_context, "away", "away")).withColumns(
        {"place": F.col("scope"), "state": F.lit(VERIFIED), "method": seen, "drifted": F.lit(None).cast("string"), "was": F.lit(None).cast("string"), "was_marks": F.lit(None).cast("string")}
    ).withColumn("aid", F.col("_k"))
    named = ["sport", "land", "seq", "source", "sid", "key", "marks", "place", "target", "state", "method", "aid"]
    joined = k.plays.select("sport", "scope", F.col("id").alias("target"))
    own = k.teams.select("sport", F.col("id").alias("target"), F.col("key").alias("_tk"), F.col("marks").alias("_tm"))
    enters = teams.join(joined, ["sport", "scope", "target"], "left_anti").join(own, ["sport", "target"], "left")
    enters = enters.withColumns({"key": F.coalesce("_tk", "key"), "marks": F.coalesce("_tm", "marks")})
    with_id = lambda df: df.filter("source_event_id is not null")
    may_move = F.col("source") == F.col("e_provider") if reference is None else (F.col("source") == reference) | (F.col("source") == F.col("e_provider"))
    moved = reduce(DataFrame.unionByName, [d.select("sport", "land", "seq", "source", "event", "start", "e_start", "e_provider") for d in (kept, in_context, rest)])
    parts = [
        _entry(recycled, "event-id", "source_event_id", "event", F.lit(SUSPECT), F.lit("recycled-id")),
        _entry(comps.filter("made"), "competition", "key", "target", "state", "method", "marks", "context"), *_learned(comps, "competition"),
        _entry(enters, "team", "key", "target", "state", "method", "marks", "scope"), *_learned(teams, "team"), *_learned(placed, "team"),
        *_claims(comps, "competition", k, reference), *_claims(teams.select(*named).unionByName(placed.select(*named)), "team", k, reference),
        _entry(with_id(in_context), "event-id", "source_event_id", "event", F.lit(VERIFIED), seen),
        _entry(rest.filter("made"), "event", F.concat_ws(" ", "home", "away"), "event", F.lit(VERIFIED), F.lit("new"), context="comp", at="e_start"),
        _entry(with_id(rest), "event-id", "source_event_id", "event", "trust", F.lit("resolved")),
        _entry(moved.filter(may_move & (F.col("start") != F.col("e_start"))), "kickoff", F.lit(""), "event", F.lit(VERIFIED), F.lit("kickoff"), at="start"),
    ]
    log = reduce(DataFrame.unionByName, parts)
    last = catalogue.groupBy(F.coalesce("sport", F.lit("")).alias("sport")).agg(F.max("no").alias("_last"))
    rank = F.coalesce(*[F.when(F.col("kind") == kind, i) for i, kind in enumerate(_KINDS)])
    # suspicion comes before what is learnt of the same record
    order = F.col("seq") * 32 + rank * 2 + F.when(F.col("state") == SUSPECT, 0).otherwise(1)
    log = log.join(last, "sport", "left").withColumn("no", F.coalesce(F.col("_last") + 1, F.lit(0)) + order)
    entity = F.col("kind").isin("competition", "team", "event")
    # an entity is written once a scope, by its first record
    once = log.withColumn("_e", F.when(entity, "").otherwise(F.to_json(F.struct("source", "name", "marks", "state", "method"))))
    row = F.struct("lot", "no", *_FIELDS)
    entries = once.groupBy("sport", "kind", "target", "context", "_e", "at").agg(F.min_by(row, F.struct("no", "source", "lot")).alias("r")).select("sport", "r.*").select("sport", "lot", "no", *_FIELDS)
    done = reduce(
        DataFrame.unionByName,
        [
            refused.select("_k", F.lit(None).cast("string").alias("event_id"), F.lit(0.0).alias("confidence"), "resolution"),
            kept.select("_k", F.col("event").alias("event_id"), F.lit(100.0).alias("confidence"), F.lit("resolved").alias("resolution")),
            in_context.select("_k", F.col("event").alias("event_id"), F.col("score").alias("confidence"), F.lit("resolved-by-fixture-context").alias("resolution")),
            rest.select("_k", F.col("event").alias("event_id"), F.col("score").alias("confidence"), F.lit("resolved").alias("resolution")),
        ],
    )
    return hashed.select("id", "_k").join(done, "_k", "left").select("id", "event_id", "confidence", "resolution"), _cut(entries)
