"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a seeded hash and repeated in passes.
A document's virtual finish time is its source's cumulative tokens divided by the
source's target, so all sources progress alike; the mix is the global order of
finish times, truncated at the total budget. Cumulative sums never meet in one
task: a source is cut into hash-range buckets whose sums are accumulated first,
and the global order is range-partitioned.

Rows that agree in all columns of the key are one entry with a count until they are
dealt out, each with its ordinal, which the shuffle's hash includes: so the order is
total, reruns agree whatever order the rows come in, and a row that is repeated a
million times lies in no single bucket. The targets are found by sorting sources by
the pass at which they are used up, so any number of sources will do.

Defined results: a null text has size 0; a null source is a source, last in code
point order; a null doc_id is a key like any other; documents of size 0 take 0 words;
rows that are equal in doc_id, source, size and text are interchangeable, and the
words taken of them are the same on every run as a whole; extra columns are ignored by
the query and carried along by ``mix``, where their names must not begin with an
underscore; a very long text is one document, counted whole; an empty table gives an
empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import copies, cut, numbered, ranged_prefix, read, spread_join, stored, text_or_empty

#: Fixed values of the mix: weights by source order, and the most passes over a source.
WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Documents that a bucket of a source should hold about.
BUCKET = 50_000


def words(col: Column) -> Column:
    """Number of runs of anything but space and \\t..\\r."""
    return F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(docs: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES, fraction: float = 1.0) -> DataFrame:
    """``docs`` (source, size, and n, where a row stands for n) -> a row a source: source, source_size, target, and n, its rows.

    Weights are dealt in code point order. A target is its weight's share of ``fraction`` x
    all sizes, but at most ``most`` x its source's size; the excess is shared again by
    weight. Sorted by most x size / weight, the sources that stop at their bound come
    first: the level of a source is what is left after those before it, by weight, and the
    first source that doesn't stop gives the level of all that follow.
    """
    n = F.col("n") if "n" in docs.columns else F.lit(1).cast("long")
    sizes = docs.groupBy("source").agg(F.sum(F.col("size") * n).cast("long").alias("source_size"), F.sum(n).alias("n"))
    # UTF-8 bytes are in the order of code points
    order = [F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8")]
    dealt = numbered(sizes, order, "_rank").withColumn(
        "_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    )
    bound = F.col("source_size") * F.lit(float(most))
    dealt = dealt.withColumn("_full", bound / F.col("_w"))
    whole = dealt.agg((F.sum("source_size") * F.lit(float(fraction))).alias("_all"), F.sum("_w").alias("_weights"))
    run = ranged_prefix(dealt.withColumn("_bound", bound), ["_full", "_rank"], {"_bound": "_used", "_w": "_gone"}, before=True)
    run = run.crossJoin(F.broadcast(whole)).withColumn(  # one row
        "_level", (F.col("_all") - F.col("_used")) / (F.col("_weights") - F.col("_gone"))
    )
    run = cut(run.withColumn("_open", F.col("_full") >= F.col("_level")))
    level = run.filter("_open").agg(F.min(F.struct("_full", "_rank", "_level"))["_level"].alias("_l"))
    goal = F.when(F.col("_open"), F.col("_w") * F.col("_l")).otherwise(F.col("_bound"))
    return run.crossJoin(F.broadcast(level)).select("source", "source_size", goal.cast("double").alias("target"), "n")  # one row


def mix(docs: DataFrame, key: list[str], weights=WEIGHTS, most: int = MOST_PASSES, seed: int = 7) -> DataFrame:
    """``docs`` (source, size and the columns of ``key``) -> a row for each row: source, size,
    the columns of ``key``, ``copy`` (its number among rows that are equal in these),
    source_size, target, ``passes`` (times the document is taken, 0 to ``most``) and ``taken``
    (passes x size).
    """
    columns = list(dict.fromkeys(["source", "size", *key]))
    entries = stored(docs.groupBy(*columns).agg(F.count("*").alias("n")))
    rows = copies(entries).drop("n")
    goal = cut(targets(entries, weights, most))  # used often below: its plan must not be part of each of them
    first = goal.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.max("n"), F.lit(0))).first()
    total, budget, largest = int(first[0]), float(first[1]), int(first[2])
    goal = goal.withColumns({"_source": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull()}).drop("source")
    named = rows.withColumns({"_source": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull()})
    order = [*columns, "copy"]
    bits = max(8, min(40, (largest // BUCKET).bit_length()))  # of the bucket number, as the largest source asks for
    shuffled = spread_join(named, goal, ["_source", "_null"], total).withColumn("_h", F.xxhash64(F.lit(seed), *order))
    shuffled = stored(shuffled.withColumn("_b", F.shiftrightunsigned("_h", 64 - bits)))
    # cumulative size within the source: sums of hash-range buckets first, then inside each
    bucket = ["_source", "_null", "_b"]
    sums = shuffled.groupBy(*bucket).agg(F.sum("size").alias("_n"))
    below = Window.partitionBy("_source", "_null").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*bucket, F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*bucket).orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = shuffled.withColumn("_cum", F.sum("size").over(within)).join(offsets, bucket)
    placed = cut(placed.withColumn("_cum", F.col("_cum") + F.col("_off")).drop("_off", *bucket, "_h"))

    # one queue entry for each pass that can come up before the end of virtual time
    last = F.least(F.lit(most - 1), F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).cast("int")
    rounds = F.sequence(F.lit(0), last)

    def entry(n: Column) -> Column:
        finish = (F.col("_cum") + n * F.col("source_size")) / F.col("target")
        finish = F.when(F.col("target") > 0, finish).otherwise(F.lit(0.0)).cast("double")
        return F.struct(finish.alias("finish"), n.alias("round"), *[F.col(k) for k in order])

    queue = placed.select(F.col("size").alias("_size"), F.explode(F.transform(rounds, entry)).alias("e")).select("_size", "e.*")
    run = ranged_prefix(queue, ["finish", "round", *order], {"_size": "_run"})
    end = run.filter(F.col("_run") <= F.lit(budget + 0.5)).agg(F.max(F.struct("finish", "round", *order)).alias("e"))
    cutoff = end.first()["e"]
    if cutoff is None:
        passes = F.lit(0)
    else:
        types = dict(queue.dtypes)
        stop = F.struct(*[F.lit(cutoff[c]).cast(types[c]).alias(c) for c in ("finish", "round", *order)])
        passes = F.size(F.filter(F.transform(rounds, entry), lambda e: e <= stop))
    return placed.withColumn("passes", passes).withColumn("taken", (F.col("passes") * F.col("size")).cast("long")).drop("_cum")


def identity(*columns: str) -> list[Column]:
    """Two 64-bit hashes that tell rows apart by ``columns``, nulls included."""
    told = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(F.lit(1), *told).alias("h1"), F.xxhash64(F.lit(2), *told).alias("h2")]


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to the targets of their sources."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", words(text_or_empty()).alias("size"), *identity("text"))
    return mix(docs, ["doc_id", "h1", "h2"]).select("doc_id", "size", "source_size", "target", "taken")
