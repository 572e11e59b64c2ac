"""Peak concurrency sweep over dyadic time nodes.

Time is cut into dyadic nodes: node (level, i) covers the moments from i * 2^level up to
(i + 1) * 2^level. An interval is the disjoint union of at most two nodes a level, so what is open
at a moment is the sum over the nodes above it. Intervals become node keys, sums are kept a node,
every change moment is joined with the nodes above it, and maxima are scanned blockwise.

Levels are taken ``BITS`` at a time. A tier is the levels of one such stretch; in a tier's unit a
block holds 2^BITS places. An interval gives each tier at most two pieces, one at each edge, which
lie within a block; what is between them belongs to the tiers above. Pieces and moments are
pre-aggregated, dealt by (key, block) and only then laid out as nodes and as ancestors, so that the
equi-join on nodes needs no further shuffle. The places of a tier are the blocks of the tier below:
all that holds for a whole block (its ancestors above, the maximum before it, the moment after it)
is worked out once a block. A block has at most 2^BITS rows whatever the data, so neither a hot key
nor a hot time makes a large group, and no group grows with the input.

Defined results: intervals with a null begin, or an end not after it, take no part; a null end is
open for ever; a null key counts for ``together`` only; a null weight is 0; repeated rows count each; equal
moments of a key are one; a moment whose changes cancel gives no row; an empty table gives an empty
table; columns other than those named are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import HOT, cut, parts, read, stored

#: Levels of a tier: a block has 2^BITS places.
BITS = 8
_SIZE = 1 << BITS


def utc_seconds(df: DataFrame, name: str) -> Column:
    """Seconds since 1970, rounded down. A time without a zone is taken as UTC, whatever
    the session's zone is."""
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.expr(f"(unix_micros(`{name}`) - pmod(unix_micros(`{name}`), 1000000L)) div 1000000L")
    since = f"(`{name}` - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    whole = " + ".join(f"extract({unit} FROM {since}) * {s}L" for unit, s in (("DAY", 86_400), ("HOUR", 3600), ("MINUTE", 60)))
    return F.floor(F.expr(f"{whole} + extract(SECOND FROM {since})")).cast("long")


def _up(c: Column, bits: int) -> Column:
    """Rounded up to units of 2^bits."""
    return F.shiftright(c + ((1 << bits) - 1), bits)


def _pieces(spans: DataFrame, tiers: int) -> DataFrame:
    """Spans (key, a, b, n, w) -> key, tier, lo, hi, n, w: what each tier covers of them, in its own
    unit, each piece within a block. The last tier, which has one block, takes all that is left."""
    a, b, out = F.col("a"), F.col("b"), []
    made = lambda t, lo, hi: F.struct(F.lit(t).alias("tier"), lo.alias("lo"), hi.alias("hi"))
    for t in range(tiers):
        lo, hi = _up(a, BITS * t), F.shiftright(b, BITS * t)
        if t == tiers - 1:
            out.append(F.when(lo < hi, made(t, lo, hi)))
            break
        inside, outside = lo.bitwiseAND(_SIZE - 1) != 0, hi.bitwiseAND(_SIZE - 1) != 0
        of_lo, of_hi = F.shiftright(lo, BITS), F.shiftright(hi, BITS)
        out.append(F.when((lo < hi) & inside, made(t, lo, F.least(hi, F.shiftleft(of_lo + 1, BITS)))))
        out.append(F.when((lo < hi) & outside & ~(inside & (of_lo == of_hi)), made(t, F.shiftleft(of_hi, BITS), hi)))
    laid = spans.select("key", "n", "w", F.inline(F.array(*out))).filter("tier is not null")
    return laid.groupBy("key", "tier", "lo", "hi").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))


def _nodes(pieces: DataFrame, last: bool) -> DataFrame:
    """Pieces of a tier, dealt by (key, block) -> key, block, node, n, w. ``node`` numbers the dyadic
    nodes of a block: level and place as 2^(BITS - level) + place, the whole block is 1."""
    lo, hi = F.col("lo").bitwiseAND(_SIZE - 1), F.col("hi") - F.shiftleft("block", BITS)
    found = []
    for level in range(BITS + bool(last)):
        x, y, first = _up(lo, level), F.shiftright(hi, level), 1 << (BITS - level)
        found.append(F.when((x < y) & (x.bitwiseAND(1) == 1), x + first))
        found.append(F.when((x < y) & (y.bitwiseAND(1) == 1), y - 1 + first))
    laid = pieces.select("key", "block", F.explode(F.array(*[x.cast("int") for x in found])).alias("node"), "n", "w").filter("node is not null")
    return laid.groupBy("key", "block", "node").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))


def _placed(df: DataFrame, at: str) -> DataFrame:
    """``df`` dealt by (key, block), the block of ``at``."""
    return df.withColumn("block", F.shiftright(at, BITS)).repartition(parts(df.sparkSession), "key", "block")


def _open_at(places: DataFrame, pieces: DataFrame, above: DataFrame | None) -> DataFrame:
    """Places (key, u) of a tier -> key, block, u, n, w: the sums of all nodes above them, those of
    the tiers above coming with the block, from ``above`` (key, u, n, w)."""
    nodes = _nodes(_placed(pieces, "lo"), above is None)
    place = F.col("u").bitwiseAND(_SIZE - 1).cast("int")
    levels = F.array(*[F.shiftright(place + _SIZE, level) for level in range(BITS + (above is None))])
    asked = _placed(places, "u").select("key", "block", "u", F.explode(levels).alias("node"))
    joined = asked.join(nodes.hint("shuffle_hash"), ["key", "block", "node"], "left")
    sums = joined.groupBy("key", "block", "u").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "w")])
    if above is None:
        return sums
    base = above.select("key", F.col("u").alias("block"), F.col("n").alias("n0"), F.col("w").alias("w0"))
    return sums.join(base, ["key", "block"]).select("key", "block", "u", (F.col("n") + F.col("n0")).alias("n"), (F.col("w") + F.col("w0")).alias("w"))


@contextmanager
def _dealt_once(spark: SparkSession):
    """Within it, a join is content with sides dealt by some of its keys. Blocks are bounded, so this makes no skew."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _carried(blocks: DataFrame, tiers: int) -> DataFrame:
    """Blocks (key, u, first, top_n, top_w) -> key, u, next, high, peak: the first moment after the
    block, the largest n before it, the largest w of the key. ``tiers``: how many tiers the blocks need."""
    spot = Window.partitionBy("key", "block").orderBy("u")
    before = spot.rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("block", F.shiftright("u", BITS) if tiers > 0 else F.lit(0).cast("long"))
    rows = rows.withColumn("next", F.lead("first").over(spot)).withColumn("high", F.max("top_n").over(before))
    if tiers <= 0:
        return rows.select("key", "u", "next", "high", F.max("top_w").over(Window.partitionBy("key", "block")).alias("peak"))
    whole = blocks.groupBy("key", F.shiftright("u", BITS).alias("u")).agg(F.min("first").alias("first"), F.max("top_n").alias("top_n"), F.max("top_w").alias("top_w"))
    above = _carried(whole, tiers - 1).select("key", F.col("u").alias("block"), F.col("next").alias("next0"), F.col("high").alias("high0"), "peak")
    return rows.join(above, ["key", "block"]).select(
        "key", "u", F.coalesce("next", "next0").alias("next"), F.greatest("high", "high0").alias("high"), "peak"
    )


def sweep(intervals: DataFrame, key: str, begin: str, end: str, weight: str, together: int | None = None) -> DataFrame:
    """``intervals`` (``begin`` to ``end``, excluded, as whole numbers) -> a row for each key and moment
    at which the number or the weight of its open intervals changes: key, from_s, to_s (the key's
    next, null for the last), n_open, open_weight, high_open (the key's largest n_open so far),
    is_peak (open_weight is the key's largest). ``together``: a key that all intervals count for once more."""
    spans = intervals.filter(F.col(begin).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(begin)))).select(
        F.col(key).alias("key"), F.col(begin).cast("long").alias("a"), F.col(end).cast("long").alias("b"), F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("w")
    )
    spans = stored(spans)
    # one row: the range of time alone decides how many tiers there are
    low, high = spans.agg(F.min("a"), F.greatest(F.max("a"), F.max("b"))).first()
    low = low or 0
    tiers = max(1, -(-((high or 0) - low + 1).bit_length() // BITS))
    if together is not None:
        spans = spans.withColumn("key", F.explode(F.array("key", F.lit(together).cast(spans.schema["key"].dataType))))
    spans = spans.filter("key is not null").select("key", (F.col("a") - low).alias("a"), (F.col("b") - low).alias("b"), F.lit(1).cast("long").alias("n"), "w")
    ends = F.array(F.struct(F.col("a").alias("u"), "n", "w"), F.struct(F.col("b").alias("u"), (-F.col("n")).alias("n"), (-F.col("w")).alias("w")))
    changes = spans.select("key", F.explode(ends).alias("x")).filter("x.u is not null").groupBy("key", F.col("x.u").alias("u"))
    moments = stored(changes.agg(F.sum("x.n").alias("n"), F.sum("x.w").alias("w")).filter("n <> 0 or w <> 0").select("key", "u"))
    forever = F.lit(1 << (BITS * tiers)).cast("long")
    pieces = stored(_pieces(spans.withColumn("b", F.coalesce("b", forever)), tiers))

    above = None
    for t in reversed(range(tiers)):
        places = moments if t == 0 else moments.select("key", F.shiftright("u", BITS * t).alias("u")).distinct()
        above = _open_at(places, pieces.filter(F.col("tier") == t), above)
    spot = Window.partitionBy("key", "block").orderBy("u")
    running = above.withColumn("next", F.lead("u").over(spot)).withColumn("high", F.max("n").over(spot))
    with _dealt_once(spans.sparkSession):
        rows = stored(running)
    blocks = stored(rows.groupBy("key", F.col("block").alias("u")).agg(F.min("u").alias("first"), F.max("n").alias("top_n"), F.max("w").alias("top_w")))
    carried = _carried(blocks, tiers - 1).select("key", F.col("u").alias("block"), F.col("next").alias("next0"), F.col("high").alias("high0"), "peak")
    return rows.join(carried, ["key", "block"]).select(
        F.col("key").alias(key), (F.col("u") + low).alias("from_s"), (F.coalesce("next", "next0") + low).alias("to_s"),
        F.col("n").alias("n_open"), F.col("w").alias("open_weight"), F.greatest("high", "high0").alias("high_open"), (F.col("w") == F.col("peak")).alias("is_peak"),
    )


#: A sale ends so many seconds after its first shipment; the key of all nations.
AFTER, ALL = 86_400, -2


def _looked_up(rows: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """``rows`` with what ``one``, a row a key, has for them, or nulls. Keys that are frequent in a
    sample of about 100 HOT rows (hence at most 2 HOT keys) are joined by broadcast, the others by a
    shuffle: the sample decides where a row is joined, never what comes out."""
    share = min(1.0, 100 * HOT / max(1, rows.count()))
    hot = cut(rows.filter(F.col(key).isNotNull()).sample(share, 7).groupBy(key).count().filter("count > 50").select(key))
    if hot.isEmpty():
        return rows.join(one, key, "left")
    crowded = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(one.join(F.broadcast(hot), key, "left_semi")), key, "left")
    return crowded.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(one, key, "left"))


def open_sales(sales: DataFrame, lines: DataFrame, clients: DataFrame) -> DataFrame:
    """Sales as intervals: nation_id (-1 for none), begin, end (null for ever), cents. A client that
    occurs with several nations has the smallest; a total that isn't a number, or beyond 9e16, has no cents."""
    shipped = lines.filter("sale_id is not null").groupBy("sale_id").agg(F.min("shipped_at").alias("shipped_at")).filter("shipped_at is not null")
    shipped = shipped.select("sale_id", (utc_seconds(shipped, "shipped_at") + AFTER).alias("end"))
    nation = clients.filter("client_id is not null").groupBy("client_id").agg(F.min("nation_id").cast("int").alias("nation_id"))
    fits = F.col("total").between(-9e14, 9e14)
    cents = F.when(fits, F.floor(F.when(fits, 100 * F.col("total") + 0.5))).otherwise(0)
    begun = sales.select("sale_id", "client_id", utc_seconds(sales, "sold_at").alias("begin"), cents.cast("long").alias("cents")).filter("begin is not null")
    ended = stored(_looked_up(begun, shipped, "sale_id").filter("end is null or end > begin"))
    return _looked_up(ended, nation, "client_id").select(F.coalesce("nation_id", F.lit(-1)).alias("nation_id"), "begin", "end", "cents")


def op13_peak_concurrency(spark, sf_dir: str) -> DataFrame:
    """Open sales and their cents of each nation, and of all together (-2), at every change."""
    intervals = open_sales(read(spark, sf_dir, "sales"), read(spark, sf_dir, "sale_lines"), read(spark, sf_dir, "clients"))
    out = sweep(intervals, "nation_id", "begin", "end", "cents", ALL)
    return out.withColumnRenamed("open_weight", "open_cents").select("nation_id", "from_s", "to_s", "n_open", "open_cents", "high_open", "is_peak")

