"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A topology is a list of shards, each in a rack of a region and with a weight; a
rack or region weighs what its shards weigh. A key descends three levels, and at
each level the child with the smallest draw ``-ln(u(key, child)) / weight`` wins.
A child's draw depends on its own name and weight alone, so a change of weight
moves keys only into or out of the subtrees whose weights changed.

``grow`` puts the new shard in a region of its own: no existing weight changes,
hence one more shard takes rows only into itself.

Defined results: a null key is a key like any other (hash of nothing), equal keys
share a shard, whatever their texts, rows that are wholly equal have slots of their own, an
empty table gives an empty table, a null text has size 16 and crc32 0, a very long text is
only measured. Columns of the input other than the key and text are ignored.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import copies, read, text_or_empty


@dataclass(frozen=True)
class Shard:
    shard: int
    region: str
    rack: str
    weight: float = 1.0


def topology(shards: int, racks_per_region: int = 2, shards_per_rack: int = 4) -> list[Shard]:
    """Shards 0..n-1 filled region by region, equal weights."""
    per_region = racks_per_region * shards_per_rack
    return [
        Shard(i, f"region{i // per_region}", f"rack{i % per_region // shards_per_rack}") for i in range(shards)
    ]


def grow(topo: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a new region: only it gains rows."""
    new = max(s.shard for s in topo) + 1
    return [*topo, Shard(new, f"grown{new}", "rack0", weight)]


def _winner(key: Column, names: Column, weights: Column) -> Column:
    """Place (from 0) of the child with the smallest weighted draw among parallel arrays of
    names and weights (ties: the first)."""

    def draw(name: Column, i: Column) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(name, key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((-F.log(unit) / F.get(weights, i)).alias("d"), i.alias("i"))

    return F.array_min(F.transform(names, draw))["i"]


def _tree(topo: list[Shard], fields: tuple[str, ...]) -> tuple[list[str], list[list[str]], list[list[float]]]:
    """Paths of one level's parents, and the names and weights of each one's children."""
    found: dict[str, dict[str, float]] = {}
    for s in topo:
        path = "".join(f"/{getattr(s, f)}" for f in fields[:-1])
        children = found.setdefault(path, {})
        name = f"{path}/{getattr(s, fields[-1])}"
        children[name] = children.get(name, 0.0) + s.weight
    return list(found), [list(c) for c in found.values()], [list(map(float, c.values())) for c in found.values()]


def assign(key: Column, topo: list[Shard]) -> Column:
    """Shard of ``key``; a shard of weight 0 or less gets nothing.

    Each level is one expression over literal arrays, in which the path chosen so far
    selects the children; so its size is that of the topology.
    """
    live = [s for s in topo if s.weight > 0 and math.isfinite(s.weight)]
    if not live:
        raise ValueError("no shard has a positive weight")

    def literal(values: list, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(values)), f"array<array<{kind}>>")

    levels, path = ("region", "rack", "shard"), None
    for depth in range(len(levels)):
        parents, names, weights = _tree(live, levels[: depth + 1])
        at = F.lit(0) if path is None else F.element_at(F.from_json(F.lit(json.dumps({p: i for i, p in enumerate(parents)})), "map<string,int>"), path)
        own, heavy = F.get(literal(names, "string"), at), F.get(literal(weights, "double"), at)
        path = F.get(own, _winner(key, own, heavy))
    return F.element_at(F.split(path, "/"), -1).cast("int")


def with_slots(df: DataFrame, shard: str, order: list[str], salts: int = 256) -> DataFrame:
    """Each row's ``shard`` and columns of ``order``, with ``slot``: gapless from 0 within each
    shard, the same on every run. Other columns must be functions of these, and are kept.

    A shard may hold any share of the rows, so it is numbered in salted runs, plus the rows
    of the lower salts. Rows that are equal in ``order`` are one with a count until they are
    numbered, so no salt holds all copies of a row. The sums of salts have at most shards x
    salts rows, whatever the input.
    """
    rest = [c for c in df.columns if c not in (shard, *order)]
    firsts = [F.first(c).alias(c) for c in rest]
    one = df.groupBy(shard, *order).agg(F.count("*").alias("_n"), *firsts).withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sums = one.groupBy(shard, "_salt").agg(F.sum("_n").alias("_s"))
    below = Window.partitionBy(shard).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(shard, "_salt", F.coalesce(F.sum("_s").over(below), F.lit(0)).alias("_off"))
    up = Window.partitionBy(shard, "_salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = one.withColumn("_rank", F.coalesce(F.sum("_n").over(up), F.lit(0))).join(F.broadcast(offsets), [shard, "_salt"])
    dealt = copies(placed, "_n", "_copy")
    return dealt.select(*df.columns, (F.col("_off") + F.col("_rank") + F.col("_copy")).cast("long").alias("slot"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the ``key`` law."""
    topo = topology(40)
    text = text_or_empty()
    docs = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    )
    key = F.col("doc_id")
    placed = docs.withColumns({"shard": assign(key, topo), "grown_shard": assign(key, grow(topo))})
    return with_slots(placed, "shard", ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
