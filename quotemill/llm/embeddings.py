"""Near-duplicate embeddings by NN-descent.

Equal vectors of a label form a class with one representative and a number of its own, so
ids that repeat or clash change nothing. Representatives start
with neighbours from leaves of random projections, in as many tables as find a pair at the
threshold with probability 1 - ``MISS`` in a label of its size; every round joins each vector's
neighbours with each other (neighbours of neighbours) and keeps the best ``K`` of each.
Edges of cosine at least the threshold stay. A list that is full of such edges may hide
more: the whole component of a saturated list is compared exactly, together with all such
components that can touch it, block by block, and only counts and joined components
leave a block. A fixed number of audit queries is compared with all rows, and recall is
averaged over queries, by their number of links, so that crowds don't hide the
lonely pairs. Below the wanted recall, there are new tables, longer lists and more rounds; if
that doesn't help in ``ATTEMPTS``, all rows of a label are compared, in blocks.

Defined results: vectors without a label, null, empty, zero, or with null or non-finite
components link with nothing and stay; rows without vec_id likewise; rows that repeat a
vec_id are vectors of their own, and are copies only of equal vectors; vectors of different
lengths don't link; components of other types than float are compared as doubles; ties in similarity go to the smaller number; other columns are ignored,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ._common import cut, parts, read, small_batches, spread_join
from .components import components

THRESHOLD = 0.93
#: Neighbours of a list, reverse neighbours that join in, vectors of a leaf, share of pairs that no table may find.
K, REVERSE, LEAF, MISS = 8, 8, 48, 0.02
ROUNDS, RECALL, AUDIT, ATTEMPTS = 3, 0.97, 1000, 3
#: Least and most representatives of a block in an exact comparison, and blocks of a crowd between them.
SMALL, LARGE, SPLIT = 128, 1024, 8
#: Audit queries that make the recall of a number of links worth looking at.
ENOUGH = 20


def _unit(raw: list[bytes]) -> np.ndarray:
    """Rows of bytes, the first of which names the type -> unit vectors in double precision."""
    kind = "<f8" if raw and raw[0][:1] == b"d" else "<f4"
    x = np.frombuffer(b"".join(memoryview(r)[1:] for r in raw), kind).reshape(len(raw), -1).astype(np.float64)
    if kind == "<f8" and len(x):  # squares of large and small doubles leave their range
        x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def grouped(batches, key: int = 0):
    """Sorted Arrow batches -> (key, column lists) of each group, across batch borders."""
    held, key_held = None, None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_pylist()
        cols = [c.to_pylist() for c in b.columns]
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            part = [c[start:i] for c in cols]
            if held is not None and keys[start] == key_held:
                held = [x + y for x, y in zip(held, part, strict=True)]
            else:
                if held is not None:
                    yield key_held, held
                held, key_held = part, keys[start]
            start = i
    if held is not None:
        yield key_held, held


def _edges(rows):
    import pyarrow as pa

    u, v, s = (np.concatenate(x) if x else np.zeros(0) for x in (zip(*rows, strict=True) if rows else ((), (), ())))
    return pa.RecordBatch.from_arrays(
        [pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(s.astype(np.float64))], names=["u", "v", "s"]
    )


def _flush(made, limit=20_000):
    """(u, v, s) arrays -> Arrow batches of moderate size."""
    rows, n = [], 0
    for r in made:
        rows.append(r)
        n += len(r[0])
        if n >= limit:
            yield _edges(rows)
            rows, n = [], 0
    if n:
        yield _edges(rows)


def _best(ids: np.ndarray, sims: np.ndarray, floor: np.ndarray, most: int):
    """For each row its ``most`` largest similarities above ``floor``."""
    np.fill_diagonal(sims, -2.0)
    n = min(most, len(ids) - 1)
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at = np.argpartition(-sims, n - 1, axis=1)[:, :n]
    s = np.take_along_axis(sims, at, 1)
    keep = (s > floor[:, None]) & (ids[:, None] != ids[at])
    return np.repeat(ids, n).reshape(-1, n)[keep], ids[at][keep], s[keep]


def code_length(size: int, leaf: int) -> int:
    """Bits of a leaf's code in a label of this size."""
    return max(0, min(40, int(np.ceil(np.log2(max(1.0, size / leaf))) + 1))) if size > leaf else 0


def tables_for(size: int, leaf: int, threshold: float) -> int:
    """Tables in which a pair at the threshold is in one leaf at least, but for ``MISS``."""
    hit = (1 - np.arccos(threshold) / np.pi) ** code_length(size, leaf)
    return 1 if hit >= 1 else int(np.ceil(np.log(MISS) / np.log(1 - hit)))


def _leaves(reps: DataFrame, counts: DataFrame, total: int, attempt: int, leaf: int, k: int, threshold: float) -> DataFrame:
    """Seed edges: pairs within leaves of sign codes, a label's code as long as its size asks for."""

    def codes(batches):
        import pyarrow as pa

        for b in batches:
            node, group, size, raw = (b.column(c).to_pylist() for c in ("node", "grp", "size", "vec"))
            by_kind: dict[tuple[int, int], list[int]] = {}
            for i, r in enumerate(raw):
                by_kind.setdefault((len(r), size[i]), []).append(i)
            for (_, n), own in by_kind.items():
                x, width = _unit([raw[i] for i in own]), code_length(n, leaf)
                for t in range(tables_for(n, leaf, threshold)):
                    planes = np.random.default_rng([attempt, t, 4 * x.shape[1]]).normal(size=(x.shape[1], width))
                    bits = (x @ planes > 0).astype(np.int64) @ (np.int64(1) << np.arange(width))
                    leaves = [f"{t}|{group[i]}|{code}" for i, code in zip(own, bits.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaves, pa.string()), pa.array([node[i] for i in own], pa.int64()), pa.array([raw[i] for i in own], pa.binary())],
                        names=["leaf", "node", "vec"],
                    )

    def pairs(batches):
        def made():
            for _, (_, node, raw) in grouped(batches):
                # a large leaf is cut at random, so a crowd of near copies stays in pieces
                order = np.random.default_rng(len(node)).permutation(len(node))
                for s in range(0, len(node), leaf * 2):
                    own = order[s : s + leaf * 2]
                    if len(own) > 1:
                        x, ids = _unit([raw[i] for i in own]), np.array([node[i] for i in own])
                        yield _best(ids, x @ x.T, np.full(len(own), -1.5), k)

        yield from _flush(made())

    coded = spread_join(reps, counts, ["grp"], total).mapInArrow(codes, "leaf string, node long, vec binary")
    # a crowded leaf is dealt in salted parts; which ones depends on the leaf's rows alone
    crowd = coded.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * leaf).withColumn("size", F.col("n"))
    salt = F.pmod(F.xxhash64("node", "leaf"), F.ceil(F.col("size") / (2 * leaf)).cast("long")).cast("string")
    salted = spread_join(coded, crowd, ["leaf"], total, how="left").withColumn(
        "leaf", F.when(F.col("size").isNotNull(), F.concat_ws("|", "leaf", salt)).otherwise(F.col("leaf"))
    ).drop("size")
    dealt = salted.repartition(parts(reps.sparkSession), "leaf").sortWithinPartitions("leaf", "node")
    return dealt.mapInArrow(pairs, "u long, v long, s double")


def _keep(edges: DataFrame, k: int) -> DataFrame:
    """The best ``k`` distinct neighbours of each vector."""
    by = Window.partitionBy("u").orderBy(F.col("s").desc(), "v")
    one = edges.groupBy("u", "v").agg(F.max("s").alias("s"))
    return one.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k).drop("r")


def _round(reps: DataFrame, lists: DataFrame, total: int, k: int, reverse: int) -> DataFrame:
    """Neighbours of neighbours: pairs of each list (with some reverse neighbours) that improve one."""
    worst = lists.groupBy("u").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(F.lit(-1.5)).alias("worst"))
    back = lists.select(F.col("v").alias("u"), F.col("u").alias("v"))
    by = Window.partitionBy("u").orderBy(F.xxhash64("u", "v"), "v")
    some = back.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= reverse).select("u", "v")
    pool = lists.select("u", "v").union(some).distinct()
    members = reps.select("node", "vec").join(worst, F.col("node") == F.col("u")).select(F.col("node").alias("v"), "worst", "vec")
    # a vector can be the neighbour of very many
    members = members.join(pool.groupBy("v").agg(F.count("*").alias("n")), "v")
    dealt = spread_join(pool, members, ["v"], total).select("u", "v", "worst", "vec")
    dealt = dealt.repartition(parts(reps.sparkSession), "u").sortWithinPartitions("u", "v")

    def join(batches):
        def made():
            for _, (_, node, floor, raw) in grouped(batches):
                if len(node) > 1:
                    x = _unit(raw)
                    yield _best(np.array(node), x @ x.T, np.array(floor), 4)

        yield from _flush(made())

    return dealt.mapInArrow(join, "u long, v long, s double")


def _blocks(rows: DataFrame, by: str, total: int, columns: list[str]) -> DataFrame:
    """``rows`` dealt to (cell, b, node, ...): every pair of blocks of a ``by`` is a cell, sorted by block and node."""
    block = F.greatest(F.lit(SMALL), F.least(F.lit(LARGE), F.col("n") / SPLIT))
    sizes = rows.groupBy(by).agg(F.count("*").alias("n")).withColumn("nb", F.ceil(F.col("n") / block).cast("int"))
    cells = spread_join(rows, sizes, [by], total)
    cells = cells.withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    cells = cells.withColumn("o", other).select(F.concat_ws("|", by, F.least("b", "o"), F.greatest("b", "o")).alias("cell"), "b", "node", *columns)
    return cells.repartition(parts(rows.sparkSession), "cell").sortWithinPartitions("cell", "b", "node")


def _lowest(near: np.ndarray, part: np.ndarray) -> np.ndarray:
    """For each row the least part that its part is connected with by ``near``."""
    names, code = np.unique(part, return_inverse=True)
    of = np.arange(len(names))
    while True:
        low = np.where(near, of[code][None, :], len(names)).min(1)
        new = of.copy()
        np.minimum.at(new, code, low)
        if (new == of).all():
            return names[of[code]]
        of = new


def _exact(crowds: DataFrame, threshold: float, total: int) -> DataFrame:
    """(node, part, to, links): weights linked within each crowd (root, part, node, w, vec), in
    blocks, and the parts of a crowd that its blocks connect. Every pair of blocks is a task's group.
    """

    def count(batches):
        import pyarrow as pa

        for _, (_, b, node, w, part, raw) in grouped(batches):
            x, side, w, part = _unit(raw), np.array(b), np.array(w), np.array(part)
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            to = _lowest(near, part) if part.min() != part.max() else part
            if side[0] != side[-1]:  # within a block is another group's work
                near &= side[:, None] != side[None, :]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(c).astype(np.int64)) for c in (node, part, to, near @ w)], names=["node", "part", "to", "links"]
            )

    dealt = _blocks(crowds, "root", total, ["w", "part", "vec"])
    found = dealt.mapInArrow(count, "node long, part long, to long, links long")
    return cut(found.groupBy("node", "part", "to").agg(F.sum("links").alias("links")))


def _touching(crowds: DataFrame, threshold: float, total: int) -> DataFrame:
    """(u, v): components of ``crowds`` (grp, root, node, vec) that can have a link between them.

    A component lies in the ball about its root's vector, so two have no link if their
    roots are further apart than the angle of the threshold and both radii.
    """
    sizes = crowds.groupBy("root").agg(F.count("*").alias("n"))
    centre = crowds.filter("node = root").select("root", F.col("vec").alias("_c")).join(sizes, "root")

    def spread(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                root, vec, mid = (b.column(i).to_pylist() for i in range(3))
                by: dict[int, list[int]] = {}
                for i, v in enumerate(vec):
                    by.setdefault(len(v), []).append(i)
                for at in by.values():
                    cos = (_unit([vec[i] for i in at]) * _unit([mid[i] for i in at])).sum(1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([root[i] for i in at], pa.int64()), pa.array(np.arccos(np.clip(cos, -1, 1)))], names=["root", "angle"]
                    )

    wide = spread_join(crowds, centre, ["root"], total).select("root", "vec", "_c").mapInArrow(spread, "root long, angle double")
    balls = crowds.filter("node = root").join(wide.groupBy("root").agg(F.max("angle").alias("radius")), "root")

    def meet(batches):
        import pyarrow as pa

        for _, (_, _, node, radius, raw) in grouped(batches):
            x, r, node = _unit(raw), np.array(radius), np.array(node)
            reach = np.minimum(np.arccos(threshold) + r[:, None] + r[None, :] + 1e-6, np.pi)
            to = _lowest(x @ x.T >= np.cos(reach), node)
            yield pa.RecordBatch.from_arrays([pa.array(node[to != node]), pa.array(to[to != node])], names=["u", "v"])

    return _blocks(balls, "grp", total, ["radius", "vec"]).mapInArrow(meet, "u long, v long").distinct()


def _merged(roots: DataFrame, joins: DataFrame, total: int) -> DataFrame:
    """``roots`` (u, root) after some roots were joined by ``joins`` (u, v)."""
    new = components(joins)
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    known = new.select(F.col("u").alias("root"), F.col("root").alias("_root")).join(sizes, "root")
    moved = spread_join(roots, known, ["root"], total, how="left").select("u", F.coalesce("_root", "root").alias("root"))
    return cut(moved.union(new.select("u", "root")))


def _audit(reps: DataFrame, queries: list, threshold: float) -> DataFrame:
    """(node, truth): linked weight of each audit query, by comparison with all rows."""

    def scan(batches):
        import pyarrow as pa

        total: dict[int, int] = {}
        own: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for g in {q.grp for q in queries}:
            rows = [q for q in queries if q.grp == g]
            own[g] = (np.array([q.node for q in rows]), _unit([bytes(q.vec) for q in rows]))
        for b in batches:
            node, group, w, raw = (b.column(c).to_pylist() for c in ("node", "grp", "w", "vec"))
            by: dict[str, list[int]] = {}
            for i, g in enumerate(group):
                if g in own:
                    by.setdefault(g, []).append(i)
            for g, at in by.items():
                ids, q = own[g]
                near = q @ _unit([raw[i] for i in at]).T >= threshold
                near &= ids[:, None] != np.array([node[i] for i in at])[None, :]
                for i, n in zip(ids.tolist(), (near @ np.array([w[i] for i in at])).tolist(), strict=True):
                    total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["node", "n"])

    return reps.mapInArrow(scan, "node long, n long").groupBy("node").agg(F.sum("n").alias("truth"))


def _counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("node").agg(F.sum("links").alias("links"))


def _joined(roots: DataFrame, compared: DataFrame, total: int) -> DataFrame:
    joins = compared.filter("part <> to").select(F.col("part").alias("u"), F.col("to").alias("v")).distinct()
    return roots if joins.isEmpty() else _merged(roots, joins, total)


def _recall(truth: DataFrame, links: DataFrame) -> tuple[float, int]:
    """(least recall, queries with links): the mean over all audit queries that have links, or
    over those with about as many links, whichever is less."""
    share = F.least(F.lit(1.0), F.coalesce("links", F.lit(0)) / F.col("truth"))
    seen = truth.filter("truth > 0").join(links, "node", "left").groupBy(F.floor(F.log2("truth")).alias("about"))
    rows = seen.agg(F.sum(share).alias("s"), F.count("*").alias("n")).collect()  # a row a power of two
    n = sum(r.n for r in rows)
    return min([1.0, *[r.s / r.n for r in rows if r.n >= ENOUGH], *([sum(r.s for r in rows) / n] if n else [])]), n


def near_duplicates(
    rows: DataFrame, threshold: float = THRESHOLD, k: int = K, rounds: int = ROUNDS, recall: float = RECALL, audit: int = AUDIT,
    report: list | None = None,
) -> DataFrame:
    """``rows`` (vec_id, embedding, label) -> vec_id, n_links, component_id, kept. ``report``
    gets (recall, audit queries with links) of each attempt."""
    spark = rows.sparkSession
    small_batches(spark, 4000)
    # floats are kept as such, anything else as doubles
    element = getattr(rows.schema["embedding"].dataType, "elementType", None)
    kind = "float" if isinstance(element, FloatType) else "double"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"), "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    keyed = rows.select(
        "vec_id", F.when(valid, F.concat_ws(":", F.col("label").cast("string"), F.size("embedding"))).alias("grp"),
        F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"), "embedding",
    )
    classes = keyed.filter("grp is not null").groupBy("grp", "h1", "h2").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("w"), F.first("embedding").alias("embedding")
    )

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            vec = [kind[:1].encode() + np.asarray(x, "<f4" if kind == "float" else "<f8").tobytes() for x in b.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(vec, pa.binary())], names=["grp", "h1", "h2", "least", "w", "vec"])

    packed = classes.mapInArrow(pack, "grp string, h1 long, h2 long, least long, w long, vec binary").sortWithinPartitions("h1", "h2", "grp")
    reps = cut(packed.withColumn("node", F.monotonically_increasing_id()))  # the checkpoint fixes the numbers
    total = reps.count()
    counts = reps.groupBy("grp").agg(F.count("*").alias("n")).withColumn("size", F.col("n"))
    queries = reps.orderBy(F.xxhash64(F.lit("audit"), "h1", "h2"), "h1", "h2", "grp").limit(audit).collect()
    truth = cut(_audit(reps, queries, threshold)) if queries else None
    lists = None
    for attempt in range(ATTEMPTS):
        seeds = _leaves(reps, counts, total, attempt, LEAF, k, threshold)
        lists = cut(_keep(seeds if lists is None else lists.union(seeds), k))
        for _ in range(rounds):
            lists = cut(_keep(lists.union(_round(reps, lists, total, k, REVERSE << attempt)), k))
        near = lists.filter(F.col("s") >= threshold)
        edges = cut(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        roots = components(edges)
        full = near.groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("u")
        root_of = cut(roots.union(roots.select(F.col("root").alias("u"), "root").distinct()))
        crowded = root_of.join(full, "u", "left_semi").groupBy("root").agg(F.count("*").alias("m"))
        crowded = crowded.join(root_of.groupBy("root").agg(F.count("*").alias("n")), "root").drop("m")
        crowds = spread_join(root_of, crowded, ["root"], total).join(reps, F.col("u") == F.col("node")).select("grp", "root", "node", "w", "vec")
        crowds = cut(crowds)
        # what lists dropped can also lie between full components: those that can touch are compared as one
        touch = _merged(crowds.select(F.col("node").alias("u"), "root").filter("u <> root"), _touching(crowds, threshold, total), total)
        whole = crowds.withColumnRenamed("root", "part").join(touch, F.col("node") == F.col("u"), "left")
        compared = _exact(whole.select(F.coalesce("root", "node").alias("root"), "part", "node", "w", "vec"), threshold, total)
        exact, roots = _counts(compared), _joined(roots, compared, total)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        weight = reps.select(F.col("node").alias("v"), "w").join(both.groupBy("v").agg(F.count("*").alias("n")), "v")
        listed = spread_join(both, weight, ["v"], total).groupBy("u").agg(F.sum("w").alias("links")).select(F.col("u").alias("node"), "links")
        links = cut(exact.union(listed.join(exact.select("node"), "node", "left_anti")))
        if truth is None:
            break
        got = _recall(truth, links)
        if report is not None:
            report.append(got)
        if got[0] >= recall:
            break
        k *= 2  # too few of the audit's links: new tables, longer lists, more rounds
    else:  # still too few: all rows of a label are compared
        part = reps.join(roots, F.col("node") == F.col("u"), "left")
        compared = _exact(part.select(F.col("grp").alias("root"), F.coalesce("root", "node").alias("part"), "node", "w", "vec"), threshold, total)
        links, roots = _counts(compared), _joined(roots, compared, total)
    classes = cut(
        reps.select("grp", "h1", "h2", "node", "least", "w").join(links, "node", "left")
        .join(roots.select(F.col("u").alias("node"), "root"), "node", "left")
        .select(
            "grp", "h1", "h2", "least", F.col("w").alias("n"), (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("root", "node").alias("root"),
        )
    )
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    of_class = spread_join(classes, least, ["root"], total, "members").select("grp", "h1", "h2", "n", "n_links", "component_id")
    all_rows = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = spread_join(keyed.drop("embedding"), of_class, ["grp", "h1", "h2"], all_rows, how="left")
    component = F.coalesce("component_id", "vec_id")
    return found.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op9_embeddings(spark, sf_dir: str) -> DataFrame:
    """All embeddings, compared within their labels."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))
