"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with the same set of five-word shingles form a class with one representative row.
Representatives that share a band of MinHash values meet in the band's bucket. There they
are compared on more and more of their sketches (a byte of each MinHash value): with m of k
equal, a uniform prior makes the posterior of the agreement Beta(m+1, k-m+1), and a pair is
dropped as soon as the probability of reaching the threshold falls below a tolerance.
Pairs that stay connect their representatives to crowds, so texts that merely share a band
don't meet again. Within a crowd all pairs are pruned the same way, and what is left is
verified exactly on the shingles; links and groups come from verified pairs alone.

Pairs never leave a task: buckets give the edges of a spanning forest, crowds the number of
links of each text and the edges of a forest. A bucket of more than ``BLOCK`` rows is dealt as
pairs of blocks. A crowd beyond ``GROUP`` is cut by size class (similar sets differ in size by
at most the threshold's ratio) and then at random into blocks; every pair of blocks of
the same or neighbouring classes is a group. ``GROUP`` counts shingles, and ``LEAST`` for each
smaller text, so it bounds texts too.

Bands of ``ROWS`` values: a pair at the threshold meets in a band with probability
1 - (1 - 0.8**5)**25 > 0.9999; crowds bring together many more.

Defined results: a null text is the empty text; texts without a word form one class
(their sets are equal); a text of fewer than five words is one shingle; a very long text is
one set, hashed in pieces; repeated rows are copies of each other, and one row of a group is
kept, also where rows are wholly equal; rows with a null doc_id link with nothing and stay;
rows that repeat a doc_id with another text are documents of their own; ties in doc_id go to
the smaller hash of the text, then to the earlier row; other columns are ignored, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb, log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, parts, read, small_batches, spread_join, stored, text_or_empty
from .components import components
from .embeddings import grouped
from .shingles import finish, shingles

THRESHOLD, TOLERANCE = 0.8, 1e-6
#: MinHash values of a text, of a band, and of a step of the incremental comparison.
HASHES, ROWS, STEP = 125, 5, 25
#: Shingles that a group may hold (a single larger text makes a group of its own size), and what a small text counts.
GROUP, LEAST = 200_000, 200
#: Representatives of a block of a large bucket.
BLOCK = 1024


@lru_cache(maxsize=1)
def _family():
    rng = np.random.default_rng(5)
    mul = rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return mul[:, None], rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]


def minhash(terms: np.ndarray) -> np.ndarray:
    """HASHES 32-bit minima over the shingles' hashes."""
    mul, add = _family()
    low, high = terms.astype(np.uint32), (terms >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(terms), 1024):
        h = low[None, s : s + 1024] * mul + add
        h ^= h >> np.uint32(15)
        h += high[None, s : s + 1024] * mul
        h ^= h >> np.uint32(13)
        out = np.minimum(out, h.min(1))
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    total = np.arange(len(sig) // ROWS, dtype=np.uint64) + np.uint64(1)
    for j in range(ROWS):
        total = finish(total * np.uint64(0x9E3779B97F4A7C15) + sig[j::ROWS].astype(np.uint64))
    return total


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float, hashes: int = HASHES, step: int = STEP) -> tuple[tuple[int, int], ...]:
    """For each number k of compared values, the fewest matches that keep a pair: the
    posterior P(J >= t) = sum over j <= m of C(k+1, j) t^j (1-t)^(k+1-j)."""
    out = []
    for k in range(step, hashes + 1, step):
        total, m = 0.0, -1
        for m in range(k + 1):
            total += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if total >= tolerance:
                break
        out.append((k, m))
    return tuple(out)


def agreement(threshold: float) -> float:
    """How often two bytes of sketches agree at this similarity."""
    return threshold + (1 - threshold) / 256


def surviving(a: np.ndarray, b: np.ndarray, sketches: np.ndarray, steps) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of rows of ``sketches`` that no step drops."""
    had, done = np.zeros(len(a), np.int64), 0
    for k, least in steps:
        if not len(a):
            break
        had = had + (sketches[a, done:k] == sketches[b, done:k]).sum(1)
        stay = had >= least
        a, b, had, done = a[stay], b[stay], had[stay], k
    return a, b


def linked(sigs: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, threshold: float, tolerance: float) -> np.ndarray:
    """Boolean matrix of the pairs whose similarity reaches the threshold, of sets with their
    sketches. ``side``: if given, only pairs of different sides are asked for."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.zeros((n, n), bool)
    pairs = []
    steps = least_matches(agreement(threshold), tolerance)
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        keep = small >= threshold * large - 1e-9
        if side is not None:
            keep &= side[j] != side[i]
        _, j = surviving(np.full(int(keep.sum()), i), j[keep], sigs, steps)
        if len(j):
            pairs.append((np.full(len(j), i), j))
    if not pairs:
        return out
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    if len(a) > 4 * n:
        shared = _overlaps(sets)[a, b]
    else:
        shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)])
    # J >= t as integers: shared * (1 + t) >= t * (|a| + |b|)
    ok = shared * (1 + threshold) >= threshold * (size[a] + size[b]) - 1e-9
    out[a[ok], b[ok]] = out[b[ok], a[ok]] = True
    return out


def _overlaps(sets: list[np.ndarray], wide: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, term, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count[term] > 1
    owner, term = owner[common], term[common]
    _, term = np.unique(term, return_inverse=True)
    order = np.argsort(term, kind="stable")
    owner, term = owner[order], term[order]
    total, n = np.zeros((len(sets), len(sets)), np.float32), int(term[-1]) + 1 if len(term) else 0
    for s in range(0, n, wide):
        lo, hi = np.searchsorted(term, [s, s + wide])
        m = np.zeros((len(sets), min(wide, n - s)), np.float32)
        m[owner[lo:hi], term[lo:hi] - s] = 1
        total += m @ m.T
    return total.astype(np.int64)


def _forest(links: np.ndarray, node: np.ndarray):
    """(node, smallest node it reaches within the group) for nodes that aren't it."""
    order = np.argsort(node)
    label = np.empty(len(node), np.int64)
    label[order] = np.arange(len(node))
    while True:
        best = np.minimum(label, np.where(links, label[None, :], len(node)).min(1))
        best = np.minimum(best, best[order[best]])
        if (best == label).all():
            break
        label = best
    root = node[order[label]]
    far = root != node
    return node[far], root[far]


def keyed(terms: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets of shingles apart."""
    with np.errstate(over="ignore"):
        second = finish(terms ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        return int(terms.sum(dtype=np.uint64).astype(np.int64)), int(second.astype(np.int64))


_SIGNED = "row long, doc_id long, version long, h1 long, h2 long, size long, sketch binary, bands array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, version (hash of the text), class key (h1, h2),
    number of shingles, sketch and band keys."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            key, size, sketch, band = [], [], [], []
            for text in b.column(3).to_pylist():
                terms, _ = shingles(text)
                sig = minhash(terms)
                key.append(keyed(terms))
                size.append(len(terms))
                sketch.append(sig.astype(np.uint8).tobytes())
                band.append(bands(sig).astype(np.int64))
            h = np.array(key, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:3], pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(size, pa.int64()), pa.array(sketch, pa.binary()),
                    pa.array(band, pa.list_(pa.int64())),
                ],
                names=[x.split()[0] for x in _SIGNED.split(", ")],
            )

    small_batches(docs.sparkSession, 500)
    text = text_or_empty()
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    return own.mapInArrow(run, _SIGNED)


def _connected(sketches: np.ndarray, steps) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest over rows of one bucket: each row is compared with those not reached yet."""
    left, queue, a, b = np.arange(1, len(sketches)), [0], [], []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        at = queue.pop(0)
        _, near = surviving(np.full(len(left), at), left, sketches, steps)
        if len(near):
            a.append(np.full(len(near), at))
            b.append(near)
            queue += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _buckets(steps, pair_size: int = 6):
    """Rows (cell, node, sketch) sorted by cell -> edges (u, v) between rows of a cell that may be similar."""

    def edges(cell, node, sketches):
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[starts, len(cell)])
        none = np.zeros(0, np.int64)
        a, b = [none], [none]
        for n in range(2, pair_size + 1):  # all small buckets at once
            own = starts[sizes == n]
            for i, j in combinations(range(n), 2) if len(own) else ():
                a.append(own + i)
                b.append(own + j)
        a, b = surviving(np.concatenate(a), np.concatenate(b), sketches, steps)
        for s, n in zip(starts[sizes > pair_size], sizes[sizes > pair_size], strict=True):
            x, y = _connected(sketches[s : s + n], steps)
            a, b = np.r_[a, x + s], np.r_[b, y + s]
        return node[a], node[b]

    def run(batches):
        import pyarrow as pa

        held = None
        for b in _ended(batches):
            if b is not None:
                got = (
                    np.array(b.column(0).to_pylist(), np.int64), np.array(b.column(1).to_pylist(), np.int64),
                    np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1),
                )
                held = got if held is None else tuple(np.concatenate(x) for x in zip(held, got, strict=True))
                # the last cell may go on in the next batch
                whole = int(np.flatnonzero(held[0] == held[0][-1])[0])
                if not whole:
                    continue
            elif held is None:
                break
            else:
                whole = len(held[0])
            u, v = edges(*(x[:whole] for x in held))
            held = tuple(x[whole:] for x in held) if whole < len(held[0]) else None
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def _ended(batches):
    """The batches that hold rows, then None."""
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def _crowds(reps: DataFrame, total: int, threshold: float, tolerance: float, block: int) -> DataFrame:
    """(u, root): representatives that pairs of plausible similarity connect."""
    rows = stored(reps.select(F.explode("bands").alias("key"), "node"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("nb", F.ceil(F.col("n") / block).cast("int"))
    met = spread_join(rows, shared, ["key"], total * (HASHES // ROWS))
    met = met.withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cell = F.when(F.col("nb") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("b", "o"), F.greatest("b", "o")))
    dealt = met.select(cell.alias("cell"), "node").join(reps.select("node", "sketch"), "node").select("cell", "node", "sketch")
    # the smallest of a cell comes first and so is the hub in all bands: edges repeat and few are left
    dealt = dealt.repartition(parts(reps.sparkSession), "cell").sortWithinPartitions("cell", "node")
    found = dealt.mapInArrow(_buckets(least_matches(agreement(threshold), tolerance)), "u long, v long")
    roots = components(found)
    return roots.union(roots.select(F.col("root").alias("u"), "root").distinct())


def _cells(crowds: DataFrame, threshold: float, group: int) -> DataFrame:
    """(cell, side, ...): each crowd's rows, once for each group that they take part in."""
    count = crowds.count()
    cost = F.greatest("size", F.lit(LEAST))
    total = crowds.groupBy("root").agg(F.sum(cost).alias("total"), F.count("*").alias("n"))
    known = spread_join(crowds, total, ["root"], count)
    small = known.filter(F.col("total") <= group).select(
        F.col("root").cast("string").alias("cell"), F.lit(0).alias("side"), F.lit(False).alias("cross"), "node", "w", "sketch", "terms"
    )
    level = F.floor(F.log(F.greatest("size", F.lit(1))) / F.lit(-log(threshold))).cast("int")
    large = known.filter(F.col("total") > group).withColumn("level", level)
    blocks = large.groupBy("root", "level").agg(F.ceil(F.sum(cost) * 2 / group).cast("int").alias("nb"), F.count("*").alias("n"))
    blocks = cut(blocks)
    above = blocks.select("root", (F.col("level") - 1).alias("level"), F.col("nb").alias("up"))
    below = blocks.select("root", (F.col("level") + 1).alias("level"), F.col("nb").alias("down"))
    around = blocks.join(above, ["root", "level"], "left").join(below, ["root", "level"], "left")
    placed = spread_join(large, around, ["root", "level"], count)
    placed = placed.withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))

    def name(level, low, high):
        return F.concat_ws("|", F.col("root"), level, low, high)

    def each(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    zero = F.lit(0)
    own = F.transform(
        each(F.col("nb")),
        lambda o: F.struct(
            name(F.col("level"), F.least("b", o), F.greatest("b", o)).alias("cell"),
            F.when(F.col("b") > o, F.lit(1)).otherwise(zero).alias("side"), (F.col("b") != o).alias("cross"),
        ),
    )
    up = F.transform(
        each(F.coalesce("up", zero)),
        lambda o: F.struct(name(F.concat(F.col("level"), F.lit("+")), F.col("b"), o).alias("cell"), zero.alias("side"), F.lit(True).alias("cross")),
    )
    down = F.transform(
        each(F.coalesce("down", zero)),
        lambda o: F.struct(
            name(F.concat(F.col("level") - 1, F.lit("+")), o, F.col("b")).alias("cell"), F.lit(1).alias("side"), F.lit(True).alias("cross")
        ),
    )
    dealt = placed.select("node", "w", "sketch", "terms", F.explode(F.concat(own, up, down)).alias("c"))
    return small.unionByName(dealt.select("c.cell", "c.side", "c.cross", "node", "w", "sketch", "terms"))


def _compare(cells: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(node, links, root): a row for each linked node of each group."""

    def run(batches):
        import pyarrow as pa

        def out(node, links, root):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).astype(np.int64)) for x in (node, links, root)], names=["node", "links", "root"]
            )

        held, rows = ([], [], []), 0
        for _, (_, side, cross, node, w, sig, terms) in grouped(batches):
            if len(node) < 2:
                continue
            sigs = np.frombuffer(b"".join(sig), np.uint8).reshape(len(node), -1)
            sets = [np.frombuffer(t, np.uint64) for t in terms]
            near = linked(sigs, sets, np.array(side) if cross[0] else None, threshold, tolerance)
            at = near.any(1)
            if not at.any():
                continue
            ids, near, w = np.array(node)[at], near[np.ix_(at, at)], np.array(w)[at]
            far, root = _forest(near, ids)
            roots = ids.copy()
            roots[np.searchsorted(ids, far)] = root  # a group's rows are in the order of their nodes
            held[0].append(ids)
            held[1].append(near @ w)
            held[2].append(roots)
            rows += len(ids)
            if rows > 20_000:
                yield out(*held)
                held, rows = ([], [], []), 0
        if rows:
            yield out(*held)

    dealt = cells.repartition(parts(cells.sparkSession), "cell").sortWithinPartitions("cell", "node")
    return dealt.mapInArrow(run, "node long, links long, root long")


def _terms(docs: DataFrame, crowds: DataFrame, total: int) -> DataFrame:
    """``crowds`` with the shingles of each representative: root, node, w, size, sketch, terms."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            own = [shingles(t)[0] for t in b.column(7).to_pylist()]
            of_class = zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)
            right = [key == keyed(t) for key, t in zip(of_class, own, strict=True)]
            out = pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([t.tobytes() for t in own], pa.binary())], names=[*b.schema.names[:5], "terms"])
            yield out.filter(pa.array(right, pa.bool_()))

    texts = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("version"), text_or_empty().alias("text"))
    # n: the rows of the class, so at least those of its representative's id and text
    asked = crowds.withColumn("n", F.col("w"))
    full = spread_join(texts, asked, ["doc_id", "version"], total).select("root", "node", "w", "size", "sketch", "h1", "h2", "text")
    found = full.mapInArrow(run, "root long, node long, w long, size long, sketch binary, terms binary")
    return found.dropDuplicates(["node"])  # rows that repeat an id with its text


def similar(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """``docs`` (doc_id, text) -> one row per row of docs: doc_id, version (hash of the text),
    class_id (smallest doc_id with the same shingles), n_links (other documents linked
    directly), group_id (smallest doc_id reachable by links) and kept (true for one row of a group)."""
    small_batches(docs.sparkSession, 500)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(signatures(docs))
    total = signed.count()
    first = F.min(F.struct("doc_id", "version", "row")).alias("first")
    reps = signed.filter("doc_id is not null").groupBy("h1", "h2").agg(
        first, F.count("*").alias("w"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")
    )
    reps = stored(reps.select("h1", "h2", F.col("first.row").alias("node"), "first", "w", "size", "sketch", "bands"))
    crowd = _crowds(reps, total, threshold, tolerance, block)
    candidates = crowd.join(reps, F.col("u") == F.col("node")).select(
        "root", "node", "w", "size", "sketch", "h1", "h2", F.col("first.doc_id").alias("doc_id"), F.col("first.version").alias("version")
    )
    full = stored(_terms(docs, stored(candidates), total))
    found = cut(_compare(_cells(full, threshold, group), threshold, tolerance))
    groups = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = (
        reps.select("h1", "h2", "node", "first", "w").join(links, "node", "left")
        .join(groups.select(F.col("u").alias("node"), "root"), "node", "left")
        .select(
            "h1", "h2", "first", F.col("w").alias("n"), F.col("first.doc_id").alias("class_id"),
            (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"),
        )
    )
    classes = cut(classes)
    of_group = classes.groupBy("root").agg(F.min("first").alias("lead"), F.count("*").alias("members")).filter("members > 1")
    joined = spread_join(classes, of_group, ["root"], total, "members", "left")
    of_class = joined.select("h1", "h2", "n", "class_id", "n_links", F.coalesce("lead", "first").alias("lead"))
    # rows without an id have no key, so no class
    own = signed.select("row", "doc_id", "version", *[F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("h1", "h2")])
    rows = spread_join(own, of_class, ["h1", "h2"], total, how="left")
    return rows.select(
        "doc_id", "version", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("lead.doc_id").alias("group_id"),
        F.coalesce(F.col("row") == F.col("lead.row"), F.lit(True)).alias("kept"),
    )


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All documents, five words, 0.8."""
    return similar(read(spark, sf_dir, "documents")).drop("version")
