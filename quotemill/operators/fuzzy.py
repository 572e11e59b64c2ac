"""Exact similarity join of names: all pairs of a block, in chunks of bounded size, many pairs an instruction.

The similarity of two keys is 200 L / (n + m): L is the longest common subsequence of their texts with words in
order, n and m are the lengths. Names made of the same few syllables share their bigrams, and sets of them, so an
inverted index meets on nearly every pair and pays for each with a shuffled row. Here a block of up to a chunk of
texts is one row; the texts of a larger one are dealt into chunks by length, and chunks whose lengths can reach
the threshold are paired by a cartesian product: its tasks read the chunks, which are shuffled once, so nothing that is written
grows with the pairs. A task compares two chunks: pairs whose numbers of letters of a few kinds differ too much are passed over, those that
share too few letters are ruled out by bits of a machine word, the others are compared many at once, a letter at a time.
Texts bring the keys they stand for along, and only pairs of keys at or above the threshold leave a task, which no join
follows. No pair is lost; the work is quadratic in a block, memory and disk are not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workers import importable

#: Texts of a chunk (about), pairs whose bits are compared at once, pairs that bits let through and rows of a batch of results.
CHUNK, BLOCK, PAIRS, ROWS = 16384, 1 << 17, 16384, 8192
#: Groups of texts whose letters by kind are compared with those of all others at once.
AHEAD = 64
#: Words of the letters' masks, and letters of texts side by side, at most: longer texts and larger alphabets are taken fewer at a time.
_MASKS = 1 << 23
#: A letter's occurrences from this one on have no bit.
_REPEATS = 256
#: Kinds of letters, about equally frequent.
_KINDS = 4


class _Slice(NamedTuple):
    """Some texts of a chunk, in order of their numbers of letters by kind: places in the chunk, lengths, letters (numbered
    by ``alphabet`` from 1) with kinds and bits, where in a text a letter is; the distinct numbers by kind, and texts of each."""

    at: np.ndarray
    n: np.ndarray
    alphabet: np.ndarray
    kind: np.ndarray
    bits: np.ndarray
    signature: np.ndarray
    slack: np.ndarray
    masks: np.ndarray
    cells: np.ndarray
    sizes: np.ndarray


def _points(texts: list[str], n: np.ndarray) -> np.ndarray:
    """Code points plus 1, a text a row; 0 is no letter."""
    out = np.zeros((len(texts), n.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    return out


def _repeats(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each text in order, and how many equal ones are before each."""
    codes = np.sort(codes, axis=1)
    place = np.arange(codes.shape[1])
    first = np.ones(codes.shape, bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    return codes, np.minimum(place - np.maximum.accumulate(np.where(first, place, 0), axis=1), _REPEATS)


def _cuts(n: np.ndarray, cost: int) -> Iterator[slice]:
    """Slices of texts in order of length; ``cost`` is the words for 64 letters of a text."""
    start = 0
    while start < len(n):
        size = max(1, int(np.searchsorted(np.arange(1, len(n) - start + 1) * ((n[start:] + 63) >> 6) * cost, _MASKS, "right")))
        yield slice(start, start + size)
        start += size


def _slices(texts: list[str]) -> list[_Slice]:
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(length, kind="stable")
    letters = len(set().union(*texts)) + 1
    return [_slice([texts[i] for i in order[s]], order[s], length[order[s]]) for s in _cuts(length[order], max(letters, 64))]


def _cells(codes: np.ndarray, kind: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of texts by length and numbers of letters by kind (the last: letters without a number), those, and where others begin."""
    kinds = kind[codes]
    counts = np.stack([(kinds == c).sum(axis=1) for c in range(_KINDS)], axis=1)
    counts = np.column_stack([counts, n - counts.sum(axis=1)])
    order = np.lexsort((*counts.T, n))
    counts = counts[order]
    first = np.ones(len(n), bool)
    first[1:] = (counts[1:] != counts[:-1]).any(axis=1)
    return order, counts, np.flatnonzero(first)


def _slice(texts: list[str], at: np.ndarray, n: np.ndarray) -> _Slice:
    points = _points(texts, n)
    alphabet, codes = np.unique(points, return_inverse=True)
    codes = codes.reshape(points.shape)
    if alphabet[0]:  # no text is shorter than another
        alphabet, codes = np.concatenate([[0], alphabet]), codes + 1
    kind, total = np.full(len(alphabet), -1), [0] * _KINDS
    often = np.bincount(codes.ravel(), minlength=len(alphabet))
    for letter in 1 + np.argsort(-often[1:], kind="stable"):
        kind[letter] = total.index(min(total))
        total[kind[letter]] += int(often[letter])
    order, counts, firsts = _cells(codes, kind, n)
    at, n, codes = at[order], n[order], codes[order]
    ordered, k = _repeats(codes)
    # bits for letters counted with repeats, the most frequent ones apart; letter 0 and a repeat too many have none
    often = np.bincount((ordered * (_REPEATS + 1) + k).ravel(), minlength=len(alphabet) * (_REPEATS + 1)).reshape(len(alphabet), -1)
    often[0] = often[:, -1] = 0
    known = np.argsort(-often, axis=None, kind="stable")[: np.count_nonzero(often)]
    bits = np.zeros(often.size, np.uint64)
    bits[known] = np.uint64(1) << (np.arange(len(known)) % 64).astype(np.uint64)
    bits = bits.reshape(often.shape)
    masks = np.zeros(((codes.shape[1] + 63) >> 6, len(alphabet), len(texts)), np.uint64)
    each = np.arange(len(texts))
    for i in range(codes.shape[1]):
        masks[i >> 6, codes[:, i], each] |= np.uint64(1 << (i & 63))
    masks[:, 0] = 0
    signature = np.bitwise_or.reduce(bits[ordered, k], axis=1)
    return _Slice(at, n, alphabet, kind, bits, signature, n - np.bitwise_count(signature), masks, counts[firsts], np.diff(firsts, append=len(texts)))


def _step(row: list[np.ndarray], mask: list[np.ndarray]) -> None:
    """One letter of the other text, a pair a place: bits that turn 0 are letters of the subsequence."""
    carry = None
    for w, bits in enumerate(mask):
        hit = row[w] & bits
        total = row[w] + hit
        over = total < hit
        if carry is not None:  # a sum that overflows goes on in the next word
            total += carry
            over |= total < carry
        carry = over
        row[w] = total | (row[w] - hit)


def _common(own: _Slice, codes: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs; ``codes`` has a letter of all other texts a row."""
    row = [np.full(len(x), 2**64 - 1, np.uint64) for _ in own.masks]
    for code in codes[: m[y].max(initial=0)]:
        at = code[y]
        _step(row, [mask[at, x] for mask in own.masks])
    return 64 * len(row) - sum(np.bitwise_count(r).astype(np.int64) for r in row)


def _least(n: np.ndarray, m: np.ndarray | int, threshold: float) -> np.ndarray:
    """Letters that texts of such lengths have in common at least."""
    return np.ceil(threshold * (n + m) / 200 - 1e-9).astype(np.int64)


def _seen(own: _Slice, m: np.ndarray, signature: np.ndarray, counts: np.ndarray, firsts: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (of own, of the others) that numbers of letters by kind and bits let through."""
    starts = np.cumsum(own.sizes) - own.sizes
    cells, n = own.cells.T.astype(np.int32), own.n[starts]
    most = BLOCK + len(own.n) + 8
    both, seen, enough, length = np.empty(most, np.uint64), np.empty(most, np.uint8), np.empty(most, bool), -1
    for f, (s, e) in enumerate(zip(firsts.tolist(), [*firsts[1:].tolist(), len(m)], strict=True)):
        if f % AHEAD == 0:  # letters that aren't common, by cells of both
            of, to = counts[firsts[f : f + AHEAD]].astype(np.int32), m[firsts[f : f + AHEAD], None]
            near = sum(np.abs(cells[k] - of[:, k, None]) for k in range(len(cells))) <= n + to - 2 * _least(n, to, threshold)
        at = np.flatnonzero(near[f % AHEAD])
        if not len(at):
            continue
        sizes = own.sizes[at]
        x = np.repeat(starts[at] + sizes - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        if m[s] != length:
            length = int(m[s])
            # letters that share a bit may be common without being seen
            least = np.clip(_least(own.n, length, threshold) - own.slack, 0, 64).astype(np.uint8)
        # places up to a multiple of 8 have more bits to share than there are
        wide = -(-len(x) // 8) * 8
        bits, limit = np.zeros(wide, np.uint64), np.full(wide, 255, np.uint8)
        bits[: len(x)], limit[: len(x)] = own.signature[x], least[x]
        rows = max(1, BLOCK // wide)
        for t in range(s, e, rows):
            some = signature[t : min(t + rows, e), None]
            a, b, c = (v[: len(some) * wide].reshape(-1, wide) for v in (both, seen, enough))
            np.bitwise_and(some, bits, out=a)
            np.bitwise_count(a, out=b)
            np.greater_equal(b, limit, out=c)
            eights = c.reshape(-1, 8)  # most are empty, and looked at as one number each
            full = np.flatnonzero(eights.view(np.uint64))
            eight, place = np.nonzero(eights[full])
            j, i = np.divmod(full[eight] * 8 + place, wide)
            yield x[i], t + j


def _compared(own: _Slice, texts: list[str], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the chunk of own, places in texts, scores) of the pairs at or above the threshold."""
    m = np.fromiter(map(len, texts), np.int64, len(texts))
    points = _points(texts, m)
    codes = np.minimum(np.searchsorted(own.alphabet, points), len(own.alphabet) - 1)
    codes[own.alphabet[codes] != points] = 0
    order, counts, firsts = _cells(codes, own.kind, m)
    m, codes = m[order], codes[order]
    ordered, k = _repeats(codes)
    signature, codes = np.bitwise_or.reduce(own.bits[ordered, k], axis=1), np.ascontiguousarray(codes.T)
    lost = m - np.bitwise_count(signature)

    def scored() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y = (np.concatenate(v) for v in zip(*held, strict=True))
        may = np.bitwise_count(own.signature[x] & signature[y]) >= _least(own.n[x], m[y], threshold) - lost[y]
        x, y = x[may], y[may]
        score = 200.0 * _common(own, codes, m, x, y) / (own.n[x] + m[y])
        good = score >= threshold
        return own.at[x[good]], order[y[good]], score[good]

    held, size = [], 0
    for found in _seen(own, m, signature, counts, firsts, threshold):
        held.append(found)
        size += len(found[0])
        if size >= PAIRS:
            yield scored()
            held, size = [], 0
    if size:
        yield scored()


def alike_pairs(own: list[_Slice], ys: list[str], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the texts of ``own``, places in ys, scores) of all pairs at or above the threshold; texts aren't empty."""
    order = sorted(range(len(ys)), key=lambda j: len(ys[j]))
    n = np.array([len(ys[j]) for j in order], np.int64)
    for s in _cuts(n, 64):
        at = np.array(order[s])
        for some in own:
            for i, j, score in _compared(some, [ys[k] for k in at], threshold):
                yield i, at[j], score


def _chunks(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (scope, block, text, keys, side) -> blocks of at most a chunk (scope, block, one, two, both: texts by side), and
    the chunks of larger ones (scope, block, side, id, texts, lo, hi: the range of their lengths)."""
    own, entry = ["scope", "block", "side"], F.struct("text", "keys")
    index = index.withColumn("n", F.coalesce(F.char_length("text"), F.lit(0)))  # never null: no join filters one of two uses
    sizes = index.groupBy(*own, "n").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy(*own).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    sizes = sizes.select(*own, "n", "c", F.sum("c").over(Window.partitionBy("scope", "block")).alias("all"), F.floor(before / CHUNK).alias("band"))
    sizes = sizes.withColumn("parts", F.ceil(F.sum("c").over(Window.partitionBy(*own, "band")) / CHUNK)).drop("c")
    dealt = index.join(sizes, [*own, "n"])
    spark = index.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, entry)))
    small = dealt.filter(F.col("all") <= CHUNK).select(*own, "text", "keys").repartition(tasks, "scope", "block")
    small = small.groupBy("scope", "block").agg(of(1).alias("one"), of(2).alias("two"), of(3).alias("both"))
    large = dealt.filter(F.col("all") > CHUNK).withColumn("part", F.pmod(F.xxhash64("text"), "parts"))
    large = large.groupBy(*own, "band", "part").agg(F.sort_array(F.collect_list(entry)).alias("texts"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    return small, large.select(*own, F.concat_ws(" ", "side", "band", "part").alias("id"), "texts", "lo", "hi")


def _met(index: DataFrame, threshold: float) -> DataFrame:
    """Texts to be compared with each other: (scope, block, id, same, texts, others)."""
    spark = index.sparkSession
    small, large = _chunks(index)
    pair = lambda i, a, b: F.struct(F.lit(i).alias("id"), F.lit(a == b).alias("same"), F.col(a).alias("texts"), F.col(b).alias("others"))
    pairs = F.array(pair("1", "one", "two"), pair("2", "one", "both"), pair("3", "two", "both"), pair("4", "both", "both"))
    within = small.select("scope", "block", F.explode(F.filter(pairs, lambda p: (F.size(p["texts"]) > 0) & (F.size(p["others"]) > 0))).alias("p")).select("scope", "block", "p.*")
    # both ends are shuffled once; a task of the product reads a part of either
    ends = math.ceil(math.sqrt(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)))
    a, b = large.repartition(ends).alias("a"), large.repartition(ends).alias("b")
    # the best that lengths allow: all of the shorter text is common
    fits = lambda a, b: 200.0 * F.least(f"{a}.hi", f"{b}.lo") / (F.least(f"{a}.hi", f"{b}.lo") + F.col(f"{b}.lo")) >= threshold - 1e-9
    meet = (F.col("a.id") <= F.col("b.id")) & (F.col("a.side").bitwiseOR(F.col("b.side")) == 3) & fits("a", "b") & fits("b", "a")
    across = a.hint("shuffle_replicate_nl").join(b, (F.col("a.scope") == F.col("b.scope")) & (F.col("a.block") == F.col("b.block")) & meet)
    across = across.select("a.scope", "a.block", "a.id", (F.col("a.id") == F.col("b.id")).alias("same"), "a.texts", F.col("b.texts").alias("others"))
    return within.unionByName(across)


def _pairs(index: DataFrame, threshold: float) -> DataFrame:
    """``index`` (scope, block, text, keys: key and side) -> (scope, block, key, other, score) of the keys that reach the threshold."""
    importable()
    sides = F.coalesce(F.aggregate("keys", F.lit(0), lambda s, k: s.bitwiseOR(k["side"])), F.lit(0))
    index = index.filter("text <> '' and scope is not null and block is not null").withColumn("side", sides)
    schema = pa.schema([("scope", pa.string()), ("block", pa.string()), ("key", pa.string()), ("other", pa.string()), ("score", pa.float64())])

    def lengths(lists: pa.ListArray) -> np.ndarray:
        return np.diff(lists.offsets.to_numpy())

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                scope, block, id, same = (batch.column(c)[k].as_py() for c in range(4))
                texts, others = (batch.column(c)[k].values for c in (4, 5))
                if (scope, block, id) != last:
                    last, own = (scope, block, id), _slices(texts.field("text").to_pylist())
                keys, rows = (texts.field("keys"), others.field("keys")), []
                for i, j, score in alike_pairs(own, others.field("text").to_pylist(), threshold):
                    if same:  # each pair comes in both orders, and keys of one text are alike
                        once = (i < j) | ((i == j) & (lengths(keys[0])[i] > 1))
                        i, j, score = (v[once] for v in (i, j, score))
                    for s in range(0, len(i), ROWS):
                        xs, ys = (of.take(pa.array(at[s : s + ROWS])).to_pylist() for of, at in zip(keys, (i, j), strict=True))
                        for x, y, z, one in zip(xs, ys, score[s : s + ROWS].tolist(), (same & (i == j))[s : s + ROWS].tolist(), strict=True):
                            for a in x:
                                for b in y:
                                    if a["side"] & 1 and b["side"] & 2 and a["key"] != b["key"]:
                                        rows.append((a["key"], b["key"], z))
                                    if a["side"] & 2 and b["side"] & 1 and not one:
                                        rows.append((b["key"], a["key"], z))
                            if len(rows) >= ROWS:
                                yield _batch(scope, block, rows, schema)
                                rows = []
                if rows:
                    yield _batch(scope, block, rows, schema)

    return _met(index, threshold).mapInArrow(compared, "scope string, block string, key string, other string, score double")


def _batch(scope: str, block: str, rows: list[tuple[str, str, float]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([scope] * len(rows)), pa.array([block] * len(rows)), *(pa.array(c) for c in zip(*rows, strict=True))], schema=schema)


def candidates(texts: DataFrame, threshold: float) -> DataFrame:
    """``texts`` (scope, block, text, side: 1 asked, 2 known, 3 both) -> the pairs (scope, block, text, other, score) of a text
    asked and another known that reach the threshold."""
    index = texts.groupBy("scope", "block", "text").agg(F.bit_or("side").alias("side"))
    index = index.select("scope", "block", "text", F.array(F.struct(F.col("text").alias("key"), "side")).alias("keys"))
    return _pairs(index, threshold).withColumnRenamed("key", "text")


def similar(asked: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """All pairs of comparison keys of one scope and one block whose similarity is at least ``threshold``: (scope, key, other,
    score) from ``asked`` and ``known`` (scope, block, key). Equal keys are no pair; an empty key is like nothing."""
    names = ["scope", "block", "key"]
    if asked is known:
        sides = asked.select(*names, F.lit(3).alias("side"))
    else:
        sides = asked.select(*names, F.lit(1).alias("side")).unionByName(known.select(*names, F.lit(2).alias("side")))
    keys = sides.groupBy(*names).agg(F.bit_or("side").alias("side"))
    ordered = F.array_join(F.array_sort(F.split("key", " ")), " ")
    index = keys.groupBy("scope", "block", ordered.alias("text")).agg(F.sort_array(F.collect_list(F.struct("key", "side"))).alias("keys"))
    return _pairs(index, threshold).select("scope", "key", "other", "score")
