"""Document fingerprints by consistent weighted sampling.

The terms of a text are its five-word shingles, weighted by how often they occur.
Each sample draws, for every term, r ~ Gamma(2,1), c ~ Gamma(2,1) and b ~ U(0,1)
from the term's hash, and keeps the term (with its quantised weight t) of the least

    ln a = ln c - r (t - b) - r,   t = floor(ln w / r + b),

so two texts agree in a sample with probability equal to the generalised Jaccard
similarity of their weighted terms. The draws come from pools of 2**16 gamma and
uniform values that a term's hash selects; ties go to the smaller hash.

Defined results: a null text is the empty text; texts without a word share one
fingerprint; a text of fewer than five words is one shingle of them all; capitals and
punctuation don't count; very long texts are taken in stretches; repeated rows are each
fingerprinted; the successor of a row is the next in the order of doc_id (nulls first), then
of a hash of the text, and that of the last row is the first; other columns are ignored,
whatever their names; an empty table gives an empty table. Rows that are equal in doc_id and
text can't be told apart by a range, so they share a task.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import parts, read, small_batches, stored, text_or_empty
from .shingles import shingles

SAMPLES = 96
_POOL, _STRETCH = 1 << 16, 1024


@lru_cache(maxsize=2)
def _draws(samples: int):
    rng = np.random.default_rng(20_240_601)
    r, c, b = rng.gamma(2, 1, _POOL), rng.gamma(2, 1, _POOL), rng.random(_POOL)
    mul = rng.integers(0, 1 << 31, samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, samples, dtype=np.uint32)
    log_c = np.log(c)
    once = (log_c + r * b - r).astype(np.float32)  # of a weight of 1, where t is 0
    return r, log_c, b, mul[:, None], add[:, None], once


def signature(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """``samples`` 16-bit digests of the drawn (term, t); ``terms`` ascending."""
    r, log_c, b, mul, add, once = _draws(samples)
    best, value, level = np.zeros(samples, np.int64), np.full(samples, np.inf, np.float32), np.zeros(samples, np.int64)
    heavy = np.flatnonzero(weights > 1)
    short = (terms >> np.uint64(32)).astype(np.uint32)
    for s in range(0, len(terms), _STRETCH):  # a stretch of a long text at a time
        slot = (short[None, s : s + _STRETCH] * mul + add) >> np.uint32(16)
        log_a, t = np.take(once, slot, mode="clip"), None
        own = heavy[(heavy >= s) & (heavy < s + _STRETCH)] - s
        if len(own):
            at = slot[:, own]
            t = np.floor(np.log(weights[own + s].astype(np.float64))[None, :] / r[at] + b[at])
            log_a[:, own] = log_c[at] - r[at] * (t - b[at]) - r[at]
        low = log_a.argmin(1)
        least = log_a[np.arange(samples), low]
        better = least < value
        value[better], best[better], level[better] = least[better], low[better] + s, 0
        if t is not None:
            where = np.searchsorted(own, low)
            hit = better & (where < len(own)) & (own[where.clip(max=len(own) - 1)] == low)
            level[hit] = t[np.flatnonzero(hit), where[hit]].astype(np.int64)
    mixed = (terms[best] ^ (level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(48)).astype("<u2")


def fingerprint(text: str, samples: int = SAMPLES) -> np.ndarray:
    terms, weights = shingles(text)
    if not len(terms):
        terms, weights = np.zeros(1, np.uint64), np.ones(1, np.int64)
    return signature(terms, weights, samples)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of samples that agree."""
    return float((a == b).mean())


def written(sig: np.ndarray) -> str:
    return base64.b64encode(sig.tobytes()).decode("ascii")


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the start of ``following``."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


_ROW = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, pid int, kind string, text string"
)


def _rows(out: list[tuple]):
    import pyarrow as pa

    cols = list(zip(*out, strict=True))
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int32(), pa.string(), pa.string()]
    names = [x.split()[0] for x in _ROW.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _compared(doc, text: str, sig, following: str, next_sig, pid: int) -> tuple:
    new = edited(text, following)
    new_sig = fingerprint(new)
    digest = hashlib.sha256(new.encode("utf-8")).hexdigest()
    return (doc, len(text), digest, written(sig), written(new_sig), likeness(sig, new_sig), likeness(sig, next_sig), pid, "row", None)


def _walk(batches):
    """A sorted partition: each row against its successor. The first and the last row
    are handed on with their texts, for the seam to the neighbouring partitions."""
    from pyspark import TaskContext

    pid, held = TaskContext.get().partitionId(), None
    for b in batches:
        out = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sig = fingerprint(text)
            if held is None:
                out.append((doc, len(text), None, written(sig), None, None, None, pid, "first", text))
            else:
                out.append(_compared(*held, text, sig, pid))
            held = (doc, text, sig)
        if out:
            yield _rows(out)
    if held is not None:
        doc, text, sig = held
        yield _rows([(doc, len(text), None, written(sig), None, None, None, pid, "last", text)])


def _seam(batches):
    for b in batches:
        cols = [b.column(k).to_pylist() for k in ("doc_id", "text", "fingerprint", "next_text", "next_fingerprint", "pid")]
        out = []
        for doc, text, sig, following, next_sig, pid in zip(*cols, strict=True):
            sig, next_sig = (np.frombuffer(base64.b64decode(x), "<u2") for x in (sig, next_sig))
            out.append(_compared(doc, text, sig, following, next_sig, pid))
        if out:
            yield _rows(out)


def compare_successors(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    One range-sort by doc_id brings successors together; the last row of each partition
    is joined with what it needs of the first row of the next.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        .repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    )
    done = stored(ranged.mapInArrow(_walk, _ROW))
    # which partition follows: ids of partitions meet in one task, their rows don't
    by = Window.orderBy("pid")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = done.filter("kind = 'first'").select("pid", F.coalesce(F.lead("pid").over(by), F.first("pid").over(whole)).alias("next_pid"))
    last = done.filter("kind = 'last'").join(after, "pid")
    need = last.select(F.col("next_pid").alias("pid"), F.floor(F.col("n_chars") / 4).cast("int").alias("need"), F.col("pid").alias("before"))
    start = done.filter("kind = 'first'").select("pid", "text", F.col("fingerprint").alias("next_fingerprint")).join(need, "pid")
    start = start.select(F.col("before").alias("pid"), F.substring(F.col("text"), F.lit(1), F.col("need")).alias("next_text"), "next_fingerprint")
    seam = last.join(start, "pid").mapInArrow(_seam, _ROW)
    return done.filter("kind = 'row'").unionByName(seam).drop("pid", "kind", "text")


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, its edited text and its successor."""
    return compare_successors(read(spark, sf_dir, "documents"))
