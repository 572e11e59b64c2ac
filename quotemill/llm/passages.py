"""Substring dedup by hashing lines, and stretches between words chosen by content.

The units are whole lines (or paragraphs, by ``separator``), of any length from one
character on, and below them sentences of at least ``SENTENCE_LEAST`` characters: normalised, digested and
numbered in the JVM. A last level is for passages that begin and end anywhere and whose
lines are wrapped differently: a word begins a piece if the hash of it and its successor is the least among the ``REACH`` words on either side, and two neighbouring
pieces of at least ``LEAST`` words are a unit. So a passage that is pasted anywhere falls into
the same units but for its edges, whatever surrounds it and wherever its lines end.

Lines and sentences are compared in lower case, with single spaces and without outer punctuation
(a line of punctuation alone is compared as it is), pieces by their words in lower case. Digests
are grouped over all documents, the earliest occurrence by (doc_id, place) stays, and the
others are removed, whole lines with their line break. The original offsets of what went are kept;
those of different levels can overlap. What is removed has an earlier copy.

A document that shares a line with an earlier one loses it, however short the line: that is
the method. A document without a unit of an earlier one, or of its own, is returned as it was.

Defined results: a null text stays null; an empty text stays empty; a very long text is taken
in pieces; ties in doc_id go to the smaller hash of the text; rows that repeat a doc_id and
its text are one document, so they keep what it
keeps; rows with a null doc_id rank first; an empty table gives an empty table; extra
columns are carried along, but a column ``removed`` is replaced, and names must not begin with two underscores.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from ._common import cut, read, settled, small_batches, spread_join, stored

#: Words of a unit of the last level at least, and of a piece of words that have no least one.
LEAST, MOST = 8, 40
#: Characters of a sentence that is a unit.
SENTENCE_LEAST = 40
#: Words on either side that decide whether a word begins a piece: pieces are longer than that, and about twice as long.
REACH = 4
#: What ends a unit of the first level: a pattern that Java and Python read alike.
LINE, PARAGRAPH = "\n", r"\n[ \t\r]*\n"
SENTENCE = r"""\n|[.!?…。！？]+["'”’»)\]]*[ \t\r]+"""
#: What stands for the end in a span whose start is the number of a line or a sentence.
_LINE_NO, _SENTENCE_NO = -1, -2
_WORD = re.compile(r"\S+")
#: Characters about a line that don't count.
_OUTER = " \t\r.,;:!?…\"'“”‘’«»()[]-–—*#"


def _placed(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and start, in code points, of each word, and whether it follows white space."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower()[:1] for c in text)
    if not low.isascii():
        low = shingles._MARKS.sub(" ", low)
    raw = np.frombuffer(low.encode("utf-8", "replace"), np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = shingles._IS_WORD[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = shingles._powers(max(1, len(raw)))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(shingles._VALUE[raw] * up[: len(raw)], out=total[1:])
    hashes = shingles.finish((total[ends] - total[starts]) * down[starts])
    free = (starts == 0) | (raw[starts - 1] <= 32)
    if len(raw) != len(text):
        starts = np.cumsum((raw & 0xC0) != 0x80)[starts] - 1
    return hashes, starts, free


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_placed`` of a text of any length, in pieces that end before a space."""
    parts, at = [], 0
    while at < len(text) or not parts:
        end = text.find(" ", at + shingles._PIECE)
        end = len(text) if end < 0 else end
        h, starts, free = _placed(text[at:end])
        parts.append((h, starts + at, free))
        at = end
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def anchored(text: str) -> list[tuple[int, int, bytes]]:
    """(start, end, hashes of the words) of each two neighbouring pieces of ``text``."""
    h, starts, free = words(text)
    n = len(h)
    if n < LEAST:
        return []
    most = np.uint64(2**64 - 1)
    key = np.full(n + 2 * REACH, most)
    own = key[REACH : n + REACH]
    own[:] = h
    own[:-1] += h[1:] * shingles._MIX[1]
    own[:] = np.where(free, shingles.finish(own), most)
    left, right = key[REACH - 1 : n + REACH - 1].copy(), key[REACH + 1 : n + REACH + 1].copy()
    for i in range(2, REACH + 1):
        np.minimum(left, key[REACH - i : n + REACH - i], out=left)
        np.minimum(right, key[REACH + i : n + REACH + i], out=right)
    bounds = [0]
    for at in [*np.flatnonzero((own < left) & (own <= right)).tolist(), n]:
        while at - bounds[-1] > 2 * MOST:  # words that repeat at a short distance have no least one
            bounds.append(bounds[-1] + MOST)
        if at > bounds[-1]:
            bounds.append(at)
    if len(bounds) == 2:
        bounds.append(n)
    data, place, out = h.tobytes(), starts.tolist(), []
    place.append(len(text))
    for a, b in zip(bounds, bounds[2:]):
        if b - a >= LEAST:
            # what follows the last word without a space belongs to it
            tail = _WORD.match(text, place[b - 1])
            out.append((place[a], min(tail.end(), place[b]) if tail else place[b], data[8 * a : 8 * b]))
    return out


def without(text: str, starts, ends) -> str:
    """``text`` without the spans; the space after a span goes too, and the line break
    if the span was the whole line."""
    whole: list[list[int]] = []
    for start, end in sorted(zip(starts, ends, strict=True)):
        if whole and start <= whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], end)
        else:
            whole.append([start, end])
    kept, at, before = [], 0, "\n"
    for start, end in whole:
        if start > at:
            kept.append(text[at:start])
            before = text[start - 1]
        while end < len(text) and text[end] in " \t\r":
            end += 1
        if before == "\n" and end < len(text) and text[end] == "\n":
            end += 1
        at = max(at, end)
    kept.append(text[at:])
    return "".join(kept)


def line_digests(docs: DataFrame, separator: str = LINE, level: int = _LINE_NO, least: int = 1) -> DataFrame:
    """(h, check, doc_id, version, start, end) of every unit between separators that has
    ``least`` characters; start is its number, end the level; h and check are 96 bits of its
    digest. Case and spaces are settled once a text, and a unit is an attribute before it is used."""
    low = F.lower("text")
    spaced = low.contains("  ") | low.contains("\t") | low.contains("\r")
    low = F.when(spaced, F.regexp_replace(low, r"[ \t\r]+", " ")).otherwise(low)
    own = docs.select("doc_id", "version", F.posexplode(F.split(low, separator, -1)).alias("start", "line"))
    single = F.trim("line") if separator in (LINE, SENTENCE) else F.trim(F.regexp_replace("line", r"[ \n]+", " "))
    own = own.filter(F.char_length(single) >= least)
    inner = F.btrim(single, F.lit(_OUTER))
    unit = F.when(inner == "", single).otherwise(inner)
    digest = F.xxhash64(F.lit(level), unit).alias("h"), F.hash(F.lit(level), unit).alias("check")
    return own.select(*digest, "doc_id", "version", "start", F.lit(level).alias("end"))


def piece_digests(docs: DataFrame) -> DataFrame:
    """(h, check, doc_id, version, start, end) of every unit of the second level, in code points."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            digest, doc, version, starts, ends = [], [], [], [], []
            for d, v, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for start, end, unit in anchored(text):
                    digest.append(xxhash.xxh3_128_digest(unit))
                    doc.append(d)
                    version.append(v)
                    starts.append(start)
                    ends.append(end)
            h = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h[:, 0]), pa.array(h[:, 1].astype(np.int32)), pa.array(doc, pa.int64()), pa.array(version, pa.int64()),
                    pa.array(starts, pa.int32()), pa.array(ends, pa.int32()),
                ],
                names=["h", "check", "doc_id", "version", "start", "end"],
            )

    small_batches(docs.sparkSession, 500)
    return docs.mapInArrow(run, "h long, check int, doc_id long, version long, start int, end int")


def repeats(docs: DataFrame, separator: str = LINE) -> DataFrame:
    """(doc_id, version, spans): what of each document an earlier place holds, as (number, level) or (start, end)."""
    key = ["h", "check"]
    own = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    named = line_digests(own, separator).unionByName(line_digests(own, SENTENCE, _SENTENCE_NO, SENTENCE_LEAST))
    found = stored(named.unionByName(piece_digests(own)))
    # only counts of all units are dealt out; places only of those that repeat
    often = cut(found.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1"))
    again = stored(spread_join(found, often, key, found.count()))
    place = F.struct(F.col("doc_id"), F.col("version"), F.col("start"))
    first = cut(again.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("n")))
    later = spread_join(again, first, key, again.count()).filter(place > F.col("first"))
    # a document that is there twice names each span twice
    return later.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def offsets(text: str, spans, separator: str = LINE) -> list[tuple[int, int]]:
    """Spans of ``repeats`` as (start, end) in code points, in order."""
    out = [(s["start"], s["end"]) for s in spans if s["end"] >= 0]
    for level, between in ((_LINE_NO, separator), (_SENTENCE_NO, SENTENCE)):
        numbers, at = {s["start"] for s in spans if s["end"] == level}, 0
        for i, m in enumerate([*re.finditer(between, text), None] if numbers else []):
            if i in numbers:  # what ends a sentence belongs to it
                unit = text[at : m.end() if m else len(text)]
                out.append((at + len(unit) - len(unit.lstrip()), at + len(unit.rstrip())))
            at = m.end() if m else len(text)
    return sorted(set(out))


def dedup(docs: DataFrame, separator: str = LINE) -> DataFrame:
    """``docs`` with its repeated units removed from ``text``, and ``removed``, the
    array of (start, end) of what went, as offsets into the original text."""

    @F.pandas_udf("text string, removed array<struct<start:int,end:int>>")
    def cut_out(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        texts, removed = [], []
        for t, s in zip(text, spans, strict=True):
            own = [] if t is None or s is None else offsets(t, s, separator)
            texts.append(without(t, *zip(*own, strict=True)) if own else t)
            removed.append([{"start": a, "end": b} for a, b in own])
        return pd.DataFrame({"text": pd.Series(texts, dtype=object), "removed": pd.Series(removed, dtype=object)})

    small_batches(docs.sparkSession, 500)
    # written first, so that adaptive execution can split a join in which many rows are one document
    spans = settled(docs.sparkSession, lambda: repeats(docs, separator))
    spans = spans.select(F.col("doc_id").alias("__d"), F.col("version").alias("__v"), F.col("spans").alias("__spans"))
    joined = docs.join(
        spans, docs["doc_id"].cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(docs["text"]) == F.col("__v")), "left"
    )
    hit = F.col("__spans").isNotNull()
    joined = joined.withColumn("__cut", cut_out(F.when(hit, docs["text"]), F.col("__spans")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    columns = [F.when(hit, F.col("__cut.text")).otherwise(docs[c]).alias(c) if c == "text" else docs[c] for c in docs.columns if c != "removed"]
    return joined.select(*columns, F.when(hit, F.col("__cut.removed")).otherwise(none).alias("removed"))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the lines and pieces that an earlier document holds."""
    return dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "text", "removed", F.size("removed").alias("n_removed")
    )
