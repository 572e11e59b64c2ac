"""Byte-level BPE encoding and decoding over overlapping chunks.

A text longer than a chunk is cut into overlapping chunks. Each chunk is
pre-tokenised on its own, wherever the cluster has room. The pattern looks only
ahead, so once two parses have a boundary at the same place they agree from there
on: a chunk's parse takes over from its predecessor's at the first boundary that
both have in their overlap. Where none exists (one run longer than the overlap)
the two neighbours are joined and parsed again, until all neighbours agree; other chunks of
the text stay apart. The stitched pieces are encoded separately, and decoding concatenates
the raw bytes of the ids.

Defined results: a null text is the empty text, with no ids; special-token strings
are ordinary text; repeated rows are each encoded; a very long text is cut once, and only
a single run without a boundary is as large in one task as it is; an empty table gives an
empty table; columns of the input other than those named are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import parts, read, small_batches, stored, text_or_empty

#: Code points of a chunk, and of the stretch it shares with the next.
CHUNK, OVERLAP = 32_768, 1_024
RANKS = "byte_bpe_multi_50k.tiktoken"

def vocabulary(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pretokens():
    import public_tokenizers
    import regex

    # the class that the encoder's own engine means by white space
    return regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


#: A cut text's last code points, whose boundaries depend on what follows it.
_UNSURE = 8


def boundaries(text: str, begin: int, end: int) -> list[int]:
    """Starts of the pre-tokens of ``text`` in [begin, end)."""
    out = []
    for m in _pretokens().finditer(text):
        if m.start() >= end:
            break
        if m.start() >= begin:
            out.append(m.start())
    return out


def _map(df: DataFrame, fn, schema: str) -> DataFrame:
    small_batches(df.sparkSession, 500)
    return df.mapInArrow(fn, schema)


def _encoder(path: str, keys: int):
    """Batches of (key columns, text) -> (key columns, n_tokens, ids)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoding(path)
        for b in batches:
            ids = [np.asarray(enc.encode_ordinary(t), dtype="<u4") for t in b.column(keys).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:keys], pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                names=[*b.schema.names[:keys], "n_tokens", "ids"],
            )

    return run


def _cut(chunk: int, overlap: int):
    """Texts (doc_id, row, text) -> overlapping chunks (doc_id, row, no, upto, last, text):
    chunk ``no``, which holds the chunks up to ``upto``."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for doc, row, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                n = -(-len(text) // chunk)
                for s in range(0, n, 16):  # a few chunks at a time
                    nos = range(s, min(n, s + 16))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc] * len(nos), pa.int64()), pa.array([row] * len(nos), pa.int64()), pa.array(nos, pa.int32()),
                            pa.array(nos, pa.int32()), pa.array([x == n - 1 for x in nos], pa.bool_()),
                            pa.array([text[x * chunk : (x + 1) * chunk + overlap] for x in nos], pa.string()),
                        ],
                        names=["doc_id", "row", "no", "upto", "last", "text"],
                    )

    return run


def _parse(chunk: int, overlap: int):
    """Chunks -> chunks with the boundaries in the stretches shared with their neighbours,
    as places in the whole text."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            heads, tails = [], []
            for no, upto, last, text in zip(*(b.column(k).to_pylist() for k in ("no", "upto", "last", "text")), strict=True):
                found = boundaries(text, 0, len(text) + 1 if last else len(text) - _UNSURE)
                shared = (upto + 1 - no) * chunk
                heads.append([no * chunk + x for x in found if x < overlap] if no else [])
                tails.append([] if last else [no * chunk + x for x in found if x >= shared])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, kind), pa.array(tails, kind)], names=[*b.schema.names, "head", "tail"])

    return run


_CHUNK = "doc_id long, row long, no int, upto int, last boolean, text string"


def _stitched(chunks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks that all agree with their neighbours, with ``begin``, where each takes over.

    Neighbours without a boundary in common become one chunk and are parsed again. A chunk
    that was joined before and fails again takes as many followers as it has chunks, so
    there are only as many rounds as a run's length has binary digits.
    """
    order = Window.partitionBy("row").orderBy("no")
    done = None
    while True:
        parsed = stored(_map(chunks, _parse(chunk, overlap), f"{_CHUNK}, head array<long>, tail array<long>"))
        begin = F.when(F.col("no") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
        found = parsed.withColumn("begin", begin)
        apart = stored(found.filter("begin is null").groupBy("row").agg(F.min("no").alias("first")).select("row"))
        good = found.join(apart, "row", "left_anti").select(*[x.split()[0] for x in _CHUNK.split(", ")], "begin")
        done = good if done is None else done.unionByName(good)
        if apart.isEmpty():
            return done
        bad = found.join(apart, "row")
        # how far a chunk reaches that its successor doesn't agree with
        fails = F.lead("begin").over(order).isNull() & ~F.col("last")
        reach = F.when(fails, F.col("upto") + (F.col("upto") - F.col("no") + 1)).otherwise(F.col("upto"))
        before = Window.partitionBy("row").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
        new = bad.withColumn("reach", reach).withColumn("far", F.max("reach").over(before))
        lead = F.when(F.col("far").isNull() | (F.col("far") < F.col("no")), F.col("no"))
        whole = new.withColumn("to", F.last(lead, ignorenulls=True).over(order))
        part = F.struct("no", "upto", "last", "text")
        joined = whole.groupBy("row", F.col("to").alias("no")).agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(part)).alias("p"))
        final = F.element_at("p", -1)
        own = F.transform(
            "p", lambda x: F.when(x["no"] == final["no"], x["text"]).otherwise(F.substring(x["text"], F.lit(1), (x["upto"] + 1 - x["no"]) * chunk))
        )
        chunks = joined.select("doc_id", "row", "no", final["upto"].alias("upto"), final["last"].alias("last"), F.array_join(own, "").alias("text"))


def _joined(pdf):
    """The encoded pieces of one document, in order -> its row."""
    import pandas as pd

    pdf = pdf.sort_values("no")
    return pd.DataFrame({"doc_id": pdf.doc_id.iloc[:1], "n_tokens": [pdf.n_tokens.sum()], "ids": [b"".join(pdf.ids)]})


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_tokens, ids (little-endian unsigned 32-bit)."""
    path = path or vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    size = F.char_length("text")
    short = _map(docs.filter(size <= chunk), _encoder(path, 1), "doc_id long, n_tokens long, ids binary")

    long = docs.filter(size > chunk).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    chunks = _map(long, _cut(chunk, overlap), _CHUNK).repartition(parts(docs.sparkSession), "row", "no")
    stitched = _stitched(chunks, chunk, overlap).withColumn("start", F.col("no") * F.lit(chunk).cast("long"))
    order = Window.partitionBy("row").orderBy("no")
    begin, end = F.col("begin"), F.when(F.col("last"), F.lit(1 << 40)).otherwise(F.lead("begin").over(order))
    stitched = stitched.withColumn("end", end)
    mine = F.substring(F.col("text"), (begin - F.col("start") + 1).cast("int"), F.least(F.col("end") - begin, F.char_length("text").cast("long")).cast("int"))
    ready = stitched.select("doc_id", "row", "no", mine.alias("text"))
    done = _map(ready, _encoder(path, 3), "doc_id long, row long, no int, n_tokens long, ids binary")
    return short.unionByName(done.groupBy("row").applyInPandas(_joined, "doc_id long, n_tokens long, ids binary"))


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the raw bytes of ``ids``: those of each id, concatenated."""
    path = path or vocabulary()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoding(path)
        for b in batches:
            rows = b.column(b.schema.get_field_index(ids)).to_pylist()
            raw = [enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], names=[*b.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return _map(encoded, run, f"{schema}, `{out}` binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the bytes decoded from them."""
    return decode(encode(docs, path), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every whole text of documents."""
    return digests(read(spark, sf_dir, "documents"))
