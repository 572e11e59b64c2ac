"""Token ids as canonical, length-limited Huffman blocks.

Writing takes two passes over the encoded documents: ids are counted (partial
counts a task, one row an id), code lengths of at most ``LIMIT`` bits come from
package-merge on those counts, and the documents, range-sorted by id, are packed
into blocks. A block is one row of the file: the documents it holds, their ids
bit-packed, and the bit offset of every ``STEP``-th id. Blocks need nothing from
each other, and within a block all stretches between checkpoints are decoded side
by side through one table that maps any ``LIMIT`` bits to an id and its length.

The file format is a folder of two Parquet tables (any store that Spark writes to):
``codes`` (id, length) and ``blocks`` (part, block, doc_ids, counts, checkpoints,
payload). Files and blocks are in ascending document order.

Defined results: a null text is empty, so only the end id; repeated doc_ids follow
each other; an empty table gives folders without blocks.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import parts, read, scratch, small_batches, stored, text_or_empty

#: Longest code in bits; ids between checkpoints; ids after which a block closes.
LIMIT, STEP, BLOCK = 16, 64, 1 << 17
VOCABULARY, END_ID = "byte_bpe_50k.json", 2
#: Entries of a worker's memory of encoded words: a bound on memory, not on texts.
REMEMBERED = 700_000


# ---------------------------------------------------------------- encoding


def _byte_chars() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes for the
    code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return out


class Encoder:
    """The library's encoding of a whole text, with a memory of space-separated words.

    Every space or newline between two non-space characters begins a pre-token, so
    the words between them can be encoded apart and remembered; the model of the
    library encodes each unseen piece. A text with any other white space, or with
    characters outside Latin-1, goes to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import re

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.simple = not any(c.isalpha() and c.isascii() for c in self.special)
        self.model, self.table = self.whole.model, _byte_chars()
        # two bytes an id halve what is stored and shuffled
        self.kind = "<u2" if max(self.whole.get_vocab_size(True), max(self.whole.get_vocab(True).values()) + 1) <= 1 << 16 else "<u4"
        self.code = {"<u2": "H", "<u4": "I"}[self.kind]  # workers are little-endian, as the format is
        letter = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
        number = "0-9²³¹¼½¾"
        self.pieces = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^\s{letter}{number}]+|\s")
        self.regular = re.compile(r"\n?[\x21-\x7e\xa1-\xff]+")
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        if piece.isascii():  # printable characters stand for themselves
            alphabet = piece.replace(" ", self.table[32]).replace("\n", self.table[10])
        else:
            alphabet = piece.encode("utf-8").decode("latin-1").translate(self.table)
        return array(self.code, [t.id for t in self.model.tokenize(alphabet)]).tobytes()

    def _part(self, piece: str) -> bytes:
        out = self._ids(piece)
        if len(self.parts) < REMEMBERED:
            self.parts[piece] = out
        return out

    def _word(self, word: str) -> bytes | None:
        stem, mark = (word[:-1], word[-1]) if word[-1] in ".,;:!?" else (word, "")
        if self.simple and stem.isascii() and stem.isalpha():  # one piece, and a mark is another
            out = (self.words.get(stem) if mark else None) or self._ids(" " + stem)
            if mark:
                out += self.parts.get(mark) or self._part(mark)
            if len(self.words) < REMEMBERED:
                self.words[word] = out
            return out
        if not self.regular.fullmatch(word) or any(s in word for s in self.special):
            return None
        text = word if word[0] == "\n" else " " + word
        out = b"".join(self.parts.get(p) or self._part(p) for p in self.pieces.findall(text))
        if len(self.words) < REMEMBERED:
            self.words[word] = out
        return out

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned integers of ``kind``."""
        import numpy as np

        words = text.replace("\n", " \n").split(" ") if text else [""]
        head, out = words[0], list(map(self.words.get, words))  # known words at once
        if self.regular.fullmatch(head) and head[0] != "\n" and not any(s in head for s in self.special):
            out[0] = b"".join(self.parts.get(p) or self._part(p) for p in self.pieces.findall(head))
            if all(out):
                return b"".join(out)
            for at in [i for i, ids in enumerate(out) if not ids]:
                w = words[at]
                # a word that came up before in this text is known by now
                out[at] = self.words.get(w) or (self._word(w) if w else None)
                if not out[at]:
                    break
            else:
                return b"".join(out)
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def id_kind(path: str) -> str:
    """Width of an id in memory: 16 bits where the vocabulary allows."""
    return encoder(path).kind


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, ids (little-endian, as ``id_kind`` of the path)."""
    path = path or vocabulary()
    tail = b"" if end_id is None else int(end_id).to_bytes(int(id_kind(path)[-1]), "little")

    def run(batches):
        import pyarrow as pa

        enc = encoder(path)
        for b in batches:
            ids = [enc(t) + tail for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    small_batches(docs.sparkSession, 500)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, ids binary"
    )


# ---------------------------------------------------------------- codes


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge)."""
    import numpy as np

    if not counts:
        return {}
    ids = sorted(counts, key=lambda i: (counts[i], i))
    if len(ids) == 1:
        return {ids[0]: 1}
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids don't fit codes of {limit} bits")
    leaf = np.array([counts[i] for i in ids], dtype=np.int64)
    n = len(leaf)
    # each level: leaves merged with the pairs of the level below, by weight
    weights, is_leaf = [leaf], [np.ones(n, bool)]
    for _ in range(limit - 1):
        w = weights[-1]
        pairs = w[: len(w) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, pairs])
        order = np.argsort(both, kind="stable")
        weights.append(both[order])
        is_leaf.append(order < n)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for level in reversed(range(limit)):
        chosen = int(is_leaf[level][:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    return {i: int(x) for i, x in zip(ids, lengths, strict=True)}


def canonical(lengths: dict[int, int]):
    """Codes in order of (length, id): arrays of ids, codes and lengths."""
    import numpy as np

    ids = np.array(sorted(lengths, key=lambda i: (lengths[i], i)), dtype=np.int64)
    size = np.array([lengths[int(i)] for i in ids], dtype=np.int64)
    top = int(size.max()) if len(size) else 1
    # the next code is one more, shifted to the next length: so aligned at the top they follow each other
    step = np.int64(1) << (top - size)
    codes = (np.cumsum(step) - step) >> (top - size)
    return ids, codes, size


class Codec:
    """Encode and decode one block with a canonical code."""

    def __init__(self, lengths: dict[int, int], limit: int = LIMIT, step: int = STEP):
        import numpy as np

        self.limit, self.step = limit, step
        ids, codes, size = canonical(lengths)
        most = int(ids.max()) + 1 if len(ids) else 1
        self.code, self.size = np.zeros(most, np.int64), np.zeros(most, np.int64)
        self.code[ids], self.size[ids] = codes, size
        reach = np.int64(1) << (limit - size)
        self.to_id, self.to_size = np.zeros(1 << limit, np.int64), np.ones(1 << limit, np.int64)
        filled = np.repeat(ids, reach)
        self.to_id[: len(filled)], self.to_size[: len(filled)] = filled, np.repeat(size, reach)

    def pack(self, ids):
        """ids -> (payload bytes, bit offset of every step-th id)."""
        import numpy as np

        size = self.size[ids]
        at = np.cumsum(size) - size
        bits = int(at[-1] + size[-1]) if len(ids) else 0
        word, room = at >> 5, 64 - (at & 31) - size
        value = self.code[ids] << room.clip(0)  # a code ends within the 64 bits from its word on
        n = (bits >> 5) + 2
        # codes never overlap, so sums are unions; 32-bit halves stay exact in doubles
        high = np.bincount(word, weights=(value >> 32 & 0xFFFFFFFF).astype(np.float64), minlength=n)
        low = np.bincount(word + 1, weights=(value & 0xFFFFFFFF).astype(np.float64), minlength=n)
        words = (high[:n] + low[:n]).astype(np.uint64).astype(">u4")
        return words.tobytes()[: (bits + 7) // 8], at[:: self.step]

    def unpack(self, payload: bytes, checkpoints, count: int):
        """All stretches between checkpoints at once, one id of each a round."""
        import numpy as np

        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.int64)
        window = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]  # 24 bits from each byte on
        at = np.asarray(checkpoints, dtype=np.int64).copy()
        out = np.zeros((len(at), self.step), np.int64)
        for i in range(self.step):
            live = len(at) if i * 1 < count - (len(at) - 1) * self.step else len(at) - 1
            a = at[:live]
            x = window[a >> 3] >> (24 - self.limit - (a & 7)) & ((1 << self.limit) - 1)
            out[:live, i] = self.to_id[x]
            at[:live] += self.to_size[x]
        return out.reshape(-1)[:count]


# ---------------------------------------------------------------- files


def count_ids(encoded: DataFrame, kind: str) -> dict[int, int]:
    """Global counts: at most one row an id of the vocabulary reaches the driver."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for b in batches:
            ids = np.frombuffer(b"".join(b.column(0).to_pylist()), kind)
            part = np.bincount(ids, minlength=len(total))
            part[: len(total)] += total
            total = part
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    part = encoded.select("ids").mapInArrow(run, "id long, n long")
    return {r.id: r.n for r in part.groupBy("id").agg(F.sum("n").alias("n")).collect()}


def write(encoded: DataFrame, path: str, kind: str, limit: int = LIMIT, step: int = STEP, block: int = BLOCK) -> None:
    """Write ``encoded`` (doc_id, ids of ``kind``) to the folder ``path``, ascending doc_id."""
    spark, width = encoded.sparkSession, int(kind[-1])
    lengths = code_lengths(count_ids(encoded, kind), limit)
    spark.createDataFrame(sorted(lengths.items()), "id long, length int").coalesce(1).write.parquet(f"{path}/codes")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        codec, part = Codec(lengths, limit, step), TaskContext.get().partitionId()
        docs, rows, held, no = [], [], 0, 0

        def close():
            ids = np.frombuffer(b"".join(rows), kind).astype(np.int64)
            payload, at = codec.pack(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([docs], pa.list_(pa.int64())),
                    pa.array([[len(x) // width for x in rows]], pa.list_(pa.int64())),
                    pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
                ],
                names=["part", "block", "doc_ids", "counts", "checkpoints", "payload"],
            )

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs.append(doc)
                rows.append(ids)
                held += len(ids) // width
                if held >= block:
                    yield close()
                    docs, rows, held, no = [], [], 0, no + 1
        if docs:
            yield close()

    small_batches(spark, 500)
    schema = "part int, block int, doc_ids array<long>, counts array<long>, checkpoints array<long>, payload binary"
    (
        encoded.select("doc_id", "ids").repartitionByRange(parts(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
        .mapInArrow(run, schema)
        .write.option("compression", "none").parquet(f"{path}/blocks")
    )


def read_back(spark, path: str, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """The documents of a folder: doc_id, part, block, place, n_tokens, ids (32 bits each)."""
    lengths = {r.id: r.length for r in spark.read.parquet(f"{path}/codes").collect()}

    def run(batches):
        import numpy as np
        import pyarrow as pa

        codec = Codec(lengths, limit, step)
        names = ("part", "block", "doc_ids", "counts", "checkpoints", "payload")
        for b in batches:
            for part, block, docs, counts, at, payload in zip(*(b.column(k).to_pylist() for k in names), strict=True):
                ids = codec.unpack(payload, at, sum(counts)).astype("<u4").tobytes()
                ends = np.cumsum(counts)
                rows = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts, strict=True)]
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([block] * n, pa.int32()),
                        pa.array(range(n), pa.int32()), pa.array(counts, pa.int64()), pa.array(rows, pa.binary()),
                    ],
                    names=["doc_id", "part", "block", "place", "n_tokens", "ids"],
                )

    small_batches(spark, 500)
    blocks = spark.read.parquet(f"{path}/blocks")
    return blocks.mapInArrow(run, "doc_id long, part int, block int, place int, n_tokens long, ids binary")


def block_starts(spark, path: str) -> DataFrame:
    """(part, block, first): ids before each block, from the blocks' counts alone."""
    sizes = spark.read.parquet(f"{path}/blocks").select(
        "part", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")
    )
    by_part = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # one row a file
    before = by_part.select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off")
    )
    inside = F.coalesce(
        F.sum("n").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    return sizes.withColumn("in", inside).join(before, "part").select("part", "block", (F.col("in") + F.col("off")).alias("first"))


def op4_huffman(spark, sf_dir: str) -> DataFrame:
    """All documents written as Huffman blocks and read back: place, size, checksum."""
    encoded = stored(encode(read(spark, sf_dir, "documents")))
    path = scratch(spark, "ids")
    write(encoded, path, id_kind(vocabulary()))
    docs = read_back(spark, path).withColumn("crc", F.crc32("ids")).drop("ids")
    within = Window.partitionBy("part", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("in", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(block_starts(spark, path), ["part", "block"]).select(
        "doc_id", (F.col("first") + F.col("in")).cast("long").alias("start"), "n_tokens", F.col("crc").cast("long").alias("ids_crc32")
    )
