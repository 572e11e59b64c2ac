"""BPE of a word vocabulary with word ends, by prefix-sharing trie traversal.

Encoding a prefix of a word differs from encoding a shorter prefix in one thing only: its last
token. If token t ends the encoding of a prefix, what stands before t is the encoding of the prefix
without t; and of all tokens that end a prefix exactly one goes together with the last token of
what stands before it. So the state of a trie node is its last token, the state of a child follows
from the states above it, and no merge is ever replayed.

The distinct new words of a batch form a trie whose last edge is the symbol with the word's end. In
sorted order they are the trie's leaves, depth first, and a word branches off from the one before
where their common prefix ends: the states on the current path are all that is kept, and those of a
shared prefix are computed once. Encodings stay in a table of bounded size in each worker.

Texts are normalised and split as the vocabulary's file says. Where a text has only characters that
all versions of Unicode treat alike, this is done by one pattern, otherwise by the library's own
normaliser and splitter; merging is always done here.

Defined results: a null text is the empty text, with no ids; the strings of added tokens in a text
become their ids, as in the library; repeated rows are each encoded; null or repeated doc_ids are
kept; a text of any length is one row of one task; an empty table gives an empty table; columns
other than those named are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import read, small_batches, text_or_empty
from .tokens import vocabulary

VOCABULARY = "word_bpe_49k.json"
#: Words, and pairs of tokens, that a worker remembers.
WORDS, PAIRS = 400_000, 400_000
#: Added to the last byte of a word.
_END = 256


class Merges:
    """The tokens of a vocabulary as symbol strings in a prefix automaton, and which pairs of them can be neighbours."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        ids, self.text = model["vocab"], {i: t for t, i in model["vocab"].items()}
        self.text |= {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = byte_letters()
        symbols = {t: chr(b) for b, t in enumerate(letters)} | {t + end: chr(b + _END) for b, t in enumerate(letters)}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}  # a token's rank; single symbols come before all merges
        spelled = {ids[t]: s for t, s in symbols.items() if t in ids}
        self.made.update(dict.fromkeys(spelled, -1))
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.rank[left, right] = rank
            if whole not in self.made:
                self.halves[whole], self.made[whole], spelled[whole] = (left, right), rank, spelled[left] + spelled[right]
        self.raw = {t: t.to_bytes(4, "little") for t in spelled}
        self.known: dict[int, bool] = {}
        # the automaton of all suffixes: by state its edges, where it goes on when there is none, and the tokens that end there, longest first
        self.edges: list[dict[str, int]] = [{}]
        token = [-1]
        for t, s in spelled.items():
            if t in self.halves and not self.apart(*self.halves[t], self.made[t]):
                continue  # its own symbols are merged otherwise: it occurs in no encoding
            state = 0
            for x in s:
                state = self.edges[state].setdefault(x, len(token))
                if state == len(token):
                    token.append(-1)
                    self.edges.append({})
            token[state] = t
        self.shorter, self.ends = [0] * len(token), [()] * len(token)
        queue = [*self.edges[0].values()]
        self.ends[0] = ()
        for state in queue:
            own = ((token[state], len(spelled[token[state]])),) if token[state] >= 0 else ()
            self.ends[state] = own + self.ends[self.shorter[state]]
            for x, to in self.edges[state].items():
                self.shorter[to] = self.follow(self.shorter[state], x)
                queue.append(to)
        self.size = {t: len(s) for t, s in spelled.items()}
        self.paths = [{} for _ in token]  # where symbols lead, as far as was asked

    def follow(self, state: int, x: str) -> int:
        while (to := self.edges[state].get(x)) is None and state:
            state = self.shorter[state]
        return to or 0

    def apart(self, a: int, b: int, until: int = 1 << 60) -> bool:
        """Whether no merge of rank below ``until`` crosses the border of neighbours ``a`` and ``b``.

        At any time the border lies between the piece of ``a`` at its right edge and the piece of ``b`` at its
        left edge. Pieces are formed in order of rank, so undoing the younger of both goes back in time;
        at each step the pair's own merge must come too late, that is after one of them was used up.
        Equal ranks are merged from the left."""
        limit_a, limit_b = until, until
        while True:
            rank = self.rank.get((a, b), 1 << 60)
            if rank < limit_a and rank <= limit_b and rank < until:
                return False
            of_a, of_b = self.made[a], self.made[b]
            if of_a < 0 and of_b < 0:
                return True
            if of_a > of_b:
                limit_a, a = of_a, self.halves[a][1]
            else:
                limit_b, b = of_b, self.halves[b][0]

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each of ``words``, sorted strings of symbols of which the last has the word's end."""
        paths, ends, size, known, raw, out = self.paths, self.ends, self.size, self.known, self.raw, []
        last, states, above = [-1], [0], ""  # by depth, on the path to the word before
        for word in words:
            shared, most = 0, min(len(above), len(word)) - 1
            while shared < most and above[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            state = states[shared]
            for depth in range(shared, len(word)):
                x = word[depth]
                to = paths[state].get(x)
                if to is None:
                    to = paths[state][x] = self.follow(state, x)
                state = to
                for t, n in ends[state]:
                    before = last[depth + 1 - n]
                    if before < 0:
                        break
                    fits = known.get(before << 20 | t)
                    if fits is None:
                        fits = self.apart(before, t)
                        if len(known) < PAIRS:
                            known[before << 20 | t] = fits
                    if fits:
                        break
                last.append(t)
                states.append(state)
            ids, at = [], len(word)
            while at:
                t = last[at]
                ids.append(raw[t])
                at -= size[t]
            out.append(b"".join(ids[::-1]))
            above = word
        return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


class Encoder:
    """Encodes texts, remembering what it has seen: stretches without white space, and words.

    A stretch is named by itself; a word that the library cut, by itself after a space; an
    added token, by itself after two: neither can be a stretch."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.merges, self.words, self.seen = Merges(path), {}, {}
        self.library = Tokenizer.from_file(path)
        self.back = str.maketrans({c: chr(b) for b, c in enumerate(byte_letters())})
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(self.merges.added, key=len, reverse=True)) or "(?!)")
        # fixed values: the vocabulary's own pattern, with its engine's white space
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        #: No marks to compose, no letters whose case depends on their place, nothing assigned of late, no separators that only Python calls white space.
        self.unsettled = regex.compile("[^\x00-\x1b\x20-\u024f\u2010-\u2027\u2030-\u205e\u20ac\u2122]")

    def stretches(self, text: str) -> list[str]:
        if not self.unsettled.search(text):
            return text.lower().split()
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [" " + p.translate(self.back).encode("latin-1").decode("utf-8") for p, _ in pieces]

    def named(self, text: str) -> list[str]:
        if "<" not in text or not (found := [*self.special.finditer(text)]):
            return self.stretches(text)
        row, at = [], 0
        for m in found:
            row += [*self.stretches(text[at : m.start()]), "  " + m[0]]
            at = m.end()
        return row + self.stretches(text[at:])

    def learn(self, names: set[str]) -> None:
        """Ids of stretches that were not seen before; their distinct words that weren't either make one trie."""
        added = {x for x in names if x.startswith("  ")}
        cut = {x: [x[1:]] if x.startswith(" ") else self.pattern.findall(x) for x in names - added}
        plain = set().union(*cut.values())
        new = plain - self.words.keys()
        if len(self.words) + len(new) > WORDS:
            self.words.clear()
            new = plain
        spelled = {(x := w.encode("utf-8").decode("latin-1"))[:-1] + chr(ord(x[-1]) + _END): w for w in new}
        order = sorted(spelled)
        self.words.update(zip(map(spelled.__getitem__, order), self.merges.encode(order), strict=True))
        if len(self.seen) + len(names) > WORDS:
            self.seen.clear()
        self.seen.update((x, b"".join([self.words[w] for w in row])) for x, row in cut.items())
        self.seen.update((x, self.merges.added[x[2:]].to_bytes(4, "little")) for x in added)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        rows = [self.named(x) for x in texts]
        names = set().union(*rows)
        new = names - self.seen.keys()
        if new:
            self.learn(names if len(self.seen) + len(new) > WORDS else new)
        return [b"".join(map(self.seen.__getitem__, row)) for row in rows]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: Code points that are split and looked up at once.
_AT_ONCE = 1 << 21


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_tokens, ids (little-endian unsigned 32-bit)."""
    path = path or vocabulary(VOCABULARY)

    def run(batches):
        import pyarrow as pa

        coder = encoder(path)
        for b in batches:
            texts, ids, at = b.column(1).to_pylist(), [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= _AT_ONCE):
                    size += len(texts[to])
                    to += 1
                ids += coder.encode(texts[at:to])
                at = to
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    small_batches(docs.sparkSession, 500)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of ``ids``: the tokens' strings, word ends included, with a space between
    two, since the vocabulary names no decoder. An id that the vocabulary lacks is left out."""
    path = path or vocabulary(VOCABULARY)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        words = encoder(path).merges.text
        for b in batches:
            rows = b.column(b.schema.get_field_index(ids)).to_pylist()
            texts = [" ".join([words[x] for x in np.frombuffer(r or b"", "<u4").tolist() if x in words]) for r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    small_batches(encoded.sparkSession, 500)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, `{out}` string")


def op11_word_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole text of documents."""
    rows = decode(encode(read(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
