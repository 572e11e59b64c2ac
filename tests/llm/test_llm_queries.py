"""The registered queries without SQL, every column of every row, against plain Python."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import test_llm_small
import xxhash
from pyspark.sql import functions as F

from quotemill.llm import fingerprints, huffman, langid, mixing, passages, sharding, tokens
from quotemill.llm.queries import QUERIES


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Awkward documents with a null and a repeated id, a clashing column and some long texts."""
    rng = random.Random(4)
    rows = test_llm_small.awkward(7, 50)
    rows += [(None, "nobody's text here", "en", "a", 1, "x"), (20, "another text of twenty", "fr", None, 1, "x"), (20, None, None, "b", 1, "x")]
    rows += [(900, test_llm_small.prose(rng, 9000) + " " + "7" * 3000 + " end", "en", "b", 1, "x")]
    rows += [(901, "repeated wholly", "de", "c", 1, "x")] * 30
    rows += [(1000 + i, text, lang, "s", 1, "x") for i in range(60) for text, lang in [(f"der die das und nicht {i} ist ein", "de"), (f"the and of that was {i} in a", "en")]]
    rng.shuffle(rows)
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, test_llm_small.DOC).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path, rows


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def spark_hash(data, seed=42):
    return xxhash.xxh64(data, seed=seed).intdigest()


def test_fingerprints(spark, sf):
    path, rows = sf
    got = QUERIES["op2_fingerprints"](spark, path).collect()
    # nulls first, then ids, then the engine's hash of the text
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(spark_hash((r[1] or "").encode()))))
    want, sig = Counter(), {}
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        text, following = r[1] or "", after[1] or ""
        q = len(text) // 4
        new = text[: len(text) - q] + following[:q]
        for t in (text, new, following):
            sig.setdefault(t, fingerprints.fingerprint(t))
        near = [float(np.mean(sig[text] == sig[t])) for t in (new, following)]
        want[(r[0], len(text), hashlib.sha256(new.encode()).hexdigest(), fingerprints.written(sig[text]), fingerprints.written(sig[new]), *near)] += 1
        for t, value in zip((new, following), near, strict=True):
            a, b = (Counter(zip(*[iter_[i:] for i in range(min(5, len(iter_)))])) for iter_ in (plain_words(text), plain_words(t)))
            if min(sum(a.values()), sum(b.values())) > 30:
                exact = sum((a & b).values()) / sum((a | b).values())
                assert abs(value - exact) < 5 * math.sqrt(max(exact * (1 - exact), 0.01) / fingerprints.SAMPLES)
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == want


def plain_words(text):
    return re.findall(r"[^\W_]+", text.lower())


def test_byte_bpe(spark, sf):
    path, rows = sf
    enc = tokens.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    want = Counter()
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        raw = b"".join(enc.decode_single_token_bytes(i) for i in ids)
        want[(r[0], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(raw).hexdigest())] += 1
    got = QUERIES["op3_byte_bpe"](spark, path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


@pytest.mark.parametrize(("chunk", "overlap"), [(60, 16), (64, 32), (300, 32)])
def test_runs_longer_than_an_overlap(spark, chunk, overlap):
    """Digits fall into threes, so chunks can agree with each other and yet not with the text."""
    rng = random.Random(chunk)
    kinds = ["1234567890" * 30, "x" * 400, " " * 130, "word and word ", "\n\n \n" * 9, "7" * 61, "!?" * 50, "日本語" * 40, "don't we'll ", "é" * 90, "\u3000\u00a0" * 20]
    texts = ["a" + "".join(rng.choice(kinds) for _ in range(rng.randrange(1, 12))) for _ in range(40)] + ["b" + "9" * 2000, " " * 999, "1" * 59 + "a" + "2" * 600]
    enc = tokens.encoding(tokens.vocabulary())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in tokens.decode(tokens.encode(df, chunk=chunk, overlap=overlap)).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded).decode() == texts[r.doc_id]


def test_huffman(spark, sf):
    path, rows = sf
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t, *_ in rows}
    got = QUERIES["op4_huffman"](spark, path).collect()
    want = Counter((r[0], len(ids[r[1]]), zlib.crc32(np.array(ids[r[1]], "<u4").tobytes())) for r in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    total, last = 0, None
    for r in sorted(got, key=lambda r: r.start):  # in this order ids ascend and every document starts where its predecessor ends
        assert r.start == total and (last is None or (r.doc_id is not None and r.doc_id >= last))
        total, last = total + r.n_tokens, r.doc_id if r.doc_id is not None else last


def test_langid(spark, sf):
    path, rows = sf
    got = QUERIES["op5_langid"](spark, path).collect()
    docs = spark.read.parquet(f"{path}/documents.parquet")
    picked = langid.sample(docs)
    assert {lang for _, lang in picked} <= {r[2] for r in rows if r[2]}
    taught = [r for r in rows if r[2] and zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 5]
    assert all(any(w in (r[1] or "") and lang == r[2] for r in taught) for w, lang in picked)
    model, want = langid.train(picked), Counter()

    def by_hand(text):
        raw = text.encode()
        starts = list(range(0, max(len(raw) - 255, 1), 256))
        if starts[-1] + 256 < len(raw):
            starts.append(len(raw) - 256)
        logs, sums = np.zeros(len(model.languages)), np.zeros(len(model.languages))
        for s in starts:
            w = [b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in raw[s : s + 256].ljust(256, b"\0")]
            tops = [max(sum(t[j][w[i + j]][f] for j in range(len(t))) for i in range(257 - len(t))) for t in model.tables for f in range(langid.FILTERS)]
            z = np.maximum(np.array(tops) + model.bias, 0) @ model.dense + model.offset
            p = (np.exp(z - z.max()) / np.exp(z - z.max()).sum())[:-1]
            logs, sums = logs + np.log(p), sums + p
        return model.languages[logs.argmax()], sums[logs.argmax()] / len(starts)

    for r in got:
        want[(r.doc_id, r.held_out)] += 1
        assert 0 <= r.score <= 1 and r.lang_pred in {*model.languages, "und"}
    assert want == Counter((r[0], zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 5 == 0) for r in rows)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.lang_pred, round(r.score, 3)))
    for r in rows[:40]:
        if r[1] and len(r[1]) < 800:
            lang, score = by_hand(r[1]) if re.search(r"[^\W\d_]", r[1]) else ("und", 0.0)
            assert any(x[0] == lang and abs(x[1] - score) < 2e-3 for x in by[r[0]])
        elif not r[1]:
            assert ("und", 0.0) in by[r[0]]


def draw(path, key, weight):
    """One child's weighted draw, by the published hash function."""
    h = spark_hash(path.encode())
    if key is not None:
        h = spark_hash(int(key).to_bytes(8, "little", signed=True), h)
    return -math.log(((h >> 11) + 0.5) / 2**53) / weight


def descend(key, topo):
    path, left = "", topo
    for level in ("region", "rack", "shard"):
        weights = Counter()
        for s in left:
            weights[str(getattr(s, level))] += s.weight
        best = min(weights, key=lambda n: draw(f"{path}/{n}", key, weights[n]))
        path, left = f"{path}/{best}", [s for s in left if str(getattr(s, level)) == best]
    return left[0].shard


def test_sharding(spark, sf):
    path, rows = sf
    got = QUERIES["op6_sharding"](spark, path).collect()
    topo = sharding.topology(40)
    one_more = sharding.grow(topo)
    want = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        want[(r[0], len(raw) + 16, zlib.crc32(raw), "key", descend(r[0], topo), descend(r[0], one_more))] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    uneven = [sharding.Shard(i, f"r{i % 3}", f"k{i % 2}", 0.5 + i) for i in range(7)]
    wide = [sharding.Shard(i, "r", f"k{i % 20}", 1.0 + i % 3) for i in range(60)]
    for topology in (uneven, wide):
        keys = spark.range(500).select("id", sharding.assign(F.col("id"), topology).alias("s")).collect()
        assert all(r.s == descend(r.id, topology) for r in keys)


def test_substring_dedup(spark, sf):
    path, rows = sf
    got = QUERIES["op7_substring_dedup"](spark, path).collect()
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1])
    seen = set()
    order = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, signed(spark_hash(r[1].encode()))))
    lost = {}
    for d, text in order:
        lost[(d, text)] = {(a, b) for a, b, u in test_llm_small.lines_of(text, passages.LINE) if u in seen}
        own = [u for *_, u in test_llm_small.lines_of(text, passages.LINE)]
        lost[(d, text)] |= {(a, b) for i, (a, b, u) in enumerate(test_llm_small.lines_of(text, passages.LINE)) if u in own[:i]}
        seen |= set(own)
    assert len(got) == len(rows)
    for r in got:
        spans = {(s.start, s.end) for s in r.removed}
        assert r.n_removed == len(r.removed)
        fits = [t for t in texts[r.doc_id] if t is not None and lost[(r.doc_id, t)] == spans & {(a, b) for a, b, _ in test_llm_small.lines_of(t, passages.LINE)}]
        assert fits or (r.text is None and None in texts[r.doc_id])


def test_mixing(spark, sf):
    path, rows = sf
    got = QUERIES["op8_mixing"](spark, path).collect()
    again = QUERIES["op8_mixing"](spark, path).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == len(rows)
    hashes = spark.createDataFrame(rows, test_llm_small.DOC).select("doc_id", "text", "source", *mixing.identity("text")).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    plain = [{"source": r.source, "size": size(r.text), "doc_id": r.doc_id, "h1": r.h1, "h2": r.h2} for r in hashes]
    taken = test_llm_small.queue_by_hand(spark, plain, ["doc_id", "h1", "h2"])
    want, sizes = Counter(), Counter()
    for (_, n, doc, *_), words in taken.items():
        want[(doc, n)] += words
    for r in plain:
        sizes[r["source"]] += r["size"]
    mine = Counter()
    for r in got:
        mine[(r.doc_id, r.size)] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert +mine == +want
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    goals = dict(zip(order, test_llm_small.share([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], sum(sizes.values()), 3), strict=True))
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((r["doc_id"], r["size"], sizes[r["source"]]) for r in plain)
    assert sorted(r.target for r in got) == pytest.approx(sorted(goals[r["source"]] for r in plain))


def test_huffman_files_are_what_they_say(spark, sf, tmp_path):
    """A block decoded bit by bit from the stored code lengths."""
    path, _ = sf
    kind = huffman.id_kind(huffman.vocabulary())
    encoded = huffman.encode(spark.read.parquet(f"{path}/documents.parquet").filter("doc_id < 30")).cache()
    huffman.write(encoded, str(tmp_path / "f"), kind, block=400)
    lengths = sorted((r.length, r.id) for r in spark.read.parquet(str(tmp_path / "f/codes")).collect())
    code, table, last = 0, {}, lengths[0][0]
    for n, i in lengths:
        code <<= n - last
        table[(n, code)] = i
        code, last = code + 1, n
    want = Counter((r.doc_id, tuple(np.frombuffer(r.ids, kind).tolist())) for r in encoded.collect())
    got = Counter()
    for b in spark.read.parquet(str(tmp_path / "f/blocks")).collect():
        bits = np.unpackbits(np.frombuffer(b.payload, np.uint8)).tolist()
        at, ids = 0, []
        for _ in range(sum(b.counts)):
            n, code = 0, 0
            while (n, code) not in table:
                code, n, at = code << 1 | bits[at], n + 1, at + 1
            ids.append(table[(n, code)])
        for d, c in zip(b.doc_ids, b.counts, strict=True):
            got[(d, tuple(ids[:c]))] += 1
            ids = ids[c:]
    assert got == want
    assert json.dumps(sorted(map(str, got))) == json.dumps(sorted(map(str, want)))
