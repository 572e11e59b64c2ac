"""Operators of the training-data part against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.llm import embeddings, fingerprints, huffman, jaccard, langid, mixing, passages, sharding, tokens, urls
from quotemill.llm.components import components
from quotemill.llm.shingles import shingles

DOC = "doc_id long, text string, lang string, source string, n_chars long, size string"
VOCAB = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "rt", "st", "ll")]


def prose(rng, n, stop=9):
    words = [rng.choice(VOCAB) for _ in range(n)]
    return " ".join(w + ("." if i % stop == stop - 1 else "") for i, w in enumerate(words))


def awkward(seed=0, n=60):
    """Nulls, empty, one-word, repeated, long and non-Latin texts, with a clashing column."""
    rng = random.Random(seed)
    texts = [None, "", "one", "!!! ...", "   \n\n ", "日本語 テキスト。", "x" * 5000, "a\n\nb  c\t d", prose(rng, 3000), "tail ", "Ünïcödé ça «quoted» text"]
    texts += [prose(rng, rng.randrange(5, 120)) for _ in range(n - len(texts) - 4)]
    texts += [texts[20], texts[20], texts[21] + " extra", texts[22].replace(".", "!")]
    src = ["a", "b", "a", "a", None]
    rows = [(i, t, "en" if i % 3 else None, src[i % 5], None, "clash") for i, t in enumerate(texts)]
    return rows + [rows[30], rows[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# ---------------------------------------------------------------- components


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3), (5, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and (a := find(a)) != (b := find(b)):
            parent[max(a, b)] = min(a, b)
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- 1


PAGES = [
    (1, "http://a.com/en/1", "<link rel='canonical' href='/fr/9'>"),
    (2, "http://a.com/fr/9", ""),
    (3, "http://b.net/x", '<META http-equiv="refresh" content="0; url=http://a.com/en/1">'),
    (4, "http://q.example.com/en/7", '<link href="http://c.org/es/1" rel=canonical>'),
    (5, "http://c.org/es/1", None),
    (6, None, "x"),
    (7, "no scheme", None),
    (8, "HTTP://C.ORG/zz?x", '<link rel="canonical" href="http://c.org/es/1">'),
    (9, "http://z.z/a/b", "<link rel=canonical href=c>"),
    (10, "http://z.z/a/c", None),
    (11, "http://Example.COM", None),
    (12, "http://xexample.com/en/7", None),
    (12, "http://xexample.com/en/7", None),
    (13, "", None),
]


def test_url_verdicts(spark):
    d = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    rows = urls.filter_urls(d).collect()
    assert len(rows) == len(PAGES)
    got = {r.page_id: (r.rule, r.verdict) for r in rows}
    assert got == {
        1: ("com/en/", "block"), 2: (None, "block"), 3: (None, "block"), 4: ("example.com/en/7", "allow"), 5: ("org/es/", "block"),
        6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "allow"),
        12: ("com/en/", "block"), 13: (None, "allow"),
    }
    assert {r.page_id: (r.host, r.path) for r in rows}[11] == ("example.com", "")
    assert urls.filter_urls(d.limit(0)).count() == 0


def test_many_rules_by_join_and_observed_redirects(spark, monkeypatch):
    d = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    r = spark.createDataFrame([("http://b.net/x", "http://new.io/"), ("http://old.io/", "http://b.net/x")], "source string, target string")
    extra = d.union(spark.createDataFrame([(20, "http://old.io/", None)], d.schema))
    literal = sorted(map(str, urls.filter_urls(extra, redirects=r).collect()))
    monkeypatch.setattr(urls, "LITERAL_RULES", 0)
    assert sorted(map(str, urls.filter_urls(extra, redirects=r).select("page_id", "host", "path", "rule", "verdict", "component").collect())) == literal
    assert any("page_id=20" in x and "block" in x for x in literal)


def test_verdicts_of_test_pages_against_brute_force(spark):
    out = urls.op1_url_filter(spark, "/root/testdata/sf0.001")
    src = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in out.collect():
        m = re.search(r"://([^/?#]*)([^?#]*)", src[r.page_id])
        host, path = m[1].lower(), m[2]
        fit = [x for x in urls.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.text), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best.text if best else None)
        assert r.verdict == (best.verdict if best else "allow")


# ---------------------------------------------------------------- 2


def test_fingerprints(docs, none):
    rows = fingerprints.compare_successors(docs).collect()
    assert len(rows) == docs.count()
    order = sorted(docs.collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text or "" for r in order}
    ids = sorted(texts)
    seen = {}
    for r in rows:
        assert r.n_chars == len(texts[r.doc_id])
        assert seen.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        nxt = texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        options = {fingerprints.edited(texts[r.doc_id], x) for x in (nxt, texts[r.doc_id])}  # repeated rows follow each other
        assert r.edited_sha256 in {hashlib.sha256(x.encode()).hexdigest() for x in options}
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert fingerprints.compare_successors(none).count() == 0


def test_single_row_follows_itself(spark):
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    r = fingerprints.compare_successors(one).first()
    assert (r.near_next, r.n_chars) == (1.0, 15)


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(1)
    terms = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    a, b = rng.integers(0, 4, 400), rng.integers(0, 4, 400)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    sig = [fingerprints.signature(terms[w > 0], w[w > 0], 2048) for w in (a, b)]
    assert abs(fingerprints.likeness(*sig) - want) < 0.04
    assert fingerprints.likeness(sig[0], fingerprints.signature(terms[a > 0], a[a > 0], 2048)) == 1


# ---------------------------------------------------------------- 3


@pytest.mark.parametrize(("chunk", "overlap"), [(32_768, 1024), (400, 64), (64, 32)])
def test_bpe_equals_the_library(docs, chunk, overlap):
    enc = tokens.encoding(tokens.vocabulary())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    out = tokens.decode(tokens.encode(docs, chunk=chunk, overlap=overlap)).collect()
    assert len(out) == docs.count()
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded).decode() == texts[r.doc_id]


def test_bpe_of_nothing(none):
    assert tokens.digests(none).count() == 0


def test_boundaries_are_those_of_the_encoder():
    text = "I'll go  to\n\n the 42 zoo's\t x" * 3
    cuts = [*tokens.boundaries(text, 0, len(text)), len(text)]
    enc = tokens.encoding(tokens.vocabulary())
    assert sum((enc.encode_ordinary(text[a:b]) for a, b in zip(cuts, cuts[1:])), []) == enc.encode_ordinary(text)


# ---------------------------------------------------------------- 4


def test_encoder_equals_the_library():
    enc = huffman.encoder(huffman.vocabulary())
    texts = [r[1] or "" for r in awkward(3)] + ["don't you'll I'M", "a <|endoftext|> b", "x y", " lead", "1²3 ½", "\n", "a\r\nb"]
    for t in texts * 2:  # the second time from memory
        assert np.frombuffer(enc(t), enc.kind).tolist() == enc.whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [9, 16])
def test_codes_are_limited_complete_and_best(limit):
    rng = np.random.default_rng(limit)
    counts = {int(i): int(c) for i, c in enumerate((1.3 ** rng.uniform(0, 60, 300)).astype(np.int64) + 1)}
    lengths = huffman.code_lengths(counts, limit)
    assert max(lengths.values()) <= limit
    assert sum(2.0**-x for x in lengths.values()) == 1
    if limit == 16:  # long enough here: equal to the unlimited optimum
        import heapq

        heap, cost = [*counts.values()], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            s = heapq.heappop(heap) + heapq.heappop(heap)
            cost += s
            heapq.heappush(heap, s)
        assert sum(counts[i] * x for i, x in lengths.items()) >= cost
        if max(lengths.values()) < limit:
            assert sum(counts[i] * x for i, x in lengths.items()) == cost
    assert huffman.code_lengths({7: 3}) == {7: 1}
    assert huffman.code_lengths({}) == {}
    with pytest.raises(ValueError, match="don't fit"):
        huffman.code_lengths(dict.fromkeys(range(5), 1), 2)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.05, n), 200).astype(np.int64)
    codec = huffman.Codec(huffman.code_lengths(dict(Counter(ids.tolist()))))
    payload, at = codec.pack(ids)
    assert codec.unpack(payload, at, n).tolist() == ids.tolist()


def test_files_round_trip(spark, docs, none, tmp_path):
    kind = huffman.id_kind(huffman.vocabulary())
    encoded = huffman.encode(docs).cache()
    huffman.write(encoded, str(tmp_path / "ids"), kind, block=500)
    want = sorted((r.doc_id, tuple(np.frombuffer(r.ids, kind).tolist())) for r in encoded.collect())
    back = huffman.read_back(spark, str(tmp_path / "ids")).orderBy("part", "block", "place").collect()
    assert [r.doc_id for r in back] == [d for d, _ in want]
    assert sorted((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in back) == want
    assert len({(r.part, r.block) for r in back}) > 2
    starts = {(r.part, r.block): r.first for r in huffman.block_starts(spark, str(tmp_path / "ids")).collect()}
    total = 0
    for r in back:
        if r.place == 0:
            assert starts[(r.part, r.block)] == total
        total += r.n_tokens
    huffman.write(huffman.encode(none), str(tmp_path / "none"), kind)
    assert huffman.read_back(spark, str(tmp_path / "none")).count() == 0


# ---------------------------------------------------------------- 5


def test_language(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(langid.sample(docs))
    test = docs.filter(langid.held_out(F.col("doc_id")))
    found = langid.identify(test, model)
    right = found.agg(F.avg((F.col("_lang") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the and of"), (None, "der und die das")], "doc_id long, text string")
    got = [(r._lang, r._score) for r in langid.identify(odd, model).collect()]
    assert got[:3] == [("und", 0.0)] * 3
    assert all(0 <= s <= 1 for _, s in got)
    assert langid.identify(none, model).count() == 0
    assert langid.train([]) is None
    assert langid.identify(odd, None).filter("_lang <> 'und'").count() == 0


def test_held_out_and_windows(spark):
    rows = spark.range(50).select("id", langid.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
    x, owner = langid.windows([b"a" * 600, b"", b"b" * 256])
    assert x.shape == (5, langid.WINDOW)
    assert owner.tolist() == [0, 0, 0, 1, 2]


# ---------------------------------------------------------------- 6


def test_sharding(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    topo = sharding.topology(40)
    r = keys.select("doc_id", sharding.assign(F.col("doc_id"), topo).alias("a"), sharding.assign(F.col("doc_id"), sharding.grow(topo)).alias("b")).collect()
    assert all(x.b in (x.a, 40) for x in r)
    sizes = Counter(x.a for x in r)
    assert len(sizes) == 40 and max(sizes.values()) < 1.3 * 500 and min(sizes.values()) > 0.7 * 500
    heavy = [sharding.Shard(s.shard, s.region, s.rack, 3.0 if s.shard == 0 else 1.0) for s in topo]
    moved = keys.select(sharding.assign(F.col("doc_id"), topo).alias("a"), sharding.assign(F.col("doc_id"), heavy).alias("b")).filter("a <> b")
    regions = {s.shard: s.region for s in topo}
    # rows only move into the region whose weight changed, or within it
    assert all(regions[x.b] == regions[0] for x in moved.collect())
    gone = [sharding.Shard(s.shard, s.region, s.rack, 0.0 if s.shard == 5 else 1.0) for s in topo]
    assert keys.select(sharding.assign(F.col("doc_id"), gone).alias("a")).filter("a = 5").count() == 0


def test_slots_are_gapless(spark, docs):
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), sharding.assign(F.col("doc_id"), sharding.topology(3)).alias("shard"))
    out = sharding.with_slots(placed, "shard", ["doc_id", "text"], salts=4).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == docs.count()
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.with_slots(placed.limit(0), "shard", ["doc_id"]).count() == 0


# ---------------------------------------------------------------- 7


def test_substrings(spark):
    rng = random.Random(5)
    passage = prose(rng, 70)
    base = [prose(rng, 80) for _ in range(6)]
    texts = {
        1: base[0], 2: base[1] + " " + passage + " " + base[2], 3: base[3][:60] + " " + passage + " " + base[4],
        4: base[5] + "\n" + passage + "\n" + "Short line.", 5: None, 6: "", 7: "short  LINE\nown words", 8: base[0],
        9: "\n".join(["short repeated line"] * 5), 10: "\n".join(["short repeated line"] * 5) + "\n---", 11: "---\n\n- Own. -",
    }
    df = spark.createDataFrame([(k, v, "c") for k, v in texts.items()] + [(2, texts[2], "c")], "doc_id long, text string, removed string")
    out = by_id(passages.dedup(df))
    assert all(out[i].text == texts[i] for i in (1, 2, 5, 6))
    words = passage.split()
    for d in (3, 4):
        runs = {tuple(out[d].text.split()[i : i + 20]) for i in range(len(out[d].text.split()) - 19)}
        assert not any(tuple(words[i : i + 20]) in runs for i in range(len(words) - 19))
        assert all(texts[d][r.start : r.end] in passage for r in out[d].removed)
    assert out[8].text == "" and out[4].text.endswith("Short line.")
    assert out[7].text == "own words" and [(r.start, r.end) for r in out[7].removed] == [(0, 11)]
    assert out[9].text == "short repeated line\n" and out[10].text == "---" and out[11].text == "\n- Own. -"
    assert passages.dedup(df.limit(0)).count() == 0


def lines_of(text, separator):
    """(start, end, words) of each unit, by plain string handling."""
    out, at = [], 0
    for piece in re.split(f"({separator})", text):
        if not re.fullmatch(separator, piece) and piece.strip():
            start = at + len(piece) - len(piece.lstrip())
            word = " ".join(re.split(r"[ \t\r\n]+", piece.lower().strip(" \t\r\n")))
            out.append((start, start + len(piece.strip()), word.strip(passages._OUTER) or word))
        at += len(piece)
    return out


@pytest.mark.parametrize("separator", [passages.LINE, passages.PARAGRAPH])
def test_removed_lines_equal_brute_force(spark, docs, separator):
    rng = random.Random(1)
    extra = [(800 + i, "\n".join(rng.choice(["A b.", "  a  B ", "c", "...", "d e f", "", "\t", "Ünï «c»", "c\n"]) for _ in range(rng.randrange(12)))) for i in range(40)]
    rows = sorted({(r.doc_id, r.text) for r in docs.collect() if r.text is not None} | set(extra))
    seen, want = set(), {}
    for d, text in rows:
        want[d] = set()
        for start, end, unit in lines_of(text, separator):
            if unit in seen:
                want[d].add((start, end))
            seen.add(unit)
    df = spark.createDataFrame(rows[::-1] + [(None, None)], "doc_id long, text string").repartition(5)
    got = by_id(passages.dedup(df, separator))
    for d, text in rows:
        spans = {(s.start, s.end) for s in got[d].removed}
        whole = {(a, b) for a, b, _ in lines_of(text, separator)}
        assert spans & whole == want[d]
        left = "".join("" if any(a <= i < b for a, b in spans) else c for i, c in enumerate(text))
        assert got[d].text.split() == left.split()  # nothing else but white space goes
        if not spans:
            assert got[d].text == text


def test_repeated_sentences_and_offsets():
    text = "One two. Three four five! Six.\nSeven"
    assert passages.offsets(text, [{"start": 1, "end": -2}, {"start": 1, "end": -1}, {"start": 2, "end": 5}]) == [(2, 5), (9, 25), (31, 36)]
    assert passages.without("Ab. Cd. Ef", [4], [7]) == "Ab. Ef"
    assert passages.without("Ab.\nCd.\nEf", [4], [7]) == "Ab.\nEf"


def invented(rng, n, low=5, high=7):
    """``n`` words, none of them twice, in sentences of ``low`` to ``high``."""
    out = []
    while n > 0:
        k = min(n, rng.randint(low, high))
        out.append(" ".join(f"{rng.choice(VOCAB)}{rng.randrange(10**9)}" for _ in range(k)) + ".")
        n -= k
    return " ".join(out)


def left_over(passage, text, size):
    """Whether ``size`` words in a row of ``passage`` are still in ``text``."""
    words, held = passage.split(), text.split()
    runs = {tuple(held[i : i + size]) for i in range(len(held) - size + 1)}
    return any(tuple(words[i : i + size]) in runs for i in range(len(words) - size + 1))


def test_passages_of_short_sentences_whatever_surrounds_them(spark):
    rng = random.Random(11)
    rows, passage = [], {}
    for i in range(0, 120, 2):
        passage[i + 1] = invented(rng, 51)
        rows += [(d, f"{invented(rng, rng.randrange(3, 40))} {passage[i + 1]} {invented(rng, 20)}") for d in (i, i + 1)]
    out = by_id(passages.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    texts = dict(rows)
    assert all(out[d].text == texts[d] for d in range(0, 120, 2))
    assert not any(left_over(passage[d], out[d].text, 30) for d in passage)
    for d in passage:  # what surrounds the passage stays
        assert set(texts[d].split()) - set(passage[d].split()) <= set(out[d].text.split())


def test_passages_in_short_lines(spark):
    rng = random.Random(12)
    rows, passage = [], {}
    for i in range(0, 60, 2):
        words = invented(rng, 51).split()
        lines = []
        while words:
            k = rng.randint(2, 7)
            lines.append(" ".join(words[:k]))
            words = words[k:]
        passage[i + 1] = "\n".join(lines)
        again = passage[i + 1] if i % 4 else passage[i + 1].replace("\n", " ")  # wrapped differently
        rows += [(i, f"{invented(rng, 15)}\n{again}\n{invented(rng, 20)}"), (i + 1, f"{invented(rng, 4)}\n\n{passage[i + 1]}\nThe end of {i + 1}.")]
    out = by_id(passages.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(out[d].text == t for d, t in rows if d % 2 == 0)
    assert not any(left_over(passage[d], out[d].text, 30) for d in passage)
    assert all(out[d].text.endswith(f"The end of {d}.") for d in passage)


# ---------------------------------------------------------------- 8


def share(sizes, weights, total, most):
    """Targets by the rule's own words: what is above a bound is shared again until none is."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        w = sum(weights[i] for i in open_)
        for i in open_:
            out[i] = left * weights[i] / w
        over = {i for i in open_ if out[i] > most * sizes[i]}
        for i in over:
            out[i] = most * sizes[i]
        if not over:
            break
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100}, {"a": 10, "b": 100, None: 7}, {"a": 0, "b": 0}, {"z": 1, "é": 900, "y": 3, "": 5, "aa": 400}, {None: 5}])
@pytest.mark.parametrize("fraction", [1.0, 2.5, 4.0])
def test_targets(spark, sizes, fraction):
    rows = [(s, n // 2) for s, n in sizes.items()] + [(s, n - n // 2) for s, n in sizes.items()]
    out = {r.source: r for r in mixing.targets(spark.createDataFrame(rows, "source string, size long"), fraction=fraction).collect()}
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = share([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], fraction * sum(sizes.values()), 3)
    assert [out[s].target for s in order] == pytest.approx(want)
    assert [(out[s].source_size, out[s].n) for s in order] == [(sizes[s], 2) for s in order]
    assert mixing.targets(spark.createDataFrame([], "source string, size long")).count() == 0


def queue_by_hand(spark, rows, key, seed=7):
    """The words that the mix takes, by a loop over one sorted list: {key of a row: words of all its copies}."""
    goal = {r.source: r for r in mixing.targets(spark.createDataFrame([(r["source"], r["size"]) for r in rows], "source string, size long")).collect()}
    seen, own = Counter(), []
    for r in rows:
        k = (r["source"], r["size"], *(r[c] for c in key))
        own.append((*k, seen[k]))
        seen[k] += 1
    names = ["source", "size", *key, "copy"]
    kinds = "source string, size long, " + ", ".join(f"{c} long" for c in key) + ", copy long"
    hashes = spark.createDataFrame(own, kinds).withColumn("h", F.xxhash64(F.lit(seed), *names)).collect()
    by_source = defaultdict(list)
    for r in hashes:
        by_source[r.source].append((r.h % 2**64, r))
    low = lambda x: (x is not None, x if x is not None else 0)
    queue = []
    for s, rows_ in by_source.items():
        total, target, n = 0, goal[s].target, goal[s].source_size
        for _, r in sorted(rows_, key=lambda x: x[0]):
            total += r.size
            for turn in range(min(2, int(target // max(n, 1))) + 1):
                finish = (total + turn * n) / target if target > 0 else 0.0
                queue.append(((finish, turn, *(low(r[c]) for c in names)), r))
    taken, run, budget = Counter(), 0, sum(g.target for g in goal.values())
    for _, r in sorted(queue, key=lambda x: x[0]):
        run += r.size
        if run > budget + 0.5:
            break
        taken[tuple(r[c] for c in names[:-1])] += r.size
    return taken


def test_mixture_equals_a_queue_by_hand(spark, docs):
    rng = random.Random(2)
    rows = [{"source": s, "size": rng.randrange(0, 40), "doc_id": rng.choice([None, *range(30)]), "h1": rng.randrange(3)} for s in "aaaaabbc" for _ in range(25)]
    rows += [{"source": None, "size": 9, "doc_id": 4, "h1": 1}] * 40 + [{"source": "b", "size": 0, "doc_id": None, "h1": 0}] * 3
    want = queue_by_hand(spark, rows, ["doc_id", "h1"])
    for seed in (1, 2):  # whatever the order of the rows
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame([(r["source"], r["size"], r["doc_id"], r["h1"]) for r in rows], "source string, size long, doc_id long, h1 long")
        out = mixing.mix(df.repartition(seed + 1), ["doc_id", "h1"]).collect()
        assert len(out) == len(rows) and all(r.taken <= 3 * r.size for r in out)
        got = Counter()
        for r in out:
            got[(r.source, r.size, r.doc_id, r.h1)] += r.taken
        assert +got == +want
    assert mixing.mix(df.limit(0), ["doc_id"]).count() == 0


def test_plans_of_the_mixture_stay_small(spark, monkeypatch):
    """What is used more than once is stored first: large plans fill the driver's memory, however small the data."""
    seen = []
    for name in ("cut", "stored"):
        def record(df, *args, own=getattr(mixing, name)):
            seen.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
            return own(df, *args)
        monkeypatch.setattr(mixing, name, record)
    rows = [("ab"[i % 2], i % 7, i) for i in range(50)]
    assert mixing.mix(spark.createDataFrame(rows, "source string, size long, doc_id long"), ["doc_id"]).count() == 50
    assert max(seen) <= 12, seen


def test_copies(spark):
    from quotemill.llm._common import copies

    df = spark.createDataFrame([("a", 3), ("b", 0), ("c", 70_000), ("d", 65_536), ("e", 65_537)], "k string, n long")
    got = {r.k: r for r in copies(df).groupBy("k").agg(F.count("*").alias("c"), F.max("copy").alias("m"), F.min("copy").alias("l")).collect()}
    assert {k: (r.c, r.l, r.m) for k, r in got.items()} == {"a": (3, 0, 2), "c": (70_000, 0, 69_999), "d": (65_536, 0, 65_535), "e": (65_537, 0, 65_536)}


# ---------------------------------------------------------------- 9


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=32).astype("f4"), int(i % 3)) for i in range(300)]
    crowd = rng.normal(size=32)
    rows += [(400 + i, (crowd + rng.normal(size=32) * 0.05).astype("f4"), 1) for i in range(90)]
    rows += [(600 + i, rows[i][1] + np.float32(0.01), rows[i][2]) for i in range(0, 60, 3)]
    rows += [(700 + i, rows[5][1], rows[5][2]) for i in range(4)] + [(720, rows[5][1], None), (721, np.zeros(32, "f4"), 1)]
    table = [(i, v.tolist(), label) for i, v, label in rows]
    table += [(730, None, 1), (731, [], 1), (732, [float("nan")] * 32, 1), (733, [1.0] * 7, 1), (734, [None, 1.0], 1), (None, rows[5][1].tolist(), 2)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")
    out = {r.vec_id: r for r in embeddings.near_duplicates(df, audit=100).collect()}
    assert len(out) == len(table)
    good = [(i, v.astype("f8"), label) for i, v, label in rows if label is not None and v.any()]
    links = defaultdict(set)
    for a in good:
        for b in good:
            if a[0] < b[0] and a[2] == b[2] and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93:
                links[a[0]].add(b[0])
                links[b[0]].add(a[0])
    found = sum(out[i].n_links for i, *_ in good)
    assert all(out[i].n_links <= len(links[i]) for i, *_ in good)
    assert found >= 0.97 * sum(map(len, links.values()))
    assert all(out[400 + i].component_id == 400 for i in range(90))
    for i in (720, 721, 730, 731, 732, 733, 734):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    assert out[None].n_links == 0
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_with_ids_that_repeat(spark):
    rng = np.random.default_rng(3)
    v0, v1 = rng.normal(size=(2, 16))
    near = lambda v: v + rng.normal(size=16) * 0.01
    rows = [(1, v0), (1, v1), (2, near(v0)), (3, near(v1)), (4, v0), (4, v0), (None, v0)]
    df = spark.createDataFrame([(i, v.astype("f4").tolist(), "a", "c") for i, v in rows], "vec_id long, embedding array<float>, label string, node string")
    out = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect())
    assert out == Counter({(1, 3, 1, True): 1, (1, 1, 1, True): 1, (2, 3, 1, False): 1, (3, 1, 1, False): 1, (4, 3, 1, False): 2, (None, 0, None, True): 1})


def test_embeddings_of_doubles(spark):
    """Pairs on either side of the threshold by less than a float can tell, beyond its range, and very small."""
    pair = lambda cos, scale=1.0: ([scale, 0.0, 0.0], [scale * cos, scale * float(np.sqrt(1 - cos * cos)), 0.0])
    cases = [pair(0.93 + 1e-12), pair(0.93 - 1e-12), pair(0.95, 1e200), pair(0.95, 1e-200), pair(0.9, 1e300)]
    table = [(2 * i + j, v, i) for i, two in enumerate(cases) for j, v in enumerate(two)] + [(90, [float("inf"), 0.0, 0.0], 0), (91, [0.0, -0.0, 0.0], 0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    linked = {0, 2, 3}
    want = {2 * i + j: (1, 2 * i) if i in linked else (0, 2 * i + j) for i in range(len(cases)) for j in (0, 1)}
    assert got == want | {90: (0, 90), 91: (0, 91)}


def test_lonely_pairs_beside_a_crowd(spark):
    """Recall is measured by query: a crowd with all its links doesn't make up for lost pairs."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    twin = x[:400] + rng.normal(size=(400, 64)) * 0.36 / 8
    crowd = x[-1] + rng.normal(size=(300, 64)) * 0.1 / 8
    v = np.concatenate([x, twin, crowd]).astype("f4")
    df = spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(v)], "vec_id long, embedding array<float>, label int")
    report = []
    out = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, report=report).collect()}
    y = v.astype("f8")
    y /= np.linalg.norm(y, axis=1)[:, None]
    want = (y @ y.T >= 0.93).sum(1) - 1
    alone = [i for i in range(4400) if want[i] == 1]
    assert len(alone) > 500
    assert sum(out[i] for i in alone) >= 0.95 * len(alone) and all(out[i] <= want[i] for i in out)
    assert report[-1][0] >= embeddings.RECALL and report[-1][1] > 100


def test_tables_grow_with_a_label():
    n = [embeddings.tables_for(10**e, embeddings.LEAF, 0.93) for e in range(1, 9)]
    assert n[0] == 1 and n == sorted(n) and n[-1] > 30


def twins(seed=6):
    """Six pairs of tight crowds of 30: cosine about .99 inside, .95 across."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(6):
        mid, off = rng.normal(size=(2, 64))
        mid, off = mid / np.linalg.norm(mid), off / np.linalg.norm(off)
        for side in (-1, 1):
            rows += [(mid + side * 0.16 * off + rng.normal(size=64) * 0.012).astype("f4") for _ in range(30)]
    return rows


@pytest.mark.parametrize("recall", [0.0, 2.0])  # no growth at all; the last resort
def test_links_between_full_components(spark, recall):
    rows = twins()
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    out = {r.vec_id: r for r in embeddings.near_duplicates(df, rounds=1, recall=recall).collect()}
    x = np.array(rows, "f8")
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.93
    assert near[:30, 30:60].mean() > 0.5
    assert [out[i].n_links for i in range(len(rows))] == (near.sum(1) - 1).tolist()
    assert [out[i].component_id for i in range(len(rows))] == [i // 60 * 60 for i in range(len(rows))]


# ---------------------------------------------------------------- 10


def copies(seed=9):
    rng = random.Random(seed)
    rows, base = [], [prose(rng, rng.randrange(60, 160)) for _ in range(25)]
    for i, t in enumerate(base):
        rows.append((3 * i, t))
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((3 * i + 1, " ".join(w)))
    crowd = prose(rng, 150).split()
    for i in range(60):
        w = list(crowd)
        w[i * 2] = f"edit{i}"
        rows.append((200 + i, " ".join(w)))
    rows += [(400, base[0]), (401, base[0].upper() + "!"), (402, None), (403, ""), (404, "..."), (405, "two words"), (406, "two words"), (400, base[0])]
    return rows


def jaccard_brute_force(rows):
    """Links and smallest reachable id of each row of (doc_id, text), by all pairs of rows."""
    sets = [frozenset(shingles(t or "")[0].tolist()) for _, t in rows]
    links, parent = Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            y = sets[j]
            if x == y or (x and y and len(x & y) >= 0.8 * len(x | y)):
                links[i] += 1
                links[j] += 1
                parent[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, links[i], least[find(i)]) for i, (d, _) in enumerate(rows)), len(least)


@pytest.mark.parametrize(("group", "block"), [(jaccard.GROUP, jaccard.BLOCK), (3000, 16)])
def test_jaccard_join_equals_brute_force(spark, group, block):
    rows = copies()
    rng = random.Random(3)
    a, b = prose(rng, 60), prose(rng, 60)
    # ids that repeat with another text, and rows that repeat wholly
    rows += [(500, a), (500, b), (501, a), (502, b), (503, a.rsplit(" ", 1)[0] + " other"), (500, a), (500, a), (504, b + " more"), (504, b + " more")]
    want, groups = jaccard_brute_force(rows)
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame([(*r, "c", "c") for r in [*rows, (None, "nobody"), (None, a)]], "doc_id long, text string, kept string, row string")
        out = jaccard.similar(df.repartition(1 + seed), group=group, block=block).collect()
        assert len(out) == len(rows) + 2
        assert Counter((r.doc_id, r.n_links, r.group_id) for r in out if r.doc_id is not None) == want
        kept = [r for r in out if r.kept and r.doc_id is not None]
        assert len(kept) == groups and all(r.doc_id == r.group_id for r in kept)
        assert all((r.n_links, r.group_id, r.kept) == (0, None, True) for r in out if r.doc_id is None)
    assert jaccard.similar(df.limit(0)).count() == 0


def test_forest_of_a_bucket_connects_what_all_pairs_connect():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (4, jaccard.HASHES), dtype=np.uint8)
    rows = np.concatenate([np.where(rng.random((12, jaccard.HASHES)) < 0.05, rng.integers(0, 256, (12, jaccard.HASHES)), b) for b in base]).astype(np.uint8)
    rows = rows[rng.permutation(len(rows))]
    steps = jaccard.least_matches(jaccard.agreement(0.8), 1e-6)
    a, b = map(np.array, zip(*[(i, j) for i in range(len(rows)) for j in range(i)], strict=True))
    x, y = jaccard.surviving(a, b, rows, steps)
    u, v = jaccard._connected(rows, steps)
    assert len(u) == len(rows) - 4

    def roots(p, q):
        r = list(range(len(rows)))
        for _ in range(len(rows)):
            for i, j in zip(p, q, strict=True):
                r[i] = r[j] = min(r[i], r[j])
        return r

    assert roots(x.tolist(), y.tolist()) == roots(u.tolist(), v.tolist())


def test_pruning_keeps_what_can_reach_the_threshold():
    for k, m in jaccard.least_matches(0.8, 1e-6):
        assert 0 < m < 0.8 * k


def test_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = jaccard._overlaps(sets, wide=64)
    assert all(got[i, j] == want[i][j] for i in range(12) for j in range(12) if i != j)


# ---------------------------------------------------------------- very long texts


def test_long_texts_are_taken_in_pieces(monkeypatch):
    from quotemill.llm import shingles as sh

    text = prose(random.Random(8), 4000) + "x" * 3000 + " end"
    whole = sh.word_hashes(text)
    monkeypatch.setattr(sh, "_PIECE", 500)
    assert sh.word_hashes(text).tolist() == whole.tolist()
    model = langid.train([("der und die das nicht", "de"), ("the and of that was", "en")] * 20, epochs=3)
    segments = [s for _, group in langid._segments([text, None, "ab"], size=2 * langid.WINDOW) for s in group]
    joined = b"".join(segments[:-3])
    assert text.encode().startswith(joined) and segments[-2:] == [b"", b"ab"]
    assert len(segments[-3]) >= langid.WINDOW and text.encode().endswith(segments[-3])
    assert langid.predict(model, [text, "the and of"])[0][1] == "en"
