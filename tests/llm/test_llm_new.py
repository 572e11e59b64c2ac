"""Word BPE by a trie, collocations and peak concurrency, against the library and plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import public_tokenizers
import pytest
import test_llm_small
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotemill.llm import collocations, concurrency, wordtrie
from quotemill.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(wordtrie.VOCABULARY))


@pytest.fixture(scope="module")
def coder():
    return wordtrie.Encoder(public_tokenizers.path(wordtrie.VOCABULARY))


def strings(seed):
    rng = random.Random(seed)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(rng.randrange(n)))
    for _ in range(600):
        yield pick("abcdeth n'!.", 40)
        yield pick("aab", 60)
        yield pick(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<", "|", "a", " ", "'S", "\x1c", "12", "Σ", "ΑΣ ", "é", " ", " ", "ﬁ", "İ", "中文"], 20)
        yield "".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0x3400), rng.randrange(0xE000, 0x10FFFF)])) for _ in range(rng.randrange(30)))


@pytest.mark.parametrize("seed", [1, 2])
def test_word_bpe_equals_the_library(library, coder, seed):
    texts = [*strings(seed)]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_tokens_of_the_vocabulary_side_by_side(library, coder):
    rng, known = random.Random(5), [x.removesuffix("</w>") for x in library.get_vocab()]
    texts = ["".join(rng.choice(known) for _ in range(rng.randrange(5))) for _ in range(4000)]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_shared_prefixes_are_followed_once(coder, monkeypatch):
    asked, follow = Counter(), wordtrie.Merges.follow
    monkeypatch.setattr(wordtrie.Merges, "follow", lambda self, state, x: asked.update([(state, x)]) or follow(self, state, x))
    end = lambda w: w[:-1] + chr(ord(w[-1]) + 256)
    words = sorted(end(w) for w in ("xqzxqz", "xqzxqza", "xqzxqzab", "xqzxq", "xqzxqzabc"))
    coder.merges.encode(words)
    assert max(asked.values()) == 1


def test_tables_that_overflow(monkeypatch, library):
    monkeypatch.setattr(wordtrie, "WORDS", 20)
    small = wordtrie.Encoder(public_tokenizers.path(wordtrie.VOCABULARY))
    rng = random.Random(9)
    for _ in range(5):
        texts = [test_llm_small.prose(rng, 60) for _ in range(4)]
        assert [np.frombuffer(x, "<u4").tolist() for x in small.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_bpe_query(spark, tmp_path, library):
    rows = test_llm_small.awkward(3, 40) + [(None, "No id </w> <|endoftext|>", "en", "a", 1, "x"), (7, None, None, None, 1, "x"), (8, "x" * 50_000 + " é" * 20_000, "en", "a", 1, "x")] * 2
    spark.createDataFrame(rows, test_llm_small.DOC).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[(r[0], len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(map(tuple, QUERIES["op11_word_bpe"](spark, str(tmp_path)).collect())) == want
    assert wordtrie.decode(wordtrie.encode(spark.createDataFrame([], test_llm_small.DOC))).count() == 0


def mined(rows, most, least, within, top):
    """All of it with lists."""
    freq, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, most + 1):
                freq[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in freq.items():
        cand, found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}, []
        for p, a in cand.items():
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= within * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("most", "least", "within", "top", "bits"), [(3, 3, 50, 2000, 1 << 26), (5, 2, 80, 7, 1 << 15), (2, 2, 50, 3, 1 << 15)])
def test_collocations_equal_brute_force(spark, most, least, within, top, bits):
    rng = random.Random(most)
    words = ["a", "B", "b", "é", "É", "the", "of", " x", "x\x00y", "和", "z" * 300]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " \t ", ".", ", ", "\r\n", "\x0b", "! ?"]) for _ in range(n))
    rows = [(text(rng.randrange(80)), rng.choice(["en", "de", None, "und"])) for _ in range(120)]
    rows += [(None, "en"), ("", "fr"), ("the of the of the of", "en"), (" \t ", None)] + [("new york city hall. new york city", "en")] * 9
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, n long").repartition(3)
    got = collocations.collocations(docs, most, least, within, top, bits)
    assert sorted(map(tuple, got.collect())) == mined(rows, most, least, within, top)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("one two", "en")], "text string, lang string")).count() == 0


def test_collocations_in_small_lots(spark, monkeypatch):
    """Texts and keys are cut into lots within a task, and products pass 64 bits."""
    monkeypatch.setattr(collocations, "_CHARS", 64)
    monkeypatch.setattr(collocations, "_KEYS", 16)
    rows = [("a b c. b c a! c c c", "en"), ("a b " * 30, "de")] * 8
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), 3, 2, 50, 50, 1 << 15)
    assert sorted(map(tuple, got.collect())) == mined(rows, 3, 2, 50, 50)
    big = spark.createDataFrame([("x", 1, "p", 3_000_000_000, 3_000_000_000, 3_000_000_000)], "lang string, k int, phrase string, a long, l long, r long")
    d = big.select(*[collocations._exactly(c).alias(c) for c in ("a", "l", "r")])
    assert d.select(F.expr("CAST(1000000BD * a * a AS DECIMAL(38,0)) div CAST(l * r AS DECIMAL(38,0))")).first()[0] == 1_000_000


def swept(rows, together):
    """Changes in order of time."""
    change = defaultdict(Counter)
    for key, a, b, w in rows:
        if a is None or b is not None and b <= a:
            continue
        for k in (key, together):
            if k is not None:
                change[k][a, 0] += 1
                change[k][a, 1] += w or 0
                if b is not None:
                    change[k][b, 0] -= 1
                    change[k][b, 1] -= w or 0
    out = []
    for k, c in change.items():
        n = weight = high = 0
        line = []
        for t in sorted({t for t, _ in c}):
            if c[t, 0] or c[t, 1]:
                n, weight = n + c[t, 0], weight + c[t, 1]
                high = n if not line else max(high, n)
                line.append([k, t, None, n, weight, high])
        for x, y in zip(line, line[1:]):  # noqa: B905
            x[2] = y[1]
        out += [(*x, x[4] == max(y[4] for y in line)) for x in line]
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "span"), [(1, 30), (2, 700), (3, 70_000), (4, 20_000_000), (5, 1 << 38)])
def test_sweep_equals_a_running_sum(spark, seed, span):
    rng = random.Random(seed)
    low = rng.choice([0, -5000, 1_700_000_000])
    rows = []
    for _ in range(400):
        a = rng.choice([low + rng.randrange(span), low + rng.randrange(span) // 256 * 256, low, None]) if rng.random() < 0.9 else low + span // 2
        b = rng.choice([None, low + rng.randrange(span), (a or 0) + rng.randrange(300), a, low + span])
        rows.append((rng.choice([1, 1, 1, 2, 3, None]), a, b, rng.choice([None, 0, 5, -7, 10**12])))
    rows += rows[:40] + [(9, low, low + span, 5), (9, low + span, None, 5), (8, low + 1, low + 2, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k int, a long, b long, w long, key string").repartition(3)
    got = concurrency.sweep(df, "k", "a", "b", "w", -2)
    assert sorted(map(tuple, got.collect()), key=str) == swept(rows, -2)


def test_sweep_of_nothing_and_plan(spark, capsys):
    none = spark.createDataFrame([(1, None, 5, 1), (1, 5, 5, 1)], "k int, a long, b long, w long")
    assert concurrency.sweep(none, "k", "a", "b", "w").count() == 0
    # after pieces and moments are dealt by block, nodes and ancestors meet without another shuffle
    places, pieces = spark.createDataFrame([(1, 5)], "key int, u long"), spark.createDataFrame([(1, 0, 8, 1, 1)], "key int, lo long, hi long, n long, w long")
    with concurrency._dealt_once(spark):
        concurrency._open_at(places, pieces, None).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 2 and plan.count("REPARTITION_BY_NUM") == 2 and "ShuffledHashJoin" in plan


def test_open_sales(spark):
    day, at = timedelta(days=1), datetime(2024, 1, 2, 3, 4, 5, 999_999)
    sales = [(1, 10, 1.005, at), (2, 11, None, at), (3, 12, 5.0, datetime(1969, 12, 31, 23, 59, 59, 1)), (4, None, float("nan"), at), (None, 10, 2.0, at), (5, 10, 1.0, None), (6, 99, 1e300, at)]
    sales += [(1, 10, 1.005, at)] * 200  # hot
    lines = [(1, at + 2 * day), (1, at), (1, None), (2, at - 2 * day), (3, None), (None, at), (6, at - day + timedelta(seconds=1))]
    clients = [(10, 7), (10, 7), (11, 3), (12, None), (None, 4)]
    s = spark.createDataFrame(sales, "sale_id long, client_id long, total double, sold_at timestamp_ntz")
    li = spark.createDataFrame(lines, "sale_id long, shipped_at timestamp_ntz")
    c = spark.createDataFrame(clients, "client_id long, nation_id int")
    t = 1_704_164_645
    want = Counter({(7, t, t + 86_400, 100): 201, (7, t, None, 200): 1, (-1, -1, None, 500): 1, (-1, t, None, 0): 1, (-1, t, t + 1, 0): 1})
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert Counter(map(tuple, concurrency.open_sales(s, li, c).collect())) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
