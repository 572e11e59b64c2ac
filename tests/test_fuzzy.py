"""The similarity join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quotemill.functions import text as T
from quotemill.operators import fuzzy


def words(rng):
    syllables = ["an", "ber", "ko", "ly", "a", "b", "é", "ström", "x", "aa", "ab", "ba", "1"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 4)))


def changed(rng, key):
    """A letter left out, put in or another, once to four times."""
    for _ in range(rng.randrange(1, 5)):
        i = rng.randrange(len(key) + 1)
        key = key[:i] + rng.choice(["", "a", "q", " "]) + key[i + rng.randrange(2) :]
    return " ".join(key.split())


@pytest.mark.parametrize(("seed", "threshold"), [(1, 75.0), (2, 80.0), (3, 92.5), (4, 60.0)])
def test_equals_all_pairs(spark, seed, threshold):
    rng = random.Random(seed)
    keys = [words(rng) for _ in range(90)]
    keys += [changed(rng, k) for k in keys] + ["", "a", "b", "aa", "ab a", "a ab", "a" * 300, "a" * 299 + "b"]
    rows = [(rng.choice("st") if i % 3 else "s", rng.choice(["", "u21"]) if i % 5 else "", k) for i, k in enumerate(keys)]
    asked, known = sorted(set(rows[::2])), sorted(set(rows))
    make = lambda x: spark.createDataFrame(x, "scope string, block string, key string")
    got = {(r.scope, r.key, r.other): r.score for r in fuzzy.similar(make(asked), make(known), threshold).collect()}
    want = {
        (s, k, o): T.token_sort_ratio(k, o) for s, b, k in asked for s2, b2, o in known
        if (s, b) == (s2, b2) and k != o and k and o and T.token_sort_ratio(k, o) >= threshold
    }
    assert got == want and len(want) > 5


def test_few_pairs_are_compared(spark):
    """Names of a thousand people: what is compared is a small part of all pairs."""
    rng = random.Random(5)
    syllables = [a + b for a in "bcdfghklmnprstvz" for b in "aeiou"]
    names = sorted({" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5))) for _ in range(2)) for _ in range(1000)})
    both = spark.createDataFrame([("s", "", n, 3) for n in names], "scope string, block string, text string, side int")
    assert fuzzy.candidates(both, 85.0).count() < 0.01 * len(names) ** 2


def test_bounds_hold_for_random_pairs():
    """Bigrams and letters that pairs share are at least what their similarity implies."""
    rng, grams = random.Random(6), lambda t: [t[i : i + 2] for i in range(len(t) - 1)]
    for _ in range(20_000):
        a = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 14)))
        b = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 14))) if rng.random() < 0.3 else changed(rng, a) or "a"
        length = T.common_subsequence(a, b)
        shared = lambda x, y: sum(min(x.count(g), y.count(g)) for g in set(x))
        assert shared(grams(a), grams(b)) >= 3 * length - len(a) - len(b) - 1
        assert shared([*a], [*b]) >= length


def test_nothing_is_like_nothing(spark):
    none = spark.createDataFrame([], "scope string, block string, key string")
    assert fuzzy.similar(none, none, 80.0).count() == 0
    assert fuzzy.similar(none.union(spark.range(1).select(F.lit("s"), F.lit(""), F.lit(""))), none, 80.0).count() == 0


def test_pairs_of_common_syllables_meet_at_the_threshold_only(spark):
    """Names of the same few syllables share most bigrams: what leaves a task are the pairs that are alike, whatever the length."""
    rng = random.Random(8)
    names = sorted({" ".join("".join(rng.choice(["an", "el", "ma", "jo"]) for _ in range(3)) for _ in range(2)) for _ in range(150)} | {"an" * 40, "an" * 39 + "el"})
    both = spark.createDataFrame([("s", "", n, 3) for n in names], "scope string, block string, text string, side int")
    got = [(r.text, r.other) for r in fuzzy.candidates(both, 85.0).collect()]
    alike = lambda a, b: 200 * T.common_subsequence(a, b) / (len(a) + len(b)) >= 85
    assert sorted(got) == [(a, b) for a in names for b in names if a != b and alike(a, b)]


def test_chunks_lose_no_pair(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(fuzzy, "CHUNK", 7)
    keys = sorted({changed(rng, "anders berström") for _ in range(60)})
    rows = spark.createDataFrame([("s", "", k) for k in keys], "scope string, block string, key string")
    got = {(r.key, r.other) for r in fuzzy.similar(rows, rows, 85.0).collect()}
    assert got == {(a, b) for a in keys for b in keys if a != b and T.token_sort_ratio(a, b) >= 85}


def shuffled(spark, run):
    """Bytes that the stages of ``run`` write for others to read."""
    sc = spark.sparkContext
    new, none = sc._jvm.java.util.ArrayList, sc._gateway.new_array(sc._jvm.double, 0)

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(new(), False, False, none, new())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    run()
    return sum(v for k, v in written().items() if k not in before)


def test_what_is_shuffled_grows_as_the_names_not_as_their_pairs(spark, monkeypatch):
    """Eight times the names in chunks of the same size: 64 times the pairs of chunks, eight times the bytes."""
    monkeypatch.setattr(fuzzy, "CHUNK", 16)
    rng = random.Random(10)
    names = sorted({" ".join("".join(rng.choice(["an", "el", "ma", "jo", "ri", "to"]) for _ in range(3)) for _ in range(2)) for _ in range(1100)})
    rows = lambda n: spark.createDataFrame([("s", "", k) for k in names[:n]], "scope string, block string, key string")
    small, large = (shuffled(spark, lambda n=n: fuzzy.similar(rows(n), rows(n), 99.0).count()) for n in (len(names) // 8, len(names)))
    assert large < 10 * small


def test_chunks_of_names_asked_and_known_lose_no_pair(spark, monkeypatch):
    """Large and small blocks side by side, keys of the same words, names on one side only."""
    monkeypatch.setattr(fuzzy, "CHUNK", 9)
    rng = random.Random(11)
    keys = sorted({changed(rng, k) for k in ("anders berström", "berström anders", "maria el kové", "x" * 70 + " an") for _ in range(25)} | {"b a", "a b", "c"})
    rows = sorted({(rng.choice("sst"), rng.choice(["", "", "u21"]), k) for k in keys for _ in range(2)})
    asked, known = [r for r in rows if rng.random() < 0.6], [r for r in rows if rng.random() < 0.6]
    make = lambda x: spark.createDataFrame(x, "scope string, block string, key string")
    got = sorted(tuple(r) for r in fuzzy.similar(make(asked), make(known), 80.0).collect())
    want = sorted(
        (s, k, o, T.token_sort_ratio(k, o)) for s, b, k in asked for s2, b2, o in known if (s, b) == (s2, b2) and k != o and T.token_sort_ratio(k, o) >= 80
    )
    assert got == want and len(want) > 100


@pytest.mark.parametrize("masks", [400, 1 << 22])
def test_pairs_are_the_same_however_texts_are_cut(monkeypatch, masks):
    monkeypatch.setattr(fuzzy, "_MASKS", masks)
    monkeypatch.setattr(fuzzy, "BLOCK", 3)
    monkeypatch.setattr(fuzzy, "PAIRS", 10)
    rng = random.Random(12)
    keys = [words(rng) for _ in range(60)]
    keys += [changed(rng, k) for k in keys] + ["a" * 300, "a" * 299 + "b", "b" + "a" * 299, "x" * 64, "x" * 65, "x" * 63 + "y", "😀aé\x00z", "😀aé\x00y"]
    xs, ys = (rng.sample(sorted({k for k in keys if k}), 80) for _ in range(2))
    got = sorted((int(i), int(j), float(s)) for found in fuzzy.alike_pairs(fuzzy._slices(xs), ys, 75.0) for i, j, s in zip(*found, strict=True))
    ratio = lambda x, y: 200.0 * T.common_subsequence(x, y) / (len(x) + len(y))
    assert got == [(i, j, ratio(x, y)) for i, x in enumerate(xs) for j, y in enumerate(ys) if ratio(x, y) >= 75]


@pytest.mark.parametrize("chunk", [2, 100])
def test_keys_of_the_same_words_are_alike_once(spark, monkeypatch, chunk):
    monkeypatch.setattr(fuzzy, "CHUNK", chunk)
    rows = spark.createDataFrame([("s", "", k) for k in ("a b", "b a", "c", "b a", "c d e", "e d c", "d c e", "zz")], "scope string, block string, key string")
    got = sorted(tuple(r) for r in fuzzy.similar(rows, rows, 99.0).collect())
    alike = (("a b", "b a"), ("c d e", "e d c", "d c e"))
    assert got == sorted(("s", a, b, 100.0) for group in alike for a in group for b in group if a != b)
