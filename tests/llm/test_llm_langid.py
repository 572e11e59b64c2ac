"""The language model and its cutoff come from all labelled rows, not from a part of them."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.llm import langid

WORDS = {"de": "der und die das nicht ein ist", "en": "the and of that was in a", "fr": "le et les des que dans est"}


def labelled(spark, n, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, f"{' '.join(rng.choices(WORDS[lang].split(), k=rng.randint(1, 90)))} {i}", lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_every_text_and_language_teaches(spark):
    docs, rows = labelled(spark, 4000)
    odd = [(5000, None, "en"), (5001, "12 34", "en"), (5002, "nobody's", None), (5003, "", "en"), (None, "of none", "en")]
    seldom = [(6000 + i, f"word{i} of its own", f"x{i:03}") for i in range(450)]
    every = docs.unionByName(spark.createDataFrame(odd + seldom, docs.schema))
    teach = {r.doc_id for r in every.filter(~langid.held_out(F.col("doc_id"))).collect()}
    want = Counter((t, lang) for i, t, lang in rows + seldom + odd[4:] if i in teach)
    assert Counter(langid.lessons(every)) == want and sum(want.values()) > 3400
    model = langid.train(langid.lessons(every), epochs=1)
    assert model.languages == sorted({lang for _, lang in want}) and len(model.languages) > 330


def test_the_middle_of_a_long_text_teaches(spark):
    """Texts that differ only where four windows spread over the text don't look."""
    filler = "lorem ipsum dolor sit amet " * 200
    rng = random.Random(1)
    rows = []
    for i in range(240):
        lang = ("de", "en")[i % 2]
        own = " ".join(rng.choices(WORDS[lang].split(), k=200))
        rows.append((i, filler[:768] + own + filler[len(own) + 768 : 5000], lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(langid.lessons(docs))
    found = langid.identify(docs.filter(langid.held_out(F.col("doc_id"))), model)
    assert found.agg(F.avg((F.col("_lang") == F.col("lang")).cast("double"))).first()[0] > 0.95


def test_rounds_and_shards_take_all_once_however_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(langid, "SHARD", 64)
    monkeypatch.setattr(langid, "VISITS", 1)
    docs, rows = labelled(spark, 3000)
    taught = list(langid.lessons(docs))
    total = sum(langid._n_windows(t) for t, _ in taught)
    rounds = langid._rounds(total)
    assert len(rounds) > 2 and rounds[0][0] == 0 and rounds[-1][1] == 1 and all(a[1] == b[0] for a, b in zip(rounds, rounds[1:], strict=False))
    one, other = (langid.train(langid.lessons(docs.repartition(n))) for n in (1, 7))
    assert all(np.array_equal(a, b) for a, b in zip([*one.tables, one.bias, one.dense, one.offset], [*other.tables, other.bias, other.dense, other.offset], strict=True))
    state = langid._State.first(3, 0)
    place = {lang: i for i, lang in enumerate(sorted(WORDS))}
    seen = langid._learn(state, sorted(WORDS), [([t for t, _ in taught], [place[lang] for _, lang in taught])], np.ones(4, np.float32), np.random.default_rng(0), 64, (0.01, 0.0), total)
    assert seen == total


def test_the_cutoff_is_that_of_all_held_out_texts(spark):
    docs, rows = labelled(spark, 30_000)
    model = langid.train([(t, lang) for _, t, lang in rows[:300]], epochs=4)
    scores = [r._score for r in langid.identify(docs.filter(langid.held_out(F.col("doc_id"))), model).collect()]
    assert len(scores) > 5000
    assert langid.cutoff(docs, model) == pytest.approx(0.25 * np.quantile(scores, langid.UNDER), rel=1e-12)
    few = spark.createDataFrame([(0.5,)], "_score double")
    assert langid.least_score(few) == 0.125 and langid.least_score(few.limit(0)) == 0
