"""The corpus pipeline, stage by stage, on its own input and on awkward rows."""

import hashlib
import random
import threading
from collections import Counter
from pathlib import Path

import pytest
import test_llm_small
from pyspark.sql import functions as F

import corpus_pipeline
from quotemill.llm import langid, mixing, tokens
from quotemill.llm._common import free, settled, shared_dir, stored

SF = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
STAGES = dict(corpus_pipeline.STAGES)


def beside_odd_rows(spark, sf):
    """Test documents beside rows in no language, nulls, wholly repeated rows and repeated ids."""
    own = spark.read.parquet(f"{sf}/documents.parquet")
    first = own.orderBy("doc_id").first()
    rng = random.Random(3)
    odd = [
        (9_001, None, None, None, None), (9_002, "123 456", "en", "src0", 7), (9_003, "", None, "src0", 0),
        (9_004, "xkqz jvvw qqpl zzkr bnmw wwrt xxpq vvbn kkjh qzqz jxjx wvwv", None, "src0", 60), (9_005, "Это русский текст и ещё немного слов о погоде", None, "src1", 46),
        (first.doc_id, "another text of the same id " + test_llm_small.prose(rng, 30), "en", "src0", 20), (None, test_llm_small.prose(rng, 30), "en", "src0", 5),
        (9_006, first.text, None, "src2", first.n_chars),
    ]
    again = own.filter(F.col("doc_id") == first.doc_id)
    clash = own.unionByName(spark.createDataFrame(odd, own.schema)).unionByName(again).unionByName(again)
    return stored(clash.withColumns({"_lang": F.lit("clash"), "kept": F.lit("clash"), "removed": F.lit(1), "n": F.lit(2), "h1": F.lit(3)}))


@pytest.fixture(scope="module")
def docs(spark):
    return beside_odd_rows(spark, SF)


def rows_of(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_language(spark):
    docs = beside_odd_rows(spark, "/root/testdata/sf0.01")
    left = rows_of(STAGES["language_id"](spark, docs, SF))
    before = rows_of(docs)
    ids = {r[0] for r in left}
    assert not ids & {9_001, 9_002, 9_003, 9_004, 9_005} and 9_006 in ids
    assert {r[0] for r in before} - ids == {9_001, 9_002, 9_003, 9_004, 9_005}
    assert Counter({(r[0], r[1], r[3], r[4]): n for r, n in left.items()}) <= Counter({(r[0], r[1], r[3], r[4]): n for r, n in before.items()})
    assert all(r[2] for r in left)  # what had no label has one now
    true = {r[:2]: r[2] for r in before if r[2]}
    wrong = sum(r[2] != true.get(r[:2], r[2]) for r in left)
    assert wrong <= 0.02 * len(left)
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert STAGES["language_id"](spark, none, SF).count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()


def test_cutoff_spares_held_out_documents(spark):
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(langid.sample(own))
    least = langid.cutoff(own, model)
    assert 0.02 < least < 0.3
    kept = langid.identify(own.filter(langid.held_out(F.col("doc_id"))), model).agg(F.avg((F.col("_score") >= least).cast("double"))).first()[0]
    assert kept >= 0.995
    assert langid.cutoff(own.limit(0), model) == 0 and langid.cutoff(own, None) == 0


def test_near_duplicates(spark, docs):
    left = rows_of(STAGES["ngram_jaccard_join"](spark, docs, SF))
    own = [r for r in rows_of(docs).elements() if r[0] is not None]
    _, groups = test_llm_small.jaccard_brute_force([r[:2] for r in own])
    assert sum(n for r, n in left.items() if r[0] is not None) == groups
    assert all(n == 1 for n in left.values()) and not left - rows_of(docs)
    assert sum(r[0] is None for r in left) == 1


def test_substrings(spark, docs):
    left = STAGES["substring_dedup"](spark, docs, SF)
    assert left.columns == list(COLUMNS) and left.count() == docs.count()
    assert left.filter(~F.col("n_chars").eqNullSafe(F.char_length("text"))).count() == 0
    assert Counter(r.doc_id for r in left.collect()) == Counter(r.doc_id for r in docs.collect())


def test_mixture(spark, docs):
    left = rows_of(STAGES["source_mixing"](spark, docs, SF))
    before = rows_of(docs)
    assert all(left[r] <= 3 * before[r] for r in left) and set(left) <= set(before)
    size = lambda t: len((t or "").split())
    hashed = docs.select(*COLUMNS).select("*", *mixing.identity(*COLUMNS)).collect()
    plain = [{"source": r.source, "size": size(r.text), "h1": r.h1, "h2": r.h2} for r in hashed]
    if all(p["size"] == r.n for p, r in zip(plain, docs.select(mixing.words(F.coalesce("text", F.lit(""))).alias("n")).collect(), strict=True)):
        taken = test_llm_small.queue_by_hand(spark, plain, ["h1", "h2"])
        words = Counter()
        for r, n in left.items():
            words[r[3]] += n * size(r[1])
        want = Counter()
        for (source, *_), n in taken.items():
            want[source] += n
        assert +words == +want


def test_stages_follow_each_other(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == list(COLUMNS), name
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(r.text)
    enc = tokens.encoding(tokens.vocabulary())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(out) == docs.count()
    for r in out:
        fits = [t for t in texts[r.doc_id] if hashlib.sha256(t.encode()).hexdigest() == r.decoded_sha256]
        assert fits and r.n_tokens == len(enc.encode_ordinary(fits[0]))


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    with free(spark):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF))
            assert docs.count() == 0


def tables(spark):
    return set(Path(shared_dir(spark).removeprefix("file:")).glob("quotemill-table-*"))


@pytest.mark.parametrize("name", ["language_id", "ngram_jaccard_join", "substring_dedup"])
def test_a_stage_leaves_one_table_without_texts(spark, docs, name):
    before = tables(spark)
    left = STAGES[name](spark, docs, SF)
    made = tables(spark) - before
    assert len(made) == 1 and "text" not in spark.read.parquet(str(*made)).columns
    assert left.count() > 0


def test_settled_removes_what_was_made_on_the_way(spark):
    other = []

    def work():
        within = stored(spark.range(3))
        beside = threading.Thread(target=lambda: other.append(stored(spark.range(4))))
        beside.start()
        beside.join()
        return within.selectExpr("2 * id AS id")

    before = tables(spark)
    assert sorted(r.id for r in settled(spark, work).collect()) == [0, 2, 4]
    assert other[0].count() == 4 and len(tables(spark) - before) == 2

    def fail():
        stored(spark.range(3))
        raise ValueError

    before = tables(spark)
    with pytest.raises(ValueError):
        settled(spark, fail)
    assert all(not any(p.iterdir()) for p in tables(spark) - before)
