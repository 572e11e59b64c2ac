"""A training corpus in five stages, each written and read again by the next.

Every stage works on all that its predecessor kept. All but the last return the
columns of documents; the last returns ids and digests for each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm import jaccard, langid, mixing, passages, tokens
from quotemill.llm._common import copies, read, settled, stored, text_or_empty

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The language model, the signatures and the shuffle are not SQL; tested by brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told: no text, no letter, or a score under the
    cutoff, which all held-out labelled documents calibrate; all others that are labelled teach. What is unsure stays; texts in two
    languages are clean. A lang that is null or that a sure prediction contradicts is replaced.

    Without any labelled document nothing is learned, and all that has a letter stays as it is.
    Null, empty and letterless texts go; repeated rows are each judged; an empty table gives an
    empty table; columns other than those of documents go.
    """
    own = docs.select(*COLUMNS)
    model = langid.train(langid.lessons(own))
    if model is None:
        return own.filter(F.col("text").rlike(r"\p{L}"))
    least = langid.cutoff(own, model)  # held-out texts are judged twice; storing what is judged would store all texts
    found = langid.identify(own, model).filter((F.col("_lang") != langid.UNKNOWN) & (F.col("_score") >= least))
    wrong = F.col("lang").isNull() | ((F.col("lang") != F.col("_lang")) & (F.col("_score") >= langid.SURE))
    return found.withColumn("lang", F.when(wrong, F.col("_lang")).otherwise(F.col("lang"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the smallest doc_id.

    Rows that repeat a doc_id and its text are copies, and one of them stays (which one,
    if other columns differ, is the least in these); rows that repeat a doc_id with another
    text are documents of their own; a null doc_id is in no group and stays; texts without a
    word are copies of each other; an empty table gives an empty table.
    """
    own = docs.select(*COLUMNS).withColumn("_v", F.xxhash64(text_or_empty()))
    judged = settled(
        spark, lambda: jaccard.similar(own.select("doc_id", "text")).filter("doc_id is not null").select("doc_id", F.col("version").alias("_v"), "kept")
    )
    by_row = judged.groupBy("doc_id", "_v").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    go, again = by_row.filter("not stays").select("doc_id", "_v"), by_row.filter("stays and n > 1").select("doc_id", "_v")
    left = own.join(go, ["doc_id", "_v"], "left_anti")
    if not again.isEmpty():  # rows that can't be told apart by id and text: the least of each
        rest = [c for c in COLUMNS if c != "doc_id"]
        some = left.join(again, ["doc_id", "_v"], "left_semi").groupBy("doc_id", "_v").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("r"))
        left = left.join(again, ["doc_id", "_v"], "left_anti").select(*COLUMNS).unionByName(some.select("doc_id", *[F.col("r")[c].alias(c) for c in rest]))
    return left.select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages from the texts; every document stays.

    A null text stays null, with a null length; a text that is gone as a whole is empty; rows
    that repeat a doc_id and its text keep the same; an empty table gives an empty table.
    """
    return passages.dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; those not taken go.

    Rows that are equal in all columns are repeated as often as the mix takes them together; a
    null source is a source; a null text has size 0; an empty table gives an empty table.
    """
    key = ["h1", "h2"]
    own = docs.select(*COLUMNS).select("*", *mixing.identity(*COLUMNS))
    sized = own.select("source", mixing.words(text_or_empty()).alias("size"), *key)
    taken = stored(mixing.mix(sized, key).groupBy(*key).agg(F.sum("passes").alias("passes"), F.count("*").alias("n")))
    once = own.join(taken.filter("n = 1 and passes > 0"), key)
    out = copies(once, "passes").select(*COLUMNS)
    often = taken.filter("n > 1 and passes > 0")
    if not often.isEmpty():  # equal rows are one before they are shuffled
        row = own.join(often, key, "left_semi").groupBy(*key).agg(*[F.first(c).alias(c) for c in COLUMNS])
        out = out.unionByName(copies(row.join(often, key), "passes").select(*COLUMNS))
    return out


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with the digests of the ids and of the bytes they decode to.

    A null text has no ids, like an empty one; repeated rows are each encoded; very long texts
    are cut and stitched; an empty table gives an empty table.
    """
    return tokens.decode(tokens.encode(docs)).select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substrings),
    ("source_mixing", mixture),
    ("byte_bpe", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
