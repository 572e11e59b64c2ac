"""Phrase collocation mining.

Every phrase of 1 to ``most`` words becomes a DataFrame row (language, phrase, count) and is
hash-aggregated; phrases that are frequent enough are joined with the counts of their prefixes and
suffixes, scored in Decimal, anti-joined with their one-word extensions and ranked by language.

Most phrases of natural text are rare and none of them can matter: a part of a phrase occurs at least
as often as the phrase. So phrases are exploded twice. First as 64-bit keys, whose counts say which
keys are frequent; these are marked in a bitmap of fixed size. Then as texts, but only where the key
is marked. A key that two phrases share, or a mark that two keys share, lets a rare phrase through, which
the exact counts of the second time drop again; no frequent phrase can be lost. Both times phrases
are counted in the task that read them before they are shuffled.

One-word extensions suffice: if a phrase lies in a candidate that is two words longer, it lies in the
phrase between them, which is as frequent as the longer one and therefore a candidate as well.

Defined results: a null text is empty; a null language is ``und`` and one with rows that say
``und``; repeated rows count each; doc_id isn't used; only A-Z are lower-cased; a
text of any length is read whole; ties in all but the phrase go by the phrase's bytes; an empty
table gives an empty table; columns other than text and lang are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import read, small_batches, spread_join, stored

#: Words of a phrase, at most; occurrences, at least; rows a language.
MOST, LEAST, TOP = 3, 10, 2000
#: A phrase goes if a longer one has so many hundredths of its occurrences.
WITHIN = 50
SCALE = 1_000_000
#: Bits that mark frequent keys: 8 MB whatever the input.
BITS = 1 << 26
#: Characters that are split, and keys that are counted, at once in a task.
_CHARS, _KEYS = 1 << 23, 1 << 21


def _phrases(texts, most: int):
    """Arrow strings -> distinct words (Arrow), and for each number of words the places of phrases in the
    list of word numbers, which comes first."""
    import numpy as np
    import pyarrow.compute as pc

    broken = pc.replace_substring_regex(pc.ascii_lower(texts), r"[.,;:!?\n-\r]", " \n ")
    split = pc.split_pattern_regex(broken, r"[ \t]+")
    coded = split.flatten().dictionary_encode()
    words, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    blank, gap = (pc.index(words, x).as_py() for x in ("", "\n"))
    real = ids != blank
    ids, owner = ids[real], owner[real]
    word = ids != gap
    # a phrase lies in one text, and no gap lies in it
    piece = owner + np.cumsum(~word)
    runs = [np.flatnonzero(word)]
    for k in range(1, most):
        at = runs[-1]
        at = at[at + k < len(ids)]
        runs.append(at[word[at + k] & (piece[at] == piece[at + k])])
    return words, ids, runs


def _mixed(x):
    """uint64 -> uint64, one to one: every bit depends on all."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(words, ids, runs, lang: str):
    """The 64-bit keys of all phrases, for each number of words."""
    import numpy as np
    from pandas.util import hash_array

    seed = hash_array(np.array([lang], dtype=object))[0]
    own = hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)
    of, out, key = own[ids], [], None
    with np.errstate(over="ignore"):
        for k, at in enumerate(runs):
            # a phrase's key continues that of its first words
            long = np.zeros(len(ids), np.uint64)
            long[at] = _mixed((seed if key is None else key[at]) * np.uint64(0x9E3779B97F4A7C15) + of[at + k])
            out.append(long[at])
            key = long
    return out


def _by_lang(batches):
    """Batches of (lang, text) -> (lang, texts), of about ``_CHARS`` bytes."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        for lang in b.column(0).unique().to_pylist():
            texts = b.column(1).filter(pc.equal(b.column(0), lang))
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(sizes // _CHARS)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(texts)], strict=True):
                if hi > lo:
                    part = texts.slice(lo, hi - lo)
                    yield lang, part if pa.types.is_string(part.type) else part.cast(pa.string())


def _counted(most: int):
    """(lang, text) -> key, n: keys of all phrases, counted for every ``_KEYS`` of them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, size = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)].view(np.int64)), pa.array(n[at : at + (1 << 16)], pa.int64())], names=["key", "n"])

        for lang, texts in _by_lang(batches):
            for keys in _keys(*_phrases(texts, most), lang):
                held.append(keys)
                size += len(keys)
            if size >= _KEYS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _spelled(most: int, marks, bits: int):
    """(lang, text) -> lang, k, phrase, n: phrases whose key is marked, counted by stretches of text, and
    with k = 0 the number of words."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        frequent = np.frombuffer(marks.value, np.uint8)
        for lang, texts in _by_lang(batches):
            words, ids, runs = _phrases(texts, most)
            yield _rows(lang, 0, pa.array([""]), [len(runs[0])])
            for k, (at, keys) in enumerate(zip(runs, _keys(words, ids, runs, lang), strict=True)):
                bit = (keys % np.uint64(bits)).astype(np.int64)
                at = at[(frequent[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
                if not len(at):
                    continue
                # number the phrases that are left, one word more at a time
                number, first, n = np.zeros(len(at), np.int64), None, None
                for j in range(k + 1):
                    _, first, number, n = np.unique(number * len(words) + ids[at + j], return_index=True, return_inverse=True, return_counts=True)
                spelled = [words.take(pa.array(ids[at[first] + j])) for j in range(k + 1)]
                phrases = pc.binary_join_element_wise(*spelled, " ") if k else spelled[0]
                for lo in range(0, len(phrases), 1 << 14):
                    yield _rows(lang, k + 1, phrases.slice(lo, 1 << 14), n[lo : lo + (1 << 14)])

    return run


def _rows(lang: str, k: int, phrases, n):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array([k] * len(phrases), pa.int32()), phrases, pa.array(n, pa.int64())], names=["lang", "k", "phrase", "n"])


def _marks(keys: DataFrame, bits: int) -> bytes:
    """A bitmap of ``bits`` bits in which those of all ``keys`` (longs, read as unsigned) are set."""
    # what the key leaves as an unsigned number: the bits are a power of two
    spot = F.col("key").bitwiseAND(bits - 1)
    each = keys.select(F.shiftright(spot, 15).cast("int").alias("bucket"), spot.bitwiseAND(32_767).alias("at"))
    rows = each.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")).collect()  # bits / 32,768 rows at most
    out = bytearray(bits // 8)
    for bucket, part in rows:
        out[bucket * 4096 : bucket * 4096 + len(part)] = part
    return bytes(out)


def frequent(docs: DataFrame, most: int = MOST, least: int = LEAST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """``docs`` (text, lang) -> phrases of 1 to ``most`` words that occur ``least`` times in their language
    (lang, k, phrase, f), and the words of each language (lang, n)."""
    spark = docs.sparkSession
    small_batches(spark, 1000)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    keys = rows.mapInArrow(_counted(most), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    marks = spark.sparkContext.broadcast(_marks(keys.select("key"), bits))
    spelled = rows.mapInArrow(_spelled(most, marks, bits), "lang string, k int, phrase string, n long")
    counts = stored(spelled.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f")).filter((F.col("f") >= least) | (F.col("k") == 0)))
    return counts.filter("k > 0"), counts.filter("k = 0").select("lang", F.col("f").alias("n"))


def _exactly(c: str) -> Column:
    return F.col(c).cast("decimal(18,0)")


def _with_counts(rows: DataFrame, counts: DataFrame, phrase: str, out: str) -> DataFrame:
    """``rows`` with ``out``, how often their ``phrase`` occurs. A part of very many phrases is joined by broadcast."""
    fan = rows.groupBy("lang", phrase).agg(F.count("*").alias("_n"))
    one = counts.select("lang", F.col("phrase").alias(phrase), F.col("f").alias(out)).join(fan, ["lang", phrase])
    return spread_join(rows, one, ["lang", phrase], rows.count(), "_n")


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, within: int = WITHIN, top: int = TOP, bits: int = BITS) -> DataFrame:
    """The ``top`` phrases of 2 to ``most`` words of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` how often the two sides of its worst cut do, ``n`` the
    language's words; the score is floor(SCALE a a / (l r))."""
    counts, totals = frequent(docs, most, least, bits)
    words = F.split("phrase", " ")
    phrases = counts.filter("k >= 2").withColumnRenamed("f", "a")
    each = phrases.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    sides = stored(each.select("lang", "k", "phrase", "a", "j", F.array_join(F.slice(words, F.lit(1), F.col("j")), " ").alias("left"), F.array_join(F.slice(words, F.col("j") + 1, F.col("k")), " ").alias("right")))
    known = _with_counts(stored(_with_counts(sides, counts, "left", "l")), counts, "right", "r")
    # exact: whole numbers of up to 38 digits
    score = F.expr(f"CAST({SCALE}BD * a * a AS DECIMAL(38,0)) div CAST(l * r AS DECIMAL(38,0))")
    known = known.select("lang", "k", "phrase", "j", *[_exactly(c).alias(c) for c in ("a", "l", "r")]).withColumn("score", score)
    worst = known.groupBy("lang", "k", "phrase").agg(F.min(F.struct("score", "j", "a", "l", "r")).alias("w")).select("lang", "k", "phrase", "w.*")

    ends = F.array(F.slice(words, F.lit(1), F.col("k") - 1), F.slice(words, F.lit(2), F.col("k") - 1))
    longer = phrases.filter("k >= 3").select("lang", F.explode(ends).alias("part"), "a").groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("a").alias("f"))
    left = worst.join(longer, ["lang", "phrase"], "left").filter(F.col("f").isNull() | (100 * F.col("f") < within * F.col("a")))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each of a fixed number of parts of a language, then of the language
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = left.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    ranked = ranked.join(totals, "lang")
    return ranked.select("lang", "rank", "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two or three words of each language of documents."""
    return collocations(read(spark, sf_dir, "documents"))

