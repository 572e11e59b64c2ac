"""Language identification by a small byte convolutional network, in numpy.

A text is cut into fixed-length windows of bytes. Filters of several widths slide
over each window, each keeps its maximum, and a softmax over the pooled filters
gives the window's language; a text takes the language with the largest mean log
probability over all its windows. A filter of width w is w tables of 256 byte
values, so a convolution is w look-ups and sums over a whole batch of windows.

The model learns from all windows of all texts that may teach, in all their languages. That goes
in rounds, each over texts of its own, chosen by a hash: every shard of a round goes on from the
same model, and the mean of what the shards learned is the next one. The first round is small and
has one shard, later ones are eight times larger each, so most of the work is spread evenly. Few texts are gone
over several times. Shards, their order and the mean don't depend on how rows were dealt.

One more output stands for no language: it learns from invented windows (bytes of training
windows in random order, random letters of any script, random digits), so what no learned
language explains has a low score in all of them. ``cutoff`` says how low is too low: by
the scores of all labelled documents that the model didn't learn from.

Defined results: a null or empty text, or one without a letter, is ``und`` with score 0;
rows without a label teach nothing; if no row teaches, every text is ``und``; a very long
text is taken in pieces, all of it; repeated rows are each predicted; ties go to the first language in
order; an empty table gives an empty table; other columns are carried along by ``identify``,
and their names must not begin with an underscore.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import numbered, read, small_batches, stored

UNKNOWN = "und"
#: Bytes of a window, filter widths, filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 12
#: Windows of the first round and of a shard (about), growth of the rounds, shards of a round at most: beyond,
#: shards are larger. Windows that are learned from in all (about), if need be by going over them again.
SHARD, GROWTH, SHARDS, VISITS = 1 << 15, 8, 512, 200_000
#: Windows that are put in random order together; invented ones are one in NONSENSE at most.
POOL, NONSENSE = 2048, 16
#: Weight of a window in a rare language at most, and share of the learning rate that is left at the end.
HEAVIEST, LAST_RATE = 100.0, 0.02
#: Share of the held-out documents that lies under four times the cutoff, and the score from
#: which a prediction outweighs another label.
UNDER, SURE = 0.001, 0.99
#: Windows that are convolved together.
BATCH = 32

#: Capitals read as small letters and all digits as one, byte by byte.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48


@dataclass
class Model:
    languages: list[str]
    tables: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    bias: np.ndarray  # (pooled filters,)
    dense: np.ndarray  # (pooled filters, languages and none)
    offset: np.ndarray  # (languages and none,)

    def pooled(self, x: np.ndarray, where: bool = False):
        """Windows (n, WINDOW) of bytes -> maxima (n, filters), and their places."""
        tops, places, n = [], [], x.size
        flat = x.reshape(-1).astype(np.intp)
        # one stretch of memory for all look-ups; sums that straddle two windows are not read
        total, part = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.float32)
        for table in self.tables:
            np.take(table[0], flat, axis=0, out=total, mode="clip")
            for j in range(1, len(table)):
                np.take(table[j], flat[j:], axis=0, out=part[: n - j], mode="clip")
                total[: n - j] += part[: n - j]
            inside = total.reshape(*x.shape, FILTERS)[:, : x.shape[1] - len(table) + 1]
            if where:
                at = inside.argmax(1)
                places.append(at)
                tops.append(np.take_along_axis(inside, at[:, None, :], 1)[:, 0])
            else:
                tops.append(inside.max(1))
        return np.concatenate(tops, 1) + self.bias, places

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        h, _ = self.pooled(x)
        return _log_softmax(np.maximum(h, 0) @ self.dense + self.offset)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of all texts as windows, and each window's text. The last window of
    a longer text ends with it; a shorter text is filled up with zeros."""
    starts, owner, at = [], [], 0
    for i, t in enumerate(texts):
        n = max(len(t), WINDOW)
        own = list(range(0, n - WINDOW + 1, WINDOW))
        if own[-1] + WINDOW < n:
            own.append(n - WINDOW)
        starts += [at + s for s in own]
        owner += [i] * len(own)
        at += n
    flat = _FOLD[np.frombuffer(b"".join(t.ljust(WINDOW, b"\0") for t in texts), np.uint8)]
    return flat[np.array(starts)[:, None] + np.arange(WINDOW)], np.array(owner)


def nonsense(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` windows in no language: bytes of windows ``x`` in random order, letters of random
    scripts, and random hexadecimal digits."""
    out = x[rng.integers(0, len(x), n)].copy()
    for i in range(n):
        if i % 3 == 0:
            out[i] = rng.permutation(out[i])
        elif i % 3 == 1:
            first = int(rng.choice([0x61, 0x370, 0x410, 0x5D0, 0x620, 0x905, 0xE01, 0x3041, 0x4E00, 0xAC00]))
            chars = [chr(c) for c in first + rng.integers(0, 26 if first < 0x370 else 48, WINDOW)]
            out[i] = np.frombuffer("".join(" " if rng.random() < 0.15 else c for c in chars).encode()[:WINDOW], np.uint8)
        else:
            out[i] = np.frombuffer(rng.choice(list(b"0123456789abcdef"), WINDOW).astype(np.uint8).tobytes(), np.uint8)
    return _FOLD[out]


class Lessons:
    """All labelled texts that may teach, as a table of text and lang; iterating gives them one by one."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def __iter__(self) -> Iterator[tuple[str, str]]:
        return ((r.text, r.lang) for r in self.rows.toLocalIterator())


@dataclass
class _State:
    """All weights in one vector, with Adam's means and squares and its steps so far."""

    values: np.ndarray  # (3, weights)
    steps: float

    def model(self, languages: list[str]) -> Model:
        """The model whose arrays are views of the first row."""
        n_pooled, n_out = FILTERS * len(WIDTHS), len(languages) + 1
        out, at = [], 0
        for shape in [*[(w, 256, FILTERS) for w in WIDTHS], (n_pooled,), (n_pooled, n_out), (n_out,)]:
            n = int(np.prod(shape))
            out.append(self.values[0, at : at + n].reshape(shape))
            at += n
        return Model(languages, out[: len(WIDTHS)], *out[len(WIDTHS) :])

    @staticmethod
    def first(n_languages: int, seed: int) -> _State:
        rng = np.random.default_rng(seed)
        n_pooled, n_out = FILTERS * len(WIDTHS), n_languages + 1
        parts = [rng.normal(0, 0.3, w * 256 * FILTERS) for w in WIDTHS]
        parts += [np.zeros(n_pooled), rng.normal(0, 0.2, n_pooled * n_out), np.zeros(n_out)]
        flat = np.concatenate(parts).astype(np.float32)
        return _State(np.stack([flat, np.zeros_like(flat), np.zeros_like(flat)]), 0.0)


def _invented(n: int, n_languages: int) -> int:
    return max(1, n // max(n_languages, NONSENSE))


def _weights(n: list[int]) -> np.ndarray:
    """Weight of a window of each language and of none, so that all count alike."""
    each = np.array([*n, _invented(sum(n), len(n))], np.float64)
    return (each.sum() / (len(each) * each)).clip(0, HEAVIEST).astype(np.float32)


def _rate(done: float) -> float:
    """Share of the learning rate when a share ``done`` of all windows is: whole until the middle, then falling."""
    return max(LAST_RATE, min(1.0, 2 * (1 - done)))


def _learn(state: _State, languages: list[str], rows: Iterable[tuple[list[str], list[int]]], weight: np.ndarray, rng, batch: int, rates: tuple[float, float], expected: float) -> int:
    """Adam on the cross entropy over all windows of all texts, batch by batch of (texts, places of
    their languages), in ``state`` itself; ``rates`` are passed through linearly. The windows that it saw."""
    m, seen = state.model(languages), 0
    p, m1, m2 = state.values
    for texts, labels in rows:
        for which, segments in _segments(texts, POOL * WINDOW):
            x, owner = windows(segments)
            y = np.array(labels)[np.array(which)[owner]]
            n = len(y)
            none = _invented(n, len(languages))
            x, y = np.concatenate([x, nonsense(x, none, rng)]), np.concatenate([y, np.full(none, len(languages))])
            order = rng.permutation(len(y))
            for s in range(0, len(y), batch):
                pick = order[s : s + batch]
                xb, yb = x[pick], y[pick]
                h, places = m.pooled(xb, where=True)
                a = np.maximum(h, 0)
                d = np.exp(_log_softmax(a @ m.dense + m.offset))
                d[np.arange(len(yb)), yb] -= 1
                d *= weight[yb][:, None] / len(yb)
                dh = (d @ m.dense.T) * (h > 0)
                grads = []
                for k, (w, at) in enumerate(zip(WIDTHS, places, strict=True)):
                    part = dh[:, k * FILTERS : (k + 1) * FILTERS].ravel()
                    for j in range(w):  # only the place of the maximum learns
                        cell = np.take_along_axis(xb, at + j, 1).astype(np.int64) * FILTERS + np.arange(FILTERS)
                        grads.append(np.bincount(cell.ravel(), weights=part, minlength=256 * FILTERS))
                g = np.concatenate([*grads, dh.sum(0), (a.T @ d).ravel(), d.sum(0)]).astype(np.float32)
                state.steps += 1
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                now = rates[0] + (rates[1] - rates[0]) * min(1.0, (seen + s) / max(expected, 1.0))
                p -= now * (m1 / (1 - 0.9**state.steps)) / (np.sqrt(m2 / (1 - 0.999**state.steps)) + 1e-8)
            seen += n
    return seen


def _n_windows(text: str) -> int:
    return max(1, -(-len(text.encode("utf-8", "replace")) // WINDOW))


def _batch(most: int, total: int) -> int:
    """Windows of a step: ``most``, or so many that an epoch has 16 steps."""
    return max(4, min(most, total // 16))


def train(rows: Lessons | list[tuple[str, str]], epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 0) -> Model | None:
    """Fit on all windows of (text, language) pairs: in this process, or, of a table of them, in the
    executors, which give back sums of weights. A table is gone over ``epochs`` times at most;
    of few windows, fewer than ``batch`` make a step."""
    if isinstance(rows, Lessons):
        return _train_apart(rows.rows, epochs, batch, rate, seed)
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    place = {lang: i for i, lang in enumerate(languages)}
    texts, y = [t for t, _ in rows], [place[lang] for _, lang in rows]
    n = [_n_windows(t) for t in texts]
    batch = _batch(batch, sum(n))
    state, rng = _State.first(len(languages), seed), np.random.default_rng(seed)
    weight = _weights(np.bincount(y, weights=n).astype(int).tolist())
    for e in range(epochs):
        order = rng.permutation(len(y))
        again = [([texts[i] for i in order], [y[i] for i in order])]
        _learn(state, languages, again, weight, rng, batch, (rate * _rate(e / epochs), rate * _rate((e + 1) / epochs)), sum(n))
    return state.model(languages)


def _train_apart(rows: DataFrame, epochs: int, batch: int, rate: float, seed: int) -> Model | None:
    small_batches(rows.sparkSession, 500)
    size = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / WINDOW))
    counts = {r["lang"]: int(r["n"]) for r in rows.groupBy("lang").agg(F.sum(size).alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    total, weight = sum(counts.values()), _weights([counts[lang] for lang in languages])
    batch = _batch(batch, total)
    passes = max(1, min(epochs, -(-VISITS // total)))
    state = _State.first(len(languages), seed)
    for e in range(passes):
        for low, high in _rounds(total) if e == 0 else [(0.0, 1.0)]:
            rates = (rate * _rate((e + low) / passes), rate * _rate((e + high) / passes))
            state = _round(rows, f"{seed} {e}", low, high, (high - low) * total, state, languages, weight, batch, rates)
    return state.model(languages)


def _rounds(total: int) -> list[tuple[float, float]]:
    """Shares of all windows: the first SHARD, GROWTH times as many next, and so on to the end."""
    out, at, n = [], 0, SHARD
    while at < total:
        end = at + n if at + n + n // 2 < total else total  # a small rest goes with the round before
        out.append((at / total, end / total))
        at, n = end, n * GROWTH
    return out


def _round(rows: DataFrame, salt: str, low: float, high: float, n: float, state: _State, languages: list[str], weight: np.ndarray, batch: int, rates: tuple[float, float]) -> _State:
    """The mean, by windows, of what each shard of one round learns from ``state`` on."""
    shards = max(1, min(SHARDS, round(n / SHARD)))
    place = {lang: i for i, lang in enumerate(languages)}
    values, steps = state.values, state.steps

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own, rng, seen = None, None, None, 0

        def done():
            return pd.DataFrame({"shard": [now], "n": [seen], "steps": [own.steps], "state": [own.values.tobytes()]})

        for pdf in batches:
            for shard, part in pdf.groupby("shard"):
                if shard != now:  # shards follow each other
                    if now is not None:
                        yield done()
                    now, own, rng, seen = shard, _State(values.copy(), steps), np.random.default_rng([int(shard), int(steps)]), 0
                taught = [(list(part["text"]), [place[lang] for lang in part["lang"]])]
                left = max(1.0, n / shards - seen)
                begin = rates[0] + (rates[1] - rates[0]) * min(1.0, seen * shards / n)
                seen += _learn(own, languages, taught, weight, rng, batch, (begin, rates[1]), left)
        if now is not None:
            yield done()

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        total, part = pdf["n"].sum(), np.zeros(values.size)
        pdf = pdf.sort_values("shard")
        for k, v in zip(pdf["n"], pdf["state"], strict=True):
            part += np.frombuffer(v, np.float32) * (k / total)
        return pd.DataFrame({"group": [pdf["shard"].iloc[0] // 32], "n": [total], "steps": [(pdf["n"] * pdf["steps"]).sum() / total], "state": [part.tobytes()]})

    key = F.xxhash64(F.lit(f"langid {salt}"), "doc_id", "text", "lang")
    unit = F.shiftrightunsigned(key, 11).cast("double") / float(1 << 53)
    dealt = (
        rows.filter((unit >= low) & (unit < high))
        .select(F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards)).cast("int").alias("shard"), key.alias("_k"), "doc_id", "text", "lang")
        .repartitionById(shards, "shard").sortWithinPartitions("shard", "_k", "doc_id", "text", "lang").select("shard", "text", "lang")
    )
    learned = dealt.mapInPandas(fit, "shard int, n long, steps double, state binary")
    means = learned.groupBy((F.col("shard") / 32).cast("int")).applyInPandas(mean, "group int, n long, steps double, state binary")
    found = sorted(means.collect(), key=lambda r: r["group"])
    if not found:
        return state
    every = sum(r["n"] for r in found)
    mixed = sum(np.frombuffer(r["state"], np.float64) * (r["n"] / every) for r in found)
    return _State(mixed.astype(np.float32).reshape(values.shape), sum(r["steps"] * r["n"] for r in found) / every)


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """(languages, scores): the score is the mean probability over the windows."""
    if model is None or not texts:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    shape = (len(texts), len(model.languages))
    total, seen, count = np.zeros(shape), np.zeros(shape), np.zeros(len(texts))
    for which, segments in _segments(texts):
        x, owner = windows(segments)
        owner = np.array(which)[owner]
        for i in range(0, len(x), BATCH):
            lp = model.log_probabilities(x[i : i + BATCH])[:, :-1].astype(np.float64)
            np.add.at(total, owner[i : i + BATCH], lp)
            np.add.at(seen, owner[i : i + BATCH], np.exp(lp))
        count += np.bincount(owner, minlength=len(texts))
    best = total.argmax(1)
    return [model.languages[b] for b in best], (seen[np.arange(len(texts)), best] / count).clip(0, 1).tolist()


def _segments(texts: list[str | None], size: int = 256 * WINDOW):
    """All bytes of all texts in groups of about ``size``; a longer text is cut at whole
    windows, so that memory doesn't depend on the longest."""
    which, held, n = [], [], 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "replace")
        for s in range(0, max(len(raw), 1), size):
            part = raw[s : s + size]
            held.append(raw[-WINDOW:] if s and len(part) < WINDOW else part)
            which.append(i)
            n += len(part)
            if n >= size:
                yield which, held
                which, held, n = [], [], 0
    if held:
        yield which, held


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is 0 modulo 5."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def lessons(docs: DataFrame) -> Lessons:
    """All labelled texts that may teach: not held out, with a letter."""
    own = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return Lessons(own.select("doc_id", "text", "lang"))


#: Its name when it took a part of the texts; now it takes none away.
sample = lessons


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``_lang`` and ``_score``; the other columns stay in the JVM."""
    @F.pandas_udf("lang string, score double")
    def guess(text: pd.Series) -> pd.DataFrame:
        names, scores = predict(model, list(text))
        return pd.DataFrame({"lang": names, "score": scores})

    small_batches(docs.sparkSession, 500)
    guess = guess.asNondeterministic()  # so that a filter on its result doesn't run it twice
    legible = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = docs.withColumn("_g", guess("text"))
    return found.withColumns(
        {
            "_lang": F.when(legible, F.col("_g.lang")).otherwise(F.lit(UNKNOWN)),
            "_score": F.when(legible, F.col("_g.score")).otherwise(F.lit(0.0)),
        }
    ).drop("_g")


def known(docs: DataFrame) -> DataFrame:
    """The documents that the cutoff is calibrated on: held out, labelled, with a letter."""
    return docs.filter(held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))


def cutoff(docs: DataFrame, model: Model | None, under: float = UNDER) -> float:
    """Score below which a document is in no learned language: a quarter of the score that a share
    ``under`` of all held-out labelled documents stays below. A quarter, because those documents are clean."""
    return 0.0 if model is None else least_score(stored(identify(known(docs), model).select("_score")), under)


def least_score(scores: DataFrame, under: float = UNDER) -> float:
    """The cutoff by ``_score`` of all rows of a stored table. Exact: scores are sorted over all
    tasks, and the driver gets the two beside the place, between which it is interpolated."""
    n = scores.count()
    if not n:
        return 0.0
    at = under * (n - 1)
    near = numbered(scores.select("_score"), ["_score"], "_place").filter(F.col("_place").isin(int(at), min(int(at) + 1, n - 1)))
    low = [r["_score"] for r in near.orderBy("_place").collect()]
    return 0.25 * (low[0] + (low[-1] - low[0]) * (at - int(at)))


def op5_langid(spark, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents."""
    docs = read(spark, sf_dir, "documents")
    model = train(lessons(docs.select("doc_id", "text", "lang")))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score")
    )
