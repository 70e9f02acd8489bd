"""Toxicity: averaged subword-bag embeddings under a linear softmax, embeddings and softmax trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (hashed), so a misspelling never seen in training shares
most n-grams with the word it stands for. A bag is the mean of the word vectors of ``WINDOW`` successive words; the softmax
over a bag gives its odds. A document is as toxic as its worst bag, however long it is; training starts from whole documents
as bags, then goes on with each document's worst bag.

Training is on a bounded sample of labelled rows (``TRAIN_ROWS``, each of at most ``TRAIN_BYTES`` and together of at most
``TRAIN_TOTAL``); scoring covers all rows and whole texts.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import batches_of, filter_rows, give_back, per_worker, pieces

#: Bounds of the training sample.
TRAIN_ROWS = 4000
TRAIN_BYTES = 65_536
TRAIN_TOTAL = 24 << 20
BUCKETS = 1 << 16
DIM = 8
WINDOW, STRIDE = 24, 12
CACHE_WORDS = 300_000
LONG_WORD = 64
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Words, lower-cased. A run over ``LONG_WORD`` characters (joined words, scripts without spaces) becomes parts of half that
    length that overlap by half of theirs, each a word of its own, so that none of it is unread or drowned."""
    found = _WORD.findall(text.lower()) if text else []
    if found and max(map(len, found)) > LONG_WORD:
        half, step = LONG_WORD // 2, LONG_WORD // 4
        return [p for w in found for p in ([w] if len(w) <= LONG_WORD else [w[i : i + half] for i in range(0, len(w) - step, step)])]
    return found


def subwords(word: str) -> list[int]:
    """Hashed n-grams of 3 and 4 characters of the word with its ends marked."""
    w = f"<{word}>"
    return [zlib.crc32(w[i : i + n].encode("utf-8", "replace")) % BUCKETS for n in (3, 4) for i in range(max(1, len(w) - n + 1))]


def window_starts(n: int) -> np.ndarray:
    return np.arange(0, max(1, n - STRIDE), STRIDE)


class _Sums:
    """Sums of the rows of a matrix by group, and back: rows' gradients from their groups'. A group has one row at least."""

    def __init__(self, index: np.ndarray, sizes: np.ndarray, n_rows: int) -> None:
        self.index, self.sizes, self.starts = index, sizes, np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        self.scale = (1.0 / sizes)[:, None].astype(np.float32)
        order = np.argsort(index, kind="stable")
        self.back = np.repeat(np.arange(sizes.size, dtype=np.int32), sizes)[order]
        self.rows, first = np.unique(index[order], return_index=True)
        self.first, self.n_rows = first, n_rows

    def only(self, rows: np.ndarray) -> _Sums:
        """The sums of some groups."""
        n = self.sizes[rows]
        at = np.repeat(self.starts[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return _Sums(self.index[at], n, self.n_rows)

    def mean(self, x: np.ndarray) -> np.ndarray:
        # Column by column: no matrix as long as all rows' grams.
        return np.stack([np.add.reduceat(c[self.index], self.starts) for c in np.ascontiguousarray(x.T)], axis=1) * self.scale

    def gradient(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n_rows, g.shape[1]), np.float32)
        for k, c in enumerate(np.ascontiguousarray((g * self.scale).T)):
            out[self.rows, k] = np.add.reduceat(c[self.back], self.first)
        return out


class ToxicityModel:
    """``weights``: each bucket's vector times the difference of the two softmax rows; ``bias``: the odds of an empty bag."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias, self.known = weights, bias, {}

    def word_odds(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = list(set(words))
            grams = [subwords(w) for w in new]
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            flat = np.fromiter((x for g in grams for x in g), np.int64, int(sizes.sum()))
            sums = np.add.reduceat(self.weights[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])))
            known.update(zip(new, (sums / sizes).tolist()))
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def score(self, text: str | None) -> float:
        """The probability of the toxic class for the worst bag of the text."""
        words = words_of(text)
        odds = self.bias
        if words:
            total = np.concatenate(([0.0], np.cumsum(self.word_odds(words))))
            lo = window_starts(len(words))
            hi = np.minimum(lo + WINDOW, len(words))
            odds = float(((total[hi] - total[lo]) / (hi - lo)).max()) + self.bias
        return 1.0 / (1.0 + float(np.exp(-np.clip(odds, -30, 30))))


def fit(texts: list[str], labels: list[int], steps: int = 80, warm: int = 15, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> ToxicityModel:
    """Train on whole documents for ``warm`` steps, then on their worst bags. Full-batch Adam; reruns agree."""
    # Words are numbers from here on, grams are in flat arrays: the driver holds no lists of words.
    number: dict[str, int] = {}
    flat, sizes, y = array("i"), array("i"), array("f")
    for text, label in zip(texts, labels):
        found = words_of(text)
        if found:
            flat.extend([number.setdefault(w, len(number)) for w in found])
            sizes.append(len(found))
            y.append(label)
    if len(set(y)) < 2:
        p = (float(np.mean(labels)) if labels else 0.0) * 0.98 + 0.01
        return ToxicityModel(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    grams, gram_sizes = array("i"), array("i")
    for w in number:
        found = subwords(w)
        grams.extend(found)
        gram_sizes.append(len(found))
    n_words = len(number)
    del number
    flat, sizes, y = np.frombuffer(flat, np.int32), np.frombuffer(sizes, np.int32).astype(np.int64), np.frombuffer(y, np.float32)
    gram_sums = _Sums(np.frombuffer(grams, np.int32), np.frombuffer(gram_sizes, np.int32).astype(np.int64), BUCKETS)
    offsets = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    whole = _Sums(flat, sizes, n_words)
    starts = [window_starts(int(n)) for n in sizes]
    of = np.repeat(np.arange(sizes.size), [s.size for s in starts])
    lo = np.concatenate([o + s for o, s in zip(offsets, starts)])
    hi = np.concatenate([o + np.minimum(s + WINDOW, n) for o, s, n in zip(offsets, starts, sizes)])
    first = np.concatenate(([0], np.cumsum([s.size for s in starts])[:-1]))
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.array([1.0, -1.0], np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    weight = np.where(y == 1, 0.5 / max(1e-6, y.mean()), 0.5 / max(1e-6, 1 - y.mean())) ** 0.5
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    for step in range(1, steps + 1):
        grams, bags = gram_sums, whole
        if step > warm:
            word_odds = gram_sums.mean(params[0] @ (params[1][:, 1:] - params[1][:, :1]))[:, 0]
            total = np.concatenate(([0.0], np.cumsum(word_odds[flat], dtype=np.float64)))
            odds = (total[hi] - total[lo]) / (hi - lo)
            best = np.flatnonzero(odds == np.maximum.reduceat(odds, first)[of])
            best = best[np.unique(of[best], return_index=True)[1]]
            used, index = np.unique(np.concatenate([flat[a:b] for a, b in zip(lo[best], hi[best])]), return_inverse=True)
            grams, bags = gram_sums.only(used), _Sums(index, hi[best] - lo[best], used.size)
        vectors = grams.mean(params[0])
        x = bags.mean(vectors)
        z = x @ params[1] + params[2]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - np.stack((1 - y, y), axis=1)) * weight
        grads = [grams.gradient(bags.gradient(g @ params[1].T)) + decay * params[0], x.T @ g, g.sum(axis=0)]
        for q, d, (m, v) in zip(params, grads, moments):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ToxicityModel((params[0] @ (params[1][:, 1] - params[1][:, 0])).astype(np.float64), float(params[2][1] - params[2][0]))


def held_out() -> F.Column:
    """Rows that training never sees: crc32 of the id as text is a multiple of five; a null id is none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES, total_bytes: int = TRAIN_TOTAL) -> ToxicityModel:
    """Fit on the first ``rows`` labelled rows in the order of a hash of their id, without those held out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    text = docs.select(F.col("doc_id").cast("long").alias("of"), F.col("text").cast("string").alias("text")).filter(F.octet_length("text") <= most_bytes)
    # At most ``rows`` ids of 12 bytes are broadcast, and as many texts are summed up.
    sample = text.join(F.broadcast(chosen), F.col("of") == F.col("doc_id")).select("doc_id", "toxic", "text").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows)
    upto = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    sample = sample.withColumn("upto", upto).filter(F.col("upto") <= total_bytes).select("toxic", "text").collect()
    model = fit([r.text for r in sample], [r.toxic for r in sample])
    del sample
    give_back()
    return model


def _scorer(docs: DataFrame, labels: DataFrame, rows: int) -> Callable[[], ToxicityModel]:
    """Train; what gives the model in a task."""
    model = train(docs, labels, rows)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    name = uuid.uuid4().hex
    return lambda: per_worker(("toxicity", name), lambda: ToxicityModel(shared.value[0].astype(np.float64), shared.value[1]))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, each by its own text, whatever its doc_id; see ``score_toxicity``."""
    model = _scorer(docs, labels, rows)

    def make() -> Callable[[list[str | None]], list[bool]]:
        own = model()
        return lambda texts: [own.score(t) < threshold for t in texts]

    return filter_rows(docs, make)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on) of every row of ``docs`` (doc_id, text).

    Only texts enter a score. A null or empty text, or one without word characters, gets the empty bag's score. Without
    labels of both classes the score is the share of toxic labels, kept off 0 and 1. Labels whose class is null or whose
    document is missing are left out; rows that repeat a doc_id are scored one by one; other columns are left."""
    model, schema = _scorer(docs, labels, rows), pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model()
        for batch in pieces(batches):
            yield from batches_of(schema, [batch.column("doc_id"), [own.score(t) for t in batch.column("text").to_pylist()]])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
