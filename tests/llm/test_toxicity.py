import random
import zlib

import numpy as np
import pytest

from tidemark.llm import toxicity

BAD = ["idiot", "stupid", "worthless", "pathetic", "moron"]


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "er", "th", "on", "ti", "ou", "re", "ha", "ed", "st"]
    rows = []
    for i in range(n):
        w = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 200))]
        toxic = int(rng.random() < 0.3)
        for _ in range(rng.randint(2, 4) * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w), toxic))
    return rows


def test_held_out_accuracy_and_misspellings(spark):
    rows = corpus(700, 1) + [(10_000, None, 0), (10_001, "", 0), (10_002, "...", 0), (10_003, "x" * 50_000, 0), (None, "an er", 0)]
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t, _ in rows], "doc_id long, text string, lang string, score double").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:700]] + [(None, 1), (5, None), (99_999, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got if i is not None) and not got[None].held_out
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[i].predicted, y) for i, _, y in rows[:700] if got[i].held_out]
    assert len(held) > 80 and np.mean([p == y for p, y in held]) > 0.93
    assert got[10_000].score == got[10_001].score == got[10_002].score < 0.5
    model = toxicity.fit([t for _, t, _ in rows[:500]], [y for _, _, y in rows[:500]])
    clean = " ".join(["tian", "on", "thed", "anre"] * 8)
    assert model.score(f"{clean} stuupid {clean}") > 2 * model.score(f"{clean} tianth {clean}")
    long = " ".join([clean] * 300)
    assert model.score(f"{long} you idiot moron {long}") > 0.5 > model.score(long)


def test_training_ignores_held_out_labels(spark):
    rows = corpus(300, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    a = toxicity.score_toxicity(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = toxicity.score_toxicity(docs, spark.createDataFrame(flip, "doc_id long, toxic int"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1), (2, 1)]])
def test_without_both_classes(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len({r.score for r in got}) == 1 and 0 < got[0].score < 1
    assert toxicity.score_toxicity(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_gradient():
    rng = np.random.default_rng(3)
    index, sizes = rng.integers(0, 7, 12), np.array([3, 4, 5])
    s = toxicity._Sums(index, sizes, 7)
    x, g = rng.normal(size=(7, 2)).astype(np.float32), rng.normal(size=(3, 2)).astype(np.float32)
    dense = np.zeros((3, 7))
    for row, (lo, hi) in enumerate(((0, 3), (3, 7), (7, 12))):
        for k in index[lo:hi]:
            dense[row, k] += 1 / (hi - lo)
    assert np.allclose(s.mean(x), dense @ x, atol=1e-5) and np.allclose(s.gradient(g), dense.T @ g, atol=1e-5)
    assert np.allclose(s.only(np.array([2, 0])).mean(x), (dense @ x)[[2, 0]], atol=1e-5)


def test_scores_match_a_plain_computation(spark):
    """Each score again, gram by gram and window by window."""
    rows = corpus(200, 4) + [(900, None, 0), (901, "", 0), (902, "é" * 300 + " idiot", 0), (903, " ".join(["an"] * 36), 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:200]], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    weights = model.weights.astype(np.float32).astype(np.float64)

    def odds(word):
        marked = "<" + word + ">"
        grams = [marked[i : i + n] for n in (3, 4) for i in range(len(marked)) if i == 0 or i + n <= len(marked)]
        return sum(weights[zlib.crc32(g.encode()) % toxicity.BUCKETS] for g in grams) / len(grams)

    def score(text):
        words = toxicity.words_of(text)
        bags = [words[i : i + 24] for i in range(0, max(1, len(words) - 12), 12)] if words else []
        best = max((sum(map(odds, b)) / len(b) for b in bags), default=0.0) + model.bias
        return 1 / (1 + np.exp(-best))

    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all(abs(got[i] - score(t)) < 1e-6 for i, t, _ in rows)


def test_long_words_are_read_whole():
    rows = corpus(500, 1)
    model = toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    assert model.score("a" * 64 + "idiot") != model.score("a" * 64 + "peace")
    clean = "_".join(["tian", "on", "thed", "anre"] * 30)
    assert model.score(f"{clean}_stupid_idiot_moron_worthless_pathetic_idiot_{clean}") > 1.5 * model.score(f"{clean}_{clean}")
    assert "".join(p[:16] for p in toxicity.words_of("abcdefgh" * 40)).startswith("abcdefgh" * 38)


def test_training_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "word " * 100) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    seen = []
    fit, toxicity.fit = toxicity.fit, lambda texts, y: seen.append(texts)
    try:
        toxicity.train(docs, labels, total_bytes=3000)
    finally:
        toxicity.fit = fit
    assert 0 < sum(map(len, seen[0])) <= 3000
