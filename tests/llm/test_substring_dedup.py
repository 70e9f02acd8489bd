import random

import pytest

from tidemark.llm import substring_dedup as s


def brute(rows, least):
    seen, keep = {}, []
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0))
    texts = [[x for x in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if x] for _, t in rows]
    out = [None] * len(rows)
    for r in order:
        w, gone = texts[r], set()
        for i in range(len(w) - least + 1):
            key = tuple(w[i : i + least])
            if key in seen:
                gone.update(range(i, i + least))
            else:
                seen[key] = (r, i)
        out[r] = (rows[r][0], " ".join(x for j, x in enumerate(w) if j not in gone), len(w), len(gone))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 70))] for _ in range(6)]
    rows = [(None, "a b c"), (-5, None), (-4, ""), (-3, " \n\t ")]
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = list(rng.choice(passages)) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = rng.choice(vocabulary)
            a, b = sorted((rng.randrange(len(p) + 1), rng.randrange(len(p) + 1)))
            parts += p if rng.random() < 0.5 else p[a:b]
        rows.append((rng.randrange(10**6), rng.choice([" ", "  ", "\n"]).join(parts)))
    rows.append((2_000_000, "same " * 90))
    rows.append((2_000_001, "x y " * 45))
    rows.append((2_000_002, rows[-1][1]))
    return rows


@pytest.mark.parametrize("seed,shard", [(1, 1000), (2, 1000), (3, 1), (4, 3)])
def test_matches_brute_force(spark, seed, shard):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int").repartition(3)
    for least in (20, 7):
        got = sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in s.dedup_substrings(docs, least, shard).collect()), key=repr)
        assert got == brute(rows, least)


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(7, text), (7, text), (8, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in s.dedup_substrings(docs).collect())
    assert got == [(7, 0), (7, 0), (8, 30)]
    assert s.dedup_substrings(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [1000, 1])
def test_repeated_rows_beside_a_partial_overlap(spark, shard):
    text = [f"t{i}" for i in range(60)]
    rows = [(7, " ".join(text))] * 3 + [(8, " ".join([*(f"a{i}" for i in range(9)), *text[3:40], *(f"b{i}" for i in range(9))]))]
    got = sorted(map(tuple, s.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), shard_segments=shard).collect()))
    assert got == [(7, rows[0][1], 60, 0)] * 3 + [(8, " ".join([f"a{i}" for i in range(9)] + [f"b{i}" for i in range(9)]), 55, 37)]


def test_automaton_statistics():
    rng = random.Random(5)
    a = s.SuffixAutomaton()
    known = [[rng.choice("ab c".split() + ["d"]) for _ in range(30)] for _ in range(8)]
    for k in known:
        a.add(k)
    runs = {tuple(k[i:j]) for k in known for i in range(30) for j in range(i + 1, 31)}
    q = [rng.choice(["ab", "c", "d", "zz"]) for _ in range(200)]
    assert a.statistics(q) == [max([n for n in range(e + 2) if n == 0 or tuple(q[e + 1 - n : e + 1]) in runs]) for e in range(200)]


def test_against_reference(spark):
    rng = random.Random(6)
    reference = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(6)]
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(10)) + " " + " ".join(rng.choice(reference).split()[5:25])) for i in range(20)]
    least = 8
    windows = {tuple(t.split()[i : i + least]) for t in reference for i in range(len(t.split()) - least + 1)}
    want = []
    for i, t in rows:
        w = t.split()
        gone = {j for k in range(len(w) - least + 1) if tuple(w[k : k + least]) in windows for j in range(k, k + least)}
        want.append((i, " ".join(x for j, x in enumerate(w) if j not in gone), len(w), len(gone)))
    docs, ref = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in reference], "text string")
    for shard_words in (30, 10_000):
        assert sorted(map(tuple, s.dedup_against(docs, ref, least, shard_words).collect())) == want
