import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash


def brute_fp(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    w = [x for x in lower.split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    name = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            name[c] = min(name.get(c, i), i)
    return sorted(((i, f, name.get(c)) for (i, _), f, c in zip(rows, fps, comp)), key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(None, None), (50, ""), (51, " \n"), (52, "One"), (53, "one two"), (53, "one two")]
    for i in range(100, 160):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for j in range(rng.randint(1, 4)):
            base[rng.randrange(120)] = f"x{j}"
            rows.append((i * 10 + j, "  ".join(base)))
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, fp string").repartition(3)
    for size in (4096, 1):
        got = simhash.simhash_components(docs, list_size=size).collect()
        assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=repr) == brute(rows)


def test_empty_table(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("size", [4096, 30])
def test_links_keep_connectivity_of_a_dense_group(spark, size):
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 62), 1 << 62)
    fps = {int(base)}
    for _ in range(600):
        x = int(base)
        for b in rng.integers(0, 63, rng.integers(0, 8)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(f, [f]) for f in fps], "node long, fps array<long>"), size)
    got = {r.node: r.component for r in simhash.connected_components(edges).collect()}
    comp = {f: f for f in fps}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and comp[a] != comp[b]:
                lo, hi = sorted((comp[a], comp[b]))
                comp = {k: lo if c == hi else c for k, c in comp.items()}
    assert {f: got.get(f, f) for f in fps} == comp
    assert edges.count() < 40 * len(fps)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)]
    got = {r.node: r.component for r in simhash.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1100)}}


def test_similar_groups(spark):
    """Clear copies meet, clear strangers do not: the groups of brute force over shingle sets, away from the threshold."""
    rng = random.Random(7)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = [(None, None), (1, ""), (2, " "), (3, "short text"), (4, "Short  text"), (4, "short text")]
    for i in range(60):
        base = say(rng.randint(150, 600))
        rows.append((100 + i * 10, " ".join(base)))
        for j in range(1, 4):
            copy = list(base)
            if j == 1:
                copy[rng.randrange(len(copy))] = "NEW"
            elif j == 2:
                copy = copy[len(copy) // 2 :] + say(len(copy) // 2)
            rows.append((100 + i * 10 + j, "\n".join(copy)))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = {3: 3, 4: 3} | {100 + i * 10 + j: 100 + i * 10 + (j == 2) * 2 for i in range(60) for j in range(4)}
    assert got == want
    assert simhash.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shingles_of(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def exact_groups(rows):
    sets = {i: shingles_of(t) for i, t in rows}
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and group[i] != group[j]:
                if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                    lo, hi = sorted((group[i], group[j]))
                    group = {k: lo if g == hi else g for k, g in group.items()}
    return group


def tails(rng, n):
    """Texts, each with three copies whose ends are cut, appended to or replaced, to 0.8 to 0.92 of exact similarity and a bit below."""
    rows = []
    for i in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(100, 600))]
        new = [f"n{rng.randrange(5000)}" for _ in range(len(base))]
        k = int(len(base) * rng.uniform(0.08, 0.21))
        rows += [(10 * i, base), (10 * i + 1, base[:-k]), (10 * i + 2, base + new[:k]), (10 * i + 3, base[: -k // 2] + new[: k // 2])]
    return [(i, " ".join(w)) for i, w in rows]


def groups(spark, rows, **kw):
    return {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **kw).collect()}


def test_similar_groups_finds_changed_ends(spark):
    rows = tails(random.Random(11), 60)
    assert groups(spark, rows) == exact_groups(rows)


def test_similar_groups_are_exact_at_the_threshold(spark):
    """Pairs with scattered changes, of an exact similarity from 0.7 to 0.9: those up to 0.8 meet and the others do not."""
    rng, rows = random.Random(12), []
    for i in range(150):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(100, 500))]
        copy = list(base)
        for at in rng.sample(range(0, len(base), 5), int(len(base) * rng.uniform(0.011, 0.034))):
            copy[at] = "n"
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(copy))]
    want = exact_groups(rows)
    assert 30 < sum(i != g for i, g in want.items()) < 120
    assert groups(spark, rows) == want


def test_similar_groups_of_many_near_copies(spark):
    """One large group whose members differ: no block of a list is much over its size, and components are those of brute force."""
    rng, base = random.Random(13), [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        copy = list(base)
        for at in rng.sample(range(0, 120, 5), rng.randint(0, 5)):
            copy[at] = f"n{rng.randrange(3)}"
        rows.append((i, " ".join(copy)))
    assert groups(spark, rows, list_size=16) == exact_groups(rows)
    posted = spark.createDataFrame([(1, i, 0) for i in range(400)], "w long, node long, low long")
    parts = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(400)], "node long, component long")
    blocks = simhash.blocks(posted, parts, 40).groupBy("w", "task").count().collect()
    assert len(blocks) > 10 and max(r["count"] for r in blocks) <= 80


def test_similar_groups_index_fingerprints_by_positional_bytes(spark):
    """A text's fingerprints are SimHashes of its shingles and of samples of them. Pairs of the lists are those that share 7 of 8
    positional bytes and differ in at most 3 bits in some fingerprint of the same number."""
    rng = np.random.default_rng(6)
    shingles = np.unique(rng.integers(-(1 << 62), 1 << 62, 70_000))
    samples = simhash.sampled(shingles)
    assert samples.shape == (simhash.SAMPLES, simhash.SAMPLE) and np.isin(samples.view(np.int64), shingles).all()
    hashes = [shingles.view(np.uint64).tolist(), *samples.tolist()]
    want = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) for h in hashes]
    assert simhash.set_fingerprints(shingles).view(np.uint64).tolist() == want

    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 5)]
    one = [[base[0], base[1]], [base[0] ^ 0b1011, 7], [base[0] ^ 0b1111, 8], [base[0] ^ 0b100000001, 9], [10, base[1] ^ (5 << 40)], [base[1], 11], [base[2] ^ (7 << 56), 12], [base[2], 13]]
    fps = np.array(one)
    near = lambda x: (np.array([x]).view(np.uint8) == 0).sum() >= 7 and int(x & (1 << 64) - 1).bit_count() <= 3
    pairs = {(a, b) for a in range(len(one)) for b in range(a + 1, len(one)) if any(near(x) for x in (fps[a] ^ fps[b]).tolist())}
    posted = simhash.half_lists(spark.createDataFrame(list(enumerate(one)), "node long, fps array<long>"))
    stars = {tuple(r) for r in simhash.star_pairs(posted).collect()}
    size, bits = np.full(len(one), 9), np.zeros((len(one), simhash.WIDE), np.int64)
    crossed = {tuple(sorted(p)) for nth in (0, 1) for half in (0, 1) for p in simhash.cross_pairs(fps[:, nth], half, np.arange(len(one)), size, bits, None, 0.8)}
    assert len(pairs) >= 3 and stars <= pairs == crossed
