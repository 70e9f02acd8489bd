import math
import random

import numpy as np
import pytest

from tidemark.llm import topk


def brute(rows, k=5, every=50):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in dict((i, v) for i, v in sorted(good, reverse=True) if i % every == 0).items():
        found = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b)))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("n,dim,block", [(400, 8, 20), (130, 3, 1000), (4, 2, 1000), (0, 2, 1000)])
def test_matches_brute_force(spark, n, dim, block):
    rng = random.Random(n)
    rows = [(i, [float(np.float32(rng.choice([rng.gauss(0, 1), 0.0, 0.5, -0.25]))) for _ in range(dim)]) for i in range(n)]
    rows += [(i + 1000, rows[0][1]) for i in range(8) if n] + [(None, [1.0] * dim), (2000, None), (2050, [None] * dim), (2100, [math.nan] * dim), (2101, [math.inf] * dim), (2150, [1.0] * (dim + 1)), (2151, [2.0] * (dim + 1)), (2200, [])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    assert sorted(map(tuple, topk.top_k(vectors, query_values=block, candidate_values=10 * block).collect())) == brute(rows)


def test_large_values_and_repeated_ids_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([100_000.0, 65_535.99, -1e6, 3.0, 0.004]) * rng.random() for _ in range(6)]) for i in range(120)]
    rows += [(0, [100_000.0, 1.0, 0.0, 0.0, 0.0, 0.0]), (0, [-5.0] * 6), (50, [7.0] * 6), (301, [100_000.0, 1.0, 0.0, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    assert sorted(map(tuple, topk.top_k(vectors).collect())) == brute(rows)
    a = topk.whole_numbers(np.array([100_000.0, 1.0]))
    assert topk.inner_products(a, a[None, :]) == [655_360_000_065_536]
    with pytest.raises(OverflowError):
        topk.inner_products(np.array([1e300]), np.array([[1e300]]))


def test_reading_stops_early_without_losing_any():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 30, (3000, 16)).round()
    x[:, 0] += (np.arange(3000) < 40) * 3000
    lists = topk.SortedLists(np.arange(3000), x)
    for own in range(0, 60, 7):
        exact = x @ x[own]
        found, depth = lists.search(x[own], 5, own)
        want = sorted((-int(exact[i]), i) for i in range(3000) if i != own)[:5]
        assert [(-s, i) for s, i in found] == want
        assert own >= 40 or depth < 2000
        again, _ = lists.search(x[own], 5, own, least=-want[2][0])
        assert [(-s, i) for s, i in again] == [w for w in want if w[0] <= want[2][0]]


def test_any_lists_give_what_brute_force_gives():
    rng = np.random.default_rng(5)
    for n in (1, 2, 30, 400):
        for _ in range(15):
            x = np.floor(rng.choice([0.0, 1.0, -3.0, 500.0, 2.0**36], (n, 5)) * rng.normal(0, 1, (n, 5)))
            q = np.floor(rng.choice([0.0, 1.0, -3.0, 2.0**20], 5) * rng.normal(0, 2, 5))
            ids = rng.permutation(n)
            scores = topk.inner_products(q, x)
            want = sorted((-s, i) for s, i in zip(scores, ids.tolist()) if i != 0)[:3]
            assert [(-s, i) for s, i in topk.SortedLists(ids, x).search(q, 3, 0)[0]] == want


def test_a_score_reached_in_one_group_goes_on_to_the_others(spark, monkeypatch):
    """Tasks of all groups but the first begin with the k-th score found there, and with it lists are read less far."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 0.125, (1200, 16)).round(3)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    started, searched = [], topk._searched
    monkeypatch.setattr(topk, "_searched", lambda rows, asked, groups, blocks, k: started.append((groups, asked)) or searched(rows, asked, groups, blocks, k))
    got = sorted(map(tuple, topk.top_k(vectors, candidate_values=300 * 16).collect()))
    want = brute([(i, v.tolist()) for i, v in enumerate(x)])
    assert got == want and [g for g, _ in started] == [[0], [1, 2, 3]]
    last = {q: s for q, r, _, s in want if r == 5}
    least = {r.query_id: r.least for r in started[1][1].collect()}
    assert least.keys() == last.keys() and all(s is not None and s <= last[q] for q, s in least.items())
    v = topk.whole_numbers(x)
    lists = topk.SortedLists(np.arange(1200), v)
    depths = [(lists.search(v[q], 5, q)[1], lists.search(v[q], 5, q, least=s)[1]) for q, s in least.items()]
    assert all(b <= a for a, b in depths) and sum(b for _, b in depths) < sum(a for a, _ in depths)
