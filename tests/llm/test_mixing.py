import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def water(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {s: 0.0 for s in order}, share * sum(sizes.values()), set(order)
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total >= most * sizes[s]}
        if not full:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def corpus(seed, n=300):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["b", "a", "é", "Z", None, "a"]), " ".join(f"t{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(n)]
    return rows + [(None, "a", "x y"), (3, "b", None), (5, "a", "one two"), (5, "a", "one two"), (7, "only blank", " \t\n")]


@pytest.mark.parametrize("seed", [1, 2])
def test_plan(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, source string, text string, target string").repartition(3)
    got = mixing.plan_mix(docs, levels=4, block_docs=4).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    taken, blocks, shards = {}, {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == sum(x.words for x in r.draws) <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        for x in r.draws:
            blocks.setdefault((r.source, x.block), set()).add(x.shard)
            shards[x.shard] = shards.get(x.shard, 0) + 1
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert all(len(s) == 1 for s in blocks.values())
    assert max(shards) < 16
    again = mixing.plan_mix(docs.repartition(5), levels=4, block_docs=4).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mix_rows(spark):
    rows = corpus(3, 80)
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, s, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    plan = mixing.plan_mix(docs).select("doc_id", F.explode("draws").alias("d")).select("doc_id", "d.words").collect()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = [(r.doc_id, len(re.findall(mixing.WORD, r.text))) for r in mixed.collect()]
    assert sorted(got, key=repr) == sorted(map(tuple, plan), key=repr)


def test_empty_and_wordless(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.plan_mix(spark.createDataFrame([], schema)).count() == 0
    (r,) = mixing.plan_mix(spark.createDataFrame([(1, "a", " ")], schema)).collect()
    assert (r.size, r.target, r.taken, r.draws) == (0, 0.0, 0, [])


def test_quotas_are_exact_and_hypergeometric(spark):
    quota = [40, 0, 7, 100, 1]
    shards = mixing.split_quotas(spark.createDataFrame([(quota,)], "quota array<long>"), 3).collect()
    assert [sum(c) for c in zip(*(s.quota for s in shards))] == quota
    assert max(sum(s.quota) for s in shards) - min(sum(s.quota) for s in shards) <= 1
    u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    for total, good, drawn in ((50, 20, 25), (1000, 30, 400), (10, 10, 4), (9, 0, 5), (5000, 2500, 2500)):
        x = [r[0] for r in u.select(mixing.hypergeometric(F.lit(total), F.lit(good), F.lit(drawn), F.col("u"))).collect()]
        mean, p = sum(x) / len(x), good / total
        var = drawn * p * (1 - p) * (total - drawn) / max(1, total - 1)
        assert mean == pytest.approx(drawn * p, abs=0.02 + var**0.5 / 30)
        assert sum((v - mean) ** 2 for v in x) / len(x) == pytest.approx(var, rel=0.05, abs=0.01)
        assert max(0, drawn + good - total) <= min(x) and max(x) <= min(good, drawn)


def test_shards_follow_the_size():
    assert [mixing.shard_levels(n) for n in (0, 10**6, 10**9, 10**13)] == [2, 2, 9, 23]


def test_many_sources(spark):
    """More sources than one array holds: every source gets its target, shards their sizes, and blocks one shard each."""
    rng = random.Random(8)
    rows = [(i, f"s{rng.randrange(700):03d}" if i % 50 else None, "w " * rng.randint(1, 60)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = mixing.plan_mix(docs, levels=3, block_docs=2).collect()
    sizes, taken, blocks, shards = {}, {}, {}, {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    assert len(got) == len(rows) and len(sizes) > 600
    want = water(sizes)
    for r in got:
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
        for x in r.draws:
            blocks.setdefault((r.source, x.block), set()).add(x.shard)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert all(len(s) == 1 and None not in s for s in blocks.values())
    for (_, _), s in blocks.items():
        shards[min(s)] = shards.get(min(s), 0) + 1
    assert set(shards) == set(range(8)) and max(shards.values()) - min(shards.values()) < 0.1 * sum(shards.values())


def test_query_columns(spark, tmp_path):
    from tidemark.llm.queries import op1_mix_sources

    rows = corpus(4)
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, mix_id int").write.parquet(f"{tmp_path}/documents.parquet")
    got = op1_mix_sources(spark, str(tmp_path)).collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = sorted(((i, len((t or "").split()), sizes[s]) for i, s, t in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.source_size) for r in got), key=repr) == want
    assert abs(sum(r.taken for r in got) - 1.5 * sum(sizes.values())) <= 2 * len(sizes) and all(0 <= r.taken <= 2 * r.size for r in got)
