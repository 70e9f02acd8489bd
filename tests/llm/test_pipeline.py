import random

import corpus_pipeline
from tidemark.llm import simhash


def test_stages_against_their_operators_and_brute_force(spark, tmp_path):
    """Each stage drops what brute force drops, and nothing else; run() gives the rows of the last."""


    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    bench = [(i, say(30)) for i in range(5)]
    rows = [(i, say(rng.randint(60, 300)), "en", f"s{i % 3}") for i in range(120)]
    toxic = {i: " idiot moron stupid idiot" for i in range(0, 60, 2)}
    rows = [(i, t + toxic.get(i, ""), a, b) for i, t, a, b in rows]
    rows += [(200 + i, rows[61 + 2 * i][1], "en", "s1") for i in range(5)]
    rows += [(300 + i, f"{say(50)} {bench[i][1]} {say(50)}", "en", "s0") for i in range(5)]
    rows += [(400, None, "en", "s0"), (401, "", None, None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 0, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = [tuple(r) for r in docs.collect()]
        assert name == "token_files" or docs.columns == columns

    ids = {name: {r[0] for r in o} for name, o in out.items()}
    assert ids["toxicity"] == {r[0] for r in rows} - set(toxic)
    kept = {r[0]: r[1] for r in out["toxicity"]}
    sets = {i: shingles_of(t) for i, t in kept.items()}
    assert ids["near_duplicates"] == {i for i in kept if not any(j < i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in kept)}
    assert not ids["near_duplicates"] & set(range(200, 205))
    assert ids["decontamination"] == ids["near_duplicates"] - set(range(300, 305))
    assert len(out["token_files"]) == len(out["mixing"]) > 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(out["token_files"])


def shingles_of(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def tables(spark, folder, docs, bench=(), labels=()):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, id string, score int, node int, row string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(bench), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def row(i, text, source="s"):
    return (i, text, "en", source, None, "x", 1, None, "r")


def test_repeated_and_null_ids_and_clashing_columns(spark, tmp_path):
    """Each row is judged by its own text: rows that share an id, or have none, do not go with one another."""
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    clean, other, third, copied, item = (say(60) for _ in range(5))
    bad = "you stupid idiot moron stupid idiot " * 3
    labelled = [row(1000 + i, say(40) + (" stupid idiot moron idiot" if i % 2 else "")) for i in range(80)]
    rows = [row(7, clean), row(7, bad), row(None, other), row(None, bad), row(8, third), row(8, item), row(None, f"{third} x"), row(9, copied), row(9, copied), row(9, copied), row(None, None), row(5, ""), row(5, "")]
    docs = tables(spark, tmp_path, rows + labelled, [(1, item)], [(1000 + i, 0, i % 2) for i in range(80)])
    mine = lambda df: sorted(((r.doc_id, r.text) for r in df.collect() if r.doc_id is None or r.doc_id < 1000), key=repr)
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and mine(kept) == sorted([(r[0], r[1]) for r in rows if r[1] != bad], key=repr)
    near = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    assert mine(near) == sorted([(7, clean), (7, bad), (None, other), (8, third), (8, item), (9, copied), (None, None), (5, ""), (5, "")], key=repr)
    leaks = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert leaks.columns == docs.columns and mine(leaks) == sorted([(r[0], r[1]) for r in rows if r[1] != item], key=repr)
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.count() > 0


def test_empty_tables(spark, tmp_path):
    docs = tables(spark, tmp_path, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_of_planted_pairs_by_brute_force(spark, tmp_path):
    """1200 documents with copies of a similarity from 0.8 on: recall and precision over pairs of different texts, by brute force."""
    rng = random.Random(21)
    rows = []
    for i in range(400):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(80, 300))]
        k = max(1, int(len(base) * rng.uniform(0.0, 0.16)))
        spread = list(base)
        for at in rng.sample(range(len(base)), max(1, int(len(base) * rng.uniform(0, 0.022)))):
            spread[at] = "changed"
        rows += [row(10 * i, " ".join(base)), row(10 * i + 1, " ".join(base[:-k])), row(10 * i + 2, " ".join(spread))]
    docs = tables(spark, tmp_path, rows)
    sets = {r[0]: shingles_of(r[1]) for r in rows}
    pairs = [(a, b) for i in range(400) for a in range(10 * i, 10 * i + 3) for b in range(10 * i, a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    found = sum(group[a] == group[b] for a, b in pairs)
    assert len(pairs) > 600 and found == len(pairs)
    linked = {i for p in pairs for i in p}
    assert all(group[i] == i for i in group if i not in linked)
    assert {r.doc_id for r in simhash.drop_similar(docs).collect()} == set(group.values())
