import math
import random
from collections import Counter

from tidemark.llm import decontaminate as d


def brute(docs, items):
    words = [(i, d.words_of(t)) for i, t in items]
    words = [(i, w) for i, w in words if len(w) >= d.MIN_WORDS]
    df = Counter(x for _, w in words for x in set(w))
    n, mean = len(words), sum(len(w) for _, w in words) / max(1, len(words))
    classes = {}
    for i, w in words:
        classes.setdefault(max(0, math.ceil(math.log2(len(w) / 64))), []).append((i, w))
    out = []
    for group in classes.values():
        cell = max(len(w) for _, w in group)
        for doc, text in docs:
            dw = d.words_of(text)
            for i, w in group:
                raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (d.K1 + 1) / (c + d.K1 * (1 - d.B + d.B * len(w) / mean)) for t, c in Counter(w).items()}
                own, best = sum(raw.values()), None
                for c in range(-(-len(dw) // cell)):
                    passage = dw[c * cell : (c + 2) * cell]
                    score = sum(raw[t] for t in set(passage) if t in raw) / own
                    q, a = d.split_item(w)
                    shares = (len(d.shingles(w) & d.shingles(passage)) / len(d.shingles(w)), len(set(q) & set(passage)) / len(set(q)), len(set(a) & set(passage)) / len(set(a)))
                    if score >= d.RETRIEVE and min(shares) >= d.OVERLAP and (best is None or (score, *shares) > best):
                        best = (score, *shares)
                if best:
                    out.append((doc, i, *(round(x, 6) for x in best)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([8, 15, 40, 60, 70, 150])))) for i in range(60)]
    items += [(100, items[0][1]), (None, " ".join(say(20))), (101, "too short"), (102, None), (103, ""), (104, " ".join(["the", "of"] * 10))]
    docs = [(None, items[3][1]), (1, None), (2, ""), (3, "the of " * 400)]
    for k in range(80):
        w = say(rng.randint(0, 300))
        for _ in range(rng.randint(0, 2)):
            p = (rng.choice(items)[1] or "").split()
            if rng.random() < 0.4 and p:
                for _ in range(rng.randint(1, 3)):
                    p[rng.randrange(len(p))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "," for x in p]
        docs.append((k + 10, " ".join(w)))
    return docs, items


def test_matches_brute_force(spark):
    docs, items = corpus()
    want = brute(docs, items)
    assert len(want) > 30
    a = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int").repartition(3)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    for size in (1000, 7):
        got = sorted(((r[0], r[1], *(round(x, 6) for x in r[2:])) for r in map(tuple, d.find_leaks(a, b, block_items=size).collect())), key=repr)
        assert got == want
    assert d.find_leaks(a, b.limit(0)).count() == 0 and d.find_leaks(a.limit(0), b).count() == 0


def test_wand_returns_all_above_threshold():
    _, items = corpus()
    found = [(i, d.words_of(t)) for i, t in items if len(d.words_of(t)) >= d.MIN_WORDS]
    df = Counter(x for _, w in found for x in set(w))
    index = d.Index(found, df, len(found), 40.0, retrieve=0.12)
    rng = random.Random(5)
    for _ in range(60):
        passage = sorted({rng.choice(rng.choice(found)[1]) for _ in range(rng.randint(1, 60))})
        scores = {}
        for t in passage:
            for k, x in zip(*index.postings[t][:2]):
                scores[k] = scores.get(k, 0) + x
        assert sorted(k for k, _ in index.search(passage)) == sorted(k for k, x in scores.items() if x >= 0.12 - 1e-9)


def test_short_items_are_found_word_for_word(spark):
    items = [(1, "Who wrote Faust?"), (2, "今天天气怎么样"), (3, "who wrote faust"), (4, "..."), (5, "wrote Faust in seven long years then")]
    docs = [(10, "He asked: who wrote Faust? Nobody knew."), (11, "Who had wrote Faust"), (12, "他问，今天天气怎么样？"), (13, None), (14, "wrote Faust in seven long years")]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    got = sorted(map(tuple, d.find_leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()))
    assert got == [(10, 1, 1.0, 1.0, 1.0, 1.0), (10, 3, 1.0, 1.0, 1.0, 1.0), (12, 2, 1.0, 1.0, 1.0, 1.0)]
