import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
LONG = "a line that is certainly longer than forty characters"


def brute(rows, min_docs=5, min_chars=40):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    holders, last = defaultdict(set), {}
    low = lambda i: (-1, 0) if i is None else (0, i)
    for n, (i, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(n)
                last[key(line)] = max(last.get(key(line), low(None)), low(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or last[key(x)] == low(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


CASES = [
    [],
    [(None, None), (1, ""), (2, "\n\n")],
    [(i, f"{LONG}\nown {i}") for i in range(7)],
    [(i, f"  {LONG.upper()}\t\n{LONG}\n{LONG}") for i in range(4)] + [(9, LONG), (9, LONG), (None, LONG)],
    [(None, LONG)] * 6,
    [(i, "é" * 39 + "\n" + "é" * 40 + "\n" + "x" * 5000) for i in range(5)],
    [(i, " " + LONG) for i in range(5)] + [(i, LONG) for i in range(5, 9)],
    [(None, LONG)] * 4 + [(-(1 << 63), LONG), (-(1 << 63), f"{LONG}\nx")],
    [(i, "\n".join([LONG * 2000, f"{i} " * 9000, LONG])) for i in range(6)],
]


@pytest.mark.parametrize("rows", CASES)
def test_matches_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_lines int")
    got = sorted(map(tuple, line_dedup.dedup_lines(docs, shard_keys=2).collect()), key=repr)
    assert got == brute(rows)


def test_perfect_hash_is_minimal_and_survives_bytes():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(0, 1 << 63, 5000, dtype=np.int64).view(np.uint64) for _ in range(2))
    h1[:10] = h1[0]
    assert sorted(line_dedup.PerfectHash.build(h1, h2).numbers(h1, h2)) == list(range(5000))
    shard = line_dedup.LineShard.from_bytes(line_dedup.LineShard.build(h1, h2, np.arange(5000), np.arange(5000), np.arange(5000) % 2 == 0).to_bytes())
    found, counts, last, known = shard.probe(h1, h2)
    assert (known == (np.arange(5000) % 2 == 0)).all() and shard.index.bits.nbytes + shard.index.rank.nbytes < 5000
    assert found.all() and (counts == np.arange(5000)).all() and (last == np.arange(5000)).all()
    assert not shard.probe(h2, h1)[0].any()


def test_sha_of_kept_text(spark):
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert hashlib.sha256(got["text"].encode()).hexdigest() == hashlib.sha256(b"").hexdigest()


def test_a_lost_shard_is_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(i, LONG) for i in range(6)], "doc_id long, text string")
    folder, n, present = line_dedup.build_line_index(docs)
    shards = line_dedup._Shards(folder, present)
    assert n == 1 and present == {0} and shards.get(0).counts.tolist() == [6] and shards.get(5) is None
    with pytest.raises(FileNotFoundError):
        line_dedup._Shards(str(tmp_path), present).get(0)
