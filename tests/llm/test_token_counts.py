import math
import random
import struct

from tidemark.llm import token_counts as t
from tidemark.llm.queries import piece_vocabulary


def brute(word, scores):
    byte = min(scores.values()) - t.BYTE_PENALTY
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + scores[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in scores]
        n = len(word[end - 1].encode())
        best.append(max(options, key=lambda o: o[0]) if options else (best[end - 1][0] + n * byte, best[end - 1][1] + n))
    return best[-1][1]


def test_matches_segmentation_word_by_word(spark):
    rng = random.Random(1)
    scores = t.unigram_scores(piece_vocabulary())
    words = ["".join(rng.choice(["th", "e", "ing", "é", "日", "q", "x", "st", "\U0001f600"]) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    rows = [(None, None), (1, ""), (2, " \t"), (3, "a" * 3000), (3, "the the\nthe"), (4, " ".join(words)), (5, "\t".join(words[::-1]))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_tokens string").repartition(2)
    got = sorted(map(tuple, t.count_tokens(docs, piece_vocabulary()).collect()), key=repr)
    want = sorted(((i, len((x or "").split()), sum(brute(t.MARK + w, scores) for w in (x or "").split())) for i, x in rows), key=repr)
    assert got == want
    assert t.count_tokens(docs.limit(0), piece_vocabulary()).count() == 0


def test_prefixes_are_computed_once():
    scores = {"▁": -1.0, "a": -2.0, "ab": -2.5, "b": -2.0}
    words = sorted("▁" + w for w in ("a", "ab", "abc", "abd", "b"))
    trie = t.PrefixTrie(scores)
    for w in words:
        assert trie.count(w) == brute(w, scores)
    assert trie.nodes == len({w[:n] for w in words for n in range(1, len(w) + 1)})
    assert math.isfinite(trie.byte)


def unigram_file(path, pieces):
    """A sentencepiece unigram model, field by field: pieces with scores, the trainer's kind of model, no normalisation."""
    field = lambda n, data: bytes([n << 3 | 2, len(data)]) + data
    piece = lambda text, score, kind: field(1, field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + bytes([3 << 3, kind]))
    model = piece("<unk>", 0.0, 2) + b"".join(piece(p, s, 1) for p, s in pieces.items())
    path.write_bytes(model + field(2, bytes([3 << 3, 1])) + field(3, field(1, b"identity")))
    return str(path)


def test_a_unigram_model_counts_as_its_own_library_does(spark, tmp_path):
    import sentencepiece

    rng = random.Random(3)
    texts = ["▁", *"abcdeé", *sorted({"".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 5))) for _ in range(150)}), *sorted({"▁" + "".join(rng.choice("abcde") for _ in range(rng.randint(1, 3))) for _ in range(60)})]
    model = unigram_file(tmp_path / "unigram.model", {p: -rng.uniform(2, 12) for p in texts})
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 25))) for _ in range(2000)]
    rows = [(i, " ".join(words[i * 20 : i * 20 + 20])) for i in range(100)]
    got = {r.doc_id: r.n_tokens for r in t.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), model).collect()}
    assert got == {i: sum(len(library.encode(w)) for w in x.split()) for i, x in rows}
