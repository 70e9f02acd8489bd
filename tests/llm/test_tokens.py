import numpy as np
import pytest

from tidemark.llm import tokens
from tidemark.llm.queries import byte_bpe


@pytest.mark.parametrize("ids", [[], [0], [5, 5, 5], list(range(70)), np.random.default_rng(2).integers(0, 50_257, 3000).tolist()])
def test_wavelet_matrix(ids):
    a = np.array(ids, np.uint32)
    shard = tokens.ShardFile.of(tokens.shard_bytes(a, [None, 7], [0, len(ids)]))
    w = shard.matrix()
    assert shard.doc_ids == [None, 7] and shard.lengths.tolist() == [0, len(ids)]
    assert w.decode().tolist() == ids
    for i in range(0, len(ids), max(1, len(ids) // 40)):
        t = ids[i]
        places = [j for j, x in enumerate(ids) if x == t]
        assert w.access(i) == t
        assert w.count(t) == len(places) and w.count(t, 0, i) == sum(j < i for j in places)
        assert w.find(t, len(places) - 1) == places[-1]
    assert w.count(60_000) == 0


TEXTS = ["", " ", "a b", "a  b", " lead", "trail ", "tab\t x", "line\n next\n\n  two", "don't stop, 'tis <|endoftext|> x", "é  ü x ", "1 2 33 a-b", None, "\x1c x \x1c", "word " * 3000 + "end", "y" * 20_000]


def test_matches_whole_text_encoding(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(byte_bpe())
    rows = [(100 - i, t, "en") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (100, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in tokens.tokenize(docs, byte_bpe(), shard_tokens=50).collect()]
    want, at = [], 0
    for i, t in sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, ids))
    assert sorted(((i, x) for i, _, x in got), key=repr) == sorted(want, key=repr)
    for i, start, ids in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += len(ids)
    order = [i for i, _, _ in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_empty_table(spark):
    assert tokens.tokenize(spark.createDataFrame([], "doc_id long, text string"), byte_bpe()).count() == 0


def test_access_reads_ranges_of_the_file(tmp_path):
    ids = np.random.default_rng(4).integers(0, 50_257, 1_500_000).astype(np.uint32)
    path = tmp_path / "a.tokens"
    path.write_bytes(tokens.shard_bytes(ids, [1], [ids.size]))
    shard = tokens.ShardFile.open(f"file://{path}")
    assert shard.matrix().access(1_234_567) == ids[1_234_567]
    assert shard.bytes_read < path.stat().st_size / 4
    some = int(ids[77])
    assert tokens.ShardFile.open(f"file://{path}").matrix().count(some, 0, 700_000) == int((ids[:700_000] == some).sum())
    assert tokens.ShardFile.open(f"file://{path}").matrix().find(some, 0) == int(np.flatnonzero(ids == some)[0])


def test_chunks_are_cut_where_whole_encoding_cuts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    plain, encoder, draw = Tokenizer.from_file(byte_bpe()), tokens.Encoder(byte_bpe()), np.random.default_rng(6)
    signs = ["a", "bc", "Z", "é", "ß", "İ", "ª", "µ", "×", "1", "٣", "²", "'", "'s", "’", "-", ".", ",", "###", "&", "(", ")", "_", "日本", "й", "\u0301", "\u200b", "😀", "ǅ", "ɏ", "ɐ", "\xa0", " ", " ", " ", "\n", "  ", "\t", "<|endoftext|>"]
    texts = ["".join(draw.choice(signs, draw.integers(0, 14))) for _ in range(9000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(pa.array(texts, pa.string()))]
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_query_columns(spark, tmp_path):
    import zlib

    from tokenizers import Tokenizer

    from tidemark.llm.queries import op3_token_files

    plain = Tokenizer.from_file(byte_bpe())
    rows = [(7, "one two."), (3, None), (5, "x  y\n"), (7, "one two.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, at = [], 0
    for i, t in sorted((i, t or "") for i, t in rows):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, ids.size, zlib.crc32(ids.tobytes())))
        at += ids.size
    assert sorted(tuple(r) for r in op3_token_files(spark, str(tmp_path)).collect()) == want
