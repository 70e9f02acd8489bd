"""SimHash near-dedup: 64-bit fingerprints, a byte-position inverted index with count filtering, connected components.

Fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they share at least 5 positional bytes.
Put the 8 positions in two groups of four: one group then holds at least 3 shared ones. The inverted index has a posting list
for each choice of three positions of a group and each value of these three bytes (8 lists for each fingerprint), so that
every such pair meets. In a list, members' shared positional bytes are tallied; pairs with at least 5 are verified by bits.

Only distinct fingerprints are indexed; copies follow theirs. A list gives a spanning forest of its links, never all pairs.
Lists over ``LIST_SIZE`` are split exactly: of the other 5 bytes at least 2 are shared, so each choice of 2 is a list of its own.

``similar_groups`` and ``drop_similar`` take the same steps for a similarity of shingle sets, in which the SimHash of whole texts
differs in about ten bits at 0.8. So a text has a fingerprint of its whole set and one of each of ``SAMPLES`` min-wise samples of it,
and the samples' often agree. There lists are of four positional bytes, and a pair is tallied and verified by bits, then by
exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, batches_of, free_name, materialize, pieces

#: Members of a posting list, above which it is split.
LIST_SIZE = 4096
MAX_BITS = 3
SEED = 42
#: Shingles hashed at once: bounds the memory for very long texts.
CHUNK = 1 << 16


def _mask(positions) -> int:
    m = sum(0xFF << 8 * p for p in positions)
    return m - (1 << 64) if m >> 63 else m


#: The three positions of each kind of list, and what its lists are split by.
KINDS = [tuple(p for p in group if p != left) for group in (range(4), range(4, 8)) for left in group]
SPLITS = [[pair for pair in combinations([p for p in range(8) if p not in kind], 2)] for kind in KINDS]


#: Of ``similar_groups``: 64-bit parts of the parity bits of the shingles.
WIDE = 16
#: Shingles of a sample and samples of a text: similar texts have the same sample, and so its fingerprint, with a chance of
#: 1 - (1 - similarity^3)^24, which misses one link in thirty million at a similarity of 0.8, and fewer above.
SAMPLE, SAMPLES = 3, 24
_MIX = np.random.default_rng(2024).integers(0, 1 << 63, (2, SAMPLE * SAMPLES), dtype=np.uint64)
_ODD = 2 * _MIX[0] + 1
_BACK = np.array([pow(int(m), -1, 1 << 64) for m in _ODD], np.uint64)
#: The positions of each list of a sample's fingerprint. Of fingerprints that differ in one byte at most, one half is the same.
HALVES = [(0, 1, 2, 3), (4, 5, 6, 7)]
LEAST_SHARED = 7
#: Rows (two longs) of a table that is broadcast; a longer one is joined by shuffles.
MOST_BROADCAST = 500_000


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of the word shingles (A-Z lower-cased): a bit is 1 if more than half the shingles' XXH64 have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    data, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = [digest(data[i:j], SEED) for i, j in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little", signed=True)


def shingle_set(text: bytes | None, width: int) -> tuple[int, np.ndarray] | None:
    """A hash of all words and the sorted hashes of the distinct shingles of ``width`` words (A-Z lower-cased); None without words."""
    words = (text or b"").lower().split()
    if not words:
        return None
    digest, data = xxhash.xxh3_64_intdigest, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    made = np.fromiter((digest(data[i:j]) for i, j in zip(starts, ends[-n:].tolist())), np.uint64, n)
    return np.array(digest(data), np.uint64).view(np.int64).item(), np.unique(made.view(np.int64))


def majority(hashes: np.ndarray) -> np.ndarray:
    """SimHash of each row of hashes: a bit is 1 if more than half of the row's have it."""
    rows, n = hashes.shape
    counts = np.zeros((rows, 64), np.int64)
    for at in range(0, n, CHUNK):
        part = np.ascontiguousarray(hashes[:, at : at + CHUNK], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(rows, -1, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int32)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<i8").ravel()


def sampled(shingles: np.ndarray) -> np.ndarray:
    """The hashes of the shingles in each sample: those least under a function of the sample's. Sets share such a shingle with the
    chance of their similarity."""
    h, least = shingles.view(np.uint64), np.full(SAMPLE * SAMPLES, ~np.uint64(0))
    for at in range(0, h.size, 2048):
        mixed = h[None, at : at + 2048] * _ODD[:, None]
        mixed += _MIX[1][:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    return ((least - _MIX[1]) * _BACK).reshape(SAMPLES, SAMPLE)


def set_fingerprints(shingles: np.ndarray) -> np.ndarray:
    """SimHash of all shingles' hashes, then of each sample's."""
    return np.concatenate((majority(shingles.view(np.uint64)[None, :]), majority(sampled(shingles))))


def parity(shingles: np.ndarray) -> list[int]:
    """A bit is 1 if an odd number of shingles falls on it: sets differ in at least as many shingles as their bits differ."""
    bits = np.bincount(shingles.view(np.uint64) % np.uint64(64 * WIDE), minlength=64 * WIDE) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _may_be(m: np.ndarray, p: np.ndarray, n: np.ndarray, q: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of m and n shingles with the parity bits p and q may have the similarity."""
    most = m + n - 2 * np.ceil(similarity / (1 + similarity) * (m + n) - 1e-9)
    differ = np.bitwise_count((p ^ q).view(np.uint64)).sum(axis=-1, dtype=np.int64)
    return (np.minimum(m, n) >= similarity * np.maximum(m, n) - 1e-9) & (differ <= most)


def cross_pairs(fps: np.ndarray, half: int, component: np.ndarray, size: np.ndarray, bits: np.ndarray, side: np.ndarray | None, similarity: float) -> Iterator[tuple[int, int]]:
    """Places of members of a list of this half, of different components (and of different sides, if given), that tallies, bits of
    the fingerprints, size and parity bits do not rule out. Pairs that share both halves are those of the first one's list."""
    order = np.lexsort((size, component))
    for at, one in enumerate(order.tolist()):
        rest = order[at + 1 :]
        rest = rest[component[rest] != component[one]]
        if side is not None:
            rest = rest[side[rest] != side[one]]
        x = fps[rest] ^ fps[one]
        near = ((x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= LEAST_SHARED) & (np.bitwise_count(x.view(np.uint64)) <= MAX_BITS)
        rest = rest[near & ((x != 0) | (half == 0))]
        rest = rest[np.minimum(size[rest], size[one]) >= similarity * np.maximum(size[rest], size[one]) - 1e-9]
        yield from ((one, b) for b in rest[_may_be(size[rest], bits[rest], size[one], bits[one], similarity)].tolist())


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b: nodes) whose sets (node, shingles) have the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, (x, y) = [], [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column("x"), batch.column("y"))]
            for i in range(batch.num_rows):
                p, q = x[1][x[0][i] : x[0][i + 1]], y[1][y[0][i] : y[0][i + 1]]
                if min(p.size, q.size) < similarity * max(p.size, q.size) - 1e-9:
                    continue
                n = np.intersect1d(p, q, assume_unique=True).size
                if n / (p.size + q.size - n) >= similarity:
                    good.append(i)
            yield from batches_of(schema, [batch.column(c).take(pa.array(good, pa.int64())) for c in ("a", "b")])

    return _both(pairs, sets, F.col("shingles")).mapInArrow(run, "a long, b long")


def _both(pairs: DataFrame, table: DataFrame, value) -> DataFrame:
    """The pairs (a, b: nodes) with the value of a as x and of b as y. Both tables are written ones, so that Spark can split the
    parts of a node in very many pairs."""
    for key, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(table.select(F.col("node").alias("of"), value.alias(name)), F.col(key) == F.col("of")).drop("of")
    return pairs


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs that size and parity bits do not rule out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (m, p), (n, q) = (tuple(batch.column(c).field(k) for k in (0, 1)) for c in ("x", "y"))
            m, n, p, q = m.to_numpy(), n.to_numpy(), *(v.flatten().to_numpy().reshape(-1, WIDE) for v in (p, q))
            good = np.flatnonzero(_may_be(m, p, n, q, similarity))
            yield from batches_of(schema, [batch.column(c).take(pa.array(good)) for c in ("a", "b")])

    return _both(pairs, nodes, F.struct("size", "bits")).mapInArrow(run, "a long, b long")


def _few(table: DataFrame) -> DataFrame:
    """A table of two columns, to be broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text as it stands) and text of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64(F.col("text").cast("binary")), F.lit(0)).alias("key"), F.col("text").cast("binary").alias("text"))


def _grouped(docs: DataFrame, width: int, similarity: float, list_size: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, node of each row that has words; text_node, component of each node."""
    texts = _rows(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("bits", pa.list_(pa.int64())), ("fps", pa.list_(pa.int64()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = [(i, k, s) for i, k, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text"))) if (s := shingle_set(t, width))]
            yield from batches_of(schema, [[i for i, _, _ in made], [k for _, k, _ in made], [s[0] for _, _, s in made], [s[1].size for _, _, s in made], [parity(s[1]) for _, _, s in made], [set_fingerprints(s[1]) for _, _, s in made]])

    sketches = materialize(texts.mapInArrow(sketch, "doc_id long, key long, node long, size long, bits array<long>, fps array<long>"), "sketches")
    own = sketches.select("doc_id", "key", "node")
    nodes = sketches.groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("row"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("fps").alias("fps"))
    nodes = materialize(nodes, "texts")

    posted = materialize(half_lists(nodes), "lists")
    stars = materialize(star_pairs(posted), "stars")
    stars = materialize(_possible(stars, nodes, similarity), "possible-stars")
    found = materialize(_linked(stars, nodes, texts, width, similarity), "star-links")
    parts = materialize(connected_components(found), "star-components")
    left = materialize(_left_over(posted.filter("n > 3"), nodes, parts, similarity, list_size), "left-over")
    if not left.isEmpty():
        more = materialize(_linked(left, nodes, texts, width, similarity), "links")
        parts = materialize(connected_components(found.union(more)), "components")
    named = nodes.select(F.col("node").alias("text_node")).join(parts, F.col("text_node") == F.col("node"), "left")
    return own, named.select("text_node", F.coalesce("component", "text_node").alias("component"))


def half_lists(nodes: DataFrame) -> DataFrame:
    """w, fp, node of each member of a list of two or more, and the list's n, low and high (nodes) with their fingerprints.

    A fingerprint (nodes: node, fps) is posted in a list for each half, of its four positional bytes there; w tells fingerprints'
    numbers apart, and its last bit is the half."""
    halves = F.array(*[F.struct(F.lit(k).cast("long").alias("half"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("value")) for k, p in enumerate(HALVES)])
    posted = nodes.select("node", F.posexplode("fps").alias("nth", "fp")).select("node", "nth", "fp", F.explode(halves).alias("list"))
    w = F.xxhash64("nth", "list.half", "list.value").bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(F.col("list.half"))
    posted = posted.select(w.alias("w"), "fp", "node")
    ends = [F.min("node").alias("low"), F.min_by("fp", "node").alias("low_fp"), F.max("node").alias("high"), F.max_by("fp", "node").alias("high_fp")]
    lists = posted.groupBy(F.col("w").alias("v")).agg(F.count(F.lit(1)).alias("n"), *ends).filter("n > 1")
    return posted.join(lists, F.col("w") == F.col("v")).drop("v")


def star_pairs(posted: DataFrame) -> DataFrame:
    """a, b: each list's members with its smallest and its largest node, if their fingerprints share at least ``LEAST_SHARED``
    positional bytes and differ in at most ``MAX_BITS`` bits."""
    ends = F.array(*[F.struct(F.col(c).alias("node"), F.col(f"{c}_fp").alias("fp")) for c in ("low", "high")])
    pairs = posted.select("node", "fp", F.explode(ends).alias("to")).filter("node <> to.node").withColumn("x", F.col("fp").bitwiseXOR(F.col("to.fp")))
    shared = reduce(add, [(F.col("x").bitwiseAND(F.lit(_mask((p,)))) == 0).cast("int") for p in range(8)])
    pairs = pairs.filter((shared >= LEAST_SHARED) & (F.bit_count("x") <= MAX_BITS))
    return pairs.select(F.least("node", "to.node").alias("a"), F.greatest("node", "to.node").alias("b")).distinct()


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, list_size: int = LIST_SIZE) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reached over links) for each row that has words.

    Rows are linked if their sets of ``width``-word shingles (A-Z lower-cased, by 64-bit hashes) have a Jaccard similarity of
    ``similarity`` or more. A text without words is left out; null ids name a group only if all its ids are null. Very long
    texts are read whole. An empty table gives an empty table; other columns are left.

    Similar sets have an equal fingerprint, of a sample if not of all shingles (``SAMPLES``), and meet in its lists of positional
    bytes. Members are tallied and verified by bits as fingerprints are. First each list's members are compared with its smallest and its largest
    node, which ends lists of up to three and joins most of a large group. In what is left only members of different components
    are compared, by bounds that rule out no similar pair, in blocks of at most about ``list_size`` members: those of another
    component than the smallest node against all, for the rest is joined already. The exact similarity decides."""
    own, named = _grouped(docs, width, similarity, list_size)
    first = own.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    named = materialize(first.join(named, F.col("node") == F.col("text_node")).select("node", "first_id", "component"), "named")
    # Written first, so that the join can split a component of very many nodes.
    names = materialize(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "names")
    table = named.join(names, "component").select(F.col("node").alias("text_node"), "component_id")
    return own.join(table, F.col("node") == F.col("text_node")).select("doc_id", "component_id")


def drop_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, list_size: int = LIST_SIZE) -> DataFrame:
    """``docs`` with one row of each group of ``similar_groups``: that of the smallest doc_id, nulls last.

    Of rows with that id the one with the smallest hash of the text stays, and of rows equal in id and text any one. Texts
    without words are no copies of each other and all stay. Texts are not shuffled for this: what goes is a thin table of ids
    and hashes."""
    own, named = _grouped(docs, width, similarity, list_size)
    rows = own.groupBy("doc_id", "key").agg(F.first("node").alias("node"), F.count(F.lit(1)).alias("n"))
    rows = materialize(rows.join(named, F.col("node") == F.col("text_node")).select("doc_id", "key", "n", "component"), "group-rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    # Written first, so that the join can split a group of very many rows.
    kept = materialize(rows.groupBy(F.col("component").alias("of")).agg(F.min(order).alias("kept")), "kept")
    gone = rows.join(kept, F.col("component") == F.col("of")).withColumn("stays", order == F.col("kept"))
    gone = materialize(gone.filter(~F.col("stays") | (F.col("n") > 1)).select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"), "stays"), "gone")
    id_, key = free_name(docs, "id"), free_name(docs, "key")
    keyed = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(key, F.coalesce(F.xxhash64(F.col("text").cast("binary")), F.lit(0)))
    same = F.col(id_).eqNullSafe(F.col("gone_id")) & (F.col(key) == F.col("gone_key"))
    left = keyed.join(_few(gone), same, "left_anti").select(*docs.columns)
    repeated = gone.filter("stays")
    if repeated.isEmpty():
        return left
    once = keyed.join(_few(repeated), same).groupBy(id_, key).agg(F.first(F.struct(*docs.columns)).alias("row"))
    return left.unionByName(once.select("row.*"))


def _linked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar; only one text of each of their nodes is shingled."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield from batches_of(schema, [batch.column("node"), [shingle_set(t, width)[1] for t in as_bytes(batch, "text")]])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("of")).distinct()
    wanted = materialize(nodes.join(wanted, F.col("node") == F.col("of")).select("row.doc_id", "row.key", "node"), "wanted")
    wanted = wanted.select(F.col("doc_id").alias("of"), F.col("key").alias("its"), "node")
    named = texts.join(_few(wanted), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("its"))).select("node", "text")
    # Of rows that are equal one is enough.
    sets = named.mapInArrow(shingle, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))
    return _verified(pairs, materialize(sets, "sets"), similarity)


def blocks(posted: DataFrame, parts: DataFrame, list_size: int = LIST_SIZE) -> DataFrame:
    """w, node, component, major, task: the members of lists (posted: w, node, low; its other columns stay) that have several components (parts), dealt
    out so that two members of different components meet in a task (w, task) of about ``list_size`` members.

    Members of the smallest node's component, the major ones, are in one block each and meet the blocks of the others."""
    parts = parts.select(F.col("node").alias("of"), "component")
    member = posted.join(parts, F.col("node") == F.col("of"), "left").withColumn("component", F.coalesce("component", "node")).drop("of")
    member = materialize(member, "list-members")
    lows = member.filter("node = low").select(F.col("w").alias("v"), F.col("component").alias("main"))
    counts = member.join(lows, F.col("w") == F.col("v")).groupBy("v", "main").agg(F.count_if(F.col("component") != F.col("main")).alias("minor"), F.count_if(F.col("component") == F.col("main")).alias("major"))
    half = list_size / 2
    counts = counts.filter("minor > 0").select("v", "main", F.ceil(F.col("minor") / half).cast("int").alias("l"), F.ceil(F.col("major") / half).cast("int").alias("k"))
    # Written first, so that the join can split a list that very many texts share.
    counts = materialize(counts, "list-blocks")
    member = member.join(counts, F.col("w") == F.col("v")).drop("v", "low").withColumn("major", F.col("component") == F.col("main"))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("major"), F.col("k")).otherwise(F.col("l"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda i, kind, j: F.struct(i.alias("i"), F.lit(kind).alias("mixed"), j.alias("j"))
    own = F.col("block")
    tasks = F.when(F.col("major"), F.transform(upto("l"), lambda i: at(i, True, own))).otherwise(
        F.concat(F.transform(upto("k"), lambda j: at(own, True, j)), F.transform(upto("l"), lambda j: at(F.least(own, j), False, F.greatest(own, j))))
    )
    return member.withColumn("block", block).select(*[c for c in posted.columns if c != "low"], "component", "major", F.explode(tasks).alias("task"))


def _left_over(posted: DataFrame, nodes: DataFrame, parts: DataFrame, similarity: float, list_size: int) -> DataFrame:
    """a, b: pairs of nodes of one list (posted: w, fp, node, low) but different components (parts) that may be similar."""
    member = blocks(posted.select("w", "fp", "node", "low"), parts, list_size)
    member = member.join(nodes.select(F.col("node").alias("of"), "size", "bits"), F.col("node") == F.col("of"))
    lists = member.groupBy("w", "task").agg(F.collect_list(F.struct("node", "fp", "component", "major", "size", "bits")).alias("members")).select("task.mixed", F.col("w").bitwiseAND(F.lit(1).cast("long")).alias("half"), "members")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("members")
            at, members = column.offsets.to_numpy(), column.values
            ids, fps, component, size = (members.field(c).to_numpy() for c in ("node", "fp", "component", "size"))
            bits, side = members.field("bits").values.to_numpy().reshape(len(ids), -1), members.field("major").to_numpy(zero_copy_only=False)
            for lo, hi, mixed, half in zip(at[:-1], at[1:], *(batch.column(c).to_pylist() for c in ("mixed", "half"))):
                found = list(cross_pairs(fps[lo:hi], half, component[lo:hi], size[lo:hi], bits[lo:hi], side[lo:hi] if mixed else None, similarity))
                if found:
                    both = np.sort(ids[lo:hi][np.array(found)], axis=1)
                    yield from batches_of(schema, [pa.array(both[:, 0]), pa.array(both[:, 1])])

    return lists.mapInArrow(run, "a long, b long").distinct()


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (long) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield from batches_of(schema, [batch.column("doc_id"), [fingerprint(t, width) for t in as_bytes(batch, "text")]])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def list_links(fps: np.ndarray, max_bits: int = MAX_BITS, wide: np.ndarray | None = None, max_wide: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the links among the members of one list, as pairs of their places.

    Members are taken one after another; each is tallied against those not yet reached: shared positional bytes first, then
    bits for those that share enough, then, if there are any, the bits of the wide fingerprints."""
    fps, open_, links, queue = fps.astype(np.int64), np.arange(len(fps)), [], []
    while open_.size or queue:
        if not queue:
            queue, open_ = [int(open_[-1])], open_[:-1]
        one = queue.pop()
        if not open_.size:
            break
        x = fps[open_] ^ fps[one]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = np.flatnonzero(shared >= 8 - max_bits)
        near = near[np.bitwise_count(x[near].view(np.uint64)) <= max_bits]
        if wide is not None and near.size:
            near = near[np.bitwise_count((wide[open_[near]] ^ wide[one]).view(np.uint64)).sum(axis=1) <= max_wide]
        if near.size:
            got = open_[near].tolist()
            links += [(one, b) for b in got]
            queue += got
            open_ = np.delete(open_, near)
    return links


def links(nodes: DataFrame, list_size: int = LIST_SIZE, max_wide: int | None = None) -> DataFrame:
    """a, b: links of ``nodes`` (node, fps: an array of fingerprints) that connect whatever is connected by pairs with at
    most 3 differing bits in some fingerprint of the array. With ``max_wide``, nodes have ``wide`` too, an array of longs, and
    pairs must differ there in at most so many bits."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("value")) for k, p in enumerate(KINDS)])
    posted = nodes.select("node", F.posexplode("fps").alias("nth", "fp")).select("node", "nth", "fp", F.explode(kinds).alias("list"))
    posted = posted.select("nth", "list.kind", "list.value", "fp", "node")
    # Written first, so that the join can split a list that very many nodes share.
    sizes = materialize(posted.groupBy("nth", "kind", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "list-sizes")
    posted = posted.join(sizes, ["nth", "kind", "value"])
    member = ["fp", "node"]
    if max_wide is not None:
        posted = posted.join(nodes.select(F.col("node").alias("of"), "wide"), F.col("node") == F.col("of")).drop("of")
        member.append("wide")
    masks = F.element_at(F.array(*[F.array(*[F.lit(_mask(p)) for p in pairs]) for pairs in SPLITS]), F.col("kind") + 1)
    parts = F.when(F.col("n") > list_size, F.transform(masks, lambda m: F.struct(m.alias("mask"), F.col("fp").bitwiseAND(m).alias("part")))).otherwise(
        F.array(F.struct(F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("part")))
    )
    lists = posted.select("nth", "kind", "value", F.struct(*member).alias("member"), F.explode(parts).alias("p"))
    lists = lists.groupBy("nth", "kind", "value", "p.mask", "p.part").agg(F.collect_list("member").alias("members"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("members")
            at, members = column.offsets.to_numpy(), column.values
            fps, ids, wide = members.field("fp").to_numpy(), members.field("node").to_numpy(), None
            if max_wide is not None:
                wide = members.field("wide").values.to_numpy().reshape(len(ids), -1)
            found = [(lo + a, lo + b) for lo, hi in zip(at[:-1], at[1:]) for a, b in list_links(fps[lo:hi], MAX_BITS, None if wide is None else wide[lo:hi], max_wide or 0)]
            if found:
                pairs = np.sort(ids[np.array(found)], axis=1)
                yield from batches_of(schema, [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])])

    return lists.filter(F.size("members") > 1).select("members").mapInArrow(tally, "a long, b long").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for the nodes of ``edges`` (a, b longs).

    Large-star and small-star steps until every component is a star; each step's edges are written to the shared folder. Minima
    are aggregated before they are joined, so a node with very many links is no hot group."""
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while _unfinished(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m")), "minima")
        with_low = lambda df, low=low: df.join(low, F.col("u") == F.col("of")).drop("of")
        large = with_low(both.filter("v > u")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.union(with_low(edges).filter("m = v").select("u", "v")).distinct(), "edges")
        low = materialize(large.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m")), "minima")
        small = with_low(large, low).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialize(small.filter("u <> v").distinct(), "edges")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node of the edges (u to a smaller v) has two parents, or a parent and a child."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return not nodes.filter((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty()


def simhash_components(docs: DataFrame, width: int = 3, list_size: int = LIST_SIZE) -> DataFrame:
    """doc_id, fp (long), component_id (the smallest doc_id reached over links of at most 3 differing bits) for each row.

    Words are ``[^\\x20\\x09-\\x0D]+``; fewer than ``width`` words are one shingle; a null or empty text has fingerprint 0 and
    is linked like any other. Rows that repeat a doc_id count as one node in effect, for they name it alike; a null doc_id
    is a member, yet names a component only if all its members are null. An empty table gives an empty table."""
    own = materialize(fingerprints(docs, width), "fingerprints")
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    parts = materialize(connected_components(links(fps.select(F.col("fp").alias("node"), F.array("fp").alias("fps")), list_size)), "components")
    named = fps.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    # Written first, so that the join can split a component of very many fingerprints.
    named = materialize(named, "named")
    names = materialize(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "names")
    table = named.join(names, "component").select(F.col("fp").alias("of"), "component_id")
    return own.join(table, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")
