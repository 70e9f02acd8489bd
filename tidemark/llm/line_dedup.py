"""Line dedup: sharded minimal perfect hashes over the hashes of frequent lines, probed by documents.

1. Every document gives the 128-bit hashes of its long lines, each once. Spark counts them with map-side combining and
   keeps those found in enough documents.
2. The frequent hashes are cut into shards of bounded size. One task builds a shard: a minimal perfect hash and, by its
   numbers, an array of 64-bit fingerprints, one of counts and one of the largest document. A shard is one file in the
   shared folder.
3. Documents probe these arrays. Their texts are neither shuffled nor joined with lines. A task takes some megabytes of text at
   once, looks up all their lines shard by shard, and holds few shards: each is read once for each such chunk at most.
"""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_BYTES, as_bytes, batches_of, materialize, pieces, read_file, work_dir, write_file

#: Frequent lines in a shard, at most about so many: 21 bytes of arrays and 5 bits of hash each, so 11 MB a shard.
SHARD_KEYS = 500_000
#: Bytes of shards that a task keeps at once, and bytes of text whose lines it looks up shard by shard.
CACHE_BYTES, CHUNK_BYTES = 64 << 20, 8 << 20


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE_BYTES).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of 128-bit keys (two uint64 arrays), by levels of bit arrays.

    At each level a key that has a place of its own sets its bit; the others go on. A key's number is the rank of its bit."""

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        """``bits``: the levels' bits one after another, 64 in a word, the lowest first. ``rank``: ones before each word."""
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        ones = np.cumsum(np.bitwise_count(bits), dtype=np.uint32)
        self.rank = np.concatenate((np.zeros(1, np.uint32), ones))[: bits.size]

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        left, sizes, bits = np.arange(h1.size), [], []
        while left.size:
            size = 2 * left.size + 1
            at = cls._place(h1[left], h2[left], len(sizes), size)
            n = np.bincount(at, minlength=size)
            sizes.append(size)
            bits.append(n == 1)
            left = left[n[at] != 1]
            if len(sizes) > 200:
                raise ValueError("keys must be distinct")
        flat = np.packbits(np.concatenate([*bits, np.zeros(0, bool)]), bitorder="little")
        return cls(sizes, np.concatenate((flat, np.zeros(-flat.size % 8, np.uint8))).view(np.uint64))

    @staticmethod
    def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mixed(h1 + np.uint64(level + 1) * (h2 | np.uint64(1))) % np.uint64(size)).astype(np.int64)

    def numbers(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The numbers of keys; a foreign key gets -1 or any number, so compare a fingerprint."""
        out = np.full(h1.size, -1, np.int64)
        left = np.arange(h1.size)
        for level, size in enumerate(self.sizes):
            if not left.size:
                break
            at = self.starts[level] + self._place(h1[left], h2[left], level, size)
            word, low = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> low & np.uint64(1)).astype(bool)
            before = np.bitwise_count(word[hit] & ((np.uint64(1) << low[hit]) - np.uint64(1)))
            out[left[hit]] = self.rank[at[hit] >> 6].astype(np.int64) + before
            left = left[~hit]
        return out


class LineShard:
    """One shard: the hash and its arrays. ``last_doc`` is the largest document that holds a line, ``known`` whether it has an id."""

    def __init__(self, index: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray, last_doc: np.ndarray, known: np.ndarray) -> None:
        self.index, self.fingerprints, self.counts, self.last_doc, self.known = index, fingerprints, counts, last_doc, known
        self.size = 12 * index.bits.size + 21 * counts.size

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, last_doc: np.ndarray, known: np.ndarray) -> LineShard:
        index = PerfectHash.build(h1, h2)
        to = index.numbers(h1, h2)
        arrays = [np.empty(h1.size, t) for t in (np.uint64, np.uint32, np.int64, bool)]
        for array, values in zip(arrays, (h2, np.minimum(counts, 0xFFFFFFFF), last_doc, known)):
            array[to] = values
        return cls(index, *arrays)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, sizes=np.array(self.index.sizes, np.int64), bits=self.index.bits, fingerprints=self.fingerprints, counts=self.counts, last_doc=self.last_doc, known=self.known)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> LineShard:
        with np.load(io.BytesIO(data)) as z:
            return cls(PerfectHash(z["sizes"].tolist(), z["bits"]), z["fingerprints"], z["counts"], z["last_doc"], z["known"])

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """found, count, largest document and whether that has an id, of each hash."""
        if not self.counts.size:
            return np.zeros(h1.size, bool), np.zeros(h1.size, np.uint32), np.zeros(h1.size, np.int64), np.zeros(h1.size, bool)
        at = np.maximum(self.index.numbers(h1, h2), 0)
        return self.fingerprints[at] == h2, self.counts[at], self.last_doc[at], self.known[at]


def _hashes(lines: list[bytes], least: int) -> tuple[list[int], list[bytes]]:
    """Which lines have a long key, and those keys' hashes."""
    at, out = [], []
    for i, line in enumerate(lines):
        if len(line) >= least and _long_enough(key := line_key(line), least):
            at.append(i)
            out.append(xxhash.xxh3_128_digest(key))
    return at, out


def frequent_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """h1, h2, n_docs, last_doc of each line key of at least ``min_chars`` code points in at least ``min_docs`` rows."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, found, per = batch.column("doc_id"), [], []
            for text in as_bytes(batch, "text"):
                own = set(_hashes((text or b"").split(b"\n"), min_chars)[1])
                found.extend(own)
                per.append(len(own))
            h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            who = ids.take(pa.array(np.repeat(np.arange(len(per)), per)))
            yield from batches_of(schema, [pa.array(h[:, 0]), pa.array(h[:, 1]), who])

    lines = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(keys, "h1 long, h2 long, doc_id long")
    found = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
    return found.filter(F.col("n_docs") >= min_docs)


def build_line_index(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, shard_keys: int = SHARD_KEYS) -> tuple[str, int, frozenset[int]]:
    """Write the shards to the shared folder; return the folder, their number and which of them have keys."""
    lines = materialize(frequent_lines(docs, min_docs, min_chars), "frequent-lines")
    total = lines.count()
    n = max(1, -(-total // shard_keys))
    folder = work_dir(docs.sparkSession, "line-index")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        made = LineShard.build(pdf["h1"].to_numpy().view(np.uint64), pdf["h2"].to_numpy().view(np.uint64), pdf["n_docs"].to_numpy(), pdf["last_doc"].to_numpy(), pdf["known"].to_numpy())
        write_file(f"{folder}/{shard:06d}.lines", made.to_bytes())
        return pd.DataFrame({"shard": [shard], "keys": [len(pdf)]})

    shards = lines.select(F.pmod("h1", F.lit(n)).cast("int").alias("shard"), "h1", "h2", "n_docs", F.coalesce("last_doc", F.lit(0)).alias("last_doc"), F.col("last_doc").isNotNull().alias("known"))
    # A row for each shard: the manifest.
    built = shards.groupBy("shard").applyInPandas(build, "shard int, keys long").collect()
    if sum(r["keys"] for r in built) != total:
        raise RuntimeError(f"{total} frequent lines, but their shards hold {sum(r['keys'] for r in built)}")
    return folder, n, frozenset(r["shard"] for r in built)


class _Shards:
    """Shards of one index, as few in memory as fit. A shard of the manifest whose file is gone is an error."""

    def __init__(self, folder: str, present: frozenset[int]) -> None:
        self.folder, self.present, self.kept, self.size = folder, present, OrderedDict(), 0

    def get(self, k: int) -> LineShard | None:
        if k not in self.present:
            return None
        if k not in self.kept:
            self.kept[k] = LineShard.from_bytes(read_file(f"{self.folder}/{k:06d}.lines"))
            self.size += self.kept[k].size
            while self.size > CACHE_BYTES and len(self.kept) > 1:
                self.size -= self.kept.popitem(last=False)[1].size
        self.kept.move_to_end(k)
        return self.kept[k]


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, text (the lines that stay), n_lines, n_dropped for each row of ``docs`` (doc_id, text; other columns are left).

    A line's key is the line without outer white space, A-Z lower-cased. Keys of at least ``min_chars`` code points in at
    least ``min_docs`` rows go, but for all their lines in the largest doc_id that holds them. A null or empty text is one
    empty line. Each row is a document, also if its doc_id repeats; rows that share the largest doc_id all keep the line.
    A null doc_id is below all others. Very long texts and lines are read whole. An empty table gives an empty table."""
    folder, n, present = build_line_index(docs, min_docs, min_chars, shard_keys)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(folder, present)
        for batch in pieces(batches, 1 << 20, CHUNK_BYTES):
            own = batch.column("doc_id")
            has, ids = own.is_valid().to_numpy(zero_copy_only=False), own.fill_null(0).to_numpy()
            texts = [(t or b"").split(b"\n") for t in as_bytes(batch, "text")]
            found = [_hashes(lines, min_chars) for lines in texts]
            h = np.frombuffer(b"".join(x for _, hs in found for x in hs), "<u8").reshape(-1, 2)
            who = np.repeat(np.arange(len(found)), [len(at) for at, _ in found])
            drop = np.zeros(len(h), bool)
            to = h[:, 0].view(np.int64) % n
            order = np.argsort(to, kind="stable")
            used, first = np.unique(to[order], return_index=True)
            for k, rows in zip(used.tolist(), np.split(order, first[1:])):
                if (shard := shards.get(k)) is not None:
                    found_, _, last, known = shard.probe(h[rows, 0], h[rows, 1])
                    drop[rows] = found_ & ((last != ids[who[rows]]) | (known != has[who[rows]]))
            kept, dropped, i = [], [], 0
            for lines, (at, _) in zip(texts, found):
                gone = {a for a, d in zip(at, drop[i : i + len(at)].tolist()) if d}
                i += len(at)
                dropped.append(len(gone))
                kept.append(b"\n".join(x for j, x in enumerate(lines) if j not in gone) if gone else b"\n".join(lines))
            yield from batches_of(schema, [batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), [len(x) for x in texts], dropped])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(probe, "doc_id long, text string, n_lines long, n_dropped long")
