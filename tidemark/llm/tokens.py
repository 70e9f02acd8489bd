"""Token ids as files: one wavelet matrix per shard.

Documents are dealt by range of doc_id, so the shards follow each other in that order. A task encodes its documents and
writes shards of bounded size: bit planes of a wavelet matrix over the ids, a rank directory for each plane and the
documents' offsets, every section compressed on its own in one file, planes in blocks. A reader gets a token, counts a token
in a range or finds its k-th place by reading ranges of the file: the header, and of each plane its rank directory and the
blocks on the way. It can also decode all ids.
"""

from __future__ import annotations

import json
import os
import re
import struct
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import file_system, materialize, per_worker, pieces, running_total, work_dir, write_file

MAGIC = b"TMWAVE1\n"
#: Ids in a shard: a document is never cut, so one longer than this makes a longer shard.
SHARD_TOKENS = 1_000_000
#: Bits of a plane for each entry of its rank directory.
RANK_STEP = 512
#: Bytes of a plane that are compressed together, a multiple of the rank directory's step.
PLANE_BLOCK = 1 << 15
#: Words in a generation of those whose ids a worker remembers.
CACHE_WORDS = 150_000
#: Chunks encoded as one string.
JOINED = 2000
#: A chunk's stem, up to a Latin letter or a digit, and the ASCII marks after it.
STEM_AND_MARKS = r"^(?P<stem>.*[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])(?P<marks>[!-/:-@\[-`{-~]+)$"
#: How byte-level vocabularies write a space.
SPACE_SIGN = "Ġ"
#: White space other than space and line feed: a text with some is encoded whole.
OTHER_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
#: Stems that are one pre-token: Latin letters, or digits.
PRE_TOKEN = r"^(?:[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+|[0-9]+)$"
#: Text that is cut in chunks at once: distinct chunks repeat more in longer slices.
SLICE_BYTES = 8 << 20


class Lazy:
    """An array that is made when it is first asked for."""

    def __init__(self, make: Callable[[], np.ndarray]) -> None:
        self.make, self.made = make, None

    def __getitem__(self, i: int) -> int:
        if self.made is None:
            self.made = self.make()
        return self.made[i]


class Plane:
    """The bytes of a bit plane, read in blocks of ``PLANE_BLOCK``; slices lie in one block, or are the whole plane."""

    def __init__(self, size: int, read: Callable[[int], np.ndarray]) -> None:
        self.size, self.read, self.blocks = size, read, {}

    def block(self, i: int) -> np.ndarray:
        if i not in self.blocks:
            self.blocks[i] = self.read(i)
        return self.blocks[i]

    def __getitem__(self, at: int | slice) -> np.ndarray:
        if isinstance(at, slice):
            k = at.start // PLANE_BLOCK
            return self.block(k)[at.start - k * PLANE_BLOCK : at.stop - k * PLANE_BLOCK] if at.stop > at.start else np.zeros(0, np.uint8)
        return self.block(at // PLANE_BLOCK)[at % PLANE_BLOCK]

    def whole(self) -> np.ndarray:
        return np.concatenate([self.block(i) for i in range(-(-self.size // PLANE_BLOCK))] or [np.zeros(0, np.uint8)])


class WaveletMatrix:
    """Bit planes from the highest bit down; at each plane, rows with 0 go before rows with 1, both in order."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray] | list[Plane], ranks: list[np.ndarray] | list[Lazy]) -> None:
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max()).bit_length()) if ids.size else 1
        a, zeros, planes, ranks = ids.astype(np.uint16 if levels <= 16 else np.uint32), [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (a & a.dtype.type(1 << level)) != 0
            packed = np.packbits(bit)
            ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, max(1, packed.size), RANK_STEP // 8), dtype=np.int64) if packed.size else np.zeros(0, np.int64)
            zeros.append(int(ids.size - ones.sum()))
            dealt = np.empty_like(a)
            np.compress(~bit, a, out=dealt[: zeros[-1]])
            np.compress(bit, a, out=dealt[zeros[-1] :])
            a = dealt
            planes.append(packed)
            ranks.append(np.concatenate(([0], np.cumsum(ones))).astype(np.uint32))
        return cls(int(ids.size), zeros, planes, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i."""
        block = i // RANK_STEP
        first, last = block * RANK_STEP // 8, i // 8
        plane = self.planes[level]
        n = int(self.ranks[level][block]) + int(np.bitwise_count(plane[first:last]).sum())
        return n + (int(plane[last]) >> (8 - i % 8)).bit_count() if i % 8 else n

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(len(self.planes)):
            bit = (int(self.planes[level][i // 8]) >> (7 - i % 8)) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        levels = len(self.planes)
        if token < 0 or token >> levels:
            return 0, 0
        for level in range(levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the token stands in places lo to hi - 1 (rank, if lo is 0)."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th bit of that value, from 0."""
        before = (lambda i: self._ones(level, i)) if bit else (lambda i: i - self._ones(level, i))
        lo, hi = 0, self.n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if before(mid) <= k else (lo, mid)
        return lo

    def find(self, token: int, k: int) -> int:
        """The place of the token's k-th occurrence, from 0 (select)."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i, levels = lo + k, len(self.planes)
        for level in range(levels - 1, -1, -1):
            bit = token >> (levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids."""
        a = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k, level in enumerate(range(len(self.planes) - 1, -1, -1)):
            plane = self.planes[level]
            bit = np.unpackbits(plane.whole() if isinstance(plane, Plane) else plane, count=self.n).view(bool)
            a[self.zeros[level] :] |= a.dtype.type(1 << k)
            back = np.empty_like(a)
            back[np.flatnonzero(~bit)] = a[: self.zeros[level]]
            back[np.flatnonzero(bit)] = a[self.zeros[level] :]
            a = back
        return a.astype(np.uint32)


def _blocks(plane: np.ndarray) -> list[bytes]:
    return [plane[at : at + PLANE_BLOCK].tobytes() for at in range(0, plane.size, PLANE_BLOCK)]


def shard_bytes(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of a shard: header, then sections compressed one by one. A plane is a section for each ``PLANE_BLOCK`` bytes."""
    wave, press = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1)
    null = np.array([x is None for x in doc_ids], bool)
    parts = [("doc_ids", np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes()), ("doc_null", np.packbits(null).tobytes()), ("lengths", np.array(lengths, "<i8").tobytes())]
    parts += [(f"rank{k}", r.astype("<u4").tobytes()) for k, r in enumerate(wave.ranks)]
    parts += [(f"plane{k}.{i}", block) for k, p in enumerate(wave.planes) for i, block in enumerate(_blocks(p))]
    sections = [(name, press.compress(data)) for name, data in parts]
    head = json.dumps({"n": wave.n, "docs": len(doc_ids), "zeros": wave.zeros, "sections": [[name, len(data)] for name, data in sections]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(data for _, data in sections)


class ShardFile:
    """A shard's file, opened for reading. Sections are read by their range and inflated when they are needed, so a token is
    got, counted or found from the header, the rank directories and a block of each plane."""

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        """``read``: the bytes of the file from a place on, so many."""
        first = read(0, 12)
        if first[:8] != MAGIC:
            raise ValueError("not a token shard")
        (size,) = struct.unpack("<I", first[8:12])
        self.head, at, self.at, self.read, self.bytes_read = json.loads(read(12, size)), 12 + size, {}, read, 12 + size
        for name, n in self.head["sections"]:
            self.at[name] = (at, n)
            at += n

    @classmethod
    def of(cls, data: bytes) -> ShardFile:
        return cls(lambda at, n: data[at : at + n])

    @classmethod
    def open(cls, uri: str) -> ShardFile:
        fs, path = file_system(uri)
        file = fs.open_input_file(path)

        def read(at: int, n: int) -> bytes:
            file.seek(at)
            return file.read(n)

        return cls(read)

    def section(self, name: str, dtype: str) -> np.ndarray:
        at, n = self.at[name]
        self.bytes_read += n
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.read(at, n)), dtype)

    @property
    def doc_ids(self) -> list[int | None]:
        null = np.unpackbits(self.section("doc_null", "u1"), count=self.head["docs"]).astype(bool)
        return [None if n else x for x, n in zip(self.section("doc_ids", "<i8").tolist(), null.tolist())]

    @property
    def lengths(self) -> np.ndarray:
        return self.section("lengths", "<i8")

    def matrix(self) -> WaveletMatrix:
        """The matrix over the file: planes' blocks and rank directories come when they are asked for."""
        levels = range(len(self.head["zeros"]))
        size = -(-self.head["n"] // 8)
        planes = [Plane(size, lambda i, k=k: self.section(f"plane{k}.{i}", "u1")) for k in levels]
        return WaveletMatrix(self.head["n"], self.head["zeros"], planes, [Lazy(lambda k=k: self.section(f"rank{k}", "<u4")) for k in levels])


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one after another."""
    upto = np.cumsum(sizes, dtype=np.int64)
    total = int(upto[-1]) if upto.size else 0
    return values[np.repeat(starts - (upto - sizes), sizes) + np.arange(total, dtype=np.int64)]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes, dtype=np.int64) - sizes


class Encoder:
    """Ids of texts by a byte-level BPE of the tokenizers library, equal to encoding each whole text.

    This vocabulary's pre-tokens never hold white space after another character, nor a letter or digit and a mark. So a text
    can be cut before each single space and around each single line feed, and a chunk between its last letter and the marks
    after it. Of a slice of texts each distinct stem and each distinct run of marks is encoded once. A stem of Latin letters or
    of digits is one pre-token and goes to the library's model as such; others go many in one string, whose ids part at the
    tokens that start with a space, or at line feeds. Texts where that is not certain (white space next to white space or at
    the end, a special token's string) are encoded whole."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join(["  ", " \n", "\n ", "\n\n", r"[ \n]\z", f"[{OTHER_SPACE}]", *map(re.escape, special)])
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.spaced[k] = token.startswith(SPACE_SIGN)
        self.feed = self._ids(["\n"])[0]
        self.model, self.known, self.older = self.tokenizer.model, {}, {}
        # How byte-level vocabularies write bytes: printable Latin-1 characters as they are, the others from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_signs = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        ids = self._ids(texts)
        return np.concatenate([*ids, np.zeros(0, "<u4")]), np.fromiter(map(len, ids), np.int64, len(ids))

    def _pre_tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that are one pre-token each with a space in front. Words of this slice and lately met ones are
        remembered; what is met again moves up, the rest goes with its generation."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older, tokenize, signs = self.known, self.older, self.model.tokenize, self.byte_signs
        parts = list(map(known.get, words))
        for i in [i for i, p in enumerate(parts) if p is None]:
            w = words[i]
            if (p := older.get(w)) is None:
                p = array("I", [t.id for t in tokenize(SPACE_SIGN + (w if w.isascii() else w.encode().decode("latin-1").translate(signs)))]).tobytes()
            parts[i] = known[w] = p
        return np.frombuffer(b"".join(parts), np.uint32).astype("<u4", copy=False), np.fromiter(map(len, parts), np.int64, len(parts)) // 4

    def _joined(self, chunks: pa.Array, mark: str) -> tuple[np.ndarray, np.ndarray]:
        """The same for distinct chunks, each with ``mark`` (a space or a line feed) in front of it in one long string. A line
        feed is no part of a chunk."""
        ids, sizes = [np.zeros(0, "<u4")], []
        for at in range(0, len(chunks), JOINED):
            part = chunks.slice(at, JOINED).to_pylist()
            (found,) = self._ids([mark + mark.join(part)])
            starts = np.flatnonzero(self.spaced[found] if mark == " " else found == self.feed[0])
            if starts.size == len(part) and (mark == " " or self.feed.size == 1):
                size = np.diff(np.append(starts, found.size))
                if mark != " ":
                    found, size = np.delete(found, starts), size - 1
            else:
                found, size = self._each([mark + c for c in part] if mark == " " else part)
            ids.append(found)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate([*sizes, np.zeros(0, np.int64)])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text of a string array without nulls.

        Arrow splits and numbers the chunks, and the ids are laid out by numpy."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        whole = iter([self._ids([t])[0].tobytes() for t in texts.filter(pa.array(odd)).to_pylist()])
        cut = iter(self._chunked(texts.filter(pa.array(~odd))))
        return [next(whole) if o else next(cut) for o in odd.tolist()]

    def _chunked(self, texts: pa.Array) -> list[bytes]:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        if not ends.size:
            return []
        numbered = pc.list_flatten(lists).dictionary_encode()
        index, chunks = numbered.indices.to_numpy(), numbered.dictionary
        # A chunk stands alone at the start of a text and around a line feed; else it has its space in front.
        feed = index == pc.index(chunks, "\n").as_py()
        alone = feed.copy()
        alone[1:] |= feed[:-1]
        alone[0] = True
        alone[ends[:-1]] = True
        code = 2 * index + ~alone
        used = np.flatnonzero(np.bincount(code, minlength=2 * len(chunks)))
        spaced, bare = used[used & 1 == 1] >> 1, used[used & 1 == 0] >> 1
        ids, sizes = self._known(chunks.take(pa.array(spaced)), chunks.take(pa.array(bare)))
        starts, slot = _starts(sizes), np.zeros(2 * len(chunks), np.int64)
        slot[np.concatenate((2 * spaced + 1, 2 * bare))] = np.arange(sizes.size)
        at = slot[code]
        size = sizes[at]
        stops = np.cumsum(size)[ends - 1]
        data = _gather(ids, starts[at], size).tobytes()
        return [data[4 * x : 4 * y] for x, y in zip([0, *stops[:-1].tolist()], stops.tolist())]

    def _known(self, spaced: pa.Array, bare: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all distinct chunks, those with a space in front first, and how many each has."""
        cut = pc.extract_regex(spaced, STEM_AND_MARKS)
        stems = pc.if_else(cut.is_valid(), pc.struct_field(cut, "stem"), spaced).dictionary_encode()
        marks = pc.fill_null(pc.struct_field(cut, "marks"), "").dictionary_encode()
        # Stems of one pre-token or more; chunks that stand alone with words in them, or without: empty ones and line feeds.
        kinds = [(stems.dictionary, pc.match_substring_regex(stems.dictionary, PRE_TOKEN), self._pre_tokens, lambda c: self._joined(c, " "))]
        kinds += [(bare, pc.is_in(bare, pa.array(["", "\n"])), self._each, lambda c: self._joined(c, "\n"))]
        values, found, total = [], [], 0
        for chunks, plain, one, many in kinds:
            start, size, plain = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64), plain.to_numpy(zero_copy_only=False)
            for rows, (ids, n) in ((plain, one(chunks.filter(pa.array(plain)).to_pylist())), (~plain, many(chunks.filter(pa.array(~plain))))):
                start[rows], size[rows] = total + _starts(n), n
                values.append(ids)
                total += ids.size
            found.append((start, size))
        ids, n = self._each(marks.dictionary.to_pylist())
        values.append(ids)
        # A chunk is its stem's ids, then its marks'.
        begin, size = (np.zeros((len(spaced) + len(bare), 2), np.int64) for _ in range(2))
        row = stems.indices.to_numpy()
        begin[: len(spaced), 0], size[: len(spaced), 0] = found[0][0][row], found[0][1][row]
        row = marks.indices.to_numpy()
        begin[: len(spaced), 1], size[: len(spaced), 1] = (total + _starts(n))[row], n[row]
        begin[len(spaced) :, 0], size[len(spaced) :, 0] = found[1]
        return _gather(np.concatenate(values), begin.ravel(), size.ravel()), size.sum(axis=1)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode and write; path, part, seq, docs, tokens of each shard. part and seq give the shards' order."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # Equal rows say the same in any order; a number for each row lets very many of them part.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    schema = pa.schema([("path", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = per_worker(("encoder", tokenizer), lambda: Encoder(tokenizer)), TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        ids: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{part:06d}-{seq:06d}.tokens"
            write_file(path, shard_bytes(np.frombuffer(b"".join(held), "<u4"), ids, [len(x) // 4 for x in held]))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([size // 4], pa.int64())], schema=schema)

        for piece in pieces(batches, 1 << 20, SLICE_BYTES):
            for doc_id, data in zip(piece.column("doc_id").to_pylist(), encoder.encode(piece.column("text"))):
                if ids and size // 4 + len(data) // 4 + 1 > shard_tokens:
                    yield flush()
                    held, ids, size, seq = [], [], 0, seq + 1
                held.append(data + end)
                ids.append(doc_id)
                size += len(data) + 4
        if ids:
            yield flush()

    return materialize(rows.mapInArrow(write, "path string, part long, seq long, docs long, tokens long"), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary, little-endian 32 bit) of each document, from the files."""
    shards = _offsets(shards)
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard = ShardFile.open(path)
                ids, lengths, docs = shard.matrix().decode().astype("<u4"), shard.lengths, shard.doc_ids
                ends = np.cumsum(lengths)
                for lo in range(0, len(docs), 2048):
                    hi = min(len(docs), lo + 2048)
                    cut = [ids[e - n : e].tobytes() for e, n in zip(ends[lo:hi].tolist(), lengths[lo:hi].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(docs[lo:hi], pa.int64()), pa.array(start + ends[lo:hi] - lengths[lo:hi], pa.int64()), pa.array(cut, pa.binary())], schema=out)

    spread = shards.select("path", "start").repartition(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(read, "doc_id long, start long, ids binary")


def _offsets(shards: DataFrame) -> DataFrame:
    """Add start, the ids before each shard: within a part, then over the parts."""
    inner = running_total(shards, ["part"], "seq", "tokens", "within")
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("part_tokens")).withColumn("all", F.lit(0))
    parts = running_total(parts, ["all"], "part", "part_tokens", "before").select("part", "before")
    return inner.join(parts, "part").withColumn("start", F.col("before") + F.col("within")).drop("before", "within")


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write ``docs`` (doc_id, text) as token shards in ascending doc_id order, then read them back: doc_id, start, ids.

    A null text is empty and gives the end id alone. Null doc_ids come first; rows with the same doc_id follow each other,
    ordered by text. An empty table writes no file and gives an empty table; other columns are left."""
    return read_shards(write_shards(docs, work_dir(docs.sparkSession, "tokens"), tokenizer, end_id, shard_tokens))
