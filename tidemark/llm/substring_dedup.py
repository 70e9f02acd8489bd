"""Substring dedup: suffix automata over shards of repeated text, through which documents stream for matching statistics.

Any run of ``MIN_WORDS`` words (a window) picks one anchor in it: the k-gram with the smallest hash, the first if several.
Equal windows pick equal anchors, so what can repeat meets under one anchor and automata need not be sent to all documents:

1. Successive windows with the same anchor are one segment. Each document gives its segments: anchor, segment hash, place.
2. Segments whose anchor occurs once are gone after one aggregation. Of equal segments all but the earliest are removed whole.
3. The distinct segments of an anchor are its reference shard. In the order of their first places they stream through the
   shard's automaton, then join it: where the matching statistic reaches ``MIN_WORDS``, the window has started earlier.
4. An anchor with more than ``SHARD_SEGMENTS`` distinct segments would make a hot shard. Its windows are compared exactly by
   128-bit hashes instead, with minima aggregated before they are joined.

Sending automata of the whole corpus to every document, as the method's name says, would cost the square of the corpus;
``dedup_against`` does just that for a reference of its own, in shards of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, batches_of, materialize, per_worker, pieces, words

MIN_WORDS = 20
#: Words of an anchor, about a third of a window.
ANCHOR_WORDS = 6
SHARD_SEGMENTS = 1000
#: Words in a reference shard of ``dedup_against``.
SHARD_WORDS = 200_000
CACHE_WORDS = 400_000


class SuffixAutomaton:
    """All word runs of the sequences added, generalised: each sequence starts at the root."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list) -> None:
        next_, link, length, last = self.next, self.link, self.length, 0
        for w in sequence:
            p, known = last, next_[last].get(w)
            if known is not None and length[known] == length[p] + 1:
                last = known
                continue
            if known is None:
                cur = len(next_)
                next_.append({})
                length.append(length[p] + 1)
                link.append(0)
                while p >= 0 and w not in next_[p]:
                    next_[p][w] = cur
                    p = link[p]
                if p < 0:
                    last = cur
                    continue
            else:
                cur = -1
            q = next_[p][w]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(next_)
                next_.append(dict(next_[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = clone
                if cur >= 0:
                    link[cur] = clone
                while p >= 0 and next_[p].get(w) == q:
                    next_[p][w] = clone
                    p = link[p]
                if cur < 0:
                    cur = clone
            last = cur

    def statistics(self, sequence: list) -> list[int]:
        """For each word, the length of the longest known run that ends there."""
        next_, link, length, v, n, out = self.next, self.link, self.length, 0, 0, []
        for w in sequence:
            while v and w not in next_[v]:
                v = link[v]
                n = length[v]
            if w in next_[v]:
                v, n = next_[v][w], n + 1
            out.append(n)
        return out


def found_spans(statistics: list[int], least: int) -> list[tuple[int, int]]:
    """start, length of the maximal spans covered by known runs of ``least`` words."""
    out: list[list[int]] = []
    for end, n in enumerate(statistics):
        if n >= least:
            start = end - least + 1
            if out and start <= out[-1][1]:
                out[-1][1] = end + 1
            else:
                out.append([start, end + 1])
    return [(a, b - a) for a, b in out]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def segments(text_words: list[bytes], hashes: dict, least: int = MIN_WORDS, k: int = ANCHOR_WORDS) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """anchor, segment hash, first window, number of windows of each segment of a document."""
    n = len(text_words)
    if n < least:
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, text_words), np.uint64, n)
    grams = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j]
    grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(29)
    at = sliding_window_view(grams, least - k + 1).argmin(axis=1) + np.arange(n - least + 1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.concatenate((first, [at.size])))
    ends = np.cumsum(np.fromiter(map(len, text_words), np.int64, n) + 1)
    data, digest = b" ".join(text_words), xxhash.xxh64_intdigest
    lo = np.concatenate(([0], ends))[first].tolist()
    hi = (ends[first + count + least - 2] - 1).tolist()
    return grams[at[first]].view(np.int64), [digest(data[a:b], 1) for a, b in zip(lo, hi)], first, count


def _rows(docs: DataFrame) -> DataFrame:
    """d, h, text: the id (null below all), a hash that tells rows of the same id apart, the text as bytes."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))


def _segments(rows: DataFrame, least: int) -> DataFrame:
    schema = pa.schema([("f", pa.int64()), ("s", pa.int64()), ("d", pa.int64()), ("h", pa.int64()), ("i", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = per_worker("word hashes", _Hashes)
        for piece in pieces(batches):
            if len(hashes) > CACHE_WORDS:
                hashes.clear()
            made = [segments(words(t), hashes, least, min(ANCHOR_WORDS, least)) for t in as_bytes(piece, "text")]
            who = pa.array(np.repeat(np.arange(len(made)), [len(m[0]) for m in made]))
            s = np.array([x for m in made for x in m[1]], np.uint64).view(np.int64)
            f, i, n = (np.concatenate([m[c] for m in made]) for c in (0, 2, 3))
            yield from batches_of(schema, [pa.array(f), pa.array(s), piece.column("d").take(who), piece.column("h").take(who), pa.array(i.astype(np.int32)), pa.array(n.astype(np.int32))])

    return rows.mapInArrow(run, "f long, s long, d long, h long, i int, n int")


def _with_text(wanted: DataFrame, rows: DataFrame, function, schema: str) -> DataFrame:
    """Join lists of places (wanted: d, h, i, n, f) with their documents and map them."""
    listed = wanted.groupBy(F.col("d").alias("wd"), F.col("h").alias("wh")).agg(F.collect_list(F.struct("f", "i", "n")).alias("places"))
    same = rows.join(listed.hint("merge"), F.col("d").eqNullSafe(F.col("wd")) & (F.col("h") == F.col("wh")))
    # Rows equal in id and text say the same and come each; whoever compares what they give must take it once.
    return same.select("d", "h", "text", "places").mapInArrow(function, schema)


def _shard_spans(wanted: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """Spans (d, h, i, n words) of segments that hold windows of earlier segments of their anchor."""
    cut_schema = pa.schema([("f", pa.int64()), ("d", pa.int64()), ("h", pa.int64()), ("i", pa.int32()), ("segment", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: list[list] = [[], [], [], [], []]
            for d, h, text, places in zip(*(batch.column(c).to_pylist() for c in ("d", "h", "text", "places"))):
                w = words(text)
                for p in places:
                    for to, v in zip(out, (p["f"], d, h, p["i"], b" ".join(w[p["i"] : p["i"] + p["n"] + least - 1]))):
                        to.append(v)
            yield from batches_of(cut_schema, out)

    schema = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("i", pa.int32()), ("n", pa.int32())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, automaton, before = None, SuffixAutomaton(), None
        for batch in pieces(batches, 8192):
            out: list[list] = [[], [], [], []]
            for f, d, h, i, text in zip(*(batch.column(c).to_pylist() for c in ("f", "d", "h", "i", "segment"))):
                if (f, d, h, i, text) == before:
                    continue  # of a row that repeats
                before = (f, d, h, i, text)
                if f != anchor:
                    anchor, automaton = f, SuffixAutomaton()
                w = text.split(b" ")
                for start, n in found_spans(automaton.statistics(w), least):
                    for to, v in zip(out, (d, h, i + start, n)):
                        to.append(v)
                automaton.add(w)
            yield from batches_of(schema, out)

    cuts = _with_text(wanted, rows, cut, "f long, d long, h long, i int, segment binary")
    return cuts.repartition("f").sortWithinPartitions("f", "d", "h", "i").mapInArrow(stream, "d long, h long, i int, n int")


def _hot_spans(wanted: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """The same for the segments of hot anchors: windows by 128-bit hashes, all but the earliest of equal ones."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("d", pa.int64()), ("h", pa.int64()), ("i", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found, out = [], [[], [], []]
            for d, h, text, places in zip(*(batch.column(c).to_pylist() for c in ("d", "h", "text", "places"))):
                w = words(text)
                for p in places:
                    for i in range(p["i"], p["i"] + p["n"]):
                        found.append(xxhash.xxh3_128_digest(b" ".join(w[i : i + least])))
                        for to, v in zip(out, (d, h, i)):
                            to.append(v)
            both = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield from batches_of(schema, [pa.array(both[:, 0]), pa.array(both[:, 1]), *out])

    windows = _with_text(wanted, rows, cut, "w1 long, w2 long, d long, h long, i int")
    windows = materialize(windows, "hot-windows")
    place = F.struct("d", "h", "i")
    first = windows.groupBy(F.col("w1").alias("v1"), F.col("w2").alias("v2")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    later = windows.join(first, (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2"))).filter(~place.eqNullSafe(F.col("first")))
    return later.select("d", "h", "i", F.lit(least).alias("n"))


def repeated_spans(docs: DataFrame, least: int = MIN_WORDS, shard_segments: int = SHARD_SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """The rows (d, h, text) and the spans (d, h, i, n words) of windows that start earlier too."""
    rows = _rows(docs)
    all_ = materialize(_segments(rows, least), "segments")
    # Written first, so that the join deals out both sides by itself and can split an anchor that very many segments share.
    often = materialize(all_.groupBy(F.col("f").alias("g")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("g"), "often")
    places = materialize(all_.join(often, F.col("f") == F.col("g")).drop("g"), "repeated-anchors")
    distinct = places.groupBy(F.col("f").alias("g"), F.col("s").alias("t")).agg(F.min(F.struct("d", "h", "i")).alias("first"), F.min("n").alias("m"), F.count(F.lit(1)).alias("c"))
    distinct = materialize(distinct, "distinct-segments")

    again = distinct.filter("c > 1").select("g", "t", "first")
    copies = places.join(again, (F.col("f") == F.col("g")) & (F.col("s") == F.col("t"))).filter(~F.struct("d", "h", "i").eqNullSafe(F.col("first")))
    spans = copies.select("d", "h", "i", (F.col("n") + least - 1).cast("int").alias("n"))

    counts = materialize(distinct.groupBy(F.col("g").alias("f")).agg(F.count(F.lit(1)).alias("segments")).filter("segments > 1"), "anchors")
    shards = distinct.join(counts, F.col("g") == F.col("f")).select("segments", "f", "first.d", "first.h", "first.i", F.col("m").alias("n"))
    spans = spans.union(_shard_spans(shards.filter(F.col("segments") <= shard_segments), rows, least))
    if not counts.filter(F.col("segments") > shard_segments).isEmpty():
        spans = spans.union(_hot_spans(shards.filter(F.col("segments") > shard_segments), rows, least))
    return rows, spans


def _removed(rows: DataFrame, spans: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: list[list] = [[], [], [], []]
            for d, text, gone in zip(*(batch.column(c).to_pylist() for c in ("d", "text", "spans"))):
                w = words(text)
                kept = w
                if gone:
                    depth = np.zeros(len(w) + 1, np.int64)
                    at, n = (np.array([s[c] for s in gone]) for c in ("i", "n"))
                    np.add.at(depth, at, 1)
                    np.add.at(depth, at + n, -1)
                    kept = [x for x, k in zip(w, (np.cumsum(depth)[:-1] == 0).tolist()) if k]
                for to, v in zip(out, (d, b" ".join(kept), len(w), len(w) - len(kept))):
                    to.append(v)
            out[1] = pa.array(out[1], pa.binary()).cast(pa.string())
            yield from batches_of(schema, out)

    listed = spans.groupBy(F.col("d").alias("sd"), F.col("h").alias("sh")).agg(F.collect_list(F.struct("i", "n")).alias("spans"))
    same = rows.join(listed.hint("merge"), F.col("d").eqNullSafe(F.col("sd")) & (F.col("h") == F.col("sh")), "left")
    return same.select("d", "text", "spans").mapInArrow(remove, "doc_id long, text string, n_words long, n_removed long")


def dedup_substrings(docs: DataFrame, least: int = MIN_WORDS, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed of each row of ``docs`` (doc_id, text).

    A word goes if a window of ``least`` words that covers it also starts earlier: in a row with a smaller doc_id, or earlier
    in the same one. Windows are judged on the input. A null text has no words. A null doc_id is below all others. Of rows with
    the same doc_id one, by a hash of the text, is the earlier; rows equal in doc_id and text count as one and are returned
    each. Very long texts are read whole. An empty table gives an empty table; other columns are left."""
    return _removed(*repeated_spans(docs, least, shard_segments))


def dedup_against(docs: DataFrame, reference: DataFrame, least: int = MIN_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """As ``dedup_substrings``, but words go where a window occurs in ``reference`` (text): each shard of at most
    ``shard_words`` words becomes an automaton that is broadcast for one pass over the documents.

    A reference text longer than a shard is cut with ``least`` - 1 words of overlap; texts without a window are left out."""
    step = max(1, shard_words - least)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("piece", pa.binary()), ("n", pa.int32())])
        for batch in batches:
            cut = [w[a : a + step + least - 1] for w in map(words, as_bytes(batch, "text")) for a in range(0, max(0, len(w) - least) + 1, step) if len(w) - a >= least]
            yield from batches_of(schema, [[b" ".join(c) for c in cut], [len(c) for c in cut]])

    parts = materialize(reference.select(F.col("text").cast("binary")).mapInArrow(pieces, "piece binary, n int").distinct(), "reference")
    total = parts.agg(F.sum("n")).first()[0] or 0
    shards = -(-2 * total // shard_words)
    rows, spans = _rows(docs), None
    for k in range(shards):
        own = parts.filter(F.pmod(F.xxhash64("piece"), F.lit(shards)) == k).select("piece").collect()
        automaton = SuffixAutomaton()
        for r in sorted(own):
            automaton.add(r.piece.split(b" "))
        found = _reference_spans(rows, automaton, least)
        spans = found if spans is None else spans.union(found)
    if spans is None:
        spans = rows.sparkSession.createDataFrame([], "d long, h long, i int, n int")
    return _removed(rows, spans)


def _reference_spans(rows: DataFrame, automaton: SuffixAutomaton, least: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(automaton)
    schema = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("i", pa.int32()), ("n", pa.int32())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: list[list] = [[], [], [], []]
            for d, h, text in zip(*(batch.column(c).to_pylist() for c in ("d", "h", "text"))):
                for i, n in found_spans(shared.value.statistics(words(text)), least):
                    for to, v in zip(out, (d, h, i, n)):
                        to.append(v)
            yield from batches_of(schema, out)

    return rows.mapInArrow(stream, "d long, h long, i int, n int")
