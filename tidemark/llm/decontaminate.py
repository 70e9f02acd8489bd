"""Benchmark decontamination: a BM25 inverted index of test items, queried by every training passage with block-max WAND.

Items stay small tables: they are indexed in blocks of at most ``BLOCK_ITEMS``, one pass over the documents for each block.
Impacts are BM25 weights over the item's own score, so an item scores 0 to 1 and one threshold serves all items.

A document is cut in passages of two cells, a cell being as long as the longest item of the class, so every run of an item's
length lies in one. Before a passage is a query, a bound is taken for it: the impacts of each item's rarer words that occur in
it, plus the item's common words in any case. Passages with no item up to the threshold end there, as WAND would end without
a pivot; the others go through WAND with block maxima. What is found is verified: the item's five-word shingles must occur in the
passage, and the words of its question and of its answer, each to ``OVERLAP``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches_of, filter_rows, materialize, pieces

#: Items in an index: bounds what is broadcast.
BLOCK_ITEMS = 20_000
#: Share of an item's own BM25 score from which it is retrieved, and of its shingles that must occur.
RETRIEVE, OVERLAP = 0.5, 0.8
SHINGLE = 5
#: Shorter items have too few words to share some of them: they are found where they stand as a whole, word for word.
MIN_WORDS = 8
K1, B = 1.2, 0.75
#: Postings in a block of a list.
POSTINGS = 16
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def split_item(words: list[str]) -> tuple[list[str], list[str]]:
    """Question and answer of an item that is one text: the last quarter, five words at least, is the answer."""
    n = max(SHINGLE, len(words) // 4)
    return words[:-n], words[-n:]


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class Verbatim:
    """Items found only as whole runs of words, by their length and their words."""

    def __init__(self, items: list[tuple[int | None, list[str]]]) -> None:
        self.items: dict[int, dict[tuple[str, ...], list[int | None]]] = {}
        for i, w in items:
            self.items.setdefault(len(w), {}).setdefault(tuple(w), []).append(i)
        self.firsts = {n: {w[0] for w in known} for n, known in self.items.items()}

    def match(self, text: str | None, overlap: float = OVERLAP) -> list[tuple[int | None, float, float, float, float]]:
        words = words_of(text)
        found = []
        for n, known in self.items.items():
            firsts = self.firsts[n]
            held = {run for i, w in enumerate(words) if w in firsts and (run := tuple(words[i : i + n])) in known}
            found += [(i, 1.0, 1.0, 1.0, 1.0) for run in sorted(held) for i in known[run]]
        return found


class Index:
    """Posting lists (item number, impact) by word, with the maximum of each block of postings."""

    def __init__(self, items: list[tuple[int | None, list[str]]], df: dict[str, int], n_items: int, mean_words: float, retrieve: float = RETRIEVE) -> None:
        self.ids, self.words, self.retrieve = [i for i, _ in items], [w for _, w in items], retrieve
        self.cell = max((len(w) for w in self.words), default=1)
        self.parts = [(shingles(w), *map(set, split_item(w))) for w in self.words]
        postings: dict[str, list[tuple[int, float]]] = {}
        rare: dict[str, list[tuple[int, float]]] = {}
        self.common = np.zeros(len(items), np.float64)
        for k, w in enumerate(self.words):
            tf = Counter(w)
            raw = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean_words)) for t, c in tf.items()}
            own = sum(raw[t] for t in sorted(raw))
            for t, x in raw.items():
                postings.setdefault(t, []).append((k, x / own))
            for t in sorted(raw, key=lambda t: (-df[t], t)):
                if self.common[k] + raw[t] / own <= retrieve / 2:
                    self.common[k] += raw[t] / own
                else:
                    rare.setdefault(t, []).append((k, raw[t] / own))
        self.postings = {t: ([k for k, _ in p], [x for _, x in p], [max(x for _, x in p[i : i + POSTINGS]) for i in range(0, len(p), POSTINGS)]) for t, p in postings.items()}
        self.rare = {t: i for i, t in enumerate(rare)}
        lists = list(rare.values())
        self.starts = np.concatenate(([0], np.cumsum([len(p) for p in lists]))).astype(np.int64)
        self.rare_item = np.array([k for p in lists for k, _ in p], np.int64)
        self.rare_impact = np.array([x for p in lists for _, x in p], np.float64)

    def bounded(self, words: list[str]) -> list[int]:
        """Passages whose bound reaches the threshold for some item; passage c holds cells c and c + 1."""
        get = self.rare.get
        term = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        at = np.flatnonzero(term >= 0)
        if not at.size:
            return []
        lo, n = self.starts[term[at]], self.starts[term[at] + 1] - self.starts[term[at]]
        own = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        cells, items = np.repeat(at // self.cell, n), self.rare_item[own]
        key, back = np.unique(cells * len(self.ids) + items, return_inverse=True)
        sums = np.bincount(back, self.rare_impact[own], key.size)
        next_ = np.searchsorted(key, key + len(self.ids))
        follow = np.where(next_ < key.size, key[np.minimum(next_, key.size - 1)] == key + len(self.ids), False)
        both = sums + np.where(follow, sums[np.minimum(next_, key.size - 1)], 0.0)
        # A cell is the first of a passage and the second of the one before.
        good = np.flatnonzero(np.maximum(both, sums) + self.common[key % len(self.ids)] >= self.retrieve - 1e-9)
        cell = key[good] // len(self.ids)
        return np.unique(np.concatenate((cell, np.maximum(cell - 1, 0)))).tolist()

    def search(self, terms: list[str]) -> list[tuple[int, float]]:
        """Block-max WAND: all items with a score up to the threshold for the distinct words of a passage."""
        lists = [[self.postings[t], 0] for t in sorted(terms) if t in self.postings]
        bound = {id(x): max(x[0][2]) for x in lists}
        least, out = self.retrieve - 1e-9, []
        while lists:
            lists.sort(key=lambda x: x[0][0][x[1]])
            total, pivot = 0.0, -1
            for i, x in enumerate(lists):
                total += bound[id(x)]
                if total >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][0][lists[pivot][1]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][0][lists[pivot + 1][1]] == item:
                pivot += 1
            # Maxima of the blocks in which the pivot item would stand; no list moves for this.
            block, until = 0.0, None
            for x in lists[: pivot + 1]:
                ids, _, tops = x[0]
                b = x[1] // POSTINGS
                while b + 1 < len(tops) and ids[(b + 1) * POSTINGS - 1] < item:
                    b += 1
                block += tops[b]
                last = ids[min(len(ids), (b + 1) * POSTINGS) - 1]
                until = last if until is None else min(until, last)
            if block >= least:
                here = lists[0][0][0][lists[0][1]] == item  # then all lists up to the pivot stand there
                if here and (score := sum(x[0][1][x[1]] for x in lists[: pivot + 1])) >= least:
                    out.append((item, score))
                to = item + here
            else:
                to = max(item, until) + 1
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][0][0][lists[pivot + 1][1]])
                to = max(to, item + 1)
            for x in lists[: pivot + 1]:
                ids = x[0][0]
                while x[1] < len(ids) and ids[x[1]] < to:
                    x[1] += 1
            lists = [x for x in lists if x[1] < len(x[0][0])]
        return out

    def match(self, text: str | None, overlap: float = OVERLAP) -> list[tuple[int | None, float, float, float, float]]:
        """item_id, score, overlap of shingles, of question and of answer words, of each item found, in its best passage."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        best: dict[int, tuple[float, float, float, float]] = {}
        for c in self.bounded(words):
            passage = words[c * self.cell : (c + 2) * self.cell]
            found = self.search(list(dict.fromkeys(passage)))
            if not found:
                continue
            have = (shingles(passage), set(passage), set(passage))
            for k, score in found:
                shares = tuple(len(p & h) / len(p) for p, h in zip(self.parts[k], have))
                if min(shares) >= overlap and (score, *shares) > best.get(k, (0.0,) * 4):
                    best[k] = (score, *shares)
        return [(self.ids[k], *v) for k, v in sorted(best.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, retrieve: float = RETRIEVE, overlap: float = OVERLAP, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, bm25 (share of the item's own score), overlap (of five-word shingles), question_overlap and
    answer_overlap (of words): a row for each row of ``docs`` (doc_id, text) and item of ``benchmark`` (item_id, text) that it holds.

    Words are runs of word characters, lower-cased. Items of fewer than eight words are found where all their words stand
    in a row, with 1 for each share. Null texts and texts without words, on either side, match nothing. Very long texts are
    searched whole; of an item's passages that tie the first counts. Equal items are found each; rows that repeat a doc_id give
    rows each; null ids are kept; other columns are left. Word counts are those of all items of eight words or more, not of a block. Empty tables give an empty table."""
    schema = "doc_id long, item_id long, bm25 double, overlap double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = docs.sparkSession.createDataFrame([], schema)
    for index in _indexes(benchmark, retrieve, block_items):
        out = out.union(_leaks(rows, index, overlap, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, retrieve: float = RETRIEVE, overlap: float = OVERLAP, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs`` whose texts hold no item, each by its own text, whatever its doc_id; see ``find_leaks``."""
    out = docs
    for index in _indexes(benchmark, retrieve, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        out = filter_rows(out, lambda shared=shared: lambda texts: [not shared.value.match(t, overlap) for t in texts])
    return out


def _indexes(benchmark: DataFrame, retrieve: float, block_items: int) -> Iterator[Index | Verbatim]:
    """Indexes of blocks of items; each block comes to the driver when it is its turn."""
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.string()))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield from batches_of(schema, [batch.column("item_id"), [words_of(t) for t in batch.column("text").to_pylist()]])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(split, "item_id long, words array<string>").filter(F.size("words") > 0)
    items = items.withColumn("class", F.ceil(F.log2(F.size("words") / 64.0))).withColumn("class", F.greatest("class", F.lit(0)))
    items = materialize(items.withColumn("class", F.when(F.size("words") < MIN_WORDS, -1).otherwise(F.col("class"))), "benchmark-items")
    sizes = {r["class"]: r["n"] for r in items.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    scored = items.filter("class >= 0")
    total = scored.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("mean")).first()
    df = scored.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    for size, n in sorted(sizes.items()):
        for k in range(blocks := -(-n // block_items)):
            block = items.filter((F.col("class") == size) & (F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k))
            found = sorted(((r.item_id, r.words) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            if size < 0:
                yield Verbatim(found)
                continue
            counts = {r.word: r.df for r in df.join(block.select(F.explode("words").alias("word")).distinct(), "word").collect()}
            yield Index(found, counts, total["n"], total["mean"], retrieve)


def _leaks(rows: DataFrame, index: Index | Verbatim, overlap: float, schema: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(index)
    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("bm25", pa.float64()), ("overlap", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for m in shared.value.match(t, overlap)]
            if found:
                yield from batches_of(out, [list(c) for c in zip(*found)])

    return rows.mapInArrow(run, schema)
