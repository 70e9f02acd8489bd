"""Exact top-k by inner product: no-random-access (NRA) aggregation over sorted lists, block of candidates by block.

A block of candidates has one sorted list for each component. For a query, each list is read from its good end (from the top
for a positive weight, from the bottom for a negative one), some entries of every list at a time. What has been read gives each
candidate a lower bound (components not yet read at their list's worst value) and an upper bound (at the value the list has come
to). Candidates whose upper bound is below the k-th lower bound are out. When no outsider can qualify, reading stops, and the
scores of those that are left are resolved as whole numbers. A query's k-th score goes on from block to block.

An unseen candidate's upper bound is the sum of what the lists have come to, and no other's is below it. Candidates are compared
once that sum is below the k-th lower bound, for before none could be out.

Queries are a table like the candidates. Both are cut in groups of bounded size, and each pair of a candidate group and a query
group is one task of a cogrouped job; it gives the k best of each query, and an aggregation keeps the best of all. One
group of candidates is searched first, so that the tasks of the others begin with the k-th score found there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Vector components in a group of candidates and in one of queries, about.
CANDIDATE_VALUES, QUERY_VALUES = 1 << 22, 1 << 20
#: Groups of candidates that are made in any case, if they have ``LEAST_ROWS`` each: they are what runs in parallel.
LEAST_GROUPS, LEAST_ROWS = 64, 4096
#: Queries in a block of those that meet the first group, if blocks are fewer than ``LEAST_GROUPS`` otherwise.
LEAST_QUERIES = 128
#: Candidates whose lists are sorted together.
BLOCK = 4096
#: Steps in which a list is read; bounds are compared after each.
STEPS = 8
#: Candidates left, as multiples of k or as a share of the block, at which their scores are resolved.
FEW, SHARE = 4, 1 / 32


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component, as whole numbers in doubles: scaling by 256 is exact."""
    return np.floor(x.astype(np.float64) * 256.0)


def inner_products(q: np.ndarray, x: np.ndarray) -> list[int]:
    """Exact inner products of a vector with rows, all whole numbers in doubles; an error where one passes 64 bits."""
    size = float(np.abs(q).max(initial=0.0)) * float(np.abs(x).max(initial=0.0)) * max(1, q.size)
    if size < 2.0**53:
        return (x @ q).astype(np.int64).tolist()
    weights = [int(v) for v in q]
    out = [sum(w * int(v) for w, v in zip(weights, row)) for row in x]
    if any(not -(1 << 63) <= s < 1 << 63 for s in out):
        raise OverflowError("an inner product passes 64 bits")
    return out


class SortedLists:
    """A block of candidates, ``x`` whole numbers in doubles, with a list for each component from either end."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        n, size = x.shape
        self.ids, self.x, self.each = ids, x, max(1, -(-n // STEPS))
        order = np.argsort(x, axis=0, kind="stable").T
        values = np.take_along_axis(x.T, order, axis=1)
        # Lists by direction (first all from the smallest, then all from the largest) and component.
        order, values = np.concatenate((order, order[:, ::-1])), np.concatenate((values, values[:, ::-1]))
        self.worst = values[:, -1].copy() if n else np.zeros(2 * size)
        with np.errstate(over="ignore"):
            gain = values - self.worst[:, None]
        #: By step: the candidates that each list gives, and what they have above the list's worst value; what the list has come to.
        self.read = [(np.ascontiguousarray(order[:, at : at + self.each]), np.ascontiguousarray(gain[:, at : at + self.each])) for at in range(0, n, self.each)]
        self.front = np.array([g[:, -1] for _, g in self.read]).reshape(len(self.read), 2 * size)
        #: Of each candidate, which entry of the lists from the smallest it is: what has been read of it follows from the depth.
        self.place = np.empty((n, size), np.int16 if n < 1 << 15 else np.int32)
        np.put_along_axis(self.place, order[:size].T, np.arange(n, dtype=self.place.dtype)[:, None], axis=0)
        self.largest = float(np.abs(x).max(initial=0.0))

    def search(self, q: np.ndarray, k: int, own: int, least: int | None = None) -> tuple[list[tuple[int, int]], int]:
        """score and id of the k best that reach ``least`` (higher scores first, then smaller ids), without ``own``; and how
        many entries of each list were read."""
        n = self.x.shape[0]
        alive, depth, few = np.flatnonzero(self.ids != own), 0, max(FEW * k, int(n * SHARE))
        end = (q > 0).astype(self.place.dtype)
        lists = np.arange(q.size) + q.size * end.astype(np.intp)
        # Sums of whole numbers are exact up to 2^53; beyond, bounds get the room that rounding may take.
        reach = float(np.abs(q).sum()) * self.largest
        room = 0.0 if reach < 2.0**51 else reach * (q.size + 4) * 2.0**-50
        sound = q.size > 0 and bool(np.isfinite(4.0 * (reach + self.largest)))
        if sound:
            worst, front = float((self.worst[lists] * q).sum()), self.front[:, lists] * q
            lower, unseen = np.full(n, worst), worst + front.sum(axis=1)
        for step, (order, gain) in enumerate(self.read):
            if not sound or alive.size <= few:
                break
            gain = np.take(gain, lists, axis=0)
            gain *= q[:, None]
            lower += np.bincount(np.take(order, lists, axis=0).ravel(), gain.ravel(), n)
            depth += order.shape[1]
            bounds = lower[alive]
            floor = np.partition(bounds, alive.size - k)[alive.size - k]
            if least is not None:
                floor = max(floor, float(least))
            if unseen[step] - room < floor:
                # From the largest, entry n - 1 - place: read or not, ~place tells it with no list turned around.
                unread = (np.take(self.place, alive, axis=0) ^ -end) >= (depth - n * end.astype(np.int64)).astype(end.dtype)
                alive = alive[bounds + unread @ front[step] >= floor - room]
        scores = inner_products(q, self.x[alive])
        found = sorted((-s, i) for s, i in zip(scores, self.ids[alive].tolist()) if least is None or s >= least)[:k]
        return [(-s, i) for s, i in found], depth


def best_of(queries: list[tuple[int, np.ndarray, int | None]], ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """query, id, score of the k best candidates of each query (id, vector, score to reach), block by block."""
    best: list[list[tuple[int, int]]] = [[] for _ in queries]
    for at in range(0, len(ids), BLOCK):
        lists = SortedLists(ids[at : at + BLOCK], x[at : at + BLOCK])
        for j, (own, q, least) in enumerate(queries):
            # All that is found reaches the score asked for.
            least = best[j][-1][0] if len(best[j]) == k else least
            found, _ = lists.search(q, k, own, least)
            best[j] = sorted(best[j] + found, key=lambda r: (-r[0], r[1]))[:k]
    return [(own, i, s) for (own, _, _), found in zip(queries, best) for s, i in found]


def _vectors(table: pa.Table, name: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and vectors of a table, by the vectors' length."""
    table = table.combine_chunks()
    column = table.column("x").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    ids, offsets, flat = table.column(name).to_numpy(), column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    return {int(z): (ids[rows], whole_numbers(flat[(offsets[:-1][rows][:, None] + np.arange(z)[None, :])])) for z in np.unique(sizes) for rows in [np.flatnonzero(sizes == z)]}


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x of vectors without null or non-finite components."""
    kind = dict(vectors.dtypes)["embedding"]
    x = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.col("x").isNotNull() & F.col("vec_id").isNotNull())
    return rows.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, query_values: int = QUERY_VALUES, candidate_values: int = CANDIDATE_VALUES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of each query with all other rows of ``vectors``
    (vec_id, embedding); queries are the rows whose vec_id is divisible by ``every``.

    A component x becomes floor(256 x), x as double, however large; scores are exact whole numbers, and one that passes 64 bits
    is an OverflowError. Ties go to the smaller vec_id. Rows with a null vec_id, and vectors that are null or hold a null or
    non-finite component, take no part. A query meets vectors of its own length; without components all scores are 0. All rows
    with the query's vec_id are its own. If several rows share a vec_id, the query is the smallest of their vectors, as arrays
    are ordered, and each row is a candidate. Fewer candidates than k give fewer rows, an empty table none; other columns are
    left."""
    # Dealt by row numbers, so that rows that repeat part too.
    rows = materialize(_usable(vectors).withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "vectors")
    asked = materialize(rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("x").alias("x")), "queries")
    n, values = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("x").cast("long")), F.lit(0))).first()
    m, asked_values = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("x").cast("long")), F.lit(0))).first()
    groups = max(1, -(-values // candidate_values), min(LEAST_GROUPS, n // LEAST_ROWS))
    blocks = max(1, -(-asked_values // query_values))
    rows = rows.withColumn("g", F.pmod("deal", F.lit(groups)))
    first = materialize(_searched(rows.filter("g = 0"), asked.withColumn("least", F.lit(None).cast("long")), [0], max(blocks, min(LEAST_GROUPS, m // LEAST_QUERIES)), k), "first")
    best = first
    if groups > 1:
        reached = first.groupBy(F.col("query_id").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
        asked = asked.join(reached, F.col("query_id") == F.col("of"), "left").select("query_id", "x", "least")
        best = first.union(_searched(rows.filter("g > 0"), asked, list(range(1, groups)), blocks, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(rows: DataFrame, asked: DataFrame, groups: list[int], blocks: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best rows (vec_id, x, g) of each of the groups for each query (query_id, x, least), of those
    that reach its ``least`` score if it has one. Queries are dealt out over so many blocks."""
    pair = (F.col("g") * blocks + F.col("b")).alias("pair")
    left = rows.select("vec_id", "x", "g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")).select(pair, "vec_id", "x")
    right = asked.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    right = right.select("query_id", "x", "least", "b", F.explode(F.sequence(F.lit(groups[0]), F.lit(groups[-1]))).alias("g")).select(pair, "query_id", "x", "least")

    def search(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        rows, asked = _vectors(candidates, "vec_id"), _vectors(queries, "query_id")
        least = dict(zip(*(queries.column(c).to_pylist() for c in ("query_id", "least"))))
        found = [r for z, (own, q) in asked.items() if z in rows for r in best_of([(i, v, least[i]) for i, v in zip(own.tolist(), q)], *rows[z], k)]
        return pa.table({c: pa.array([r[i] for r in found], pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))})

    # As many parts as tasks: the rows are few bytes for the work in them, so parts are not to be put together by size.
    parts = max(1, min(2 * len(groups) * blocks, 10_000))
    left, right = left.repartition(parts, "pair"), right.repartition(parts, "pair")
    return left.groupBy("pair").cogroup(right.groupBy("pair")).applyInArrow(search, "query_id long, vec_id long, score long")
