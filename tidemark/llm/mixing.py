"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree, with DataFrame functions only.

1. Every source gets a target in words (``targets``) and its documents a random order by a hash, in which they are taken whole
   until the target is met; past the end of a source its order starts again. Only the document at the edge is cut.
2. Taken documents form blocks of ``BLOCK_DOCS``. The tree starts with all sources' block quotas, a row for each group of
   ``GROUP`` sources. Each level splits every node's quotas between two halves of its output shards: the left half's quotas are
   a draw from the multivariate hypergeometric distribution, first among the groups, then within each, so shards get exact
   sizes and sources exact quotas, as if all blocks were shuffled.
3. The quotas give each shard a range of a source's permuted blocks; ranges are disjoint, and rows of a table that draws are
   joined with by source and stretch of blocks. Shards are shuffled locally.

Orders within a source are ranks in small hash buckets plus the buckets' running totals, so no task holds a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, free_name, materialize, running_total

#: Weights of the sources in order, repeating, and the mix's size as a share of all words.
WEIGHTS, SHARE = (5, 2, 1), 1.5
#: A source gives at most so many times its words.
MOST = 2
BLOCK_DOCS = 16
#: Words in an output shard, about: their number is a power of two that follows the size of the mix.
SHARD_WORDS = 2_000_000
#: Documents in a bucket of a source's order, about.
BUCKET = 1024
SEED = 17
#: Sources whose quotas are one array.
GROUP = 256
#: Multipliers of the block permutation; a source with fewer blocks than 10^24 has one that is prime to their number.
PRIMES = (1_000_003, 999_983, 999_979, 999_961)


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, h: whole words of each text and a random number for its row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), text.alias("text"))
    return rows.select("doc_id", "source", "size", F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("h"))


def _ranked(sources: DataFrame) -> DataFrame:
    """Add k, the place of each source in code point order, null last: places within ranges, plus the ranges' running totals."""
    order = F.col("source").asc_nulls_last()
    parts = sources.repartitionByRange(order).sortWithinPartitions(order)
    # The number of a row in its partition is in the lower 33 bits.
    parts = materialize(parts.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "sources")
    before = running_total(parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0)), ["all"], "part", "n", "before")
    return parts.join(before.select("part", "before"), "part").withColumn("k", F.col("before") + F.col("at")).drop("part", "at", "before")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, k (its place in code point order, null last), n_docs, source_size, target.

    Shares by weight are held to ``most`` times a source's size; the excess goes to the others by weight, until none is above.
    That is one water level for all sources below their limit; it is found by steps on three sums."""
    sources = _ranked(sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, held = 0.0, -1
    while True:
        full = F.col("w") * level >= F.col("cap")
        sums = sources.agg(
            F.coalesce(F.sum(F.when(full & (F.lit(held) >= 0), F.col("cap"))), F.lit(0.0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full | (F.lit(held) < 0), F.col("w"))), F.lit(0.0)).alias("free"),
            F.coalesce(F.sum(F.when(full & (F.lit(held) >= 0), 1)), F.lit(0)).alias("n"),
        ).first()
        if sums["n"] == held or sums["free"] == 0:
            break
        level, held = max(0.0, total - sums["capped"]) / sums["free"], sums["n"]
    if total <= 0:
        level = 0.0
    return sources.select("source", "k", "n_docs", "source_size", F.least("cap", F.col("w") * F.lit(level)).alias("target"))


def _log_factorial(x: Column) -> Column:
    """Logarithm of x!: exact to 20, then Stirling's series."""
    z = x.cast("double") + 1.0
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z)
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """A draw: how many of ``drawn`` from ``total`` are among ``good``; by inversion of ``u`` outwards from the mode."""
    log_choose = lambda n, k: _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)

    def bounds(v: Column) -> Column:
        lo, hi = F.greatest(F.lit(0).cast("long"), v["drawn"] - v["bad"]), F.least(v["good"], v["drawn"])
        mode = F.floor((v["drawn"] + 1) * ((v["good"] + 1) / (v["total"] + 2)))
        return F.struct(v["total"].alias("total"), v["good"].alias("good"), v["bad"].alias("bad"), v["drawn"].alias("drawn"), v["u"].alias("u"), lo.alias("lo"), hi.alias("hi"), F.greatest(lo, F.least(hi, mode.cast("long"))).alias("mode"))

    def chances(v: Column) -> Column:
        p = F.exp(log_choose(v["good"], v["mode"]) + log_choose(v["bad"], v["drawn"] - v["mode"]) - log_choose(v["total"], v["drawn"]))
        share = v["good"] / F.greatest(v["total"], F.lit(1))
        steps = F.least(v["hi"] - v["lo"], F.ceil(12 * F.sqrt(v["drawn"] * share * (1 - share)) + 20).cast("long"))
        return F.struct(v.alias("v"), p.alias("p"), steps.alias("steps"))

    def invert(w: Column) -> Column:
        v, p = w["v"], w["p"]
        start = F.struct(p.alias("right"), p.alias("left"), p.alias("sum"), F.when(v["u"] < p, v["mode"]).alias("found"))

        def both(acc: Column, t: Column) -> Column:
            """The next value on either side, and its chance."""
            x, y = v["mode"] + t, v["mode"] - t
            right = F.when(x > v["hi"], F.lit(0.0)).otherwise(acc["right"] * ((v["good"] - x + 1) * (v["drawn"] - x + 1).cast("double")) / (x * (v["bad"] - v["drawn"] + x).cast("double")))
            left = F.when(y < v["lo"], F.lit(0.0)).otherwise(acc["left"] * ((y + 1) * (v["bad"] - v["drawn"] + y + 1).cast("double")) / ((v["good"] - y) * (v["drawn"] - y).cast("double")))
            return F.struct(acc["sum"].alias("sum"), right.alias("right"), left.alias("left"), x.alias("x"), y.alias("y"))

        def step(acc: Column, t: Column) -> Column:
            def move(n: Column) -> Column:
                hit = F.when((v["u"] < n["sum"] + n["right"]) & (n["right"] > 0), n["x"]).when((v["u"] < n["sum"] + n["right"] + n["left"]) & (n["left"] > 0), n["y"])
                return F.struct(n["right"].alias("right"), n["left"].alias("left"), (n["sum"] + n["right"] + n["left"]).alias("sum"), hit.alias("found"))

            return F.when(acc["found"].isNotNull(), acc).otherwise(_let(both(acc, t), move))

        found = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(w["steps"], F.lit(1).cast("long"))), start, step, lambda acc: F.coalesce(acc["found"], v["mode"]))
        return F.when(v["hi"] <= v["lo"], v["lo"]).otherwise(found)

    total, good, drawn = (c.cast("long") for c in (total, good, drawn))
    given = F.struct(total.alias("total"), good.alias("good"), (total - good).alias("bad"), drawn.alias("drawn"), u.alias("u"))
    return _let(_let(_let(given, bounds), chances), invert)


def _uniform(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _fold(total: Column, room: Column, quota: Column, *seed: Column) -> Column:
    """The left half's share of each quota of an array, one after another, given what those before took."""

    def draw(acc: Column, q: Column) -> Column:
        n = hypergeometric(acc["total"], q, acc["room"], _uniform(*seed, F.size(acc["left"])))
        return _let(n, lambda n: F.struct((acc["total"] - q).alias("total"), (acc["room"] - n).alias("room"), F.concat(acc["left"], F.array(n)).alias("left")))

    start = F.struct(total.cast("long").alias("total"), room.cast("long").alias("room"), F.array().cast("array<long>").alias("left"))
    return F.aggregate(quota, start, draw, lambda acc: acc["left"])


def _sum(quota: str) -> Column:
    return F.aggregate(quota, F.lit(0).cast("long"), lambda a, x: a + x)


def _rooms(nodes: DataFrame, level: int, seed: int) -> DataFrame:
    """Add room, how much of each group of a node goes to the left half: a draw among the groups of the node."""
    sums = nodes.groupBy(F.col("shard").alias("of")).agg(F.array_sort(F.collect_list(F.struct("group", "total"))).alias("parts"))
    totals = F.transform("parts", lambda p: p["total"])
    sums = sums.withColumn("totals", totals).withColumn("all", _sum("totals"))
    drawn = _fold(F.col("all"), F.ceil(F.col("all") / 2), F.col("totals"), F.lit(seed), F.lit(level), F.col("of"), F.lit(-1))
    rooms = sums.withColumn("drawn", drawn).select("of", F.explode(F.arrays_zip(F.transform("parts", lambda p: p["group"]).alias("group"), F.col("drawn").alias("room"))).alias("g"))
    rooms = rooms.select("of", F.col("g.group").alias("its"), F.col("g.room").alias("room"))
    return nodes.join(rooms, (F.col("shard") == F.col("of")) & (F.col("group") == F.col("its"))).drop("of", "its")


def split_quotas(quotas: DataFrame, levels: int, seed: int = SEED) -> DataFrame:
    """shard, group, quota: the tree over ``quotas``, a row (group, quota: an array of longs) for each group of sources. A table
    without groups is one."""
    many = "group" in quotas.columns
    nodes = quotas.select(F.lit(0).cast("long").alias("shard"), F.col("group") if many else F.lit(0).cast("long").alias("group"), "quota")
    for level in range(levels):
        nodes = nodes.withColumn("total", _sum("quota"))
        nodes = _rooms(nodes, level, seed) if many else nodes.withColumn("room", F.ceil(F.col("total") / 2).cast("long"))
        nodes = nodes.withColumn("left", _fold(F.col("total"), F.col("room"), F.col("quota"), F.lit(seed), F.lit(level), F.col("shard"), F.col("group")))
        right = F.zip_with("quota", "left", lambda q, n: q - n)
        halves = F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("quota")), F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("quota")))
        nodes = nodes.select("group", F.explode(halves).alias("half")).select("half.shard", "group", "half.quota")
        if level % 4 == 3:  # short plans; the tree starts as few rows, and later its branches are worked on apart
            nodes = materialize(nodes.repartition("shard") if level > 4 else nodes, "nodes")
    return nodes


def _ranges(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """rk, stretch, low, high, shard: for each source the ranges of permuted blocks that shards take, a row for each stretch of
    blocks that a range meets; a source has about as many stretches as there are shards."""
    own = split_quotas(quotas, levels, seed).select("shard", "group", F.posexplode("quota").alias("pos", "n")).filter("n > 0")
    # Written, for it is used several times below and is the end of a long plan.
    own = materialize(own.select((F.col("group") * GROUP + F.col("pos")).alias("rk"), "shard", "n"), "quotas")
    own = running_total(own, ["rk"], "shard", "n", "low").withColumn("high", F.col("low") + F.col("n"))
    total = own.groupBy(F.col("rk").alias("of")).agg(F.ceil(F.sum("n") / float(1 << levels)).cast("long").alias("width"))
    own = own.join(total, F.col("rk") == F.col("of")).drop("of", "n")
    stretches = F.sequence(F.floor(F.col("low") / F.col("width")), F.floor((F.col("high") - 1) / F.col("width")))
    return own.withColumn("stretch", F.explode(stretches)).select("rk", "stretch", "low", "high", "width", "shard")


def shard_levels(words: int) -> int:
    """Levels of the tree for a mix of so many words: four shards at least."""
    return max(2, math.ceil(math.log2(max(1, words) / SHARD_WORDS)))


def plan_mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, levels: int | None = None, block_docs: int = BLOCK_DOCS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, h, taken and draws of each row of ``docs`` (doc_id, source, text).

    ``size`` counts the words of the whole text (null: 0); ``taken`` the words that the mix takes of it, repeats counted;
    ``draws`` has a struct (epoch, words, shard, block) for each time. The shards are two to the power ``levels``, by default by size. A source's taken words are its target's, rounded to
    whole words and held to twice its size. Very long texts are counted whole. Texts without words are in no draw. A null source is a source of its own, the last in order. Equal rows
    are documents each. Without words, or in an empty table, targets and draws are 0 and empty. Other columns are left."""
    rows = materialize(sized(docs, seed), "sizes")
    sources = targets(rows, weights, share).withColumn("quota_words", F.least(F.round("target").cast("long"), F.col("source_size") * MOST))
    sources = materialize(sources, "targets")
    if levels is None:
        levels = shard_levels(sources.agg(F.sum("quota_words")).first()[0] or 0)

    # The random order of each source: places and words before each document.
    own = sources.select(F.col("source").alias("of"), "k", "n_docs", "source_size", "target", "quota_words")
    rows = rows.join(own, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    n_buckets = F.ceil(F.col("n_docs") / BUCKET)
    rows = rows.withColumn("bucket", F.floor(_uniform(F.col("h"), F.lit(seed)) * n_buckets).cast("long"))
    buckets = rows.groupBy("k", "bucket").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("words"))
    buckets = running_total(running_total(buckets, ["k"], "bucket", "docs", "docs_before"), ["k"], "bucket", "words", "words_before")
    buckets = buckets.select(F.col("k").alias("bk"), F.col("bucket").alias("bb"), "docs_before", "words_before")
    inside = Window.partitionBy("k", "bucket").orderBy("h", "doc_id", "size")
    rows = rows.join(buckets, (F.col("k") == F.col("bk")) & (F.col("bucket") == F.col("bb"))).drop("bk", "bb")
    rows = rows.withColumn("rank", F.col("docs_before") + F.row_number().over(inside) - 1)
    rows = rows.withColumn("start", F.col("words_before") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    # Each time that the order comes to the document before the quota is full.
    epochs = F.sequence(F.lit(0).cast("long"), F.lit(MOST - 1).cast("long"))
    taken = F.filter(
        F.transform(epochs, lambda e: F.struct(e.alias("epoch"), (e * F.col("n_docs") + F.col("rank")).alias("place"), F.least(F.col("size"), F.col("quota_words") - e * F.col("source_size") - F.col("start")).alias("words"))),
        lambda d: d["words"] > 0,
    )
    rows = rows.withColumn("draws", taken).drop("bucket", "docs_before", "words_before", "rank", "start")
    rows = materialize(rows, "draws")

    # Places may skip texts without words: blocks are counted up to the last place of each source.
    last = rows.groupBy("k").agg(F.max(F.array_max(F.transform("draws", lambda d: d["place"]))).alias("last"))
    blocks = materialize(last.select("k", F.coalesce(F.floor(F.col("last") / block_docs) + 1, F.lit(0)).cast("long").alias("blocks")), "blocks")
    group = F.floor(F.col("k") / GROUP)
    quotas = blocks.groupBy(group.alias("group")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "blocks"))), lambda s: s["blocks"]).alias("quota"))
    if blocks.filter(F.col("k") >= GROUP).isEmpty():
        quotas = quotas.select("quota")
    ranges = materialize(_ranges(quotas, levels, seed), "ranges")

    prime = F.coalesce(*[F.when(F.col("blocks") % p != 0, F.lit(p)) for p in PRIMES]).cast("long")
    width = F.greatest(F.ceil(F.col("blocks") / float(1 << levels)).cast("long"), F.lit(1))
    sized_ = blocks.select(F.col("k").alias("ek"), "blocks", prime.alias("prime"), width.alias("step"))
    rows = rows.join(sized_, F.col("k") == F.col("ek")).drop("ek")
    for e in range(MOST):
        # The place of the draw of this round among the permuted blocks, and the range of a shard that holds it.
        drawn = F.get(F.filter("draws", lambda d, e=e: d["epoch"] == e), F.lit(0))
        at = F.pmod(F.floor(drawn["place"] / block_docs).cast("long") * F.col("prime") + F.pmod(F.xxhash64(F.lit(seed), F.col("k")), F.lit(1_000_000_007)), F.col("blocks"))
        rows = rows.withColumn(f"at{e}", at)
        # Rows without a draw meet nothing, and not all in one task.
        rows = rows.withColumn("stretch", F.coalesce(F.floor(F.col(f"at{e}") / F.col("step")), -1 - F.pmod("h", F.lit(4096)))).withColumn("of", F.col("k"))
        own = ranges.select("rk", F.col("stretch").alias("its"), "low", "high", F.col("shard").alias(f"shard{e}"))
        meet = (F.col("of") == F.col("rk")) & (F.col("stretch") == F.col("its")) & (F.col(f"at{e}") >= F.col("low")) & (F.col(f"at{e}") < F.col("high"))
        rows = rows.join(own, meet, "left").drop("rk", "its", "low", "high", "stretch", "of")

    def placed(d: Column) -> Column:
        one = lambda name: F.element_at(F.array(*[F.col(f"{name}{e}") for e in range(MOST)]), (d["epoch"] + 1).cast("int"))
        return F.struct(d["epoch"].alias("epoch"), d["words"].alias("words"), one("shard").alias("shard"), one("at").alias("block"))

    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "h",
        F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]).alias("taken"),
        F.transform("draws", placed).alias("draws"),
    )


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, levels: int | None = None, block_docs: int = BLOCK_DOCS, seed: int = SEED) -> DataFrame:
    """The mix itself: the columns of ``docs`` with a row for each draw, dealt by shard and shuffled within. Rows with the same
    doc_id, source and text stand for each other: which of them a draw takes is open.

    A draw that is not the whole document holds its first words, joined by single spaces. See ``plan_mix`` for the rest."""
    plan = plan_mix(docs, weights, share, levels, block_docs, seed).filter(F.size("draws") > 0)
    id_, h, copy, draw, size, draws = (free_name(docs, n) for n in ("mix_id", "mix_hash", "mix_copy", "mix_draw", "mix_size", "mix_draws"))
    same = Window.partitionBy(id_, h).orderBy(h)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    left = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(h, F.xxhash64(F.lit(seed), F.col(id_), F.col("source").cast("string"), text)).withColumn(copy, F.row_number().over(same))
    of, its, nth = (free_name(docs, n) for n in ("plan_id", "plan_hash", "plan_copy"))
    right = plan.select(F.col("doc_id").alias(of), F.col("h").alias(its), F.col("size").alias(size), F.col("draws").alias(draws))
    right = right.withColumn(nth, F.row_number().over(Window.partitionBy(of, its).orderBy(F.size(draws))))
    rows = left.join(right, F.col(id_).eqNullSafe(F.col(of)) & (F.col(h) == F.col(its)) & (F.col(copy) == F.col(nth)))
    rows = rows.withColumn(draw, F.explode(draws))
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col(draw)["words"].cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col(draw)["words"] == F.col(size), F.col("text")).otherwise(words))
    order = F.xxhash64(F.lit(seed), F.col(draw)["epoch"], h)
    # Spark's own number of partitions; a shard is whole in one of them.
    return rows.repartition(F.col(draw)["shard"]).sortWithinPartitions(F.col(draw)["shard"], order).select(*docs.columns)
