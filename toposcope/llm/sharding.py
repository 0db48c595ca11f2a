"""Sharding: minimax contiguous partition of ordered atomic groups.

Documents with equal texts are one atomic group. The groups stand in a fixed order and are cut
into contiguous shards so that the largest shard is as small as possible: the capacity is found by
binary search, each candidate is checked greedily, and the greedy cuts of the smallest feasible
capacity are the shards.

The greedy check needs "the last group that ends at or before x" a few dozen times per candidate.
Prefix sums of the sizes stay distributed; the driver holds a summary by blocks
of consecutive groups whose number depends on the number of shards only. On the summary the search runs twice: with cuts at block ends only
(an upper bound) and with blocks taken as divisible (a lower bound). Between the bounds every
possible cut lies in a few blocks; those are split into finer blocks by one more aggregation, until
all of them are single groups and the bounds meet. The result is the exact minimax partition.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import global_running_sum
from .textbuf import frozen, text_key

SHARDS, OVERHEAD, BLOCKS = 40, 16, 4096


class Blocks:
    """Consecutive blocks of groups by prefix sum: block i covers sizes ``(start[i], end[i]]``."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        rows = sorted(rows)
        self.start = np.array([r[0] for r in rows], np.int64)
        self.end = np.array([r[1] for r in rows], np.int64)
        self.single = np.array([r[2] == 1 for r in rows], bool)
        self.total = int(self.end[-1]) if rows else 0

    def reach(self, x: int, divisible: bool) -> int:
        """The furthest cut at or before ``x``; with ``divisible`` a block of several groups may be
        cut anywhere."""
        if x >= self.total:
            return self.total
        i = int(np.searchsorted(self.end, x, side="right"))      # the first block that ends after x
        if divisible and not self.single[i]:
            return max(x, int(self.start[i]))
        return int(self.start[i])

    def cuts(self, capacity: int, shards: int, divisible: bool) -> list[int]:
        """Greedy ends of the shards under ``capacity``; the last is short of the total if it fails."""
        out, at = [], 0
        for _ in range(shards):
            at = max(at, self.reach(at + capacity, divisible))
            out.append(at)
        return out

    def least(self, shards: int, divisible: bool) -> int:
        """The smallest capacity whose greedy check reaches the total."""
        lo, hi = -(-self.total // shards), self.total
        while lo < hi:
            mid = (lo + hi) // 2
            if self.cuts(mid, shards, divisible)[-1] >= self.total:
                hi = mid
            else:
                lo = mid + 1
        return lo


def minimax_cuts(groups: DataFrame, shards: int, blocks: int = BLOCKS) -> list[int]:
    """Prefix-sum values at which the shards of ``groups(start, size)`` end (the last is the total).
    ``start`` is the sum of the sizes of all groups before; sizes are positive.

    A block is all groups that start in one aligned stretch of 2^k; its finer blocks nest in it.
    Between the bounds cut j moves within about 2 j blocks, so a level splits some shards^2 blocks
    into 16 each: the driver's rows depend on the number of shards, not on the data."""
    total = groups.agg(F.max(F.col("start") + F.col("size"))).first()[0] or 0
    if not total:
        return [0] * shards
    bits = max(0, (-(-total // blocks) - 1).bit_length())

    def summary(df: DataFrame):
        rows = (df.groupBy(F.shiftright("start", bits).alias("_k"))
                .agg(F.min("start").alias("a"), F.max(F.col("start") + F.col("size")).alias("b"),
                     F.count(F.lit(1)).alias("n")).collect())
        return [(r["a"], r["b"], r["n"]) for r in rows]

    held = summary(groups)
    while True:
        view = Blocks(held)
        low, high = view.least(shards, True), view.least(shards, False)
        touched = np.zeros(len(view.start), bool)
        for a, b in zip(view.cuts(low, shards, False), view.cuts(high, shards, True)):
            touched |= (view.start <= b) & (view.end >= a)
        split = touched & ~view.single
        if not split.any():
            return view.cuts(high, shards, False)
        bits = max(0, bits - 4)
        ranges: list[list[int]] = []
        for a, b in zip(view.start[split].tolist(), view.end[split].tolist()):      # neighbours: one range
            if ranges and ranges[-1][1] == a:
                ranges[-1][1] = b
            else:
                ranges.append([a, b])
        finer = summary(groups.where(" or ".join(f"(start >= {a} and start < {b})" for a, b in ranges)))
        held = finer + [(a, b, 1 if one else 2) for a, b, one in
                        zip(view.start[~split].tolist(), view.end[~split].tolist(), view.single[~split].tolist())]


def shard(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """Deal every row of ``docs(doc_id, text)`` to one of ``shards`` shards of near equal bytes.

    Returns doc_id, size (UTF-8 bytes plus ``overhead``), text_crc32, shard, slot (gapless from 0
    within the shard) and ``group_key``, a hash of the text. Rows with equal texts (null counts as
    empty) are one group and stay together. A group larger than an equal share of what is left gets
    a shard of its own, so that it does not set the capacity of the others; all other groups, in
    the order of their text hash, are cut by :func:`minimax_cuts`. Repeated rows are separate rows
    of one group; null doc_ids are dealt like any other; with fewer groups than shards some shards
    are empty; an empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       (F.octet_length(text) + overhead).cast("bigint").alias("size"),
                       F.crc32(text).alias("text_crc32"), *text_key())
    rows = frozen(rows)
    by_text = rows.groupBy("_t1", "_t2").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    giants, left, rest = [], shards, total
    for r in by_text.orderBy(F.col("bytes").desc(), "_t1", "_t2").limit(shards).collect():
        if left > 1 and r["bytes"] * left > rest:
            giants.append((len(giants), r["_t1"], r["_t2"], r["bytes"]))
            left, rest = left - 1, rest - r["bytes"]
        else:
            break
    spark = docs.sparkSession
    side = spark.createDataFrame([g[:3] for g in giants], "_g int, _t1 bigint, _t2 bigint")
    ranked = rows.join(F.broadcast(side), ["_t1", "_t2"], "left").withColumn("_g", F.coalesce("_g", F.lit(shards)))
    run = global_running_sum(ranked, ["_g", "_t1", "_t2", "doc_id"], [], ["size"])
    run = frozen(run)
    ends = np.cumsum([g[3] for g in giants]).tolist() if giants else []
    base = ends[-1] if ends else 0
    groups = (run.where(F.col("_g") == shards).groupBy("_t1", "_t2")
              .agg((F.min(F.col("cum_size") - F.col("size")) - F.lit(base)).alias("start"), F.sum("size").alias("size")))
    cuts = ends + [base + c for c in minimax_cuts(frozen(groups.select("start", "size")), left)]
    place = F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts[:-1]]), lambda c: c < F.col("cum_size")))
    run = run.withColumn("shard", place.cast("int"))
    opening = run.groupBy("shard").agg(F.min("cum_n").alias("_first"))
    return run.join(F.broadcast(opening), "shard").select(        # one row per shard
        "doc_id", "size", "text_crc32", "shard", (F.col("cum_n") - F.col("_first")).cast("bigint").alias("slot"),
        F.lower(F.hex("_t1")).alias("group_key"))
