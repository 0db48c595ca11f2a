"""Connected components of a distributed edge list (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import gathered


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)`` (bigint); the root is the smallest node
    of the component. Self-loops are ignored; an empty edge list gives an empty result.

    Each round hangs all larger neighbours of a node, then all smaller ones, on the smallest node
    they know; stars remain when nothing changes, after a number of rounds that grows with the
    logarithm of the longest chain. A round is two aggregations and two joins on the node; the
    neighbours of a hub are rows, never one list, and adaptive execution can split them. Each
    round's edges go to the shared checkpoint folder, so lineage stays short; equal ones (at most as many
    as there are edges) go at the end of a round.
    """
    now = gathered(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .distinct())
    state = _state(now)
    while state[0]:
        ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = now.select(F.inline(ways))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        ways = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        now = gathered(hung.select(F.inline(ways)).where("u <> v").distinct())
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
