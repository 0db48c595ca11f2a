"""Mixing sources to target weights.

Every document gets a hash-random key; rows are range-sorted by (source, key), prefix sums of the
word counts run over the sorted partitions, and each source is cut at its exact budget. A budget
above the source's size takes whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import global_row_number, global_running_sum
from .textbuf import WORD, broadcast_counted, frozen, repeated, text_key

WEIGHTS, TOTAL_SHARE, MAX_EPOCHS = (5, 2, 1), 1.5, 2


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = TOTAL_SHARE,
            most: float = MAX_EPOCHS) -> tuple[DataFrame, int]:
    """``(_null, _s, source_size, target)``, frozen, of the sources ``sizes(_null, _s, source_size)``, and
    their number. ``share`` of all words is dealt by weight (``weights`` in order of the sources,
    repeating); sources over ``most`` times their size stop there and the excess goes to the others by
    weight, until none is above.

    In order of size over weight the sources that stop come first. Prefix sums in that order give, at
    each source, the words and weights left when all before it stop; the first one that can take its
    part of them ends the list. So the driver holds a few numbers however many sources there are."""
    place = global_row_number(sizes, ["_null", "_s"], name="_i")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int"))
    ranked = place.withColumn("_w", weight.cast("bigint"))
    ranked = frozen(global_running_sum(ranked.withColumn("_r", F.col("source_size") / F.col("_w")), ["_r", "_i"], [],
                                       ["source_size", "_w"]).drop("_i"))
    whole = ranked.agg(F.count(F.lit(1)).alias("n"), F.sum("source_size").alias("words"), F.sum("_w").alias("w")).first()
    total = share * (whole["words"] or 0)
    rest = F.lit(total) - most * (F.col("cum_source_size") - F.col("source_size"))
    left = F.lit(whole["w"] or 0) - F.col("cum__w") + F.col("_w")
    ends = ranked.where(rest * F.col("_w") / left <= most * F.col("source_size")).agg(
        F.min(F.struct(F.col("cum_n").alias("k"), rest.alias("rest"), left.alias("left"))).alias("e")).first()["e"]
    full = F.lit(float(most)) * F.col("source_size")
    part = full if ends is None else F.when(F.col("cum_n") < ends["k"], full).otherwise(
        F.lit(float(ends["rest"])) * F.col("_w") / F.lit(ends["left"]))
    return ranked.select("_null", "_s", "source_size", part.alias("target")), whole["n"]


def _mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, most: int = MAX_EPOCHS,
        seed: int = 42) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("size"),
                       F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                                         F.coalesce("text", F.lit("")))).alias("key"), *text_key())
    rows = rows.withColumn("_null", F.col("source").isNull()).withColumn("_s", F.coalesce("source", F.lit("")))
    running = global_running_sum(rows, ["key", "doc_id", "size"], ["_null", "_s"], ["size"])
    sizes = frozen(running.groupBy("_null", "_s").agg(F.sum("size").alias("source_size")))
    side, n = targets(sizes, weights, share, most)
    out = running.join(broadcast_counted(side, n), ["_null", "_s"])
    size, whole = F.col("size"), F.col("source_size")
    budget = F.floor(F.col("target")).cast("bigint")
    epochs = F.when(whole > 0, F.least(F.expr("floor(target) div greatest(source_size, 1)"), F.lit(most)))
    out = out.withColumn("_e", F.coalesce(epochs, F.lit(0)).cast("bigint"))
    part = F.greatest(F.lit(0), F.least(size, budget - F.col("_e") * whole - (F.col("cum_size") - size)))
    out = out.withColumn("_part", F.when(F.col("_e") >= most, F.lit(0)).otherwise(part).cast("bigint"))
    extra = (F.col("_part") > 0) & (2 * F.col("_part") >= size)
    return out.select("doc_id", "source", "_t1", "_t2", "key", "size", "source_size", "target",
                      (F.col("_e") * size + F.col("_part")).alias("taken"),
                      (F.col("_e") + extra.cast("bigint")).alias("passes"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, most: int = MAX_EPOCHS,
        seed: int = 42) -> DataFrame:
    """How often the mix takes each row of ``docs(doc_id, text, source)``.

    Returns doc_id, source, size (words; null or empty text: 0), source_size, target (double),
    taken (words the mix takes, repeats counted) and passes (whole copies: the document at the cut
    counts if at least half of it fits). With target T and source size S the first floor(T / S)
    epochs take everything, the next takes the documents in key order until the words left are
    used up, the last of them in part. Reruns agree: keys are hashes of the row and ties are equal
    rows. Null sources are one source, sorted last. Empty tables give an empty result; other
    columns are not read.

    The targets are set on the table of sources, which may be as many as hosts.
    """
    return _mixed(docs, weights, share, most, seed).drop("_t1", "_t2")


def mixture(docs: DataFrame, weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, most: int = MAX_EPOCHS,
            seed: int = 42) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as :func:`mix` has ``passes``."""
    taken = _mixed(docs, weights, share, most, seed).groupBy("doc_id", "source", "_t1", "_t2").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("passes").alias("n")).where("n > 0")
    return repeated(docs, frozen(taken), ["doc_id", "source"])
