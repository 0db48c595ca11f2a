"""Prefix trie of conversations by van Emde Boas recursion over depth.

All turns are rows ``(conv, d, t1, t2)``. A trie of height 2 L is cut at half its depth: sequences that
reach the cut are grouped by their root and the content of their upper half, and the smallest member
names the cut prefix. The upper trie (the halves above) and the lower forests (one below each named
prefix) are tries of height L; all of them, at all depths, are cut together in the next round, so the
number of rounds follows the logarithm of the longest conversation. After the last cut every prefix of
every conversation has its name.

Totals go back upward: first within tries of height 1, then the totals of the lower tries below a cut
node are grafted onto it and its ancestors in the upper trie, which gives tries of twice the height.

No row holds a conversation: one of any length is dealt over tasks by (conv, block), and a prefix that
many conversations share is an aggregation with partial sums.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import global_row_number
from .textbuf import WORD, frozen, tasks

GROUP, HEADS = 20, 4
#: Decimal ids that are joined into one piece of a digest's input: 2 to this power.
PIECE_BITS = 12


def turns(conversations: DataFrame) -> DataFrame:
    """``(c, pos, t1, t2, words)``: the turns of each conversation, numbered from 0."""
    role, text = (F.coalesce(F.col(k).cast("string"), F.lit("")) for k in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("c"), F.col("turn"), F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), role, text).alias("t2"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
        F.monotonically_increasing_id().alias("same"))
    return global_row_number(rows, ["turn", "t1", "t2", "same"], ["c"], name="pos").select("c", "pos", "t1", "t2", "words")


def rebuilt(spark: SparkSession, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(convs(c, m), seq(c, m, d, t1, t2, words))``: lengths and turns (d from 1) of the rebuilt conversations."""
    # the driver of this step is the count of turns, one row for each conversation
    counts = own.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % HEADS
    base = F.col("c") - F.pmod("c", F.lit(GROUP))
    heads = F.pmod("c", F.lit(GROUP)) == 0
    bases = counts.where(heads).select(F.col("c").alias("b"), F.col("n").alias("nb"))
    convs = counts.select("c", "n", h.alias("h"), base.alias("b")).join(bases, "b", "left").select(
        "c", "b", "h", F.least("h", F.coalesce("nb", F.lit(0))).alias("p"), "n")
    convs = frozen(convs.withColumn("m", F.col("p") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    kept = own.where(F.col("pos") >= h).join(convs.select("c", "h", "p", "m"), "c").select(
        "c", "m", (F.col("pos") - F.col("h") + F.col("p") + 1).alias("d"), "t1", "t2", "words")
    first = own.where(heads & (F.col("pos") < HEADS - 1)).withColumnRenamed("c", "b")
    lead = convs.where("p > 0").join(first, "b").where("pos < p").select(
        "c", "m", (F.col("pos") + 1).alias("d"), "t1", "t2", "words")
    return convs.select("c", "m"), kept.unionByName(lead)


def blocks(seq: DataFrame, size: int) -> DataFrame:
    """``(c, a, x1, x2)``: content hash of every whole block of ``size`` turns that starts at depth ``a``
    (a multiple of 2 ``size``): the upper halves of the tries of height 2 ``size``."""
    at = F.col("d") - 1
    k = F.floor(at / F.lit(size))
    inside = at - k * F.lit(size)
    # each place of a block occurs once, so the exclusive or of hashed (place, turn) stands for the block
    marks = [F.xxhash64(F.lit(seed), inside, "t1", "t2") for seed in (3, 5)]
    halves = seq.where((F.col("m") >= size) & (k % 2 == 0) & ((k + 1) * F.lit(size) <= F.col("m")))
    if size == 1:
        return halves.select("c", at.alias("a"), *[m.alias(f"x{i + 1}") for i, m in enumerate(marks)])
    return halves.groupBy("c", (k * F.lit(size)).alias("a")).agg(
        *[F.bit_xor(m).alias(f"x{i + 1}") for i, m in enumerate(marks)])


def names(seq: DataFrame, longest: int) -> DataFrame:
    """``(c, d, name)`` for every ``d`` from 1 to the length of ``c``: the smallest conversation that has
    the same first ``d`` turns."""
    size = 1
    while 2 * size <= longest:
        size *= 2
    known = None
    while size:
        upper = blocks(seq, size)
        rooted = upper.where("a = 0").withColumn("root", F.lit(0).cast("bigint"))       # one trie starts at depth 0
        if known is not None:     # those that start deeper, at nodes named in an earlier round
            roots = known.where(F.col("d") % (2 * size) == 0).select("c", F.col("d").alias("a"), F.col("name").alias("root"))
            rooted = rooted.unionByName(upper.where("a > 0").join(roots, ["c", "a"]))
        rooted = frozen(rooted)
        key = ["root", "a", "x1", "x2"]
        # frozen, so that the join deals both sides anew and adaptive execution can split a common prefix
        low = frozen(rooted.groupBy(*key).agg(F.min("c").alias("name")))
        cut = frozen(rooted.join(low, key).select("c", (F.col("a") + size).alias("d"), "name"))
        known = cut if known is None else known.unionByName(cut)
        size //= 2
    return frozen(known)


def _digests(ends: DataFrame) -> DataFrame:
    """``(conv_id, depth, ends_sha256)`` of ``ends(conv_id, depth, c)``: the ids are joined into pieces by
    ranges of ``2^PIECE_BITS``; the pieces of a node are hashed as a stream, in order."""
    piece = F.shiftright("c", PIECE_BITS)
    joined = ends.groupBy("conv_id", "depth", piece.alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches):
        now, digest = None, None
        for batch in batches:
            out = []
            for conv, depth, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if (conv, depth) == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (conv, depth), hashlib.sha256(ids.encode())
            yield _digest_rows(out)
        if now is not None:
            yield _digest_rows([(*now, digest.hexdigest())])

    dealt = joined.repartition(tasks(joined), "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "piece")
    return dealt.mapInArrow(run, "conv_id bigint, depth bigint, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(3)],
                                      ["conv_id", "depth", "ends_sha256"])


def _grafted(nodes: DataFrame, paths: DataFrame, longest: int) -> DataFrame:
    """``nodes(conv_id, depth, parent_conv_id, leaves, saved)`` with the last two summed over subtrees."""
    size = 1
    while size < longest:
        # totals of the lower tries, at the cut nodes: depths that are odd multiples of size
        below = nodes.where((F.col("depth") - 1) % (2 * size) == size).groupBy(
            F.col("parent_conv_id").alias("u"), (F.col("depth") - 1).alias("at")).agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        below = below.withColumn("block", F.floor((F.col("at") - 1) / F.lit(size)))
        above = paths.where(F.col("m") >= size).withColumn("block", F.floor((F.col("d") - 1) / F.lit(size))).where("block % 2 = 0")
        # the conversation that names a cut node passes through all of the node's ancestors
        more = below.join(above, (F.col("u") == F.col("c")) & (below["block"] == above["block"])).groupBy(
            F.col("name").alias("conv_id"), F.col("d").alias("depth")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        nodes = frozen(nodes.join(more, ["conv_id", "depth"], "left").select(
            "conv_id", "depth", "parent_conv_id",
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
        size *= 2
    return nodes


def trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations of ``conversations(conv_id, turn, role, text)``.

    Turns are ordered by ``turn`` (null first; equal numbers by a hash of role and text, so that the
    order does not depend on the partitions; repeated rows are turns of their own); a null role or text
    is empty. Conversation c is rebuilt from the first h turns of conversation c - c % 20 and its own
    turns after its first h, with h = crc32(decimal c) % 4. Rows with a null conv_id go. Returns one row
    for each distinct sequence of first d rebuilt turns: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``; the
    root (depth 0) has all conversations as members. An empty table has no conversations and gives no
    rows. Other columns are not read. Turns are compared by 128 bits of hash of role and text.
    """
    spark = conversations.sparkSession
    convs, seq = rebuilt(spark, turns(conversations))
    convs, seq = frozen(convs), frozen(seq)
    total = convs.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("m").alias("longest")).first()
    schema = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
              "saved_tokens bigint, ends_sha256 string")
    if not total["n"]:
        return spark.createDataFrame([], schema)
    longest, top = int(total["longest"]), total["low"]
    nothing = hashlib.sha256(b"").hexdigest()
    if longest:
        named = names(seq, longest)
    else:
        named = spark.createDataFrame([], "c bigint, d bigint, name bigint")
    paths = named.join(convs, "c")
    members = named.groupBy(F.col("name").alias("conv_id"), F.col("d").alias("depth")).agg(F.count(F.lit(1)).alias("n_convs"))
    parents = named.select("c", (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    own = seq.join(named.where("c = name").select("c", "d"), ["c", "d"]).join(parents, ["c", "d"], "left").select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") == 1, F.lit(top)).otherwise(F.col("parent")).alias("parent_conv_id"), "words")
    nodes = frozen(own.join(members, ["conv_id", "depth"]))
    children = nodes.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = frozen(nodes.join(children, ["conv_id", "depth"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))))
    sums = nodes.select("conv_id", "depth", "parent_conv_id", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaves"),
                        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    sums = _grafted(sums, paths, longest)
    # the root's own totals: one row
    first = sums.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"),
                                        F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"),
                                        F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    root = first.select(
        F.lit(top).alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"),
        F.lit(total["n"]).alias("n_convs"), "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).alias("n_leaves"),
        F.col("saved").alias("saved_tokens"))
    rows = nodes.drop("parent_conv_id", "words").join(sums, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    ends = convs.where("m = 0").select(F.lit(top).alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), "c").unionByName(
        paths.where("d = m").select(F.col("name").alias("conv_id"), F.col("d").alias("depth"), "c"))
    return rows.unionByName(root).join(_digests(ends), ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
