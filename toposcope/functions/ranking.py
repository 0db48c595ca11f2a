"""Distributed dense numbering and size-checked broadcasts.

``row_number() over (order by ...)`` without ``partitionBy`` moves every row into one task, so
corpus-sized numbering is done as: range-partition on the (total) sort key, sort inside each
partition, tag rows with ``monotonically_increasing_id`` (partition id in the high bits, local
index in the low 33 bits), freeze that with a reliable checkpoint (range bounds are sampled and the
tag is not deterministic, so neither may be recomputed after an executor loss), then add the row
counts of earlier partitions. The per-partition count table has one row per (partition, group): at most
partitions + groups rows, since a range partition shares at most one group with the one before. The
groups are estimated while the rows are frozen (an observed aggregate, no job of its own), and the table
is broadcast when that bound allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

_LOCAL_MASK = (1 << 33) - 1

# A table is broadcast only when its measured size is at most this; beyond it the join shuffles.
BROADCAST_MAX_BYTES = 128 << 20
# Beyond the limit the most frequent keys (a bounded top-k) are joined from a broadcast table, so
# that a hot word never gathers its rows in one partition.
HEAD_KEYS = 10_000


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _frozen_tags(tagged: DataFrame, group_names: list[str], n: int) -> tuple[DataFrame, int]:
    """The rows with partition ``_p`` and place ``_l``, frozen, and a bound of the (partition, group) pairs."""
    seen = Observation()
    groups = F.approx_count_distinct(F.struct(*group_names) if group_names else F.lit(0)).alias("groups")
    tagged = (tagged.withColumn("_p", F.shiftright("_m", 33).cast("int"))
                    .withColumn("_l", F.col("_m").bitwiseAND(F.lit(_LOCAL_MASK)))
                    .drop("_m").observe(seen, groups).checkpoint(eager=True))
    return tagged, n + int((seen.get.get("groups") or 0) * 1.25)      # the estimate is off by 5 % or so


def _hinted(stats: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table of at most ``rows`` rows of numbers and group columns."""
    width = 16 + sum(64 if isinstance(f.dataType, T.StringType) else 16 for f in stats.schema.fields)
    return F.broadcast(stats) if rows * width <= BROADCAST_MAX_BYTES else stats


def global_row_number(df: DataFrame, order_cols, group_cols=(), name: str = "rn",
                      num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in the order ``order_cols`` (within ``group_cols``).

    ``order_cols`` must make the order total within a group (end with a unique id).
    Pass a narrow frame (keys and ids only); join wider payloads back afterwards. Tables of every
    size take the same path.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    group_names = list(group_cols)
    keys = [_as_col(c) for c in group_names] + [_as_col(c) for c in order_cols]
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.repartitionByRange(n, *keys)
                .sortWithinPartitions(*keys)
                .withColumn("_m", F.monotonically_increasing_id()))
    tagged, rows = _frozen_tags(tagged, group_names, n)
    stats = tagged.groupBy("_p", *group_names).agg(F.count(F.lit(1)).alias("_n"),
                                                    F.min("_l").alias("_lo"))
    before = Window.partitionBy(*group_names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = tagged.join(_hinted(stats.select("_p", *group_names, "_lo", "_off"), rows), ["_p", *group_names])
    return (joined.withColumn(name, (F.col("_l") - F.col("_lo") + F.col("_off")).cast("bigint"))
                  .drop("_p", "_l", "_lo", "_off"))


def _width(field: T.StructField) -> Column:
    """Bytes of one value: text by its length, arrays by their elements, anything else 8."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(field.dataType, T.ArrayType):
        each = 24 if isinstance(field.dataType.elementType, (T.StringType, T.StructType)) else 8
        return F.greatest(F.size(c), F.lit(0)) * each + 16
    return F.lit(8)


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows of ``df`` by one aggregation (narrow columns, text and array lengths)."""
    row = sum((_width(f) for f in df.schema.fields), F.lit(16))
    return df.agg(F.coalesce(F.sum(row.cast("bigint")), F.lit(0)).alias("n")).first()["n"]


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only when the measured bytes are under ``max_bytes``."""
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df


def lookup_join(rows: DataFrame, side: DataFrame, on: str, how: str = "inner", weight: str | None = None,
                max_bytes: int = BROADCAST_MAX_BYTES, head_keys: int = HEAD_KEYS) -> DataFrame:
    """Join many ``rows`` to a table with one row per key (``how``: inner or left).

    A small table is broadcast. A larger one is split by ``weight`` (how often the key occurs among
    the rows): its ``head_keys`` heaviest keys are broadcast and their rows never move; all other
    rows meet the rest of the table in a shuffle join, where no key is hot any more.
    """
    value = [c for c in side.columns if c not in (on, weight)]
    if measured_bytes(side) <= max_bytes:
        return rows.join(F.broadcast(side.select(on, *value)), on, how)
    if weight is None:
        return rows.join(side.select(on, *value), on, how)
    head = (side.orderBy(F.col(weight).desc(), F.col(on)).limit(head_keys)
            .select(on, *value, F.lit(True).alias("_head")))
    marked = rows.join(F.broadcast(head), on, "left")
    hot = marked.where("_head").drop("_head")
    rest = marked.where("_head is null").drop("_head", *value).join(side.select(on, *value), on, how)
    return hot.unionByName(rest)


def global_running_sum(df: DataFrame, order_cols, group_cols, value_cols, num_partitions: int | None = None,
                       prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``value_cols`` (and the running row count ``<prefix>n``) in
    ``order_cols`` order within ``group_cols``, without putting a whole group into one task.

    Same scheme as :func:`global_row_number`: rows are range-partitioned on (group, order) so a
    hot group spans several partitions; inside a range partition a window on (partition, group)
    gives local running sums (bounded by the partition size); per-(partition, group) totals of
    earlier partitions are added from a small broadcast table. Values should be exact (integers)
    if the sums must not depend on the partitioning.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    group_names = list(group_cols)
    keys = [_as_col(c) for c in group_names] + [_as_col(c) for c in order_cols]
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                .withColumn("_m", F.monotonically_increasing_id()))
    tagged, rows = _frozen_tags(tagged, group_names, n)
    aggs = [F.count(F.lit(1)).alias("_tn")] + [F.sum(v).alias(f"_t_{v}") for v in value_cols]
    stats = tagged.groupBy("_p", *group_names).agg(*aggs)
    before = Window.partitionBy(*group_names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = [F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in value_cols]
    stats = stats.select("_p", *group_names,
                         F.coalesce(F.sum("_tn").over(before), F.lit(0)).alias("_on"), *offs)
    local = Window.partitionBy("_p", *group_names).orderBy("_l").rowsBetween(Window.unboundedPreceding, 0)
    out = tagged.join(_hinted(stats, rows), ["_p", *group_names])
    out = out.withColumn(f"{prefix}n", (F.count(F.lit(1)).over(local) + F.col("_on")).cast("bigint"))
    for v in value_cols:
        out = out.withColumn(f"{prefix}{v}", F.sum(v).over(local) + F.col(f"_o_{v}"))
    return out.drop("_p", "_l", "_on", *[f"_o_{v}" for v in value_cols])
