"""The training-data pipeline over ``documents``: quality rules, SimHash near-dedup, benchmark
decontamination, mixing to target weights, sharding.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``docs``, whatever they
are; nulls, empty texts and repeated rows are handled as the operators' docstrings say, and empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from toposcope.llm import decontaminate, mixing, quality, sharding, simhash
from toposcope.llm.textbuf import table
from toposcope.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base counts or are depleted of own lines go."""
    return quality.accepted(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    return simhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a document the mix leaves out goes."""
    return mixing.mixture(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row: doc_id, size, text_crc32, shard, slot, group_key."""
    return sharding.shard(docs)


STAGES = [("quality_rules", quality_rules), ("simhash_dedup", simhash_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("source_mix", source_mix), ("shards", shards)]

#: The stages hash and search iteratively; SQL cannot express them. See tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``; intermediate tables go to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
