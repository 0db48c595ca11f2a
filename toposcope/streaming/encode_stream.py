"""Structured Streaming use of the narrow operators.

The reference has no streaming operator. What carries over unchanged to a stream are the
per-row stages: cleaning (P9), encoding against a static vocabulary (J1 as a stream–static
broadcast join) and sentence-level lookups. Per-document positions need a window over the whole
document, which a micro-batch does not guarantee, so the streamed form keeps the source position
``src_pos`` instead of the dense re-numbered ``pos``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ranking import broadcast_if_small
from ..functions.text import clean_token_array
from ..session import scratch_path


def encode_stream(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Streaming ``(doc_id, text)`` → ``(doc_id, src_pos, token_id)``; the vocabulary is a static
    side, broadcast when its counted size is under the limit (else a stream–static shuffle join)."""
    toks = docs.select("doc_id", F.posexplode(clean_token_array(F.col("text"))).alias("src_pos", "word"))
    return toks.join(broadcast_if_small(vocab.select("word", "token_id")), "word").select(
        "doc_id", F.col("src_pos").cast("bigint").alias("src_pos"), "token_id")


def start_encoded_sink(spark: SparkSession, source_dir: str, schema: str, vocab: DataFrame,
                       out_dir: str, checkpoint: str | None = None,
                       once: bool = True) -> StreamingQuery:
    """Read parquet files arriving in ``source_dir``, encode them and append to ``out_dir``.
    The checkpoint lives under the session's shared checkpoint directory unless given."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    q = (encode_stream(stream.select("doc_id", "text"), vocab).writeStream
         .format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
         .outputMode("append"))
    if once:
        q = q.trigger(availableNow=True)
    return q.start()
