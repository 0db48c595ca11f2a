"""Vectorised views of Arrow text columns and the Spark helpers the operators share.

A string column arrives in a task as one UTF-8 byte buffer and an offset array. The helpers here
find words, hash them and hash word windows with NumPy over that buffer, so tasks hold no Python
object per word. All hashes are functions of the bytes alone: the same words give the same hash
in every task and on every rerun.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

#: ``[^\x20\x09-\x0D]+``: what the contracts call a word.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"

#: Text bytes handled at once in a task. One longer text is handled whole, by itself.
CHUNK_BYTES = 2 << 20

#: A side of a join is broadcast only when it was counted and its entries take at most this many bytes.
BROADCAST_BYTES = 128 << 20

_U = np.uint64


def _splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` well-mixed 64-bit numbers (splitmix64 of seed + index)."""
    x = (np.arange(1, n + 1, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15)
    return mix64(x)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _splitmix(256, 17)
MULT = _U(0x9FB21C651E98DF25)
_STEP = _U(0xD6E8FEB86659FD93)          # odd, so it has an inverse modulo 2^64
_STEP_INV = _U(pow(int(_STEP), -1, 1 << 64))

_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


# ---------------------------------------------------------------- Arrow text

def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; a null is an empty text."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    _, off, data = column.buffers()
    offs = np.frombuffer(off, dtype=width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offs[0]:offs[-1]]
    return raw, offs - offs[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` text bytes each (or one longer text)."""
    n = batch.num_rows
    _, offs = utf8(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


def word_spans(data: np.ndarray, offs: np.ndarray, word_byte: np.ndarray | None = None
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ``starts`` and ``ends`` of all words, and ``first``: words of text i are
    ``first[i]:first[i + 1]``. ``word_byte``: a mask over ``data`` (default: not ASCII white)."""
    mask = _WORD_BYTE[data] if word_byte is None else word_byte
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    start = mask.copy()
    start[1:] &= ~mask[:-1]
    end = mask.copy()
    end[:-1] &= ~mask[1:]
    cut = offs[:-1][offs[:-1] < len(data)]
    start[cut] = mask[cut]                       # a word never runs on into the next text
    cut = offs[1:][offs[1:] > 0] - 1
    end[cut] = mask[cut]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes: one step for the k-th byte of all words that have it."""
    n = ends - starts
    h = n.astype(_U) * MULT
    live = np.arange(len(n))
    k = 0
    while len(live):
        h[live] = (h[live] ^ _BYTE[data[starts[live] + k]]) * MULT
        k += 1
        live = live[n[live] > k]
    return mix64(h)


class RangeHash:
    """Hashes of word ranges ``[a, b)`` of one word-hash array, position-independent."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self._inv = np.ones(n + 1, _U)
        power = np.ones(n + 1, _U)
        if n:
            power[1:] = _STEP
            power = np.multiply.accumulate(power)
            self._inv[1:] = _STEP_INV
            self._inv = np.multiply.accumulate(self._inv)
        self._sum = np.zeros(n + 1, _U)
        np.cumsum(words * power[:n], out=self._sum[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray, lead: np.ndarray | np.uint64 = _U(0)) -> np.ndarray:
        """``lead`` is added to the hash of the first word of each range."""
        return mix64((self._sum[b] - self._sum[a]) * self._inv[a] + lead + (b - a).astype(_U) * MULT)


def sliding(values: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """``pick`` (np.minimum / np.maximum) over every ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


# ---------------------------------------------------------------- Spark helpers

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def frozen(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared checkpoint folder: later reads survive the
    loss of executors and values that depend on task order (row marks) do not change."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """The frame, :func:`frozen`, read by one task for about every ``rows`` of its counted rows where it has
    more partitions than that: every task that shuffles leaves files, be it of a few rows."""
    kept = frozen(df)
    return kept.coalesce(max(-(-kept.count() // rows), 1))


def fits_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``rows`` counted rows (with arrays: elements) of ``df`` stay within ``limit`` bytes, 64 for a
    text and 16 for any other column."""
    wide = sum(isinstance(f.dataType, (T.StringType, T.BinaryType)) for f in df.schema.fields)
    return rows * (16 + 64 * wide + 16 * (len(df.columns) - wide)) <= limit


def broadcast_counted(df: DataFrame, rows: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for a side that fits; beyond it the join shuffles (and adaptive execution splits
    skewed partitions)."""
    return F.broadcast(df) if fits_broadcast(df, rows, limit) else df.hint("merge")


def text_key(text: str = "text") -> list:
    """Two independent 64-bit hashes that stand for a text in joins (null counts as empty)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("_t1"), F.xxhash64(F.lit(1), t).alias("_t2")]


def _same(docs: DataFrame, side: DataFrame, columns: list[str]) -> tuple[DataFrame, Column]:
    """``side(columns, _t1, _t2)`` under names that cannot clash, and the condition that a row of
    ``docs`` has those (null-safe) columns and that text."""
    inner = side.select([F.col(c).alias(f"__side_{c}") for c in side.columns])
    one, two = (k for k in text_key())
    match = (one == F.col("__side__t1")) & (two == F.col("__side__t2"))
    for c in columns:
        match = match & F.col(c).cast(side.schema[c].dataType).eqNullSafe(F.col(f"__side_{c}"))
    return inner, match


def without(docs: DataFrame, out: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` less the rows that agree with a row of ``out`` in ``columns`` and text."""
    inner, match = _same(docs, out, columns)
    return docs.join(broadcast_counted(inner, out.count()), match, "left_anti")


def beside(docs: DataFrame, side: DataFrame, columns: list[str], entries: int) -> DataFrame:
    """All rows of ``docs`` beside the row of ``side`` (columns named ``__side_...``, null where there is
    none) that agrees in ``columns`` and text. ``entries``: the counted size of ``side``."""
    inner, match = _same(docs, side, columns)
    return docs.join(broadcast_counted(inner, entries), match, "left")


def repeated(docs: DataFrame, times: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``docs``, as often as ``times(columns, _t1, _t2, rows, n)`` says: ``n`` copies for
    the ``rows`` rows of ``docs`` that agree in ``columns`` and text; those not listed go.

    Rows that agree in ``columns`` and text may differ in other columns. They are ordered by a hash of the
    whole row; row i of r gets ``n // r`` copies, and one more where ``i < n % r``, so each row's own
    values are kept and reruns agree. Equal rows are counted, not gathered."""
    inner, match = _same(docs, times, columns)
    names = docs.columns
    joined = docs.join(broadcast_counted(inner, times.count()), match)
    copy = F.explode(F.array_repeat(F.lit(0), F.col("__side_n").cast("int"))).alias("__side_copy")
    out = joined.where("__side_rows = 1").select(*names, copy).select(*names)
    if times.where("rows > 1").limit(1).count():
        key = [f"__side_{c}" for c in (*columns, "_t1", "_t2")]
        quoted = [F.col(f"`{c}`") for c in names]
        several = joined.where("__side_rows > 1").withColumn("__side_hash", F.xxhash64(*quoted))
        kinds = several.groupBy(*quoted, *key, "__side_rows", "__side_n", "__side_hash").agg(F.count(F.lit(1)).alias("__side_c"))
        order = Window.partitionBy(*key).orderBy("__side_hash", *quoted)
        upto = F.sum("__side_c").over(order.rowsBetween(Window.unboundedPreceding, 0))
        r, n, c = F.col("__side_rows"), F.col("__side_n"), F.col("__side_c")
        more = F.least(F.col("__side_upto"), n % r) - F.least(F.col("__side_upto") - c, n % r)
        kinds = kinds.withColumn("__side_upto", upto).withColumn("__side_n", c * F.floor(n / r) + more)
        out = out.unionByName(kinds.select(*names, copy).select(*names))
    return out


def tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
