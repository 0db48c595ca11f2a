"""Quality rules: per-document counts and cross-document line frequency.

Lines are normalised (A-Z lower-cased, words joined by one space) and hashed. For each host (the
``source`` column) and line the distinct documents that carry it are counted; lines above the
limit are boilerplate and their words are taken away; a document of which too little is left is
depleted and rejected.

Copies of one document would make all of its lines frequent and the whole group would go, so
documents are told apart by their text: equal texts of a host count once. Near copies are different
documents. Boilerplate lines that stand together are each counted by themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import WHITE, beside, chunks, frozen, text_key, utf8, without

MIN_WORDS, MAX_DOCS, MIN_LEFT = 50, 20, 0.2
_SYMBOLS = b"#*$%&|<>"

_METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = ("doc_id bigint, source string, _t1 bigint, _t2 bigint, " + ", ".join(f"{m} bigint" for m in _METRICS)
           + ", lines array<struct<h:bigint,words:bigint>>")


def line_hash(line: bytes) -> int:
    """60 bits of the MD5 of a normalised line."""
    return int.from_bytes(hashlib.md5(line).digest()[:8], "big") >> 4


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice (first occurrences included)."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    grams = np.fromiter((ids.setdefault(g, len(ids)) for g in zip(words, words[1:], words[2:])), np.int64, n - 2)
    if len(ids) == n - 2:
        return 0
    often = np.bincount(grams) > 1
    at = np.flatnonzero(often[grams])
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def measure(raw: bytes) -> tuple:
    """The counts of one UTF-8 text and its lines, as (hash, words) with repeats merged."""
    words = raw.split()
    size = sum(map(len, words))
    tails = 0 if raw.isascii() else len(raw) - len(raw.decode("utf-8", "replace"))
    symbols = sum(raw.count(bytes([c])) for c in _SYMBOLS)
    seen: set = set()
    duplicates = 0
    lines: dict = {}
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            continue
        if line in seen:
            duplicates += 1
        else:
            seen.add(line)
        h = line_hash(b" ".join(own).lower())
        lines[h] = lines.get(h, 0) + len(own)
    return len(words), size - tails, symbols, duplicates, repeated_words(words), lines


def measured(docs: DataFrame) -> DataFrame:
    """One narrow row per document: counts and its distinct normalised lines."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                data, offs = utf8(part.column(1))
                raw = data.tobytes()
                rows = [measure(raw[a:b]) for a, b in zip(offs[:-1], offs[1:])]
                hs, ws, ends = [], [], [0]
                for row in rows:
                    hs.extend(row[5])
                    ws.extend(row[5].values())
                    ends.append(len(hs))
                items = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (hs, ws)], ["h", "words"])
                cols = [part.column(0), *part.columns[2:5]]
                cols += [pa.array([row[k] for row in rows], pa.int64()) for k in range(5)]
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "source", "_t1", "_t2", *_METRICS, "lines"])

    return docs.select(F.col("doc_id").cast("bigint"), "text", F.col("source").cast("string"),
                       *text_key()).mapInArrow(run, _SCHEMA)


def frequent_lines(lines: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``(source, h, n_distinct)`` of the lines that more than ``max_docs`` distinct documents of their
    host carry. ``lines``: one row per (document, distinct line) with ``source, h, _t1, _t2``, the
    last two a hash of the document's text. Copies are merged and counts summed before each shuffle;
    the first one deals a line by text, so that a line of a third of all documents has no task of its
    own."""
    once = lines.select("source", "h", "_t1", "_t2").distinct()
    counted = once.groupBy("source", "h").agg(F.count(F.lit(1)).alias("n_distinct"))
    return counted.where(F.col("n_distinct") > F.lit(max_docs))


def _hits(rows: DataFrame, max_docs: int, *keys: str) -> DataFrame:
    """``(keys, source, h, words)``: the occurrences of frequent lines in the rows of :func:`measured`."""
    lines = rows.select("*", F.explode("lines").alias("l"))
    names = list(dict.fromkeys([*keys, "source", "_t1", "_t2"]))
    frequent = frequent_lines(lines.select("source", "l.h", "_t1", "_t2"), max_docs)
    frequent = frequent.select(F.col("source").alias("_s"), F.col("h").alias("_h"))
    lines = lines.select(*names, "l.*")
    found = lines.join(frequent, F.col("source").eqNullSafe(F.col("_s")) & (F.col("h") == F.col("_h")))
    return found.select(*dict.fromkeys([*keys, "source"]), "h", "words")


def _verdicts(docs: DataFrame, min_words: int, max_docs: int, min_left: float) -> DataFrame:
    rows = frozen(measured(docs).withColumn("_row", F.monotonically_increasing_id()))
    hit = _hits(rows, max_docs, "_row")
    lost = hit.groupBy("_row").agg(F.sum("words").alias("lost"), F.count(F.lit(1)).alias("n_frequent_lines"))
    out = rows.drop("lines").join(lost, "_row", "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    return out.select("doc_id", "source", "_t1", "_t2", *_METRICS, failed.alias("base_failed"),
                      (~failed & (left.cast("double") >= F.lit(min_left) * F.col("n_words"))).alias("kept"),
                      F.coalesce("n_frequent_lines", F.lit(0)).cast("bigint").alias("n_frequent_lines"),
                      left.cast("bigint").alias("words_left"))


def judge(docs: DataFrame, min_words: int = MIN_WORDS, max_docs: int = MAX_DOCS,
          min_left: float = MIN_LEFT) -> DataFrame:
    """Quality verdict of every row of ``docs(doc_id, text, source)``.

    Returns doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_frequent_lines, words_left. A null or empty text has no words and fails the base
    rules; a null source is a host of its own; repeated rows are judged each; an empty table gives
    an empty result; other columns are not read. ``kept`` is false for base failures and for
    documents of which less than ``min_left`` of the words stand outside frequent lines.
    """
    return _verdicts(docs, min_words, max_docs, min_left).drop("_t1", "_t2")


def accepted(docs: DataFrame, min_words: int = MIN_WORDS, max_docs: int = MAX_DOCS,
             min_left: float = MIN_LEFT) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns. The verdict depends on
    text and source alone, so rejected (text, source) pairs are taken out, whatever the ids."""
    out = _verdicts(docs, min_words, max_docs, min_left).where("not kept")
    out = frozen(out.select("source", "_t1", "_t2").distinct())
    return without(docs, out, ["source"])


def cleaned(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """All rows of ``docs`` with all their columns, the texts without their frequent lines: a cleaned text
    has the ``words_left`` of :func:`judge`. Lines without a word and texts without a frequent line stay
    as they are."""
    hit = _hits(frozen(measured(docs)), max_docs, "_t1", "_t2")
    lost = frozen(hit.groupBy("source", "_t1", "_t2").agg(F.collect_set("h").alias("drop")))
    entries = lost.agg(F.sum(F.size("drop"))).first()[0] or 0
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def stays(line):
        words = F.translate(F.trim(F.regexp_replace(line, WHITE, " ")), upper, lower)
        h = F.conv(F.substring(F.md5(words), 1, 15), 16, 10).cast("bigint")
        return ~F.array_contains("__side_drop", h)

    text = F.array_join(F.filter(F.split("text", "\n", -1), stays), "\n")
    return beside(docs, lost, ["source"], entries).select(
        *[F.when(F.col("__side_drop").isNull(), F.col("text")).otherwise(text).alias(c) if c == "text" else F.col(c)
          for c in docs.columns])
