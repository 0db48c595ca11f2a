"""Substring dedup: winnowed anchors, extension both ways, maximal repeats over a length.

Every window of ``length`` words holds ``length - gram + 1`` grams; the one with the smallest hash
is the window's anchor (the leftmost where several are equal), so equal windows have equal anchors
and only repeated anchors need work. An anchor's context is what lies up to a window's length to
both sides of it within its document. Two occurrences of an anchor with equal context repeat each
other in every window around it: that settles copies without looking at windows. Where one anchor
has several contexts, one occurrence of each context is extended word by word: the windows that it
anchors are hashed and matched. Windows are grouped by hash, never paired: a passage that stands in
a third of all documents costs a row for each occurrence.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import RangeHash, broadcast_counted, chunks, frozen, sliding, utf8, word_hashes, word_spans

LENGTH, GRAM = 35, 12
_KEY = "_k1 bigint, _k2 bigint"


def _anchors(words: np.ndarray, first: np.ndarray, length: int, gram: int):
    """Grams of the flat word-hash array, valid windows and their anchors.

    Returns ``(hashes, windows, low, chosen)``: hash of the gram at each position, start positions
    of windows that lie in one text, each such window's anchor hash, and the flat positions of all
    anchors."""
    n = len(words)
    if n < length:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, np.zeros(0, np.uint64), z
    at = np.arange(n - gram + 1)
    ranges = RangeHash(words)
    hashes = ranges(at, at + gram)
    wide = length - gram + 1
    low = sliding(hashes, wide, np.minimum)                     # per window start
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = text_of[:n - length + 1] == text_of[length - 1:]
    bound = np.zeros(n - gram + 1 + wide - 1, np.uint64)        # a gram is chosen if some valid window
    bound[wide - 1:wide - 1 + len(low)] = np.where(valid, low, np.uint64(0))    # over it has it as its low
    best = sliding(bound, wide, np.maximum)
    chosen = np.flatnonzero((best == hashes) & (best > 0))
    return hashes, np.flatnonzero(valid), low, chosen


def anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(key, at, a, c)``: every anchor of every text, with the hash of its context. ``at`` holds the
    word position in its high and the words of the text in its low 32 bits."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                data, offs = utf8(part.column(2))
                starts, ends, first = word_spans(data, offs)
                words = word_hashes(data, starts, ends)
                hashes, _, _, chosen = _anchors(words, first, length, gram)
                doc = np.searchsorted(first, chosen, side="right") - 1
                lo, hi = first[doc], first[doc + 1]
                a = np.maximum(lo, chosen - (length - gram))
                b = np.minimum(hi, chosen + length)
                context = RangeHash(words)(a, b) ^ (chosen - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                keys = [part.column(k).take(pa.array(doc)) for k in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array((chosen - lo) << 32 | (hi - lo)), pa.array(hashes[chosen].view(np.int64)), pa.array(context.view(np.int64))],
                    ["_k1", "_k2", "at", "a", "c"])

    return docs.mapInArrow(run, _KEY + ", at bigint, a bigint, c bigint")


def _extended(docs: DataFrame, seeds: DataFrame, length: int, gram: int) -> DataFrame:
    """``(key, s, w1, w2)``: the windows anchored at the seed positions, with 128 bits of hash.
    ``seeds``: ``key, at`` (an array of word positions)."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                data, offs = utf8(part.column(2))
                starts, ends, first = word_spans(data, offs)
                words = word_hashes(data, starts, ends)
                hashes, valid, low, _ = _anchors(words, first, length, gram)
                at = part.column(3)
                flat = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                seed = np.zeros(len(words) + 1, bool)
                seed[flat + np.repeat(first[:-1], np.diff(at.offsets.to_numpy()))] = True
                wide = length - gram + 1
                todo, anchor = valid, np.full(len(valid), -1)
                for k in range(wide):                               # leftmost gram that equals the low
                    hit = (anchor < 0) & (hashes[todo + k] == low[todo])
                    anchor[hit] = todo[hit] + k
                s = todo[seed[anchor]] if len(todo) else todo
                doc = np.searchsorted(first, s, side="right") - 1
                two = RangeHash(words ^ (words << np.uint64(21)) + np.uint64(0x2545F4914F6CDD1D))
                keys = [part.column(k).take(pa.array(doc)) for k in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array((s - first[doc]).astype(np.int32)),
                     pa.array(RangeHash(words)(s, s + length).view(np.int64)),
                     pa.array(two(s, s + length).view(np.int64))], ["_k1", "_k2", "s", "w1", "w2"])

    key = ["_k1", "_k2"]
    joined = docs.join(seeds, key).select(*key, "text", "at")
    return joined.mapInArrow(run, _KEY + ", s int, w1 bigint, w2 bigint")


def _key_columns() -> list:
    """128 bits of doc_id and text: rows with one doc_id and different texts stay apart."""
    both = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))), F.coalesce(F.col("text"), F.lit(""))]
    return [F.xxhash64(*both).alias("_k1"), F.xxhash64(F.lit(1), *both).alias("_k2")]


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(_k1, _k2, los, his)``: the word ranges ``[lo, hi)`` covered by repeated windows, merged and in
    order, for every document key that has any."""
    key = ["_k1", "_k2"]
    src = docs.select(*_key_columns(), "text")
    found = anchors(src, length, gram)
    # kept by itself, so that the join below shuffles both sides and a hot anchor's rows can be split
    again = frozen(found.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("a"))
    seen = frozen(found.join(again, "a"))
    context = frozen(seen.groupBy("a", "c").agg(F.count(F.lit(1)).alias("m"),
                                                F.min(F.struct(*key, "at")).alias("one")))
    several = context.groupBy("a").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("a")
    whole = (seen.join(context.where("m > 1").select("a", "c"), ["a", "c"])
             .select(*key, F.expr("cast(shiftright(at, 32) as int)").alias("pos"),
                     F.expr("cast(at & 4294967295 as int)").alias("n"))
             .select(*key, F.greatest(F.lit(0), F.col("pos") - (length - gram)).alias("lo"),
                     F.least(F.col("n"), F.col("pos") + length).alias("hi")))
    seeds = frozen(context.join(several, "a").groupBy(*[F.col(f"one.{k}").alias(k) for k in key])
                   .agg(F.collect_set(F.expr("cast(shiftright(one.at, 32) as int)")).alias("at")))
    # rows repeated with one key give the same windows: count each (key, start) once
    windows = frozen(_extended(src, broadcast_counted(seeds, _weight(seeds)), length, gram).distinct())
    twice = (windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
             .select("w1", "w2"))
    parts = (windows.join(twice, ["w1", "w2"])
             .select(*key, F.col("s").alias("lo"), (F.col("s") + length).alias("hi")))
    spans = whole.unionByName(parts).groupBy(*key).agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"))
    return spans.mapInArrow(_merged, _KEY + ", los array<int>, his array<int>")


def _merged(batches):
    """Overlapping and touching ranges of each document become one."""
    for batch in batches:
        cols = [batch.column(k) for k in (2, 3)]
        offsets = [c.offsets.to_numpy() for c in cols]
        lo, hi = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in cols)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets[0]))
        order = np.lexsort((lo, doc))
        lo, hi, doc = lo[order], hi[order], doc[order]
        far = np.maximum.accumulate(hi + (doc << 33))              # never mixes documents
        new = np.ones(len(lo), bool)
        new[1:] = (lo + (doc << 33))[1:] > far[:-1]
        at = np.flatnonzero(new)
        ends = np.append(at[1:], len(lo)) - 1
        first = np.searchsorted(doc[at], np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(v.astype(np.int32)))
                 for v in (lo[at], (far[ends] - (doc[ends] << 33)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["_k1", "_k2", "los", "his"])


def _weight(seeds: DataFrame) -> int:
    """Rows plus listed positions over 8: what decides on a broadcast of ``seeds``."""
    column = "at" if "at" in seeds.columns else "los"
    row = seeds.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(column)), F.lit(0))).first()
    return row[0] + row[1] // 8


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Remove every word of ``docs(doc_id, text)`` that is covered by a window of ``length`` words
    whose word sequence also starts anywhere else, in the same document or another.

    Returns one row per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by
    one space) and, with ``with_text``, kept_text. All windows are judged on the input: of two
    copies both go. Texts of fewer than ``length`` words lose nothing; null and empty texts have
    no words. Rows repeated with equal doc_id and text are copies of each other. An empty table
    gives an empty result; other columns are not read. Words are compared by 64-bit word hashes
    within 128-bit window hashes.
    """
    key = ["_k1", "_k2"]
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *_key_columns())
    spans = frozen(repeats(docs, length, gram))
    joined = src.join(broadcast_counted(spans, _weight(spans)), key, "left").select("doc_id", "text", "los", "his")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" * with_text)

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                data, offs = utf8(part.column(1))
                raw = data.tobytes()
                rows = []
                for a, b, los, his in zip(offs[:-1], offs[1:], part.column(2).to_pylist(), part.column(3).to_pylist()):
                    words = raw[a:b].split()
                    gone = 0
                    kept = words
                    if los:
                        keep = np.ones(len(words), bool)
                        for lo, hi in zip(los, his):
                            keep[lo:hi] = False
                        kept = [w for w, k in zip(words, keep) if k]
                        gone = len(words) - len(kept)
                    text = b" ".join(kept)
                    rows.append((len(words), gone, hashlib.sha256(text).hexdigest(), text))
                cols = [part.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)),
                        pa.array([r[2] for r in rows], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    cols.append(pa.array([r[3] for r in rows], pa.binary()).cast(pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(run, schema)
