"""SimHash near-dedup: fingerprints of word shingles, linked within a bit distance.

Fingerprints that differ in at most two bits agree in two of four 16-bit blocks, so each distinct
fingerprint is dealt to the six block pairs it could share (32 bits of key). Inside a bucket the
fingerprints are compared bit-sliced: bit plane p holds bit p of 64 fingerprints in one word, a
carry-save counter adds the planes of the differences for 64 fingerprints at once, and a block is
abandoned when all its counters exceed the radius. A bucket gives a spanning forest, not pairs.

A bucket of more than ``HOT_BUCKET`` fingerprints is dealt again by two of the four 8-bit blocks
of the remaining 32 bits: 48 bits are then fixed, so no bucket can hold more than 65,536.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .textbuf import chunks, frozen, repeated, tasks, text_key, utf8

SHINGLE, RADIUS, HOT_BUCKET = 3, 2, 4096
_ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one text: bit set where over half of the shingle hashes have it set."""
    words = text.translate(_ASCII_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle))))]
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[at:at + (1 << 15)], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, _t1, _t2, fp)`` with the fingerprint as a signed 64-bit integer; one row per row."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                data, offs = utf8(part.column(1))
                raw = data.tobytes()
                fps = [fingerprint(raw[a:b], shingle) for a, b in zip(offs[:-1], offs[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *part.columns[2:4], pa.array(np.array(fps, dtype=np.uint64).view(np.int64))],
                    ["doc_id", "_t1", "_t2", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text", *text_key()).mapInArrow(
        run, "doc_id bigint, _t1 bigint, _t2 bigint, fp bigint")


# ---------------------------------------------------------------- bit-sliced comparison

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
BLOCK = 64
TILES = 1 << 14


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """``planes[p, w]``: bit p of fingerprints 64 w .. 64 w + 63, one per bit of the word."""
    padded = np.zeros(-(-len(fps) // BLOCK) * BLOCK, np.uint64)
    padded[:len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within_radius(queries: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """One word per tile, with a bit for each fingerprint of the tile's block that is within
    ``radius`` bits of the tile's query. ``queries``: a fingerprint per tile; ``planes[p]``: plane
    p of each tile's block.

    The distances of a block are vertical counters: the difference plane is added to all 64 of
    them by a carry-save step. ``over`` marks those past the radius, which stay so; tiles in which
    all are over are abandoned every eight planes."""
    n = len(queries)
    live = np.arange(n)
    count = np.zeros((max(radius.bit_length(), 1), n), np.uint64)
    over = np.zeros(n, np.uint64)
    out = np.zeros(n, np.uint64)
    for p in range(64):
        flip = np.uint64(0) - (queries[live] >> np.uint64(p) & np.uint64(1))
        carry = planes[p, live] ^ flip
        for k in range(len(count)):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        more, same = np.zeros(len(live), np.uint64), np.full(len(live), _FULL)
        for k in reversed(range(len(count))):        # counter > radius, high bit first
            if radius >> k & 1:
                same &= count[k]
            else:
                more |= same & count[k]
                same &= ~count[k]
        over |= more
        if p % 8 == 7:
            keep = over != _FULL
            if not keep.all():
                live, count, over = live[keep], count[:, keep], over[keep]
                if not len(live):
                    return out
    out[live] = ~over
    return out


def _hits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little").astype(bool)


def forest(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (two index arrays) that span the graph 'within ``radius`` bits' of one large bucket.
    Every fingerprint is a query once, against all blocks of those not reached before."""
    links, left = [], np.arange(len(fps))
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            planes = bit_planes(fps[left])
            blocks = planes.shape[1]
            now, frontier = np.split(frontier, [max(1, TILES // blocks)])
            words = within_radius(np.repeat(fps[now], blocks), np.tile(planes, len(now)), radius)
            hit = _hits(words.reshape(len(now), blocks))[:, :len(left)]
            reached = hit.any(axis=0)
            found = left[reached]
            links.append((now[hit.argmax(axis=0)[reached]], found))
            frontier, left = np.concatenate([frontier, found]), left[~reached]
    if not links:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links])


def bucket_links(fps: np.ndarray, first: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets ``first[i]:first[i + 1]`` of ``fps``. Buckets of up to 64 fingerprints
    are one block each and compared together, a tile per fingerprint; larger ones one by one."""
    sizes = np.diff(first)
    us, vs = [], []
    for i in np.flatnonzero(sizes > BLOCK):
        a, b = forest(fps[first[i]:first[i + 1]], radius)
        us.append(first[i] + a)
        vs.append(first[i] + b)
    small = np.flatnonzero((sizes > 1) & (sizes <= BLOCK))
    for at in range(0, len(small), 256):
        some = small[at:at + 256]
        n = sizes[some]
        bucket = np.repeat(np.arange(len(some)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        index = first[some][bucket] + place
        grid = np.zeros((len(some), BLOCK), np.uint64)
        grid[bucket, place] = fps[index]
        planes = bit_planes(grid.reshape(-1))
        hit = _hits(within_radius(fps[index], planes[:, bucket], radius)[:, None])
        hit &= np.arange(BLOCK)[None, :] < place[:, None]        # each pair once; drops the padding too
        i, j = np.nonzero(hit)
        us.append(index[i])
        vs.append(first[some][bucket[i]] + j)
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(us), np.concatenate(vs)


def _links_of_sorted(radius: int):
    """Arrow map over rows ``(fp, key columns)`` that are sorted by key: links within each key."""

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            found, held = found_in(held, False)
            yield from found
        if held is not None:
            yield from found_in(held, True)[0]

    def found_in(rows: pa.Table, last: bool):
        keys = [rows.column(k).to_numpy() for k in ("c", "k", "c2", "k2")]
        n = rows.num_rows
        new = np.ones(n, bool)
        if n:
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        first = np.flatnonzero(new)
        done = n if last else (int(first[-1]) if n else 0)       # the last bucket may go on
        first = np.append(first[first < done], done)
        fps = rows.column("fp").to_numpy()[:done].view(np.uint64)
        u, v = bucket_links(fps, first, radius)
        signed = fps.view(np.int64)
        out = pa.RecordBatch.from_arrays([pa.array(signed[u]), pa.array(signed[v])], ["u", "v"])
        return [out], rows.slice(done).combine_chunks()

    return run


def _pair_keys(word, bits: int, blocks: int = 4):
    """Array of keys: (index of the block pair, the two blocks) of a ``bits`` wide value."""
    width = bits // blocks
    mask = (1 << width) - 1
    piece = [F.shiftrightunsigned(word, width * b).bitwiseAND(F.lit(mask)) for b in range(blocks)]
    return [(a, b, F.shiftleft(piece[a], width).bitwiseOR(piece[b])) for a, b in combinations(range(blocks), 2)]


def _rest(word, a: int, b: int):
    """The two 16-bit blocks of ``word`` other than a and b, as one 32-bit value."""
    c, d = (x for x in range(4) if x not in (a, b))
    piece = [F.shiftrightunsigned(word, 16 * x).bitwiseAND(F.lit(0xFFFF)) for x in (c, d)]
    return F.shiftleft(piece[0], 16).bitwiseOR(piece[1])


def links(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT_BUCKET) -> DataFrame:
    """``(u, v)`` links that connect all fingerprints of ``distinct(fp)`` within ``radius`` (<= 2)."""
    if radius > 2:
        raise ValueError("block pairs find bit distances up to 2")
    fp = F.col("fp")
    dealt = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), key.alias("k"), _rest(fp, a, b).alias("rest"))
        for i, (a, b, key) in enumerate(_pair_keys(fp, 64))])).alias("b")).select(
            "fp", "b.c", "b.k", F.col("b.rest").alias("rest"))
    crowded = dealt.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(
        "c", "k", F.lit(True).alias("hot"))
    dealt = dealt.join(crowded, ["c", "k"], "left")
    finer = F.array(*[F.struct(F.lit(1 + i).alias("c2"), key.alias("k2"))
                      for i, (_, _, key) in enumerate(_pair_keys(F.col("rest"), 32))])
    whole = F.array(F.struct(F.lit(0).alias("c2"), F.lit(0).cast("bigint").alias("k2")))
    dealt = dealt.select("fp", "c", "k", F.explode(F.when(F.col("hot"), finer).otherwise(whole)).alias("f")).select(
        "fp", "c", "k", "f.c2", "f.k2")
    keys = ["c", "k", "c2", "k2"]
    shared = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    dealt = dealt.join(shared, keys)

    sorted_ = dealt.repartition(tasks(dealt), *keys).sortWithinPartitions(*keys).select("fp", *keys)
    return sorted_.mapInArrow(_links_of_sorted(radius), "u bigint, v bigint").distinct()


def _grouped(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """:func:`fingerprints` with the ``component_id`` of each row."""
    fp = frozen(fingerprints(docs, shingle))
    distinct = frozen(fp.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(distinct.select("fp"), radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    own = named.join(lowest, "root").select("fp", "root", "component_id")
    return fp.join(own, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """SimHash near-dedup of ``docs(doc_id, text)``.

    Returns one row per input row: ``doc_id``, ``fingerprint`` (16 lowercase hex digits) and
    ``component_id``, the smallest doc_id reachable over links of at most ``radius`` bits.
    Null and empty texts have fingerprint zero and link like any other. Repeated rows are kept;
    a null doc_id is never a component's id unless the component has no other. An empty table
    gives an empty result; other columns of ``docs`` are not read.
    """
    return _grouped(docs, shingle, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that with the smallest doc_id
    (ties: the smallest text hash; of equal rows one)."""
    groups = _grouped(docs, shingle, radius)
    by_row = groups.groupBy("root", "doc_id", "_t1", "_t2").agg(F.count(F.lit(1)).alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_t1", "_t2", "rows")).alias("f")
    best = by_row.groupBy("root").agg(first).select("f.doc_id", "f._t1", "f._t2", "f.rows", F.lit(1).alias("n"))
    return repeated(docs, frozen(best), ["doc_id"])
