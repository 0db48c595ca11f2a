"""MinHash near-dedup with odd sketches.

Every distinct shingle set gets ``BANDS x ROWS`` MinHash values. Bands of equal values deal sets into
buckets; a pair at the threshold similarity of 0.8 shares no bucket with probability (1 - 0.8^5)^45,
under 2e-8. The same values, folded into a bitmap of parities (the odd sketch), give the similarity of
a candidate pair by the population count of the bitmaps' exclusive or; pairs that are too far off, by
over six standard deviations, go. A second odd sketch, of the whole set, bounds the difference of two
sets from below without error and is sharp for small sets. What is left is confirmed on the full sets.

Groups are never expanded into pairs. First each set is held against one set only: the bucket leader
(smallest hash) with which it shares most bands. Confirmed links make components; buckets within one
component are done, of buckets with the same sets one is kept, and those of one leader, which hold much the
same sets, become one bucket where no more pairs come of it. In these, every set outside the bucket's largest
component is compared, by sketch, with all sets of other components, in cells of bounded size, and its nearest
one over all its buckets is confirmed. Only sets that had more partners than that ask
again, after the links found have merged components, for sixteen times as many, until none has untested
partners in another component. So every link between different components is found, while pairs inside a
component are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .textbuf import MULT, RangeHash, _splitmix, broadcast_counted, chunks, frozen, gathered, mix64, tasks, text_key, utf8, word_hashes, word_spans

SHINGLE, PERCENT = 2, 80
BANDS, ROWS = 45, 5
SKETCH_BITS = 512
#: Bits of the sketch of a whole set: enough that sets of 1,000 shingles do not fill it.
SET_BITS = 2048
#: Sets on either side of a cell in which sketches are compared.
CELL = 4096
#: Nearest partners of a set that are confirmed in the first full round; sixteenfold in each later one.
PARTNERS = 1

_U = np.uint64
_TIMES = _splitmix(BANDS * ROWS, 99) | _U(1)
_WORDS = SKETCH_BITS // 64
_SET_WORDS = SET_BITS // 64


def farthest(bits: int = SKETCH_BITS, samples: int = BANDS * ROWS, percent: int = PERCENT, sigmas: float = 6.5) -> int:
    """Largest number of differing sketch bits at which a pair may still have the threshold similarity:
    the mean at the threshold plus ``sigmas`` deviations (of the sample, and of the folding)."""
    miss = 1 - percent / 100
    flips = 2 * samples * miss
    mean = bits / 2 * (1 - (1 - 2 / bits) ** flips)
    slope = (1 - 2 / bits) ** flips
    spread = ((2 * (samples * miss * (1 - miss)) ** 0.5 * slope) ** 2 + bits / 4 * (1 - slope ** 2)) ** 0.5
    return int(mean + sigmas * spread)


# ---------------------------------------------------------------- sets, samples and sketches

def shingle_sets(data: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (A-Z lower-cased)."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, first = word_spans(data, offs)
    window = RangeHash(word_hashes(data, starts, ends))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a > shingle:
            at = np.arange(a, b - shingle + 1)
            yield np.unique(window(at, at + shingle))
        elif b > a:
            yield window(np.array([a]), np.array([b]))
        else:
            yield np.zeros(0, _U)


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row for each (non-empty) set."""
    flat = mix64(np.concatenate(sets))
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), len(_TIMES)), _U)
    for i, times in enumerate(_TIMES):
        out[:, i] = np.minimum.reduceat(flat * times, first)
    return out


def _odd(hashes: np.ndarray, owner: np.ndarray, n: int, bits: int) -> np.ndarray:
    place = (mix64(hashes) % _U(bits)).astype(np.int64)
    hits = np.bincount(owner * bits + place, minlength=n * bits)
    return np.packbits((hits & 1).astype(np.uint8).reshape(n, bits), axis=1, bitorder="little").view(_U)


def sketches(values: np.ndarray) -> np.ndarray:
    """Odd sketches: bit b is the parity of the number of samples that hash to b. ``(sets, words)``."""
    n, k = values.shape
    return _odd((values + np.arange(1, k + 1, dtype=_U) * MULT).reshape(-1), np.repeat(np.arange(n), k), n, SKETCH_BITS)


def set_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Odd sketches of the sets themselves. Two of them differ in at most as many bits as the sets
    differ in elements."""
    return _odd(np.concatenate(sets) ^ MULT, np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets), SET_BITS)


def band_keys(values: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands (the band's number is part of its key). ``(sets, bands)``."""
    keys = np.empty((len(values), BANDS), _U)
    for band in range(BANDS):
        key = np.full(len(values), band + 1, _U)
        for row in range(ROWS):
            key = mix64(key * MULT + values[:, band * ROWS + row])
        keys[:, band] = key
    return keys


_SIGNED = "doc_id bigint, _t1 bigint, _t2 bigint, n_shingles bigint, node bigint, sketch array<bigint>, bands array<bigint>"


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: size and hash (``node``) of its set, sketch and band keys (null
    for an empty set)."""

    def lists(matrix: np.ndarray, present: np.ndarray) -> pa.Array:
        width = matrix.shape[1]
        offsets = np.concatenate([[0], np.cumsum(present) * width]).astype(np.int32)
        mask = pa.array(np.append(~present, False))
        return pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(offsets), [mask_to_valid(mask), pa.py_buffer(offsets)]),
                                        pa.array(matrix.reshape(-1).view(np.int64)))

    def mask_to_valid(mask: pa.Array):
        return pa.array(~np.asarray(mask)).buffers()[1]

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                data, offs = utf8(part.column(1))
                sets = list(shingle_sets(data, offs, shingle))
                sizes = np.array([len(s) for s in sets], np.int64)
                present = sizes > 0
                full = [s for s in sets if len(s)]
                values = samples(full) if full else np.zeros((0, len(_TIMES)), _U)
                both = np.concatenate([sketches(values), set_sketches(full)], axis=1) if full else np.zeros((0, _WORDS + _SET_WORDS), _U)
                marks = np.array([np.sum(mix64(s + MULT), dtype=_U) for s in sets], _U)
                node = mix64(marks + sizes.astype(_U) * MULT)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *part.columns[2:4], pa.array(sizes), pa.array(node.view(np.int64), mask=~present),
                     lists(both, present), lists(band_keys(values), present)],
                    ["doc_id", "_t1", "_t2", "n_shingles", "node", "sketch", "bands"])

    return docs.select(F.col("doc_id").cast("bigint"), "text", *text_key()).mapInArrow(run, _SIGNED)


# ---------------------------------------------------------------- confirmation

def _may_link(percent: int) -> F.Column:
    """Sides ``size_a, sketch_a`` and ``size_b, sketch_b`` may have the threshold similarity: by the sizes
    and the sets' sketches for certain, by the samples' sketches as :func:`farthest` says. With sizes of
    sum s and difference d the similarity is (s - d) / (s + d)."""
    words = [F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in range(_WORDS + _SET_WORDS)]
    total = (F.col("size_a") + F.col("size_b")) * (100 - percent)
    apart = F.abs(F.col("size_a") - F.col("size_b")) * (100 + percent)
    return ((apart <= total) & (sum(words[_WORDS:], F.lit(0)) * (100 + percent) <= total)
            & (sum(words[:_WORDS], F.lit(0)) <= farthest(percent=percent)))


def _confirmed(near: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` of nodes whose full sets have the threshold similarity."""
    asked = near.select(F.col("u").alias("node")).unionByName(near.select(F.col("v").alias("node"))).distinct()
    # texts of the nodes that take part: one row of documents for each
    keys = asked.join(classes, "node").select("node", F.col("doc_id").alias("k0"), F.col("_t1").alias("k1"), F.col("_t2").alias("k2"))
    keys = gathered(keys)
    own = gathered(texts.join(broadcast_counted(keys, keys.count()), F.col("doc_id").eqNullSafe(F.col("k0")) & (F.col("_t1") == F.col("k1")) & (F.col("_t2") == F.col("k2")))
                 .select("node", "text").dropDuplicates(["node"]), 1000)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text_a"):
                for rows in chunks(part, "text_b"):
                    a, b = (shingle_sets(*utf8(rows.column(k)), shingle) for k in (2, 3))
                    keep = []
                    for x, y in zip(a, b):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        keep.append(100 * both >= percent * (len(x) + len(y) - both))
                    yield rows.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    return near.join(own.toDF("u", "text_a"), "u").join(own.toDF("v", "text_b"), "v").select(
        "u", "v", "text_a", "text_b").mapInArrow(run, "u bigint, v bigint")


# ---------------------------------------------------------------- comparison of components in buckets

def _nearest(limit: int, percent: int):
    """Arrow map over rows ``(key, qc, mc, query, member, node, root, size, sketch)`` sorted by cell: for each query
    of a cell its ``limit`` nearest members of other components among those that may link with it, how far
    they are (both sketches, as shares of what a link may differ by), and whether there are more."""
    most = farthest(percent=percent)

    def cell(rows: pa.Table) -> pa.RecordBatch:
        query, member = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("query", "member"))
        node, root, size = (rows.column(k).to_numpy() for k in ("node", "root", "size"))
        planes = rows.column("sketch").combine_chunks().flatten().to_numpy().view(_U).reshape(-1, _WORDS + _SET_WORDS)
        member = np.flatnonzero(member)
        drawn, whole = planes[:, :_WORDS], planes[:, _WORDS:]
        us, vs, fars, mores = [], [], [], []
        for q in np.flatnonzero(query):
            total = (size[member] + size[q]) * (100 - percent)
            apart = np.abs(size[member] - size[q]) * (100 + percent)
            fits = (root[member] != root[q]) & (apart <= total)
            other, total = member[fits], total[fits]
            differ = np.bitwise_count(drawn[other] ^ drawn[q]).sum(axis=1, dtype=np.int64)
            near = differ <= most
            other, total, differ = other[near], total[near], differ[near]
            least = np.bitwise_count(whole[other] ^ whole[q]).sum(axis=1, dtype=np.int64) * (100 + percent)
            near = least <= total
            other, far = other[near], differ[near] / most + least[near] / total[near]
            order = np.lexsort((node[other], far))
            best = order[:limit]
            us.append(np.full(len(best), node[q]))
            vs.append(node[other[best]])
            fars.append(far[best])
            mores.append(np.full(len(best), len(order) > limit))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.zeros(0, kind), *x])) for x, kind in
             ((us, np.int64), (vs, np.int64), (fars, np.float64), (mores, np.bool_))], ["q", "m", "far", "more"])

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            keys = [held.column(k).to_numpy() for k in ("key", "qc", "mc")]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            edges = [0, *new.tolist()]
            for a, b in zip(edges[:-1], edges[1:]):
                yield cell(held.slice(a, b - a))
            held = held.slice(edges[-1])
        if held is not None and held.num_rows:
            yield cell(held)

    return run


def _unlike(buckets: DataFrame) -> DataFrame:
    """One of the buckets ``(key, node, leader)`` that hold the same nodes, by their number and 128 bits of hash."""
    marks = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.bit_xor("node").alias("x"),
                                       F.bit_xor(F.xxhash64("node")).alias("y"))
    return buckets.join(marks.groupBy("k", "x", "y").agg(F.min("key").alias("key")).select("key"), "key")


def _stars(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The buckets ``(key, node, leader)`` that hold several components, as ``(key, node)``. Those of one leader
    become one bucket, each of its sets once, where the square of its size is at most the sum of theirs; so every
    pair that shares a bucket still does."""
    several = buckets.join(labels, "node").groupBy("key").agg(
        F.min("root").alias("one"), F.max("root").alias("two"), F.count(F.lit(1)).alias("k")).where("one <> two")
    rows = gathered(buckets.join(several.select("key", "k"), "key").select("key", "node", "leader", "k"))
    stars = rows.groupBy("leader", "node").agg(F.sum("k").alias("pairs"), F.min("key").alias("star")).groupBy("leader").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pairs").alias("pairs"), F.min("star").alias("star")).where("n * n <= pairs")
    # a leader has a bucket for each band at most, but any number of rows: these are joined by bucket
    named = rows.select("key", "leader").distinct().join(stars.select("leader", "star"), "leader", "left").select("key", "star")
    return rows.join(named, "key").select(F.coalesce("star", "key").alias("key"), "node").distinct()


def _cells(buckets: DataFrame, labels: DataFrame, sides: DataFrame, asked: DataFrame | None) -> DataFrame:
    """Rows of the cells: in each bucket that holds several components, the sets that are asked for
    (``asked(node)``; None: those outside its largest component) as queries against all of its sets
    (members), in a grid of cells of about ``CELL`` by ``CELL``. A set has one row in a cell, be it both."""
    rows = buckets.join(labels, "node").select("key", "node", "root")
    if asked is not None:
        rows = rows.join(asked.withColumn("query", F.lit(True)), "node", "left").withColumn("query", F.col("query").isNotNull())
        held = F.max("query")
    else:
        held = F.lit(True)
    several = rows.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("two"), held.alias("held")).where(
        "held and one <> two").select("key")
    rows = rows.join(several, "key")
    if asked is None:
        rows = gathered(rows)
        top = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(
            F.max(F.struct("k", "root")).alias("top")).select("key", F.col("top.root").alias("largest"))
        rows = rows.join(top, "key").withColumn("query", F.col("root") != F.col("largest")).drop("largest")
    rows = gathered(rows)
    grid = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("mcs"),
                                   F.ceil(F.count_if("query") / CELL).cast("int").alias("qcs"))
    spot = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    at = lambda qc, mc, query, member: F.struct(qc.alias("qc"), mc.alias("mc"), query.alias("query"), F.lit(member).alias("member"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    members = F.transform(each("qcs"), lambda qc: at(qc, spot(F.col("mcs")), F.col("query") & (qc == spot(F.col("qcs"))), True))
    elsewhere = F.filter(each("mcs"), lambda mc: F.col("query") & (mc != spot(F.col("mcs"))))
    queries = F.transform(elsewhere, lambda mc: at(spot(F.col("qcs")), mc, F.lit(True), False))
    places = F.inline(F.concat(members, queries))
    return rows.join(grid, "key").select("key", places, "node", "root").join(sides, "node")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the ``links(u, v)`` between nodes are added."""
    named = labels.withColumnRenamed("node", "n")
    between = (links.join(named.toDF("u", "ru"), "u").join(named.toDF("v", "rv"), "v")
               .select(F.col("ru").alias("u"), F.col("rv").alias("v")))
    roots = components(between).toDF("root", "top")
    return gathered(labels.join(roots, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, partners: int = PARTNERS) -> DataFrame:
    """MinHash near-dedup of ``docs(doc_id, text)``.

    A document's set: its distinct ``shingle``-word shingles, A-Z lower-cased (with fewer words the whole
    sequence; without words, or with a null text, empty and linked with nothing). Documents link when
    ``100 * intersection >= percent * union``. Returns one row per input row: ``doc_id``, ``n_shingles``,
    ``component_id`` (smallest doc_id reachable) and ``kept`` (doc_id = component_id). Repeated rows are
    kept; a null doc_id is never a component's id unless the component has no other, and is not kept.
    Shingles are compared by 64-bit hashes, and equal sets found by one. An empty table gives an empty
    result; other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *text_key())
    signed = frozen(signatures(docs, shingle))
    filled = signed.where("node is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_t1", "_t2")).alias("f")

    # copies share their node, so a bucket of one node is no bucket; keys of the others only go on
    dealt = filled.select("node", F.explode("bands").alias("key"))
    shared = dealt.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("other")).where("leader <> other")
    buckets = gathered(dealt.join(shared.select("key", "leader"), "key").distinct())
    labels = gathered(buckets.select("node").distinct().withColumn("root", F.col("node")))
    candidates = filled.join(labels.select("node"), "node", "left_semi")
    classes = gathered(candidates.groupBy("node").agg(first).select("node", "f.doc_id", "f._t1", "f._t2"))
    sides = gathered(candidates.select("node", F.col("n_shingles").alias("size"), "sketch").dropDuplicates(["node"]))

    votes = buckets.where("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("node").agg(F.max(F.struct("n", "leader")).alias("b")).select(F.col("node"), F.col("b.leader").alias("leader"))
    pairs = gathered(best.select(F.least("node", "leader").alias("u"), F.greatest("node", "leader").alias("v")).distinct())
    near = gathered(pairs.join(sides.toDF("u", "size_a", "sketch_a"), "u").join(sides.toDF("v", "size_b", "sketch_b"), "v")
                  .where(_may_link(percent)).select("u", "v"))
    labels = _merged(labels, _confirmed(near, classes, texts, shingle, percent))
    buckets = gathered(_stars(_unlike(buckets), labels))
    tested, asked, limit = near, None, partners
    # a pair of different components that is untested always has a node in ``asked``
    while True:
        cells = _cells(buckets, labels, sides, asked)
        order = ["key", "qc", "mc"]
        found = cells.repartition(tasks(cells), *order).sortWithinPartitions(*order).select(
            *order, "query", "member", "node", "root", "size", "sketch").mapInArrow(
            _nearest(limit, percent), "q bigint, m bigint, far double, more boolean")
        place = F.row_number().over(Window.partitionBy("q").orderBy("far", "m")).alias("place")
        found = gathered(found.groupBy("q", "m").agg(F.min("far").alias("far"), F.max("more").alias("more")).select("q", "m", "more", place))
        new = gathered(found.where(F.col("place") <= limit).select(F.least("q", "m").alias("u"), F.greatest("q", "m").alias("v"))
                     .distinct().join(tested, ["u", "v"], "left_anti"))
        if new.limit(1).count():
            labels = _merged(labels, _confirmed(new, classes, texts, shingle, percent))
            tested = gathered(tested.unionByName(new))
        asked = gathered(found.where(F.col("more") | (F.col("place") > limit)).select(F.col("q").alias("node")).distinct())
        if not asked.limit(1).count():
            break
        limit *= 16

    named = signed.select("doc_id", "n_shingles", "node").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("low"))
    own = named.where("root is not null").join(lowest, "root").select("doc_id", "n_shingles", F.col("low").alias("component_id"))
    bare = named.where("root is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return own.unionByName(bare).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
