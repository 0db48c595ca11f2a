"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units turn into typed placeholders, other tokens are
lower-cased. Template windows of the benchmark are hash-joined with those of the documents, so a
question whose numbers or names were exchanged still meets its original. The slots of the matched
windows must then agree: along one alignment each value of the benchmark text stands for one
value in the document. A document holds an item when enough of the item's windows match that way.

Windows of fewer than half literal tokens say too little as templates; they count when the lower-cased
tokens themselves agree. Names are told by capitals, so a copy in capitals or title case has other
templates than its item: an item whose windows all agree token by token is held as well.

The benchmark's window hashes are the stated query set: they go to the tasks in blocks of at most
``BLOCK_HASHES`` (8 bytes each); a larger benchmark takes more passes over the documents.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import RangeHash, chunks, frozen, text_key, utf8, without, word_hashes, word_spans

WINDOW, LEAST_WORDS, MIN_SHARE, BLOCK_HASHES = 8, 4, 0.5, 1_000_000

# Units of measure that may follow a number.
UNITS = ("kg", "g", "mg", "lb", "lbs", "oz", "ton", "tons", "km", "m", "cm", "mm", "mile", "miles", "ft", "feet",
         "foot", "inch", "inches", "yard", "yards", "l", "ml", "liter", "liters", "litre", "litres", "gallon",
         "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day",
         "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar", "dollars", "usd", "cent",
         "cents", "euro", "euros", "eur", "pound", "pounds", "mph", "kmh", "degree", "degrees", "w", "kw", "v", "hz")

LITERAL, NUMBER, NAME, UNIT = range(4)
_MARK = np.array([0, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)
_PLAIN = np.uint64(0x589965CC75374CC3)          # tells hashes of plain tokens from those of templates

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?:\n"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _unit_hashes() -> np.ndarray:
    raw = "".join(UNITS).encode()
    ends = np.cumsum([len(u) for u in UNITS])
    starts = ends - [len(u) for u in UNITS]
    return np.sort(word_hashes(np.frombuffer(raw, np.uint8), starts, ends))


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte À-Þ lower-cased."""
    out = _LOWER[data]
    if len(data) > 1:
        accent = np.flatnonzero(data[:-1] == 0xC3) + 1
        up = accent[(data[accent] >= 0x80) & (data[accent] <= 0x9E) & (data[accent] != 0x97)]
        out[up] += 0x20
    return out


def template(data: np.ndarray, offs: np.ndarray):
    """``(hashes, kinds, starts, ends, first, lower, plain)`` of the template tokens of a text buffer;
    ``plain``: the hashes of the lower-cased tokens themselves.

    A token is a run of letters, digits and bytes above 127; a point or comma between two digits
    belongs to the number. A token with a digit first is a number; a listed unit after a number is a
    unit; a capitalised token that does not begin a text, line or sentence is a name."""
    mask = _LETTER[data]
    if len(data) > 2:
        digit = _DIGIT[data]
        mask[1:-1] |= ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
    starts, ends, first = word_spans(data, offs, mask)
    lower = lower_bytes(data)
    hashes = plain = word_hashes(lower, starts, ends)
    kinds = np.zeros(len(starts), np.int8)
    if len(starts):
        head = data[starts]
        number = _DIGIT[head]
        second = data[np.minimum(starts + 1, len(data) - 1)]
        capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
        opens = np.ones(len(starts), bool)
        opens[1:] = breaks[starts[1:]] > breaks[ends[:-1]]
        opens[first[:-1][first[:-1] < len(starts)]] = True
        kinds[capital & ~opens] = NAME
        units = _unit_hashes()
        found = np.searchsorted(units, hashes)
        unit = units[np.minimum(found, len(units) - 1)] == hashes
        after = np.zeros(len(starts), bool)
        after[1:] = number[:-1]
        after[first[:-1][first[:-1] < len(starts)]] = False
        kinds[unit & after] = UNIT
        kinds[number] = NUMBER
        hashes = np.where(kinds > 0, _MARK[kinds], hashes)
    return hashes, kinds, starts, ends, first, lower, plain


def _windows(hashes, kinds, first, plain, width: int):
    """The windows of ``width`` tokens in one text: start tokens, template hashes, whether half of the
    tokens are literal, plain hashes, and, for windows that begin with a name, the template hashes with
    that first token taken literally and whether half of the tokens are literal then."""
    n = len(hashes)
    if n < width:
        z, no = np.zeros(0, np.uint64), np.zeros(0, bool)
        return np.zeros(0, np.int64), z, no, z, z, no
    s = np.arange(n - width + 1)
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    s = s[text_of[s] == text_of[s + width - 1]]
    literal = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
    literal = literal[s + width] - literal[s]
    least, ranges = -(-width // 2), RangeHash(hashes)
    named = kinds[s] == NAME
    return (s, ranges(s, s + width), literal >= least, RangeHash(plain ^ _PLAIN)(s, s + width),
            ranges(s, s + width, plain[s] - hashes[s]), named & (literal + 1 >= least))


def _slots(raw: bytes, kinds, starts, ends, at: np.ndarray, width: int) -> list[list[str]]:
    out = []
    for s in at:
        held = [k for k in range(s, s + width) if kinds[k]]
        out.append([f"{kinds[k]}{raw[starts[k]:ends[k]].decode('utf-8', 'replace')}" for k in held])
    return out


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, width, wpos, plain, heavy, n_literal, n_all, h, slots)``: the windows of every item, by
    template where half of the tokens are literal (``n_literal`` windows) and all of them (``n_all``) by
    plain tokens; ``heavy``: too few literal tokens for a template. An item of fewer than ``window``
    tokens is one window; below ``LEAST_WORDS`` tokens it counts by plain tokens only."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                for i in range(part.num_rows):
                    data, offs = utf8(part.column(1).slice(i, 1))
                    hashes, kinds, starts, ends, first, lower, plain = template(data, offs)
                    width = min(window, len(hashes))
                    if not width:
                        continue
                    s, h, literal, exact, _, _ = _windows(hashes, kinds, first, plain, width)
                    literal &= width >= LEAST_WORDS
                    own = s[literal]
                    slots = _slots(lower.tobytes(), kinds, starts, ends, own, width) + [[]] * len(s)
                    at, n = np.concatenate([own, s]), len(own) + len(s)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(np.full(n, i))), pa.array(np.full(n, width, np.int32)),
                         pa.array(at.astype(np.int32)), pa.array(np.arange(n) >= len(own)),
                         pa.array(np.concatenate([np.zeros(len(own), bool), ~literal & (width >= LEAST_WORDS)])),
                         pa.array(np.full(n, len(own), np.int32)), pa.array(np.full(n, len(s), np.int32)),
                         pa.array(np.concatenate([h[literal], exact]).view(np.int64)),
                         pa.array(slots, pa.list_(pa.string()))],
                        ["item_id", "width", "wpos", "plain", "heavy", "n_literal", "n_all", "h", "islots"])

    return items.select(F.col("item_id").cast("bigint"), "text").mapInArrow(
        run, "item_id bigint, width int, wpos int, plain boolean, heavy boolean, n_literal int, n_all int, h bigint, "
             "islots array<string>")


def _matches(docs: DataFrame, widths: list[int], block) -> DataFrame:
    """``(doc_id, _t1, _t2, width, pos, h, slots)``: document windows whose hash is in the broadcast block,
    as templates (a name that begins the window also taken literally, as it would be at the beginning of
    an item) and as plain tokens (without slots). Windows of fewer than ``LEAST_WORDS`` tokens are whole
    texts, by plain tokens."""

    def run(batches):
        wanted = block.value
        bits = 22
        seen = np.zeros(1 << bits, bool)
        seen[(wanted >> np.uint64(64 - bits)).astype(np.int64)] = True

        def hits(h, among):
            maybe = np.flatnonzero(among & seen[(h >> np.uint64(64 - bits)).astype(np.int64)])
            found = np.searchsorted(wanted, h[maybe])
            return maybe[wanted[np.minimum(found, len(wanted) - 1)] == h[maybe]]

        for batch in batches:
            for part in chunks(batch):
                data, offs = utf8(part.column(3))
                hashes, kinds, starts, ends, first, lower, plain = template(data, offs)
                raw = lower.tobytes()
                for width in widths:
                    if width < LEAST_WORDS:
                        s = first[:-1][np.diff(first) == width]
                        readings = ((2, RangeHash(plain ^ _PLAIN)(s, s + width), True),) if len(s) else ()
                    else:
                        s, h, literal, exact, led, lead = _windows(hashes, kinds, first, plain, width)
                        readings = ((0, h, literal), (1, led, lead), (2, exact, True))
                    for how, one, among in readings:
                        hit = hits(one, among)
                        if not len(hit):
                            continue
                        at = s[hit]
                        doc = np.searchsorted(first, at, side="right") - 1
                        slots = [[]] * len(at) if how == 2 else _slots(raw, kinds, starts, ends, at, width)
                        if how == 1:
                            slots = [x[1:] for x in slots]
                        yield pa.RecordBatch.from_arrays(
                            [*(part.column(k).take(pa.array(doc)) for k in range(3)),
                             pa.array(np.full(len(at), width, np.int32)), pa.array((at - first[doc]).astype(np.int32)),
                             pa.array(one[hit].view(np.int64)), pa.array(slots, pa.list_(pa.string()))],
                            ["doc_id", "_t1", "_t2", "width", "pos", "h", "slots"])

    return docs.select(F.col("doc_id").cast("bigint"), *text_key(), "text").mapInArrow(
        run, "doc_id bigint, _t1 bigint, _t2 bigint, width int, pos int, h bigint, slots array<string>")


def _shares(docs: DataFrame, items: DataFrame, window: int, block_hashes: int) -> DataFrame:
    """``(doc_id, _t1, _t2, item_id, n_windows, n_matched, n_changed)`` of every text that shares windows
    with an item, a row for each reading: the literal windows by template with consistent slots; with
    the heavy ones by plain tokens beside them; all windows by plain tokens along one alignment."""
    spark = docs.sparkSession
    ours = frozen(benchmark_windows(items, window))
    widths = sorted(r[0] for r in ours.select("width").distinct().collect())      # at most ``window`` values
    distinct = ours.select("h").distinct()
    blocks = max(1, -(-distinct.count() // block_hashes))
    found = None
    for b in range(blocks):
        part = distinct.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == b).toPandas()["h"]
        wanted = np.sort(part.to_numpy(np.int64).view(np.uint64)) if len(part) else np.zeros(1, np.uint64)
        one = _matches(docs, widths, spark.sparkContext.broadcast(wanted))
        found = one if found is None else found.unionByName(one)
    both = (frozen(found).join(ours, ["width", "h"])
            .where(F.size("slots") == F.size("islots"))
            .withColumn("diag", F.col("pos") - F.col("wpos")))
    pair = both.where("not plain")
    text = ["doc_id", "_t1", "_t2", "item_id"]
    line = [*text, "diag"]
    slot = pair.select(*line, F.explode(F.arrays_zip("islots", "slots")).alias("z")).select(
        *line, F.col("z.islots").alias("mine"), F.col("z.slots").alias("theirs")).distinct()
    torn = (slot.groupBy(*line, "mine").agg(F.count(F.lit(1)).alias("k")).groupBy(*line)
            .agg(F.max("k").alias("k")))
    changed = slot.where("mine <> theirs").groupBy(*line).agg(F.count(F.lit(1)).alias("n_changed"))
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in line])

    def beside(df):
        return df.select(*[F.col(c).alias(f"_{c}") for c in line], *[c for c in df.columns if c not in line])

    sizes = ["n_literal", "n_all"]
    none = F.array().cast("array<int>")
    sound = pair.join(beside(torn.where("k > 1")), match, "left_anti")
    lines = sound.groupBy(*line, *sizes).agg(F.collect_set("wpos").alias("at"))
    lines = lines.join(beside(changed), match, "left").select(
        *text, *sizes, "at", none.alias("heavy_at"), F.lit(0).alias("n_plain"),
        F.coalesce("n_changed", F.lit(0)).alias("n_changed"))
    exact = both.where("plain").groupBy(*line, *sizes).agg(
        F.collect_set(F.when(F.col("heavy"), F.col("wpos"))).alias("heavy_at"),
        F.count_distinct("wpos").cast("int").alias("n_plain"))
    exact = exact.select(*text, *sizes, none.alias("at"), "heavy_at", "n_plain", F.lit(0).alias("n_changed"))
    held = lines.unionByName(exact).groupBy(*text, *sizes).agg(
        *[F.size(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("at", "heavy_at")],
        F.max("n_plain").alias("n_plain"), F.sum("n_changed").alias("n_changed"))

    def reading(given, n_windows, n_matched, n_changed):
        return F.when(given, F.struct(n_windows.cast("int").alias("n_windows"),
                                      n_matched.cast("bigint").alias("n_matched"),
                                      n_changed.cast("bigint").alias("n_changed")))

    n, every = F.col("n_literal"), F.col("n_all")
    readings = F.array(reading(F.col("at") > 0, n, F.col("at"), F.col("n_changed")),
                       reading(F.col("heavy_at") > 0, every, F.col("at") + F.col("heavy_at"), F.col("n_changed")),
                       reading(F.col("n_plain") == every, every, every, F.lit(0)))
    held = held.select(*text, F.explode(F.array_compact(readings)).alias("r"))
    return held.select(*text, "r.n_windows", "r.n_matched", "r.n_changed")


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE,
                 block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """Pairs ``(doc_id, item_id, n_matched, n_windows, share, n_changed)`` of ``docs(doc_id, text)``
    and the benchmark items ``items(item_id, text)`` they hold.

    ``n_matched``: item windows found with consistent slots, ``n_changed``: slots of them whose value
    differs from the item's (0: a plain copy). ``n_windows`` counts the item's windows of which half of the
    tokens are literal, or all where that gives the greater share: the others count when found token by
    token, and an item found whole that way, in any case of its letters, has share 1. (A copy in
    capitals or title case that is changed or not whole is not found.) Pairs with ``share`` >=
    ``min_share`` are returned.
    An item of fewer than ``LEAST_WORDS`` tokens is held only by a text that has its tokens and no others.
    Null and empty texts match nothing; rows repeated under one doc_id (null included) give one row per item with the best share; equal items
    under several ids are all returned. Empty tables give an empty result; other columns are not
    read.
    """
    texts = _shares(docs, items, window, block_hashes)
    best = texts.groupBy("doc_id", "item_id").agg(
        F.max(F.struct((F.col("n_matched") / F.col("n_windows")).alias("share"), "n_matched",
                       F.col("n_windows").cast("bigint").alias("n_windows"), (-F.col("n_changed")).alias("unchanged"))
              ).alias("b"))
    return (best.select("doc_id", "item_id", "b.n_matched", "b.n_windows", "b.share",
                        (-F.col("b.unchanged")).alias("n_changed")).where(F.col("share") >= F.lit(min_share)))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE,
                   block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all their columns."""
    held = _shares(docs, items, window, block_hashes).where(F.col("n_matched") >= min_share * F.col("n_windows"))
    return without(docs, frozen(held.select("_t1", "_t2").distinct()), [])
