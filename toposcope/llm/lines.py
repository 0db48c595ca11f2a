"""Line dedup: lines within a small edit distance of each other, by a segment-partition edit join.

With at most k edits between two lines, a partition of the shorter one into k + 1 segments has one
that the longer line holds unchanged, near the same place. Each distinct line is indexed by its
segments (key: its length, the segment's number and hash) and probes, for every length that a
partner may have, the substrings at the few starts where that segment can lie. Candidates from the
join on keys are verified with a banded bit-parallel edit distance. Everything is DataFrame
functions.

Lines of one template (log lines, prices, ids) share whole segments without being near. Keys that many
lines share are dealt again: their lines are cut into k + 1 segments of equal *variety*, chosen per key
from a few of its lines, and probe with these. Any cuts find every pair, so the choice
decides the work alone.

The allowance grows with the length: a line allows as many edits as there are ``LENGTHS`` up to its own,
and two lines are linked when their distance is at most what the shorter one allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .textbuf import broadcast_counted, frozen

#: Lengths from which a line allows one edit more; beyond the last one the allowance stays at their number.
LENGTHS = (16, 32, 256, 1024, 4096, 16384, 65536, 262144)
# Frequent letters whose counts filter candidates inside the join, eight to a bigint: one edit changes
# the counts of at most two letters by one.
LETTERS = ("etaonirs", "hdlucmpg", "bfvwyzk ")
# Keys whose index rows times all rows exceed CROWD are dealt again, by cuts chosen from SAMPLES lines.
CROWD, SAMPLES = 4096, 8


def all_lines(docs: DataFrame) -> DataFrame:
    """``(line, h)``: every line of every text that holds a word, with its hash."""
    lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("h", F.xxhash64("line"))


def edits(length: str, lengths: tuple = LENGTHS) -> str:
    """SQL of the edits allowed between a line of this length and any longer one."""
    return "(" + " + ".join(f"if({length} >= {x}, 1, 0)" for x in lengths) + ")"


def _signatures(line: str) -> Column:
    """Counts of ``LETTERS`` modulo 256, eight to a bigint."""
    words = [" | ".join(f"shiftleft(cast((length({line}) - length(replace({line}, '{c}', ''))) % 256 as bigint), {8 * i})"
                        for i, c in enumerate(letters)) for letters in LETTERS]
    return F.expr(f"array({', '.join(words)})")


def _letters_near(a: str, b: str, k: str) -> str:
    """True unless the letter counts prove more than ``k`` edits."""
    def apart(w, i):
        x = " - ".join(f"(shiftrightunsigned({side}[{w}], {8 * i}) & 255L)" for side in (a, b))
        return f"least(({x}) & 255L, 256L - (({x}) & 255L))"
    return "(" + " + ".join(apart(w, i) for w in range(len(LETTERS)) for i in range(8)) + f") <= 2 * {k}"


def _specs(k: int) -> Column:
    """The starts to probe at k edits, as (k, d, i, shift): a partner d characters shorter, its segment i."""
    specs = [(k, d, i, shift) for d in range(k + 1) for i in range(k + 1)
             for shift in range(max(-i, d - (k - i)), min(i, d + (k - i)) + 1)]
    return F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("k", "d", "i", "shift"), row)]) for row in specs])


def _codes(line: str) -> Column:
    """Two bytes for each character of a line."""
    two = F.encode(line, "UTF-16BE")
    wide = F.encode(F.regexp_replace(line, r"[\x{10000}-\x{10FFFF}]", "\uFFFD"), "UTF-16BE")
    return F.when(F.octet_length(two) == 2 * F.length(line), two).otherwise(wide)


def keyed_lines(docs: DataFrame, lengths: tuple = LENGTHS) -> DataFrame:
    """``(key, h, n, m, own)``: for every line the substrings at which a segment of a line of
    ``m = n - d`` characters may lie, hashed with that length and the segment's number. ``own`` marks the
    line's own segments (the index); all rows are probes.

    Of k + 1 segments one is found with at most i edits before segment i and at most k - i after
    it; so its start is within i of its own place counted from the front and within k - i counted
    from the back. Segments differ by one character at most, the last ones are the longer.

    Substrings are slices of the line's two-byte characters; those beyond two bytes count as one
    character here (a candidate more at worst: verification reads the text).
    """
    if any(x < (k + 1) * (k + 2) for k, x in enumerate(lengths, 1)) or list(lengths) != sorted(set(lengths)):
        raise ValueError("lengths must rise, and a segment has to be longer than any shift")
    df = all_lines(docs).select("h", "line", F.length("line").alias("n")).where(F.col("n") >= lengths[0])
    df = df.select("h", "n", _codes("line").alias("codes"))
    n, nothing = F.col("n"), _specs(1)
    # a partner up to k characters shorter may allow fewer edits than the line itself
    sets = [F.when((n >= x) & (n - k < up), _specs(k)).otherwise(F.slice(nothing, 1, 0))
            for k, (x, up) in enumerate(zip(lengths, (*lengths[1:], 1 << 31)), 1)]
    df = df.select("h", "n", "codes", F.explode(F.concat(*sets)).alias("s")).select("h", "n", "codes", "s.*")
    df = df.where(f"k = {edits('(n - d)', lengths)}")
    df = df.select("*", F.expr("cast(floor((n - d) / (k + 1)) as int)").alias("short"))
    df = df.select("*", F.expr("k + 1 - (n - d - short * (k + 1))").alias("equal"))      # segments of that size
    df = df.select("h", "n", "codes", F.expr("n - d").alias("m"), F.expr("k * 100 + i").alias("number"),
                   F.expr("2 * (i * short + greatest(0, i - equal) + shift) + 1").alias("at"),
                   F.expr("2 * (short + if(i >= equal, 1, 0))").alias("size"),
                   F.expr("d = 0 and shift = 0").alias("own"))
    return df.select(F.expr("xxhash64(substring(codes, at, size), m, number)").alias("key"), "h", "n", "m", "own")


def dealt_again(crowded: DataFrame, lengths: tuple = LENGTHS, samples: int = SAMPLES) -> DataFrame:
    """The rows of crowded keys (``key, h, n, m, own, line`` and others) under finer keys.

    The index lines of a key have one length m. Up to ``samples`` of them (the smallest under as many
    hashes) show at which places the lines differ; the k + 1 segments are cut so that each has an equal
    share of these differences, and at least k + 1 characters. Shifts are those of :func:`keyed_lines`.
    """
    codes = crowded.withColumn("codes", _codes("line"))
    taken = codes.where("own").groupBy("key", "m").agg(
        *[F.min_by("codes", F.xxhash64(F.lit(j), "h")).alias(f"s{j}") for j in range(samples)])
    chars = ", ".join(f"substring(s{j}, 2 * p - 1, 2)" for j in range(samples))
    most = len(lengths)
    taken = taken.select("key", F.expr(edits("m", lengths)).alias("k"), "m", F.expr(
        f"transform(sequence(1, m), p -> 64 * (size(array_distinct(array({chars}))) - 1) + 1)").alias("w"))
    taken = taken.withColumn("all", F.expr("aggregate(w, 0L, (x, y) -> x + y)"))
    begin = ", ".join(f"'c{t}', 0" for t in range(1, most + 1))
    count = ", ".join(f"'c{t}', a.c{t} + if((a.sum + y) * (k + 1) <= {t} * all, 1, 0)" for t in range(1, most + 1))
    taken = taken.withColumn("cut", F.expr(f"aggregate(w, named_struct('sum', 0L, {begin}), "
                                           f"(a, y) -> named_struct('sum', a.sum + y, {count}))"))
    cuts = ", ".join(f"if({t} > k, m, cast(greatest({t} * (k + 1), least(m - (k + 1 - {t}) * (k + 1), cut.c{t})) as int))"
                     for t in range(1, most + 1))
    taken = taken.select(F.col("key").alias("_key"), F.col("k").alias("_k"), F.expr(f"array(0, {cuts}, m)").alias("cuts"))
    # each cut is at least k + 1 beyond the one before it
    apart = ", ".join(f"if({t} > _k, element_at(cuts, -1), " + "greatest(" + ", ".join(
        f"cuts[{u}] + {t - u} * (_k + 1)" for u in range(t)) + f", cuts[{t}]))" for t in range(1, most + 1))
    taken = frozen(taken.select("_key", "_k", F.expr(f"array(0, {apart}, element_at(cuts, -1))").alias("cuts")))
    rows = codes.join(broadcast_counted(taken, taken.count()), F.col("key") == F.col("_key"))
    specs = F.slice(_specs(1), 1, 0)
    for k in range(1, most + 1):
        specs = F.when(F.col("_k") == k, _specs(k)).otherwise(specs)
    rows = rows.withColumn("s", F.explode(specs)).where("s.d = n - m")
    finer = F.expr("xxhash64(key, s.i, substring(codes, 2 * (cuts[s.i] + s.shift) + 1, "
                   "2 * (cuts[s.i + 1] - cuts[s.i])))")
    return rows.withColumn("own", F.expr("own and s.shift = 0")).withColumn("key", finer).drop(
        "codes", "_key", "_k", "cuts", "s")


def candidate_pairs(docs: DataFrame, lengths: tuple = LENGTHS, crowd: int = CROWD) -> DataFrame:
    """``(a, b, line_a, line_b)``: pairs of lines (the shorter one first) that share a key and pass the
    letter filter.

    Keys of more than one line, one of them in the index, are found by an aggregation whose partial step
    merges the copies of a line before the shuffle. Only rows with such keys, and only the texts of their
    lines, go on; keys with more than ``crowd`` index rows times rows by :func:`dealt_again`."""
    rows = keyed_lines(docs, lengths)
    shared = frozen(rows.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.max("own").alias("own"))
                    .where("low <> high and own").select("key"))
    held = frozen(rows.join(broadcast_counted(shared, shared.count()), "key").distinct())
    wanted = frozen(held.select("h").distinct())
    texts = frozen(all_lines(docs).join(broadcast_counted(wanted, wanted.count()), "h").distinct().select(
        "h", "line", _signatures("line").alias("sig")))
    crowds = frozen(held.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("own").cast("long")).alias("i"))
                    .where(F.col("c") * F.col("i") > crowd).select("key"))
    n = crowds.count()
    if not n:
        return _near_pairs(held.join(texts, "h"), lengths).distinct()
    few = held.join(broadcast_counted(crowds, n), "key", "left_anti").join(texts, "h")
    many = held.join(broadcast_counted(crowds, n), "key").join(texts, "h")
    again = dealt_again(many, lengths)
    return _near_pairs(few, lengths).unionByName(_near_pairs(again, lengths)).distinct()


def _near_pairs(held: DataFrame, lengths: tuple) -> DataFrame:
    """Pairs of index and other rows of a key that pass the letter filter."""
    index = held.where("own").select("key", F.col("h").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"),
                                     F.col("line").alias("line_a"))
    probe = held.select("key", F.col("h").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"),
                        F.col("line").alias("line_b"))
    near = F.expr(_letters_near("sa", "sb", edits("na", lengths)))
    order = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    return index.join(probe, (index["key"] == probe["key"]) & order & near).select("a", "b", "line_a", "line_b")


# ---------------------------------------------------------------- verification

def _common(a: str, b: str, back: bool, most: int = 30) -> str:
    """Length of the common prefix (suffix) of two different strings, by halving steps."""
    def piece(s, at, n):
        return (f"substring({s}, length({s}) - {at} - {n} + 1, {n})" if back else f"substring({s}, {at} + 1, {n})")
    same = f"{piece(a, 'p', 's')} = {piece(b, 'p', 's')}"
    steps = f"transform(sequence({most}, 0, -1), i -> shiftleft(1, i))"
    room = "least(length({0}), length({1}))".format(a, b)
    return f"aggregate({steps}, 0, (p, s) -> if(p + s <= {room}, if({same}, p + s, p), p))"


def banded_distance(x: str, y: str, k: int) -> str:
    """SQL of the edit distance of character arrays ``x`` and ``y`` if it is at most ``k``, else
    ``k + 1``; their sizes differ by at most ``k``.

    Bit-parallel over a diagonal band: after j characters of ``y``, bit t of word ``r_e`` says that
    the first j - k + t characters of ``x`` are at most e edits away. The band is 2 k + 1 bits wide,
    so the words fit a bigint for strings of any length. A character shifts the band by one row:
    a match keeps bit t, a replacement takes it from r_(e-1), an insertion takes bit t + 1 and a
    deletion bit t - 1 of it. Once r_k is empty nothing can come back and the rest is skipped.
    """
    full = (1 << (2 * k + 1)) - 1
    match = " | ".join(f"if(j > {k - t} and get({x}, j - {k - t} - 1) = get({y}, j - 1), {1 << t}L, 0L)"
                       for t in range(2 * k + 1))
    columns = f"transform(sequence(1, greatest(size({y}), 1)), j -> {match})"
    begin = ", ".join(f"'r{e}', {sum(1 << (k + i) for i in range(e + 1))}L" for e in range(k + 1))
    now = ["(r.r0 & m)"]
    for e in range(1, k + 1):
        before = f"r.r{e - 1}"
        now.append(f"(((r.r{e} & m) | {before} | shiftright({before}, 1) | shiftleft({now[-1]}, 1)) & {full}L)")
    after = ", ".join(f"'r{e}', {row}" for e, row in enumerate(now))
    last = f"aggregate({columns}, named_struct({begin}), (r, m) -> if(r.r{k} = 0, r, named_struct({after})))"
    bit = f"shiftleft(1L, size({x}) - size({y}) + {k})"
    cases = " ".join(f"when r.r{e} & {bit} <> 0 then {e}" for e in range(k + 1))
    # "last" is evaluated once, as the only element of an array
    return f"element_at(transform(array({last}), r -> case {cases} else {k + 1} end), 1)"


def distances(pairs: DataFrame, max_edits: int) -> DataFrame:
    """``distance`` (``max_edits + 1``: more) beside ``pairs(line_a, line_b, ...)``, lengths within
    ``max_edits``. Common ends are cut off first; they do not change the distance."""
    df = pairs.withColumn("_p", F.expr(_common("line_a", "line_b", False)))
    df = df.withColumn("_x", F.expr("substring(line_a, _p + 1)")).withColumn("_y", F.expr("substring(line_b, _p + 1)"))
    df = df.withColumn("_q", F.expr(_common("_x", "_y", True)))
    for c in ("_x", "_y"):
        df = df.withColumn(c, F.expr(f"regexp_extract_all(substring({c}, 1, length({c}) - _q), '(?s).', 0)"))
    return df.withColumn("distance", F.expr(banded_distance("_x", "_y", max_edits))).drop("_p", "_q", "_x", "_y")


def line_links(docs: DataFrame, lengths: tuple = LENGTHS) -> DataFrame:
    """``(a, b, distance)``: every pair of different lines within the allowed distance, by hash."""
    both = candidate_pairs(docs, lengths)
    both = frozen(both.withColumn("allowed", F.expr(edits("least(length(line_a), length(line_b))", lengths))))
    bands = sorted({min(k, len(lengths)) for k in (2, 4, 8, 16, 30)})           # a wider band costs more a character
    found, low = None, 0
    for k in bands:
        part = distances(both.where(F.col("allowed").between(low + 1, k)), k).select("a", "b", "distance", "allowed")
        found, low = part if found is None else found.unionByName(part), k
    # kept before it is filtered: a pushed filter would compute the distance again inside itself
    return frozen(found).where("distance <= allowed").select("a", "b", "distance")


def line_classes(docs: DataFrame, lengths: tuple = LENGTHS) -> DataFrame:
    """Classes of near-equal lines of ``docs(doc_id, text)``.

    Returns one row per distinct line that holds a word: doc_id and line_no (0-based) of its first
    occurrence in (doc_id, line_no) order, n_copies, class_doc_id and class_line_no of the first
    occurrence of its class (lines reachable over links), and n_links, the number of different lines
    linked to it. Line dedup keeps the lines whose class is their own first occurrence. Texts are
    split at line feeds; lines are compared as they stand. Null and empty texts have no lines; rows
    repeated are copies; a null doc_id sorts first; an empty table gives an empty result; other
    columns are not read. Lines are told apart by 128 bits of hash, linked by 64.
    """
    lines = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.posexplode(
        F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    lines = lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select(
        F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc_id", "line_no")
    distinct = lines.groupBy("h", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"),
                                            F.count(F.lit(1)).alias("n_copies"))
    links = frozen(line_links(docs, lengths))
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    count = (links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
             .groupBy("node").agg(F.count(F.lit(1)).alias("n_links")))
    linked = frozen(roots.join(count, "node"))
    n = linked.count()
    firsts = distinct.join(broadcast_counted(linked, n), distinct["h"] == linked["node"]).groupBy("root").agg(
        F.min("first").alias("top"))
    named = frozen(linked.join(firsts, "root").select(F.col("node").alias("h"), "top", "n_links"))
    out = distinct.join(broadcast_counted(named, n), "h", "left").withColumn("top", F.coalesce("top", "first"))
    return out.select("first.doc_id", "first.line_no", "n_copies", F.col("top.doc_id").alias("class_doc_id"),
                      F.col("top.line_no").alias("class_line_no"),
                      F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def dedup(docs: DataFrame, lengths: tuple = LENGTHS) -> DataFrame:
    """``(doc_id, kept_lines)``: for each document the numbers of the lines that line dedup keeps
    (the first occurrence of every class)."""
    kept = line_classes(docs, lengths).where(
        F.col("doc_id").eqNullSafe(F.col("class_doc_id")) & (F.col("line_no") == F.col("class_line_no")))
    return kept.groupBy("doc_id").agg(F.array_sort(F.collect_list("line_no")).alias("kept_lines"))
