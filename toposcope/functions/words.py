"""Tokens of whole texts, some megabytes of text at a time (Arrow maps; same tokens as :mod:`.text`).

The regular expressions of :mod:`.text` read a character in about a microsecond. Here a character's class
is looked up in a table, runs are found by comparing neighbours, and the words of a chunk of texts become
one dictionary-encoded Arrow column, so counting is integer work and each different word leaves a chunk
once per document (or once at all). The classes and lower-case forms of the cleaning tokeniser are those
that the session's Java gives, character by character.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WORD_PATTERN, clean_body_pattern

#: Text bytes handled at a time (or one longer text).
CHUNK_BYTES = 1 << 20
#: Words hashed at a time.
HASHED_AT_ONCE = 1 << 16
CODE_POINTS = 0x110000
#: Class of a character: part of a word, but no word of the cleaning tokeniser holds it.
SPOILS = 1
#: Part of a word; its lower-case form depends on its neighbours or is longer than one character.
SPECIAL = 3
PLAIN = 2
FINAL_SIGMA = 0x3A3
TOKENIZERS = ("clean", "whitespace")

_TABLES: dict[tuple[str, str], object] = {}


def _whitespace_classes() -> np.ndarray:
    classes = np.full(CODE_POINTS, PLAIN, np.uint8)
    classes[[c for c in range(CODE_POINTS) if chr(c).isspace()]] = 0
    return classes


def _clean_tables(spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of every code point, as this session's Java has them."""
    chars = spark.range(CODE_POINTS).where("id not between 55296 and 57343").select(
        "id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    low = F.lower("c")
    known = (chars.where(F.col("c").rlike(WORD_PATTERN))
             .select("id", F.col("c").rlike(clean_body_pattern()).alias("body"), F.char_length(low).alias("n"),
                     F.conv(F.hex(F.encode(low, "UTF-32")), 16, 10).cast("bigint").alias("low")).collect())
    classes, lower = np.zeros(CODE_POINTS, np.uint8), np.arange(CODE_POINTS, dtype=np.uint32)
    for c, body, n, to in known:
        classes[c] = SPOILS if not body else PLAIN if n == 1 and c != FINAL_SIGMA else SPECIAL
        if classes[c] == PLAIN:
            lower[c] = to
    return classes, lower


def _tables(spark: SparkSession, tokenizer: str):
    """The tokeniser's tables as a broadcast variable, made once a session."""
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {tokenizer!r}: one of {TOKENIZERS}")
    at = (spark.sparkContext.applicationId, tokenizer)
    if at not in _TABLES:
        made = _clean_tables(spark) if tokenizer == "clean" else (_whitespace_classes(), None)
        _TABLES[at] = spark.sparkContext.broadcast(made)
    return _TABLES[at]


def _code_points(column) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a string column, and the place of each text's first one (and the end)."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offs[0]:offs[-1]]
    try:
        points = np.frombuffer(str(data.data, "utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:           # as Java does, text by text: a broken sequence is one U+FFFD
        whole = column.cast(pa.large_binary()).to_pylist()
        texts = [t.decode("utf-8", "replace") for t in whole]
        return (np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32),
                np.cumsum([0] + [len(t) for t in texts]))
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    return points, lead[offs - offs[0]]


def _strings(points: np.ndarray, lengths: np.ndarray):
    """Arrow strings of consecutive runs of code points."""
    import pyarrow as pa

    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(width)])
    offs = ends[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int64)
    data = points.astype(np.uint32, copy=False).tobytes().decode("utf-32-le").encode("utf-8")
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offs), pa.py_buffer(data)])


def words_of(column, classes: np.ndarray, lower: np.ndarray | None):
    """``(words, rows)``: the tokens of the texts in order, and the number of each token's text. With
    ``lower``, a word with a spoiling character goes, then the words of one character."""
    import pyarrow as pa
    import pyarrow.compute as pc

    points, first = _code_points(column)
    kind = classes[points]
    inside = kind > 0
    opens, ends = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = first[1:-1]
    cut = cut[(cut > 0) & (cut < len(points))]               # a word never runs on into the next text
    opens[cut], ends[cut - 1] = inside[cut], inside[cut - 1]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(ends) + 1
    special = np.zeros(len(starts), bool)
    if lower is not None:
        spoiled = np.concatenate([[0], np.cumsum(kind == SPOILS, dtype=np.int64)])
        keep = spoiled[stops] == spoiled[starts]
        odd = kind == SPECIAL
        if odd.any():
            odd = np.concatenate([[0], np.cumsum(odd, dtype=np.int64)])
            special = odd[stops] > odd[starts]
        keep &= special | (stops - starts > 1)
        starts, stops, special = starts[keep], stops[keep], special[keep]
    mark = np.zeros(len(points) + 1, np.int8)
    mark[starts] += 1
    mark[stops] -= 1
    kept = points[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    words = _strings(kept if lower is None else lower[kept], stops - starts)
    rows = np.searchsorted(first, starts, side="right") - 1
    if special.any():
        at = np.flatnonzero(special)
        low = [w.lower() for w in words.take(pa.array(at)).to_pylist()]
        words = pc.replace_with_mask(words, pa.array(special), pa.array(low, pa.large_string()))
        keep = ~special
        keep[at] = [len(w) > 1 for w in low]
        words, rows = words.filter(pa.array(keep)), rows[keep]
    return words, rows


def string_hashes(column) -> np.ndarray:
    """64-bit hashes of a string column, some texts at a time; a null one is hashed as an empty text."""
    import pyarrow as pa

    out = np.zeros(len(column), np.uint64)
    for at in range(0, len(column), HASHED_AT_ONCE):
        part = column.slice(at, HASHED_AT_ONCE).cast(pa.large_string()).fill_null("")
        offs = np.frombuffer(part.buffers()[1], np.int64)[part.offset:part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offs[0]:offs[-1]]
        starts, lens = offs[:-1] - offs[0], np.diff(offs)
        power = np.concatenate([[1], np.cumprod(np.full(max(lens.max(initial=0), 1), 0x9E3779B97F4A7C15, np.uint64))]).astype(np.uint64)
        place = np.arange(len(data)) - np.repeat(starts, lens)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[place], dtype=np.uint64)])
        out[at:at + len(part)] = total[starts + lens] - total[starts]
    return out


def words_by_hash(words, ids):
    """``(words, ids, hashes)`` in the order of the hashes: what :func:`place_in` looks words up in."""
    import pyarrow as pa

    hashes = string_hashes(words)
    order = np.argsort(hashes, kind="stable")
    at = pa.array(order)
    return words.take(at), ids.take(at), hashes[order]


def place_in(known, hashes: np.ndarray, words) -> np.ndarray:
    """Place of each of ``words`` among ``known`` (in the order of their hashes), or -1. No table is built."""
    import pyarrow as pa
    import pyarrow.compute as pc

    wanted = string_hashes(words)
    at, out = np.searchsorted(hashes, wanted), np.full(len(wanted), -1)
    left = np.arange(len(wanted))
    while len(left):                          # a round more only where different words share a hash
        left = left[at[left] < len(hashes)]
        left = left[hashes[at[left]] == wanted[left]]
        same = pc.fill_null(pc.equal(known.take(pa.array(at[left])), words.take(pa.array(left)).cast(known.type)), False)
        same = same.to_numpy(zero_copy_only=False)
        out[left[same]] = at[left[same]]
        left = left[~same]
        at[left] += 1
    return out


def _chunks(batch, text: int):
    """Slices of a batch with about :data:`CHUNK_BYTES` of text each (or one longer text)."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + CHUNK_BYTES, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _mapped(src: DataFrame, tokenizer: str, emit, schema: T.StructType) -> DataFrame:
    """``emit(part, words, rows)`` → columns over each chunk ``part`` of ``src``, whose last column is the text."""
    tables, place, names = _tables(src.sparkSession, tokenizer), len(src.columns) - 1, schema.names

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for part in _chunks(batch, place):
                columns = emit(part, *words_of(part.column(place), *tables.value))
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return src.mapInArrow(run, schema)


def _keyed(df: DataFrame, text: str, keys, tokenizer: str, emit, *more: T.StructField) -> DataFrame:
    """:func:`_mapped` where each output row begins with the keys of its text."""
    src = df.select(*keys, F.col(text).cast("string").alias("_text"))
    return _mapped(src, tokenizer, emit, T.StructType([*src.schema.fields[:-1], *more]))


def _encoded(words):
    """Dictionary of the words, and each word's number in it."""
    import pyarrow as pa
    coded = words.dictionary_encode()
    return coded.dictionary.cast(pa.string()), coded.indices.to_numpy().astype(np.int64)


def _pairs(words, rows: np.ndarray):
    """The different (text, word) pairs: dictionary, text numbers, word numbers, and how often each occurs."""
    names, codes = _encoded(words)
    pairs, n = np.unique(rows * max(len(names), 1) + codes, return_counts=True)
    return names, pairs // max(len(names), 1), pairs % max(len(names), 1), n


def token_rows(df: DataFrame, text: str = "text", keys=("doc_id",), tokenizer: str = "clean", word: str = "word") -> DataFrame:
    """``(keys..., pos, word)``: one row per token, ``pos`` counts a text's tokens from 0."""
    def emit(part, words, rows):
        import pyarrow as pa
        new = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1]) if len(rows) else np.zeros(0, np.int64)
        pos = np.arange(len(rows)) - np.repeat(new, np.diff(np.append(new, len(rows))))
        at = pa.array(rows)
        return [*(part.column(i).take(at) for i in range(len(keys))), pa.array(pos.astype(np.int64)), words.cast(pa.string())]

    return _keyed(df, text, keys, tokenizer, emit, T.StructField("pos", T.LongType()), T.StructField(word, T.StringType()))


def word_counts_by_row(df: DataFrame, text: str = "text", keys=("doc_id",), tokenizer: str = "clean") -> DataFrame:
    """``(keys..., word, n)``: one row per different word of a text (a row of ``df``), with its count."""
    def emit(part, words, rows):
        import pyarrow as pa
        names, row, code, n = _pairs(words, rows)
        at = pa.array(row)
        return [*(part.column(i).take(at) for i in range(len(keys))), names.take(pa.array(code)), pa.array(n.astype(np.int64))]

    return _keyed(df, text, keys, tokenizer, emit, T.StructField("word", T.StringType()), T.StructField("n", T.LongType()))


def word_totals(df: DataFrame, text: str = "text", tokenizer: str = "clean") -> DataFrame:
    """``(word, n)``: partial counts of all tokens, one row per different word of a chunk."""
    def emit(part, words, rows):
        import pyarrow as pa
        names, codes = _encoded(words)
        return [names, pa.array(np.bincount(codes, minlength=len(names)).astype(np.int64))]

    return _keyed(df, text, (), tokenizer, emit, T.StructField("word", T.StringType()), T.StructField("n", T.LongType()))


def document_counts(df: DataFrame, text: str = "text", flags=(), tokenizer: str = "clean") -> DataFrame:
    """``(word, n, flags...)``: partial numbers of texts (rows) with the word, one row per different word
    of a chunk; a flag is 1 if any of those texts has it, 0 if none has, null if it is null in all."""
    def emit(part, words, rows):
        import pyarrow as pa
        names, row, code, _ = _pairs(words, rows)
        out = [names, pa.array(np.bincount(code, minlength=len(names)).astype(np.int64))]
        for i in range(len(flags)):
            # -1: null, 0: false, 1: true
            value = part.column(i).cast(pa.int8()).fill_null(-1).to_numpy()
            top = np.full(len(names), -1, np.int8)
            np.maximum.at(top, code, value[row])
            out.append(pa.array(top.astype(np.int32), mask=top < 0))
        return out

    fields = [T.StructField("word", T.StringType()), T.StructField("n", T.LongType()),
              *(T.StructField(f, T.IntegerType()) for f in flags)]
    src = df.select(*[F.col(f).cast("boolean").alias(f) for f in flags], F.col(text).cast("string").alias("_text"))
    return _mapped(src, tokenizer, emit, T.StructType(fields))


def packed_counts(df: DataFrame, vocab, text: str = "text", keys=("doc_id",), tokenizer: str = "clean") -> DataFrame:
    """``(keys..., tokens, counts)``: ids of a text's (a row's) known words, ascending, with their counts;
    texts without one have no row. ``vocab``: a broadcast of :func:`words_by_hash`, each word once."""
    def emit(part, words, rows):
        import pyarrow as pa
        known, ids, hashes = vocab.value
        coded = words.dictionary_encode()
        place = place_in(known, hashes, coded.dictionary)
        token = np.where(place >= 0, ids.to_numpy()[place], -1) if len(known) else np.full(len(place), -1)
        token = token[coded.indices.to_numpy()]
        rows, token = rows[token >= 0], token[token >= 0]
        span = int(token.max()) + 1 if len(token) else 1
        pairs, n = np.unique(rows * span + token, return_counts=True)
        row, first = np.unique(pairs // span, return_index=True)
        offsets = pa.array(np.append(first, len(pairs)).astype(np.int32))
        at = pa.array(row)
        return [*(part.column(i).take(at) for i in range(len(keys))),
                pa.ListArray.from_arrays(offsets, pa.array(pairs % span)), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int64)))]

    ids = T.ArrayType(T.LongType())
    return _keyed(df, text, keys, tokenizer, emit, T.StructField("tokens", ids), T.StructField("counts", ids))
