"""Language identification of whole, possibly mixed-language texts.

Words are scored per language by character n-grams and the word itself (hashed into a table of
fixed size, so the model does not grow with the corpus). The scripts of a word's letters narrow its
candidates to the languages that were seen with that script. A Viterbi pass with a penalty for
each switch of language labels the words; spans are runs of one label. The language of a text is
the one with the most letters in its spans.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textbuf import (MULT, broadcast_counted, chunks, frozen, mix64, text_key, utf8, word_hashes,
                      word_spans)

TRAIN_DOCS, TRAIN_CHARS, BITS, SWITCH, PRIOR = 1000, 500_000, 18, 6.0, 0.5
SCRIPT_SHARE, GRAMS, MEMO = 0.01, 4, 500_000
UND = "und"

# First code points of the script ranges that are told apart, with the name of the script.
SCRIPTS = ((0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
           (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "other indic"), (0x0E00, "thai"), (0x0E80, "other asian"),
           (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
           (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"),
           (0xF900, "han"), (0xFB00, "other"))
_NAMES = sorted({name for _, name in SCRIPTS})
_FROM = np.array([at for at, _ in SCRIPTS])
_SCRIPT = np.array([_NAMES.index(name) for _, name in SCRIPTS])


_ALPHA = np.zeros(0, bool)


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _ALPHA
    if not len(_ALPHA):                                   # once per process; the table is Unicode's, not ours
        _ALPHA = np.fromiter((chr(c).isalpha() for c in range(0x20000)), bool, 0x20000)
    return _ALPHA[np.minimum(points, 0x1FFFF)] | ((points >= 0x20000) & (points < 0x32000))


class Letters:
    """Lower-cased letters of a list of words as one code point array, ``<`` and ``>`` around each."""

    def __init__(self, words: list[bytes]):
        text = b"\n".join(words).decode("utf-8", "replace").lower()
        raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        word = np.cumsum(raw == 10)
        keep = _is_letter(raw)
        self.sizes = np.bincount(word[keep], minlength=len(words))[:len(words)]
        n = self.sizes + 2
        self.start = np.cumsum(n) - n
        self.points = np.empty(int(n.sum()), np.uint64)
        self.points[self.start], self.points[self.start + n - 1] = 60, 62
        self.place = np.arange(len(self.points)) - np.repeat(self.start, n)
        self.room = np.repeat(n, n) - self.place          # code points from here to the word's end
        inner = (self.place > 0) & (self.room > 1)
        self.points[inner] = raw[keep]
        kind = _SCRIPT[np.maximum(np.searchsorted(_FROM, raw[keep], side="right") - 1, 0)]
        bits = np.zeros(len(self.points), np.int64)
        bits[inner] = 1 << kind
        self.scripts = np.bitwise_or.reduceat(bits, self.start)       # a bit for each script of a word

    def slots(self):
        """``(positions, table slots)`` of the n-grams of each length, then of the whole words."""
        h = np.zeros(len(self.points), np.uint64)
        at = np.arange(len(self.points))
        for k in range(GRAMS):
            at = at[self.room[at] > k]
            h[at] = (h[at] ^ self.points[at + k]) * MULT
            yield at, self._slot(h[at])
        power = np.multiply.accumulate(np.full(int(self.place.max()) + 1, MULT))
        yield self.start, self._slot(np.add.reduceat(mix64(self.points) * power[self.place], self.start))

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (mix64(h) & np.uint64((1 << BITS) - 1)).astype(np.int64)


class Model:
    """Log-probability table, script table and prior order of the learned languages."""

    def __init__(self, rows: list[tuple[str, str]]):
        words: dict[str, Counter] = {}
        docs: Counter = Counter()
        for text, lang in rows:
            docs[lang] += 1
            words.setdefault(lang, Counter()).update(text.encode().split())
        self.langs = sorted(words, key=lambda c: (-docs[c], c))      # ties go to the most frequent
        n = max(len(self.langs), 1)                                   # with nothing learned: one empty column
        table = np.zeros((1 << BITS, n), np.float32)
        self.scripts = np.zeros(n, np.int64)                          # a bit for each script a language uses
        for k, lang in enumerate(self.langs):
            counts = np.zeros(1 << BITS)
            if words[lang]:
                held = Letters(list(words[lang]))
                times = np.where(held.sizes > 0, list(words[lang].values()), 0)
                by_point = np.repeat(times, held.sizes + 2)
                for at, slots in held.slots():
                    counts += np.bincount(slots, by_point[at], minlength=1 << BITS)
                for b in range(len(_NAMES)):
                    if times[held.scripts >> b & 1 > 0].sum() >= SCRIPT_SHARE * max(times.sum(), 1):
                        self.scripts[k] |= 1 << b
            table[:, k] = np.log((counts + PRIOR) / (counts.sum() + PRIOR * (1 << BITS)))
        self.table = table - table.mean(axis=1, keepdims=True)

    def scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Score per word and language, and its letters. Languages not seen with a word's scripts are
        far below, unless that leaves none; words without a letter score 0 everywhere."""
        held = Letters(words)
        by_point = np.zeros((len(held.points), self.table.shape[1]), np.float32)
        for at, slots in held.slots():
            by_point[at] += self.table[slots]
        grams = GRAMS * (held.sizes + 2) + 1
        out = np.add.reduceat(by_point, held.start, axis=0) / np.sqrt(grams, dtype=np.float32)[:, None]
        fits = (held.scripts[:, None] & ~self.scripts[None, :]) == 0
        narrow = fits.any(axis=1) & ~fits.all(axis=1)
        out[narrow] = np.where(fits[narrow], out[narrow], out[narrow].min(axis=1, keepdims=True) - 20)
        out[held.sizes == 0] = 0
        return out, held.sizes


class Scorer:
    """Word scores with a bounded memory of words met before in this task."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self):
        self.known: dict[int, int] = {}
        self.rows = np.zeros((1 << 16, self.model.table.shape[1]), np.float32)
        self.sizes = np.zeros(1 << 16, np.int32)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and letters of the words at ``starts`` and ``ends`` of a text buffer."""
        if len(self.known) > MEMO:
            self._forget()
        known, raw = self.known, data.tobytes()
        words, at, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        words = words.tolist()
        fresh = [k for k, w in enumerate(words) if w not in known]
        while len(self.rows) < len(known) + len(fresh):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        for i in range(0, len(fresh), 10_000):
            part = fresh[i:i + 10_000]
            ids = slice(len(known), len(known) + len(part))
            spans = zip(starts[at[part]].tolist(), ends[at[part]].tolist())
            self.rows[ids], self.sizes[ids] = self.model.scores([raw[a:b] for a, b in spans])
            known.update(zip((words[k] for k in part), range(ids.start, ids.stop)))
        ids = np.array([known[w] for w in words], np.int64)[back]
        return self.rows[ids], self.sizes[ids]


def label(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word: Viterbi with ``switch`` lost per change, for the texts
    ``first[i]:first[i + 1]``.

    A text stays in its best single language if no run of words gains more than half of ``switch`` in
    any other one: r runs in other languages cost r - 1 switches at least. That is one pass of sums
    for all texts; the others go through the Viterbi steps together, one step per word position."""
    n = np.diff(first)
    langs = scores.shape[1]
    labels = np.zeros(len(scores), np.int16)
    if langs < 2 or not len(scores):
        return labels
    text = np.repeat(np.arange(len(n)), n)
    totals = np.stack([np.bincount(text, scores[:, k], minlength=len(n)) for k in range(langs)], axis=1)
    main = totals.argmax(axis=1)
    labels[:] = main[text]
    own = scores[np.arange(len(scores)), labels]
    mixed = np.zeros(len(n), bool)
    filled = np.flatnonzero(n > 0)
    for k in range(langs):
        run = np.concatenate([[0.0], np.cumsum((scores[:, k] - own).astype(np.float64))])
        fall = run.max() - run.min() + 1.0                # puts each text below the one before it
        sunk = run[1:] - fall * text
        before = run[:-1] - fall * text
        gain = sunk - np.minimum.accumulate(before)
        mixed[filled] |= np.maximum.reduceat(gain, first[filled]) > switch / 2
    some = np.flatnonzero(mixed)
    if len(some):
        inside = mixed[text]
        labels[inside] = _viterbi(scores[inside], np.concatenate([[0], np.cumsum(n[some])]), switch)
    return labels


def _viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    start, lengths = first[:-1][order], n[order]
    langs = scores.shape[1]
    labels = np.zeros(len(scores), np.int16)
    best = scores[start].astype(np.float64)
    came = np.zeros((len(scores), langs), np.int16)
    own = np.arange(langs, dtype=np.int16)
    lives = np.searchsorted(-lengths, -np.arange(int(lengths[0])))      # texts with more than t words
    for t in range(1, int(lengths[0])):
        live = int(lives[t])
        now = best[:live]
        top = now.argmax(axis=1)
        jump = now[np.arange(live), top][:, None] - switch
        stay = now >= jump
        at = start[:live] + t
        came[at] = np.where(stay, own, top[:, None])
        best[:live] = np.where(stay, now, jump) + scores[at]
    last = best.argmax(axis=1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        live = int(lives[t])
        at = start[:live] + t
        labels[at] = last[:live]
        if t:
            last[:live] = came[at, last[:live]]
    return labels


def held_out(doc_id: str = "doc_id"):
    """True for documents that never train: crc32(doc_id as text) mod 4 is 2 (null: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _first_texts(texts: DataFrame, max_docs: int, most: int) -> DataFrame:
    """Different ``texts(_t1, _t2, lang, n)`` that hold the first ``max_docs`` of every language, texts of
    up to ``most`` characters before longer ones, then by ``_t1``.

    Different texts are counted per language and number of significant bits of ``_t1`` above the least
    long; each further bit holds about as many as all before it, so what is kept of a language is about
    twice ``max_docs`` however many texts it has, and no task ranks all of them."""
    place = [(F.col("n") > most).alias("late"), F.length(F.bin(F.col("_t1").bitwiseXOR(F.lit(-2**63)))).alias("bits")]
    texts = texts.select("*", *place)
    counted = texts.distinct().groupBy("lang", "late", "bits").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy("lang").orderBy("late", "bits")) - F.col("m")
    held = frozen(counted.withColumn("before", before).where(F.col("before") < max_docs).select("lang", "late", "bits"))
    return texts.join(broadcast_counted(held, held.count()), ["lang", "late", "bits"]).select(
        "_t1", "_t2", "lang", "n").distinct()


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> Model:
    """A model from at most ``max_docs`` different labelled texts of each language outside the held-out
    part, those with the smallest text hash, and at most ``max_chars`` of them altogether; later texts
    of a language that is full are left out whole. Texts of more than a twentieth of ``max_chars`` come
    after the shorter ones and train with that much of their beginning. The bounds are per language and
    do not depend on the corpus."""
    labelled = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    most = max_chars // 20
    keys = [*text_key(), F.col("lang")]
    texts = labelled.select(*keys, F.length("text").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n") > most, "_t1", "_t2")
    chosen = (_first_texts(texts, max_docs, most).withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_docs)
              .withColumn("used", F.sum(F.least("n", F.lit(most))).over(Window.partitionBy("lang").orderBy("k"))))
    chosen = frozen(chosen.where(F.col("used") <= max_chars).select("_t1", "_t2", "lang"))
    begun = labelled.select(*keys, F.substring("text", 1, most).alias("text"))
    sample = begun.join(broadcast_counted(chosen, chosen.count()), ["_t1", "_t2", "lang"])
    return Model([tuple(r) for r in sample.select("text", "lang").distinct().collect()])


def identify(docs: DataFrame, model: Model | None = None, switch: float = SWITCH,
             with_spans: bool = False) -> DataFrame:
    """Language of every whole text of ``docs(doc_id, text)`` (``lang`` is read for training only).

    Returns doc_id, held_out, lang_pred, score (share of the letters that lie in spans of the
    predicted language), n_spans and, with ``with_spans``, spans (``lang:first word:end word``).
    Texts that are null, empty or without a letter are ``und`` with score 0; so is everything if
    nothing could be learned. Ties go to the language with more training documents. Repeated rows
    are labelled each; a null doc_id is not held out; an empty table gives an empty result; other
    columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs) if model is None else model)
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double, n_spans bigint" + ", spans string" * with_spans

    def run(batches):
        model = shared.value
        scorer = Scorer(model)
        for batch in batches:
            for part in chunks(batch):
                data, offs = utf8(part.column(2))
                starts, ends, first = word_spans(data, offs)
                scores, sizes = scorer(data, starts, ends)
                labels = label(scores, first, switch)
                n = len(model.langs)
                weight = np.zeros((part.num_rows, max(n, 1)))
                np.add.at(weight, (np.repeat(np.arange(part.num_rows), np.diff(first)), labels), sizes)
                total = weight.sum(axis=1)
                known = (total > 0) & (n > 0)
                top = weight.argmax(axis=1)
                share = np.where(known, weight[np.arange(part.num_rows), top] / np.maximum(total, 1), 0.0)
                change = np.ones(len(labels), bool)
                change[1:] = labels[1:] != labels[:-1]
                change[first[:-1][first[:-1] < len(labels)]] = True
                spans = np.diff(np.concatenate([[0], np.cumsum(change)])[first])
                cols = [part.column(0), part.column(1),
                        pa.array([model.langs[k] if ok else UND for k, ok in zip(top, known)], pa.string()),
                        pa.array(share), pa.array(np.where(known, spans, 0).astype(np.int64))]
                names = ["doc_id", "held_out", "lang_pred", "score", "n_spans"]
                if with_spans:
                    cols.append(pa.array([_spans(labels[a:b], model.langs) if ok else "" for a, b, ok in
                                          zip(first[:-1], first[1:], known)], pa.string()))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), "text").mapInArrow(run, schema)


def _spans(labels: np.ndarray, langs: list[str]) -> str:
    cut = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1], [True]]))
    return ",".join(f"{langs[labels[a]]}:{a}:{b}" for a, b in zip(cut[:-1], cut[1:]))
