"""PII: pattern rules plus a semi-Markov conditional random field for what they miss.

The base finds e-mail, IP, card and phone spans with fixed patterns. The model then cuts the
tokens around digits and ``@`` into segments: every stretch of up to four tokens, or up to
``MAX_TOKENS`` where it can be one number, is a candidate of every type, scored by features of the whole span (digits, separators, shape, words
before it). Boundaries and types are chosen together by a Viterbi pass over segment ends whose
inner loop is bounded by ``MAX_TOKENS``. Tokens without a digit or ``@`` nearby cannot begin or
end an entity, so they need no pass.

The weights are the maximum of the conditional likelihood (forward-backward over segments) on a
sample of at most ``TRAIN_DOCS`` different texts that hold digits or ``@``, chosen by hash; base spans are the
labels. Each such document trains again with its spans rewritten in ways the patterns do not
know (a phone number without its country code, with points or dashes, in pairs of digits or after ``00``, a
card number in fours with points or colons, of 15 digits, or as the longest one with a wrong last digit, an
address with commas, colons or underscores), so those spellings score as what they are, and with the digits of its spans as a list of numbers and as a
date, which are none. Features of the digit groups do not depend on what divides them, so spellings
that were never seen are found as well; a bracketed at or dot counts as the sign.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import broadcast_counted, chunks, frozen, text_key, utf8

KINDS = ("email", "ip", "card", "phone")
MAX_DIGITS = 19                       # the most digits of any kind (card)
MAX_TOKENS = MAX_DIGITS               # a token for each of them
CONTEXT, TRAIN_DOCS, EPOCHS, RATE, DECAY = 2, 200, 20, 0.3, 1e-4
MARGIN = 0.3
SPELLINGS = 8                         # ways in which a training text is spelled anew

_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_HEAD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_TRIGGER = re.compile(r"[0-9@]")
_DIGITS, _RUN = re.compile(r"[0-9]"), re.compile(r"[0-9]+")
_AT_MARK, _DOT_MARK = re.compile(r" ?[(\[{] ?(?:at|@) ?[)\]}] ?", re.I), re.compile(r" ?[(\[{] ?(?:dot|\.) ?[)\]}] ?", re.I)
_EDGE_LEFT, _EDGE_RIGHT = "\"'<[{", ".,;:!?\"'>]}"
# Words that announce an entity.
CUES = ("mail", "email", "phone", "tel", "call", "fax", "mobile", "card", "visa", "account", "ip", "host", "server",
        "address", "contact")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by the fixed patterns, by kind as listed, then start. Each pattern is
    matched in time linear in the text: an e-mail is found at its ``@`` and extended to the left
    within what no earlier match took, which is where a scan from the left would begin."""
    out = []
    last = 0
    for m in _EMAIL_TAIL.finditer(text) if "@" in text else ():
        at = m.start()
        while at > last and text[at - 1] in _EMAIL_HEAD:
            at -= 1
        if at < m.start():
            out.append((0, at, m.end()))
            last = m.end()
    if not _DIGITS.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m.group())) <= 15]
    return out


# ---------------------------------------------------------------- the model

def _span_features(piece: str, tokens: int, before: str) -> list[int]:
    """Indices of the active features of one candidate span."""
    piece = _DOT_MARK.sub(".", _AT_MARK.sub("@", piece))
    digits = len(_DIGITS.findall(piece))
    letters = sum(c.isalpha() for c in piece)
    dots, at = piece.count("."), piece.count("@")
    dashes, spaces = piece.count("-"), piece.count(" ")
    on = [0, 1 + min(digits, 20), 22 + min(letters, 8), 31 + min(dots, 4), 36 + min(at, 2), 39 + min(dashes, 3),
          43 + tokens if tokens < 5 else 74 + min(tokens, MAX_TOKENS), 48 + (piece[:1] == "+"), 50 + ("(" in piece and ")" in piece),
          52 + (piece[:1].isdigit()) + 2 * (piece[-1:].isdigit()), 56 + min(spaces, 3)]
    lead = before.strip(".,:;()\"'").lower()
    if lead in CUES:
        on.append(60 + CUES.index(lead))
    if at == 1 and "." in piece.rpartition("@")[2].strip("."):
        on.append(75)
    if dots == 3 and digits + 3 == len(piece):
        on.append(76)
    if digits == len(piece):
        on.append(77)
    if digits >= 12 and digits + dashes + spaces == len(piece) and luhn("".join(_DIGITS.findall(piece))):
        on.append(78)
    return on + _group_features(piece, digits, letters)


def _group_features(piece: str, digits: int, letters: int) -> list[int]:
    """Features of the digit groups of a span, whatever stands between them: their number, whether one mark
    divides them all, and the shapes of the four kinds."""
    runs = _RUN.findall(piece)
    marks = {m.replace(" ", "") for m in _RUN.split(piece)[1:-1]}
    kind = 0 if not marks else 1 if marks == {""} else 2 if len(marks) == 1 and not letters else 3
    sizes = [len(r) for r in runs]
    at = 75 + MAX_TOKENS
    on = [at + min(len(runs), 7), at + 8 + kind]
    if kind == 2 and len(runs) == 4 and not letters and max(sizes) <= 3 and all(int(r) <= 255 for r in runs):
        on.append(at + 12)
    if 13 <= digits <= MAX_DIGITS and not letters and luhn("".join(runs)):
        on.append(at + 13)
    inner = set(sizes[1:-1])
    if len(inner) == 1 and inner <= {2, 3, 4}:
        on.append(at + 12 + inner.pop())
    if 9 <= digits <= 15 and not letters and len(runs) >= 3 and sizes[0] <= 4 and all(2 <= n <= 4 for n in sizes[1:]):
        on.append(at + 17)
    if piece.startswith(("+", "00", "(+", "(00")):
        on.append(at + 18)
    if 1 in sizes[1:]:
        on.append(at + 19)
    return on


N_FEATURES, N_TYPES = 75 + MAX_TOKENS + 20, len(KINDS)


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Runs of token spans around triggers: a trigger token, the tokens up to ``CONTEXT`` on either
    side, joined where they meet. Closing and opening punctuation is outside a token's span."""
    runs: list[list[tuple[int, int]]] = []
    held: list[tuple[int, int]] = []
    since = None                        # tokens since the last trigger of the open run
    for m in _TOKEN.finditer(text):
        piece = m.group()
        a, b = m.span()
        a += len(piece) - len(piece.lstrip(_EDGE_LEFT))
        b -= len(piece) - len(piece.rstrip(_EDGE_RIGHT))
        span = (a, b) if a < b else m.span()
        if _TRIGGER.search(piece):
            held.append(span)
            since = 0
        elif since is None:
            held = held[-(CONTEXT - 1):] + [span]
        else:
            held.append(span)
            since += 1
            if since == 2 * CONTEXT:    # the next run keeps the last tokens as its left context
                runs.append(held[:-CONTEXT])
                held, since = held[-CONTEXT:], None
    if since is not None:
        runs.append(held)
    return runs


def candidates(text: str, run: list[tuple[int, int]]) -> list[list[tuple[int, int, list[int]]]]:
    """For each token end j: ``(i, j, features)`` of the candidate segments that end with token j.
    A segment begins and ends with a token that holds a digit, ``@`` or ``(``; one of five tokens or
    more stands in one line, without letters or ``@``, and has at most ``MAX_DIGITS`` digits."""
    edge = [any(c.isdigit() or c in "@(" for c in text[a:b]) for a, b in run]
    digits = np.cumsum([0] + [len(_DIGITS.findall(text[a:b])) for a, b in run]).tolist()
    bars = np.cumsum([0] + [any(c.isalpha() or c == "@" for c in text[a:b]) for a, b in run]).tolist()
    out = []
    for j in range(len(run)):
        row = []
        if edge[j]:
            for i in range(j, max(-1, j - MAX_TOKENS), -1):
                if j - i >= 4 and (digits[j + 1] - digits[i] > MAX_DIGITS or bars[j + 1] > bars[i]
                                   or "\n" in text[run[i][1]:run[j][0]]):
                    break
                if edge[i]:
                    before = text[run[i - 1][0]:run[i - 1][1]] if i else ""
                    row.append((i, j, _span_features(text[run[i][0]:run[j][1]], j - i + 1, before)))
        out.append(row)
    return out


def best_segments(rows, weights: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Viterbi over segment ends: ``(i, j, type, margin)`` of the best segmentation. The margin is
    the segment's score over that of leaving its tokens outside."""
    best, back = [0.0], []
    for j, row in enumerate(rows):
        top, how = best[j], None                         # token j outside any entity scores 0
        for i, _, on in row:
            scores = weights[:, on].sum(axis=1)
            kind = int(scores.argmax())
            if best[i] + scores[kind] > top:
                top, how = best[i] + scores[kind], (i, j, kind, float(scores[kind]))
        best.append(top)
        back.append(how)
    out, j = [], len(rows) - 1
    while j >= 0:
        how = back[j]
        if how is None:
            j -= 1
        else:
            out.append(how)
            j = how[0] - 1
    return out[::-1]


def _log_likelihood_gradient(rows, gold: dict, weights: np.ndarray) -> np.ndarray:
    """Observed minus expected feature counts of one run (forward-backward over segments)."""
    n = len(rows)
    scored = [[(i, on, weights[:, on].sum(axis=1)) for i, _, on in row] for row in rows]
    fore = np.zeros(n + 1)
    for j in range(n):
        terms = [fore[j]] + [fore[i] + s for i, _, sc in scored[j] for s in sc]
        fore[j + 1] = np.logaddexp.reduce(terms)
    by_start: dict[int, list] = {}
    for j in range(n):
        for i, _, sc in scored[j]:
            by_start.setdefault(i, []).append((j, sc))
    aft = np.zeros(n + 1)
    for i in range(n - 1, -1, -1):
        terms = [aft[i + 1]] + [aft[j + 1] + s for j, sc in by_start.get(i, []) for s in sc]
        aft[i] = np.logaddexp.reduce(terms)
    grad = np.zeros_like(weights)
    for j in range(n):
        for i, on, sc in scored[j]:
            p = np.exp(fore[i] + sc + aft[j + 1] - fore[n])
            if (i, j) in gold:
                p[gold[i, j]] -= 1
            grad[:, on] -= p[:, None]
    return grad


def _grouped(digits: str, sizes: tuple, sep: str) -> str:
    """The digits in groups of ``sizes`` (the last size repeats)."""
    out, at, k = [], 0, 0
    while at < len(digits):
        size = sizes[min(k, len(sizes) - 1)]
        out.append(digits[at:at + size])
        at, k = at + size, k + 1
    return sep.join(out)


def _spelled(kind: int, piece: str, spelling: int) -> str | None:
    """One span as ``spelling`` (of ``SPELLINGS``) has it; None: as it stands, and no entity any more."""
    digits = "".join(_DIGITS.findall(piece))
    if kind == 0:
        return piece
    if spelling >= SPELLINGS - 2:
        return None
    if kind == 1:
        return piece.replace(".", (".", ",", ":", " : ", "_", ".")[spelling])
    if kind == 2:
        long = (digits + digits)[:MAX_DIGITS - 1]
        long += "1" if luhn(long + "0") else "0"
        less = next(digits[:14] + c for c in "0123456789" if luhn(digits[:14] + c))
        return (piece, _grouped(digits, (4,), "."), _grouped(long, (4,), " "), _grouped(digits, (4,), " : "),
                _grouped(less, (4, 6, 5), "-"), _grouped(digits, (4,), " "))[spelling]
    home = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", piece)
    own = "".join(_DIGITS.findall(home))
    return (home, re.sub(r"[^0-9]+", ".", home.strip("()")), _grouped(own, (2,), " "),
            "00" + _grouped(digits, (2, 3, 3, 4), ":"), re.sub(r"[^0-9]+", "-", home.strip("()")),
            "00" + _grouped(digits, (2, 3, 3, 4), " "))[spelling]


def rewritten(text: str, spans: list[tuple[int, int, int]], spelling: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its ip, card and phone spans in another spelling, and the spans there. The last two
    spellings make no entities of the digits: a list of small numbers, and a date with a time."""
    out, moved, at = [], [], 0
    size = 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        piece = _spelled(kind, text[a:b], spelling)
        lost = piece is None
        if lost:
            digits = "".join(_DIGITS.findall(text[a:b]))
            piece = (_grouped(digits, (2, 1, 3, 1, 2, 3), " ") if spelling == SPELLINGS - 1 else
                     f"20{digits[:2]}-0{digits[2:3]}-1{digits[3:4]} 1{digits[4:5]}:{digits[5:7]}")
        out += [text[at:a], piece]
        size += a - at
        if not lost:
            moved.append((kind, size, size + len(piece)))
        size += len(piece)
        at = b
    return "".join(out) + text[at:], moved


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights ``(type, feature)`` from at most ``max_docs`` different texts that hold digits or ``@``, those
    with the smallest text hash. The sample's bound does not depend on the corpus; a sample without
    base spans gives a model that finds nothing. Where the card pattern takes numbers that stand side by side
    as one too long, the base says nothing of either, and the run does not train. Runs of up to 60 tokens train, and texts of fewer than
    4,000 characters (bounds on the work of one step)."""
    hinted = docs.select("text").where(F.col("text").rlike("[0-9]{3}") | F.col("text").contains("@"))
    short = hinted.where(F.length("text") < 4000)
    keyed = short.select(*text_key(), "text")
    chosen = frozen(keyed.select("_t1", "_t2").distinct().orderBy("_t1", "_t2").limit(max_docs))
    found = keyed.join(broadcast_counted(chosen, chosen.count()), ["_t1", "_t2"]).distinct()
    texts = [r["text"] for r in sorted(found.collect())]
    examples = []
    for text in texts:
        base = base_spans(text)
        examples.append((text, base))
        if any(k >= 1 for k, _, _ in base):
            examples += [rewritten(text, base, k) for k in range(SPELLINGS)]
    data = []
    for text, base in examples:
        spans = {(a, b): k for k, a, b in base}
        vague = [m.span() for m in _CARD.finditer(text) if len(_DIGITS.findall(m.group())) > MAX_DIGITS]
        for run in windows(text):
            if any(a < run[-1][1] and run[0][0] < b for a, b in vague):
                continue
            rows = candidates(text, run)
            gold = {(i, j): spans[run[i][0], run[j][1]] for row in rows for i, j, _ in row
                    if (run[i][0], run[j][1]) in spans}
            if len(run) <= 60 and any(rows):
                data.append((rows, gold))
    weights = np.zeros((N_TYPES, N_FEATURES))
    weights[:, 0] = -1.0
    squares = np.full_like(weights, 1e-6)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for at in order.permutation(len(data)):
            grad = _log_likelihood_gradient(*data[at], weights) - DECAY * weights
            squares += grad * grad
            weights += RATE * grad / np.sqrt(squares)
    return weights if any(g for _, g in data) else np.full((N_TYPES, N_FEATURES), -1.0)


def added_spans(text: str, base: list[tuple[int, int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of the best segmentations that score above ``MARGIN`` and touch no base span."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
    out = []
    for run in windows(text):
        for i, j, kind, margin in best_segments(candidates(text, run), weights):
            a, b = run[i][0], run[j][1]
            k = int(np.searchsorted(starts, b))          # base spans that begin before b
            if margin > MARGIN and not (k and reach[k - 1] > a):
                out.append((kind, a, b))
    return out


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """Personal data in every whole text of ``docs(doc_id, text)``.

    Returns doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (base and
    added, ``kind:start:end`` in code points, by kind, then start), n_added. Null and empty texts have
    no spans; repeated rows are searched each; an empty table gives an empty result; other columns
    are not read. ``weights``: a trained model; by default one is trained on the documents.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs) if weights is None else weights)

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                data, offs = utf8(part.column(1))
                hot = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))
                some = np.searchsorted(hot, offs)
                found, texts = [], part.column(1)
                for i in range(part.num_rows):
                    if some[i] == some[i + 1]:
                        found.append(((0, 0, 0, 0), "", "", 0))
                        continue
                    text = texts[i].as_py()
                    base = base_spans(text)
                    more = added_spans(text, base, model.value)
                    counts = tuple(sum(k == kind for k, _, _ in base) for kind in range(N_TYPES))
                    found.append((counts, _listed(base), _listed(base + more), len(more)))
                cols = [part.column(0)] + [pa.array([f[0][k] for f in found], pa.int64()) for k in range(N_TYPES)]
                cols += [pa.array([hashlib.sha256(f[1].encode()).hexdigest() for f in found], pa.string()),
                         pa.array([f[2] for f in found], pa.string()), pa.array([f[3] for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, _NAMES)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
             "spans string, n_added bigint")


_NAMES = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
