import hashlib
import re
from collections import Counter

import numpy as np

from toposcope.llm import pii as P

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def slow_base(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            s = m.group()
            digits = re.sub(r"[^0-9]", "", s)
            if k == 1 and any(int(x) > 255 for x in s.split(".")):
                continue
            if k == 2:
                total = 0
                for i, c in enumerate(reversed(digits)):
                    d = int(c) * (1 + i % 2)
                    total += d - 9 if d > 9 else d
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_base_spans_match_the_patterns():
    rng = np.random.default_rng(2)
    pieces = ["a", "b.c", "@", ".", "1", "23", "255", "256", "-", "+", " ", "(", ")", "4111 1111 1111 1111",
              "4111111111111111", "x@y.z", "é", "%", "10.0.0.1", "+49 ", "\n", "_"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces, rng.integers(1, 14)))
        assert P.base_spans(text) == slow_base(text), text


def test_query_matches_brute_force(docs, rows):
    got = Counter(tuple(r)[:6] for r in P.find(docs).collect())
    want = Counter()
    for r in rows:
        spans = slow_base(r["text"] or "")
        line = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        n = [sum(k == x for k, _, _ in spans) for x in range(4)]
        want[r["doc_id"], *n, hashlib.sha256(line.encode()).hexdigest()] += 1
    assert got == want


def test_spans_hold_the_base_and_do_not_touch(docs, rows):
    texts = {(r["doc_id"], r["text"]) for r in rows}
    by_id = {i: t for i, t in texts}
    for r in P.find(docs).collect():
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert len(spans) == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_added"]
        if r["doc_id"] in by_id and spans:
            size = len(by_id[r["doc_id"]])
            assert all(0 <= int(a) < int(b) <= size for _, a, b in spans)


def all_segmentations(rows):
    """Scores by exhaustion: every choice of disjoint candidate segments."""
    def go(j):
        if j == 0:
            return [[]]
        out = list(go(j - 1))
        for i, _, on in rows[j - 1]:
            out += [s + [(i, j - 1, k, on)] for s in go(i) for k in range(P.N_TYPES)]
        return out
    return go(len(rows))


def test_viterbi_and_gradient_by_exhaustion():
    rng = np.random.default_rng(0)
    w = rng.normal(size=(P.N_TYPES, P.N_FEATURES))
    text = "call +1 (269) 555-3296 now x@y.de"
    run = P.windows(text)[0]
    rows = P.candidates(text, run)
    every = all_segmentations(rows)
    score = [sum(w[k, on].sum() for _, _, k, on in s) for s in every]
    best = max(score)
    assert np.isclose(sum(m for *_, m in P.best_segments(rows, w)), best)
    gold_seg = every[len(every) // 2]
    gold = {(i, j): k for i, j, k, _ in gold_seg}
    p = np.exp(score - np.logaddexp.reduce(score))
    want = np.zeros_like(w)
    for _, _, k, on in gold_seg:
        want[k, on] += 1
    for prob, seg in zip(p, every):
        for _, _, k, on in seg:
            want[k, on] -= prob
    assert np.allclose(P._log_likelihood_gradient(rows, gold, w), want)


def test_model_learns_the_base_and_more(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    w = P.train(df)
    text = "phone (269) 555-3296 and mail hsr.29@mail5.example.com then 44.161.181.40 ends"
    got = {(P.KINDS[k], text[a:b]) for k, a, b in P.added_spans(text, [], w)}
    assert ("email", "hsr.29@mail5.example.com") in got and ("ip", "44.161.181.40") in got
    assert ("phone", "(269) 555-3296") in got
    assert P.added_spans("plain words with 2 numbers and 17 more", [], w) == []


def test_long_spans_are_candidates():
    text = "call +33 1 23 45 67 89 or card 4111 1111 1111 1111 123 or 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 now"
    run, = P.windows(text)
    held = {text[run[i][0]:run[j][1]] for row in P.candidates(text, run) for i, j, _ in row}
    assert {"+33 1 23 45 67 89", "4111 1111 1111 1111 123", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9"} <= held
    assert max(on[-1] for row in P.candidates(text, run) for *_, on in row) < P.N_FEATURES


def test_words_and_lines_end_long_candidates():
    for text in ("q1 q2 q3 q4 q5 q6 q7 q8", "1 2 3\n4 5 6\n7 8 9"):
        rows = P.candidates(text, P.windows(text)[0])
        assert max(j - i + 1 for row in rows for i, j, _ in row) == 4


def test_long_spans_are_found(spark):
    w = P.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"))
    for kind, piece in (("phone", "01 23 45 67 89"), ("card", "4123 4567 8901 2345 678")):
        text = f"{kind} {piece} ends"
        assert {(P.KINDS[k], text[a:b]) for k, a, b in P.added_spans(text, [], w)} == {(kind, piece)}


def test_copies_train_once(spark, monkeypatch):
    texts = [f"text {i} mail a{i}@b.cd" for i in range(30)]
    first = spark.createDataFrame([(t,) for t in texts], "text string").orderBy(P.F.xxhash64("text")).first()[0]
    seen = []
    monkeypatch.setattr(P, "windows", lambda text: seen.append(text) or [])
    P.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts + [first] * 50)], "doc_id int, text string"), 10)
    assert len(seen) == len(set(seen)) == 10


def test_empty(empty):
    assert P.find(empty).collect() == []


def _digits(rng, n):
    return "".join(rng.choice(list("0123456789"), n))


def _card(rng, n=16):
    head = "4" + _digits(rng, n - 2)
    return next(head + c for c in "0123456789" if P.luhn(head + c))


def _fours(sep):
    return lambda rng: sep.join(re.findall(".{4}", _card(rng)))


def _octets(sep):
    return lambda rng: sep.join(map(str, rng.integers(1, 256, 4)))


UNSEEN = {                              # spellings that neither the patterns nor the training texts have
    "card": [_fours("/"), _fours("_"), _fours("  "), _fours(" - "),
             lambda r: (lambda s: f"{s[:4]}.{s[4:10]}.{s[10:]}")(_card(r, 15))],
    "phone": [lambda r: f"{_digits(r, 3)}/555/{_digits(r, 4)}", lambda r: f"{_digits(r, 3)} 555 {_digits(r, 4)}",
              lambda r: f"00{r.integers(20, 50)} {_digits(r, 3)} {_digits(r, 4)} {_digits(r, 2)}"],
    "ip": [_octets("-"), _octets(" . "), _octets("[.]")],
    "email": [lambda r: f"hein.{_digits(r, 2)} @ mail{_digits(r, 1)}.example.com",
              lambda r: f"hein.{_digits(r, 2)}@mail[.]example[.]com", lambda r: f"hein.{_digits(r, 2)}(at)mail.example.com"]}
DECOYS = [lambda r: f"{r.integers(1950, 2030)}-{r.integers(1, 13):02}-{r.integers(1, 29):02}",
          lambda r: f"{r.integers(1, 29):02}.{r.integers(1, 13):02}.{r.integers(1950, 2030)}",
          lambda r: f"{r.integers(0, 24)}:{_digits(r, 2)}:{_digits(r, 2)}", lambda r: f"{_digits(r, 3)},{_digits(r, 3)}.{_digits(r, 2)}",
          lambda r: "".join(r.choice(list("0123456789abcdef"), 40)), lambda r: _digits(r, r.integers(1, 6)),
          lambda r: f"v{r.integers(1, 9)}.{r.integers(0, 30)}.{r.integers(0, 9)}", lambda r: f"A{_digits(r, 8)}",
          lambda r: " ".join(_digits(r, r.integers(1, 4)) for _ in range(6))]


def test_spellings_that_were_never_seen(spark):
    """Planted into texts without digits: nine tenths of the spans are found whole, and little else."""
    w = P.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"))
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    clean = [r["text"].split(" ") for r in base if r["text"] and not re.search("[0-9@]", r["text"]) and len(r["text"]) < 3000]
    rng = np.random.default_rng(11)
    planted, rows = {}, []
    for kind, make in [(k, f) for k, fs in UNSEEN.items() for f in fs] + [(None, f) for f in DECOYS]:
        for _ in range(40):
            words = clean[rng.integers(len(clean))]
            at = rng.integers(0, len(words) + 1)
            lead, piece = "".join(w + " " for w in words[:at]), str(make(rng))
            if not P.base_spans(piece):
                planted[len(rows)] = kind and f"{kind}:{len(lead)}:{len(lead) + len(piece)}"
                rows.append((len(rows), lead + piece + "".join(" " + w for w in words[at:])))
    got = P.find(spark.createDataFrame(rows, "doc_id bigint, text string"), w).collect()
    hit = sum(planted[r["doc_id"]] in r["spans"].split(",") for r in got if planted[r["doc_id"]])
    added = sum(r["n_added"] for r in got)
    n = sum(v is not None for v in planted.values())
    print("recall", hit / n, "precision", hit / added)
    assert hit >= 0.9 * n and hit >= 0.95 * added


def test_two_cards_side_by_side(spark):
    """The pattern takes both numbers as one and drops them; the field finds each."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = P.find(docs).where("n_added > 0").join(docs, "doc_id").collect()
    assert found
    for r in found:
        for kind, a, b in (s.split(":") for s in r["spans"].split(",")):
            if kind == "card":
                assert P.luhn("".join(re.findall("[0-9]", r["text"][int(a):int(b)])))
