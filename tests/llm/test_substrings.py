import hashlib
import re
from collections import Counter

from toposcope.llm import substrings as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(rows, length):
    texts = [WORD.findall(r["text"] or "") for r in rows]
    seen = Counter(tuple(w[i:i + length]) for w in texts for i in range(len(w) - length + 1))
    out = []
    for r, w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i:i + length])] > 1:
                gone |= set(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r["doc_id"], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_matches_brute_force(docs, rows):
    got = Counter(tuple(r) for r in S.dedup(docs).collect())
    assert got == slow(rows, 35)


def test_short_windows_and_shuffle_join(docs, rows, monkeypatch):
    monkeypatch.setattr(S, "broadcast_counted", lambda df, rows: df.hint("merge"))
    got = Counter(tuple(r) for r in S.dedup(docs, length=12, gram=5).collect())
    assert got == slow(rows, 12)


def test_overlapping_contexts(spark):
    p = [f"p{i}" for i in range(80)]
    rows = [(1, " ".join(p)), (2, " ".join(p)), (3, " ".join(p[10:60] + ["x"])), (4, " ".join(["y"] + p[30:64])),
            (5, " ".join(["z"] + p[30:65] + p[30:65])), (6, " ".join(p[:34])), (7, "a " * 100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(tuple(r) for r in S.dedup(df).collect())
    assert got == slow(df.collect(), 35)


def test_kept_text(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["kept_text"] for r in S.dedup(df, with_text=True).collect()} == {1: "a b", 2: ""}


def test_empty(empty):
    assert S.dedup(empty).collect() == []
