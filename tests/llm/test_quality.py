import hashlib
import re
from collections import Counter, defaultdict

from toposcope.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(rows, max_docs, min_left):
    texts, out = defaultdict(set), []
    lines_of = []
    for r in rows:
        lines = Counter()
        for line in (r["text"] or "").split("\n"):
            w = WORD.findall(line)
            if w:
                norm = "".join(c.lower() if "A" <= c <= "Z" else c for c in " ".join(w))
                lines[int(hashlib.md5(norm.encode()).hexdigest()[:15], 16)] += len(w)
        for h in lines:
            texts[r["source"], h].add(r["text"])
        lines_of.append(lines)
    often = {k for k, t in texts.items() if len(t) > max_docs}
    for r, lines in zip(rows, lines_of):
        text = r["text"] or ""
        w = WORD.findall(text)
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        c = Counter(grams)
        rep = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(3)}
        raw = [x for x in text.split("\n") if WORD.search(x)]
        base = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        lost = [h for h in lines if (r["source"], h) in often]
        left = len(w) - sum(lines[h] for h in lost)
        out.append((r["doc_id"], r["source"], len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"),
                    len(raw) - len(set(raw)), len(rep), base, not base and left >= min_left * len(w), len(lost), left))
    return Counter(out)


def test_matches_brute_force(docs, rows):
    for max_docs, min_left in ((20, 0.2), (1.5, 0.7)):
        got = Counter(tuple(r) for r in Q.judge(docs, max_docs=max_docs, min_left=min_left).collect())
        assert got == slow(rows, max_docs, min_left)


def test_boilerplate_is_depleted_but_copies_are_not(spark):
    body = [" ".join(f"b{d}w{k}" for k in range(60)) for d in range(40)]
    nav = " ".join(f"nav{k}" for k in range(400))
    rows = [(d, f"{body[d]}\n{nav}", "one") for d in range(40)]                  # own words: 60 of 460
    rows += [(100 + d, f"{body[0]} copy\n{body[1]} copy\n{body[2]} copy", "two") for d in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["kept"] for r in Q.judge(df).collect()}
    assert not any(got[d] for d in range(40)) and all(got[100 + d] for d in range(40))


def test_boilerplate_that_stands_together(spark):
    """Header, navigation and footer lines always in one company; a large group of copies beside them."""
    shared = [" ".join(f"s{i}w{k}" for k in range(20)) for i in range(5)]
    rows = [(d, "\n".join(shared + [" ".join(f"own{d}w{k}" for k in range(15))]), "one") for d in range(2000)]
    rows += [(10000 + d, "\n".join(x + " copied" for x in shared), "one") for d in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = Counter((r["doc_id"] >= 10000, r["n_frequent_lines"], r["words_left"], r["kept"]) for r in Q.judge(df).collect())
    assert got == {(False, 5, 15, False): 2000, (True, 0, 105, True): 2000}


def test_limit_is_exact(spark):
    """21 distinct texts are over a limit of 20; 20 and their copies are not; hosts are counted apart."""
    line = " ".join(f"w{k}" for k in range(60))
    rows = [(d, f"{line}\nown {d}", s) for s, n in (("a", 21), ("b", 20), (None, 21)) for d in range(n)]
    rows += [(100 + d, f"{line}\nown 3", "b") for d in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {(r["source"], r["n_frequent_lines"], r["kept"]) for r in Q.judge(df).collect()}
    assert got == {("a", 1, False), ("b", 0, True), (None, 1, False)}


def test_cleaned_texts(spark, docs, rows):
    for max_docs in (20, 1.5):
        got = Q.cleaned(docs, max_docs)
        assert got.columns == docs.columns
        words = Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in got.collect())
        judged = Q.judge(docs, max_docs=max_docs).collect()
        assert words == Counter((r["doc_id"], r["source"], r["words_left"]) for r in judged)
    assert any(r["n_frequent_lines"] for r in judged)
    rows = [(d, f"\n Own line {d}\nNAV  a\tÄ\n\nnav a Ä\nend {d}", s) for d in range(30) for s in ("one", None)]
    rows += [(99, "nav a Ä\n", "two"), (98, None, "one")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = [(d, t if s == "two" or t is None else f"\n Own line {d}\n\nend {d}", s) for d, t, s in rows]
    assert Counter(tuple(r) for r in Q.cleaned(df).collect()) == Counter(want)


def test_empty(empty):
    assert Q.judge(empty).collect() == []


def test_cleaned_empty(empty):
    assert Q.cleaned(empty).collect() == []
