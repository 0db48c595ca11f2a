import random
from collections import Counter, defaultdict

from toposcope.llm import lines as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def slow(rows, lengths=L.LENGTHS):
    def allowed(n):
        return sum(n >= x for x in lengths)

    first, copies = {}, Counter()
    for r in rows:
        for n, line in enumerate((r["text"] or "").split("\n")):
            if line.strip("\x20\x09\x0a\x0b\x0c\x0d"):
                at = (r["doc_id"] is not None, r["doc_id"] or 0, n)
                first[line] = min(first.get(line, at), at)
                copies[line] += 1
    near = defaultdict(list)
    by_len = defaultdict(list)
    for x in first:
        by_len[len(x)].append(x)
    for x in first:
        for d in range(allowed(len(x)) + 1):
            for y in by_len[len(x) + d]:
                if x != y and (d or x < y) and sum((Counter(x) - Counter(y)).values()) <= allowed(len(x)):
                    if distance(x, y) <= allowed(len(x)):
                        near[x].append(y)
                        near[y].append(x)
    out, top = [], {}
    for x in first:
        if x not in top:
            comp, todo = {x}, [x]
            while todo:
                for y in near[todo.pop()]:
                    if y not in comp:
                        comp.add(y)
                        todo.append(y)
            best = min(first[y] for y in comp)
            top.update({y: best for y in comp})
    for x, (has, i, n) in first.items():
        t = top[x]
        out.append((i if has else None, n, copies[x], t[1] if t[0] else None, t[2], len(near[x])))
    return Counter(out)


def test_matches_brute_force(docs, rows):
    assert Counter(tuple(r) for r in L.line_classes(docs).collect()) == slow(rows)


def test_random_edits(spark):
    rng = random.Random(4)
    lines = []
    for _ in range(40):
        base = [rng.choice("abcdeß漢😀 ") for _ in range(rng.randint(10, 60))]
        for _ in range(5):
            x = base[:]
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(x))
                how = rng.randrange(3)
                if how == 0:
                    x[k] = rng.choice("abcdeß漢😀 ")
                elif how == 1:
                    x.insert(k, rng.choice("abc"))
                elif len(x) > 2:
                    del x[k]
            lines.append("".join(x))
    rows = [(i, x) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = slow(df.collect())
    assert sum(k[5] * n for k, n in want.items()) > 50
    assert Counter(tuple(r) for r in L.line_classes(df).collect()) == want


def test_template_lines(spark):
    """Lines of a template share most segments: candidates stay in proportion, near pairs are found."""
    rng = random.Random(5)
    text = "The customer order was received and confirmed, reference number "
    numbers = ["".join(rng.choice("0123456789") for _ in range(12)) for _ in range(20000)]
    changed = [x[:5] + "xy"[i % 2] + x[6:] for i, x in enumerate(numbers[:300])]
    df = spark.createDataFrame([(i, text + x) for i, x in enumerate(numbers + changed)], "doc_id bigint, text string")
    both = L.candidate_pairs(df).select("line_a", "line_b").collect()
    assert len(both) < 20 * len(numbers)
    found = {frozenset((r["line_a"], r["line_b"])) for r in both}
    assert all(frozenset((text + a, text + b)) in found for a, b in zip(numbers, changed))


SHORT = (12, 16, 24, 36, 48, 60)


def edited(rng, base, most):
    x = base[:]
    for _ in range(rng.randint(0, most)):
        k = rng.randrange(len(x))
        if rng.random() < .5:
            x[k] = rng.choice("abcd😀")
        elif rng.random() < .5:
            x.insert(k, rng.choice("abc"))
        else:
            del x[k]
    return "".join(x)


def test_allowance_grows_with_length(spark, monkeypatch):
    """Up to six edits, at lengths around the steps, also with every key dealt again."""
    rng = random.Random(7)
    lines = []
    for n in (13, 17, 23, 26, 35, 38, 47, 50, 59, 64, 80):
        base = [rng.choice("abß漢😀 xyz") for _ in range(n)]
        lines += [edited(rng, base, 8) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    want = slow(df.collect(), SHORT)
    assert sum(k[5] * n for k, n in want.items()) > 1000
    assert Counter(tuple(r) for r in L.line_classes(df, SHORT).collect()) == want
    monkeypatch.setattr(L.candidate_pairs, "__defaults__", (L.LENGTHS, 0))
    assert Counter(tuple(r) for r in L.line_classes(df, SHORT).collect()) == want


def test_long_line_with_a_word_changed(spark):
    line = " ".join(f"word{k}" for k in range(45))
    far = line.replace("word7 ", "thing7 ")
    df = spark.createDataFrame([(1, line), (2, line.replace("word7 ", "term7 ")), (3, far)], "doc_id bigint, text string")
    assert {r["doc_id"]: (r["class_doc_id"], r["n_links"]) for r in L.line_classes(df).collect()} == {
        1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_crowded_keys_lose_no_pair(spark, monkeypatch):
    """With every key dealt again the links are those of brute force."""
    rng = random.Random(6)
    lines = []
    for n in (16, 24, 33, 40):
        base = [rng.choice("abß漢😀 ") for _ in range(n)]
        for _ in range(60):
            x = base[:]
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(x))
                if rng.random() < .5:
                    x[k] = rng.choice("abcd😀")
                elif rng.random() < .5:
                    x.insert(k, rng.choice("abc"))
                else:
                    del x[k]
            lines.append("".join(x))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    want = slow(df.collect())
    assert sum(k[5] * n for k, n in want.items()) > 200
    monkeypatch.setattr(L.candidate_pairs, "__defaults__", (L.LENGTHS, 0))
    assert Counter(tuple(r) for r in L.line_classes(df).collect()) == want


def test_distance(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(1, 4)):
            k = rng.randint(0, len(b))
            if rng.random() < .5:
                b.insert(k, rng.choice("ab"))
            elif b:
                del b[min(k, len(b) - 1)]
        b = "".join(b)
        if a != b and abs(len(a) - len(b)) <= 2:
            rows.append((a, b) if len(a) <= len(b) else (b, a))
    df = spark.createDataFrame(rows, "line_a string, line_b string")
    for r in L.distances(df, 2).collect():
        assert r["distance"] == min(3, distance(r["line_a"], r["line_b"]))


def test_long_lines_with_many_letters(spark):
    """Letter counts beyond 127 and 255 fill and wrap their byte of the signature."""
    base = "setaonir" * 40
    lines = [base, base[:-1], base + "s", base + "sssxx", "s" * 300, "s" * 299 + "t", "r" * 200 + "x", "r" * 200]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    assert Counter(tuple(r) for r in L.line_classes(df).collect()) == slow(df.collect())


def test_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([(2, "a line that is long enough\nb"), (1, "a line that is long enougg\n\nb")],
                               "doc_id bigint, text string")
    assert {r["doc_id"]: r["kept_lines"] for r in L.dedup(df).collect()} == {1: [0, 2]}


def test_no_python(docs):
    plan = L.distances(L.all_lines(docs).selectExpr("line as line_a", "line as line_b"), 8)._jdf.queryExecution()
    assert "Python" not in plan.toString() and "Arrow" not in plan.toString()


def test_empty(empty):
    assert L.line_classes(empty).collect() == [] and L.dedup(empty).collect() == []
