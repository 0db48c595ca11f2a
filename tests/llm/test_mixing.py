import random
import re
from collections import Counter, defaultdict

from toposcope.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """By rounds over a sorted list."""
    total = share * sum(n for _, n in sizes)
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(sizes)}
    size, fixed = dict(sizes), {}
    while True:
        open_ = [s for s in weight if s not in fixed]
        rest, whole = total - sum(fixed.values()), sum(weight[s] for s in open_)
        want = {s: rest * weight[s] / whole for s in open_}
        above = [s for s in open_ if want[s] > most * size[s]]
        if not above:
            return fixed | want
        fixed |= {s: float(most * size[s]) for s in above}


def targets(spark, sizes, **more):
    df = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes], "_null boolean, _s string, source_size bigint")
    side, n = M.targets(df.repartition(3), **more)
    got = {None if r["_null"] else r["_s"]: r["target"] for r in side.collect()}
    assert len(got) == n == len(sizes)
    return got


def test_targets(spark):
    assert targets(spark, [("a", 100), ("b", 100), ("c", 100)]) == {"a": 200.0, "b": 500 / 3, "c": 250 / 3}
    got = targets(spark, [("a", 10), ("b", 10), ("c", 10), (None, 970)])
    assert got["a"] == 20 and got["b"] == 20 and got["c"] == 20 and got[None] == 1440
    assert targets(spark, [("a", 0), ("b", 8)]) == {"a": 0.0, "b": 12.0}
    assert targets(spark, [("a", 0), ("", 0)]) == {"a": 0.0, "": 0.0} and targets(spark, []) == {}
    assert targets(spark, [("a", 3), ("b", 5)], share=3.0) == {"a": 6.0, "b": 10.0}


def test_targets_of_many_sources(spark):
    rng = random.Random(3)
    sizes = sorted((f"host{i}", int(rng.paretovariate(0.7) * 10) if i % 9 else 0) for i in range(3000))
    assert targets(spark, sizes) == plain_targets(sizes)


def test_budgets_are_met(docs, rows):
    got = M.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter(
        (r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    ordered = sorted(sizes.items(), key=lambda x: (x[0] is None, x[0] or ""))
    plan = plain_targets(ordered)
    taken = Counter()
    by = defaultdict(list)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - plan[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        by[r["source"]].append(r)
    for s, t in plan.items():
        assert abs(taken[s] - t) < 1
        # in key order: full, then one part, then none of the last epoch
        part = [r["taken"] - (int(t) // max(sizes[s], 1)) * r["size"] for r in sorted(
            by[s], key=lambda r: (r["key"], r["doc_id"] if r["doc_id"] is not None else -1, r["size"])) if r["size"]]
        whole = [r["size"] for r in sorted(by[s], key=lambda r: (
            r["key"], r["doc_id"] if r["doc_id"] is not None else -1, r["size"])) if r["size"]]
        if sizes[s] and int(t) // sizes[s] < 2:
            k = next((i for i, (p, w) in enumerate(zip(part, whole)) if p != w), len(part))
            assert all(p == 0 for p in part[k + 1:])


def test_reruns_agree(spark, docs):
    a = Counter(tuple(r) for r in M.mix(docs).collect())
    b = Counter(tuple(r) for r in M.mix(docs.repartition(5)).collect())
    assert a == b


def test_empty(empty):
    assert M.mix(empty).collect() == []
