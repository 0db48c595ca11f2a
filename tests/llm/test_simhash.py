import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from toposcope.llm import simhash as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(pairs):
    near = defaultdict(list)
    fps = sorted({f for _, f in pairs})
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                near[a].append(b)
                near[b].append(a)
    low = {}
    for i, f in pairs:
        if i is not None:
            low[f] = min(low.get(f, i), i)
    out, seen = {}, set()
    for f in fps:
        if f not in seen:
            todo, comp = [f], {f}
            while todo:
                for g in near[todo.pop()]:
                    if g not in comp:
                        comp.add(g)
                        todo.append(g)
            seen |= comp
            ids = [low[g] for g in comp if g in low]
            for g in comp:
                out[g] = min(ids) if ids else None
    return out


def test_near_duplicates_match_brute_force(docs, rows):
    pairs = [(r["doc_id"], slow_fingerprint(r["text"])) for r in rows]
    comp = slow_components(pairs)
    want = Counter((i, f"{f:016x}", comp[f]) for i, f in pairs)
    got = Counter(tuple(r) for r in S.near_duplicates(docs).collect())
    assert got == want


def test_bucket_links_connect_exactly_the_near():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    for n in (2, 64, 65, 300):
        fps = set()
        while len(fps) < n:
            f = int(rng.choice(seeds))
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                f ^= 1 << int(b)
            fps.add(f)
        fps = np.array(sorted(fps), np.uint64)
        u, v = S.bucket_links(fps, np.array([0, n]))
        comp = slow_components([(i, int(f)) for i, f in enumerate(fps)])
        parent = list(range(n))

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for a, b in zip(u, v):
            assert (int(fps[a]) ^ int(fps[b])).bit_count() <= 2
            a, b = sorted((top(int(a)), top(int(b))))
            parent[b] = a
        assert [top(i) for i in range(n)] == [comp[int(f)] for f in fps]


def test_hot_buckets_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = 0x0123456789ABCDEF
    fps = {base}
    for _ in range(400):
        f = base
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            f ^= 1 << int(b)
        fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    from toposcope.llm.components import components
    got = {r["node"]: r["root"] for r in components(S.links(df, hot=4)).collect()}
    comp = slow_components([(f - (1 << 64) if f >> 63 else f, f) for f in fps])
    for f in fps:
        s = f - (1 << 64) if f >> 63 else f
        assert got.get(s, s) == comp[f]


def test_long_chain_is_one_component(spark):
    from toposcope.llm.components import components
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_empty(empty):
    assert S.near_duplicates(empty).collect() == []
