import random
import re

import numpy as np
import pytest

from toposcope.llm import minhash
from toposcope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {(a, b) for a, b in zip(words, words[1:])} if len(words) > 1 else {tuple(words)} - {()}


def brute(rows):
    """Components by an inverted index over exact sets; ``rows``: (doc_id, text)."""
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(shingles(t)), []).append(i)
    keys = [s for s in sets if s]
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = {}
    for k, s in enumerate(keys):
        common = {}
        for x in s:
            for j in index.get(x, ()):
                common[j] = common.get(j, 0) + 1
            index.setdefault(x, []).append(k)
        for j, both in common.items():
            if 100 * both >= 80 * (len(s) + len(keys[j]) - both):
                parent[find(k)] = find(j)
    low = {}
    for k, s in enumerate(keys):
        ids = [i for i in sets[s] if i is not None]
        if ids:
            low[find(k)] = min([low[find(k)], *ids] if find(k) in low else ids)
    place = {s: k for k, s in enumerate(keys)}
    out = []
    for i, t in rows:
        s = frozenset(shingles(t))
        c = low.get(find(place[s])) if s else i
        out.append((i, len(s), c, i is not None and i == c))
    return sorted(out, key=repr)


def check(df, rows):
    assert sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr) == brute(rows)


def test_whole_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op12_minhash"](spark, SF), rows)


def test_edges(spark, docs, rows, empty):
    check(minhash.near_duplicates(docs), [(r.doc_id, r.text) for r in rows])
    assert minhash.near_duplicates(empty).collect() == []


def test_links_near_the_threshold(spark):
    """Families whose members are edited more and more: chains, links just above and below 0.8."""
    rng, rows = random.Random(4), []
    for family in range(12):
        base = [f"f{family}w{rng.randrange(400)}" for _ in range(120)]
        for member in range(25):
            text = list(base)
            for at in rng.sample(range(120), rng.randrange(0, 14)):
                text[at] = f"e{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(text)))
            if member % 8 == 7:
                base = text
    check(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)), rows)


def test_crowded_bucket_in_cells(spark, monkeypatch):
    """One template with more members than a cell holds, most of them too far apart to link."""
    monkeypatch.setattr(minhash, "CELL", 16)
    rng, rows = random.Random(5), []
    base = [f"w{k}" for k in range(100)]
    for _ in range(120):
        text = list(base)
        for at in rng.sample(range(100), rng.choice([2, 4, 9, 12, 14])):
            text[at] = f"e{rng.randrange(10 ** 6)}"
        rows.append((len(rows), " ".join(text)))
    check(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), partners=1), rows)


def test_candidates_grow_with_the_members(spark, monkeypatch):
    """One template whose members share most buckets: a member is confirmed against few of the others."""
    rng, rows, asked = random.Random(6), [], []
    base = [f"w{k}" for k in range(100)]
    for member in range(160):
        text = list(base)
        for at in rng.sample(range(100), rng.choice([2, 3, 4])):
            text[at] = f"e{rng.randrange(10 ** 6)}"
        rows.append((member, " ".join(text)))
    confirmed = minhash._confirmed

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(minhash, "_confirmed", counted)
    check(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")), rows)
    assert sum(asked) <= 2 * len(rows)


def test_cells_hold_a_member_once(spark, monkeypatch):
    """One template, most of whose members link with no other: their buckets share a leader and become few."""
    rng, rows, placed = random.Random(7), [], []
    base = [f"w{k}" for k in range(100)]
    for member in range(160):
        text = list(base)
        for at in rng.sample(range(100), rng.choice([2, 3, 9, 12])):
            text[at] = f"e{rng.randrange(10 ** 6)}"
        rows.append((member, " ".join(text)))
    cells = minhash._cells

    def counted(*args):
        out = cells(*args)
        placed.append(out.count())
        return out

    monkeypatch.setattr(minhash, "_cells", counted)
    check(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")), rows)
    assert placed[0] <= 10 * len(rows)


def test_buckets_of_a_leader(spark):
    """Buckets 1 to 3 have the leader 1 and the same sets but one; 4 and 5 have little in common; 6 is done."""
    sets = {1: [1, 2, 3, 4], 2: [1, 2, 3, 5], 3: [1, 2, 4, 5], 4: [7, 8, 9], 5: [7, 10, 11], 6: [12, 13]}
    buckets = spark.createDataFrame([(k, n, v[0]) for k, v in sets.items() for n in v], "key bigint, node bigint, leader bigint")
    labels = spark.createDataFrame([(n, 12 if n > 11 else n) for n in range(1, 14)], "node bigint, root bigint")
    got = sorted(map(tuple, minhash._stars(buckets, labels).select("key", "node").collect()))
    assert got == sorted([(1, n) for n in range(1, 6)] + [(k, n) for k in (4, 5) for n in sets[k]])


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(2)
    for similarity in (0.8, 0.9):
        sets = []
        for _ in range(60):
            both = rng.integers(0, 2 ** 63, int(1000 * similarity), dtype=np.uint64)
            rest = rng.integers(0, 2 ** 63, 1000 - len(both), dtype=np.uint64)
            half = len(rest) // 2
            sets += [np.unique(np.concatenate([both, rest[:half]])), np.unique(np.concatenate([both, rest[half:]]))]
        bits = minhash.sketches(minhash.samples(sets))
        far = np.bitwise_count(bits[::2] ^ bits[1::2]).sum(axis=1)
        assert (far <= minhash.farthest()).all()
        n, k = minhash.SKETCH_BITS, minhash.BANDS * minhash.ROWS
        estimate = 1 + n / (4 * k) * np.log(1 - 2 * far / n)
        assert estimate.mean() == pytest.approx(similarity, abs=0.02)
        whole = minhash.set_sketches(sets)
        apart = [len(np.setxor1d(a, b)) for a, b in zip(sets[::2], sets[1::2])]
        assert (np.bitwise_count(whole[::2] ^ whole[1::2]).sum(axis=1) <= apart).all()
