import random
import zlib
from collections import defaultdict

import pytest

from toposcope.llm import sharding as S


def greedy(sizes, cap):
    n, at = 1, 0
    for s in sizes:
        if s > cap:
            return None
        if at + s > cap:
            n, at = n + 1, 0
        at += s
    return n


def slow_capacity(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        n = greedy(sizes, mid)
        lo, hi = (lo, mid) if n is not None and n <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("n,shards,blocks,most", [(300, 7, 16, 60), (900, 40, 64, 1000), (50, 40, 8, 9), (5, 8, 4, 30),
                                                  (400, 5, 4096, 5)])
def test_cuts_are_minimax(spark, n, shards, blocks, most):
    rng = random.Random(n)
    sizes = [rng.randint(1, most) if rng.random() < .97 else most * 12 for _ in range(n)]
    rows, at = [], 0
    for s in sizes:
        rows.append((at, s))
        at += s
    cuts = S.minimax_cuts(spark.createDataFrame(rows, "start bigint, size bigint"), shards, blocks)
    ends = {a + s for a, s in rows}
    assert len(cuts) == shards and cuts[-1] == at and set(cuts) <= ends
    shard_sizes = [b - a for a, b in zip([0] + cuts, cuts)]
    assert max(shard_sizes) == slow_capacity(sizes, shards)


def test_shards(docs, rows):
    got = S.shard(docs).collect()
    assert len(got) == len(rows)
    for r in rows:
        pass
    texts = defaultdict(list)
    for r in rows:
        texts[r["doc_id"]].append(r["text"] or "")
    slots, keys = defaultdict(list), defaultdict(set)
    for r in got:
        assert (r["size"], r["text_crc32"]) in {(len(t.encode()) + 16, zlib.crc32(t.encode())) for t in texts[r["doc_id"]]}
        assert 0 <= r["shard"] < 40
        slots[r["shard"]].append(r["slot"])
        keys[r["group_key"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in keys.values())
    assert len(keys) == len({r["text"] or "" for r in rows})


def test_giant_groups_stand_alone(spark):
    rows = [(i, "giant text " * 20) for i in range(300)] + [(1000 + i, f"small text {i} " * 3) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = S.shard(df, 10).groupBy("shard").sum("size").collect()
    sizes = sorted(r[1] for r in got)
    assert len(sizes) == 10 and sizes[-2] < 1.1 * sum(sizes[:-1]) / 9


def test_empty(empty):
    assert S.shard(empty).collect() == []
