import hashlib
import re
import zlib

import pytest

from toposcope.llm import prefix_trie
from toposcope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, c bigint, d string, name string, m int"


def brute(rows):
    """The trie by dictionaries of whole prefixes; ``rows``: (conv_id, turn, role, text), no ties in turn."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    members = {}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(seqs[c]) + 1):
            members.setdefault(seqs[c][:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) if p in children else 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in children.get(p, []))
    out = set()
    for p, own_members in members.items():
        ends = ",".join(map(str, sorted(c for c in own_members if seqs[c] == p)))
        out.add((min(own_members), len(p), min(members[p[:-1]]) if p else None, len(own_members), len(children.get(p, [])),
                 leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(df, rows):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA).repartition(5)


def test_whole_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(QUERIES["op13_prefix_trie"](spark, SF), rows)


def test_shared_prefixes(spark):
    rows = []
    for c in range(90):
        n = [1, 2, 3, 5, 8, 13, 37][c % 7]
        for t in range(n):
            text = f"turn {t} said" if t < 4 + c % 5 or c % 2 else f"turn {t} of {c % 3} here"
            rows.append((c, t, "user" if t % 2 else None, text))
    rows += [(200, t, "user", f"turn {t} said") for t in range(70)] + [(220, t, "user", f"turn {t} said") for t in range(68)]
    rows += [(-5, 1, "a", "x"), (-5, None, "a", "first"), (None, 1, "a", "b"), (-40, 3, None, None), (1000001, 9, "r", "alone")]
    check(prefix_trie.trie(frame(spark, rows)), rows)


def test_turnless_and_empty(spark):
    assert prefix_trie.trie(frame(spark, [])).collect() == []
    # 41's base 40 is absent and its one turn falls into its first h
    lone = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(lone, 0, "user", "gone")]
    check(prefix_trie.trie(frame(spark, rows)), rows)
    check(prefix_trie.trie(frame(spark, rows + [(lone + 40, 0, "user", "gone")])), rows + [(lone + 40, 0, "user", "gone")])


def test_ties_and_repeated_rows(spark):
    rows = [(40, 1, "user", "same"), (40, 1, "user", "same"), (40, 1, "user", "other"), (40, None, "a", "lead")]
    one = sorted(map(tuple, prefix_trie.trie(frame(spark, rows)).collect()))
    two = sorted(map(tuple, prefix_trie.trie(frame(spark, rows[::-1]).repartition(2)).collect()))
    assert one == two and max(r[1] for r in one) == 4


def test_many_equal_conversations(spark):
    rows = [(20 * c, t, "user", f"copy {t}") for c in range(500) for t in range(3)]
    rows += [(20 * c, 3, "user", f"own {c % 50}") for c in range(0, 500, 3)]
    check(prefix_trie.trie(frame(spark, rows)), rows)


@pytest.mark.parametrize("n", [1, 2, 5, 16])
def test_lengths_around_powers_of_two(spark, n):
    rows = [(20 * c, t, "u", f"w{t} {c if t == n - 1 - c % 3 else ''}") for c in range(4) for t in range(n)]
    check(prefix_trie.trie(frame(spark, rows)), rows)
