from collections import Counter, defaultdict

import corpus_pipeline as C
from toposcope.llm import decontaminate as D
from toposcope.llm import mixing as M
from toposcope.llm import quality as Q
from toposcope.llm import simhash as S

from .conftest import SF


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_by_their_operators(spark, docs):
    """Each stage keeps exactly the rows its operator's verdict keeps, with all columns."""
    now = docs
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns
        before, after = as_rows(now), as_rows(out)
        if name == "quality_rules":
            kept = {(r["doc_id"], r["source"], r["n_words"]) for r in Q.judge(now).collect() if r["kept"]}
            want = Counter({r: n for r, n in before.items()
                            if (r[0], r[3], len((r[1] or "").split())) in kept})
            assert sum(after.values()) == sum(1 for r in Q.judge(now).collect() if r["kept"])
            assert not after - want
        elif name == "simhash_dedup":
            comp = {r["component_id"] for r in S.near_duplicates(now).collect()}
            assert {r[0] for r in after} == comp and set(after.values()) == {1}
            assert not after - before
        elif name == "benchmark_decontamination":
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            bad = {r["doc_id"] for r in D.contaminated(now, items).collect()}
            assert bad and after == Counter({r: n for r, n in before.items() if r[0] not in bad})
        else:
            times = Counter()
            for r in M.mix(now).collect():
                times[r["doc_id"]] += r["passes"]
            got = Counter()
            for r, n in after.items():
                got[r[0]] += n
            assert got == +times
        now = spark.createDataFrame(out.collect(), out.schema)
    last = C.STAGES[-1][1](spark, now, SF).collect()
    assert len(last) == now.count()
    slots = defaultdict(list)
    for r in last:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_repeated_rows_and_nulls(spark, edge):
    """Edge rows go through every stage by itself; equal rows count as the operators count them."""
    two = edge.unionByName(edge)
    assert Q.accepted(two).count() == 2 * Q.accepted(edge).count()
    one = S.one_of_each(two)
    assert as_rows(one) == as_rows(S.one_of_each(edge))
    mixed = M.mixture(two)
    assert mixed.count() == sum(r["passes"] for r in M.mix(two).collect())
    items = spark.createDataFrame([(1, "first line here is long")], "item_id bigint, text string")
    left = D.decontaminated(two, items)
    assert left.count() == two.count() - 2


def test_empty(spark, empty):
    now = empty
    for _, stage in C.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == 0


def test_run(spark):
    assert C.run(spark, SF).count() > 0
    assert [k for k, _ in C.STAGES] and C.ORACLE_SQL is None


def test_rows_that_differ_in_other_columns_are_kept(spark):
    """Equal id, text and source but another lang: each row keeps its own values, and reruns agree."""
    from toposcope.llm import mixing, simhash
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "de", "s", 5), (1, "a b c", "de", "s", 5), (2, "d e", None, "s", 3),
            (3, "f g h i", "fr", "t", 7)]
    docs = spark.createDataFrame(rows, schema)
    mixed = [sorted(map(tuple, mixing.mixture(docs.repartition(p)).collect()), key=repr) for p in (1, 3)]
    assert mixed[0] == mixed[1]
    mine = [r for r in mixed[0] if r[0] == 1]
    kinds = {r[2] for r in mine}
    assert len(mine) < 2 or kinds == {"en", "de"}
    kept = simhash.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3]


def test_copies_are_dealt_over_the_rows(spark):
    from toposcope.llm import textbuf
    schema = "doc_id bigint, text string, lang string"
    docs = spark.createDataFrame([(1, "x", "a"), (1, "x", "a"), (1, "x", "b"), (1, "x", None), (2, "y", "c"), (3, "z", "d")], schema)
    keyed = docs.select("doc_id", *textbuf.text_key()).distinct()
    for n, want in ((4, {"a": 2, "b": 1, None: 1}), (8, {"a": 4, "b": 2, None: 2}), (9, None), (1, None)):
        times = keyed.where("doc_id < 3").selectExpr("doc_id", "_t1", "_t2", "if(doc_id = 1, 4, 1) as rows", f"if(doc_id = 1, {n}, 2) as n")
        got = [tuple(r) for r in textbuf.repeated(docs, times, ["doc_id"]).collect()]
        assert sum(r[0] == 1 for r in got) == n and sum(r[0] == 2 for r in got) == 2 and not any(r[0] == 3 for r in got)
        if want:
            assert {k: sum(r[2] == k for r in got if r[0] == 1) for k in want} == want


def test_broadcasts_are_decided_by_bytes(spark):
    from toposcope.llm import textbuf
    narrow = spark.range(1).selectExpr("id", "id as b")
    wide = narrow.selectExpr("id", "'x' as s", "'y' as t", *(f"id as c{i}" for i in range(10)))
    assert textbuf.fits_broadcast(narrow, 2_000_000) and not textbuf.fits_broadcast(wide, 2_000_000)
    assert textbuf.fits_broadcast(wide, 400_000) and not textbuf.fits_broadcast(narrow, 3_000_000)
