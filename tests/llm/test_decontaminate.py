import pytest

from toposcope.llm import decontaminate as D

ITEM = "A train leaves Paris at 12 km per hour. How many minutes does Anna need to reach the town with 35 stops?"


def run(spark, texts, items=((1, ITEM),), **more):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    b = spark.createDataFrame(list(items), "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]): r for r in D.contaminated(d, b, **more).collect()}


def test_copies_and_new_parameters_are_caught(spark):
    changed = "lead words " + ITEM.replace("12", "77").replace("35", "8").replace("km", "miles").replace("Anna", "Bob")
    torn = ITEM.replace("Anna need", "Anna need").replace("12", "5")
    other = "Some text about other things entirely, with 12 km per hour and nothing else to share with the item."
    got = run(spark, ["x " + ITEM + " y", changed, torn.upper(), other, None, "", "x " * 5000 + ITEM])
    assert set(got) == {(0, 1), (1, 1), (6, 1)}
    assert got[0, 1]["n_changed"] == 0 and got[1, 1]["n_changed"] >= 4


def test_slots_must_agree(spark):
    item = "first 5 apples and then 5 more apples make how many apples in the whole big basket of Anna here"
    sound = item.replace("5", "9")
    torn = "first 5 apples and then 9 more apples make how many apples in the whole big basket of Anna here"
    got = run(spark, [sound, torn], [(1, item)])
    assert set(got) == {(0, 1)} and got[0, 1]["share"] == 1.0


def test_blocks_and_short_items(spark):
    items = [(1, ITEM), (1, ITEM), (2, ITEM), (3, "only four short words"), (4, "two words"), (5, None)]
    items += [(6, "What?"), (7, "17 * 3"), (8, "Paris!")]
    texts = [ITEM, "here only four short words stand", "Two words.", "these are two words", "what", "17*3", "18 * 3",
             "Paris", "17", "two", " ? "]
    one = run(spark, texts, items)
    many = run(spark, texts, items, block_hashes=3)
    assert set(one) == {(0, 1), (0, 2), (1, 3), (2, 4), (4, 6), (5, 7), (7, 8)} and one == many
    assert {one[k]["share"] for k in one} == {1.0} and one[2, 4]["n_changed"] == 0
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    assert {r["doc_id"] for r in D.decontaminated(d, b).collect()} == {3, 6, 8, 9, 10}


def test_items_of_few_literal_tokens(spark):
    sums = "Compute 17 * 23 + 4 - 9"
    many = "Compute 17 * 23 + 4 - 9 and add 81 78 12 44 95 61 33 27"
    names = "Ask Anna Bob Carl Dora Emil Fritz Gina and Hans"
    texts = ["so then compute 17 * 23 + 4 - 9 now", "compute 18 * 23 + 4 - 9", f"see {many}.",
             f"see {many}".replace("95", "96"), names, "Ask Anna Bob Carl Dora Emil Fritz Gina or Rosa"]
    got = run(spark, texts, [(1, sums), (2, many), (3, names)])
    assert set(got) >= {(0, 1), (2, 1), (2, 2), (3, 1), (4, 3)}
    assert not {(1, 1), (0, 2), (1, 2)} & set(got)
    assert got[0, 1]["share"] == got[2, 2]["share"] == got[4, 3]["share"] == 1.0


def test_other_case_and_first_words(spark):
    short = "Mary has 7 apples left"
    texts = [ITEM.upper(), "lead " + ITEM.title(), "lead words Mary has 7 apples left", "asked Mary has 9 apples left",
             "asked Rosa has 7 apples left", ITEM.upper().replace("TRAIN", "PLANE")]
    got = run(spark, texts, [(1, ITEM), (2, short)])
    assert set(got) == {(0, 1), (1, 1), (2, 2), (3, 2)}
    assert got[0, 1]["n_changed"] == got[2, 2]["n_changed"] == 0 and got[3, 2]["n_changed"] == 1


def brute(text, items, window):
    """Shares by plain string templates, for texts without slots."""
    import re
    tok = lambda t: re.findall(r"[a-zà-öø-þß-ÿ0-9]+", t.lower())
    words = tok(text)
    have = {tuple(words[i:i + window]) for i in range(len(words) - window + 1)}
    out = {}
    for i, t in items:
        w = tok(t)
        grams = [tuple(w[k:k + window]) for k in range(len(w) - window + 1)]
        out[i] = sum(g in have for g in grams) / len(grams)
    return out


def test_planted_passages_of_the_table(spark, docs, rows):
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, b).collect()}
    want = set()
    for r in rows:
        for i, share in brute(r["text"] or "", items, 8).items():
            if share >= 0.5:
                want.add((r["doc_id"], i))
    assert got == want and want


@pytest.mark.parametrize("which", [0, 1])
def test_empty(spark, empty, which):
    b = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    if which:
        assert D.contaminated(empty, b).collect() == []
    else:
        assert D.contaminated(spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string"), b.where("false")).collect() == []
