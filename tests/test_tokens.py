"""Tokenisation: hand fixture and a plain-Python twin of the cleaning rules."""

import re
import string

from pyspark.sql import functions as F

from toposcope.functions import text as T
from toposcope.operators import tokens as P

EDGES = "don't foo_bar x² ½a café İstanbul 東京 a1 ١٢ _x '' ab-cd a+b [tag] a´b naïve Ab AB a"
EXPECTED = ["½a", "café", "i̇stanbul", "東京", "ab", "cd", "tag", "naïve", "ab", "ab"]


def py_clean(text: str) -> list[str]:
    """Plain-Python statement of P9 (word runs, drop punctuation / digit tokens, lower, len > 1)."""
    toks = re.findall(r"[\w']+", text)
    toks = [w.lower() for w in toks if not any(c in string.punctuation for c in w)]
    toks = [w for w in toks if not any(c.isdigit() for c in w)]
    return [w for w in toks if len(w) > 1]


def test_hand_fixture(spark):
    df = spark.createDataFrame([(1, EDGES)], "doc_id long, text string")
    got = P.clean_token_arrays(df).first()["words"]
    assert got == EXPECTED
    assert py_clean(EDGES) == EXPECTED


def test_fused_equals_stepwise(spark):
    texts = [EDGES, "a_b c'd e1f ²x x² ⑤z abc", "Ⅻ roman ⅻ and ¼ quarter", "", None,
             "tab\there nbsp em", "ÉCOLE École ß straße ΣΊΣΥΦΟΣ"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a = df.select("doc_id", T.clean_token_array(F.col("text")).alias("w")).orderBy("doc_id").collect()
    b = df.select("doc_id", T.clean_token_array_stepwise(F.col("text")).alias("w")).orderBy("doc_id").collect()
    assert [r.w for r in a] == [r.w for r in b]
    for r, t in zip(a, texts):
        if t:
            assert r.w == py_clean(t)


def test_whitespace_split_matches_python(spark):
    texts = ["a  b\tc\nd", " x y　z ", "\x1c1\x1d2\x1e3\x1f4\x855", " lead trail "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = df.select("doc_id", T.whitespace_tokens(F.col("text")).alias("w")).orderBy("doc_id").collect()
    assert [r.w for r in got] == [t.split() for t in texts]


def test_vectorizer_tokens(spark):
    df = spark.createDataFrame([(0, "A bb C_d 1x Ab")], "doc_id long, text string")
    got = df.select(T.vectorizer_tokens(F.col("text")).alias("w")).first().w
    assert got == re.findall(r"(?u)\b\w\w+\b", "A bb C_d 1x Ab".lower())


def test_digit_rule_matches_isdigit():
    import unicodedata
    body = T.digit_pattern()[len("[\\p{Nd}"):-1]
    covered = set()
    for a, b in re.findall(r"\\x\{([0-9A-F]+)\}(?:-\\x\{([0-9A-F]+)\})?", body):
        lo = int(a, 16)
        hi = int(b, 16) if b else lo
        covered.update(range(lo, hi + 1))
    expected = {c for c in range(0x110000) if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"}
    assert covered == expected
    assert not "½".isdigit() and 0xBD not in covered


def test_strip_subword_marks(spark):
    df = spark.createDataFrame([("un@@ believ@@ able thing@@",)], "t string")
    got = df.select(T.strip_subword_marks(F.col("t")).alias("o")).first().o
    assert got == "unbelievable thing"
