import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "kept boolean, fp bigint, h bigint, line string, _t1 string, shard int, size string, spans string")

LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(30000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
EDGE = [
    (None, "a null id with a few words in it", "en", "src1"),
    (None, None, None, None),
    (900001, None, "en", "src1"),
    (900002, "", "de", "src2"),
    (900003, " \n\t \r\n", "fr", None),
    (900004, "1234 5678 !!! ???", None, "src3"),
    (900005, LONG, "en", "src0"),
    (900006, "lead in one two " + PASSAGE + " tail a b c", "en", "src0"),
    (900007, "other start " + PASSAGE + " and another tail", "en", "src0"),
    (900008, "again again again " * 30, "en", "src0"),
    (900009, "same row twice " + " ".join(f"q{i}" for i in range(50)), "en", "src4"),
    (900009, "same row twice " + " ".join(f"q{i}" for i in range(50)), "en", "src4"),
    (900009, "one id two texts " + PASSAGE, "en", "src4"),
    (900010, "Mail a.b@c.de, x@y.z.w@q.r +1 (269) 555-3296 or 4111 1111 1111 1111 at 10.0.0.256 and 010.2.3.4.5.6.7.8",
     "en", "src4"),
    (900011, "naïve Ünïcode ﬁne 漢字 Привет мир   nbsp em x", "fr", "src5"),
    (900012, "\n\nfirst line here is long\nfirst line here is lond\nfirst line here is long\n", "en", "src5"),
]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), None, None, 3, "x", "y", 1, "z", "q") for i, t, lang, s in EDGE]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def docs(spark, edge):
    """The smallest table plus edge cases, with extra columns whose names clash with inner ones."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    return base.unionByName(edge, allowMissingColumns=True).select(edge.columns).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return docs.select("doc_id", "text", "lang", "source").collect()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
