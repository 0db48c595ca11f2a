from pyspark.sql import functions as F

from toposcope.llm import urls as U

URLS = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.com/en/1?b=2&a=1#x", "http://example.com/en/", "http://example.com/en",
        "http://a.b.example.com/en/x", "http://notexample.com/en/x", "ftp://x.net/es/1", "http://x.net/fr?x=/fr/", "http://net/fr/1",
        "http://xnet/fr/1", "http://é.org/a//", "http://m.q.org/a/index.html?ref=1", "http://q.org/a", "http://q.org/a?z=1&utm_source=k",
        "http://q.org?z=1", "a://b://c/d", "http://q.org/a", "http://u@q.org:80/a", "http://x.com#/en/", "http://q.org/\n?a#b"]


def slow_rule(host, path):
    best = None
    for v, r in U.RULES:
        site, _, start = r.partition("/")
        if (host == site or host.endswith("." + site)) and path.startswith("/" + start):
            if best is None or len(r) > len(best[1]):
                best = (v, r)
    return best or (None, None)


def slow(url):
    rest = (url or "").partition("://")[2]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[:min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    name = host
    for p in ("www.", "m."):
        if host.startswith(p):
            name = host[len(p):]
    place = path
    for p in ("/index.html", "/index.htm"):
        if place.endswith(p):
            place = place[:-len(p)]
    query = rest.partition("#")[0].partition("?")[2]
    kept = sorted(p for p in query.split("&") if p and p.partition("=")[0] not in U.TRACKING)
    return host, path, "" if not host else name + place.rstrip("/") + ("?" + "&".join(kept) if kept else "")


def check(pages, listed_urls, got):
    black = {slow(u)[2] for u in listed_urls} - {""}
    want = []
    for i, u in pages:
        host, path, canon = slow(u)
        v, r = slow_rule(host, path)
        want.append((i, host, path, r, v or ("block" if canon in black else "allow"), canon, canon in black))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_matches_brute_force(spark):
    pages = list(enumerate(URLS)) + [(None, "http://q.org/a"), (3, "http://q.org/a")]
    listed = ["https://m.q.org/a/#k", None, "junk", "http://x.net/es/1", "http://www.q.org/?z=1&ref=2"]
    p = spark.createDataFrame(pages, "page_id bigint, url string").withColumn("rule", F.lit(1)).withColumn("canon", F.lit("x"))
    check(pages, listed, U.filter_urls(p, spark.createDataFrame([(u,) for u in listed], "url string")).collect())


def test_table_and_salted_filter(spark, monkeypatch):
    p = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    pages = [tuple(r) for r in p.collect()]
    listed = p.where("page_id % 3 = 0").select("url")
    check(pages, [r[0] for r in listed.collect()], U.filter_urls(p, listed).collect())
    table = p.select(F.col("url").alias("canon")).distinct()
    ours = table.where(F.xxhash64("canon") % 2 == 0)
    blocks = U.bloom_blocks(ours, 4)
    for rows in (4, 2_000_000):
        hits = {r[0] for r in U.possible_hits(table, blocks, 4, rows).collect()}
        assert {r[0] for r in ours.collect()} <= hits and U.possible_hits(table, blocks, 4, rows).count() == len(hits)


def test_few_false_positives(spark):
    listed = spark.range(20000).select(F.concat(F.lit("a"), "id").alias("canon"))
    other = spark.range(20000).select(F.concat(F.lit("b"), "id").alias("canon"))
    n = 20000 // U.KEYS_PER_BLOCK
    blocks = U.bloom_blocks(listed, n)
    assert U.possible_hits(listed, blocks, n, n).count() == 20000
    assert U.possible_hits(other, blocks, n, n).count() < 1200


def test_empty(spark):
    p = spark.createDataFrame([], "page_id bigint, url string")
    one = spark.createDataFrame([("http://a.b/c",)], "url string")
    assert U.filter_urls(p, one).collect() == []
    assert [r["verdict"] for r in U.filter_urls(one.selectExpr("1L as page_id", "url"), one.where("false")).collect()] == ["allow"]
