"""URL filters: domain and path rules first, then a blocked Bloom filter over listed URLs.

The filter is a table of blocks of 512 bits (eight bigints). A canonical URL's hash names its block
and one bit in each of the eight words, so a look-up reads one row. Possible hits go on to an exact
join with the listed URLs, which removes the false positives; no listed URL can be missed. All of
it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbuf import fits_broadcast, frozen

# (verdict, host and path): the fixed rules of the contract.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/"))
# Query parameters that do not change a page.
TRACKING = ("ref", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid")
WORDS, KEYS_PER_BLOCK, SALTS = 8, 32, 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))


def host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """``_host`` and ``_path`` beside the columns: after the first ``://`` up to ``/ ? #``, A-Z
    lower-cased; then up to ``? #``. Null or no ``://``: both empty."""
    df = pages.withColumn("_url", F.coalesce(F.col(url), F.lit("")))
    df = df.withColumn("_rest", _after_scheme(F.col("_url")))
    host = F.regexp_extract("_rest", r"\A[^/?#]*", 0)
    df = df.withColumn("_host", F.translate(host, _UPPER, _LOWER))
    tail = F.expr("substring(_rest, length(_host) + 1)")
    return df.withColumn("_path", F.regexp_extract(tail, r"\A[^?#]*", 0))


def canonical(host: Column, path: Column, rest: Column) -> Column:
    """One spelling per page: no scheme, ``www.`` or ``m.``, fragment, closing slashes or index page;
    query parameters sorted, tracking ones dropped. Empty for an empty host."""
    name = F.regexp_replace(host, r"\A(www|m)\.", "")
    place = F.regexp_replace(F.regexp_replace(path, r"/index\.html?\z", ""), r"/+\z", "")
    query = F.regexp_extract(F.regexp_replace(rest, r"#[\s\S]*\z", ""), r"\?([\s\S]*)\z", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.element_at(
        F.split(p, "=", 2), 1).isin(*TRACKING)))
    return F.when(host == "", "").otherwise(
        F.concat(name, place, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule whose host is the host or a parent domain and whose
    path begins the path; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        site, _, start = text.partition("/")
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(f"/{start}")
        name = F.when(fits, text).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _bits(url: Column, blocks: Column) -> list[Column]:
    """Block number and the eight bit positions of a URL."""
    h = F.xxhash64(url)
    g = F.xxhash64(F.lit(7), url)
    return [F.pmod(h, blocks)] + [F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """``(block, w0 .. w7)`` of the distinct canonical URLs ``listed(canon)``."""
    at = _bits(F.col("canon"), F.lit(blocks))
    one = [F.expr("1L")] * WORDS
    rows = listed.select(at[0].alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(at[1:])])
    return rows.groupBy("block").agg(*[F.bit_or(F.expr(f"shiftleft(1L, b{i})")).alias(f"w{i}") for i in range(len(one))])


def possible_hits(urls: DataFrame, filter_blocks: DataFrame, blocks: int, rows: int) -> DataFrame:
    """Rows of ``urls(canon, ...)`` that the filter lets through. The filter is broadcast when its
    counted blocks fit; else both sides shuffle by block and salt, so that one URL in a third of
    all rows spreads over ``SALTS`` tasks."""
    at = _bits(F.col("canon"), F.lit(blocks))
    probe = urls.withColumn("block", at[0])
    for i, b in enumerate(at[1:]):
        probe = probe.withColumn(f"_b{i}", b)
    side, keys = F.broadcast(filter_blocks), ["block"]
    if not fits_broadcast(filter_blocks, rows):
        probe = probe.withColumn("_salt", F.floor(F.rand(11) * SALTS).cast("int"))
        side = filter_blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keys.append("_salt")
    hit = probe.join(side, keys)
    for i in range(WORDS):
        hit = hit.where(F.expr(f"(shiftrightunsigned(w{i}, _b{i}) & 1L) = 1L"))
    return hit.select(*urls.columns)


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """Verdict on every row of ``pages(page_id, url)`` against ``listed(url)``.

    Returns page_id, host, path, rule, verdict, canonical_url, listed: the longest fitting rule
    decides; without one, a listed canonical URL is blocked and any other allowed. Null URLs and
    URLs without ``://`` have empty host and path, fit no rule, are never listed and so allowed;
    repeated rows are judged each; an empty list blocks nothing; empty tables give empty results;
    other columns are not read.
    """
    def canon(df, *keep):
        at = host_and_path(df.select(*keep, "url"))
        return at.withColumn("canon", canonical(F.col("_host"), F.col("_path"), F.col("_rest")))

    ours = frozen(canon(listed).where("canon <> ''").select("canon").distinct())
    n = ours.count()
    blocks = max(1, -(-n // KEYS_PER_BLOCK))
    table = bloom_blocks(ours, blocks)
    page = canon(pages, "page_id")
    text, verdict = rule(F.col("_host"), F.col("_path"), rules)
    page = page.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), text.alias("rule"),
                       verdict.alias("said"), "canon")
    # the URLs that occur, each once: hot URLs are merged before the filter and the exact join
    seen = page.select("canon").where("canon <> ''").distinct()
    maybe = possible_hits(seen, table, blocks, min(n, blocks))
    hits = maybe.join(ours, "canon").select(F.col("canon").alias("_hit"))
    out = page.join(hits, page["canon"] == hits["_hit"], "left")
    found = F.col("_hit").isNotNull()
    return out.select("page_id", "host", "path", "rule",
                      F.coalesce("said", F.when(found, "block").otherwise("allow")).alias("verdict"),
                      F.col("canon").alias("canonical_url"), found.alias("listed"))
