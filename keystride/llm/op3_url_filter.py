r"""URL verdicts: a blocked Bloom filter of the listed keys, then an exact hash join for what passes.

The list holds rules (host and path prefix, for the host and its subdomains) and canonical URLs that are blocked. A page
has a key for each suffix of its host with each listed prefix length of its path, and one for its canonical URL. Keys that
the filter knows go on; the join by value removes the false ones. The longest rule wins; without one, a listed URL is
blocked and any other allowed.

The filter has at most 2 ** `LOG_BLOCKS` blocks of 512 bits and is broadcast as that many rows; a longer list makes it
pass more, never miss any. Only distinct URLs are judged, so a URL that holds a third of the rows is judged once.

The query lists the canonical URLs of pages whose document (the first number in the path) is labelled toxic. Canonical: host
without a leading `www.`, path without closing slashes, no scheme, query or fragment.

Null urls, or urls without `://`, have empty host and path and are allowed. Rows without an id and repeated rows are judged
each; an empty list allows all; extra columns stay as they are.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LOG_BLOCKS, BITS_PER_KEY = 17, 12
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def canonical(url) -> Column:
    return F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), "/+$", ""))


def _hashed(keys: DataFrame, blocks: int) -> DataFrame:
    h = F.xxhash64("key")
    bits = [F.shiftright(F.xxhash64("key", F.lit(1)), 6 * i).bitwiseAND(63).cast("int").alias(f"b{i}") for i in range(8)]
    return keys.select("*", F.pmod(h, F.lit(blocks)).alias("block"), *bits)


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """`block, w0 .. w7`: eight words of 64 bits; a key sets one bit in each word of its block."""
    return _hashed(keys, blocks).groupBy("block").agg(*[F.bit_or(F.expr(f"shiftleft(1L, b{i})")).alias(f"w{i}") for i in range(8)])


def possible(keys: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """The keys whose eight bits are set."""
    hits = _hashed(keys, blocks).join(F.broadcast(filter_), "block")
    for i in range(8):
        hits = hits.where(F.expr(f"(w{i} & shiftleft(1L, b{i})) <> 0"))
    return hits.select(keys.columns)


def block_count(keys: DataFrame) -> int:
    """Blocks for a filter of `keys`: a power of two, 2 ** `LOG_BLOCKS` at most."""
    return 1 << min(LOG_BLOCKS, max(4, (keys.count() * BITS_PER_KEY // 512).bit_length()))


def marked(rows: DataFrame, filter_: DataFrame, blocks: int, name: str) -> DataFrame:
    """All rows with a column that says whether the filter may hold their `key` (the columns of both stay)."""
    hits = _hashed(rows, blocks).join(F.broadcast(filter_), "block", "left")
    there = F.lit(True)
    for i in range(8):
        there = there & F.expr(f"(w{i} & shiftleft(1L, b{i})) <> 0")
    return hits.withColumn(name, F.coalesce(there, F.lit(False)))


def judge(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame) -> DataFrame:
    """`pages` with `host, path, rule, verdict`; `listed` has canonical URLs in `key`."""
    spark = pages.sparkSession
    lengths = sorted({len(r) - r.index("/") for r, _ in rules})
    named = spark.createDataFrame([(r, r, v) for r, v in rules], "key string, rule string, verdict string")
    all_ = named.union(listed.select(F.concat(F.lit(" "), "key"), F.lit(None).cast("string"), F.lit("block")).distinct())
    blocks = block_count(all_)
    urls = pages.select("url").where(F.col("url").contains("://")).distinct().withColumns({"h": host("url"), "p": path("url")})
    labels = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("p") >= n, F.substring("p", 1, n)) for n in lengths]).cast("array<string>"), lambda x: x.isNotNull())
    rule_keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda x: F.concat(s, x))))
    keys = urls.select("url", F.explode(F.concat(rule_keys, F.array(F.concat(F.lit(" "), canonical("url"))))).alias("key"))
    hits = possible(keys, bloom(all_.select("key"), blocks), blocks).join(all_, "key")
    best = hits.groupBy("url").agg(F.max_by(F.struct("rule", F.col("verdict").alias("v")), F.struct(F.col("rule").isNotNull(), F.length("rule"), "rule")).alias("best"))
    out = pages.drop("host", "path", "rule", "verdict").join(best, "url", "left")
    return out.select(*[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")], host("url").alias("host"), path("url").alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    number = F.regexp_extract(path("url"), "([0-9]+)", 1).try_cast("long")
    listed = pages.where(F.col("url").contains("://")).withColumn("doc_id", number).join(toxic, "doc_id", "left_semi").select(canonical("url").alias("key"))
    return judge(pages, RULES, listed).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH u AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
c AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS canon FROM u),
listed AS (SELECT DISTINCT canon FROM c WHERE contains(url, '://') AND try_cast(nullif(regexp_extract(path, '([0-9]+)', 1), '') AS BIGINT) IN (SELECT doc_id FROM labels WHERE toxic = 1)),
rules(rule, rh, rp, v) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
hit AS (SELECT c.*, r.rule, r.v, row_number() OVER (PARTITION BY c.page_id, c.url ORDER BY length(r.rule) DESC NULLS LAST) AS n
        FROM c LEFT JOIN rules r ON (c.host = r.rh OR ends_with(c.host, '.' || r.rh)) AND starts_with(c.path, r.rp))
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN v WHEN contains(url, '://') AND canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM hit WHERE n = 1"""
