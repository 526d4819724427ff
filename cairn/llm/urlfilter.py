"""URL filters: host and path rules first, then a list of canonical URLs.

The list is held as a blocked Bloom filter: rows of one 512-bit block each, made with bit_or. A URL's hash names one block and
eight bits in it, so a test touches one row. Only URLs whose bits are all set go on to the exact join with the list, which
removes false positives. The blocks are broadcast while their measured size is within most_bytes; beyond it the same rows are
joined by block number through a shuffle. A list of up to BROADCAST_ROWS rows is broadcast for the exact join as well, and pages
are read and parsed once; beyond that the tested pages are staged, and only possible hits are shuffled to the list.

Null URLs and URLs without "://" have an empty host and path, no rule, are on no list, and are allowed. Very long URLs are read
whole. Of rules that fit, the longest wins; two of one length fit the same URL only if they are equal. Repeated rows are each
judged. An empty table gives an empty result, an empty list blocks nothing. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import UPPER, shipped

shipped(__name__)

#: Rules (verdict, host, path) of the query; fixed values.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: The query's list: the URLs whose canonical form has a digest that begins with one of these digits, an eighth of all.
LISTED = "01"
#: Query parameters that a canonical URL leaves out.
TRACKING = "^(utm_[^=]*|ref)(=|$)"
WORDS, PROBES = 8, 8


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, UPPER, UPPER.lower())


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without user, default port and leading www., path without trailing slashes, query without tracking parameters."""
    name = F.regexp_replace(F.regexp_replace(host(url), "^[^@]*@|:(80|443)$", ""), r"^www\.", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: ~x.rlike(TRACKING) & (x != "")), "&")
    return F.concat(name, F.regexp_replace(path(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (like "net/es/") and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _bits(key: str) -> list[tuple[Column, Column]]:
    """(word, bit) of each probe in the block, nine bits of a second hash each."""
    h = F.xxhash64(F.lit("bits"), F.col(key))
    out = []
    for k in range(PROBES):
        v = F.shiftrightunsigned(h, 7 * k).bitwiseAND(F.lit(511))
        out.append((F.shiftright(v, 6).cast("int"), v.bitwiseAND(F.lit(63)).cast("int")))
    return out


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), F.col(key)), F.lit(blocks))


def blocked_bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, words array<long>): one row for each block with a bit set."""
    words = []
    for w in range(WORDS):
        mask = F.lit(0).cast("long")
        for word, bit in _bits(key):
            mask = mask.bitwiseOR(F.when(word == w, F.call_function("shiftleft", F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
        words.append(F.bit_or(mask))
    return listed.groupBy(_block(key, blocks).alias("block")).agg(F.array(*words).alias("words"))


def on_list(pages: DataFrame, listed: DataFrame, key: str, bits_per_entry: int = 16, most_bytes: int = 64 << 20, most_rows: int = common.BROADCAST_ROWS) -> DataFrame:
    """pages with the boolean columns possible (the filter's answer) and listed (whether key is in the list, a table with a
    column key)."""
    listed = common.staged(listed.select(key).where(F.col(key).isNotNull()).distinct(), "listed")
    n = listed.count()
    blocks = max(1, -(-n * bits_per_entry // (64 * WORDS)))
    bloom = blocked_bloom(listed, key, blocks)
    if blocks * WORDS * 8 <= most_bytes:
        bloom = F.broadcast(bloom)
    set_bits = F.lit(True)
    for word, bit in _bits(key):
        set_bits = set_bits & (F.call_function("shiftrightunsigned", F.get("words", word), bit).bitwiseAND(F.lit(1).cast("long")) == 1)
    tested = pages.withColumn("block", _block(key, blocks)).join(bloom, "block", "left")
    possible = F.col("words").isNotNull() & F.col(key).isNotNull() & F.coalesce(set_bits, F.lit(False))
    tested = tested.withColumn("possible", possible).drop("block", "words")
    hit = listed.select(F.col(key).alias("_hit"), F.lit(True).alias("listed"))
    answer = F.coalesce("listed", F.lit(False)).alias("listed")
    if n <= most_rows:
        probe = F.when(F.col("possible"), F.col(key)) == F.col("_hit")
        return tested.join(F.broadcast(hit), probe, "left").select(*pages.columns, "possible", answer)
    tested = common.staged(tested, "tested")
    never = tested.where("not possible").withColumn("listed", F.lit(False))
    exact = tested.where("possible").join(hit, F.col(key) == F.col("_hit"), "left").select(*tested.columns, answer)
    return never.unionByName(exact)


def judged(pages: DataFrame, listed: DataFrame, rules=RULES, **limits) -> DataFrame:
    """page_id, host, path, rule, verdict and listed of each page; listed has canonical URLs in a column canonical."""
    url = F.col("url")
    pages = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), F.when(F.instr(url, "://") > 0, canonical(url)).alias("canonical"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = on_list(pages, listed, "canonical", **limits)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def listed_urls(urls: DataFrame, digits: str = LISTED) -> DataFrame:
    """canonical: the list that stands in for a public one, of URLs chosen by the digest of their canonical form. The list has
    them as lists do, in another guise: with a user, www., default port, trailing slashes and a tracking parameter; canonical() takes
    these off. Nothing but the whole canonical URL says whether a page is on it."""
    form = F.when(F.instr("url", "://") > 0, canonical(F.col("url")))
    chosen = urls.select(form.alias("c")).where(F.substring(F.md5("c"), 1, 1).isin(*digits)).distinct()
    place, query = F.split_part("c", F.lit("?"), F.lit(1)), F.regexp_extract("c", r"(?s)\?(.*)$", 1)
    guise = F.concat(F.lit("http://user@www."), F.regexp_replace(place, "^([^/]*)", "$1:80"), F.lit("//?utm_campaign=x"), F.when(query != "", F.concat(F.lit("&"), query)).otherwise(""))
    return chosen.select(canonical(guise).alias("canonical"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, listed_urls(pages))


ORACLE_SQL = {
    "op7_url_filter": rf"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), named AS (
  SELECT page_id, host, path, contains(url, '://') AS whole,
         regexp_replace(regexp_replace(host, '^[^@]*@|:(80|443)$', '', 'g'), '^www\.', '')
         || regexp_replace(path, '/+$', '') AS place,
         array_to_string(list_filter(string_split(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '&'),
                                     lambda x: NOT regexp_matches(x, '{TRACKING}') AND x <> ''), '&') AS kept
  FROM parts
), urls AS (
  SELECT page_id, host, path, CASE WHEN whole THEN place || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical
  FROM named
), listed AS (
  SELECT DISTINCT canonical FROM urls WHERE left(md5(canonical), 1) IN ('{"', '".join(LISTED)}')
), ruled AS (
  SELECT u.page_id, u.host, u.path, l.canonical IS NOT NULL AS listed,
         CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM urls u LEFT JOIN listed l ON u.canonical = l.canonical
)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'www.example.com/en/' THEN 'allow' WHEN 'example.com/en/' THEN 'block' WHEN 'net/es/' THEN 'block'
                 WHEN 'net/fr/' THEN 'block' WHEN 'com/' THEN 'allow' ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict,
       listed
FROM ruled"""
}
