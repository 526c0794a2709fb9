"""URL filter by host rules and a Bloom filter cascade (operator 10), DataFrame functions only.

Rules first: a rule ``host/path`` fits its host and all subdomains when the url's path starts with
the rule's path; the longest fitting rule gives the verdict. Urls without a rule are judged by the
host list: a host on it is blocked.

The list is a cascade of Bloom filters over the complete key universe (every host of the corpus).
Level 1 holds the listed keys; level 2 the unlisted keys that level 1 wrongly accepts; level 3 the
listed keys that level 2 wrongly accepts; and so on until nothing is wrong. Walking the levels then
gives exact membership for every key of the universe from a few bits a key, with no join: a row
tests k bits per level, each a look-up in an array held as a constant.

Size: each level is one constant in the plan, so all levels together are checked against
``max_bytes``; a list beyond that is answered by a join on the key instead, with the same result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm.bloom import bloom_words, filter_bits, in_bloom
from tickweave.llm.common import LOWER, UPPER, saved
from tickweave.sources.tables import read_table

#: Fixed values of the contract: verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: A host is listed when at least LISTED_NUM of LISTED_DEN of its urls carry a tracking parameter.
TRACKING, LISTED_NUM, LISTED_DEN = "utm_source=", 1, 4
MAX_FILTER_BYTES = 8 << 20


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path
    from there up to ``?``, ``#`` or the end. Null or no ``://``: both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as ``host/path``, its verdict) of the longest fitting rule, nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # later, longer ones win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def build_cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_FILTER_BYTES):
    """[(words, level, hashes, bits)] such that :func:`is_listed` is exact on ``universe`` (column
    ``key``, distinct), or None when the levels would pass ``max_bytes``. Each level's keys are a
    saved table, so later passes read them instead of recomputing the levels before."""
    inside = saved(universe.join(listed, "key", "left_semi"), "op10-listed")
    outside = saved(universe.join(listed, "key", "left_anti"), "op10-unlisted")
    n_in, n_out = inside.count(), outside.count()
    levels, size = [], 0
    while n_in:
        level = len(levels) + 1
        rate = min(0.5, n_in / (math.sqrt(2) * max(1, n_out))) if level == 1 else 0.5
        rate = max(rate, 1e-6)
        bits, hashes = filter_bits(n_in, rate), max(1, round(-math.log2(rate)))
        size += bits // 8
        if size > max_bytes:
            return None
        levels.append((bloom_words(inside, level, hashes, bits), level, hashes, bits))
        wrong = saved(outside.filter(in_bloom(F.col("key"), *levels[-1])), "op10-wrong")
        inside, outside, n_in, n_out = wrong, inside, wrong.count(), n_in
    return levels


def is_listed(key: Column, levels) -> Column:
    """Walk the cascade: the first level that does not accept the key decides, by its parity."""
    last = len(levels)
    verdict = F.lit(last % 2 == 1)
    for n in range(last, 0, -1):
        verdict = F.when(in_bloom(key, *levels[n - 1]), verdict).otherwise(F.lit((n - 1) % 2 == 1))
    return verdict


def tracking_hosts(hosts: DataFrame) -> DataFrame:
    """The host list: of (host, url) rows, hosts with at least LISTED_NUM/LISTED_DEN of their urls tracking."""
    tracked = F.sum(F.coalesce(F.instr("url", TRACKING) > 0, F.lit(False)).cast("long"))
    return (hosts.groupBy(F.col("host").alias("key")).agg(F.count(F.lit(1)).alias("n"), tracked.alias("t"))
            .select("key", (F.col("t") * LISTED_DEN >= F.col("n") * LISTED_NUM).alias("listed")))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
               max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(id, host, path, rule, verdict), one row per page, repeated rows included; null and malformed
    urls have host and path ``''`` and are judged as that host. Other columns are not read."""
    url = F.col(f"`{url_col}`").cast("string")
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), url.alias("url"))
    rows = rows.select("id", "url", host.alias("host"), path.alias("path"))
    keys = saved(tracking_hosts(rows), "op10-hosts")
    listed = keys.filter("listed").select("key")
    levels = build_cascade(listed, keys.select("key"), max_bytes)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("v"))
    if levels is None:  # a list beyond the size bound: the same answer from a join AQE can split
        on = listed.select(F.col("key").alias("host"), F.lit(True).alias("on_list"))
        rows = rows.join(on, "host", "left").withColumn("on_list", F.coalesce("on_list", F.lit(False)))
    else:
        rows = rows.withColumn("on_list", is_listed(F.col("host"), levels))
    method = F.when(F.col("on_list"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("v", method).alias("verdict"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages", ["page_id", "url"]))


OP10_SQL = r"""
WITH r AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
u AS (
  SELECT page_id, url,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r),
l AS (SELECT host, 4 * count(*) FILTER (WHERE strpos(url, 'utm_source=') > 0) >= count(*) AS listed FROM u GROUP BY host),
j AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM u)
SELECT page_id, j.host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM j JOIN l ON j.host = l.host
"""
