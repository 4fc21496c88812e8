"""URL filters: host and path rules, then a blocked Bloom filter before an exact hash join.

Rules decide first. A URL without a rule is looked up in a list of canonical
URLs: a blocked Bloom filter of the list passes possible hits, and a join with
the list itself removes the false positives.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.bloom import bloom_filter, probe
from lamella.llm.common import materialise, prepare


class Rule(NamedTuple):
    """``host`` fits itself and its subdomains; ``path`` fits URLs whose path starts with it."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without trailing slashes; scheme, query and fragment don't count."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    return F.concat(host, F.regexp_replace(path_of(url), "/+$", ""))


def _longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The rule with the longest host, then path, as a chain of cases: the rules are a short fixed list."""
    out: Column | None = None
    for rule in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.name), reverse=True):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return none if out is None else out.otherwise(none)


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[Rule] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "url",
    bits_per_key: int = 16,
    most_bytes: int = 32 << 20,
) -> DataFrame:
    """Verdict for every page: a rule's, else block where the canonical URL is listed, else allow.

    The longest fitting rule wins (host and path lengths together). The list
    may have any size: its filter takes ``bits_per_key`` bits a key but
    ``most_bytes`` at most, and with too small a filter only more URLs reach
    the join. Lists are made distinct by canonical URL first, so the join adds
    no rows, and its probe side is only what the filter passes; a URL that very
    many pages share is split by adaptive execution.

    Returns id, host, path, rule, verdict, maybe (what the filter said; false
    where a rule decided) and listed. A null URL or one without ``://`` has an
    empty host and path and fits only rules that would fit these; it is never
    in the list. Null list entries are left out. Repeated rows are judged row
    by row; an empty list blocks nothing.
    """
    spark = pages.sparkSession
    prepare(spark)
    keys = materialise(listed.select(canonical(F.col(listed_col)).alias("key")).filter("key <> ''").distinct(), "url-list")
    table = bloom_filter(keys, "key", keys.count(), bits_per_key, most_bytes)
    url = F.col(url_col)
    parted = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key"))
    ruled = parted.withColumn("found", _longest_rule(F.col("host"), F.col("path"), rules)).select("id", "host", "path", "key", "found.rule", "found.verdict")
    probed = probe(ruled, "key", table).withColumn("probe", F.when(F.col("maybe") & F.col("rule").isNull(), F.col("key")))
    # A hash join at any size: its table is the distinct keys of one partition, which hashing makes even.
    marked = keys.select(F.col("key").alias("hit")).hint("shuffle_hash")
    # Rows that need no look-up join nothing and keep their place: they go round the join.
    near = probed.filter("probe is not null").join(marked, F.col("probe") == F.col("hit"), "left")
    far = probed.filter("probe is null").withColumn("hit", F.lit(None).cast("string"))
    both = near.unionByName(far)
    is_listed = F.col("hit").isNotNull()
    verdict = F.coalesce("verdict", F.when(is_listed, "block").otherwise("allow"))
    return both.select(
        F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.col("probe").isNotNull().alias("maybe"), is_listed.alias("listed")
    )


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: First characters of the MD5 of the URLs that make up the query's list.
LISTED = ("0", "1", "2")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, by the five rules and a list of three sixteenths of their URLs, written otherwise, and of as many URLs of no page as there are pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    url = F.col("url")
    known = pages.filter(F.substring(F.md5(url), 1, 1).isin(*LISTED)).select(F.concat(url, F.lit("#listed")).alias("url"))
    others = pages.select(F.concat(F.lit("http://www."), host_of(url), F.lit("/absent/"), F.md5(url)).alias("url"))
    return judge(pages, known.unionByName(others), RULES).drop("maybe")


ORACLE_SQL = r"""
WITH parted AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), keyed AS (
  SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS key,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
    END AS rule
  FROM parted
), listed AS (SELECT DISTINCT key FROM keyed WHERE md5(url)[1:1] IN ('0', '1', '2') AND key <> '')
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict,
       rule IS NULL AND key IN (SELECT key FROM listed) AS listed
FROM keyed
"""
