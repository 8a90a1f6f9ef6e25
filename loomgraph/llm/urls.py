"""Operator 6, URL filters: a sort-merge range join of hosts with nested rules.

A host's canonical key is its labels reversed, each followed by a dot: blog.example.net becomes
net.example.blog. and every rule on a host then covers one interval of keys, [net., net/), as "/" is the
character after ".". Intervals nest. A sorted sweep over rule bounds and hosts carries the stack of rules
that are open; a URL takes the longest rule on its host's stack whose path its own path starts with.

DataFrame code only. The sweep runs over distinct hosts, so a host with a third of all URLs is one row in
it, in buckets by a host's first two reversed labels; buckets with many hosts are split further by hash,
and each part gets the rules of its bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, columns_of

#: (host, path, verdict): the rule holds for the host and all its subdomains, from that path on.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
DEFAULT = "allow"
#: Distinct hosts that one sorted part of the sweep holds on average, at most.
PART = 100_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty if there is no ://."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _bucket(key: Column) -> Column:
    return F.concat(F.substring_index(F.regexp_replace(key, r"\.$", ""), ".", 2), F.lit("."))


def _prefixes(key: Column) -> Column:
    """Every run of first labels of a key, itself included: net. and net.example. of net.example."""
    labels = F.split(F.regexp_replace(key, r"\.$", ""), r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))


def judge(urls: DataFrame, rules: DataFrame, key: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """key, host, path, rule (like net/; null where none fits) and verdict of every URL.

    Null URLs and those without :// have empty host and path, and take the default. Repeated rows are
    judged each; repeated rules count once; of equally long rules the smaller text wins. `rules` has
    host, path and verdict; other columns of either table are not read.
    """
    scratch = Scratch(urls.sparkSession)
    pages = columns_of(urls, key, "url").select(F.col(key), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = F.concat("host", "path")
    spans = (
        rules.select("host", "path", "verdict", rule.alias("rule")).distinct()
        .select(host_key(F.col("host")).alias("lo"), F.struct(F.length("rule").alias("long"), "path", "rule", "verdict").alias("entry"))
        .groupBy("lo").agg(F.sort_array(F.collect_set("entry")).alias("entries"))
    )
    hosts = pages.select("host").distinct().select("host", host_key(F.col("host")).alias("key")).withColumn("bucket", _bucket(F.col("key")))
    parts = hosts.groupBy("bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    hosts = hosts.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))

    # Bounds: where a rule's interval opens or closes, and where a bucket begins. The stack after a bound
    # is every rule whose key is a run of first labels of the bound's own key (of its parent's, at an end).
    opens = spans.select(F.col("lo").alias("key"), F.col("lo").alias("inside"))
    parent = F.regexp_replace("lo", r"[^.]*\.$", "")
    closes = spans.select(F.regexp_replace("lo", r"\.$", "/").alias("key"), parent.alias("inside"))
    bounds = opens.unionByName(closes).withColumn("bucket", _bucket(F.col("inside"))).where("inside <> ''").join(parts, "bucket")
    begins = parts.select("bucket", F.col("bucket").alias("key"), F.col("bucket").alias("inside"), "parts")
    bounds = bounds.select("bucket", "key", "inside", "parts").unionByName(begins).distinct()
    runs = bounds.select("bucket", "key", "inside", F.explode(_prefixes(F.col("inside"))).alias("lo"))
    stacks = runs.join(spans, "lo", "left").groupBy("bucket", "key").agg(F.flatten(F.collect_list("entries")).alias("stack"))
    stacks = stacks.join(bounds.select("bucket", "key", "parts").distinct(), ["bucket", "key"])
    stacks = stacks.select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "key", F.lit(None).cast("string").alias("host"), "stack")

    sweep = Window.partitionBy("bucket", "part").orderBy("key", F.col("host").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    events = stacks.unionByName(hosts.select("bucket", "part", "key", "host").withColumn("stack", F.lit(None).cast(stacks.schema["stack"].dataType)))
    active = events.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("host is not null").select("host", "stack")
    active = scratch.write(active)
    # The smallest of (minus length, rule) is the longest rule, the smaller text first.
    best = F.array_min(F.transform(F.filter("stack", lambda e: F.startswith(F.col("path"), e["path"])), lambda e: F.struct((-e["long"]).alias("long"), e["rule"].alias("rule"), e["verdict"].alias("verdict"))))
    out = pages.join(active, "host", "left").withColumn("best", best)
    return out.select(F.col(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


OP6_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
