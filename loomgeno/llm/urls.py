"""URL filters: host-suffix and path-prefix expressions, joined with rules on short hash prefixes.

Each distinct (host, path prefix) is expanded into the expressions a rule could have: the host and its parent domains, with
every prefix of the path whose length some rule has. The 32-bit prefix of an expression's SHA-256 digest alone is equi-joined
with the rules'; only for what it matches is the full digest taken and compared, and the longest confirmed rule wins.

Defined cases: a null url, or one without ://, has empty host and path, which no rule fits; equal longest rules can differ
only in the share of host, and the longer host wins; a rule listed twice with both verdicts blocks; urls without a rule get
the default verdict; ports and user names count as part of the host; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgeno.llm.common import join_unique, materialize

RULE = "host string, path string, verdict string"
#: The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    """A separator that no host contains keeps (host, path) unambiguous."""
    return F.sha2(F.concat(host, F.lit("/\n"), path).cast("binary"), 256)


def _short(digest: Column, digits: int) -> Column:
    """The first hex digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", digits: int = 8) -> DataFrame:
    """pages with host, path, rule and verdict added (columns of these names are replaced). rules: host, path, verdict. Digests are
    joined on their first `digits` hex digits."""
    rules = rules.select(F.coalesce("host", F.lit("")).alias("rhost"), F.coalesce("path", F.lit("")).alias("rpath"), F.col("verdict").alias("rverdict"))
    rules = rules.groupBy("rhost", "rpath").agg(F.max("rverdict").alias("rverdict"))
    rules = materialize(rules.withColumn("rfull", _digest(F.col("rhost"), F.col("rpath"))).withColumn("rshort", _short(F.col("rfull"), digits)), "rules")
    lengths = sorted(r[0] for r in rules.select(F.length("rpath")).distinct().collect())
    longest = max(lengths, default=0)
    mine = pages.drop("host", "path", "rule", "verdict", "__hit").withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    mine = mine.withColumn("__head", F.left("path", F.lit(longest)))
    # Counted before the join: one row for each (host, path prefix), however many pages have it.
    keys = materialize(mine.groupBy("host", "__head").agg(F.count("*").alias("__n")), "keys")
    total = keys.agg(F.sum("__n")).first()[0] or 0
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("__head")), lambda n: F.left("__head", n))
    hosts = keys.where("host <> ''").select("host", "__head", F.explode(suffixes).alias("h"), prefixes.alias("ps"))
    each = hosts.select("host", "__head", "h", F.explode("ps").alias("p")).withColumn("short", _short(_digest(F.col("h"), F.col("p")), digits))
    # Hot expressions meet the few rules of one short prefix; adaptive execution splits or broadcasts this join by measured size.
    hits = each.join(rules, F.col("short") == F.col("rshort"))
    # The confirmation is a condition of the aggregate, as the optimiser would make a filter part of the join's key.
    sure = _digest(F.col("h"), F.col("p")) == F.col("rfull")
    rank = F.when(sure, F.struct((F.length("rhost") + F.length("rpath")).alias("a"), F.length("rhost").alias("b")))
    best = hits.groupBy("host", "__head").agg(F.max_by(F.struct(F.concat("rhost", "rpath").alias("rule"), F.col("rverdict").alias("verdict")), rank).alias("__hit"), F.count_if(~sure).alias("__refused"))
    found = materialize(keys.join(best, ["host", "__head"]).select("host", "__head", "__n", "__hit"), "hits")
    out = join_unique(mine, found, ["host", "__head"], "__n", total).drop("__head")
    return out.withColumn("rule", F.col("__hit.rule")).withColumn("verdict", F.coalesce("__hit.verdict", F.lit(default))).drop("__hit")


def verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) under a list of rules."""
    table = pages.sparkSession.createDataFrame(RULES if rules is None else rules, RULE)
    return judge(pages.select("page_id", "url"), table).select("page_id", "host", "path", "rule", "verdict")


#: The same verdicts for RULES in DuckDB.
SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
keys AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT k.host, k.path, arg_max(rhost || rpath, length(rhost) + length(rpath)) AS rule, arg_max(rverdict, length(rhost) + length(rpath)) AS verdict
  FROM keys k JOIN rules r ON (k.host = rhost OR ends_with(k.host, '.' || rhost)) AND starts_with(k.path, rpath)
  GROUP BY ALL)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""
