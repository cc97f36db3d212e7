"""URL filters whose block decisions spread over redirect and canonical-link equivalence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, without
from graphloom.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"://([^/?#]*)([^?#]*)"
#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
CANONICAL = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"
ADDED = ("host", "path", "rule", "verdict", "via")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        best = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def address(url: Column) -> Column:
    """What aliases are compared by: host, path and query, without scheme and fragment; null without a host."""
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1)))


def resolved(link: Column, base: Column) -> Column:
    """An absolute URL from a link found on the page `base`."""
    root = F.concat(F.lit("http://"), host_of(base))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(root, F.regexp_replace(path_of(base), "[^/]*$", ""), link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): URLs of pages and of what their canonical link or refresh redirect names."""
    tag = lambda pattern, inner: F.regexp_extract(F.regexp_extract("html", pattern, 0), inner, 1)
    held = F.col("html").rlike(r"(?i)canonical|refresh")
    links = F.when(held, F.array(tag(CANONICAL, HREF), tag(REFRESH, TARGET)))
    found = pages.select("url", F.explode(links).alias("link")).where("link <> ''")
    return found.select(F.col("url").alias("a"), resolved(F.col("link"), F.col("url")).alias("b"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, edges: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """pages (url, html, any others) with host, path, rule, verdict and via (rule, alias or default).

    A URL's own longest rule decides. Where none fits, its aliases do: the URLs that redirects and
    canonical links join with it, at any distance. If a rule allows one of them, it is allowed, else
    if a rule blocks one, it is blocked, else `default` holds. Null URLs and URLs without `://` have
    an empty host and path, fit no rule and have no alias. Null html has no links. Repeated rows are
    judged alike; an empty table gives none. Input columns named like an added one give way.
    `edges` (a, b: URLs), say a redirect log, are joined to those found in html.
    """
    spark = pages.sparkSession
    links = alias_edges(pages)
    if edges is not None:
        links = links.union(edges.select("a", "b"))
    out = without(pages, *ADDED).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("_own", rule_of(F.col("host"), F.col("path"), rules))
    scratch = Scratch(spark, "aliases")
    links = scratch.put(links.select(address(F.col("a")).alias("a"), address(F.col("b")).alias("b"), F.col("a").alias("url_a"), F.col("b").alias("url_b")).where("a is not null and b is not null and a <> b"), "links")
    if links.isEmpty():
        spread = out.withColumn("_spread", F.lit(None).cast("string"))
    else:
        ends = links.select(F.col("a").alias("at"), F.col("url_a").alias("u")).union(links.select("b", "url_b"))
        nodes = ends.groupBy("at").agg(F.max(rule_of(host_of(F.col("u")), path_of(F.col("u")), rules)["verdict"]).alias("verdict"))
        nodes = scratch.put(nodes.withColumn("id", F.xxhash64("at")), "nodes")
        roots = components(links.select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v")), "alias-components")
        placed = nodes.join(roots, nodes["id"] == roots["node"]).select("at", "root", "verdict")
        # "allow" sorts before "block": the smallest verdict of a class is the one that has precedence
        classes = placed.groupBy("root").agg(F.min("verdict").alias("class_verdict"))
        known = placed.join(classes, "root").select(F.col("at").alias("_at"), F.col("class_verdict").alias("_spread")).where("_spread is not null")
        spread = out.withColumn("_key", address(F.col("url"))).join(known, F.col("_key") == F.col("_at"), "left").drop("_key", "_at")
    return spread.withColumn("rule", F.col("_own.rule")).withColumn("verdict", F.coalesce("_own.verdict", "_spread", F.lit(default))).withColumn("via", F.when(F.col("_own").isNotNull(), "rule").when(F.col("_spread").isNotNull(), "alias").otherwise("default")).drop("_own", "_spread")


ORACLE_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, url, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path, coalesce(regexp_extract(url, '://[^?#]*(\?[^#]*)', 1), '') AS q FROM pages),
rules(verdict, h, t) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
tags AS (SELECT url, host, path, q, regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS link FROM p
  UNION ALL SELECT url, host, path, q, regexp_extract(regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM p),
full_links AS (SELECT host || path || q AS a, host AS ah, path AS ap, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN 'http:' || link WHEN starts_with(link, '/') THEN 'http://' || host || link ELSE 'http://' || host || regexp_replace(path, '[^/]*$', '') || link END AS target FROM tags WHERE link <> '' AND host <> ''),
ends AS (SELECT a, ah, ap, translate(regexp_extract(target, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS bh, regexp_extract(target, '://([^/?#]*)([^?#]*)', 2) AS bp, regexp_extract(target, '://[^?#]*(\?[^#]*)', 1) AS bq FROM full_links),
e AS (SELECT a, bh || bp || bq AS b FROM ends WHERE bh <> '' UNION SELECT bh || bp || bq, a FROM ends WHERE bh <> ''),
nodes AS (SELECT a AS n, ah AS h, ap AS t FROM ends WHERE bh <> '' UNION SELECT bh || bp || bq, bh, bp FROM ends WHERE bh <> ''),
judged AS (SELECT n, (SELECT verdict FROM rules r WHERE (nodes.h = r.h OR ends_with(nodes.h, '.' || r.h)) AND starts_with(nodes.t, r.t) ORDER BY length(r.h || r.t) DESC LIMIT 1) AS verdict FROM nodes),
reach AS (SELECT n, n AS m FROM nodes UNION SELECT reach.n, e.b FROM reach JOIN e ON reach.m = e.a),
spread AS (SELECT reach.n, min(judged.verdict) AS verdict FROM reach JOIN judged ON reach.m = judged.n GROUP BY reach.n),
own AS (SELECT page_id, host, path, host || path || q AS n, (SELECT struct_pack(rule := r.h || r.t, verdict := r.verdict) FROM rules r WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.t) ORDER BY length(r.h || r.t) DESC LIMIT 1) AS best FROM p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, spread.verdict, 'allow') AS verdict FROM own LEFT JOIN spread ON own.n = spread.n AND own.host <> ''
"""
