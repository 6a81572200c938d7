"""URL rules that reach aliases: pages joined by redirects and canonical links share one decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.llm.common import read_table
from tremorframe.llm.components import connected_components
from tremorframe.session import durable

#: Fixed values of the query: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Rule tables up to this many rows are broadcast; a larger one is joined by key.
BROADCAST_RULES = 10_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rules(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``url, rule, rule_verdict`` for the distinct urls under a rule; the longest rule wins.

    Every host suffix at a label border is looked up by equality, then the rule's path is tested as a prefix. Of two
    rules of one length, which can only be the same text with two verdicts, allow wins.
    """
    spark = urls.sparkSession
    table = spark.createDataFrame([(h, h + p, p, v) for h, p, v in rules], "rule_host string, rule string, rule_path string, rule_verdict string")
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    labels = F.split("host", r"\.")
    suffixes = urls.filter("host <> ''").withColumn("suffix", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    hits = suffixes.join(table, F.col("suffix") == F.col("rule_host")).filter(F.startswith(F.col("path"), F.col("rule_path")))
    best = F.max(F.struct(F.char_length("rule").alias("length"), (F.col("rule_verdict") == "allow").alias("allow"), "rule", "rule_verdict"))
    return hits.groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.rule_verdict")


def link_targets(html: Column) -> Column:
    """Targets of canonical links and of meta refreshes, as written in the page."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    wanted = F.filter(tags, lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?canonical\b") | t.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    found = F.transform(wanted, lambda t: F.when(
        t.rlike(r"(?is)^<link"), F.coalesce(
            F.nullif(F.regexp_extract(t, r"(?is)\bhref\s*=\s*\"([^\"]*)\"", 1), F.lit("")),
            F.nullif(F.regexp_extract(t, r"(?is)\bhref\s*=\s*'([^']*)'", 1), F.lit("")),
            F.regexp_extract(t, r"(?is)\bhref\s*=\s*([^\s\"'>]+)", 1),
        )).otherwise(F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'>\s;]+)", 1)))
    return F.filter(found, lambda x: F.length(x) > 0)


def absolute(base: Column, target: Column) -> Column:
    """The target as a full url without fragment: full, protocol-relative, host-relative or relative to the folder."""
    scheme = F.regexp_extract(base, r"^([\s\S]*?)://", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(base, r"^[\s\S]*?://([^/?#]*)", 1))
    folder = F.concat(site, F.regexp_replace(url_path(base), r"[^/]*$", ""))
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    full = F.when(target.contains("://"), target).when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target)) \
        .when(F.startswith(target, F.lit("/")), F.concat(site, target)).otherwise(F.concat(folder, target))
    return node_of(full)


def node_of(url: Column) -> Column:
    """The url with the host in lower case and without the fragment, which never reaches a server."""
    bare = F.regexp_replace(url, r"#[\s\S]*$", "")
    head = F.regexp_extract(bare, r"^([\s\S]*?://[^/?#]*)", 1)
    return F.concat(F.translate(head, UPPER, LOWER), F.substr(bare, F.char_length(head) + 1))


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``a, b`` urls of one page: canonical links and refreshes in the html, and the rows ``from_url, to_url`` of a crawl log."""
    html = pages.filter("url IS NOT NULL").select("url", F.explode(link_targets(F.coalesce("html", F.lit("")))).alias("target"))
    edges = html.select(node_of(F.col("url")).alias("a"), absolute(F.col("url"), F.col("target")).alias("b"))
    if redirects is not None:
        edges = edges.union(redirects.filter("from_url IS NOT NULL AND to_url IS NOT NULL").select(
            node_of(F.col("from_url")), absolute(F.col("from_url"), F.col("to_url"))))
    return edges.filter("a <> b").distinct()


def judge_pages(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict`` and the page's ``alias_group``.

    A page under a rule has the rule's verdict. Another page takes part in the decisions of its alias group (urls
    joined by redirects and canonical links, crawled or not): blocked if the group has a blocked url and no
    explicitly allowed one; else allowed. A null url, or one without ``://``, has an empty host and path, no rule and
    is allowed. Repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
    """
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = urls.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
                       F.coalesce(node_of(F.col("url")), F.lit("")).alias("node"), F.coalesce("url", F.lit("")).alias("url"))
    groups = durable(connected_components(alias_edges(urls, redirects)))
    # urls that are only linked to are judged as well
    nodes = groups.select(F.col("node").alias("url"), url_host(F.col("node")).alias("host"), url_path(F.col("node")).alias("path"))
    decided = matched_rules(nodes, rules).join(groups, F.col("url") == F.col("node")).groupBy("component").agg(
        F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked"))
    own = matched_rules(rows.select("url", "host", "path").distinct(), rules)
    shared = groups.join(decided, "component", "left").select(F.col("node"), F.col("component").alias("alias_group"), "allowed", "blocked")
    method = F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return rows.join(own, "url", "left").join(shared, "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "alias_group")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(read_table(spark, sf_dir, "pages"))


def _rule_rows() -> str:
    return ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)


#: Links of the pages: canonical links with a full url; the other forms are covered by tests.
OP7_SQL = rf"""
WITH RECURSIVE rules(rule_host, rule_path, verdict) AS (VALUES {_rule_rows()}),
rows AS (
  SELECT page_id, regexp_replace(coalesce(url, ''), '#.*$', '', 's') AS node,
         lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')) AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, html
  FROM pages
), links AS (
  SELECT node AS a, unnest(regexp_extract_all(html, '<link[^>]*rel="canonical"[^>]*href="([^"#]*://[^"#]*)', 1)) AS b FROM rows
), edges AS (
  SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b
), reach AS (
  SELECT a AS node, a AS other FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.other = edges.a
), groups AS (
  SELECT node, min(other) AS alias_group FROM reach GROUP BY node
), judged AS (
  SELECT page_id, host, path, node, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS n
  FROM rows LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
), decided AS (
  SELECT alias_group, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked
  FROM judged JOIN groups USING (node) WHERE n = 1 GROUP BY alias_group
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN coalesce(allowed, FALSE) THEN 'allow' WHEN coalesce(blocked, FALSE) THEN 'block' ELSE 'allow' END) AS verdict,
       alias_group
FROM judged LEFT JOIN groups USING (node) LEFT JOIN decided USING (alias_group) WHERE n = 1
"""
