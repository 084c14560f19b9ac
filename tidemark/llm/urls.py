"""URL filters: host and path rules, and block decisions that follow redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, stage

Rule = tuple[str, str, str]  # verdict, host, path

#: The rules of the registered query.
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and for a text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fits(host: Column, path: Column, rule: Rule) -> Column:
    _, rule_host, rule_path = rule
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def ruled(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds host, path, rule and rule_verdict (both null where none fits).

    The longest rule wins, counted in characters of host and path; among equal
    lengths the longer host, then allow.  The rules are a list in the program,
    tried from the longest down within one generated expression.
    """
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0]))
    none = F.lit(None).cast("string")
    rule, verdict = none, none
    for r in reversed(order):
        test = fits(F.col("host"), F.col("path"), r)
        rule, verdict = F.when(test, r[1] + r[2]).otherwise(rule), F.when(test, r[0]).otherwise(verdict)
    host, path = host_and_path(F.col("url"))
    return pages.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "rule_verdict": verdict})


def node(url: Column) -> Column:
    """What a url names, whatever its scheme or fragment: host, path and query; null where there is no host."""
    host, _ = host_and_path(url)
    rest = F.regexp_extract(F.substr(url, F.instr(url, "://") + F.lit(3)), r"^[^/?#]*([^#]*)", 1)
    return F.when((F.instr(url, "://") > 0) & (host != ""), F.concat(host, F.when(rest == "", F.lit("/")).otherwise(rest)))


def resolved(base: Column, link: Column) -> Column:
    """A link made absolute: full, scheme-relative, rooted, or relative to the folder of ``base``."""
    scheme = F.regexp_extract(base, r"^([^:/?#]*://)", 1)
    origin = F.regexp_extract(base, r"^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^([^:/?#]*://[^?#]*)", 1), r"(://[^/]+)$|([^/]*)$", "$1")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_replace(scheme, "//$", ""), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(F.length(link) > 0, F.concat(F.regexp_replace(folder, "/?$", "/"), link))
    )


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst) between nodes: canonical links and refresh redirects in the html, and rows (from_url, to_url) of ``redirects``."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    found = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", F.explode(tags).alias("tag"))
    href = F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)""", 1)
    refresh = F.regexp_extract("tag", r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*['"]?([^"'\s>]+)""", 1)
    link = F.when(F.col("tag").rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""), href).when(F.col("tag").rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?\s*refresh\b"""), refresh)
    links = found.select("url", F.regexp_replace(link, "&amp;", "&").alias("link")).where(F.length("link") > 0).select(F.col("url").alias("from_url"), resolved(F.col("url"), F.col("link")).alias("to_url"))
    links = stage(links, "links")
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url"))
    edges = links.select(node(F.col("from_url")).alias("src"), node(F.col("to_url")).alias("dst"))
    return edges.dropna().where("src <> dst").distinct()


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_class) per row.

    A url that a rule fits gets that rule's verdict, so an explicit allow holds
    whatever its aliases are.  Any other url is blocked if one of its aliases,
    the urls reachable over redirects and canonical links either way, is blocked
    by a rule, else allowed.  Linked urls that are no pages count as aliases.
    Null urls, urls without ``://`` and null html link nothing; repeated rows
    stay; no rows give none; other columns are dropped.
    """
    page = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = ruled(page.select("page_id", "url"), rules).withColumn("node", node(F.col("url")))
    edges = stage(alias_edges(page, redirects), "aliases")
    linked = components(edges)
    # A node is a url without its scheme, so the rules are asked again for it.
    status = ruled(linked.withColumn("url", F.concat(F.lit("x://"), "node")), rules).select("node", "component", F.when(F.col("rule_verdict") == "block", 1).otherwise(0).alias("blocked"))
    classes = status.groupBy("component").agg(F.max("blocked").alias("blocked"))
    labels = stage(status.select("node", "component").join(classes, "component"), "classes")
    verdict = F.coalesce("rule_verdict", F.when(F.col("blocked") == 1, "block"), F.lit("allow"))
    return out.join(labels, "node", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("component").alias("alias_class"))


#: The rules in SQL.  The html of the given tables has no canonical or refresh links, so no verdict
#: there comes from an alias; those are tested against a brute-force closure.
ORACLE = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM h
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict, CAST(NULL AS VARCHAR) AS alias_class FROM r
"""
