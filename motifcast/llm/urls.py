"""URL filter: rules by host and path, and redirect equivalence, in DataFrame functions only.

A page's URL is linked with the targets of its canonical link and its meta refresh, and with those of a table of redirects
if there is one. Connected components of these links are aliases of one resource. A URL that a rule blocks blocks all its
aliases, but for those that a rule allows explicitly: a rule on a page's own URL always comes first.

Defined cases: a URL that is null or has no ``://`` has an empty host and path, no rule, no aliases, and is allowed; relative
targets are resolved against the page's URL; fragments do not distinguish URLs; repeated URLs share one node, however many
rows they have; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifcast.llm.common import checkpointed, documents
from motifcast.llm.components import components

#: (verdict, host and path): a rule fits its host and all subdomains, if the URL's path starts with the rule's.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _target(html: Column) -> Column:
    """Targets of canonical links and meta refreshes, as written."""
    attribute = lambda tag, name: F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']?([^\"'>\s]+)", 1)
    canonical = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), F.lit(0)), lambda t: attribute(t, "href"))
    refresh = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), F.lit(0)), lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'>\s]+)", 1))
    return F.concat(canonical, refresh)


def _absolute(url: Column, target: Column) -> Column:
    scheme, site = F.regexp_extract(url, r"^([^/?#]*:)//", 1), F.regexp_extract(url, r"^([^/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^([^/?#]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(F.instr(target, "://") > 0, target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(F.when(folder.endswith("/") & (F.char_length(folder) > F.char_length(site)), folder).otherwise(F.concat(site, F.lit("/"))), target))
    )


def node(url: Column) -> Column:
    """A URL as a node: without its fragment, with the host in lower case."""
    head = F.regexp_extract(url, r"^([^/?#]*://[^/?#]*)", 1)
    return F.concat(F.translate(head, _UPPER, _LOWER), F.regexp_extract(url, r"^[^/?#]*://[^/?#]*([^#]*)", 1))


def alias_links(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Distinct links (a, b) between nodes: canonical links, refreshes, and (from_url, to_url) of ``redirects``."""
    found = pages.where((F.instr("url", "://") > 0) & F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", F.explode(_target(F.col("html"))).alias("target")).where(F.col("target") != "")
    links = found.select(node(F.col("url")).alias("a"), node(_absolute(F.col("url"), F.col("target"))).alias("b"))
    if redirects is not None:
        links = links.unionByName(redirects.select(node(F.col("from_url")).alias("a"), node(F.col("to_url")).alias("b")))
    return links.where((F.col("a") != "") & (F.col("b") != "") & (F.col("a") != F.col("b"))).distinct()


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, component (null without aliases)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    alias = components(alias_links(pages, redirects))
    host, path = host_and_path(F.col("node"))
    judged = checkpointed(alias.withColumn("own", rule_of(host, path, rules)["verdict"]))
    blocked = judged.groupBy("component").agg(F.max(F.col("own") == "block").alias("blocked")).where("blocked")
    aliases = judged.join(blocked, "component", "left").select("node", "component", "blocked")
    host, path = host_and_path(F.col("url"))
    out = pages.select("page_id", F.when(F.instr("url", "://") > 0, node(F.col("url"))).alias("node"), host.alias("host"), path.alias("path"))
    out = out.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).join(aliases, "node", "left")
    verdict = F.coalesce("found.verdict", F.when(F.col("blocked"), "block"), F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "component")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(documents(spark, sf_dir, "pages")).drop("component")


ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), q AS (
  SELECT page_id, url, html,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM p
), rules(verdict, rule, rhost, rpath) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), fit AS (
  SELECT q.page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM q JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY q.page_id
), raw AS (
  SELECT url AS a, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([a-z]+://[^"''>\s#]+)', 1)) AS b
  FROM q WHERE instr(url, '://') > 0
), link AS (
  SELECT regexp_extract(a, '^([^#]*)', 1) AS a, b FROM raw
), pair AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach(a, b) AS (
  SELECT a, b FROM pair UNION SELECT r.a, e.b FROM reach r JOIN pair e ON r.b = e.a
), bad AS (
  SELECT DISTINCT r.a FROM reach r JOIN q ON regexp_extract(q.url, '^([^#]*)', 1) = r.b JOIN fit USING (page_id) WHERE fit.verdict = 'block'
)
SELECT q.page_id, q.host, q.path, fit.rule,
       coalesce(fit.verdict, CASE WHEN bad.a IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM q LEFT JOIN fit USING (page_id) LEFT JOIN bad ON bad.a = regexp_extract(q.url, '^([^#]*)', 1)
"""
