"""URL filters with redirect equivalence (operator 4).

A rule is (host, path, verdict): it fits its host and all subdomains where the url's path starts with the
rule's; the longest rule wins. Urls that redirect to each other, or name each other as canonical, are one
resource: connected components over those links carry a block to every alias without a rule of its own,
and an explicit allow in the component takes precedence over any block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.llm.common import Scratch, components

RULE_SCHEMA = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("verdict", T.StringType())])
#: Rules are broadcast up to this many (a few hundred bytes each); else the join on the host shuffles.
BROADCAST_RULES = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def resource_of(url: Column) -> Column:
    """What is compared to tell whether two urls are one resource: host, path and query."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(F.coalesce(url, F.lit("")).contains("://"), F.concat(host_of(url), F.lit(" "), F.when(path_of(url) == "", "/").otherwise(path_of(url)), query))


def absolute(base: Column, href: Column) -> Column:
    """A link's url: absolute, from the scheme, from the host, or next to the page. Dot segments stay as they are."""
    scheme = F.regexp_extract(base, r"^([^:/?#]*:)//", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*/)", 1)
    folder = F.when(F.length(folder) > F.length(root), folder).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(F.length(href) > 0, F.concat(folder, href))
    )


#: Tags that name another url of the page, and where each has it.
CANONICAL, REFRESH = r"""(?is)<link\b[^<>]*\brel\s*=\s*["']?canonical\b[^<>]*>""", r"""(?is)<meta\b[^<>]*\bhttp-equiv\s*=\s*["']?refresh\b[^<>]*>"""
HREF, TARGET = r"""(?is)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", r"""(?is)\burl\s*=\s*['"]?([^'">\s]+)"""


def page_links(pages: DataFrame) -> DataFrame:
    """``(source, target)`` urls: every canonical link and redirect by meta refresh in the whole of each html."""
    tags = lambda tag, part: F.transform(F.regexp_extract_all("html", F.lit(tag), 0), lambda t: F.regexp_extract(t, part, 1))
    href = F.trim(F.regexp_replace(F.regexp_replace("href", r"""^["']|["']$""", ""), "&amp;", "&"))
    hinted = pages.where(F.lower("html").contains("canonical") | F.lower("html").contains("refresh"))
    links = hinted.select("url", F.explode(F.concat(tags(CANONICAL, HREF), tags(REFRESH, TARGET))).alias("href")).withColumn("href", href).where("href <> ''")
    return links.select(F.col("url").alias("source"), absolute(F.col("url"), F.col("href")).alias("target")).where("target is not null")


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with ``host`` and ``path``) and the ``rule`` and ``by_rule`` verdict that fit best, null if none does.

    The longest rule wins; of two as long, an allow, then the first by code point.
    """
    known = rules.select(F.translate("host", UPPER, LOWER).alias("__rule_host"), F.coalesce("path", F.lit("")).alias("__rule_path"), F.col("verdict").alias("__rule_verdict"))
    n = known.count()
    hosts = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = hosts.withColumn("__end", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    hit = ends.join(F.broadcast(known) if n <= BROADCAST_RULES else known, F.col("__end") == F.col("__rule_host")).where(F.col("path").startswith(F.col("__rule_path")))
    text = F.concat("__rule_host", "__rule_path")
    key = F.struct((-F.length(text)).alias("n"), F.when(F.col("__rule_verdict") == "allow", 0).otherwise(1).alias("o"), text.alias("rule"), F.col("__rule_verdict").alias("by_rule"))
    best = hit.groupBy("host", "path").agg(F.min(key).alias("b")).select("host", "path", F.col("b.rule").alias("rule"), F.col("b.by_rule").alias("by_rule"))
    return urls.join(best, ["host", "path"], "left")


def verdicts(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    ``links(source, target)`` are known redirects and canonical links; by default those in the pages'
    html. A page with a rule has the rule's verdict. Without one it is blocked if its component of
    aliases, pages or not, holds a blocked url and no allowed one, and allowed else. A null url, or one
    without ``://``, has empty host and path, no rule and no alias. Repeated rows are judged alike.
    An empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col("url")
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), resource_of(url).alias("resource"))
    base = scratch.save(base)
    found = links if links is not None else page_links(pages)
    ends = scratch.save(found.select(resource_of(F.col("source")).alias("a"), resource_of(F.col("target")).alias("b")).where("a is not null and b is not null and a <> b").distinct())
    known = judged(base, rules)
    if not ends.limit(1).count():  # no alias anywhere: every component is one url
        return known.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"))
    roots = components(scratch, ends)
    nodes = roots.select(F.col("node").alias("resource"), "root", F.split("node", " ")[0].alias("host"), F.regexp_extract("node", r"(?s)^\S* ([^?]*)", 1).alias("path"))
    said = judged(nodes, rules).groupBy("root").agg(F.max(F.when(F.col("by_rule") == "allow", 1).otherwise(0)).alias("allowed"), F.max(F.when(F.col("by_rule") == "block", 1).otherwise(0)).alias("blocked"))
    alias = scratch.save(roots.join(said, "root").where("blocked = 1 and allowed = 0").select(F.col("node").alias("resource"), F.lit("block").alias("by_alias")))
    out = known.join(alias, "resource", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_alias", F.lit("allow")).alias("verdict"))


#: The rules of the query (fixed values).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: The same rows in DuckDB's SQL.
SQL = r"""
WITH RECURSIVE rules(rhost, rpath, said) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), tags AS (
  SELECT DISTINCT url, regexp_extract(unnest(regexp_extract_all(html, '<link\b[^<>]*\brel\s*=\s*["'']?canonical\b[^<>]*>', 0, 'is')), '\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1, 'is') AS href FROM pages
  UNION
  SELECT url, regexp_extract(unnest(regexp_extract_all(html, '<meta\b[^<>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^<>]*>', 0, 'is')), '\burl\s*=\s*[''"]?([^''">\s]+)', 1, 'is') FROM pages
), hrefs AS (
  SELECT url, trim(replace(regexp_replace(href, '^["'']|["'']$', '', 'g'), '&amp;', '&'), ' ') AS href FROM tags
), targets AS (
  SELECT url AS source, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^([^:/?#]*:)//', 1) || href
    WHEN href LIKE '/%' THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || href
    WHEN regexp_matches(url, '^.*?://[^?#]*/', 's') AND regexp_matches(url, '^.*?://[^/?#]*/', 's') THEN regexp_extract(url, '^(.*?://[^?#]*/)', 1, 's') || href
    ELSE regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || '/' || href END AS target FROM hrefs WHERE href <> ''
), urls AS (
  SELECT url FROM pages UNION SELECT source FROM targets UNION SELECT target FROM targets
), parts AS (
  SELECT url, host, path, host || ' ' || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(url, '^.*?://[^?#]*(\?[^#]*)', 1, 's') AS resource, contains(coalesce(url, ''), '://') AS whole FROM (
    SELECT url, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM urls)
), links AS (
  SELECT s.resource AS a, t.resource AS b FROM targets l JOIN parts s ON s.url = l.source JOIN parts t ON t.url = l.target WHERE s.whole AND t.whole AND s.resource <> t.resource
), ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (
  SELECT a, b FROM ways UNION SELECT r.a, l.b FROM reach r JOIN ways l ON r.b = l.a
), fits AS (
  SELECT host, path, rhost || rpath AS rule, said, row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC, said, rhost || rpath) AS r
  FROM (SELECT DISTINCT host, path FROM parts UNION SELECT split_part(a, ' ', 1), regexp_extract(a, '^\S* ([^?]*)', 1, 's') FROM reach) JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)
), said AS (
  SELECT n.resource, f.said FROM (SELECT DISTINCT a AS resource, split_part(a, ' ', 1) AS host, regexp_extract(a, '^\S* ([^?]*)', 1, 's') AS path FROM reach) n JOIN fits f ON f.host = n.host AND f.path = n.path AND r = 1
), passed AS (
  SELECT reach.a AS resource, bool_or(s.said = 'block') AND NOT bool_or(s.said = 'allow') AS blocked FROM reach JOIN said s ON s.resource = reach.b GROUP BY reach.a
)
SELECT page_id, p.host, p.path, f.rule, coalesce(f.said, CASE WHEN d.blocked THEN 'block' END, 'allow') AS verdict
FROM pages g JOIN parts p ON p.url IS NOT DISTINCT FROM g.url LEFT JOIN fits f ON f.host = p.host AND f.path = p.path AND f.r = 1 LEFT JOIN passed d ON d.resource = p.resource AND p.whole
"""
