"""URL filters with redirect equivalence, in DataFrame operations only.

A rule (host, path, action) fits a URL whose host is the rule's or one of its subdomains and
whose path starts with the rule's; the longest fitting rule decides. A URL that no rule decides
takes the method's verdict: pages that name one another by canonical links or redirects are
aliases, a component of aliases with a blocked member blocks its undecided members, and a member
that a rule allows stays allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.session import Scratch, table

from .components import connected_components
from .exact_dedup import LOWER, UPPER

#: (host, path, action)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: More rules than this are joined by host, not written into the plan.
INLINE_RULES = 200

CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
TARGET = r"(?is)\burl\s*=\s*['\"]?([^\"'>\s]+)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for a URL without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_key(url: Column) -> Column:
    """What two URLs of one page share: host, path and query. Null without ://."""
    host, path = split_url(url)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), query))


def absolute(target: Column, base: Column) -> Column:
    """target as seen from the page base: absolute, without scheme, from the root, or from base's folder."""
    host, path = split_url(base)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    return (
        F.when(F.instr(target, "://") > 0, target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(F.lit("http://"), host, target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#|^$"), F.lit(None))
        .otherwise(F.concat(F.lit("http://"), host, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v): the keys of pages and of what their canonical links and refreshes point to."""
    href = lambda tag: F.concat(*(F.coalesce(F.regexp_extract(tag, HREF, i), F.lit("")) for i in (1, 2, 3)))
    tags = F.concat(
        F.transform(F.regexp_extract_all("html", F.lit(CANONICAL), 0), href),
        F.transform(F.regexp_extract_all("html", F.lit(REFRESH), 0), lambda tag: F.regexp_extract(tag, TARGET, 1)),
    )
    some = pages.where(F.col("html").rlike(r"(?i)canonical|refresh"))
    links = some.select("url", F.explode(tags).alias("target")).where("target <> ''")
    return links.select(url_key(F.col("url")).alias("u"), url_key(absolute(F.replace("target", F.lit("&amp;"), F.lit("&")), F.col("url"))).alias("v"))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, action) of the longest rule that fits, else null. Of equally long ones the later text wins."""
    found = F.array(*(
        F.when(
            ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(a).alias("action")),
        )
        for h, p, a in rules
    ))
    return F.array_max(found)


def with_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """urls (key, host, path, ...) with the columns rule and action. key tells rows apart."""
    if not rules:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})
    if len(rules) <= INLINE_RULES:
        return urls.withColumn("_best", best_rule(F.col("host"), F.col("path"), rules)).withColumns({"rule": F.col("_best.rule"), "action": F.col("_best.action")}).drop("_best")
    listed = urls.sparkSession.createDataFrame(rules, "r_host string, r_path string, r_action string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = (
        urls.select("key", "path", F.explode(suffixes).alias("r_host"))
        .join(listed, "r_host")
        .where(F.startswith("path", F.col("r_path")))
        .groupBy("key")
        .agg(F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("size"), F.concat("r_host", "r_path").alias("rule"), F.col("r_action").alias("action"))).alias("_best"))
    )
    return urls.join(hits, "key", "left").withColumns({"rule": F.col("_best.rule"), "action": F.col("_best.action")}).drop("_best")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, decided_by) for every row of pages (page_id, url, html, ...).

    redirects (source, target) adds known redirects to those in html. Null url or html, and
    links to themselves or without ://, add no alias. Rows with the same page_id or url are
    judged one by one. Pages without rule and without a blocked alias are allowed.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    host, path = split_url(F.col("url"))
    judged = with_rules(pages.select("page_id", F.monotonically_increasing_id().alias("key"), url_key(F.col("url")).alias("node"), host.alias("host"), path.alias("path")), rules)
    edges = alias_edges(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(url_key(F.col("source")).alias("u"), url_key(F.col("target")).alias("v")))
    edges = scratch.save(edges.where("u <> v").distinct(), "aliases")
    blocked = F.lit(False)
    if not edges.isEmpty():
        nodes = connected_components(edges, scratch)
        at, rest = split_url(F.concat(F.lit("http://"), F.col("node")))
        ruled = with_rules(nodes.select("node", "component", F.col("node").alias("key"), at.alias("host"), rest.alias("path")), rules)
        bad = ruled.where("action = 'block'").select("component").distinct()
        aliases = nodes.join(bad, "component", "left_semi").select("node", F.lit(True).alias("blocked"))
        judged = judged.join(scratch.save(aliases, "blocked"), "node", "left")
        blocked = F.coalesce("blocked", F.lit(False))
    verdict = F.coalesce("action", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))
    decided = F.when(F.col("rule").isNotNull(), "rule").when(blocked, "alias").otherwise("default")
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), decided.alias("decided_by"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).drop("decided_by")


SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
    CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, url, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS q FROM p),
rules(host, path, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
pk AS (SELECT page_id, host || CASE WHEN path = '' THEN '/' ELSE path END || q AS k, host, path, html FROM u WHERE position('://' IN coalesce(url, '')) > 0),
t AS (
  SELECT k, host, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda g: regexp_extract(g, '(?is)\bhref\s*=\s*["'']?([^\s"''>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda g: regexp_extract(g, '(?is)\burl\s*=\s*[''"]?([^"''>\s]+)', 1)))) AS target FROM pk),
a AS (SELECT k, regexp_replace(CASE WHEN position('://' IN target) > 0 THEN substr(target, position('://' IN target) + 3) ELSE host || target END, '#.*$', '') AS v
  FROM t WHERE position('://' IN target) > 0 OR target LIKE '/%'),
e AS (SELECT k AS x, v AS y FROM a UNION SELECT v, k FROM a),
reach(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
bad AS (
  SELECT DISTINCT n FROM (SELECT y AS n, (SELECT arg_max(action, length(r.host || r.path)) FROM rules r
    WHERE (regexp_extract(y, '^([^/?#]*)', 1) = r.host OR suffix(regexp_extract(y, '^([^/?#]*)', 1), '.' || r.host)) AND starts_with(regexp_extract(y, '^[^/?#]*([^?#]*)', 1), r.path)) AS act
    FROM (SELECT DISTINCT y FROM reach)) WHERE act = 'block'),
b AS (SELECT DISTINCT x FROM reach JOIN bad ON reach.y = bad.n),
m AS (
  SELECT u.page_id, u.host, u.path, pk.k,
    (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM rules r WHERE (u.host = r.host OR suffix(u.host, '.' || r.host)) AND starts_with(u.path, r.path)) AS rule,
    (SELECT arg_max(r.action, length(r.host || r.path)) FROM rules r WHERE (u.host = r.host OR suffix(u.host, '.' || r.host)) AND starts_with(u.path, r.path)) AS action
  FROM u LEFT JOIN pk ON u.page_id = pk.page_id)
SELECT m.page_id, m.host, m.path, m.rule, coalesce(m.action, CASE WHEN b.x IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM m LEFT JOIN b ON m.k = b.x
"""
