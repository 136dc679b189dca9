"""URL rules whose block decisions also reach a page's aliases.

A url is judged by the longest rule that fits it. Urls that redirect to each other or name each
other as canonical form a class of aliases (connected components over those edges); a url without
a rule of its own takes the decision of its class, in which an explicit allow goes before a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, pages, small, written
from .components import connected_components

#: (verdict, host, path prefix); fixed values of the production query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Tags that may link a page to an alias, and what they link to by their kind.
TAG = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = (r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
REFRESH = (r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b", r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*['\"]?([^\"'\s>]+)")


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, in lower case; empty for null and for a url without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """What two spellings of one address share: host, path and query, without scheme and fragment. Null without ://."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), path_of(url), query))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule (host and path together) that fits; null if none does.

    A rule fits its host and the subdomains of it. The rules become one conditional expression, so
    they are meant to be some hundreds at most.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def absolute(link: Column, base: Column) -> Column:
    """link as seen from the page at base: with a scheme, from //host, from the root, or from base's folder."""
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*/)", 1)
    folder = F.when(F.length(folder) > F.length(root), folder).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(folder, link))
    )


def alias_edges(table: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): keys of a page's url and of each url that it redirects to or names as canonical, in any of its tags."""
    u, body = F.col(url), F.replace(F.col(html), F.lit("&amp;"), F.lit("&"))
    marked = table.where(F.lower(F.col(html)).rlike("canonical|http-equiv")).where(F.instr(u, "://") > 0)
    tags = marked.select(u.alias("u"), F.explode(F.regexp_extract_all(body, F.lit(TAG), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    to = F.when(tag.rlike(CANONICAL[0]), F.regexp_extract(tag, CANONICAL[1], 1)).when(tag.rlike(REFRESH[0]), F.regexp_extract(tag, REFRESH[1], 1))
    links = tags.select("u", to.alias("link")).where("link <> ''")
    return links.select(alias_key(F.col("u")).alias("a"), alias_key(absolute(F.col("link"), F.col("u"))).alias("b")).where("a <> b and b is not null").distinct()


def alias_verdicts(edges: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(key, verdict) of urls in a class that has a decision; both ends of an edge count as members, in the table or not."""
    classes = connected_components(edges)
    full = F.concat(F.lit("x://"), F.col("node"))
    own = rule_of(host_of(full), path_of(full), rules)["verdict"]
    judged = classes.withColumn("own", own)
    decided = judged.where("own is not null").groupBy("component").agg(F.min("own").alias("verdict"))  # allow sorts before block
    return judged.join(decided, "component").select(F.col("node").alias("key"), "verdict")


def judge(table: DataFrame, redirects: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, host, path, rule and verdict of every row. Html of any length is looked through as a whole.

    A null url or one without :// has an empty host and path, no rule and is allowed. redirects may
    hold more edges (from_url, to_url), of which rows with nulls are ignored. Repeated rows are
    judged alike, each for itself; other columns of the table are not looked at.
    """
    edges = alias_edges(table, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(alias_key(F.col("from_url")).alias("a"), alias_key(F.col("to_url")).alias("b")))
    edges = written(edges, "aliases")
    rows = table.select(F.col(key).alias(key), F.col(url).alias("_url")).select(key, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), alias_key(F.col("_url")).alias("_alias"), "_url").withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    decided = written(alias_verdicts(edges, rules).where("verdict = 'block'"), "decided")
    # a url without a key matches nothing: a key has no #, and such rows are not to meet in one task
    rows = rows.withColumn("_alias", F.coalesce("_alias", F.concat(F.lit("#"), F.xxhash64(key, "_url").cast("string")))).drop("_url")
    out = rows.join(small(decided.select(F.col("key").alias("_alias"), F.col("verdict").alias("_class"))), "_alias", "left")
    return out.select(key, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", "_class", F.lit("allow")).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() on every page by the production rules; nulls, repeats and empty tables as there."""
    return judge(pages(spark, sf_dir))


OP5_SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html, lower(html) AS low,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS query
  FROM pages),
tags AS (SELECT page_id, url, host, path, query, unnest(regexp_extract_all(replace(html, '&amp;', '&'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM u WHERE contains(low, 'canonical') OR contains(low, 'http-equiv')),
links AS (SELECT url, host || path || query AS a,
    CASE WHEN regexp_matches(tag, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
         WHEN regexp_matches(tag, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*[''"]?([^"''\s>]+)', 1) END AS link FROM tags WHERE contains(url, '://')),
full_links AS (SELECT a, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN 'http:' || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || link
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN length(regexp_extract(url, '(?s)^(.*?://[^?#]*/)', 1)) > length(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1)) THEN regexp_extract(url, '(?s)^(.*?://[^?#]*/)', 1) || link
    ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || '/' || link END AS t FROM links WHERE link <> ''),
edges AS (SELECT DISTINCT a, translate(regexp_extract(t, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(t, '(?s)^.*?://[^/?#]*([^?#]*)', 1) || regexp_extract(t, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS b FROM full_links WHERE t IS NOT NULL),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
node_rule AS (SELECT n.node, (SELECT max_by(verdict, length(h || p)) FROM rules WHERE (split_part(n.node, '/', 1) = h OR ends_with(split_part(n.node, '/', 1), '.' || h)) AND starts_with(substr(n.node, length(split_part(n.node, '/', 1)) + 1), p)) AS v FROM (SELECT DISTINCT node FROM reach) n),
class AS (SELECT r.node, min(n.v) AS v FROM reach r JOIN node_rule n ON n.node = r.other GROUP BY 1),
own AS (SELECT page_id, host, path, CASE WHEN contains(url, '://') THEN host || path || query END AS k FROM u),
best AS (SELECT o.page_id, max_by(r.h || r.p, length(r.h || r.p)) AS rule, max_by(r.verdict, length(r.h || r.p)) AS verdict FROM own o JOIN rules r ON (o.host = r.h OR ends_with(o.host, '.' || r.h)) AND starts_with(o.path, r.p) GROUP BY 1)
SELECT o.page_id, o.host, o.path, b.rule, coalesce(b.verdict, c.v, 'allow') AS verdict
FROM own o LEFT JOIN best b USING (page_id) LEFT JOIN class c ON c.node = o.k
"""
