"""URL filters (operator 6): block decisions spread over redirect and canonical-link equivalence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import components

#: (verdict, host, path); a rule fits its host with all subdomains and paths that start with its own.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Behind the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    found = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to ? or #; empty without ://."""
    return F.coalesce(F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def key_of(url: Column) -> Column:
    """Node of a URL: host without a default port, path (/ if empty) and query; scheme and fragment don't count."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)
    host = F.regexp_replace(host_of(url), ":(80|443)$", "")
    return F.when(host != "", F.concat(host, F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url)), query))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does. For lists of up to some hundred rules."""
    whens = []
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        whens.append(F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*whens)


def resolve(base: Column, link: Column) -> Column:
    """An absolute URL for a link on the page base; dot segments stay as they are."""
    link = F.trim(F.regexp_replace(link, "&amp;", "&"))
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    return (
        F.when((link == "") | link.startswith("#"), F.lit(None))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("?"), F.concat(root, path_of(base), link))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def declared_links(url: Column, html: Column) -> Column:
    """URLs to which a page's canonical link and meta refresh point; the page is searched only if it names them."""

    def first(tag: str, kind: str, value: str) -> Column:
        tags = F.filter(F.regexp_extract_all(html, F.lit(rf"(?i)<{tag}\b[^>]*>"), F.lit(0)), lambda t: t.rlike(kind))
        return F.regexp_extract(F.get(tags, F.lit(0)), value, 1)

    href = first("link", r"(?i)\brel\s*=\s*[\"']?canonical\b", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]*)")
    to = first("meta", r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b", r"(?i)\bcontent\s*=\s*[\"'][^\"'>]*?\burl\s*=\s*([^\"'\s>]*)")
    found = [F.when(html.rlike(f"(?i){word}"), x) for word, x in (("canonical", href), ("http-equiv", to))]
    return F.filter(F.array(*[resolve(url, x) for x in found]), lambda x: x.isNotNull())


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Verdicts on URLs: id, host, path, rule, verdict, inherited.

    A URL that a rule fits gets the verdict of the longest one. URLs that redirects (columns from_url, to_url), meta
    refreshes or canonical links connect, over any number of steps, are equivalent: one without a rule is allowed if a
    rule allows any equivalent URL, blocked if a rule blocks one and none allows one, and allowed otherwise.

    A null URL, or one without ://, has empty host and path and is never connected. Rows with the same URL are judged
    alike; an empty table gives no rows; other columns are ignored.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), declared_links(F.col(url_col), F.col(html_col)).alias("links"))
    own = own.select("id", "url", "links", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("key"))
    own = materialize(own.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)), "urls")
    links = own.select(F.col("url").alias("from_url"), F.explode("links").alias("to_url"))
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url"))
    links = links.select(key_of(F.col("from_url")).alias("a"), key_of(F.col("to_url")).alias("b"), F.array("from_url", "to_url").alias("urls"))
    links = materialize(links.filter("a is not null and b is not null"), "url-links")
    groups = components(links)
    urls = links.select(F.explode("urls").alias("url")).distinct().withColumn("own", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules))
    said = urls.filter("own is not null").select(key_of(F.col("url")).alias("node"), F.col("own.verdict").alias("said"))
    said = groups.join(said, "node").groupBy("component").agg(F.max(F.col("said") == "allow").alias("allowed"))
    inherited = groups.join(said, "component").select(F.col("node").alias("n"), F.when(F.col("allowed"), "allow").otherwise("block").alias("inherited"))
    out = own.join(inherited, F.col("key") == F.col("n"), "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "inherited", F.lit("allow")).alias("verdict"), "inherited")


def op6_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    def host(u: str) -> str:
        return f"CASE WHEN contains({u}, '://') THEN translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') ELSE '' END"

    def path(u: str) -> str:
        return f"CASE WHEN contains({u}, '://') THEN regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END"

    def rule(column: str) -> str:
        fits = [(len(h + p), f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if column == 'rule' else v}'") for v, h, p in RULES]
        return "CASE " + " ".join(x for _, x in sorted(fits, key=lambda x: -x[0])) + " END"

    key = r"CASE WHEN host <> '' THEN regexp_replace(host, ':(80|443)$', '') || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)?', 1) END"
    tag = "list_filter(regexp_extract_all(html, '(?i)<{0}\\b[^>]*>'), lambda t: regexp_matches(t, '{1}'))[1]"
    href = f"regexp_extract({tag.format('link', '(?i)\\brel\\s*=\\s*["'']?canonical\\b')}, '(?i)\\bhref\\s*=\\s*[\"'']?([^\"''\\s>]*)', 1)"
    to = f"regexp_extract({tag.format('meta', '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')}, '(?i)\\bcontent\\s*=\\s*[\"''][^\"''>]*?\\burl\\s*=\\s*([^\"''\\s>]*)', 1)"
    return f"""
WITH RECURSIVE p AS (SELECT page_id, url, {host('url')} AS host, {path('url')} AS path, html FROM pages),
k AS (SELECT page_id, url, host, path, {key} AS key, {rule('rule')} AS rule, {rule('verdict')} AS own, unnest([trim(replace({href}, '&amp;', '&')), trim(replace({to}, '&amp;', '&'))]) AS link FROM p),
r AS (SELECT *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme FROM k WHERE coalesce(link, '') <> '' AND NOT starts_with(link, '#')),
t AS (SELECT url AS from_url, key AS a,
        CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN scheme || ':' || link
             WHEN starts_with(link, '/') THEN scheme || '://' || host || link WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
             WHEN starts_with(link, '?') THEN scheme || '://' || host || path || link
             ELSE scheme || '://' || host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || link END AS url
      FROM r),
u AS (SELECT from_url, a, url, {host('url')} AS host, {path('url')} AS path FROM t),
e AS (SELECT a, {key} AS b FROM u WHERE a IS NOT NULL AND host <> ''),
said AS (SELECT {key} AS node, {rule('verdict')} AS said FROM u WHERE host <> '' UNION SELECT key, own FROM k WHERE key IN (SELECT a FROM e)),
pair AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS other FROM pair UNION SELECT r.node, pair.b FROM reach r JOIN pair ON r.other = pair.a),
inherited AS (SELECT reach.node, CASE WHEN bool_or(said = 'allow') THEN 'allow' WHEN bool_or(said = 'block') THEN 'block' END AS inherited
              FROM reach JOIN said ON reach.other = said.node WHERE said IS NOT NULL GROUP BY reach.node)
SELECT DISTINCT page_id, host, path, rule, coalesce(own, inherited, 'allow') AS verdict, inherited FROM k LEFT JOIN inherited ON k.key = inherited.node
"""


QUERIES = {"op6_redirect_equivalence": op6_redirect_equivalence}
ORACLES = {"op6_redirect_equivalence": _sql()}
