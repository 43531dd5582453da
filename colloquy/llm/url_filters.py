"""URL filters with redirect equivalence.

Pages are joined to their aliases by declared edges only: every ``<link rel="canonical">`` and
``<meta http-equiv="refresh">`` target of a page, in any case of letters, and rows of an optional redirect table.  Connected components
over these edges form alias groups.  A page that a rule fits takes that rule's verdict.  A page that
no rule fits is allowed if any member of its group is allowed by a rule, else blocked if any member
is blocked, else allowed.

Cases: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed; null
html declares no edge; repeated rows are judged alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import cut
from colloquy.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
MAY_DECLARE = r"(?i)canonical|http-equiv"
LINK_TAG = r"(?is)<link\b[^>]*>"
#: ``rel`` is a list of words, of which one is "canonical".
IS_CANONICAL = r"(?is)\brel\s*=\s*(?:\"(?:[^\"]*\s)?canonical(?:\s[^\"]*)?\"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s/>])"
META_TAG = r"(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"

#: (rule, host, path, verdict)
RULES = (
    ("com/en/", "com", "/en/", "block"),
    ("example.com/en/7", "example.com", "/en/7", "allow"),
    ("net/de/", "net", "/de/", "allow"),
    ("example.net/de/8", "example.net", "/de/8", "block"),
    ("org/es/", "org", "/es/", "block"),
)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL_PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as (rule, verdict); null if none fits."""
    out = None
    for name, rule_host, rule_path, verdict in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        value = F.struct(F.lit(name).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def address(url: Column) -> Column:
    """Node of the alias graph: the url without its fragment, scheme and host in lower case."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    tail = F.substring(bare, F.length(head) + 1, F.length(bare))
    return F.when(head != "", F.concat(F.translate(head, UPPER, LOWER), tail))


def _absolute(target: Column, url: Column) -> Column:
    target = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target != "", F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), target))
    )


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Edges (u, v) between addresses that pages, and rows (source, target) of ``redirects``, declare."""
    url, html = F.col("url"), F.col("html")
    links = F.filter(F.regexp_extract_all(html, F.lit(LINK_TAG), F.lit(0)), lambda tag: tag.rlike(IS_CANONICAL))
    canonical = F.transform(links, lambda tag: F.regexp_extract(tag, HREF, 1))
    refresh = F.transform(F.regexp_extract_all(html, F.lit(META_TAG), F.lit(0)), lambda tag: F.regexp_extract(tag, REFRESH_URL, 1))
    edges = (
        # a plain search spares the pages, nearly all, that hold neither tag
        pages.where(html.rlike(MAY_DECLARE))
        .select(url, F.explode(F.concat(canonical, refresh)).alias("to"))
        .where("`to` <> ''")
        .select(address(url).alias("u"), address(_absolute(F.col("to"), url)).alias("v"))
    )
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("source")).alias("u"), address(F.col("target")).alias("v")))
    return edges.where("u <> v")


def filter_urls(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Judge each page: page_id, host, path, rule, verdict, component (null outside alias groups)."""
    judged = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    judged = judged.withColumn("hit", best_rule(F.col("host"), F.col("path"), rules))
    edges = cut(alias_edges(pages, redirects), "url_edges")
    if edges.isEmpty():
        return judged.select(
            "page_id", "host", "path", F.col("hit.rule").alias("rule"),
            F.coalesce(F.col("hit.verdict"), F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("component"),
        )
    groups = cut(connected_components(edges), "url_groups")
    # every address counts, also one that is only pointed to
    ruled = best_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    decided = cut(
        groups.withColumn("v", ruled)
        .groupBy("component")
        .agg(F.bool_or(F.col("v") == "allow").alias("allowed"), F.bool_or(F.col("v") == "block").alias("blocked"))
        .select("component", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("allow").alias("shared")),
        "url_decided",
    )
    members = cut(groups.join(decided, "component").select("node", "component", "shared"), "url_members")
    return (
        judged.withColumn("node", address(F.col("url")))
        .join(members, "node", "left")
        .select(
            "page_id", "host", "path", F.col("hit.rule").alias("rule"),
            F.coalesce(F.col("hit.verdict"), F.col("shared"), F.lit("allow")).alias("verdict"), "component",
        )
    )
