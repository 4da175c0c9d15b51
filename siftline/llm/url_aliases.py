"""URL rules, carried over to aliases through redirects and canonical links, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.components import connected_components
from siftline.session import written

#: (verdict, host and path prefix) of the registered query.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)"
_REFRESH = r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty if there is no ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?`` or ``#``; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What a redirect keeps of a url: host, path and query, without scheme and fragment; null without a host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def resolved(base: Column, link: Column) -> Column:
    """A link found on page ``base`` as an absolute url: with scheme, host-relative, root-relative or relative to the folder."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*/)[^/?#]*(?:[?#].*)?$", 1)
    folder = F.when(F.length(folder) > F.length(root), folder).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("#") | (link == ""), base)
        .otherwise(F.concat(folder, link))
    )


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as ``struct(verdict, rule)``, or null.

    A rule ``host/path`` fits that host and all its subdomains if the path starts
    with the rule's; of equally long rules the longer host wins, then allow. Rules are a
    parameter, so their number is known; data of any size is judged in place.
    """
    order = sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/"), r[0] != "allow"))
    chosen = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in reversed(order):
        on, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(start)
        chosen = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(chosen)
    return chosen


def page_edges(pages: DataFrame) -> DataFrame:
    """``(from_url, to_url)`` of every canonical link and refresh redirect in the html of ``pages(url, html)``."""
    links = F.array(
        F.regexp_extract(F.regexp_extract("html", _CANONICAL, 1), _HREF, 1),
        F.regexp_extract(F.regexp_extract("html", _REFRESH, 1), _TARGET, 1),
    )
    # only pages that have such a tag at all come to the costlier patterns
    some = pages.where(F.contains(F.lower("html"), F.lit("canonical")) | F.contains(F.lower("html"), F.lit("refresh")))
    found = some.select("url", F.explode(links).alias("link")).where("link <> ''")
    return found.select(F.col("url").alias("from_url"), resolved(F.col("url"), F.col("link")).alias("to_url"))


def url_verdicts(
    pages: DataFrame, rules: list[tuple[str, str]] = RULES, redirects: DataFrame | None = None, default: str = "allow"
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of each row of ``pages(page_id, url, html)``.

    A page's own rule decides. Without one, all urls reachable over redirect and
    canonical links (those in the pages, and ``redirects(from_url, to_url)`` if
    given; taken both ways; scheme and fragment do not matter) are aliases: if a rule
    allows any of them the page is allowed, else if one is blocked it is blocked, else
    the verdict is ``default``. Urls that were never fetched carry decisions too.

    Null urls and urls without ``://`` have an empty host and path, no rule and no
    alias. Null html has no links. Repeated rows and null ids are kept; other columns
    are not looked at; an empty table stays empty.
    """
    pages = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("from_url", "to_url"))
    ends = F.array(*(F.struct(node_of(F.col(c)).alias("node"), host_of(F.col(c)).alias("host"), path_of(F.col(c)).alias("path")) for c in ("from_url", "to_url")))
    linked = written(edges.select(ends.alias("ends")).where("ends[0].node <> ends[1].node"), "url-edges")
    # urls become numbers for the component search; the digest is checked to be one to one below
    number = lambda c: F.xxhash64(c)
    nodes = written(
        linked.select(F.explode("ends").alias("e")).select("e.*").distinct().withColumn("id", number(F.col("node"))), "url-nodes"
    )
    clashes = nodes.groupBy("id").agg(F.countDistinct("node").alias("n")).where("n > 1")
    if not clashes.isEmpty():
        raise ValueError("two urls share a digest; use another seed")
    groups = connected_components(linked.select(number(F.col("ends")[0]["node"]).alias("a"), number(F.col("ends")[1]["node"]).alias("b")))
    judged = nodes.join(groups, nodes["id"] == groups["node"]).select(
        nodes["node"].alias("node"), "component", rule_of(F.col("host"), F.col("path"), rules)["verdict"].alias("own")
    )
    judged = written(judged, "url-judged")
    decided = judged.groupBy("component").agg(
        F.when(F.max((F.col("own") == "allow").cast("int")) == 1, "allow")
        .when(F.max((F.col("own") == "block").cast("int")) == 1, "block")
        .alias("alias_verdict")
    )
    by_node = written(judged.join(decided, "component").where("alias_verdict is not null").select("node", "alias_verdict"), "url-alias")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    return (
        rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
        .join(by_node, "node", "left")
        .select(
            "page_id",
            "host",
            "path",
            F.col("own")["rule"].alias("rule"),
            F.coalesce(F.col("own")["verdict"], "alias_verdict", F.lit(default)).alias("verdict"),
        )
    )
