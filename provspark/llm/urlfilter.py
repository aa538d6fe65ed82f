"""URL rules, and block decisions carried to the aliases of a page; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import materialize
from provspark.llm.components import connected_components

#: (host, path, action): the production rules.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: A tag ends at the next < or >, so that unclosed tags are read once.
_TAG = r"(?is)<(?:link|meta)\b[^<>]*>"
_REL = r"(?is)^<link\b.*\brel\s*=\s*[\"']?\s*canonical\b"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_META = r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
_META_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(size, rule, action), or null. ``rules`` is configuration, part of the plan."""
    found = F.lit(None).cast("struct<size:int,rule:string,action:string>")
    for h, p, action in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1], r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def node_of(url: Column) -> Column:
    """The resource a url names: scheme and host lower-cased, no fragment; an empty path is ``/``. Others as they are."""
    plain = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    scheme = F.translate(F.regexp_extract(plain, r"(?s)^(.*?)://", 1), _UPPER, _LOWER)
    path = path_of(plain)
    query = F.regexp_extract(plain, r"(?s)^[^?]*(\?.*)$", 1)
    return F.when(plain.contains("://"), F.concat(scheme, F.lit("://"), host_of(plain), F.when(path == "", F.lit("/")).otherwise(path), query)).otherwise(plain)


def _resolved(base: Column, target: Column) -> Column:
    """``target`` as an absolute url, seen from the page ``base``."""
    target = F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))
    scheme, site = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(target == "", F.lit(None))
        .when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), target))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst)``: each page's canonical links and refresh targets, all of them, absolute. Tags are cut out once."""
    found = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).where("url like '%://%' and html is not null")
    found = found.where(F.lower("html").rlike(r"canonical|http-equiv")).select("url", F.explode(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))).alias("tag"))
    target = F.when(F.col("tag").rlike(_REL), F.regexp_extract("tag", _HREF, 1)).when(F.col("tag").rlike(_META), F.regexp_extract("tag", _META_URL, 1))
    found = found.select("url", target.alias("target")).where("target <> ''")
    return found.select(F.col("url").alias("src"), _resolved(F.col("url"), F.col("target")).alias("dst")).where("dst is not null")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages(page_id, url, html)``.

    A url's own rule decides. A url without one is blocked if a rule blocks a url it is an alias of: one it
    reaches over ``redirects(src, dst)``, canonical links and refresh targets, taken both ways; else it is allowed.
    An explicit allow keeps its own url free whatever its aliases are, and does not free the others. Null urls, and those
    without ``://``, have no rule and no alias and are allowed. Repeated rows and urls each get their row.
    Extra columns are ignored; an empty table gives an empty result.
    """
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")))
    edges = materialize(edges.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")).where("a <> b").distinct(), "aliases")
    parts = connected_components(edges)
    rule = matched_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    blocked = parts.where(rule["action"] == "block").select("component").distinct()
    aliases = parts.join(blocked, "component").select(F.col("node").alias("_node")).distinct().withColumn("_blocked", F.lit(True))
    url = F.col("url").cast("string")
    plain = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("_node"))
    plain = plain.withColumn("_rule", matched_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_rule.action"), F.when(F.col("_blocked"), F.lit("block")), F.lit("allow"))
    return plain.join(aliases, "_node", "left").select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))
