"""URL verdicts by rules, spread over redirect and canonical-link aliases.

A rule is ``(action, host/path-prefix)``.  It fits its host and all subdomains
where the url's path starts with the rule's; the longest fitting rule decides,
and of equally long ones an allow.  Pages that no rule fits take the verdict of
their aliases: redirect edges and canonical links join urls into components
(distributed, see components.py), and a block anywhere in a component reaches
every page of it that has no rule of its own; explicit allows stand.

DataFrame functions only.  Defined results: a null url, or one without
``://``, has an empty host and path, no alias and the verdict allow; null html
has no link; repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower
from .components import components

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
TAG = r"""(?is)<(?:link|meta)\b(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""
#: An attribute's value, in quotes or bare, behind whole attributes: never from within another's value.
VALUE = r"""(?is)^<\w+(?:[\s/"']*+(?!NAME[\s=])[^\s=>/"']++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?+)*+[\s/"']*+NAME\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
TARGET = r"""(?is)^(?:\s*[\d.]*\s*[;,\s]\s*(?:url\s*=\s*)?|.*?\burl\s*=\s*)["']?\s*([^"'\s]+)"""


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL, 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def node(url: Column) -> Column:
    """A url as a node of the alias graph: no fragment, host in lower case; null without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(ascii_lower(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)), rest))


def _rule_parts(rule: str) -> tuple[str, str]:
    at = rule.find("/")
    return (rule, "") if at < 0 else (rule[:at], rule[at:])


def ruled(rules: list[tuple[str, str]], host_: Column, path_: Column) -> Column:
    """Struct(size, allow, rule) of the deciding rule, or null.  ``rules`` is a parameter list."""
    found = []
    for action, rule in rules:
        h, p = _rule_parts(rule)
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(action == "allow").alias("allow"), F.lit(rule).alias("rule"))))
    none = F.lit(None).cast("struct<size:int,allow:boolean,rule:string>")
    return F.greatest(none, none, *found)


def _value(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, without its quotes and with ``&amp;`` decoded; empty if there is none."""
    raw = F.regexp_extract(tag, VALUE.replace("NAME", name), 1)
    return F.regexp_replace(F.trim(F.regexp_replace(raw, r"""^["']|["']$""", "")), "(?i)&(?:amp|#38|#x26);", "&")


def _without_dots(path_: Column) -> Column:
    """A path that starts with ``/``, its segments ``.`` and ``..`` resolved."""
    parts = F.slice(F.split(path_, "/"), 2, F.length(path_) + 1)
    last = F.element_at(parts, -1)
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda out, x: F.when(x == ".", out)
                       .when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x))))
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolved(url: Column, to: Column) -> Column:
    """Target ``to`` of a link on the page ``url``, completed; null if it is no url of a page."""
    scheme, site = F.regexp_extract(url, r"(?s)^(.*?:)//", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    whole, own = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), path(url)
    asked = F.regexp_extract(to, r"(?s)^([^?#]*)", 1)
    rest = F.substring(to, F.length(asked) + 1, F.length(to))
    folder = F.when(own == "", "/").otherwise(F.regexp_extract(own, r"(?s)^(.*/)", 1))
    return (F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.when(to.contains("://"), to))
            .when(to.startswith("//"), F.concat(scheme, to))
            .when(to.startswith("/"), F.concat(site, _without_dots(asked), rest))
            .when(to.startswith("?"), F.concat(site, own, to))
            .when(to.startswith("#"), F.concat(site, whole, to))
            .otherwise(F.concat(site, _without_dots(F.concat(folder, asked)), rest)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b) of every canonical link and refresh in the html, as nodes; targets are
    resolved against the page's url."""
    e = (pages.select(pages["url"].alias("url"), pages["html"].alias("html"))
         .where(F.col("html").rlike("(?i)canonical|refresh"))
         .select("url", F.explode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0))).alias("tag")))
    tag = F.col("tag")
    link = F.lower(F.substring(tag, 2, 4)) == "link"
    canonical = link & F.array_contains(F.split(F.lower(_value(tag, "rel")), r"\s+"), "canonical")
    refresh = ~link & (F.lower(_value(tag, "http-equiv")) == "refresh")
    to = F.when(canonical, _value(tag, "href")).when(refresh, F.regexp_extract(_value(tag, "content"), TARGET, 1))
    e = e.select("url", to.alias("to")).where("to <> ''")
    return e.select(node(F.col("url")).alias("a"), node(resolved(F.col("url"), F.col("to"))).alias("b")).where("a is not null and b is not null")


def judge(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule and verdict of every page.

    ``redirects`` may add edges: columns ``source`` and ``target``, urls.
    """
    def split(df: DataFrame, url: str) -> DataFrame:
        df = df.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
        return df.withColumn("__rule", ruled(rules, F.col("host"), F.col("path")))

    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node(redirects["source"]).alias("a"), node(redirects["target"]).alias("b")).where("a is not null and b is not null"))
    members = components(edges, "a", "b")
    # a rule of any url of the component, page or link target, decides for its aliases
    blocked = split(members, "node").where("not __rule.allow").select("root").distinct()
    aliases = members.join(blocked, "root", "left_semi").select(F.col("node").alias("__node"), F.lit(True).alias("__blocked"))

    p = split(pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url")), "url")
    own = p.where("__rule is not null").withColumn("verdict", F.when(F.col("__rule.allow"), "allow").otherwise("block"))
    rest = p.where("__rule is null").withColumn("__node", node(F.col("url")))
    rest = rest.join(aliases, "__node", "left").withColumn("verdict", F.when(F.col("__blocked"), "block").otherwise("allow"))
    cols = ["page_id", "url", "host", "path", F.col("__rule.rule").alias("rule"), "verdict"]
    return own.select(cols).unionByName(rest.select(cols))
