"""URL filters: allow and block rules, and decisions that spread over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected

#: Rules are broadcast up to this many; beyond it the joins shuffle.
BROADCAST_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ? or # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_of(spark: SparkSession, block: list[str] = (), allow: list[str] = ()) -> DataFrame:
    """A rule table (rule, action) of texts like ``example.com/de/``."""
    return spark.createDataFrame([(r, "block") for r in block] + [(r, "allow") for r in allow], "rule string, action string")


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action): the longest rule that fits each distinct host and path; of equally long ones an allow rule.

    A rule fits its host and all subdomains where the path starts with the rule's. Hosts are exploded into their
    suffixes, so that fitting is an equi-join whatever the number of rules.
    """
    at = F.instr("rule", "/")
    parts = rules.where(F.col("rule").isNotNull() & F.col("action").isin("allow", "block")).select(
        F.col("rule"), "action",
        F.translate(F.when(at > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")), UPPER, LOWER).alias("suffix"),
        F.when(at > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit("")).alias("prefix")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    each = places.select("host", "path", F.explode(suffixes).alias("suffix"))
    fits = each.join(common.if_small(parts, BROADCAST_RULES), "suffix").where(F.startswith("path", "prefix"))
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("action") == "allow").alias("allow"), F.col("rule"), F.col("action")))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.action")


def page_key(url: Column) -> Column:
    """What a link has to name to mean a page: host, path and query, without scheme and fragment."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.concat(host(url), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest)))


def _unescaped(value: Column) -> Column:
    return F.regexp_replace(value, r"(?i)&(?:amp|#38|#x26);", "&")


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not; empty without it."""
    form = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>]+))"""
    return F.trim(_unescaped(F.concat(*[F.regexp_extract(tag, form, g) for g in (1, 2, 3)])))


def _without_dots(path: Column) -> Column:
    """A path that starts with / without its segments . and .. ."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.concat(a, F.array(s))))
    end = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), end)


def resolve(target: Column, base: Column) -> Column:
    """A link's absolute url, given the absolute url that it is relative to; null for a scheme without ://."""
    scheme, authority = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)^.*?://([^/?#]*)", 1)
    site = F.concat(scheme, F.lit("://"), authority)
    own = F.when(path(base) == "", F.lit("/")).otherwise(path(base))
    way, rest = F.regexp_extract(target, r"(?s)^[^?#]*", 0), F.regexp_extract(target, r"(?s)[?#].*$", 0)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None).cast("string"))
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, _without_dots(way), rest))
        .when(F.startswith(target, F.lit("?")), F.concat(site, own, rest))
        .when((target == "") | F.startswith(target, F.lit("#")), F.concat(F.regexp_extract(base, r"(?s)^[^#]*", 0), rest))
        .otherwise(F.concat(site, _without_dots(F.concat(F.regexp_extract(own, r"(?s)^.*/", 0), way)), rest)))


def links_of(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target): canonical links and meta refreshes that pages state about themselves, resolved against the page's base or url."""
    html = F.col(f"`{html_col}`")
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta|base)\b[^>]*>"), 0)
    found = pages.select(F.col(f"`{url_col}`").alias("url"), tags.alias("tags")).where(F.size("tags") > 0)
    first = F.get(F.filter("tags", lambda t: t.rlike(r"(?is)^<base\b.*[\s\"'/]href\s*=")), F.lit(0))
    own = F.col("url")
    rows = found.select("url", F.coalesce(resolve(_attribute(first, "href"), own), own).alias("base"), F.explode("tags").alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"(?i)^<link\b") & _attribute(F.col("tag"), "rel").rlike(r"(?is)(^|\s)canonical(\s|$)"), _attribute(F.col("tag"), "href"))
    refresh = F.when(F.col("tag").rlike(r"(?is)^<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b"), _unescaped(F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)))
    return rows.select("url", "base", F.coalesce(canonical, refresh).alias("link")).where("link <> ''").select("url", resolve(F.col("link"), F.col("base")).alias("target")).where(F.col("target").contains("://"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """One row per page: (page_id, url, host, path, rule, verdict, alias_of).

    A page that a rule fits has that rule's verdict. Other pages take the verdict of their aliases: pages are aliases
    where redirects or canonical links connect them (from ``redirects``, a table (source, target) of urls, and from
    the pages' own html), however long the chain. A group with an explicitly allowed url is allowed, else one with a
    blocked url is blocked; without either a page is allowed. ``alias_of`` is the least url key of the group.

    Nulls: a url that is null or has no :// has empty host and path, fits no rule, has no aliases and is allowed.
    Rows that repeat are judged alike, one output row each. Urls that only links name take part in groups and are
    judged by the rules too. Empty tables are fine; extra columns are not read.
    """
    base = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url")).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    links = links_of(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        given = redirects.select(F.col("source").alias("url"), "target").where(F.col("url").contains("://") & F.col("target").contains("://"))
        links = given if links is None else links.unionByName(given)
    ends = F.explode(F.array("url", "target")).alias("url")
    if links is not None:
        links = common.staged(links.where(F.col("url").contains("://")), "links")
    named = base.select("host", "path").where("host <> ''")
    if links is not None:
        named = named.unionByName(links.select(ends).select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path")))
    ruled = common.staged(match_rules(named.distinct(), rules), "ruled")
    out = base.join(ruled, ["host", "path"], "left")
    if links is None or links.isEmpty():
        return out.select("page_id", "url", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("alias_of"))
    groups = common.staged(connected(links.select(page_key(F.col("url")).alias("a"), page_key(F.col("target")).alias("b"))), "aliases")
    # decisions of every url of a group: the pages' own and those that links name
    seen = base.select("url", "host", "path").where("host <> ''").unionByName(links.select(ends).select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")))
    decided = seen.join(ruled, ["host", "path"]).select(page_key(F.col("url")).alias("node"), "action").distinct()
    verdicts = groups.join(decided, "node").groupBy("root").agg(F.min("action").alias("spread"))  # "allow" precedes "block"
    of = groups.join(verdicts, "root", "left").select(F.col("node"), F.col("root").alias("alias_of"), "spread")
    keyed = out.withColumn("node", F.when(F.col("host") != "", page_key(F.col("url"))))
    return keyed.join(of, "node", "left").select("page_id", "url", "host", "path", "rule", F.coalesce("action", "spread", F.lit("allow")).alias("verdict"), "alias_of")
