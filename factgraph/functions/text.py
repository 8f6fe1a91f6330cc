"""String expressions over facts, articles and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fact_statement(s: Column, p: Column, o: Column) -> Column:
    return F.concat_ws(" ", s, p, o)


def stripped(c: Column) -> Column:
    """All white space removed from both ends, not only spaces."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def strip_html(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"<[^>]*>?", ""), "&nbsp;", " ")


def authority(url: Column) -> Column:
    """Host and port of a url, without ``www.``."""
    return F.replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("www."), F.lit(""))


def publisher_of_title(title: Column) -> Column:
    """What follows the last " - " of a title, else "Web"."""
    return F.when(F.contains(title, F.lit(" - ")), F.element_at(F.split(title, " - "), -1)).otherwise(F.lit("Web"))


def date_or_unknown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("Unknown Date"))


def classifier_input(title: Column, text: Column, n: int = 500) -> Column:
    return F.concat(title, F.lit(". "), F.left(text, F.lit(n)))


def smart_cut(c: Column, limit: int = 3500) -> Column:
    """Texts over the limit end after the last ". ", newline or ".\\n" that lies before it, or at the limit."""
    head = F.left(c, F.lit(limit))
    back = F.reverse(head)
    ends = [(F.locate(mark, back), len(mark)) for mark in (" .", "\n", "\n.")]
    # a mark of n characters found at p from the back starts limit - p - n + 1 characters in
    at = F.greatest(*[F.when(p > 0, F.length(head) - p - n + 1).otherwise(-1) for p, n in ends])
    return F.when(F.length(c) <= limit, c).when(at > 0, F.left(head, at + 1)).otherwise(head)


def sentences(c: Column, longer_than: int = 15) -> Column:
    """Sentences parted by ". ", trimmed, if long enough."""
    return F.filter(F.transform(F.split(c, r"\. "), stripped), lambda s: F.length(s) > longer_than)


def id_preview(c: Column) -> Column:
    return F.concat(F.left(c.cast("string"), F.lit(8)), F.lit("..."))


def first_text(*cs: Column) -> Column:
    """The first that is neither null nor empty, else "Unknown"."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit("Unknown"))


def keywords(query: Column, most: int = 10) -> Column:
    """The first lower-cased words of a query."""
    return F.slice(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""), 1, most)


def escaped(c: Column) -> Column:
    """Control characters dropped, ends trimmed; backslash, quotes, newline, return and tab escaped."""
    out = stripped(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


#: Patterns that mark a query as suspicious.
SUSPICIOUS = [r"""(?i)['"].*['"](?:\s*;|\s*or|\s*and|\s*where)""", r"[\$`\\]", r"\$\{.*?\}", r"--\s*$"]


def screen_code(query: Column, shortest: int = 3, longest: int = 500) -> Column:
    """Why a query is refused, or OK."""
    trimmed = stripped(query)
    bad = F.lit(False)
    for p in SUSPICIOUS:
        bad = bad | F.rlike(trimmed, F.lit(p))
    return (F.when(query.isNull() | (query == ""), "INVALID_QUERY").when(trimmed == "", "EMPTY_QUERY").when(F.length(query) > longest, "QUERY_TOO_LONG")
            .when(F.length(trimmed) < shortest, "QUERY_TOO_SHORT").when(bad, "SUSPICIOUS_QUERY").otherwise("OK"))


def valid_fact_id(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(r"^[a-zA-Z0-9_\-.]{1,255}$")), F.lit(False))


def valid_node_id(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(r"^[a-zA-Z0-9_-]{1,255}$")), F.lit(False))


def expand_terms(query: Column, variations: Column) -> Column:
    """The query and its variations, without blank ones and repetitions."""
    return F.filter(F.array_distinct(F.concat(F.array(query), F.coalesce(variations, F.array().cast("array<string>")))), lambda t: t.isNotNull() & (stripped(t) != ""))


def encoded_path(c: Column) -> Column:
    """Percent-encoded UTF-8 of all but letters, digits and - _ . ! ~ * ' ( )."""
    out = F.url_encode(c)
    for form, char in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(form), F.lit(char))
    return out


def hit_defaults(id_: Column, confidence: Column, controversy: Column) -> list[Column]:
    """A hit's id as text, confidence and controversy; where they are null "unknown", 0.5 and 0."""
    return [F.coalesce(id_.cast("string"), F.lit("unknown")).alias("id"), F.coalesce(confidence.cast("double"), F.lit(0.5)).alias("confidence"), F.coalesce(controversy.cast("double"), F.lit(0.0)).alias("controversy")]

