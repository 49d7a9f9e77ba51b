"""URL filters: allow and block rules by host and path, and block decisions carried over to aliases.

Redirects and canonical links say that two urls name one resource. The urls so tied form components; a url without a
rule of its own takes the decision that rules make for its component, allow before block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .shared import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
# What isn't markup of the page: comments, and elements whose content is text. One that is never closed goes to the end.
_UNREAD = "(?is)<!--.*?(?:-->|$)|" + "|".join(rf"<{t}\b.*?(?:</{t}\s*>|$)" for t in ("script", "style", "textarea", "title", "xmp", "template"))
#: A tag with its attributes, in which quotes are closed: some hundred quoted values at most, as the pattern must not nest deeper.
_TAG = r"""(?is)<%s(?:[\s/](?:[^<>"']++|"[^"]*+"|'[^']*+'){0,800}+)?>"""
_ATTRIBUTE = r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?"""
_REFRESH = r"(?is)^\s*[0-9.]+(?:\s*[;,]\s*|\s+)(?:url\s*=\s*)?(.*)$"

#: Named references of the characters below U+0100, from the standard's table.
NAMED = {name[:-1]: ord(c) for name, c in sorted(html5.items()) if name.endswith(";") and len(c) == 1 and ord(c) < 256}


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's. The rules are a policy of the caller's
    and become one expression, so no join or broadcast is needed; of two rules of one length that fit an allow wins.
    """
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")) if rules else ():
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        chosen = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _undotted(path: Column) -> Column:
    """A path that starts with / without its segments . and .., as urls are resolved."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), none, lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(p == ".", a).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)), "/"))


def resource(url: Column) -> Column:
    """The url as an alias is compared: without fragment and segments . and .., http as https, host in lower case."""
    tail = F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^#]*)", 1)
    place = F.regexp_extract(tail, "^[^?]*", 0)
    place = F.when(place == "", F.lit("/")).when(place.rlike(r"/\.\.?(/|$)"), _undotted(place)).otherwise(place)
    return F.when(F.instr(url, "://") > 0, F.concat(F.lit("https://"), host(url), place, F.regexp_extract(tail, r"(?s)\?.*$", 0)))


def resolved(to: Column, url: Column) -> Column:
    """The url that a link to ``to`` means in a page at ``url``.

    Null for another scheme without ``//`` (mailto:, javascript:), and for a relative link where ``url`` has no scheme.
    """
    to = F.regexp_replace(to, "(?i)^https?:(?!//)", "")
    site = F.regexp_extract(url, f"{_SCHEME}//[^/?#]*", 0)
    folder = F.regexp_replace(path(url), "[^/]*$", "")
    return (
        F.when(to.rlike(f"{_SCHEME}//"), to)
        .when((site == "") | to.rlike(_SCHEME), F.lit(None).cast("string"))
        .when(to.startswith("//"), F.concat(F.regexp_extract(url, _SCHEME, 0), to))
        .when(to.startswith("/"), F.concat(site, to))
        .when(to.startswith("?"), F.concat(site, path(url), to))
        .when((to == "") | to.startswith("#"), url)
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), to))
    )


def _character(code: Column) -> Column:
    """The character of a code point; the replacement character for what is none."""
    good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    digits = F.lpad(F.hex(F.when(good, code).otherwise(F.lit(0xFFFD))), 8, "0")
    return F.decode(F.unhex(digits), "UTF-32")


def unescaped(text: Column) -> Column:
    """A text with its character references read: numbers, and the names of ``NAMED``, with their semicolon."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    decimal, hexadecimal, named = r"^#([0-9]{1,7});", r"^#[xX]([0-9A-Fa-f]{1,6});", r"^([A-Za-z][A-Za-z0-9]*);"

    def piece(p: Column, at: Column) -> Column:
        rest = F.regexp_replace(p, "^[^;]*;", "")
        name = F.try_element_at(names, F.regexp_extract(p, named, 1))
        return (
            F.when(at == 0, p)
            .when(p.rlike(decimal), F.concat(_character(F.regexp_extract(p, decimal, 1).try_cast("int")), rest))
            .when(p.rlike(hexadecimal), F.concat(_character(F.conv(F.regexp_extract(p, hexadecimal, 1), 16, 10).try_cast("int")), rest))
            .when(name.isNotNull(), F.concat(_character(name), rest))
            .otherwise(F.concat(F.lit("&"), p))
        )

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&", -1), piece), "")).otherwise(text)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` stands in the plan once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _tags(html: Column, name: str) -> Column:
    """The tags of a name, each as an array of attributes (name in small letters, value), in which quotes decide."""
    def attributes(tag: Column) -> Column:
        inside = F.regexp_replace(tag, r"^<[A-Za-z]+|>$", "")
        pairs = F.zip_with(F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), 1), F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), 2), lambda n, v: F.struct(F.lower(n).alias("n"), v.alias("v")))
        return pairs

    return F.transform(F.regexp_extract_all(html, F.lit(_TAG % name), 0), attributes)


def _value(tag: Column, name: str) -> Column:
    """The first attribute of a name, without its quotes, references read; null if there is none."""
    found = F.get(F.filter(tag, lambda a: a["n"] == name), F.lit(0))["v"]
    return unescaped(F.regexp_replace(found, r"""(?s)^(["'])(.*)\1$""", "$2"))


def _url_of(text: Column) -> Column:
    """A url as an attribute holds it: blanks at the ends and line breaks inside don't count."""
    return F.regexp_replace(F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")


def _refresh(content: Column) -> Column:
    """The url of a refresh, quoted or not, with or without ``url=``; empty where only a time is given."""
    rest = F.regexp_extract(content, _REFRESH, 1)
    quoted = F.regexp_extract(rest, r"""(?s)^(["'])(.*?)(?:\1|$)""", 2)
    return F.when(rest.rlike("""^["']"""), quoted).otherwise(rest)


def links(pages: DataFrame) -> DataFrame:
    """(source, target) resources: the canonical link and the refresh target that a page's html names first.

    Comments, scripts, styles and other text that isn't markup are left out. Attributes are read by name, with quoted values
    up to their quote; ``rel`` is a list of words. Character references are read (``unescaped``). A relative target is
    resolved against the page's url, or its ``base`` element if it has one.
    """
    markup = pages.where("html IS NOT NULL AND url IS NOT NULL").select("url", F.regexp_replace("html", _UNREAD, " ").alias("m"))
    first = lambda found: F.coalesce(_url_of(F.get(found, F.lit(0))), F.lit(""))
    words = lambda t: F.split(F.lower(F.coalesce(_value(t, "rel"), F.lit(""))), r"\s+")
    canonical = F.transform(F.filter(_tags(F.col("m"), "link"), lambda t: F.array_contains(words(t), "canonical") & F.exists(t, lambda a: a["n"] == "href")), lambda t: _value(t, "href"))
    refresh = F.transform(F.filter(_tags(F.col("m"), "meta"), lambda t: F.lower(F.trim(_value(t, "http-equiv"))) == "refresh"), lambda t: _refresh(F.coalesce(_value(t, "content"), F.lit(""))))
    base = F.transform(F.filter(_tags(F.col("m"), "base"), lambda t: F.exists(t, lambda a: a["n"] == "href")), lambda t: _value(t, "href"))
    found = markup.select("url", first(base).alias("base"), F.explode(F.array(first(canonical), first(refresh))).alias("to")).where("to <> ''")
    base = F.when(F.col("base") == "", F.col("url")).otherwise(F.coalesce(_once(F.col("base"), lambda b: resolved(b, F.col("url"))), F.col("url")))
    target = _once(base, lambda b: _once(F.col("to"), lambda t: _once(resolved(t, b), resource)))
    found = found.select(resource(F.col("url")).alias("source"), target.alias("target"))
    return found.where("source IS NOT NULL AND target IS NOT NULL")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, edges: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, via.

    Reads page_id, url and html. ``edges`` (source, target urls) adds redirects known from elsewhere, as from a crawl
    log. ``via`` says where the verdict comes from: rule, alias or default. A null url, or one without ``://``, has an
    empty host and path, fits no rule and has no aliases; such rows are spread over all tasks. Urls and pages of any
    length are read whole; other columns, whatever their names, are ignored. An empty table gives no rows; repeated rows
    repeat.
    """
    known = links(pages)
    if edges is not None:
        more = edges.select(resource(F.col("source")).alias("source"), resource(F.col("target")).alias("target"))
        known = known.union(more.where("source IS NOT NULL AND target IS NOT NULL"))
    members = cut(connected_components(known.select(F.col("source").alias("u"), F.col("target").alias("v"))))
    ruled = members.select("component", rule_of(host(F.col("node")), path(F.col("node")), rules)["verdict"].alias("verdict"))
    decided = ruled.where("verdict IS NOT NULL").groupBy("component").agg(F.min("verdict").alias("decision"))  # allow sorts first
    aliases = members.join(decided, "component").select("node", "decision")
    url = F.col("url")
    nowhere = F.concat(F.lit("none "), F.monotonically_increasing_id().cast("string"))  # no resource's name, and no hot key
    judged = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), F.coalesce(resource(url), nowhere).alias("node"))
    judged = judged.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).join(aliases, "node", "left")
    own = F.col("fit.verdict")
    via = F.when(own.isNotNull(), F.lit("rule")).when(F.col("decision").isNotNull(), F.lit("alias")).otherwise(F.lit("default"))
    verdict = F.coalesce(own, F.col("decision"), F.lit(default))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), via.alias("via"))
