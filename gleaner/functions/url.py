"""URL functions as column expressions. They stay inside Catalyst; only internationalised host names
need a (vectorised) Python step, ``ascii_url``."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Query parameters that don't change a page's content.
DROPPED_PARAMETERS = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_campaign_id utm_source_platform "
    "fbclid gclid msclkid wbraid gbraid mc_cid mc_eid dclid gclsrc zanpid _openstat "
    "_ga _gid _gac _gl "
    "hslang hs_lang lang language locale l hl "
    "sessionid session_id phpsessid jsessionid aspsessionid sid s_id sess "
    "_ t timestamp ts cache v ver version nocache "
    "ref referrer source src referer from "
    "share shared fbid twclid igshid "
    "mkt_tok trk trkid trackid "
    "offset limit per_page"
).split()
#: The form of a locale in a path segment, and of a language segment in a path.
LOCALE_SEGMENT = "^[a-z]{2}([-_][a-z]{2,3})?$"
LANGUAGE_SEGMENT = "(?i)/[a-z]{2}(-[a-z]{2,3})?/"


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def form_decode(text: Column) -> Column:
    """Percent-decoding by form rules (+ is a blank); a bad escape leaves the text as it is."""
    return F.coalesce(F.try_url_decode(text), text)


def percent_decode(text: Column) -> Column:
    """Percent-decoding that keeps + signs."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


@F.pandas_udf(StringType())
def ascii_url(urls: pd.Series) -> pd.Series:
    """URLs with an internationalised host in their ASCII form; others, and hosts without such a form, stay
    as they are. A step of its own: put it in a column before normalising that."""

    def convert(url: str | None) -> str | None:
        if url is None or url.isascii():
            return url
        scheme, mark, rest = url.partition("://")
        name = re.match(r"[^/?#:]*", rest).group()
        try:
            return scheme + mark + name.encode("idna").decode() + rest[len(name) :]
        except UnicodeError:
            return url

    return urls.map(convert)


def host(url: Column, on_failure: str = "url") -> Column:
    """Lower-case host; without one, the url itself ("url") or the given text, as it is."""
    found = F.lower(part(url, "HOST"))
    return F.coalesce(found, url if on_failure == "url" else F.lit(on_failure))


def path_segments(path: Column) -> Column:
    """Segments of a decoded path with ``.`` and ``..`` resolved and empty ones dropped."""
    pieces = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    nothing = F.array().cast("array<string>")
    return F.aggregate(pieces, nothing, lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, s)))


def without_locale(segments: Column, locales: Sequence[str] = ()) -> Column:
    first = F.lower(F.try_element_at(segments, F.lit(1)))
    is_locale = first.isin([x.lower() for x in locales]) if locales else first.rlike(LOCALE_SEGMENT)
    return F.when(is_locale & (F.size(segments) > 1), F.slice(segments, 2, F.size(segments))).otherwise(segments)


def normal_query(query: Column) -> Column:
    """Parameters without the insignificant ones, decoded, the first of each name, sorted by name."""
    pieces = F.filter(F.split(query, "&"), lambda p: F.trim(F.element_at(F.split(p, "=", 2), 1)) != "")
    pairs = F.transform(pieces, lambda p: F.struct(F.trim(F.element_at(F.split(p, "=", 2), 1)).alias("k"), F.trim(F.coalesce(F.try_element_at(F.split(p, "=", 2), F.lit(2)), F.lit(""))).alias("v")))
    pairs = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(DROPPED_PARAMETERS))
    pairs = F.transform(pairs, lambda p: F.struct(form_decode(p["k"]).alias("k"), form_decode(p["v"]).alias("v")))
    names = F.transform(pairs, lambda p: p["k"])
    firsts = F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1)
    ordered = F.array_sort(firsts, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    return F.array_join(F.transform(ordered, lambda p: F.when(p["v"] == "", p["k"]).otherwise(F.concat(p["k"], F.lit("="), p["v"]))), "&")


def normalize_url(url: Column, strip_locale: bool = False, strip_www: bool = False, locales: Sequence[str] = ()) -> Column:
    """The canonical form of an http(s) URL, null for anything else.

    Lower-case scheme and host, no default port and no fragment; the path is decoded twice (as a parsed
    path is decoded already, and so may change again when normalised again), dots resolved, no trailing
    slash; the query as in normal_query. Hosts outside ASCII need ``ascii_url`` first.
    """
    encoded = F.trim(url)
    scheme = F.lower(part(encoded, "PROTOCOL"))
    name = F.lower(part(encoded, "HOST"))
    if strip_www:
        name = F.when(name.startswith("www.") & F.contains(F.substr(name, F.lit(5)), F.lit(".")), F.substr(name, F.lit(5))).otherwise(name)
    port = F.regexp_extract(F.coalesce(part(encoded, "AUTHORITY"), F.lit("")), ":([0-9]+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    port = F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), port))
    segments = path_segments(form_decode(percent_decode(F.coalesce(part(encoded, "PATH"), F.lit("")))))
    if strip_locale:
        segments = without_locale(segments, locales)
    query = normal_query(percent_decode(F.coalesce(part(encoded, "QUERY"), F.lit(""))))
    query = F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    return F.when(scheme.isin("http", "https") & (name != ""), F.concat(scheme, F.lit("://"), name, port, F.lit("/"), F.array_join(segments, "/"), query))


def dedup_key(url: Column) -> Column:
    """The key by which a crawl claims pages: without locale and www, else the plain canonical form, else
    the URL itself."""
    return F.coalesce(normalize_url(url, strip_locale=True, strip_www=True), normalize_url(url), url)


def path_depth(url: Column, unparsable: int = 2**31 - 1) -> Column:
    """Number of non-blank path segments."""
    path = part(url, "PATH")
    depth = F.size(F.filter(F.split(path, "/"), lambda s: F.trim(s) != ""))
    return F.when(path.isNull() & part(url, "HOST").isNull(), unparsable).when(path.isNull(), 0).otherwise(depth)


def base_domain(url: Column) -> Column:
    """scheme://host[:port]"""
    return F.concat(F.lower(part(url, "PROTOCOL")), F.lit("://"), F.lower(part(url, "AUTHORITY")))


def matches_path_language(url: Column, segment: str, base_url: str | None = None) -> Column:
    """Accept URLs of the language's path segment or of none; the base URL always."""
    path = part(url, "PATH")
    own = F.contains(F.lower(path), F.lit(f"/{segment.lower().strip('/')}/"))
    accepted = path.isNull() | own | ~path.rlike(LANGUAGE_SEGMENT)
    return accepted if base_url is None else (F.rtrim(url, F.lit("/")) == base_url.rstrip("/")) | accepted


def matches_query_language(url: Column, name: str, value: str) -> Column:
    """Accept URLs whose parameter has the value (the last one counts) or that lack it."""
    pairs = F.transform(F.split(F.lower(F.coalesce(part(url, "QUERY"), F.lit(""))), "&"), lambda p: F.split(p, "=", 2))
    values = F.transform(F.filter(pairs, lambda p: F.element_at(p, 1) == name.lower().strip()), lambda p: F.coalesce(F.try_element_at(p, F.lit(2)), F.lit("")))
    return (F.size(values) == 0) | (F.try_element_at(values, F.lit(-1)) == value.lower().strip())


def urls_in_text(text: Column) -> Column:
    """URLs in a text, without the punctuation that follows them, each once."""
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"{}|\\^`\[\]]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, "[.,)\\];:'\"]+$", "")))


def title_from_url(url: Column) -> Column:
    """The file name without its extension, dashes and underscores as blanks."""
    name = F.regexp_extract(form_decode(F.coalesce(part(url, "PATH"), F.lit(""))), "([^/]*)/*$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), "[-_]+", " "))


def host_rule_matches(name: Column, pattern: Column) -> Column:
    """Whether a host falls under a rule: exact, or ``*.domain``, which also covers the domain itself."""
    base = F.substr(pattern, F.lit(3))
    wild = pattern.startswith("*.")
    return F.when(wild, (name == base) | F.endswith(name, F.concat(F.lit("."), base))).otherwise(name == pattern)


def patterns_of_host(name: Column) -> Column:
    """All rules' patterns that match a host: itself, and ``*.`` before each of its domains."""
    labels = F.split(name, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("*."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    return F.when(name.isNotNull(), F.concat(F.array(name), above))


def lenient_uri(url: Column) -> Column:
    """The trimmed URL, if it can't be parsed, with all that a path, a query or a fragment may not hold
    percent-encoded as UTF-8 (letters beyond ASCII alone can be parsed); ``%XX`` stays, and so do the delimiters. Scheme and authority stay as they are; without a scheme only
    blanks are encoded. A blank URL is null."""
    trimmed = F.trim(url)
    head = F.regexp_extract(trimmed, "^([^:/?#]+://[^/?#]*)", 1)
    rest = F.substring(trimmed, F.length(head) + 1, F.length(trimmed))
    pieces = F.regexp_extract_all(rest, F.lit("(?s)%[0-9A-Fa-f]{2}|."), F.lit(0))
    encoded = F.transform(pieces, lambda c: F.when(c.rlike(r"^(?:%..|[A-Za-z0-9\-._~!$'()*+,;:@/?&=#])$"), c).otherwise(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))))
    legal = rest.rlike(r"^(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9\-._~!$'()*+,;:@/?&=#]|[^\x00-\x7F\p{Z}\p{Cc}])*$")
    whole = F.when(legal, trimmed).otherwise(F.concat(head, F.array_join(encoded, "")))
    return F.when(trimmed == "", None).when(head == "", F.replace(trimmed, F.lit(" "), F.lit("%20"))).otherwise(whole)


def language_pattern(pattern: Column) -> Column:
    """A filter's pattern as a struct: kind (path, query; null if there is none or it is wrong), name and
    value of a query pattern, and error, null if the pattern is right or empty."""
    text = F.trim(pattern)
    name = F.trim(F.regexp_extract(text, r"(?s)^\?([^=]*)=", 1))
    value = F.trim(F.regexp_extract(text, r"(?s)^\?[^=]*=(.*)$", 1))
    path, asks = text.startswith("/"), text.startswith("?")
    error = (
        F.when(text == "", None).when(path & ~F.endswith(text, F.lit("/")), "a path pattern ends with /").when(path & (F.length(text) < 3), "a path pattern names a segment")
        .when(path, None).when(asks & ~F.contains(text, F.lit("=")), "a query pattern has an =").when(asks & (name == ""), "a query pattern has a name")
        .when(asks & (value == ""), "a query pattern has a value").when(asks, None).otherwise("a pattern starts with / or ?")
    )
    right = error.isNull()
    kind = F.when(right & path, "path").when(right & asks, "query")
    return F.struct(kind.alias("kind"), F.when(kind == "query", name).alias("name"), F.when(kind == "query", value).alias("value"), error.alias("error"))
