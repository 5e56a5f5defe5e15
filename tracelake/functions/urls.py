"""URL expressions: application paths, origins, request keys, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A query key that holds one of these words is sensitive.
SENSITIVE_KEY = r"(?i)(?:auth|token|code|session|credential|password|secret)"


def normal_route(path: Column) -> Column:
    """With a leading slash and without trailing ones; the root stays /."""
    rooted = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(F.length(rooted) > 1, F.regexp_replace(rooted, "(?<=.)/+$", "")).otherwise(rooted)


def fragment(url: Column) -> Column:
    """From the first # on, else empty."""
    at = F.instr(url, "#")
    return F.when(at > 0, F.substring(url, at, F.length(url))).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def application_path(url: Column) -> Column:
    """The path of a #/ route without its query, else the path of the URL."""
    routed = F.startswith(fragment(url), F.lit("#/"))
    inner = F.substring_index(F.substring(fragment(url), F.lit(2), F.length(url)), "?", 1)
    return normal_route(F.when(routed, inner).otherwise(url_path(url)))


def origin(url: Column) -> Column:
    """Scheme and authority, lower-cased, without the port that the scheme implies."""
    found = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(found, "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")


def request_path(url: Column) -> Column:
    """Path and query, the key under which requests are compared."""
    found = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^#]*)", 1)
    return F.when(F.startswith(found, F.lit("/")), found).otherwise(F.concat(F.lit("/"), found))


def _redacted(query: Column) -> Column:
    """The pairs of a query, those with a sensitive key without their value."""

    def pair(x: Column) -> Column:
        key = F.substring_index(x, "=", 1)
        return F.when(F.regexp_like(key, F.lit(SENSITIVE_KEY)), F.concat(key, F.lit("=%5BREDACTED%5D"))).otherwise(x)

    return F.array_join(F.transform(F.split(query, "&", -1), pair), "&")


def sanitized_url(url: Column) -> Column:
    """The URL with the values of sensitive keys redacted, in its query and in the query of a # route."""
    head, tail = F.substring_index(url, "#", 1), fragment(url)

    def part(x: Column) -> Column:
        at = F.instr(x, "?")
        return F.when(at > 0, F.concat(F.substring(x, F.lit(1), at), _redacted(F.substring(x, at + 1, F.length(x))))).otherwise(x)

    return F.concat(part(head), part(tail))


def combined_url(base: Column, url: Column) -> Column:
    """A relative URL below a base; an absolute one, or no base, stays."""
    joined = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(url, "^/+", ""))
    return F.when(F.regexp_like(url, F.lit("^(?:[a-z][a-z0-9+.-]*:)?//")) | base.isNull() | (base == ""), url).otherwise(joined)
