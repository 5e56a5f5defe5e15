"""Route patterns: how specifically a pattern fits a path, and which fit is the more specific one.

A pattern has literal segments, `:name`, optional `:name?`, and, as its last segment only, `*`, `:name*` or `:name+`. A fit
is a struct of `exact` and `ranks`: 2 for a literal segment, 1 for a parameter, 0 for what a wildcard takes; NULL: no fit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import normal_route

WILD = r"^(?:\*|:.*[*+])$"


def segments(path: Column) -> Column:
    return F.when(path == "/", F.array().cast("array<string>")).otherwise(F.split(F.substring(path, F.lit(2), F.length(path)), "/", -1))


def varies(pattern: Column) -> Column:
    """Whether a pattern fits paths of several lengths."""
    return F.exists(segments(normal_route(pattern)), lambda p: F.regexp_like(p, F.lit(WILD)) | F.regexp_like(p, F.lit(r"^:.*\?$")))


def route_fit(pattern: Column, path: Column) -> Column:
    pattern, path = normal_route(pattern), normal_route(path)
    parts, values = segments(pattern), segments(path)
    n = F.size(values)
    wild = F.transform(parts, lambda p: F.regexp_like(p, F.lit(WILD)))
    first = F.array_position(wild, F.lit(True))  # from 1, 0: none
    body = F.when(first > 0, (first - 1).cast("int")).otherwise(F.size(parts))
    used = F.least(body, n)
    least = F.when((first > 0) & F.endswith(F.element_at(parts, -1), F.lit("+")), 1).otherwise(0)
    pairs = F.zip_with(F.slice(parts, F.lit(1), used), F.slice(values, F.lit(1), used), lambda p, v: F.startswith(p, F.lit(":")) | (p == v))
    rest = F.slice(parts, used + 1, body - used)
    fits = F.forall(pairs, lambda x: x) & F.forall(rest, lambda p: F.regexp_like(p, F.lit(r"^:.*\?$")))
    fits = fits & F.when(first > 0, (first == F.size(parts)) & (n - used >= least)).otherwise(n <= body)
    ranks = F.transform(F.slice(parts, F.lit(1), used), lambda p: F.when(F.startswith(p, F.lit(":")), 1).otherwise(2))
    taken = F.when(first > 0, F.greatest(n - used, F.when((least == 0) & (used == 0), 1).otherwise(0))).otherwise(0)
    ranks = F.concat(ranks, F.array_repeat(F.lit(0), taken))
    exact = (pattern == path) & F.forall(ranks, lambda r: r == 2)
    return F.when(fits, F.struct(exact.alias("exact"), ranks.alias("ranks")))


def dominates(a: Column, b: Column) -> Column:
    """Whether fit a is more specific than fit b: an exact one before others, else no rank is lower and one is higher.
    This is a partial order, so several fits may be undominated."""
    pairs = F.zip_with(a["ranks"], b["ranks"], lambda x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))
    ranked = F.forall(pairs, lambda d: d >= 0) & F.exists(pairs, lambda d: d > 0)
    return F.when(a["exact"] != b["exact"], a["exact"]).otherwise(ranked)


#: What a segment looks like that hides a value, that is an identifier, that is a name.
REDACTED = [r"(?i)redact|masked|hidden|^\*+$", r"^\[[^\]]+\]$"]
IDENTIFIERS = [r"^[0-9]+$", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$", r"(?i)^[0-9a-f]{16,}$"]
SLUG = r"^[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*$"


def value_class(value: Column) -> Column:
    """What a path segment that a parameter took looks like, decoded: redacted, opaque-identifier or stable-slug; null for
    null. A segment that cannot be decoded is taken as it is."""
    value = F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)
    like = lambda p: F.regexp_like(value, F.lit(p))
    redacted = like(REDACTED[0]) | like(REDACTED[1])
    opaque = like(IDENTIFIERS[0]) | like(IDENTIFIERS[1]) | like(IDENTIFIERS[2])
    opaque = opaque | ((F.length(value) >= 20) & like(r"[A-Za-z]") & like(r"[0-9]") & like(r"^[A-Za-z0-9_-]+$"))
    slug = like(SLUG) & (F.length(value) <= 64)
    return F.when(value.isNotNull(), F.when(redacted, "redacted").when(opaque, "opaque-identifier").when(slug, "stable-slug").otherwise("opaque-identifier"))


def title_of(segment: Column) -> Column:
    """A route segment as a name: hyphens and underscores become spaces, a letter after any other sign than an ASCII letter or
    digit becomes a capital."""
    words = F.split(F.regexp_replace(F.regexp_replace(segment, "^:", ""), "[-_]+", " "), "(?<=[^A-Za-z0-9_])(?=[A-Za-z0-9_])", -1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def bindings(pattern: Column, path: Column) -> Column:
    """What the parameters of a pattern took from a path: array of (parameter, position, class, value), the value only of
    names."""
    pairs = F.arrays_zip(segments(pattern).alias("p"), F.slice(segments(path), F.lit(1), F.size(segments(pattern))).alias("v"))
    found = F.transform(pairs, lambda x, i: F.struct(F.regexp_replace(F.regexp_replace(x["p"], "^:", ""), "[?*+]$", "").alias("parameter"), i.alias("position"), value_class(x["v"]).alias("class"), F.when(value_class(x["v"]) == "stable-slug", x["v"]).alias("value"), x["p"].alias("p")))
    kept = F.filter(found, lambda x: F.startswith(x["p"], F.lit(":")) & x["class"].isNotNull())
    return F.transform(kept, lambda x: F.struct(x["parameter"].alias("parameter"), x["position"].alias("position"), x["class"].alias("class"), x["value"].alias("value")))


def _hidden(pattern: Column, path: Column, put: str, lower: bool) -> Column:
    pairs = F.arrays_zip(segments(path).alias("v"), segments(pattern).alias("p"))
    one = lambda x: F.when(~F.coalesce(F.startswith(x["p"], F.lit(":")), F.lit(False)), x["v"]).when(value_class(x["v"]) == "stable-slug", F.lower(x["v"]) if lower else x["v"]).otherwise(F.lit(put))
    return F.concat(F.lit("/"), F.array_join(F.transform(F.filter(pairs, lambda x: x["v"].isNotNull()), one), "/"))


def structure_key(pattern: Column, path: Column) -> Column:
    """Pattern and path with each opaque parameter as :opaque: states of one structure have one key."""
    return F.concat(pattern, F.lit("|"), _hidden(pattern, path, ":opaque", True))


def sanitized_path(pattern: Column, path: Column) -> Column:
    return _hidden(pattern, path, "[opaque]", False)


def identity_parts(parts: Column) -> Column:
    """The distinct parts, of more than two the first and the last."""
    distinct = F.array_distinct(parts)
    return F.when(F.size(distinct) <= 2, distinct).otherwise(F.array(F.element_at(distinct, 1), F.element_at(distinct, -1)))


def route_path(value: Column) -> Column:
    """A route path with one slash at its start and between its parts, and none at its end."""
    path = F.regexp_replace(F.concat(F.lit("/"), value), "/{2,}", "/")
    return F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)


def joined_route(declared: Column, parent: Column, nested: Column) -> Column:
    """The path of a declared route: an absolute one stands for itself, a relative one below the parent's; null where the
    route is nested and its parent's path is not known. nested: whether it has a parent at all."""
    alone = F.startswith(declared, F.lit("/")) | ~nested
    return F.when(alone, route_path(declared)).when(parent.isNotNull(), route_path(F.concat(parent, F.lit("/"), declared)))


def app_page_route(path: Column) -> Column:
    """The route of a page file in an app folder; groups in brackets and slots are no part of it. Null for other files."""
    parts = F.split(F.regexp_replace(path, "^(?:src/)?app/(?:(.*)/)?page[.][a-z]+$", "$1"), "/", -1)
    kept = F.filter(parts, lambda p: (p != "") & ~F.regexp_like(p, F.lit(r"^\(.*\)$")) & ~F.startswith(p, F.lit("@")))
    page = F.regexp_like(path, F.lit("^(?:src/)?app(?:/.*)?/page[.](?:ts|tsx|js|jsx)$"))
    return F.when(page, F.concat(F.lit("/"), F.array_join(kept, "/")))
