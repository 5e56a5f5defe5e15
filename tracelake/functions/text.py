"""Text expressions: hashes, normal forms, redaction and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of secrets in examples, and what takes their place.
SECRETS = [
    (r"""(?i)(Authorization[ \t\r\n]*[:=][ \t\r\n]*Bearer[ \t\r\n]+)[^ \t\r\n,"'}]+""", "$1[REDACTED]"),
    (r"""(?i)(Authorization[ \t\r\n]*[:=][ \t\r\n]*)(?!Bearer(?![A-Za-z0-9_]))[^ \t\r\n,"'}]+""", "$1[REDACTED]"),
    (r"""(?i)(["']?(?:token|api[_-]?key|password|secret)["']?[ \t\r\n]*[:=][ \t\r\n]*["'])[^"']+(["'])""", "$1[REDACTED]$2"),
]
#: Words that mark an action that changes something.
MUTATIONS = [
    "delete", "remove", "destroy", "erase", "purge", "save", "submit", "create", "update", "edit", "install", "uninstall", "restart", "reboot",
    "shutdown", "disable", "enable", "send", "publish", "close", "resolve", "assign", "approve", "reject", "cancel subscription", "purchase", "buy", "pay",
]
#: What equal statements may differ in.
VARIABLE = [r"\[[a-z][a-z0-9 -]{2,80}\]", r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", r"https?://[^ \t\r\n)]+"]


def stable_hash(value: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(value, 256), 1, 16)


def normal_space(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"[ \t\r\n\f\x0B]+", " "))


def redacted(value: Column) -> Column:
    for pattern, put in SECRETS:
        value = F.regexp_replace(value, pattern, put)
    return value


def masked(value: Column) -> Column:
    """A sensitive value with only its first letter, or its last label, readable."""
    last = lambda x: F.substring_index(x, ".", -1)
    mail = F.concat(F.substring(value, 1, 1), F.lit("***@***."), last(F.split(value, "@", -1)[1]))
    host = F.concat(F.lit("***."), last(F.regexp_replace(value, "^https?://", "")))
    return F.when(F.contains(value, F.lit("@")), mail).when(F.contains(value, F.lit(".")), host).otherwise(F.concat(F.substring(value, 1, 1), F.lit("***")))


def supported_form(value: Column) -> Column:
    """A statement without what tenants may differ in: placeholders, mail addresses and URLs, case, end marks."""
    value = F.lower(value)
    for pattern in VARIABLE:
        value = F.regexp_replace(value, pattern, "[tenant-value]")
    return F.regexp_replace(normal_space(value), "[.!?]+$", "")


def mutation_term(text: Column, terms: list[str] = MUTATIONS) -> Column:
    """The first of the terms that stands in a text as whole words, else NULL."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))
    found = F.lit(None).cast("string")
    for term in reversed(terms):
        found = F.when(F.contains(plain, F.lit(f" {term} ")), F.lit(term)).otherwise(found)
    return found


def plain_html(html: Column) -> Column:
    """Markup off, the basic named references and decimal ones decoded, white space as one space."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?i)<br[ \t\r\n]*/?>", "\n"), "<[^>]+>", " ")
    for name, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = F.regexp_replace(text, f"(?i){name}", sign)
    codes = F.regexp_extract_all(text, F.lit("&#([0-9]{1,7});"), F.lit(1))
    signs = F.transform(codes, lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32"))
    pieces = F.arrays_zip(F.split(text, "&#[0-9]{1,7};", -1).alias("piece"), signs.alias("sign"))
    decoded = F.array_join(F.transform(pieces, lambda x: F.concat(x["piece"], F.coalesce(x["sign"], F.lit("")))), "")
    return normal_space(F.when(F.size(codes) > 0, decoded).otherwise(text))
