"""Names, keys, labels and classes of single values."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import normal_space

#: What a URI component keeps beside letters and digits, and how Spark's form encoding writes it.
KEPT = [("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%28", "("), ("%29", ")"), ("%27", "'"), ("%2F", "/")]
#: Device names that no file may have.
RESERVED = ["con", "prn", "aux", "nul", "com1", "com2", "com3", "com4", "com5", "com6", "com7", "com8", "com9", "lpt1", "lpt2", "lpt3", "lpt4", "lpt5", "lpt6", "lpt7", "lpt8", "lpt9"]
#: Fixed values: (tags, roles) that go together where the tags differ.
TAG_ROLES = [
    ("^button$", ["button"]), ("^(a|link)$", ["link"]), ("^input$", ["textbox", "checkbox", "radio", "spinbutton", "searchbox"]),
    ("^textarea$", ["textbox"]), ("^select$", ["combobox"]), ("^h[1-6]$", ["heading"]),
]
#: Resource types that are no requests of the application.
RESOURCE_TYPES = ["document", "script", "stylesheet", "image", "font", "media"]


def filled(*values: Column) -> Column:
    """The first value that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def static_value(kind: Column, value: Column) -> Column:
    """The value of a static expression; null for dynamic and empty ones."""
    return F.when(kind == "static", F.nullif(value, F.lit("")))


def joined_key(*parts: Column, by: str = "|") -> Column:
    """Parts joined to a key, missing ones empty."""
    return F.concat_ws(by, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def uri_component(value: Column) -> Column:
    """Percent-encoded UTF-8, slashes kept."""
    value = F.url_encode(value)
    for form, uri in KEPT:
        value = F.replace(value, F.lit(form), F.lit(uri))
    return value


def quoted_label(label: Column) -> Column:
    """The quoted text at the end of a label, else ''."""
    return F.regexp_extract(label, r'(?s)"(.*)"$', 1)


def display_label(node_type: Column, aria_label: Column, placeholder: Column, label: Column) -> Column:
    """What a node is called: its accessible name, placeholder, the quoted end of its label, and but for elements the label."""
    quoted = F.nullif(F.regexp_extract(label, "[\"']([^\"']+)[\"']$", 1), F.lit(""))
    return F.coalesce(aria_label, placeholder, quoted, F.when(node_type == "ui-element", F.lit("")).otherwise(label))


def graphql_type(value: Column) -> Column:
    return F.regexp_replace(value, r"[ \t\r\n\f\x0B]+", "")


def escaped_html(value: Column) -> Column:
    for char, put in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(char), F.lit(put))
    return value


def rounded(value: Column) -> Column:
    """Two digits, halves upwards."""
    return F.floor(value * 100 + 0.5) / 100


def box_issue(x: Column, y: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """Null for a box inside its page; else why it cannot be shown."""
    sound = F.lit(True)
    for v in (x, y, width, height):
        sound = sound & ~F.isnan(v) & (F.abs(v) != float("inf"))
    sound = sound & (x >= 0) & (y >= 0) & (width > 0) & (height > 0)
    out = (x + width > page_width) | (y + height > page_height)
    return F.when(~F.coalesce(sound, F.lit(False)), F.lit("bounding-box-invalid")).when(out, F.lit("bounding-box-out-of-bounds"))


def fits_pattern(value: Column, pattern: Column) -> Column:
    """What stands for the one * of a path pattern; without a * it is '' if both are equal; null if the pattern does not fit."""
    star = F.when(F.regexp_like(pattern, F.lit(r"[*].*[*]")), F.lit(-1)).otherwise(F.locate("*", pattern))
    before, after = F.substring(pattern, F.lit(1), star - 1), F.substring(pattern, star + 1, F.length(pattern))
    fits = F.startswith(value, before) & F.endswith(value, after) & (F.length(value) >= F.length(before) + F.length(after))
    return F.when((star == 0) & (value == pattern), F.lit("")).when((star > 0) & fits, F.substring(value, star, F.length(value) - F.length(before) - F.length(after)))


def module_class(specifier: Column) -> Column:
    """relative, unsupported-module-alias or external-module."""
    kind = F.when(F.regexp_like(specifier, F.lit("^[.]{1,2}/")), F.lit("relative")).when(F.regexp_like(specifier, F.lit("^[@~]/")), F.lit("unsupported-module-alias"))
    return kind.otherwise(F.lit("external-module"))


def candidate_strength(signals: Column) -> Column:
    """How surely something on a page can be clicked, by the types of its signals."""
    strong = F.arrays_overlap(signals, F.array(*[F.lit(s) for s in ("inline-click-handler", "direct-click-listener", "pointer-listener")]))
    return F.when(strong, F.lit("strong")).when(F.array_contains(signals, "focusable"), F.lit("supporting")).otherwise(F.lit("weak"))


def navigation_class(declared_href: Column, resolved_href: Column, strength: Column, context: Column) -> Column:
    explicit = (filled(declared_href) != "") & (filled(resolved_href) != "")
    return F.when(explicit, F.lit("explicit-destination")).when((strength == "strong") & (F.size(context) > 0), F.lit("custom-navigation")).otherwise(F.lit("none"))


def mapping_status(callouts: Column, claims: Column, issues: Column) -> Column:
    """The state of a step by its number of callouts and claims and the types of its issues."""
    has = lambda *types: F.arrays_overlap(issues, F.array(*[F.lit(t) for t in types]))
    status = F.when(has("ambiguous-runtime-target", "claim-ineligible"), F.lit("ambiguous")).when((callouts > 0) & (F.size(issues) > 0), F.lit("partially-mapped"))
    status = status.when((callouts > 0) & (callouts >= claims), F.lit("mapped")).when(callouts > 0, F.lit("partially-mapped"))
    return status.when(has("screenshot-unavailable", "screenshot-state-mismatch"), F.lit("screenshot-unavailable")).otherwise(F.lit("no-visual-target"))


def is_component(name: Column) -> Column:
    return F.regexp_like(name, F.lit("^[A-Z]"))


def is_event(prop: Column) -> Column:
    return F.regexp_like(prop, F.lit("^on[A-Z]"))


def tag_reason(tag: Column, runtime_tag: Column, role: Column) -> Column:
    """Why an element of the code and one of the page can be the same; null if they cannot."""
    tag = F.lower(tag)
    found = F.when(tag == runtime_tag, F.lit("compatible-element-kind"))
    for pattern, roles in TAG_ROLES:
        found = found.when(F.regexp_like(tag, F.lit(pattern)) & role.isin(roles), F.lit("compatible-role"))
    return found


def claim_allowed(status: Column, runtime_only: bool = True, static_only: bool = False) -> Column:
    """Whether a claim of that evidence may be published."""
    return (status == "corroborated") | (status.isin("runtime", "runtime-only") & F.lit(runtime_only)) | (status.isin("static", "static-only") & F.lit(static_only))


def unsafe_secret(value: Column) -> Column:
    """Whether a text still shows a credential that ought to be redacted."""
    space = r"[ \t\r\n]*"
    bearer = F.regexp_extract(value, rf"(?i)Authorization{space}[:=]{space}Bearer[ \t\r\n]+([^ \t\r\n]+)", 1)
    direct = F.regexp_extract(value, rf"(?i)Authorization{space}[:=]{space}([^ \t\r\n]+)", 1)
    named = F.regexp_like(value, F.lit(rf"(?i)(?:token|api[_-]?key|password|secret)[\"']?{space}[:=]{space}[\"'](?!\[REDACTED\])[^\"']+"))
    return ~bearer.isin("", "[REDACTED]") | (~F.lower(direct).isin("", "bearer", "[redacted]")) | named


def redacted_value(value: Column) -> Column:
    return F.when(F.regexp_like(value, F.lit("(?i)token|secret|password|bearer|api[_-]?key")), F.lit("[REDACTED]")).otherwise(value)


def content_type(value: Column) -> Column:
    return F.when(F.regexp_like(value, F.lit(r"(?i)<(?:html|section|article)(?![A-Za-z0-9_])")), F.lit("html")).otherwise(F.lit("text"))


def folded(value: Column) -> Column:
    """White space as one space, lower case: how labels are compared."""
    return F.lower(normal_space(F.coalesce(value, F.lit(""))))


@F.pandas_udf(StringType())
def export_filename(title: pd.Series) -> pd.Series:
    """A file name of letters, digits and hyphens without diacritics; 'document' where nothing is left."""

    def name(text: str | None) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
        slug = re.sub(r"[^a-z0-9]+", "-", plain.lower()).strip("-")[:80].rstrip("-") or "document"
        return f"document-{slug}" if slug in RESERVED else slug

    return title.map(name, na_action=None)
