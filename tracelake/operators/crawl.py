"""What a page offers to follow: the rank of its targets, which of them are taken, and whether a state may be left at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.names import filled
from tracelake.functions.text import mutation_term, stable_hash
from tracelake.functions.urls import origin, url_path

#: Kinds of targets, the best first.
PRIORITIES = ["explicit-navigation", "strong-custom-navigation", "supporting-navigation", "safe-control", "utility-navigation", "unknown", "semantic-image", "form-control"]
#: Roles and tags of form controls, and roles of controls.
FORM_ROLES = ["textbox", "searchbox", "combobox", "checkbox", "radio", "switch", "option"]
FORM_TAGS = ["input", "textarea", "select"]
CONTROLS = ["button", "menuitem", "tab"]


def priority(source: Column, role: Column, tag: Column, declared: Column, resolved: Column, navigation: Column, strength: Column, url: Column) -> Column:
    """What kind of target something on the page with this address is; source: semantic-element or interaction-candidate."""
    element = source == "semantic-element"
    form = element & (F.coalesce(role.isin(*FORM_ROLES), F.lit(False)) | F.coalesce(tag.isin(*FORM_TAGS), F.lit(False)))
    linked = (filled(declared) != "") & (filled(resolved) != "")
    fragment = F.startswith(declared, F.lit("#")) & ~F.startswith(declared, F.lit("#/")) & (url_path(resolved) == url_path(url))
    custom = (source == "interaction-candidate") & (navigation == "custom-navigation")
    kind = F.when(form, F.lit("form-control")).when(element & (role == "img"), F.lit("semantic-image")).when(linked & fragment, F.lit("utility-navigation")).when(linked, F.lit("explicit-navigation"))
    kind = kind.when(custom & (strength == "strong"), F.lit("strong-custom-navigation")).when(custom, F.lit("supporting-navigation"))
    return kind.when(element & role.isin(*CONTROLS), F.lit("safe-control")).otherwise(F.lit("unknown"))


def ranked_targets(targets: DataFrame, limit: int = 10) -> DataFrame:
    """targets (state_id, target_id, priority, dom_path) with place, from 1 in the order of priority, path and identifier, and
    skipped_id, which is null for the first `limit` of a state."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority"))
    rows = targets.withColumn("place", F.row_number().over(W.partitionBy("state_id").orderBy(rank, "dom_path", "target_id")).cast("long"))  # the targets of one page
    skipped = F.concat(F.lit("runtime-skipped:"), stable_hash(F.concat_ws("|", "state_id", "target_id", F.lit("not-eligible"))))
    return rows.withColumn("skipped_id", F.when(F.col("place") > limit, skipped))


def state_stops(states: DataFrame, elements: DataFrame, texts: DataFrame, origins: list[str], authenticated: bool = False) -> DataFrame:
    """(state_id, stops, expandable) for states (state_id, origin, mutated): a state stops at an origin that is not allowed, at a
    form to log in (a password field, or a text field with the words and the button for it), and after a change of data.
    elements: (state_id, role, input_type, name); texts: (state_id, place, text), a word may stand across two of them."""
    words = F.lower(F.concat_ws(" ", "text", F.lead("text").over(W.partitionBy("state_id").orderBy("place"))))  # the texts of one page
    login = texts.select("state_id", F.regexp_like(words, F.lit(r"\b(login|log in|sign in)\b")).alias("login")).groupBy("state_id").agg(F.bool_or("login").alias("login"))
    button = (F.col("role") == "button") & F.regexp_like(F.lower("name"), F.lit("^(next|login|log in|sign in)$"))
    seen = elements.groupBy("state_id").agg(F.bool_or(F.coalesce(F.col("input_type") == "password", F.lit(False))).alias("password"), F.bool_or(F.coalesce(F.col("role").isin("textbox", "searchbox"), F.lit(False))).alias("box"), F.bool_or(F.coalesce(button, F.lit(False))).alias("button"))
    rows = states.join(seen, "state_id", "left").join(login, "state_id", "left").fillna(False, ["password", "box", "button", "login"])
    outside, form = ~F.col("origin").isin(*origins), F.col("password") | (F.col("box") & F.col("login") & F.col("button"))
    stops = F.array_compact(F.array(F.when(F.col("mutated"), F.lit("mutation-observed")), F.when(outside, F.lit("origin-boundary")), F.when(form, F.lit("session-expired" if authenticated else "form-state"))))
    return rows.select("state_id", stops.alias("stops"), (F.size(stops) == 0).alias("expandable"))


def captured_targets(wanted: DataFrame, targets: DataFrame) -> DataFrame:
    """wanted (state_id, target_id, tag, text) with status: missing, ambiguous, stale (another tag or text than was seen) or
    resolved, from the targets (state_id, target_id, tag, text)."""
    found = targets.groupBy("state_id", "target_id").agg(F.count(F.lit(1)).alias("n"), F.min("tag").alias("now_tag"), F.min("text").alias("now_text"))
    fold = lambda c: F.trim(F.regexp_replace(filled(F.col(c)), r"[ \t\r\n\f\x0B]+", " "))
    same = (F.col("tag") == F.col("now_tag")) & ((fold("text") == "") | (fold("text") == fold("now_text")))
    status = F.when(F.col("n").isNull(), F.lit("missing")).when(F.col("n") > 1, F.lit("ambiguous")).when(F.coalesce(same, F.lit(False)), F.lit("resolved")).otherwise(F.lit("stale"))
    return wanted.join(found, ["state_id", "target_id"], "left").select("state_id", "target_id", status.alias("status"))


def transition_ids(transitions: DataFrame) -> DataFrame:
    """transitions (src, dst, target_id, failed) with id and status."""
    failed = F.coalesce("failed", F.lit(False))
    parts = F.when(failed, F.concat_ws("|", "src", "target_id", F.lit("failed"))).otherwise(F.concat_ws("|", "src", F.coalesce("dst", F.lit("none")), "target_id"))
    return transitions.select(F.concat(F.lit("runtime-transition:"), stable_hash(parts)).alias("id"), "src", "dst", "target_id", F.when(failed, F.lit("failed")).otherwise(F.lit("observed")).alias("status"))


#: Words of entries to a session, and what shows that a custom target navigates.
ENTRIES = ["login", "log in", "sign in"]
CONTEXTS = ["navigation-context", "menu-context", "repeated-clickable-sibling-group"]


def probe_safety(targets: DataFrame, origins: list[str] | None = None, entries: list[str] | None = None) -> DataFrame:
    """targets (source, texts, submits, input_type, declared, resolved, page_url, strength, navigation, evidence, in_form) with
    decision (blocked, allowed or unknown) and reasons, by the first rule that applies: words of a change, a form that would be
    sent, where a link leads, strong evidence of navigation, strong evidence of an entry to a session. texts: all that the
    target is called; in_form: whether it stands in a form or belongs to one. origins: allowed beside that of the page."""
    told = F.array_join(F.transform("texts", lambda t: F.coalesce(t, F.lit(""))), " ")
    change = mutation_term(told)
    declared, resolved = filled(F.col("declared")), filled(F.col("resolved"))
    scheme = F.lower(F.regexp_extract(declared, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    absolute = F.regexp_like(resolved, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:"))
    protocol = F.when(absolute, F.lower(F.regexp_extract(resolved, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))).otherwise(F.lit("https"))
    outside = absolute & (origin(resolved) != origin(F.col("page_url"))) & ~F.coalesce(origin(resolved).isin(origins or []), F.lit(False))
    strong = F.coalesce((F.col("source") == "interaction-candidate") & (F.col("strength") == "strong"), F.lit(False))
    custom = F.coalesce((F.col("navigation") == "custom-navigation") & F.array_contains("evidence", "strong-click-evidence") & F.arrays_overlap("evidence", F.array(*[F.lit(c) for c in CONTEXTS])), F.lit(False))
    entry = mutation_term(told, entries or ENTRIES).isNotNull()
    free = strong & ~F.coalesce("in_form", F.lit(False))
    clear = ["no-destructive-signal", "not-form-submit"]
    rule = lambda decision, *reasons: F.struct(F.lit(decision).alias("decision"), F.array(*[r if isinstance(r, Column) else F.lit(r) for r in reasons]).alias("reasons"))
    web = ["http", "https"]
    found = F.when(change.isNotNull(), rule("blocked", F.concat(F.lit("destructive-action-text:"), change)))
    found = found.when(F.coalesce("submits", F.lit(False)) | (filled(F.col("input_type")) == "submit"), rule("blocked", "form-submission"))
    linked = (declared != "") | (resolved != "")
    found = found.when(linked & (scheme != "") & ~scheme.isin(web), rule("blocked", F.concat(F.lit("unsupported-navigation-scheme:"), scheme)))
    found = found.when(linked & (resolved == ""), rule("unknown", "unresolved-navigation-destination"))
    found = found.when(linked & ~protocol.isin(web), rule("blocked", F.concat(F.lit("unsupported-navigation-scheme:"), protocol)))
    found = found.when(linked & outside, rule("blocked", "cross-origin")).when(linked, rule("allowed", "safe-same-origin-navigation", *clear))
    found = found.when(free & custom, rule("allowed", "strong-interaction-evidence", "structural-navigation-context", *clear)).when(free & entry, rule("allowed", "strong-interaction-evidence", "authentication-entry", *clear))
    last = F.when(strong, F.lit("strong-interaction-without-safe-navigation-evidence")).otherwise(F.lit("insufficient-safe-navigation-evidence"))
    found = found.otherwise(rule("unknown", last))
    return targets.withColumn("__found", found).select(*[c for c in targets.columns if c not in ("decision", "reasons")], "__found.decision", "__found.reasons")
