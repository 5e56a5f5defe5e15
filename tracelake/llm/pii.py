"""Operator 7, PII: information-theoretic sanitisation.

Mail addresses, IP addresses, card and phone numbers are found by patterns. Protected are their values, the domains of mail
addresses, and the four kinds themselves, since most values stand in one or two documents only. Over the whole corpus it is
counted in how many documents a term stands beside the entity (n_et), and in how many the entity (n_e) and the term (n_t)
occur: within some code points of a value or domain, anywhere in a document that has the kind. A term discloses the share

    pointwise mutual information / information content = ln(n_et N / (n_e n_t)) / ln(N / n_e)

of an entity, discounted by n_et / (n_et + 1) as few documents prove little. Terms that disclose more than a threshold of
some entity are removed above a second threshold and generalised below it. Only DataFrame functions are used.

A term is a maximal run of letters, lower-cased, of three letters at least; the terms of an entity's own text do not count
beside its kind. Defined results: a null text is an empty text and has no spans; every row is a document of its own, rows
repeated under one identifier count each and are cleaned each; a null identifier is kept. An entity that occurs in every
document discloses nothing. An empty table gives an empty result. Further columns pass through; one that has the name of an
output column (base and terms; clean_text) is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The kinds in their order. The patterns are those of the contract; a run that no match can begin inside
#: is entered at its start only, and repetitions that nothing follows never give back, so that long runs take linear time.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
TERM = r"\p{L}+"


@dataclass(frozen=True)
class PiiParams:
    """context: code points on each side of a value that count as beside it. threshold: disclosed share from which a term is
    generalised; remove_at: from which removed."""

    context: int = 80
    threshold: float = 0.7
    remove_at: float = 0.9
    replace: tuple[str, str] = ("[term]", "")


def located(text: Column, pattern: Column | str) -> Column:
    """The matches of a pattern with their places: array of (start, end, match), in code points."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    none = F.expr("cast(array() as array<struct<start:int,end:int,m:string>>)")

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(s["out"], F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"))).alias("out"))

    pairs = F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the sum of the digits, every second one from the right doubled and reduced, is a multiple of ten."""

    def step(s: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
        return s + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, "[.]", -1), lambda p: F.regexp_like(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _spans_of(text: Column, rank: int, kind: str) -> Column:
    hint = F.contains(text, F.lit("@")) if kind == "email" else F.regexp_like(text, F.lit(HINTS[kind]))
    found = F.coalesce(F.when(hint, located(text, PATTERNS[kind])), F.expr("cast(array() as array<struct<start:int,end:int,m:string>>)"))
    named = lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["m"].alias("m"))
    return F.transform(F.filter(found, lambda x: _valid(kind, x["m"])), named)


def base_spans(text: Column) -> Column:
    """array of (start, rank, end, kind, m), by start and then by kind."""
    parts = [_spans_of(text, rank, kind) for rank, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def text_terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"\P{L}+", -1)), lambda t: F.length(t) >= 3)


def _entities(x: Column) -> Column:
    """The value of a span, and the domain if it is a mail address."""
    domain = F.when(x["kind"] == "email", F.array(F.concat(F.lit("email:@"), F.lower(F.substring_index(x["m"], "@", -1)))))
    return F.concat(F.array(F.concat_ws(":", x["kind"], F.lower(x["m"]))), F.coalesce(domain, F.expr("cast(array() as array<string>)")))


def _beside(text: Column, spans: Column, context: int) -> Column:
    """The spans' values and domains with the terms wholly within the context: array of (entities, terms)."""

    def of_span(x: Column) -> Column:
        first = F.greatest(x["start"] - context - 1, F.lit(0))
        before = F.substring(text, first + 1, x["start"] - first)
        after = F.substring(text, x["end"] + 1, F.lit(context + 1))
        before = F.when(x["start"] > context, F.regexp_replace(before, r"^(?:\p{L}+|\P{L})", "")).otherwise(before)
        after = F.when(F.length(after) > context, F.regexp_replace(after, r"(?:\p{L}+|\P{L})$", "")).otherwise(after)
        return F.struct(_entities(x).alias("entities"), text_terms(F.concat(before, F.lit(" "), after)).alias("terms"))

    return F.transform(spans, of_span)


def disclosing_terms(docs: DataFrame, params: PiiParams = PiiParams(), text_col: str = "text") -> DataFrame:
    """(term, disclosed): the terms that disclose the threshold or more of some entity, stored."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = texts.select("text", base_spans(F.col("text")).alias("spans")).filter(F.size("spans") > 0).withColumn("doc", F.monotonically_increasing_id())
    own = text_terms(F.array_join("spans.m", " "))
    kinds = F.array_distinct("spans.kind")
    held = held.select("doc", _beside(F.col("text"), F.col("spans"), params.context).alias("beside"), kinds.alias("kinds"), F.array_except(text_terms(F.col("text")), own).alias("terms"))
    held = stored(held, "held")  # only documents with an entity
    spans = held.select("doc", F.explode("beside").alias("x")).select("doc", F.explode("x.entities").alias("entity"), F.col("x.terms").alias("terms"))
    pairs = spans.select("doc", "entity", F.explode("terms").alias("term")).distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et"))
    of_kinds = held.select(F.explode("kinds").alias("entity"), "terms").select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et"))
    least = params.threshold / (1 - params.threshold) if params.threshold < 1 else float("inf")  # with fewer the discount alone is too much
    pairs = stored(pairs.unionByName(of_kinds).filter(F.col("n_et") >= least * (1 - 1e-9)), "pairs")
    entities = spans.select("doc", "entity").distinct().select("entity").unionByName(held.select(F.explode("kinds").alias("entity"))).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    terms = texts.select(F.explode(text_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).filter(F.col("n_t") >= least * (1 - 1e-9))
    n_docs = texts.count()
    content = F.ln(F.lit(float(max(n_docs, 1))) / F.col("n_e"))
    shared = F.ln(F.col("n_et") * F.lit(float(n_docs)) / (F.col("n_e").cast("double") * F.col("n_t")))
    told = shared / content * F.col("n_et") / (F.col("n_et") + 1)
    scored = pairs.join(stored(entities, "entities"), "entity").join(stored(terms, "terms"), "term").filter(F.col("n_e") < n_docs).withColumn("disclosed", told)
    return stored(scored.groupBy("term").agg(F.max("disclosed").alias("disclosed")).filter(F.col("disclosed") >= params.threshold), "disclosing")


def _spans(docs: DataFrame, params: PiiParams, id_col: str, text_col: str) -> DataFrame:
    """(row, text, told, base, terms): the rows packed, the disclosing terms of their identifier, and the spans."""
    found = disclosing_terms(docs, params, text_col)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hits = rows.select("id", F.explode(text_terms(F.col("text"))).alias("term")).join(found, "term")
    hits = stored(hits.groupBy(F.col("id").alias("hit_id")).agg(F.collect_set(F.struct("term", "disclosed")).alias("told")), "hits")  # as many as the texts of an identifier have terms
    rows = rows.join(hits, F.col("id").eqNullSafe(F.col("hit_id")), "left")
    rank = F.lit(len(KINDS))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        here = F.struct(start.alias("start"), rank.alias("rank"), end.alias("end"), F.lit("term").alias("kind"), x["m"].alias("m"))
        return F.struct(end.alias("at"), F.when(F.exists("told", lambda t: t["term"] == F.lower(x["m"])), F.array_append(s["out"], here)).otherwise(s["out"]).alias("out"))

    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,m:string>>)")
    words, gaps = F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.split("text", TERM, -1)
    pairs = F.arrays_zip(words.alias("m"), F.slice(gaps, F.lit(1), F.size(words)).alias("gap"))
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    rows = rows.withColumn("base", base_spans(F.col("text")))
    outside = F.filter(spans, lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return rows.select("row", "text", "told", "base", F.when(F.col("told").isNotNull(), outside).otherwise(none).alias("terms"))


def find_spans(docs: DataFrame, params: PiiParams = PiiParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with `base` and `terms`: arrays of (start, rank, end, kind, m), the second with the kind term."""
    rows = _spans(docs, params, id_col, text_col)
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("base", "terms")], "base", "terms")


def sanitise(docs: DataFrame, params: PiiParams = PiiParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with `clean_text`: entities become their kind in brackets, disclosing terms are generalised or removed."""
    general, gone = params.replace

    def step(s: Column, x: Column) -> Column:
        strong = F.exists("told", lambda t: (t["term"] == F.lower(x["m"])) & (t["disclosed"] >= params.remove_at))
        put = F.when(x["kind"] != "term", F.concat(F.lit("["), x["kind"], F.lit("]"))).when(strong, F.lit(gone)).otherwise(F.lit(general))
        text = F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), put)
        over = x["start"] < s["at"]
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(over, s["out"]).otherwise(text).alias("out"))

    rows = _spans(docs, params, id_col, text_col)
    rows = rows.select("row", "text", F.aggregate(F.array_sort(F.concat("base", "terms")), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step).alias("done"))
    rest = F.substring(F.col("text"), F.col("done.at") + 1, F.length("text"))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "clean_text"], F.concat("done.out", rest).alias("clean_text"))
