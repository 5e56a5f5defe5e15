"""API documentation: operations, types, endpoints, authentication and pagination out of HTML and text, as rows.

Documents are rows (doc_id, content); a null content gives no rows. Everything is column expressions; a line, match or table
row is a row of the result, so long documents are split, not collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.names import redacted_value
from tracelake.functions.text import normal_space, plain_html, redacted

NAME = "[_A-Za-z][_0-9A-Za-z]*"
#: Patterns of lines that document an operation, a type, a field, a REST call.
HEADING = r"(?i)^(Query|Mutation|Subscription)\s*:?\s*$"
SIGNATURE = rf"(?i)^(?:(Query|Mutation|Subscription)\s+)?({NAME})\s*\(([^)]*)\)\s*:\s*(\S+)(?:\s+-\s+(.+))?$"
TYPE = rf"(?i)^Type\s+({NAME})(?:\s+-\s+(.+))?$"
FIELD = rf"^({NAME})\s*:\s*(\S+)(?:\s+-\s+(.+))?$"
REST = r"(?i)^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(/\S+)"
ARGUMENT = rf"^\s*({NAME})\s*:\s*([^=\s]+)(?:\s*=\s*(.+?))?\s*$"
SECTION = r"""(?is)<section\b[^>]*\bid=["'](?:query|mutation|subscription)-[^"']+["'][^>]*>.*?</section>"""
HEADER = r"(?i)\b(?:Authorization|Content-Type|CustomerSubDomain|X-[A-Za-z0-9-]+)\b\s*:\s*[^\n]{0,100}"
PAGINATION = r"(?i)[^.\n]{0,100}\bpagination\b[^.\n]{0,160}"
URL = r"""https?://[^\s<>'"`]+"""
REGION = r"(?i)\b(?:US|EU|UK|AU|APAC|EMEA)\b"


def _part(value: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text): trimmed lines, numbered from 1."""
    rows = docs.select("doc_id", F.posexplode(F.split("content", "\r?\n")).alias("line", "text"))
    return rows.select("doc_id", (F.col("line") + 1).alias("line"), F.trim(F.regexp_replace("text", r"[ \t\f\x0B]+$|^[ \t\f\x0B]+", "")).alias("text"))


def parse_arguments(value: Column) -> Column:
    """'a: T = d, b: U' as an array of (name, type, default_value)."""
    parts = F.filter(F.split(value, ","), lambda p: F.regexp_like(p, F.lit(ARGUMENT)))
    return F.transform(parts, lambda p: F.struct(_part(p, ARGUMENT, 1).alias("name"), _part(p, ARGUMENT, 2).alias("type"), _part(p, ARGUMENT, 3).alias("default_value")))


def text_operations(docs: DataFrame) -> DataFrame:
    """(doc_id, line, type, name, arguments, return_type, description): signatures in lines, whose type stands before them or
    is carried on from the last heading, and REST calls (type unknown)."""
    rows = lines(docs).withColumn("heading", F.lower(_part(F.col("text"), HEADING, 1)))
    carried = F.last("heading", ignorenulls=True).over(W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0))  # the lines of a document
    rows = rows.withColumn("carried", carried)
    signed = rows.filter(F.regexp_like("text", F.lit(SIGNATURE))).withColumn("type", F.coalesce(F.lower(_part(F.col("text"), SIGNATURE, 1)), "carried")).filter("type is not null")
    signed = signed.select("doc_id", "line", "type", _part(F.col("text"), SIGNATURE, 2).alias("name"), parse_arguments(F.regexp_extract("text", SIGNATURE, 3)).alias("arguments"), _part(F.col("text"), SIGNATURE, 4).alias("return_type"), normal_space(_part(F.col("text"), SIGNATURE, 5)).alias("description"))
    calls = rows.filter(F.regexp_like("text", F.lit(REST)))
    name = F.concat_ws(" ", F.upper(F.regexp_extract("text", REST, 1)), F.regexp_extract("text", REST, 2))
    none = F.expr("cast(array() as array<struct<name:string,type:string,default_value:string>>)")
    return signed.unionByName(calls.select("doc_id", "line", F.lit("unknown").alias("type"), name.alias("name"), none.alias("arguments"), F.lit(None).cast("string").alias("return_type"), F.lit(None).cast("string").alias("description")))


def text_types(docs: DataFrame) -> DataFrame:
    """(doc_id, line, type_name, name, type, description): the fields that follow a type heading without a gap."""
    rows = lines(docs).withColumn("field", F.regexp_like("text", F.lit(FIELD))).withColumn("of", _part(F.col("text"), TYPE, 1))
    ordered = W.partitionBy("doc_id").orderBy("line")  # the lines of a document
    rows = rows.withColumn("block", F.count_if(~F.col("field")).over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    heads = rows.filter("of is not null").select("doc_id", "block", "of")
    fields = rows.filter("field").drop("of").join(heads, ["doc_id", "block"])
    return fields.select("doc_id", "line", F.col("of").alias("type_name"), _part(F.col("text"), FIELD, 1).alias("name"), _part(F.col("text"), FIELD, 2).alias("type"), normal_space(_part(F.col("text"), FIELD, 3)).alias("description"))


def property_rows(body: Column) -> Column:
    """The rows of a table of properties as an array of (name, type, description); rows without a name or type are left out."""
    cell = lambda r, kind: normal_space(plain_html(F.regexp_extract(r, rf"(?is)property-{kind}.*?<code>(.*?)</code>", 1)))
    second = lambda r: normal_space(plain_html(F.coalesce(F.try_element_at(F.regexp_extract_all(r, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), F.lit(2)), F.lit(""))))
    rows = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: F.struct(cell(r, "name").alias("name"), cell(r, "type").alias("type"), F.nullif(second(r), F.lit("")).alias("description")))
    return F.filter(rows, lambda x: (x["name"] != "") & (x["type"] != ""))


def html_operations(docs: DataFrame) -> DataFrame:
    """(doc_id, type, name, return_type, arguments): the operation sections of an HTML reference."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("content", F.lit(SECTION), F.lit(0))).alias("body"))
    key = r"""(?is)<section\b[^>]*\bid=["'](query|mutation|subscription)-([^"']+)["']"""
    heading = normal_space(plain_html(F.regexp_extract("body", r"""(?is)<h2\b[^>]*class=["'][^"']*operation-heading[^"']*["'][^>]*>(.*?)</h2>""", 1)))
    returned = normal_space(plain_html(F.regexp_extract("body", r"(?is)operation-response.*?<code>(.*?)</code>", 1)))
    table = F.regexp_extract("body", r"(?is)operation-arguments.*?<tbody>(.*?)</tbody>", 1)
    name = F.coalesce(F.nullif(heading, F.lit("")), F.regexp_extract("body", key, 2))
    return found.select("doc_id", F.lower(F.regexp_extract("body", key, 1)).alias("type"), name.alias("name"), F.nullif(returned, F.lit("")).alias("return_type"), property_rows(table).alias("arguments"))


def endpoints(docs: DataFrame) -> DataFrame:
    """(doc_id, value, region): URLs whose surroundings speak of an API, with the last region named before them."""
    gaps, found = F.split("content", URL, -1), F.regexp_extract_all("content", F.lit(URL), F.lit(0))
    places = F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: F.aggregate(F.slice(F.arrays_zip(gaps.alias("g"), found.alias("u")), F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x["g"]) + F.length(x["u"])) - F.length(F.element_at(found, i)))
    rows = docs.filter(F.regexp_like("content", F.lit(URL))).select("doc_id", "content", F.explode(F.arrays_zip(found.alias("raw"), places.alias("at"))).alias("x"))
    rows = rows.select("doc_id", "content", F.regexp_replace("x.raw", "[),.;]+$", "").alias("value"), F.col("x.at").alias("at"))
    start = lambda n: F.greatest(F.col("at") - n, F.lit(0))
    context = F.substring(F.col("content"), start(120) + 1, F.col("at") + F.length("value") + 80 - start(120))
    before = F.substring(F.col("content"), start(100) + 1, F.col("at") - start(100))
    region = F.upper(F.try_element_at(F.regexp_extract_all(before, F.lit(REGION), F.lit(0)), F.lit(-1)))
    return rows.filter(F.regexp_like(context, F.lit(r"(?i)\b(?:api|endpoint|graphql)\b"))).select("doc_id", "value", region.alias("region"))


def authentication(docs: DataFrame) -> DataFrame:
    """(doc_id, header, purpose, scheme): header lines that speak of authentication, redacted."""
    rows = docs.select("doc_id", F.explode(F.regexp_extract_all("content", F.lit(HEADER), F.lit(0))).alias("raw")).withColumn("text", normal_space(F.col("raw")))
    rows = rows.filter(F.regexp_like("text", F.lit("(?i)auth|bearer|token|json|header|subdomain")))
    name = F.regexp_extract("text", r"^([A-Za-z0-9-]+)", 1)
    known = F.when(F.lower(name) == "authorization", F.lit("Authorization")).when(F.lower(name) == "content-type", F.lit("Content-Type")).when(F.lower(name) == "customersubdomain", F.lit("CustomerSubDomain")).otherwise(name)
    scheme = F.when(F.regexp_like("text", F.lit(r"(?i)\bBearer\b")), F.lit("Bearer"))
    return rows.select("doc_id", known.alias("header"), redacted(F.col("text")).alias("purpose"), scheme.alias("scheme"))


def pagination(docs: DataFrame) -> DataFrame:
    """(doc_id, text): what is said of pagination within a sentence and line; only those that name it are searched."""
    named = lambda x: F.contains(F.lower(x), F.lit("pagination"))
    sentences = docs.filter(named(F.col("content"))).select("doc_id", F.explode(F.filter(F.split("content", r"[.\n]"), named)).alias("sentence"))
    rows = sentences.select("doc_id", F.explode(F.regexp_extract_all("sentence", F.lit(PAGINATION), F.lit(0))).alias("text"))
    return rows.select("doc_id", normal_space(F.col("text")).alias("text"))


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id): the documents that have operations with a type, each once. Lines are made of those that can have a signature."""
    able = [F.contains("content", F.lit(sign)) for sign in "():"]
    rows = lines(docs.filter(able[0] & able[1] & able[2])).withColumn("type", F.lower(_part(F.col("text"), HEADING, 1)))
    is_signature = F.contains("text", F.lit("(")) & F.regexp_like("text", F.lit(SIGNATURE))
    rows = rows.filter(F.col("type").isNotNull() | is_signature).withColumn("is_signature", is_signature)
    own = F.when(F.col("is_signature"), _part(F.col("text"), SIGNATURE, 1)).isNotNull()
    at = rows.groupBy("doc_id").agg(F.min(F.when(F.col("type").isNotNull(), F.col("line"))).alias("heading"), F.max(F.when(F.col("is_signature"), F.col("line"))).alias("last"), F.max(own).alias("own"))
    return at.filter("own or heading <= last").select("doc_id")


def api_style(content: Column, n_operations: Column) -> Column:
    """graphql, rest or unknown. Markup is only taken off where the text names GraphQL, or may by a reference."""
    may = F.contains(F.lower(content), F.lit("graphql")) | F.contains(content, F.lit("&"))
    graphql = (n_operations > 0) | F.when(may, F.regexp_like(plain_html(content), F.lit(r"(?i)\bGraphQL\b"))).otherwise(F.lit(False))
    rest = F.when(F.contains(content, F.lit("/")), F.regexp_like(content, F.lit(r"(?im)^\s*(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+/\S+"))).otherwise(F.lit(False))
    return F.when(graphql, F.lit("graphql")).when(rest, F.lit("rest")).otherwise(F.lit("unknown"))


def merged_types(fields: DataFrame) -> DataFrame:
    """(type_name, n_definitions, n_fields, conflict) of fields (doc_id, type_name, name, type): types by name, the union of
    their fields, and whether their definitions differ."""
    whole = fields.groupBy("type_name", "doc_id").agg(F.array_sort(F.collect_set(F.struct("name", "type"))).alias("signature"))  # the fields of one definition
    shown = whole.groupBy("type_name").agg(F.count(F.lit(1)).alias("n_definitions"), (F.count_distinct("signature") > 1).alias("conflict"))
    merged = fields.groupBy("type_name").agg(F.count_distinct("name", "type").alias("n_fields"))
    return shown.join(merged, "type_name").select("type_name", "n_definitions", "n_fields", "conflict")


def safe_arguments(arguments: Column) -> Column:
    """Arguments with need (a type that ends with !) and a default without credentials."""
    return F.transform(arguments, lambda a: F.struct(a["name"].alias("name"), a["type"].alias("type"), F.endswith(a["type"], F.lit("!")).alias("required"), redacted_value(a["default_value"]).alias("default_value")))
