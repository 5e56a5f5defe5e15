"""JSON values of open shape as VARIANT: canonical texts, strict readings, kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """A JSON text with the keys of all its objects in order, without spaces, numbers in one notation: two texts are equal in
    this form if they hold the same value. Null for what is no JSON, and for objects that name a key twice. Parsing and
    ordering are those of VARIANT, nothing is compared as written."""
    told = F.to_json(F.try_parse_json(text))
    return F.regexp_replace(told, r'("(?:[^"\\]|\\.)*+")|([0-9])\.0(?=[,\]}E]|$)', "$1$2")  # whole doubles as integers, strings passed over


def kind_at(value: Column, path: str) -> Column:
    """The type of what stands at a path, as schema_of_variant names it; null where nothing does."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def text_at(value: Column, path: str) -> Column:
    """The text at a path; null for numbers and everything else."""
    return F.when(kind_at(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def boolean_at(value: Column, path: str) -> Column:
    return F.when(kind_at(value, path) == "BOOLEAN", F.try_variant_get(value, path, "boolean"))


def is_list(value: Column, path: str) -> Column:
    return F.coalesce(F.startswith(kind_at(value, path), F.lit("ARRAY")), F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))
