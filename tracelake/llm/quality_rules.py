"""Operator 1, quality rules: cross-document line frequency.

Lines are normalised and hashed, the distinct documents of each line are counted per host, lines above the limits are
removed, and documents that keep too little are rejected.

Defined results: every row is a document of its own (rows repeated under one identifier count each). A null text is an
empty text; a null host is one host of its own; a null identifier is kept. Lines without a letter or digit are never
frequent. An empty table gives an empty result. Input columns are addressed by name, so further columns pass through
`clean_documents`; one that has the name of an output column is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, list_array, null_safe, slices, stored, windows

FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = [*FIGURES, "line_hash", "line_words"]
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class LineRules:
    """max_share: a line is frequent on a host if more than this share of its documents have it, and more than min_docs of
    them, so that a small host needs some copies too. min_kept: a document is depleted if less than this share of its words
    is left."""

    min_docs: int = 4
    max_share: float = 0.005
    min_kept: float = 0.5
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8


def normal_line(line: str) -> str:
    """Lower case, runs of anything but letters and digits as one space, digits as 0."""
    return re.sub(r"\d", "0", re.sub(r"[\W_]+", " ", line.lower())).strip()


def _features(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            texts = pc.fill_null(part.column(1), "")
            words = Words(texts)
            chars = np.asarray(pc.utf8_length(words.dictionary), dtype=np.int64)
            symbols = np.asarray(pc.count_substring_regex(words.dictionary, SYMBOLS), dtype=np.int64)
            hashed, at = windows(words.codes.astype(np.uint64) + np.uint64(1), words.owner, window)
            hashed ^= (words.owner[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            order = np.argsort(hashed)
            same = hashed[order][1:] == hashed[order][:-1]
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(len(words.codes) + 1, np.int64)
            np.add.at(edge, at[twice], 1)
            np.add.at(edge, at[twice] + window, -1)
            covered = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
            repeated = covered[words.starts[1:]] - covered[words.starts[:-1]]
            dup, hashes, sizes = [], [], []
            for text in texts.to_pylist():
                lines = text.split("\n")
                filled = [x for x in lines if x.strip(BLANK)]
                dup.append(len(filled) - len(set(filled)))
                keys = [normal_line(x) for x in lines]
                hashes.append(np.array([xxhash.xxh3_64_intdigest(k) if k else 0 for k in keys], np.uint64))
                sizes.append(np.array([len(x.encode().split()) for x in lines], np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(words.counts), pa.array(words.per_text(chars)), pa.array(words.per_text(symbols)), pa.array(np.array(dup, np.int64)), pa.array(repeated.astype(np.int64)), list_array(hashes, pa.int64()), list_array(sizes, pa.int32())],
                ["id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hash", "line_words"],
            )


def line_features(df: DataFrame, rules: LineRules, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One small row per document: word figures and the hashes and word counts of its lines (stored)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))
    fields = [T.StructField("id", rows.schema["id"].dataType), T.StructField("host", T.StringType())]
    fields += [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [T.StructField("line_hash", T.ArrayType(T.LongType())), T.StructField("line_words", T.ArrayType(T.IntegerType()))]
    size = rules.window
    return stored(rows.mapInArrow(lambda it: _features(it, size), T.StructType(fields)), "lines")


def frequent_lines(features: DataFrame, rules: LineRules) -> DataFrame:
    """(host, line, n_docs) of the lines above the limits, stored so that its size is known to the join."""
    lines = features.select("host", F.explode(F.array_distinct("line_hash")).alias("line")).filter("line <> 0")
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > rules.min_docs)
    hosts = stored(features.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs")), "hosts")
    return stored(counts.join(hosts, "host").filter(F.col("n_docs") > F.col("host_docs") * rules.max_share).drop("host_docs"), "frequent")


def removed_lines(features: DataFrame, frequent: DataFrame) -> DataFrame:
    """(r_id, r_host, removed): the hashes of the lines to remove from the documents of an identifier and host. A line
    goes from every document of its host, so that documents which share both may share one list."""
    lines = features.select("id", "host", F.explode(F.array_distinct("line_hash")).alias("line")).filter("line <> 0")
    found = lines.join(frequent.drop("n_docs"), ["host", "line"])
    return found.groupBy(F.col("id").alias("r_id"), F.col("host").alias("r_host")).agg(F.collect_set("line").alias("removed"))


def _judged(rows: DataFrame, rules: LineRules) -> DataFrame:
    gone = F.expr("aggregate(arrays_zip(line_hash, line_words), 0L, (s, x) -> s + if(array_contains(removed, x.line_hash), x.line_words, 0))")
    gone = F.when(F.col("removed").isNull(), F.lit(0).cast("long")).otherwise(gone)
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    rows = rows.withColumn("removed_words", gone).withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= F.lit(rules.min_kept) * F.col("n_words")))


def score_documents(df: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row per document, without its text: identifier, host, the base figures, base_failed, kept, the number of words
    on removed lines, and the hashes of these lines."""
    features = line_features(df, rules, id_col, text_col, host_col)
    found = removed_lines(features, frequent_lines(features, rules))
    rows = _judged(features.join(found, null_safe(features, found, [("id", "r_id"), ("host", "r_host")]), "left"), rules)
    return rows.select(F.col("id").alias(id_col), "host", *FIGURES, "base_failed", "kept", "removed_words", "removed")


def clean_documents(df: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The input with `clean_text` (without its frequent lines), `removed_words` and `kept`."""
    features = line_features(df, rules, id_col, text_col, host_col)
    found = removed_lines(features, frequent_lines(features, rules))
    packed = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.struct(*df.columns).alias("row"))
    size, kinds = rules.window, {f.name: f for f in features.schema.fields}

    def add(batches):
        for batch in batches:
            for part in slices(batch):
                figures = next(_features(iter([part]), size))
                yield pa.RecordBatch.from_arrays([*part.columns, *(figures.column(c) for c in MORE)], [*part.schema.names, *MORE])

    rows = packed.mapInArrow(add, T.StructType([*packed.schema.fields, *(kinds[c] for c in MORE)]))
    rows = _judged(rows.join(found, null_safe(rows, found, [("id", "r_id"), ("host", "r_host")]), "left"), rules)
    left = F.filter(F.arrays_zip(F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("line"), "line_hash"), lambda x: ~F.coalesce(F.array_contains("removed", x["line_hash"]), F.lit(False)))
    rows = rows.withColumn("clean_text", F.array_join(F.transform(left, lambda x: x["line"]), "\n"))
    new = ["clean_text", "removed_words", "kept"]
    return rows.select(*(F.col("row")[c].alias(c) for c in df.columns if c not in new), *new)
