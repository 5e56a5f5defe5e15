"""Operator 10, toxicity: non-negative positive-unlabelled learning.

A logistic scorer over words and word stems is trained with numpy from texts that are confirmed toxic and from unlabelled
texts, by minimising the class-prior-corrected risk whose negative part may not fall below zero. A word counts as there or
not there; a stem (the first letters of a word) counts by how dense its words stand in the text. The fit reads a bounded
sample (`PuParams.max_positive`, `max_unlabelled`), in which Spark counts and picks the features; the driver gets only the
picked features of each sampled text. Scoring reads every whole text.

Defined results: a null or empty text gets the score of a text without words. A row is scored on its text alone, so rows
repeated under one identifier are scored each for itself; a null identifier is scored and never learnt from. Without any
positive label every score is the class prior, and without any usable label the least prior, so that nothing is toxic. An empty table gives an empty result. Further input columns pass through
`score`; one that has the name of an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, list_array, slices, stored

#: A full count of a feature: densities are kept as whole numbers of this part, so that sums do not depend on their order.
FULL = 64


@dataclass(frozen=True)
class PuParams:
    """max_positive, max_unlabelled: bounds of the sample that the fit reads. n_features: at most so many features get a
    weight, of those whose means differ by min_z standard errors. stems: lengths of stems. dense: a stem counts in full
    where one word in so many has it. threshold: a score from which a text counts as toxic."""

    max_positive: int = 4000
    max_unlabelled: int = 16000
    n_features: int = 512
    min_z: float = 4.0
    stems: tuple[int, ...] = (4, 6)
    dense: int = 50
    steps: int = 600
    rate: float = 0.05
    l2: float = 1e-4
    slack: float = 0.0
    threshold: float = 0.3


@dataclass(frozen=True)
class PuModel:
    """Feature hashes in ascending order, a weight for each, the bias, and the prior."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def held_out(id_col: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the identifier as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def _hashed(words: pa.Array) -> np.ndarray:
    held = Words.__new__(Words)
    held.dictionary = words
    return np.where(np.asarray(pc.equal(words, "")).astype(bool), np.uint64(0), held.hashes())


def _features(texts: pa.Array, params: PuParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and count (1 to FULL) of the features of each text."""
    words = Words(pc.utf8_lower(pc.fill_null(texts, "")))
    bare = pc.utf8_trim(words.dictionary, characters=".,;:!?\"'()[]{}*#%$&|<>-_/\\")
    found = [(_hashed(bare), 1)]
    for k in params.stems:
        cut = pc.if_else(pc.greater_equal(pc.utf8_length(bare), k), pc.binary_join_element_wise(str(k), pc.utf8_slice_codeunits(bare, 0, k), "^"), "")
        found.append((_hashed(cut), 0))
    owners, keys, counts = [], [], []
    for hashed, whole in found:
        _, code = np.unique(hashed, return_inverse=True)
        mark = np.flatnonzero(hashed[words.codes]) if len(words.codes) else np.empty(0, np.int64)
        n = int(code.max()) + 1 if len(code) else 1
        pair, first, count = np.unique(words.owner[mark] * n + code[words.codes[mark]], return_index=True, return_counts=True)
        owner = pair // n
        owners.append(owner), keys.append(hashed[words.codes[mark[first]]])
        counts.append(np.full(len(pair), FULL) if whole else np.maximum(1, np.minimum(FULL, FULL * params.dense * count // words.counts[owner])))
    return np.concatenate(owners), np.concatenate(keys), np.concatenate(counts)


def _sampled(batches: Iterator[pa.RecordBatch], params: PuParams) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            owner, keys, counts = _features(part.column(1), params)
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(1, part.num_rows))
            yield pa.RecordBatch.from_arrays([part.column(0), list_array(np.split(keys[order], cuts), pa.int64()), list_array(np.split(counts[order], cuts), pa.int32())], ["positive", "keys", "counts"])


def fit(docs: DataFrame, labels: DataFrame, params: PuParams = PuParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> PuModel:
    """Train on at most max_positive + max_unlabelled rows, those with the least hash of their identifier and then text."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("y").isNotNull())
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    total, toxic = known.agg(F.count(F.lit(1)), F.sum(F.when(F.col("y") == 1, 1).otherwise(0))).first()
    prior = min(0.95, max(1e-4, (toxic or 0) / total)) if total else 1e-4
    if not toxic:
        return PuModel(np.empty(0, np.uint64), np.empty(0), float(np.log(prior / (1 - prior))), prior)
    order = [F.xxhash64(F.col("id").cast("string"), F.lit("pu")), F.col("id")]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(~held_out(F.col("id")) & F.col("id").isNotNull()).withColumn("hash", F.xxhash64("text"))
    wanted = F.broadcast(known.filter("y = 1").orderBy(*order).limit(params.max_positive).select("id"))  # max_positive identifiers at most
    positive = texts.join(wanted, "id").select("id", "hash").orderBy(*order, "hash").limit(params.max_positive).select("id", "hash", F.lit(True).alias("positive"))
    unlabelled = texts.select("id", "hash").orderBy(*order, "hash").limit(params.max_unlabelled).select("id", "hash", F.lit(False).alias("positive"))
    chosen = positive.unionByName(unlabelled).groupBy("positive", "id", "hash").agg(F.count(F.lit(1)).cast("int").alias("n"))
    rows = texts.join(F.broadcast(chosen), ["id", "hash"])  # at most max_positive + max_unlabelled rows
    rows = rows.groupBy("positive", "id", "hash", "n").agg(F.first("text").alias("text"))  # equal rows: as many as were sampled
    rows = rows.select("positive", "text", F.explode(F.sequence(F.lit(1), "n"))).select("positive", "text")
    sample = stored(rows.mapInArrow(lambda it: _sampled(it, params), "positive boolean, keys array<bigint>, counts array<int>"), "pu-sample")
    n_p, n_u = (max(1, int(n or 0)) for n in sample.agg(F.sum(F.col("positive").cast("int")), F.sum((~F.col("positive")).cast("int"))).first())
    picked = np.sort(np.array([r[0] for r in _picked(sample, n_p, n_u, params).collect()], np.int64).view(np.uint64))  # n_features at most

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, counts = [], []
            for keys, count in zip(batch.column(1), batch.column(2)):
                keys, count = np.asarray(keys.values).view(np.uint64), np.asarray(count.values)
                held = np.isin(keys, picked)
                codes.append(np.searchsorted(picked, keys[held])), counts.append(count[held].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(codes, pa.int32()), list_array(counts, pa.int32())], ["positive", "codes", "counts"])

    table = sample.mapInArrow(narrow, "positive boolean, codes array<int>, counts array<int>").toArrow()  # a bounded sample
    sizes = np.asarray(pc.list_value_length(table.column("codes")), dtype=np.int64)
    flat = {c: np.asarray(pc.list_flatten(table.column(c)), dtype=np.int64) for c in ("codes", "counts")}
    mark = np.asarray(table.column("positive")).astype(bool)
    weights, bias = train(mark, np.repeat(np.arange(len(mark)), sizes), flat["codes"], flat["counts"] / FULL, len(picked), prior, params)
    return PuModel(picked, weights, bias, prior)


def _picked(sample: DataFrame, n_p: int, n_u: int, params: PuParams) -> DataFrame:
    """The features whose means in the two parts of the sample are furthest apart, in standard errors."""
    cells = sample.select("positive", F.explode(F.arrays_zip("keys", "counts")).alias("x")).groupBy(F.col("x.keys").alias("key"))
    sums = cells.agg(F.sum(F.when(F.col("positive"), F.col("x.counts"))).alias("a"), F.sum(F.when(~F.col("positive"), F.col("x.counts"))).alias("u"))
    a, u = (F.coalesce(c, F.lit(0)) / F.lit(float(FULL)) for c in ("a", "u"))
    share = (a + u + 1) / F.lit(n_p + n_u + 2.0)
    z = F.abs((a / n_p - u / n_u) / F.sqrt(share * (1 - share) * F.lit(1 / n_p + 1 / n_u)))
    return sums.select("key", z.alias("z")).filter(F.col("z") >= params.min_z).orderBy(F.desc("z"), "key").limit(params.n_features)


def train(positive: np.ndarray, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, k: int, prior: float, params: PuParams) -> tuple[np.ndarray, float]:
    """Weights of the k features and the bias that minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) by gradient
    steps; where the second part is below -slack, the step goes against its gradient instead, which keeps the risk of the
    unlabelled part from overfitting. At last the bias is set so that the mean score of the unlabelled texts is the prior,
    which that overshoot would miss in a small sample. rows, cols, values: the cells of the matrix of texts and features."""
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    w, b = np.zeros(k), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, params.steps + 1):
        s = np.bincount(rows, w[cols] * values, minlength=len(positive)) + b
        p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
        loss_minus = np.logaddexp(0, s)  # logistic loss as a negative
        rest = loss_minus[~positive].mean() - prior * loss_minus[positive].mean() if (~positive).any() and positive.any() else 0.0
        g_plus = np.where(positive, prior * (p - 1) / n_p, 0.0)
        g_rest = np.where(positive, -prior * p / n_p, p / n_u)
        g = g_plus + g_rest if rest >= -params.slack else -g_rest
        grad = np.append(np.bincount(cols, g[rows] * values, minlength=k)[:k] + params.l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = params.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    rest = np.bincount(rows, w[cols] * values, minlength=len(positive))[~positive]
    low, high = -40.0, 40.0
    for _ in range(60 if len(rest) else 0):  # the unlabelled texts are toxic at the prior, which settles the bias
        b = (low + high) / 2
        low, high = (b, high) if np.mean(1 / (1 + np.exp(-np.clip(rest + b, -40, 40)))) < prior else (low, b)
    return w, float(b)


def score(docs: DataFrame, model: PuModel, params: PuParams = PuParams(), text_col: str = "text") -> DataFrame:
    """The input with score (probability of being toxic) and predicted."""
    keep = [c for c in docs.columns if c not in ("score", "predicted") or c == text_col]
    docs, where = docs.select(*keep), keep.index(text_col)
    keys, weights = np.append(model.keys, np.uint64(2**64 - 1)), np.append(model.weights, 0.0)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, where):
                owner, found, counts = _features(part.column(where), params)
                place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                value = np.where(keys[place] == found, weights[place] * counts / FULL, 0.0)
                p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, value, minlength=part.num_rows) + model.bias, -40, 40)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= params.threshold).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
