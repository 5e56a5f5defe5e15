"""Operator 13, periodic run detection: power-of-two naming after Karp, Miller and Rosenberg.

A run is a stretch of consecutive words with smallest period q, at least `least` and `times` periods long, that no neighbouring
word extends keeping that period. The stretches of 1, 2, 4, ... words get names, equal names for equal stretches of one text: a
name is the rank of the pair of names of its two halves. A stretch that occurs once in its text gets none, since nothing
equals it, so from level to level only repeats are named, and naming ends where no repeat is left.

A run of period p holds `times` places of the grid 0, p, 2p, ... of its text. So for each p those grid places are candidates
whose stretch of the greatest named length up to p recurs one and two periods on; the first of a row of them is extended both
ways by the longest common extension with itself one period on: names are compared from the longest down, each at most once.
Names are equal exactly if the words are: no hashes, no suffix order. All this is NumPy over the texts of a slice at once.

Of the stretches found with several periods the least is kept; the others are multiples of it. A text's collapsed form leaves
out each word that some run holds after that run's first period.

Defined results: a null text or one without words has no runs and an empty collapsed form; every row is a text of its own, so
repeated rows and null identifiers are kept. An empty table gives an empty result. Texts are taken whole. Further columns
pass through; those that are named `n_words`, `runs` or `collapsed` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.packaging import ship

from .common import Words, slices

#: Grid places that are looked at in one step.
STEP = 1_000_000
RESULT = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"
KIND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


@dataclass(frozen=True)
class RunParams:
    """least: words of a run; times: periods of a run, three or more. order: gives, for the identifiers of some texts and
    their numbers of words, which word of its text stands at each place (all texts joined); None leaves them as they are."""

    least: int = 6
    times: int = 4
    order: Callable[[list[str | None], np.ndarray], np.ndarray] | None = None


def level_names(codes: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """For each level k the names of the stretches of 2^k words at each place, -1 where it occurs once or leaves its text;
    one more entry, -1, stands for every place beyond."""

    def named(at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        _, rank, count = np.unique(keys, return_inverse=True, return_counts=True)
        names = np.full(len(codes) + 1, -1, np.int32)
        again = count[rank] > 1
        names[at[again]] = rank[again]
        return names

    levels, at = [], np.arange(len(codes))
    names = named(at, owner * (int(codes.max()) + 1) + codes) if len(codes) else np.full(1, -1, np.int32)
    while (at := np.flatnonzero(names >= 0)).size:
        levels.append(names)
        half = 1 << (len(levels) - 1)
        at = at[at + half < len(codes)]
        at = at[(names[at + half] >= 0) & (owner[at + half] == owner[at])]
        names = named(at, names[at].astype(np.int64) * (int(names.max()) + 1) + names[at + half])
    return levels


def extension(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from places a and b on are equal, or how many before them."""
    size = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names, outside = levels[k], len(levels[k]) - 1
        x, y = (a - size - (1 << k), b - size - (1 << k)) if back else (a + size, b + size)
        held = (x >= 0) & (y < outside)
        x = names[np.where(held, x, outside)]
        size += ((x >= 0) & (x == names[np.where(held, y, outside)])).astype(np.int64) << k
    return size


def candidates(names: np.ndarray, k: int, starts: np.ndarray, owner: np.ndarray, times: int):
    """(place, period) of the first grid place of each row of recurring ones, for periods from 2^k to below 2^(k+1)."""
    texts = np.unique(owner[np.flatnonzero(names[:-1] >= 0)])
    size = (starts[1:] - starts[:-1])[texts]
    most = np.minimum(size // times, (2 << k) - 1)
    texts, size, most = texts[most >= 1 << k], size[most >= 1 << k], most[most >= 1 << k]
    n = most - (1 << k) + 1
    text = np.repeat(texts, n)
    period = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + (1 << k)
    places = np.repeat(size, n) // period
    step = np.cumsum(places) // STEP
    for rows in np.split(np.arange(len(text)), np.flatnonzero(np.diff(step)) + 1):
        if not len(rows):
            continue
        pair = np.repeat(rows, places[rows])
        grid = np.arange(len(pair)) - np.repeat(np.cumsum(places[rows]) - places[rows], places[rows])
        at = starts[text[pair]] + grid * period[pair]
        on = names[at]
        same = (on >= 0) & (on == names[np.minimum(at + period[pair], len(names) - 1)])
        for _ in range(times - 3):  # the stretch recurs for times - 2 periods
            same[:-1] &= same[1:] & (pair[:-1] == pair[1:])
            same[-1:] = False
        first = same.copy()
        first[1:] &= ~(same[:-1] & (pair[:-1] == pair[1:]))
        yield at[first], period[pair[first]]


def find(codes: np.ndarray, starts: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of some texts, by start and then by period; codes are equal if the words are."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    levels = level_names(codes, owner)
    found = [np.empty((0, 3), np.int64)]
    for k, names in enumerate(levels):
        for at, period in candidates(names, k, starts, owner, times):
            start = at - extension(levels, at, at + period, back=True)
            end = at + period + extension(levels, at, at + period)
            held = end - start >= np.maximum(least, times * period)
            found.append(np.stack([start, end, period], 1)[held])
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[fresh]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def _slice(ids: pa.Array, texts: pa.Array, params: RunParams) -> pa.Array:
    words = Words(texts)
    codes = words.codes
    if params.order is not None:
        codes = codes[params.order(ids.to_pylist(), words.counts) + np.repeat(words.starts[:-1], words.counts)]
    start, end, period = find(codes, words.starts, params.least, params.times)
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    kept = np.cumsum(change[:-1]) == 0
    offsets = np.concatenate(([0], np.cumsum(kept)))[words.starts]
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.dictionary.take(pa.array(codes[kept])))
    text = words.owner[start] if len(start) else np.empty(0, np.int64)
    runs = pa.StructArray.from_arrays([pa.array(start - words.starts[text]), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32()), runs)
    return pa.StructArray.from_arrays([pa.array(words.counts.astype(np.int64)), runs, pc.binary_join(lists, " ")], fields=list(KIND))


def run_column(ids: Column, text: Column, params: RunParams = RunParams()) -> Column:
    """(n_words, runs, collapsed) for a text column; runs are (start, length, period), by start and then by period."""

    def runs(ids: pa.Array, texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([ids, texts], ["id", "text"])
        parts = [_slice(part.column(0), part.column(1), params) for part in slices(batch)]
        return pa.concat_arrays(parts) if parts else pa.array([], KIND)

    return F.arrow_udf(runs, RESULT)(ids.cast("string"), text)


def find_runs(docs: DataFrame, params: RunParams = RunParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with `n_words`, `runs` and `collapsed` (the words that stay, joined by one space)."""
    if params.times < 3 or params.least < 1:
        raise ValueError("times must be 3 or more, least 1 or more")
    ship(docs.sparkSession)
    new = ["n_words", "runs", "collapsed"]
    rows = docs.select(F.struct(*docs.columns).alias("row"), run_column(F.col(id_col), F.col(text_col), params).alias("found"))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in new], *[F.col("found")[c].alias(c) for c in new])


def longest(runs: Column) -> Column:
    """The run with the greatest length (ties: smallest start, then period), null where there is none."""
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(order)
