"""Operator 3, benchmark decontamination: SimHash of item-sized windows.

Windows with as many words as an item are hashed with SimHash over their shingles. A multi-index of four 16-bit blocks
finds every item fingerprint of that size within the Hamming radius. Each block lists its items by their value; a window
looks at the values that differ from its own in at most the block's tolerance. The tolerances add up to r - 3, so two
fingerprints that were above it in all four blocks would differ in more than r bits. What the blocks find is held against
the radius as whole arrays, and what remains is verified by the weighted Jaccard similarity of the shingles, weighted by
how often they occur. Windows that share no shingle with an item have similarity 0 and are not hashed.

The items are the query set: they are taken in blocks of at most `item_block` items and about `item_chars` code points,
each an index of bounded size that goes to the tasks with the function. After each full block the rows are stored, so the
driver holds one block, and a task one index, however many items there are; every document is scanned against every block.

Words are lower-cased and lose the signs around them; an item of fewer words than a shingle is one shingle. Defined
results: a null or empty text, and one without words, is clean. A document shorter than an item is compared as a whole.
Items without words match nothing; equal items are all reported, items without an identifier as one that is null. Every row is judged for itself; identifiers are not
looked at. An empty benchmark finds nothing, an empty table gives an empty result. Further columns pass through; one that
has the name of an output column is replaced.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, slices, stored, windows

SIGNS = ".,;:!?\"'()[]{}*#%$&|<>-_/\\"
BLOCKS = 4

#: Cells of a table of windows by items, or by shingles, that is held at a time.
CELLS = 4_000_000


@dataclass(frozen=True)
class LeakParams:
    n: int = 5
    similarity: float = 0.8
    radius: int = 18
    item_block: int = 20_000
    item_chars: int = 16_000_000

    def tolerances(self) -> list[int]:
        """Bits in which a block may differ, as even as possible: one more in each block would be one more than the radius."""
        return [(self.radius - BLOCKS + 1 + b) // BLOCKS for b in range(BLOCKS)]


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their owners, and the first word of each text, after dropping what is left empty."""
    words = Words(pc.utf8_lower(pc.fill_null(texts, "")))
    words.dictionary = pc.utf8_trim(words.dictionary, characters=SIGNS)
    real = ~np.asarray(pc.equal(words.dictionary, "")).astype(bool)[words.codes] if len(words.codes) else np.empty(0, bool)
    owner = words.owner[real]
    values = words.hashes()[words.codes[real]] if len(owner) else np.empty(0, np.uint64)
    return values, owner, np.searchsorted(owner, np.arange(len(texts) + 1))


def simhash(grams: np.ndarray) -> np.ndarray:
    """Fingerprints, as eight bytes, of the rows of a matrix of shingle hashes: a bit is set where most shingles have it."""
    out = np.empty((len(grams), 8), np.uint8)
    for a in range(0, len(grams), 2000):
        some = np.ascontiguousarray(grams[a : a + 2000])
        bits = np.unpackbits(some.view(np.uint8).reshape(*some.shape, 8), axis=2)
        out[a : a + 2000] = np.packbits(2 * bits.sum(1, dtype=np.int64) > some.shape[1], axis=1)
    return out


class BlockTables:
    """Fingerprints by the values of their blocks: each block lists its values, and the items of each value."""

    def __init__(self, prints: np.ndarray, params: LeakParams):
        self.whole, self.radius, self.tolerances = prints.view(np.uint64)[:, 0], params.radius, params.tolerances()
        self.blocks = []
        for values in prints.view(np.uint16).T:
            order = np.argsort(values, kind="stable")
            distinct, first = np.unique(values[order], return_index=True)
            self.blocks.append((distinct, np.append(first, len(order)), order))

    def within(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a fingerprint of marks and an item whose fingerprints differ in at most `radius` bits."""
        found = []
        for (distinct, first, order), values, tolerance in zip(self.blocks, marks.view(np.uint16).T, self.tolerances):
            w, v = np.nonzero(np.bitwise_count(values[:, None] ^ distinct) <= tolerance)
            count = first[v + 1] - first[v]
            place = np.repeat(first[v] - np.cumsum(count) + count, count) + np.arange(count.sum())
            w, i = np.repeat(w, count), order[place]
            near = np.bitwise_count(marks.view(np.uint64)[w, 0] ^ self.whole[i]) <= self.radius
            found.append(w[near] * len(self.whole) + i[near])
        return np.divmod(np.unique(np.concatenate(found)), len(self.whole))


class LeakIndex:
    """The items of one block: shingles, and for each size the fingerprints with their block tables."""

    def __init__(self, items: list[tuple[int, str]], params: LeakParams):
        self.params = params
        values, _, starts = plain_words(pa.array([t for _, t in items], pa.string()))
        self.bags, sizes, owners = [], defaultdict(list), defaultdict(set)
        for i, (item_id, _) in enumerate(items):
            words = values[starts[i] : starts[i + 1]]
            if len(words):
                q = min(params.n, len(words))
                grams, _ = windows(words, np.zeros(len(words)), q)
                sizes[len(words)].append((len(self.bags), grams))
                self.bags.append((item_id, Counter(grams.tolist())))
                for g in grams.tolist():
                    owners[q, g].add(len(words))
        self.keys = {q: np.array(sorted(g for p, g in owners if p == q), np.uint64) for q in {q for q, _ in owners}}
        self.sizes_of = {q: [sorted(owners[q, g]) for g in self.keys[q].tolist()] for q in self.keys}
        self.tables = {}
        for size, found in sizes.items():
            self.tables[size] = (np.array([i for i, _ in found]), BlockTables(simhash(np.stack([g for _, g in found])), params))

    def windows_near(self, values: np.ndarray, owner: np.ndarray, starts: np.ndarray) -> dict[int, np.ndarray]:
        """For each item size the first words of the windows that share a shingle with an item of that size."""
        found = defaultdict(list)
        for q, keys in self.keys.items():
            grams, at = windows(values, owner, q)
            place = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == grams)
            pairs = [(n, p) for p, k in zip(at[hit].tolist(), place[hit].tolist()) for n in self.sizes_of[q][k]]
            if not pairs:
                continue
            sizes, points = np.array(pairs, np.int64).T
            for n in np.unique(sizes):
                p = np.unique(points[sizes == n])
                doc = owner[p]
                low = np.maximum(p - (n - q), starts[doc])
                high = np.minimum(p, np.maximum(starts[doc + 1] - n, starts[doc]))
                count = np.maximum(high - low + 1, 0)
                first = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
                found[int(n)].append(np.unique(first))
        return {n: np.unique(np.concatenate(x)) for n, x in found.items()}

    def search(self, texts: pa.Array) -> list[dict[int, tuple[float, int]]]:
        """For each text the items found in it: the best similarity, and the first word of that window."""
        values, owner, starts = plain_words(texts)
        out: list[dict[int, tuple[float, int]]] = [{} for _ in range(len(texts))]
        for n, first in self.windows_near(values, owner, starts).items():
            length = np.minimum(n, starts[owner[first] + 1] - first)
            for m in np.unique(length):
                at, q = first[length == m], min(self.params.n, n, int(m))
                if q < min(self.params.n, n):
                    continue  # too short for a shingle of the item
                grams, where = windows(values, owner, q)
                rows = np.searchsorted(where, at)[:, None] + np.arange(m - q + 1)
                step = max(1, CELLS // (len(self.tables[n][0]) + int(m)))
                for a in range(0, len(rows), step):
                    self._verify(n, grams[rows[a : a + step]], at[a : a + step], owner, starts, out)
        return out

    def _verify(self, n: int, grams: np.ndarray, at: np.ndarray, owner: np.ndarray, starts: np.ndarray, out: list) -> None:
        items, table = self.tables[n]
        for w, i in zip(*table.within(simhash(grams))):
            item_id, bag = self.bags[items[i]]
            own = Counter(grams[w].tolist())
            common = sum(min(c, bag.get(g, 0)) for g, c in own.items())
            similarity = common / (sum(own.values()) + sum(bag.values()) - common)
            best = out[owner[at[w]]]
            if similarity >= self.params.similarity and similarity > best.get(item_id, (0.0, 0))[0]:
                best[item_id] = (similarity, int(at[w] - starts[owner[at[w]]]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams(), text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows with contaminated, item_ids (ascending), similarity (the best, 0 if none) and first_words (of the window
    of each item)."""
    new = ["contaminated", "item_ids", "similarity", "first_words"]
    docs = docs.select(*[c for c in docs.columns if c not in new or c == text_col])
    where = docs.columns.index(text_col)
    found = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("first", T.LongType())]))
    rows = docs.withColumn("__leaks", F.lit(None).cast(found))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first", pa.int64())]))
    items = ((r[0], r[1]) for r in benchmark.select(F.col(item_col).cast("long"), item_text).filter(F.col(item_text).isNotNull()).toLocalIterator())
    block: list[tuple[int, str]] = []

    def scan(rows: DataFrame, index: LeakIndex) -> DataFrame:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, where):
                    more = [[{"item_id": i, "similarity": s, "first": f} for i, (s, f) in sorted(x.items(), key=lambda y: (y[0] is not None, y[0] or 0))] for x in index.search(part.column(where))]
                    old = part.column(part.num_columns - 1).to_pylist()
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([(a or []) + b for a, b in zip(old, more)], kind)], part.schema.names)

        return rows.mapInArrow(add, rows.schema)

    chars = 0
    for item in items:
        block.append(item)
        chars += len(item[1])
        if len(block) == params.item_block or chars >= params.item_chars:
            rows, block, chars = stored(scan(rows, LeakIndex(block, params)), "scanned"), [], 0
    if block:
        rows = scan(rows, LeakIndex(block, params))
    leaks = F.sort_array(F.coalesce("__leaks", F.expr("cast(array() as array<struct<item_id:bigint,similarity:double,first:bigint>>)")))
    rows = rows.withColumn("__leaks", leaks)
    return rows.select(
        *docs.columns, (F.size("__leaks") > 0).alias("contaminated"), F.col("__leaks.item_id").alias("item_ids"),
        F.coalesce(F.array_max("__leaks.similarity"), F.lit(0.0)).alias("similarity"), F.col("__leaks.first").alias("first_words"),
    )
