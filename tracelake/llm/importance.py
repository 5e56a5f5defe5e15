"""Operator 9, quality classifier: importance resampling.

The share of each hashed word and word pair in the target texts and in all texts gives two generative models; a document's
log importance is the sum of the log ratios of its n-grams. The hash has `spare_bits` more bits than the corpus has n-grams,
so the models grow with the input and a few n-grams in a hundred share a bucket at any size. Texts are kept
in chunks (see chunks.py), whose distinct buckets travel packed to ranges of the hash and back: counts are added up before
the shuffle, nothing is broadcast, and no bucket is on more than one entry of a chunk. A Gumbel number hashed from seed and
identifier is added, and the k documents with the largest sums are kept, which samples k documents without replacement in
proportion to their importance. The model of the raw texts counts every document; the target model counts at most
`max_target` labelled documents, those with the least hash of their identifier. Log ratios are kept as whole numbers of the
part 2^-32, so that sums do not depend on their order.

Defined results: a null or empty text has log importance 0. Every row is ranked for itself; equal sums are ordered by
the hash of the identifier and then the identifier, a null one counting as the empty text. Without target labels every
ratio is 0 and the sample is uniform. An empty table gives an empty result. Further columns pass through `resample`; one
that has the name of an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import by_chunk, by_range, chunked, from_bytes, key_bits, pack, pack_ascending, range_bits, single, stored_chunks, to_bytes, unpack, unpack_ascending, with_answers
from .common import Words, global_rank, mix, slices, stored, unit, windows

#: Log ratios are kept as whole numbers of this part.
UNIT = float(2**32)


@dataclass(frozen=True)
class ResampleParams:
    """keep: share of the documents to sample; None takes the share of target rows among the labelled ones. spare_bits: bits
    of the hash beyond those that number the n-grams of the corpus."""

    spare_bits: int = 3
    max_target: int = 20_000
    keep: float | None = None
    seed: str = "resample"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, wanted, text) -> a row for each chunk, with the number of its n-grams."""
    for number, part in chunked(batches, 2):
        n = np.concatenate([Words(piece.column(2)).counts for piece in slices(part, 2)])
        n, wanted = 2 * n - (n > 0), np.asarray(part.column(1)).astype(bool)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (number, int(n.sum()), int(n[wanted].sum()), to_bytes(part))], ["chunk", "raw", "wanted", "rows"])


def _counted(text: pa.Array, wanted: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """The n-grams of some texts: their distinct buckets in ascending order, how often each is there in all texts and in
    target texts; the place of each n-gram's bucket among them and its row."""
    words = Words(text)
    values = words.hashes()[words.codes] if len(words.codes) else np.empty(0, np.uint64)
    pairs, at = windows(values, words.owner, 2, seed=3)
    owner = np.concatenate((words.owner, words.owner[at]))
    keys, place = np.unique(np.concatenate((mix(values), pairs)) >> np.uint64(64 - bits), return_inverse=True)
    counts = [np.bincount(x, minlength=len(keys)) for x in (place, place[wanted[owner]])]
    return keys, *counts, place.astype(np.int32), owner.astype(np.int32)


class _Grams:
    """The n-grams of a chunk: its distinct buckets in ascending order, and how often a bucket is there in all texts and in
    target texts. Texts become words and n-grams by slices; where `places` are asked for, a slice keeps its first row, the
    places of its buckets among those of the chunk, and the place of each n-gram's bucket in the slice and its row."""

    def __init__(self, rows: pa.RecordBatch, bits: int, places: bool = False):
        parts, first, owners = [], 0, []
        for piece in slices(rows, 2):
            keys, raw, wanted, place, owner = _counted(piece.column(2), np.asarray(piece.column(1)).astype(bool), bits)
            parts.append((keys, raw, wanted))
            owners.append((first, place, owner) if places else ())
            first += piece.num_rows
        self.keys = np.concatenate([np.empty(0, np.uint64), *(keys for keys, *_ in parts)])
        self.keys.sort()
        self.keys = self.keys[np.diff(self.keys, prepend=~self.keys[:1]) != 0]
        self.raw, self.wanted = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), np.int64)
        self.slices = []
        for (keys, raw, wanted), of_slice in zip(parts, owners):
            at = np.searchsorted(self.keys, keys)
            self.raw[at] += raw
            self.wanted[at] += wanted
            if places:
                self.slices.append((of_slice[0], at.astype(np.int32), *of_slice[1:]))

    def sums(self, values: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row: the sum of what the buckets of its n-grams have, and its n-grams."""
        total, n = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
        for first, at, place, owner in self.slices:
            np.add.at(total[first:], owner, values[at][place])
            more = np.bincount(owner)
            n[first : first + len(more)] += more
        return total, n


def _cells(batches: Iterator[pa.RecordBatch], bits: int, of_range: int) -> Iterator[pa.RecordBatch]:
    """(range, chunk, keys, raw, wanted): the buckets of a chunk and their counts, by range."""

    def of_chunk(chunk: int, rows: bytes) -> pa.RecordBatch:
        grams = _Grams(from_bytes(rows), bits)
        out = [(k, chunk, pack_ascending(grams.keys[s]), pack(grams.raw[s]), pack(grams.wanted[s])) for k, s in by_range(grams.keys, bits, of_range)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 5, (pa.int64(), pa.int64(), *[pa.binary()] * 3))], ["range", "chunk", "keys", "raw", "wanted"])

    # a chunk at a time: what a function holds is gone before the next one
    return (of_chunk(**r) for r in single(batches))


def _summed(table: pa.Table) -> pa.Table:
    """One range: as an answer to each chunk what its buckets count in the other chunks. The first answer begins with the
    number of buckets in the range, the others with 0."""
    keys = [unpack_ascending(x) for x in table.column("keys").to_pylist()]
    edges = np.cumsum([0] + [len(k) for k in keys])
    found, code = np.unique(np.concatenate(keys), return_inverse=True)
    replies = [(len(found) if i == 0 else 0).to_bytes(8, "little") for i in range(len(keys))]
    for column in ("raw", "wanted"):
        counts = np.concatenate([unpack(x) for x in table.column(column).to_pylist()]).astype(np.int64)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, code, counts)
        blobs = [pack(x) for x in np.split(total[code] - counts, edges[1:-1])]
        replies = [r + len(x).to_bytes(8, "little") + x for r, x in zip(replies, blobs)]
    return pa.table({"chunk": table.column("chunk"), "range": table.column("range"), "reply": pa.array(replies, pa.binary())})


def _units(grams: _Grams, replies: list[bytes]) -> tuple[np.ndarray, int]:
    """The log ratios of the buckets of a chunk, whose answers tell what they count in other chunks; and the buckets of the
    ranges that it is the first of."""
    units, begin, n_keys = np.empty(len(grams.keys), np.int64), 0, 0
    for reply in replies:
        size = 16 + int.from_bytes(reply[8:16], "little")
        raw, wanted = (unpack(x).astype(np.int64) for x in (reply[16:size], reply[size + 8 :]))
        of_range = slice(begin, begin + len(raw))
        if of_range.stop > len(units):
            raise ValueError("the answers do not fit the chunk")
        ratio = np.log(grams.wanted[of_range] + wanted + 1) - np.log(grams.raw[of_range] + raw + 1)
        units[of_range] = np.round(ratio * UNIT).astype(np.int64)
        begin, n_keys = of_range.stop, n_keys + int.from_bytes(reply[:8], "little")
    if begin != len(units):
        raise ValueError("the answers do not fit the chunk")
    return units, n_keys


def scored(docs: DataFrame, target: DataFrame, params: ResampleParams, rest: list[str], id_col: str, text_col: str) -> DataFrame:
    """The columns `rest` with log_ratio and n_grams, stored. target: identifiers of target documents, at most max_target."""
    chosen = target.select(F.col(id_col).alias("__id"), F.lit(True).alias("wanted")).distinct()
    packed = docs.select(F.struct(*rest).alias("row"), F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id", "left")  # max_target identifiers at most
    packed = packed.select("row", F.coalesce("wanted", F.lit(False)).alias("wanted"), "text")
    chunks = stored_chunks(packed.mapInArrow(_packed, "chunk long, raw long, wanted long, rows binary"), "texts")
    raw, wanted = (int(x or 0) for x in chunks.agg(F.sum("raw"), F.sum("wanted")).first())
    bits = key_bits(raw, params.spare_bits)
    of_range = range_bits(raw, bits)
    cells = chunks.select("chunk", "rows").mapInArrow(lambda it: _cells(it, bits, of_range), "range long, chunk long, keys binary, raw binary, wanted binary")
    replies = cells.groupBy("range").applyInArrow(_summed, "chunk long, range long, reply binary")

    def of_chunk(rows: bytes, replies: list[dict] | None) -> pa.RecordBatch:
        part = from_bytes(rows)
        grams = _Grams(part, bits, places=True)
        units, n_keys = _units(grams, [x["reply"] for x in replies or ()])
        sums, n_grams = grams.sums(units if wanted else 0 * units, part.num_rows)
        new = np.zeros(part.num_rows, np.int64)
        new[0] = n_keys
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(sums), pa.array(n_grams), pa.array(new)], ["row", "units", "n_grams", "n_keys"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (of_chunk(r["rows"], r["replies"]) for r in single(batches))

    schema = T.StructType([packed.schema["row"], *(T.StructField(c, T.LongType()) for c in ("units", "n_grams", "n_keys"))])
    out = with_answers(chunks.select("chunk", "rows"), by_chunk(replies, "replies")).mapInArrow(finish, schema)
    out = stored(out, "scored")
    n = int(out.agg(F.sum("n_keys")).first()[0] or 0)
    # the shares' denominators are the same for every n-gram of a text
    each = float(np.log(max(1, raw + n)) - np.log(max(1, wanted + n))) if wanted else 0.0
    return out.select(*[F.col("row")[c].alias(c) for c in rest], (F.col("units") / F.lit(UNIT) + F.col("n_grams") * F.lit(each)).alias("log_ratio"), "n_grams")


def resample(docs: DataFrame, labels: DataFrame, params: ResampleParams = ResampleParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The input without its text: log_ratio, n_grams, gumbel_key, rank and kept."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    hashed = F.xxhash64(F.col(id_col).cast("string"), F.lit(params.seed))
    target = known.filter(F.col(label_col) == 1).select(id_col).distinct().orderBy(hashed, id_col).limit(params.max_target)
    n_known, n_target = known.agg(F.count(F.lit(1)), F.sum(F.when(F.col(label_col) == 1, 1).otherwise(0))).first()
    share = params.keep if params.keep is not None else (n_target or 0) / n_known if n_known else 1.0
    new = ["log_ratio", "n_grams", "gumbel_key", "rank", "kept"]
    rest = [c for c in docs.columns if c not in (*new, text_col) or c == id_col]
    rows = scored(docs, stored(target, "target"), params, rest, id_col, text_col)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    draw = unit(F.md5(F.concat(F.lit(params.seed + "|"), name)))
    rows = rows.withColumn("gumbel_key", F.col("log_ratio") - F.ln(-F.ln(draw)))
    rows = global_rank(rows, [F.desc("gumbel_key"), F.xxhash64(name), F.col(id_col)], "keys")
    k = int(np.floor(share * rows.count() + 0.5))
    return rows.withColumn("kept", F.col("rank") <= k)
