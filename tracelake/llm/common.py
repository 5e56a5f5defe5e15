"""Helpers that the training-data operators share: storage, word arrays, hashes, ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.packaging import ship

#: Bytes of text that one step of a Python task holds as word arrays.
SLICE_BYTES = 1_000_000
#: Rows of an Arrow batch on its way to a Python task, where the session does not say: batches stay small with long texts.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all runs in one local
    process (tests) a new one. Executors of a cluster would not see each other's local folders, so there it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, and gives the
    planner the real size, by which it decides whether a join may broadcast."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return small_batches(ship(spark)).read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> SparkSession:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # as Spark sets it
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def partitions(df: DataFrame) -> int:
    """So many tasks for a shuffle of all rows: as many as the input has, or the session says."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), df.rdd.getNumPartitions())


def null_safe(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]):
    cond = F.lit(True)
    for a, b in keys:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece hold about limit bytes (one text at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    piece = np.cumsum(sizes) // limit
    bounds = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
    for a, b in zip(bounds, bounds[1:]):
        yield batch.slice(a, b - a)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts: a dictionary of distinct words, a code for each word, and the
    first word of each text in starts (one more entry closes the last text)."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "")
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        values = lists.flatten()
        owner = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists), dtype=np.int64))
        real = np.asarray(pc.greater(pc.binary_length(values), 0)).astype(bool)
        if not real.all():
            values, owner = values.filter(pa.array(real)), owner[real]
        coded = values.dictionary_encode()
        self.dictionary: pa.Array = coded.dictionary
        self.codes = np.asarray(coded.indices, dtype=np.int64)
        self.owner = owner
        self.starts = np.searchsorted(owner, np.arange(len(texts) + 1))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def per_text(self, of_word: np.ndarray) -> np.ndarray:
        """Sum of a figure of each distinct word over every text."""
        total = np.concatenate(([0], np.cumsum(of_word[self.codes]))) if len(self.codes) else np.zeros(1, of_word.dtype)
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word, the same in every process."""
        return hash_strings(self.dictionary)


#: Random numbers for each byte at each of 32 places (the same in every process).
BYTES = np.random.default_rng(13).integers(0, 2**64, (32, 256), dtype=np.uint64)


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit tabulation hashes of strings: the sum of the random numbers of their bytes, and of their length."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64) if len(values) else np.zeros(1, np.int64)
    size = np.diff(offsets)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    place = np.arange(len(data), dtype=np.int32) - np.repeat((offsets[:-1] - offsets[0]).astype(np.int32), size)
    numbers = BYTES.ravel()[(place & 31) << 8 | data]
    if len(place) and place.max() > 31:
        numbers *= (2 * (place >> 5) + 1).astype(np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(numbers, dtype=np.uint64)))
    return mix(sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def multipliers(n: int, seed: int = 7) -> np.ndarray:
    """n odd 64-bit numbers for hashes of word windows."""
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (finaliser of a public hash)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(values: np.ndarray, owner: np.ndarray, n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows inside a text, and where they begin."""
    m = len(values) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(m, np.uint64)
    for k, factor in enumerate(multipliers(n, seed)):
        h += values[k : k + m] * factor
    at = np.flatnonzero(owner[:m] == owner[n - 1 :])
    return mix(h[at]), at


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; a shorter text is one shingle of all its words,
    a text without words has none."""
    values = words.hashes()[words.codes] if len(words.codes) else np.empty(0, np.uint64)
    hashed, at = windows(values, words.owner, n)
    first = np.searchsorted(at, words.starts)
    found = []
    for i in range(len(words.starts) - 1):
        a, b = words.starts[i], words.starts[i + 1]
        if b - a >= n:
            found.append(np.unique(hashed[first[i] : first[i + 1]]))
        elif b > a:
            found.append(mix(np.sum(values[a:b] * multipliers(n, 11)[: b - a], keepdims=True) + np.uint64(b - a)))
        else:
            found.append(np.empty(0, np.uint64))
    return found


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat).cast(kind) if flat.dtype != np.uint64 else pa.array(flat.view(np.int64)))


def unit(hashed):
    """A column of uniform numbers in (0, 1) from a hex digest column: its first 13 digits, so that any SQL can repeat it."""
    return (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**13))


def global_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with `rank` from 1 in the given order, stored: a range-partitioned sort, whose partitions are numbered within
    and shifted by the sizes of those before (one number for each partition)."""
    rows = df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order)
    rows = stored(rows.select(F.struct(*df.columns).alias("row"), F.monotonically_increasing_id().alias("at")), name)
    part = F.shiftright("at", 33).alias("part")
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shifts = stored(sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).drop("n"), f"{name}-shifts")
    rows = rows.withColumn("part", part).join(F.broadcast(shifts), "part")  # a row for each partition of the sort
    rank = F.col("at").bitwiseAND(F.lit(2**33 - 1)) + 1 + F.col("before")
    return rows.select(*[F.col("row")[c].alias(c) for c in df.columns if c != "rank"], rank.alias("rank"))
