"""Chunks: steps of rows that one task holds at a time, whose hashed keys are compared with those of all other chunks.

A chunk keeps its data in a table bucketed by chunk. Its distinct keys travel to ranges of the key space, packed, a row for
each range; a range answers each chunk, and the answers come back to the data, which is not shuffled again. So a key costs
a byte or a few, a chunk says it once however often its rows do, and a hot key is one entry of each chunk at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, partitions, slices

#: Bytes of text in a chunk (a longer text is a chunk of its own), and keys in a range, at most on average.
CHUNK_BYTES = 16_000_000
RANGE_KEYS = 1_000_000


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, by byte planes and compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def pack_ascending(values: np.ndarray) -> bytes:
    return pack(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def unpack_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def chunked(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a task in chunks, each with a number of its own."""
    held: list[pa.RecordBatch] = []
    size, number = 0, TaskContext.get().partitionId() << 33

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        for part in slices(batch, column):
            more = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + more > CHUNK_BYTES:
                yield number, joined()
                held, size, number = [], 0, number + 1
            held.append(part)
            size += more
    if held:
        yield number, joined()


def single(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as Python values, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def stored_chunks(df: DataFrame, name: str) -> DataFrame:
    """Chunk rows as a table bucketed by `chunk`, in the shared folder."""
    path = new_path(df.sparkSession, name)
    buckets = partitions(df)
    rows = df.write.format("parquet").option("path", path).option("compression", "uncompressed").bucketBy(buckets, "chunk")
    for limit in ("block", "page"):  # rows are large
        rows = rows.option(f"parquet.{limit}.size.row.check.min", "1")
    table = "tracelake_" + path.rpartition("/")[2].replace("-", "_")
    rows.saveAsTable(table)
    return df.sparkSession.table(table)


def key_bits(n_keys: int, spare: int) -> int:
    """Bits that keys are cut to: so many more than their number has, so that two share one by chance with 2^-spare."""
    return min(64, max(1, n_keys).bit_length() + spare)


def range_bits(n_keys: int, bits: int) -> int:
    return min(bits, max(0, (n_keys // RANGE_KEYS).bit_length()))


def by_range(keys: np.ndarray, bits: int, of_range: int) -> Iterator[tuple[int, slice]]:
    """The ranges that hold some of the ascending keys, and where."""
    place = (keys >> np.uint64(bits - of_range)).astype(np.int64) if of_range else np.zeros(len(keys), np.int64)
    edges = np.flatnonzero(np.diff(place, prepend=-1, append=-1 - len(keys))) if len(keys) else np.empty(0, np.int64)
    for a, b in zip(edges, edges[1:]):
        yield int(place[a]), slice(a, b)


def by_chunk(replies: DataFrame, column: str) -> DataFrame:
    """Answers (chunk, range, reply) as (chunk, column), an array by range."""
    return replies.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("range", "reply"))).alias(column))  # as many as a chunk has keys at most


def with_answers(chunks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Chunks with what belongs to them; only the answers are shuffled."""
    for more in answers:
        chunks = chunks.join(more.hint("shuffle_merge"), "chunk", "left")
    return chunks
