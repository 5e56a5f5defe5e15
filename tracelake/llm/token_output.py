"""Operator 6, token-ID output: sorted-string-table shards.

Texts are encoded, an end id is appended to each, and the ids are written in ascending order of the document identifier.
A shard file holds data blocks, a Bloom filter of its keys, a sparse index and a footer:

    block   for each entry: varint length of the prefix shared with the key before (0 for the first key of a block),
            varint length of the rest of the key, varint length of the value, the rest of the key, the value
    bloom   the bits, little-endian within each byte
    index   for each block: varint key length, first key, u64 offset, u32 length, u32 entries, u64 ids, u32 crc32
    footer  u64 offset and u64 length of the filter, u64 offset and u64 length of the index, u64 entries, u64 ids,
            u8 bytes of an id, u8 hashes of the filter, 6 bytes of zero, 8 bytes MAGIC

A key is 0x01 and the identifier plus 2**63 as eight big-endian bytes, or 0x00 for null, so that bytes sort as
identifiers do. A value is the ids, little-endian, of two bytes where the vocabulary allows it, else four.

Defined results: a null text is an empty text, and an empty text is the end id alone. Rows repeated under one identifier
are entries of their own, ordered by a hash of their text; lookup returns them all. A null identifier sorts first. An
empty table gives no shards and an empty result. Only identifier and text are read of the input; further columns do not
matter.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, new_path, partitions, slices, stored

MAGIC = b"TLSSTAB1"
FOOTER = struct.Struct("<QQQQQQBB6x8s")
ENTRY = struct.Struct("<QIIQI")
#: Words that are encoded as one text.
JOINED = 1000
#: Bytes of text that are encoded in one step: a larger step looks up fewer words.
STEP_BYTES = 4_000_000


@dataclass(frozen=True)
class TokenParams:
    """tokenizer: path of a tokenizers file. block_bytes: size from which a block is closed. cache: distinct words whose
    ids a worker keeps at most."""

    tokenizer: str
    end_id: int = 1
    block_bytes: int = 65536
    bits_per_key: int = 10
    hashes: int = 7
    cache: int = 500_000


class Encoder:
    """Encodes texts word by word. The pre-tokenizer never joins what white space separates, so the ids of a text are
    those of its words; each distinct word of a step is looked up once, and what was encoded before is kept. Where the
    tokenizer lower-cases, so does the lookup (A-Z)."""

    held: dict[str, Encoder] = {}

    def __init__(self, path: str, cache: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        self.lower = '"Lowercase"' in str(self.tokenizer.normalizer.__getstate__()) if self.tokenizer.normalizer else False
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else 4
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.first, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    @classmethod
    def get(cls, path: str, cache: int) -> Encoder:
        if path not in cls.held:
            cls.held[path] = cls(path, cache)
        return cls.held[path]

    def places(self, distinct: list[str]) -> np.ndarray:
        """Where first and size describe each of the distinct words."""
        if len(self.slots) + len(distinct) > self.cache:
            self._forget()
        found = np.fromiter(map(self.slots.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = [distinct[i] for i in np.flatnonzero(found < 0).tolist()]
        if new:
            new.sort(key=str.isalpha)
            letters = bisect_left(new, True, key=str.isalpha)
            parts = [self._one_by_one(new[:letters])]
            parts += [self._joined(new[i : i + JOINED]) for i in range(letters, len(new), JOINED)]
            ids, sizes = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            self.slots.update(zip(new, range(len(self.size), len(self.size) + len(new))))
            self.first = np.append(self.first, len(self.ids) + np.cumsum(sizes) - sizes)
            self.size, self.ids = np.append(self.size, sizes), np.append(self.ids, ids)
            found = np.fromiter(map(self.slots.get, distinct), np.int64, len(distinct))
        return found

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters only, as one text: each ends with the first token that closes a word. Where a tokenizer has no
        such tokens the numbers differ, and the words are taken one by one."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closing[ids])
        if len(ends) != len(words) or ends[-1] != len(ids) - 1:
            return self._one_by_one(words)
        return ids, np.diff(ends, prepend=-1)

    def texts(self, texts: pa.Array, end_id: int) -> list[np.ndarray]:
        lower = self.lower and not any(pc.any(pc.match_substring(texts, t, ignore_case=True)).as_py() for t in self.added)
        words = Words(texts, lower)
        place = self.places(words.dictionary.to_pylist())
        at = place[words.codes] if len(words.codes) else np.empty(0, np.int64)
        lengths = self.size[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.first[at] - ends + lengths, lengths) + np.arange(total)] if total else np.empty(0, np.uint32)
        bounds = np.concatenate(([0], ends))[words.starts]
        return [np.append(ids[a:b], np.uint32(end_id)) for a, b in zip(bounds, bounds[1:])]


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + (doc_id + 2**63).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else int.from_bytes(key[1:], "big") - 2**63


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n, at, shift = n | (b & 127) << shift, at + 1, shift + 7
        if b < 128:
            return n, at


def _bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_64_intdigest(key)
    step = xxhash.xxh3_64_intdigest(key, 1) | 1
    return [(h + j * step) % 2**64 % bits for j in range(hashes)]


class ShardWriter:
    """Writes entries, which must come in ascending order of their keys, to one file."""

    def __init__(self, out, params: TokenParams, width: int):
        self.out, self.params, self.width = out, params, width
        self.block, self.last, self.head, self.entries, self.ids = bytearray(), b"", b"", 0, 0
        self.at, self.index, self.keys, self.total, self.n = 0, bytearray(), [], 0, 0
        self.first_key = self.last_key = b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        shared = 0
        if self.block:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.head = key
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        if not self.n or key != self.last_key:
            self.keys.append(xxhash.xxh3_64_intdigest(key)), self.keys.append(xxhash.xxh3_64_intdigest(key, 1) | 1)
        self.first_key = self.first_key if self.n else key
        self.last = self.last_key = key
        self.entries, self.ids, self.n, self.total = self.entries + 1, self.ids + len(ids), self.n + 1, self.total + len(ids)
        if len(self.block) >= self.params.block_bytes:
            self.flush()

    def flush(self) -> None:
        if self.block:
            self.index += varint(len(self.head)) + self.head + ENTRY.pack(self.at, len(self.block), self.entries, self.ids, zlib.crc32(self.block))
            self.out.write(bytes(self.block))
            self.at += len(self.block)
            self.block, self.entries, self.ids = bytearray(), 0, 0

    def close(self) -> int:
        self.flush()
        pairs = np.array(self.keys, np.uint64).reshape(-1, 2)
        bits = max(64, len(pairs) * self.params.bits_per_key)
        marks = np.zeros(bits, np.uint8)
        for j in range(self.params.hashes):
            marks[(pairs[:, 0] + np.uint64(j) * pairs[:, 1]) % np.uint64(bits)] = 1
        bloom = struct.pack("<Q", bits) + np.packbits(marks, bitorder="little").tobytes()
        footer = FOOTER.pack(self.at, len(bloom), self.at + len(bloom), len(self.index), self.n, self.total, self.width, self.params.hashes, MAGIC)
        self.out.write(bloom + bytes(self.index) + footer)
        return self.at + len(bloom) + len(self.index) + len(footer)


class ShardReader:
    """Reads a shard: all entries in order, or those of one key."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        bloom_at, bloom_len, index_at, index_len, self.n, self.total, self.width, self.hashes, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a shard: {uri}")
        self.bloom_at, self.bloom_len = bloom_at, bloom_len
        data, at, self.blocks = memoryview(self.file.read_at(index_len, index_at)), 0, []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.blocks.append((bytes(data[at : at + n]), *ENTRY.unpack(data[at + n : at + n + ENTRY.size])))
            at += n + ENTRY.size

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, length, entries, _, crc = self.blocks[i]
        data = memoryview(self.file.read_at(length, offset))
        if zlib.crc32(data) != crc:
            raise ValueError("a block does not fit its checksum")
        at, key, kind = 0, b"", "<u2" if self.width == 2 else "<u4"
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + bytes(data[at : at + rest])
            at += rest
            yield key, np.frombuffer(data[at : at + size], kind)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        data = self.file.read_at(self.bloom_len, self.bloom_at)
        (bits,) = struct.unpack_from("<Q", data)
        return all(data[8 + (p >> 3)] >> (p & 7) & 1 for p in _bloom_places(key, bits, self.hashes))

    def lookup(self, key: bytes) -> list[np.ndarray]:
        """The values of a key: filter first, then a binary search of the sparse index, then the blocks that can hold it."""
        if not self.blocks or not self.may_hold(key):
            return []
        heads = [b[0] for b in self.blocks]
        span = range(max(0, bisect_left(heads, key) - 1), bisect_right(heads, key))
        return [v.astype(np.uint32) for i in span for k, v in self.block(i) if k == key]


def _write(batches: Iterator[pa.RecordBatch], folder: str, params: TokenParams) -> Iterator[pa.RecordBatch]:
    """One file for a partition. Each attempt has a file name of its own, and only the row of an attempt that succeeded
    names its file, so a lost executor leaves at worst a file that nothing reads."""
    encoder, writer = Encoder.get(params.tokenizer, params.cache), None
    fs, path = pafs.FileSystem.from_uri(folder)
    part = TaskContext.get().partitionId()
    name = f"shard-{part:06d}-{uuid.uuid4().hex}.sst"
    for batch in batches:
        for piece in slices(batch, limit=STEP_BYTES):
            if not piece.num_rows:
                continue
            if writer is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}")
                writer = ShardWriter(out, params, encoder.width)
            for doc_id, ids in zip(piece.column(0).to_pylist(), encoder.texts(piece.column(1), params.end_id)):
                writer.add(key_of(doc_id), ids)
    if writer is not None:
        size = writer.close()
        out.close()
        yield pa.RecordBatch.from_pydict({"shard": [part], "file": [f"{folder}/{name}"], "first_key": [writer.first_key], "last_key": [writer.last_key], "n_docs": [writer.n], "n_tokens": [writer.total], "n_bytes": [size]}, pa.schema([("shard", pa.int32()), ("file", pa.string()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))


def write_shards(docs: DataFrame, params: TokenParams, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards and return their list, stored: shard, file, first_key, last_key, n_docs, n_tokens, n_bytes and
    start, the number of ids in all shards before. The identifier must be of an integer type."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "shards")
    order = ["id", F.xxhash64("text")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    schema = "shard int, file string, first_key binary, last_key binary, n_docs long, n_tokens long, n_bytes long"
    shards = stored(rows.mapInArrow(lambda it: _write(it, folder, params), schema), "shard-list")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row for each file
    return stored(shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))), "shard-starts")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            reader, rows = ShardReader(file), []
            for key, ids in reader:
                rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
                if len(rows) == 5000:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(shards: DataFrame) -> DataFrame:
    """A row for each document from the files: doc_id, start, n_tokens and ids_crc32 (of the ids as u32)."""
    rows = shards.select("file", "start").repartition(max(1, shards.count()))
    return rows.mapInArrow(_digests, T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]))


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id and ids of every document in the files."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                for key, ids in ShardReader(file):
                    yield pa.RecordBatch.from_arrays([pa.array([id_of(key)], pa.int64()), pa.array([ids.astype(np.int32).tolist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return shards.select("file").repartition(max(1, shards.count())).mapInArrow(load, "doc_id long, ids array<int>")
