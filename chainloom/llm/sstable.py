"""Sorted-string-table shards of token ids.

A shard holds documents in ascending order of their keys. Layout::

    data block*      zstd-compressed entries, each
                       varint shared   bytes of the key that equal the key before it
                       varint rest     further bytes of the key
                       varint count    ids, shifted left once; the low bit is set for 32-bit ids
                       key rest, ids   16- or 32-bit little-endian unsigned
    bloom filter     bits, BLOOM_BITS a key, BLOOM_HASHES places each
    sparse index     for each block: varint key length, last key, varint offset, size, crc32
    footer           fixed size: offsets and sizes of both, key and id counts, magic

Keys are the identifier as eight big-endian bytes with the sign bit flipped, so that byte
order is number order; a null identifier has the empty key, which comes first. A lookup asks
the filter, finds the block by binary search in the index and reads that block alone.

Null and empty texts are documents with the end id only. Rows with one identifier, or with
none, follow each other in the order of a hash of their texts; repeated rows are documents
each. Very long texts are encoded whole. Columns other than identifier and text aren't read.
Empty input gives no shards. A task that runs again writes a file of another name, and only
those in the manifest count, so a lost executor leaves no half shard behind.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import modest_batches, partitions, scratch, whole
from .exchange import trim
from .pieces import Codes, compose, split

#: Letters below U+0250, with a space before them or not.
LETTERS = "^ ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+$"
MAGIC = b"CLSSTAB1"
FOOTER = struct.Struct("<QQQQQQ8s")
BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = 1 << 18, 10, 7
#: Bytes of text that a task encodes at once.
GATHER = 12_000_000


def varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def key_of(identifier: int | None) -> bytes:
    return b"" if identifier is None else (identifier + (1 << 63)).to_bytes(8, "big")


def identifier_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Appends documents in ascending key order to a binary stream."""

    def __init__(self, out):
        self.out, self.at, self.block, self.size, self.last = out, 0, [], 0, b""
        self.index, self.keys, self.n_ids = [], [], 0
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
        body = ids.astype("<u4" if wide else "<u2").tobytes()
        entry = varint(shared) + varint(len(key) - shared) + varint(len(ids) << 1 | wide) + key[shared:]
        self.block += [entry, body]
        self.size += len(entry) + len(body)
        self.last, self.n_ids = key, self.n_ids + len(ids)
        self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.zip.compress(b"".join(self.block))
            self.index.append((self.last, self.at, len(data), zlib.crc32(data)))
            self._write(data)
            self.block, self.size = [], 0

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.flush()
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(varint(len(k)) + k + varint(at) + varint(n) + varint(crc) for k, at, n, crc in self.index)
        bloom_at = self.at
        self._write(bytes(bloom))
        index_at = self.at
        self._write(index)
        self._write(FOOTER.pack(bloom_at, bits, index_at, len(index), len(self.keys), self.n_ids, MAGIC))


class Reader:
    """Reads a shard from a seekable file; only the index and the filter stay in memory."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        end = file.tell() - FOOTER.size
        self.bloom_at, self.bits, at, size, self.n_keys, self.n_ids, magic = FOOTER.unpack(self._read(end, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.bloom = self._read(self.bloom_at, (self.bits + 7) // 8)
        raw, i = self._read(at, size), 0
        self.last, self.blocks = [], []
        while i < len(raw):
            n, i = read_varint(raw, i)
            self.last.append(raw[i : i + n])
            i += n
            start, i = read_varint(raw, i)
            n, i = read_varint(raw, i)
            crc, i = read_varint(raw, i)
            self.blocks.append((start, n, crc))
        self.unzip = zstandard.ZstdDecompressor()

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return bytes(self.file.read(size))

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, size, crc = self.blocks[block]
        packed = self._read(at, size)
        if zlib.crc32(packed) != crc:
            raise ValueError("a block is damaged")
        data, i, key = self.unzip.decompress(packed), 0, b""
        while i < len(data):
            shared, i = read_varint(data, i)
            rest, i = read_varint(data, i)
            n, i = read_varint(data, i)
            key, i = key[:shared] + data[i : i + rest], i + rest
            kind, n = ("<u4" if n & 1 else "<u2"), n >> 1
            width = int(kind[-1])
            yield key, np.frombuffer(data, kind, n, i)
            i += n * width

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in range(len(self.blocks)):
            yield from self._entries(block)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every document with this key."""
        if not all(self.bloom[p >> 3] & 1 << (p & 7) for p in _places(key, self.bits)):
            return []
        out = []
        for block in range(bisect_left(self.last, key), len(self.blocks)):
            out += [ids for k, ids in self._entries(block) if k == key]
            if self.last[block] != key:
                break
        return out


class Encoder:
    """The tokenizers library over whole texts, by way of their distinct pieces.

    Pieces of characters below U+0250 are split alike by both pattern engines. A chunk with
    other characters, or with the string of a special token, is one piece here and goes to
    the library as it is, which then treats it as it would within the text.
    """

    JOINED = 100

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        find = regex.compile(pattern).findall
        special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        own = lambda s: any(x in s for x in special) or not (s.isascii() or max(s) < "ɐ")
        self.cut = lambda s: [s] if s and own(s) else find(s)
        self.newline = self.library.encode("\n", add_special_tokens=False).ids
        self.codes = Codes(self._encode)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of Latin letters are encoded many at a time, with line feeds between them, the rest one by one."""
        strings = pa.array(words, pa.string())
        many = pc.match_substring_regex(strings, LETTERS)
        joined = strings.filter(many).to_pylist()
        lines = ["\n".join(joined[i : i + self.JOINED]) + "\n" for i in range(0, len(joined), self.JOINED)]
        found = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
        end = ids == self.newline[0]
        single = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(strings.filter(pc.invert(many)).to_pylist(), add_special_tokens=False)]
        own = np.concatenate([np.diff(np.flatnonzero(end), prepend=-1) - 1, np.fromiter(map(len, single), np.int64, len(single))])
        many = many.to_numpy(zero_copy_only=False)
        place = np.concatenate([np.flatnonzero(many), np.flatnonzero(~many)])
        starts, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        starts[place], sizes[place] = np.cumsum(own) - own, own
        return starts, sizes, np.concatenate([ids[~end], *single])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = split(texts, self.cut)
        return compose(found, *self.codes(found.words.to_pylist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _gathered(batches: Iterator[pa.RecordBatch], most: int = GATHER) -> Iterator[pa.Table]:
    """Batches joined to tables of about ``most`` bytes; a text is never cut."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def write_shards(docs: DataFrame, at: str, tokenizer: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Writes shards below ``at`` in key order and returns their manifest, already stored:
    shard, path, n_docs, n_ids. ``shards`` is the number of key ranges.

    Rows of one identifier, or without any, are spread over ranges by their text, so a
    frequent identifier may go on in the next shard. Each attempt of a task writes a file of
    its own name; the manifest lists those of the attempts that Spark committed.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    n = shards or partitions(spark)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).withColumn("print", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("print").asc()]
    ranged = given.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").drop("print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode, writer = encoder(tokenizer, pattern), None
        end = np.array([end_id], np.uint32)
        for rows in _gathered(batches):
            if not rows.num_rows:
                continue
            if writer is None:
                store, root = fs.FileSystem.from_uri(at)
                store.create_dir(root)
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}.sst"
                out = store.open_output_stream(f"{root}/{name}")
                writer = Writer(out)
            ids, offsets = encode(rows.column(1).combine_chunks())
            for k, i in enumerate(rows.column(0).to_pylist()):
                writer.add(key_of(i), np.concatenate([ids[offsets[k] : offsets[k + 1]], end]))
            del rows, ids, offsets
        trim()
        if writer:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([f"{at}/{name}"]), pa.array([len(writer.keys)], pa.int64()), pa.array([writer.n_ids], pa.int64())], ["shard", "path", "n_docs", "n_ids"])

    manifest = ranged.mapInArrow(run, "shard long, path string, n_docs long, n_ids long")
    manifest.write.parquet(f"{at}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{at}/manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    begun = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as file:
                    rows = []
                    for key, ids in Reader(file):
                        rows.append((identifier_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 10_000], strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = begun.repartitionByRange(partitions(manifest.sparkSession), "shard")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shard_round_trip(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 2) -> DataFrame:
    return read_shards(write_shards(docs, scratch(docs.sparkSession, "sstable"), tokenizer, pattern, end_id))
