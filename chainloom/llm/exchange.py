"""Asking all shards of a corpus about what a chunk of rows holds, and filing the answers.

A scan task cuts its rows into chunks of a bounded size and sends one part of each chunk to
every shard. A shard writes its answers to one file in the shared folder; their places are
sent back, one small file for each chunk. A second scan forms the same chunks and reads
their ranges of the shards' files. The driver sees none of it.

Both scans must see the same rows in the same order, as scans of files do. ``rescannable``
writes any other input to the shared folder first. A chunk's name holds the scan task, its
place there and a digest of all its rows, so an input that changes in between is an error
and never a wrong answer; and equal rows of several tasks have chunks of their own.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import partitions, stored


def rescannable(df: DataFrame, from_files: bool) -> DataFrame:
    """``df`` itself if it only selects columns and rows of files, else a copy in the shared folder."""
    return df if from_files else stored(df, "rows")


def mapped(at: str) -> pa.Buffer:
    """A file's bytes, memory-mapped where it is local."""
    store, path = fs.FileSystem.from_uri(at)
    if isinstance(store, fs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with store.open_input_file(path) as file:
        return file.read_buffer()


def _range(at: str, start: int, size: int) -> memoryview:
    store, path = fs.FileSystem.from_uri(at)
    if isinstance(store, fs.LocalFileSystem):
        return memoryview(pa.memory_map(path).read_buffer())[start : start + size]
    with store.open_input_file(path) as file:
        return memoryview(file.read_at(size, start))


def put(at: str, data: Iterable[bytes]) -> None:
    """Writes a file whose bytes follow from its name: a later attempt finds an earlier one's file and leaves it."""
    store, path = fs.FileSystem.from_uri(at)
    there = lambda: store.get_file_info(path).type == fs.FileType.File
    if there():
        for _ in data:
            pass
        return
    store.create_dir(path.rpartition("/")[0])
    draft = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for part in data:
            out.write(part)
    try:
        store.move(draft, path)
    except OSError:
        if not there():
            raise
        store.delete_file(draft)


def trim() -> None:
    """Gives memory that is free but held back to the system, between pieces of work in a worker that lives on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        return


def string_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of strings without nulls."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at.astype(np.int64) - at[0]


def hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string, given as bytes and offsets."""
    sizes, out = np.diff(offsets), np.zeros(len(offsets) - 1, np.uint64)
    full = np.flatnonzero(sizes)
    with np.errstate(over="ignore"):
        if len(full):
            power = np.multiply.accumulate(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
            step = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
            out[full] = np.add.reduceat((data + np.uint64(1)) * power[step], offsets[:-1][full])
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def by_shard(words: pa.StringArray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of words by shard, and where in it each shard's begin."""
    return in_order(shard_of(hashes(*string_bytes(words)), shards), shards)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def in_order(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers, as planes of their bytes, compressed."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << 8 * w)
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    data = zstandard.compress(planes, 3)
    return bytes([width]) + len(values).to_bytes(8, "little") + len(data).to_bytes(8, "little") + data


def unpack(data: bytes | memoryview, at: int = 0) -> tuple[np.ndarray, int]:
    """The numbers, and where in the data they end."""
    width, n, size = data[at], int.from_bytes(data[at + 1 : at + 9], "little"), int.from_bytes(data[at + 9 : at + 17], "little")
    planes = np.frombuffer(zstandard.decompress(data[at + 17 : at + 17 + size], max(1, n * width)), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(f"<u{width}").ravel(), at + 17 + size


def skip(data: bytes | memoryview, at: int) -> int:
    """Where the numbers that begin at ``at`` end."""
    return at + 17 + int.from_bytes(data[at + 9 : at + 17], "little")


def pack_codes(codes: np.ndarray) -> bytes:
    """16-bit codes of which few are frequent: their list by falling frequency, and the place of each in it."""
    often = np.bincount(codes, minlength=1 << 16)
    listed = np.argsort(-often, kind="stable")[: int((often > 0).sum())]
    place = np.empty(1 << 16, np.uint16)
    place[listed] = np.arange(len(listed))
    return pack(listed.astype(np.uint16)) + pack(place[codes])


def unpack_codes(data: bytes | memoryview, at: int = 0) -> tuple[np.ndarray, int]:
    listed, at = unpack(data, at)
    place, at = unpack(data, at)
    return listed.astype(np.uint16)[place], at


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, pa.Table]]:
    """Runs of rows of about ``most`` bytes, with their names; the last column is the text, without nulls."""
    task = TaskContext.get()
    held, size, k = [], 0, 0

    def made() -> tuple[str, pa.Table]:
        rows = pa.Table.from_batches(held).combine_chunks()
        data, offsets = string_bytes(rows.columns[-1].chunk(0))
        name = xxhash.xxh3_128(data)
        name.update(offsets)
        name.update(repr([c.to_pylist() for c in rows.columns[:-1]]).encode("utf-8", "surrogatepass"))
        return f"{task.partitionId() if task else 0}-{k}-{name.hexdigest()}", rows

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.columns[-1].nbytes
            if size >= most:
                yield made()
                held, size, k = [], 0, k + 1
    if held:
        yield made()


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple]]:
    """Lists of the rows that have one key, from batches sorted by it."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def ask(rows: DataFrame, parts: Callable[[str, pa.Table, int], Iterator[tuple[int, bytes]]], answer: Callable[[int, list[bytes]], Iterator[tuple[bytes, int, int]]], at: str, most: int) -> DataFrame:
    """Answers all chunks of ``rows`` below ``at``, and returns one row for each: chunk, a, b.

    ``parts`` gives what each shard gets of a chunk. ``answer`` has for a shard and the parts
    of all chunks one answer each, in their order, and two numbers, which are summed. As many
    shards as shuffle partitions; a shard that a chunk has nothing for still gets a part.
    """
    spark = rows.sparkSession
    shards = partitions(spark)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in chunks(batches, most):
            found = parts(chunk, table, shards)
            del table
            for shard, part in found:
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([shard], pa.int64()), pa.array([part], pa.binary())], ["chunk", "shard", "part"])
            trim()

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 1):
            shard, found, end = group[0][1], [], 0

            def given(group=group, found=found) -> Iterator[bytes]:
                for (chunk, shard, _), (got, a, b) in zip(group, answer(group[0][1], [part for _, _, part in group]), strict=True):
                    found.append((chunk, shard, a, b, len(got)))
                    yield got

            put(f"{at}/shards/{shard:06d}", given())
            group.clear()
            trim()
            for i in range(0, len(found), 10_000):
                own = found[i : i + 10_000]
                sizes = [x[4] for x in own]
                starts = (end + np.cumsum([0, *sizes[:-1]])).tolist()
                end += sum(sizes)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own]), *(pa.array([x[k] for x in own], pa.int64()) for k in (1, 2, 3)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], ["chunk", "shard", "a", "b", "start", "size"])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 0):
            put(f"{at}/chunks/{group[0][0]}", [np.array([g[4:6] for g in group], "<u8").tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array([group[0][0]]), pa.array([sum(g[2] for g in group)], pa.int64()), pa.array([sum(g[3] for g in group)], pa.int64())], ["chunk", "a", "b"])

    sent = rows.mapInArrow(send, "chunk string, shard long, part binary").repartition(shards, "shard").sortWithinPartitions("shard", "chunk")
    replies = sent.mapInArrow(reply, "chunk string, shard long, a long, b long, start long, size long").repartition(shards, "chunk").sortWithinPartitions("chunk", "shard")
    filed = replies.mapInArrow(file, "chunk string, a long, b long")
    filed.write.parquet(f"{at}/filed")
    return spark.read.schema(filed.schema).parquet(f"{at}/filed")


def answers(at: str, chunk: str) -> list[memoryview]:
    """The answers to a chunk, in the order of shards."""
    places = np.frombuffer(mapped(f"{at}/chunks/{chunk}"), "<u8").reshape(-1, 2).tolist()
    return [_range(f"{at}/shards/{shard:06d}", start, size) for shard, (start, size) in enumerate(places)]
