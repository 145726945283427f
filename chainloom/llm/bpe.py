"""Byte-level BPE by replaying all merges over the corpus' distinct words.

Scan tasks send each shard the distinct matches of the pattern that fall to it by hash, so
every word of the corpus is in one shard, once. A shard lays its words out in one doubly
linked list of bytes; an inverted index goes from a token pair, by the rank of its merge, to
the places where it stands. Ranks are taken in ascending order: all places of a rank are
merged at once, from left to right where they overlap, and only the two pairs that touch
each new token are looked up and filed. A word's pairs are thus merged in the order in which
encoding it alone would merge them. The ids go back to the chunks that asked.

Null and empty texts have no ids. Repeated rows are encoded each, with null ids too; equal
pairs within a word merge from left to right, so ties can't arise. Very long words and texts
are encoded whole and take memory in proportion to their bytes. Only the id column and the
text are read, whatever else there is. Empty input gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, scratch, whole
from .exchange import answers, ask, by_shard, chunks, rescannable, string_bytes, trim
from .pieces import Pieces, compose, ranges, split

#: Bytes of text in a chunk, and of words in one list.
CHUNK, LIST = 8_000_000, 2_000_000


class Merges:
    """The ranks of a tiktoken file: token bytes, and for each pair of tokens the token they merge to."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.lengths = np.array([len(t) for t in self.token], np.int64)
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        # Any two tokens whose joint bytes are a token can merge.
        pair: dict[int, int] = {}
        n = len(self.token)
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    pair[a * n + b] = rank
        self.pairs = np.array(sorted(pair), np.int64)
        self.merged = np.array([pair[k] for k in self.pairs.tolist()], np.int32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair merges to, or -1; negative tokens merge with nothing."""
        key = a.astype(np.int64) * len(self.token) + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.merged[at], -1)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        ids, counts = self.replay_bytes(np.frombuffer(b"".join(words), np.uint8), sizes)
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if words else []

    def replay_bytes(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, their numbers), for words of ``sizes`` bytes."""
        n = len(data) + len(sizes) + 1
        tok = np.full(n, -1, np.int32)  # -1: a wall, before the first word and after each one
        begin = 1 + np.cumsum(sizes + 1) - (sizes + 1)
        tok[ranges(begin, sizes)] = self.byte[data]
        before, after = np.arange(-1, n - 1, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(rank: np.ndarray, place: np.ndarray) -> None:
            hit = np.flatnonzero(rank >= 0)
            if not len(hit):
                return
            rank, place = rank[hit], place[hit]
            order = np.argsort(rank, kind="stable")
            rank, place = rank[order], place[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, p in zip(rank[np.append(0, cuts)].tolist(), np.split(place, cuts) if len(cuts) else [place], strict=True):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heappush(heap, r)

        file(self.ranks(tok[:-1], tok[1:]), np.arange(n - 1, dtype=np.int32))
        heapify(heap)
        while heap:
            rank = heappop(heap)
            held = index.pop(rank)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            right = after[at]
            fits = self.ranks(tok[at], tok[np.minimum(right, n - 1)]) == rank
            at, right = at[fits], right[fits]
            if len(at) > 1:
                linked = right[:-1] == at[1:]
                if linked.any():  # every other place of a run of overlapping ones
                    first = np.append(True, ~linked)
                    run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                    even = (np.arange(len(at)) - run) % 2 == 0
                    at, right = at[even], right[even]
            if not len(at):
                continue
            tok[at], tok[right] = rank, -2  # no longer a place
            beyond = after[right]
            after[at] = beyond
            before[beyond] = at
            left = before[at]
            same = np.full(len(at), rank, np.int32)
            file(np.concatenate([self.ranks(tok[left], same), self.ranks(same, tok[beyond])]), np.concatenate([left, at]))
        kept = tok >= 0
        owner = np.repeat(np.arange(len(sizes)), sizes)[kept[ranges(begin, sizes)]]
        return tok[kept].astype(np.uint32), np.bincount(owner, minlength=len(sizes))

    def decode(self, ids: np.ndarray) -> bytes:
        return self.flat[ranges(self.starts[ids], self.lengths[ids])].tobytes()


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def _pieces(rows: pa.Table, pattern: str) -> Pieces:
    return split(rows.columns[-1].chunk(0), regex.compile(pattern).findall)


def _parts(pattern: str):
    """For each shard: the number of words, their sizes and their bytes."""

    def parts(_: str, rows: pa.Table, shards: int) -> Iterator[tuple[int, bytes]]:
        words = _pieces(rows, pattern).words
        order, cuts = by_shard(words, shards)
        data, offsets = string_bytes(words.take(pa.array(order)))
        sizes = np.diff(offsets).astype("<u4")
        for k in range(shards):
            a, b = cuts[k], cuts[k + 1]
            yield k, int(b - a).to_bytes(8, "little") + sizes[a:b].tobytes() + data[offsets[a] : offsets[b]].tobytes()

    return parts


def _answer(path: str):
    """A shard's words, each encoded once; for each chunk the numbers of ids of its words and the ids."""

    def answer(_: int, parts: list[bytes]) -> Iterator[tuple[bytes, int, int]]:
        asked = []
        for part in parts:
            n = int.from_bytes(part[:8], "little")
            sizes = np.frombuffer(part, "<u4", n, 8).astype(np.int64)
            asked.append(pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(part[8 + 4 * n :])]))
        coded = pa.chunked_array(asked, pa.large_binary() if sum(map(len, parts)) > 2**31 else pa.binary()).combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        vocabulary = coded.dictionary.cast(pa.large_binary())
        offsets = np.frombuffer(vocabulary.buffers()[1], np.int64)[: len(vocabulary) + 1] if len(vocabulary) else np.zeros(1, np.int64)
        data = np.frombuffer(vocabulary.buffers()[2] or b"", np.uint8)
        ids, counts, a = [], [], 0
        while a < len(vocabulary):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + LIST, "right")) - 1)
            found = merges(path).replay_bytes(data[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1]))
            ids.append(found[0])
            counts.append(found[1])
            a = b
        flat, sizes = np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *counts])
        starts = np.cumsum(sizes) - sizes
        at, a = coded.indices.to_numpy(), 0
        for part in asked:
            own = at[a : a + len(part)]
            a += len(part)
            yield sizes[own].astype("<u4").tobytes() + flat[ranges(starts[own], sizes[own])].astype("<u4").tobytes(), 0, 0

    return answer


def _answered(rows: pa.Table, pattern: str, got: list[memoryview]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows one after another, where each row's begin and end)."""
    found = _pieces(rows, pattern)
    order, cuts = by_shard(found.words, len(got))
    sizes, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    for k, part in enumerate(got):
        n = int(cuts[k + 1] - cuts[k])
        sizes.append(np.frombuffer(part, "<u4", n))
        ids.append(np.frombuffer(part, "<u4", len(part) // 4 - n, 4 * n))
    own = np.concatenate(sizes).astype(np.int64)
    starts, counts = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
    starts[order], counts[order] = np.cumsum(own) - own, own
    return compose(found, starts, counts, np.concatenate(ids))


def _run(docs: DataFrame, id_col: str, text_col: str, path: str, pattern: str, chunk: int, from_files: bool, f, names: list[str], schema: str) -> DataFrame:
    spark = docs.sparkSession
    modest_batches(spark)
    given = rescannable(docs.select(F.col(id_col), whole(text_col).alias("text")), from_files)
    at = scratch(spark, "bpe")
    ask(given, _parts(pattern), _answer(path), at, chunk)
    kind = given.schema[0].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in chunks(batches, chunk):
            ids, offsets = _answered(rows, pattern, answers(at, name))
            yield from pa.Table.from_arrays([rows.column(0), *f(merges(path), ids, offsets)], [id_col, *names]).to_batches(1000)
            del rows, ids, offsets
            trim()

    return given.mapInArrow(finish, f"`{id_col}` {kind}, {schema}")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, from_files: bool = False) -> DataFrame:
    """One row per document: id, ``ids`` array<int>. ``from_files``: ``docs`` is read from files as it is."""

    def lists(_: Merges, ids: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))]

    return _run(docs, id_col, text_col, path, pattern, chunk, from_files, lists, ["ids"], "ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, from_files: bool = False) -> DataFrame:
    """Encodes and decodes: id, n_tokens, ids_sha256, decoded_sha256."""

    def digests(m: Merges, ids: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        own = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return [
            pa.array(np.diff(offsets), pa.int64()),
            pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own], pa.string()),
            pa.array([hashlib.sha256(m.decode(x)).hexdigest() for x in own], pa.string()),
        ]

    return _run(docs, id_col, text_col, path, pattern, chunk, from_files, digests, ["n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The texts of id lists: id, text. A null list gives an empty text; bytes that aren't UTF-8 are replaced."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [merges(path).decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
