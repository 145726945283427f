"""Matroska media columns: a writer for 8-bit sample tracks and an EBML parser.

``packets`` turns a column of Matroska files into a packet table (cluster, block, place in
the lace, track, timestamp, byte range); ``demux`` joins a track's packets again. Elements
are read by their variable-length ids and sizes; unknown-size segments and clusters, simple
blocks, block groups, the three kinds of lacing and cues are understood, other elements are
skipped. A null file has no packets; a file that isn't Matroska raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, whole

# Element ids, as the Matroska specification gives them.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x4282, 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE1, 0xB5, 0x9F, 0x6264, 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = frozenset((SEGMENT, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS, INFO))

RATE = 8000  # samples a second; the timestamp scale makes one tick of one sample
FRAME, LACE, BLOCKS = 512, 8, 8  # bytes a frame, frames a block, blocks a cluster
ALIGN = 64


class Packet(NamedTuple):
    cluster: int
    block: int
    lace: int
    track: int
    timestamp: int
    start: int
    length: int
    keyframe: bool


class File(NamedTuple):
    packets: list[Packet]
    tracks: list[tuple[int, str]]
    cues: list[tuple[int, int]]
    clusters: list[int]
    scale: int
    laces: dict[int, int]


def _id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def vint(value: int, width: int = 0) -> bytes:
    """A size or number as EBML writes it; all ones are kept for the unknown size."""
    width = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def signed_vint(value: int) -> bytes:
    width = next(n for n in range(1, 9) if abs(value) < (1 << 7 * n - 1))
    return vint(value + (1 << 7 * width - 1) - 1, width)


def element(name: int, body: bytes) -> bytes:
    return _id(name) + vint(len(body)) + body


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


_HEAD = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOC_TYPE, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
_INFO = element(INFO, number(TIMESTAMP_SCALE, 10**9 // RATE) + element(0x4D80, b"chainloom") + element(0x5741, b"chainloom"))
_FLOAT_RATE = bytes.fromhex("45fa0000")  # 8000.0 as a big-endian 32-bit float
_TRACKS = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING, _FLOAT_RATE) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))))


def laced(frames: list[bytes], kind: str = "") -> tuple[int, bytes]:
    """The lacing bits and the block's body: none for one frame, fixed for equal frames, else EBML or, if asked for, Xiph."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if not kind and len(set(sizes)) == 1:
        return 2, head + b"".join(frames)
    if kind == "xiph":
        return 1, head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1]) + b"".join(frames)
    return 3, head + vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False)) + b"".join(frames)


def mux(payload: bytes, kind: str = "") -> bytes:
    """A Matroska file whose one track holds ``payload`` as unsigned 8-bit samples."""
    parts, cues, at = [_INFO, _TRACKS], [], len(_INFO) + len(_TRACKS)
    span = FRAME * LACE * BLOCKS
    for base in range(0, len(payload), span):
        blocks = []
        for first in range(base, min(base + span, len(payload)), FRAME * LACE):
            chunk = payload[first : first + FRAME * LACE]
            bits, body = laced([chunk[i : i + FRAME] for i in range(0, len(chunk), FRAME)], kind)
            blocks.append(element(SIMPLE_BLOCK, vint(1) + (first - base).to_bytes(2, "big") + bytes([0x80 | bits << 1]) + body))
        cluster = element(CLUSTER, number(TIMESTAMP, base) + b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    if cues:
        parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


def read_vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """Value and place after it; with ``keep`` the marker bit stays, as in ids. -1 is the unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError("not an EBML number")
    width = 9 - data[at].bit_length()
    raw = int.from_bytes(data[at : at + width], "big")
    if at + width > len(data):
        raise ValueError("cut short")
    if keep:
        return raw, at + width
    value = raw & (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def _frames(data: bytes, at: int, end: int, bits: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if not bits:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if bits == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif bits == 3 and n > 1:
        size, at = read_vint(data, at, False)
        sizes.append(size)
        for _ in range(n - 2):
            width = 9 - data[at].bit_length()
            step, at = read_vint(data, at, False)
            step = (1 << 7 * width) - 1 if step < 0 else step
            sizes.append(sizes[-1] + step - (1 << 7 * width - 1) + 1)
    else:
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace sizes exceed their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> File:
    """The packet table of one file, its tracks, cues and cluster positions."""
    packets: list[Packet] = []
    tracks: list[tuple[int, str]] = []
    cues: list[tuple[int, int]] = []
    clusters: list[int] = []
    laces: dict[int, int] = {}
    scale, base, segment, block = 1_000_000, 0, 0, 0
    track, codec, cue = 0, "", 0
    head, at = read_vint(data, 0, True)
    if head != EBML:
        raise ValueError("no EBML header")
    size, at = read_vint(data, at, False)
    at += size
    stack: list[tuple[int, int]] = []  # element and its end
    while at < len(data):
        while stack and at >= stack[-1][1]:
            if stack.pop()[0] == TRACK_ENTRY:
                tracks.append((track, codec))
        start = at
        name, at = read_vint(data, at, True)
        size, at = read_vint(data, at, False)
        end = len(data) if size < 0 else at + size
        if end > len(data):
            raise ValueError("an element exceeds the file")
        if name == CLUSTER:
            while stack and stack[-1][0] != SEGMENT:  # a cluster of unknown size ends where the next begins
                stack.pop()
            clusters.append(start - segment)
        if name in MASTERS:
            if name == SEGMENT:
                segment = at
            stack.append((name, end))
            continue
        if name == TIMESTAMP:
            base = int.from_bytes(data[at:end], "big")
        elif name in (SIMPLE_BLOCK, BLOCK):
            of, place = read_vint(data, at, False)
            when = base + int.from_bytes(data[place : place + 2], "big", signed=True)
            flags = data[place + 2]
            bits = flags >> 1 & 3
            laces[bits] = laces.get(bits, 0) + 1
            for lace, (first, length) in enumerate(_frames(data, place + 3, end, bits)):
                packets.append(Packet(len(clusters) - 1, block, lace, of, when, first, length, bool(flags & 0x80)))
                when += length  # one sample a byte: laced frames follow each other
            block += 1
        elif name == TRACK_NUMBER:
            track = int.from_bytes(data[at:end], "big")
        elif name == CODEC_ID:
            codec = data[at:end].decode()
        elif name == TIMESTAMP_SCALE:
            scale = int.from_bytes(data[at:end], "big")
        elif name == CUE_TIME:
            cue = int.from_bytes(data[at:end], "big")
        elif name == CUE_CLUSTER_POSITION:
            cues.append((cue, int.from_bytes(data[at:end], "big")))
        at = end
    while stack:
        if stack.pop()[0] == TRACK_ENTRY:
            tracks.append((track, codec))
    return File(packets, tracks, cues, clusters, scale, laces)


def demux(data: bytes, track: int = 1) -> bytes:
    return b"".join(data[p.start : p.start + p.length] for p in parse(data).packets if p.track == track)


def feature(found: File) -> str:
    """What the container says of itself, as text."""
    last = found.packets[-1]
    ticks = last.timestamp + last.length
    fit = sum(c in found.clusters for _, c in found.cues)
    return f"tracks={len(found.tracks)};codec={found.tracks[0][1]};clusters={len(found.clusters)};packets={len(found.packets)};fixed={found.laces.get(2, 0)};ebml={found.laces.get(3, 0)};cues={fit};ms={ticks * found.scale // 1_000_000}"


def packets(files: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """The packet table of a column of files: id, cluster, block, lace, track, timestamp, start, length, keyframe."""
    modest_batches(files.sparkSession, 200)
    kind = files.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, data in zip(batch.column(0), batch.column(1), strict=True):
                if data.is_valid:
                    found = parse(data.as_py()).packets
                    ids += [i] * len(found)
                    rows += found
            cols = list(zip(*rows, strict=True)) or [[] for _ in Packet._fields]
            types = [pa.int64()] * 7 + [pa.bool_()]
            own = pa.array([i.as_py() for i in ids], batch.column(0).type)
            yield pa.RecordBatch.from_arrays([own, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [id_col, *Packet._fields])

    return files.select(id_col, data_col).mapInArrow(run, f"{id_col} {kind}, cluster long, block long, lace long, track long, timestamp long, start long, length long, keyframe boolean")


def padded(text: bytes) -> bytes:
    """With zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % ALIGN if text else ALIGN)


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' texts as Matroska files: id, n_bytes, data."""
    return _rows(docs, id_col, text_col, "n_bytes long, data binary", lambda text: (len(text), mux(padded(text))))


def read_back(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Parses stored files and digests the track: one row per file."""

    def row(n: int, data: bytes) -> tuple:
        found = parse(data)
        payload = b"".join([data[p.start : p.start + p.length] for p in found.packets if p.track == 1])
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(data), hashlib.sha256(data).hexdigest(), feature(found)

    kind = files.schema[id_col].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(n.as_py(), d.as_py()) for n, d in zip(batch.column(1), batch.column(2), strict=True)]
            cols = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [id_col, *names])

    return files.select(id_col, "n_bytes", "data").mapInArrow(run, f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _rows(docs: DataFrame, id_col: str, text_col: str, schema: str, f) -> DataFrame:
    modest_batches(docs.sparkSession, 200)
    kind = docs.schema[id_col].dataType.simpleString()
    types = [pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [f(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column(1)]
            cols = list(zip(*rows, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [id_col, "n_bytes", "data"])

    return docs.select(F.col(id_col), whole(text_col).alias("text")).mapInArrow(run, f"{id_col} {kind}, {schema}")
