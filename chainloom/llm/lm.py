"""Language-model scores from n-gram tries of Elias-Fano levels.

Two exchanges (see ``exchange``) learn the model and answer every document. In the first, a
chunk sends its distinct words to shards by hash; a shard adds their training counts and
numbers its words, frequent ones first, so that the numbers of a corpus' words are small
and unique without a list of them in one place. In the second, a chunk sends its distinct
n-grams, as numbers, to the shard of their context; a shard adds the counts, builds a trie
for each length, stores it in the shared folder and answers from the memory-mapped file. A
last scan scores the documents. What is sent are distinct n-grams per chunk, sorted, as
differences and compressed, not tokens.

A trie goes from an n-gram's first word to its last. A level is a sorted sequence of
(place of the parent, number of the word); pointers lead from each place to its children in
the next level. Both are monotone and Elias-Fano coded: high parts in unary, with a
directory of ones and zeros, low parts bit by bit. A lookup walks from level to level: a
successor search for the next word within the range of the context found so far, on the
mapped bytes. The last level has a probability for each n-gram and a weight for each
context, quantised to 16 bits on a logarithmic scale; no hash stands for an n-gram.

The unigram is (c + 0.5) / (N + 0.5 (V + 1)); longer contexts interpolate with absolute
discounting. Null and empty texts hold the end token only. Equal texts get equal scores;
repeated rows are scored each, with null ids too; ties don't arise; very long texts are cut
at no place. Only id, text and what ``held_out`` reads matter, whatever other columns there
are. Without training rows, N and V are 0 and every token has probability 1, for want of
anything else to expect. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, scratch, whole
from .exchange import answers, ask, by_shard, chunks, in_order, mapped, pack, pack_codes, put, rescannable, shard_of, skip, string_bytes, trim, unpack, unpack_codes
from .pieces import ranges

DISCOUNT, CHUNK, SCALE = 0.75, 10_000_000, 9.0
#: Words that no text has: the end of a text, and what stands before it.
END, BEGIN = " ", "  "
ASKED = 1 << 16


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities: 0 is none, the others are even steps of the logarithm down to 10^-9."""
    with np.errstate(divide="ignore"):
        code = np.rint(65535 + np.log10(p) * (65534 / SCALE))
    return np.where(p > 0, np.clip(code, 1, 65535), 0).astype(np.uint16)


_CODES = np.where(np.arange(65536) > 0, 10.0 ** ((np.arange(65536) - 65535) * (SCALE / 65534)), 0.0)


def restore(code: np.ndarray) -> np.ndarray:
    return _CODES[code]


class EliasFano:
    """A sorted sequence of unsigned 64-bit integers: ``low`` holds the low bits of each, one
    after another, ``high`` their high parts in unary: for each high part a one per value,
    then a zero. Both are 64-bit words and stay as they are; lookups touch only what they need."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.cumsum(ones) - ones  # before each 64 bits
        self.zeros = np.arange(len(ones)) * 64 - self.ones
        self.tops = len(high) * 64 - int(ones.sum())

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        bits = max(0, int(int(v[-1]) // n).bit_length() - 1) if n else 0
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        part, at = v & np.uint64((1 << bits) - 1), np.arange(n, dtype=np.int64) * bits
        if bits:
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = (at & 63) + bits > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        top = (v >> np.uint64(bits)).astype(np.int64)
        size = (int(top[-1]) + 1 if n else 0) + n
        unary = np.zeros(-(-size // 64) * 64, np.uint8)
        unary[top + np.arange(n)] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little").view("<u8"))

    def bytes(self) -> bytes:
        return np.array([self.n, self.bits, len(self.low), len(self.high)], "<u8").tobytes() + self.low.astype("<u8").tobytes() + self.high.astype("<u8").tobytes()

    @classmethod
    def read(cls, data, at: int) -> tuple[EliasFano, int]:
        n, bits, a, b = (int(x) for x in np.frombuffer(data, "<u8", 4, at))
        at += 32
        return cls(n, bits, np.frombuffer(data, "<u8", a, at), np.frombuffer(data, "<u8", b, at + 8 * a)), at + 8 * (a + b)

    def _select(self, i: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """The place of the i-th one, or of the i-th zero if ``flip``."""
        word = np.searchsorted(before, i, "right") - 1
        left, x, place = (i - before[word]).astype(np.uint8), self.high[word], np.zeros(len(i), np.uint8)
        if flip:
            x = ~x
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(x & np.uint64((1 << half) - 1))
            up = left >= count
            left -= count * up
            place += up.view(np.uint8) * np.uint8(half)
            x = x >> (up * np.uint64(half))
        return word * 64 + place

    def _run(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand in a row from each place on, 64 at most."""
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        x = self.high[np.minimum(word, len(self.high) - 1)] >> shift
        x |= np.where(shift > 0, self.high[np.minimum(word + 1, len(self.high) - 1)] << (np.uint64(64) - shift) % np.uint64(64), np.uint64(0))
        end = ~x & (x + np.uint64(1))  # the lowest zero
        return np.where(end > 0, np.bitwise_count(end - np.uint64(1)), 64).astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        part = self.low[word] >> shift
        over = (np.uint64(64) - shift) % np.uint64(64)
        part |= np.where(shift > 0, self.low[np.minimum(word + 1, len(self.low) - 1)] << over, np.uint64(0))
        return part & np.uint64((1 << self.bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i)
        return (self._select(i, self.ones, False) - i).astype(np.uint64) << np.uint64(self.bits) | self._low(i)

    def _within(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of the values that share each x's high part: they stand between two zeros."""
        top = (x >> np.uint64(self.bits)).astype(np.int64)
        inside = top < self.tops
        near = np.where(inside, top, 0)
        zero = np.where(near > 0, self._select(np.maximum(near - 1, 0), self.zeros, True), -1)
        lo = np.where(inside, zero + 1 - near, self.n)
        size = self._run(zero + 1)
        long = np.flatnonzero(inside & (size > 32))  # a run may go on in the next word
        if len(long):
            size[long] = self._select(near[long], self.zeros, True) - near[long] - lo[long]
        return lo, np.where(inside, lo + size, self.n)

    def _first(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first place in [lo, hi), where all share x's high part, whose low part isn't below that of x."""
        low = x & np.uint64((1 << self.bits) - 1)
        lo, hi = lo.copy(), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def successor(self, x: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """The place of the first value not below x, within [start, end) of each, if given."""
        x = x.astype(np.uint64)
        lo, hi = self._within(x) if self.n else (np.zeros(len(x), np.int64),) * 2
        if start is not None:
            lo, hi = np.clip(lo, start, end), np.clip(hi, start, end)
        return self._first(x, lo, hi)

    def find(self, x: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """The place of x, or -1."""
        if not self.n:
            return np.full(len(x), -1)
        x = x.astype(np.uint64)
        lo, hi = self._within(x)
        if start is not None:
            lo, hi = np.maximum(lo, start), np.minimum(hi, end)
        low = x & np.uint64((1 << self.bits) - 1)
        at, own = lo.copy(), self._low(np.clip(lo, 0, self.n - 1))
        more = np.flatnonzero((hi - lo > 1) & (own < low))  # most high parts have one value
        at[more] = self._first(x[more], lo[more] + 1, hi[more])
        own[more] = self._low(np.minimum(at[more], self.n - 1))
        return np.where((at < hi) & (own == low), at, -1)


class Codes:
    """16-bit codes of which few are frequent: a byte each, the place in a list of the 255 most
    frequent ones; the codes of the other places are kept by place."""

    def __init__(self, listed: np.ndarray, byte: np.ndarray, places: EliasFano, others: np.ndarray):
        self.listed, self.byte, self.places, self.others = listed, byte, places, others

    @classmethod
    def of(cls, codes: np.ndarray) -> Codes:
        listed = np.argsort(-np.bincount(codes, minlength=1 << 16), kind="stable")[:255].astype(np.uint16)
        place = np.full(1 << 16, 255, np.uint8)
        place[listed] = np.arange(255)
        byte = place[codes]
        rare = np.flatnonzero(byte == 255)
        return cls(listed, byte, EliasFano.of(rare), codes[rare])

    def bytes(self) -> bytes:
        tail = self.byte.tobytes() + self.others.astype("<u2").tobytes() + self.listed.astype("<u2").tobytes()
        return np.array([len(self.byte)], "<u8").tobytes() + self.places.bytes() + tail + bytes(-len(tail) % 8)

    @classmethod
    def read(cls, data, at: int) -> tuple[Codes, int]:
        n = int(np.frombuffer(data, "<u8", 1, at)[0])
        places, at = EliasFano.read(data, at + 8)
        byte = np.frombuffer(data, np.uint8, n, at)
        others = np.frombuffer(data[at + n : at + n + 2 * places.n], "<u2")
        listed = np.frombuffer(data[at + n + 2 * places.n : at + n + 2 * places.n + 510], "<u2")
        return cls(listed, byte, places, others), at + -(-(n + 2 * places.n + 510) // 8) * 8

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        byte = self.byte[at]
        rare = np.flatnonzero(byte == 255)
        out = self.listed[np.where(byte == 255, 0, byte)]
        if len(rare):
            out[rare] = self.others[self.places.find(at[rare].astype(np.uint64))]
        return out


class Trie:
    """The n-grams of one length. ``levels`` are their words from the first to the last,
    ``pointers`` lead from each level to the next."""

    def __init__(self, width: int, levels: list[EliasFano], pointers: list[EliasFano], chance: Codes, weight: Codes):
        self.width, self.levels, self.pointers, self.chance, self.weight = width, levels, pointers, chance, weight
        self._least: np.ndarray | None = None

    def least(self) -> np.ndarray:
        """For each context the least code of its successors."""
        if self._least is None:
            parts, n = [], len(self.weight.byte)
            for s in range(0, n, ASKED):
                at = self.pointers[-1][np.arange(s, min(s + ASKED, n) + 1)]
                parts.append(np.minimum.reduceat(self.chance[np.arange(int(at[0]), int(at[-1]))], (at[:-1] - at[0]).astype(np.int64)))
            self._least = np.concatenate([np.zeros(0, np.uint16), *parts])
        return self._least

    @classmethod
    def of(cls, contexts: list[np.ndarray], owner: np.ndarray, word: np.ndarray, count: np.ndarray, width: int, discount: float = DISCOUNT) -> Trie:
        """From distinct contexts in order (a column for each of their words) and distinct n-grams in order: the
        place of their context, their last word, and counts; what has count 0 is left out."""
        seen = count > 0
        owner, word, count = owner[seen], word[seen].astype(np.uint64), count[seen]
        used = np.bincount(owner, minlength=len(contexts[0])) > 0
        owner = (np.cumsum(used) - 1)[owner]
        columns = [c[used].astype(np.uint64) for c in contexts]
        new, levels, pointers, above = np.zeros(len(columns[0]), bool), [], [], np.zeros(len(columns[0]), np.uint64)
        new[:1] = True
        for c in columns:  # a place for each distinct beginning
            new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            levels.append(EliasFano.of(above[at] << np.uint64(width) | c[at]))
            if len(levels) > 1:
                pointers.append(EliasFano.of(np.append(np.searchsorted(at, last), len(at))))
            last, above = at, (np.cumsum(new) - 1).astype(np.uint64)
        n, kinds = np.bincount(owner, count), np.bincount(owner)
        levels.append(EliasFano.of(owner.astype(np.uint64) << np.uint64(width) | word))
        pointers.append(EliasFano.of(np.append(0, np.cumsum(kinds))))
        return cls(width, levels, pointers, Codes.of(quantise((count - discount) / n[owner])), Codes.of(quantise(discount * kinds / np.maximum(n, 1))))

    def bytes(self) -> bytes:
        return np.array([self.width, len(self.levels)], "<u8").tobytes() + b"".join(x.bytes() for x in (*self.levels, *self.pointers, self.chance, self.weight))

    @classmethod
    def read(cls, data, at: int = 0) -> tuple[Trie, int]:
        width, depth = (int(x) for x in np.frombuffer(data, "<u8", 2, at))
        at, parts = at + 16, []
        for _ in range(2 * depth - 1):
            part, at = EliasFano.read(data, at)
            parts.append(part)
        chance, at = Codes.read(data, at)
        weight, at = Codes.read(data, at)
        return cls(width, parts[:depth], parts[depth:], chance, weight), at

    def ask(self, contexts: list[np.ndarray], sizes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of each word's probability after its context (0: not there), of each context's weight (0: no such
        context) and of its least probability, for sorted contexts: contexts that begin alike walk together."""
        m = len(sizes)
        if not m or not self.levels[0].n:
            return np.zeros(len(word), np.uint16), np.zeros(m, np.uint16), np.zeros(m, np.uint16)
        owner, new, first = np.zeros(m, np.int64), np.zeros(m, bool), np.zeros(1, np.int64)
        new[0] = True
        place, start, end = first, np.zeros(1, np.int64), np.full(1, self.levels[0].n)
        for level, pointer, column in zip(self.levels[:-1], self.pointers, contexts, strict=True):
            new[1:] |= column[1:] != column[:-1]
            at = np.flatnonzero(new)
            found = self._walk(level, place[owner[at]], start[owner[at]], end[owner[at]], column[at])
            hit = found >= 0
            place, start, end = np.where(hit, found, 0), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for s in range(0, len(at), ASKED):
                own = np.flatnonzero(hit[s : s + ASKED]) + s
                start[own], end[own] = pointer[place[own]], pointer[place[own] + 1]
            owner = np.cumsum(new) - 1
        place, start, end = place[owner], start[owner], end[owner]
        weight = np.where(end > start, self.weight[place], 0).astype(np.uint16)
        least = np.where(end > start, self.least()[place], 0).astype(np.uint16)
        at = self._walk(self.levels[-1], *(np.repeat(x, sizes) for x in (place, start, end)), word)
        return np.where(at >= 0, self.chance[np.maximum(at, 0)], 0).astype(np.uint16), weight, least

    def _walk(self, level: EliasFano, place: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place of each word among its context's successors, or -1."""
        out = np.full(len(word), -1)
        fits = np.flatnonzero((start < end) & (word >> np.uint64(self.width) == 0))
        for s in range(0, len(fits), ASKED):
            own = fits[s : s + ASKED]
            out[own] = level.find(place[own].astype(np.uint64) << np.uint64(self.width) | word[own].astype(np.uint64), start[own], end[own])
        return out


def tokens(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(distinct words, then END and BEGIN; the words of all texts by their places there, an END
    behind each text; how many each text has). Words are what ASCII white space separates, A-Z in lower case."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    flat, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, bool)
    before = np.append(0, np.cumsum(full))
    sizes = np.diff(before[offsets - offsets[0]])
    coded = flat.filter(pa.array(full, pa.bool_())).dictionary_encode()
    words = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([END, BEGIN])])
    out = np.empty(len(coded) + len(sizes), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = coded.indices.to_numpy(), len(words) - 2
    return words, out, sizes + 1


def _learned(rows: pa.Table, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(rows.column("learn").to_numpy().astype(np.uint8), sizes)


def _sorted_by_shard(words: pa.StringArray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of words by shard and alphabet, and where in it each shard's begin."""
    order = pc.array_sort_indices(words).to_numpy().astype(np.int64)
    turn, cuts = by_shard(words.take(pa.array(order)), shards)
    return order[turn], cuts


def send_words(_: str, rows: pa.Table, shards: int) -> Iterator[tuple[int, bytes]]:
    """For each shard: its words' training counts, and the words, each with a line feed, compressed."""
    words, at, sizes = tokens(rows.columns[-1].chunk(0))
    counts = np.bincount(at, _learned(rows, sizes), len(words)).astype(np.uint64)
    order, cuts = _sorted_by_shard(words, shards)
    data, offsets = string_bytes(pc.binary_join_element_wise(words.take(pa.array(order)), "\n", "").cast(pa.string()))
    for k in range(shards):
        a, b = cuts[k], cuts[k + 1]
        yield k, pack(counts[order[a:b]]) + zstandard.compress(data[offsets[a] : offsets[b]], 3)


def number_words(shards: int):
    def answer(shard: int, parts: list[bytes]) -> Iterator[tuple[bytes, int, int]]:
        """Ranks of each chunk's words among the shard's, by falling counts, and where in the ranks counts fall."""
        asked, counted = [], []
        for part in parts:
            counts, at = unpack(part)
            counted.append(counts.astype(np.int64))
            data = np.frombuffer(zstandard.decompress(part[at:]) if len(counts) else b"", np.uint8)
            ends = np.flatnonzero(data == 10)
            inner = np.append(0, ends - np.arange(len(ends)))
            asked.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(inner), pa.py_buffer(data[data != 10])]))
        coded = pa.concat_arrays(asked).dictionary_encode()
        at = coded.indices.to_numpy()
        total = np.bincount(at, np.concatenate(counted), len(coded.dictionary)).astype(np.int64)
        order = pc.array_sort_indices(coded.dictionary).to_numpy()  # equal counts in the order of words
        order = order[np.argsort(-total[order], kind="stable")]
        rank = np.empty(len(total), np.uint64)
        rank[order] = np.arange(len(total), dtype=np.uint64)
        falls = np.flatnonzero(np.diff(total[order], prepend=-1))
        steps = pack(falls.astype(np.uint64)) + pack(total[order][falls].astype(np.uint64))
        n, v, a = int(total.sum()), int((total > 0).sum()), 0
        for words in asked:
            own = at[a : a + len(words)]
            a += len(words)
            yield pack(rank[own]) + steps, n, v
            n = v = 0  # a shard gives its sums once

    return answer


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, a place of each, the number of each key among them)."""
    order = np.argsort(keys)
    own = keys[order]
    new = np.append(True, own[1:] != own[:-1])[: len(own)]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return own[new], order[new], place


class Grams:
    """A chunk's documents as distinct n-grams of numbered words, for each length from 1 on."""

    def __init__(self, rows: pa.Table, got: list[memoryview], order: int):
        words, at, self.sizes = tokens(rows.columns[-1].chunk(0))
        place, _ = _sorted_by_shard(words, len(got))
        numbers, counts = [], []
        for shard, part in enumerate(got):
            rank, i = unpack(part)
            falls, i = unpack(part, i)
            steps, _ = unpack(part, i)
            counts.append(steps.astype(np.int64)[np.searchsorted(falls, rank, "right") - 1] if len(rank) else np.zeros(0, np.int64))
            numbers.append(rank.astype(np.uint64) * np.uint64(len(got)) + np.uint64(shard))  # frequent words have small numbers
        number, count = np.empty(len(words), np.uint64), np.empty(len(words), np.int64)
        number[place], count[place] = np.concatenate(numbers), np.concatenate(counts)
        turn = np.argsort(number)
        rank = np.empty(len(words), np.int64)
        rank[turn] = np.arange(len(words))
        self.numbers, self.known = number[turn], count[turn]
        now, begin, n = rank[at], int(rank[len(words) - 1]), len(words)
        start = np.cumsum(self.sizes) - self.sizes
        step = np.arange(len(now)) - np.repeat(start, self.sizes)  # how far into its text each token is
        self.place = now
        learn = _learned(rows, self.sizes)
        self.contexts, self.spans, self.words, self.counts, self.lower = [], [], [], [], []
        ahead = np.where(step > 0, np.roll(now, 1), begin)
        used = np.bincount(ahead, minlength=n) > 0
        columns, context, first = [np.flatnonzero(used)], (np.cumsum(used) - 1)[ahead], int(used[:begin].sum())
        for k in range(1, order):
            if k > 1:  # the contexts are the grams of the length before, and what stands before a text
                spot = int(np.searchsorted(grams, first * n + begin))
                columns = [np.insert(c, spot, begin) for c in (*(c[grams // n] for c in columns), grams % n)]
                context = np.where(step > 0, np.roll(self.place + (self.place >= spot), 1), spot)
                used = np.bincount(context, minlength=len(columns[0])) > 0  # an end has nothing behind it
                columns, context, first = [c[used] for c in columns], (np.cumsum(used) - 1)[context], int(used[:spot].sum())
            grams, some, place = _distinct(context * n + now)
            self.contexts.append([self.numbers[c] for c in columns])
            self.spans.append(np.bincount(grams // n, minlength=len(columns[0])))
            self.words.append(self.numbers[grams % n])
            self.counts.append(np.bincount(place, learn, len(grams)).astype(np.uint64))
            self.lower.append(self.place[some])
            self.place = place

    def orders(self, shards: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length from 2 on, the order of contexts by shard and where each shard's begin."""
        for columns in self.contexts:
            h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
            for c in columns:
                h = (h ^ c) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            yield in_order(shard_of(h, shards), shards)

    def parts(self, shards: int) -> Iterator[tuple[int, bytes]]:
        """What each shard gets: for each length its contexts, sorted, their numbers of words, the words, and training counts."""
        found: list[list[bytes]] = [[] for _ in range(shards)]
        for (order, cuts), columns, spans, words, counts in zip(self.orders(shards), self.contexts, self.spans, self.words, self.counts, strict=True):
            begin = np.cumsum(spans) - spans
            for k in range(shards):
                own = order[cuts[k] : cuts[k + 1]]
                span, grams = spans[own], ranges(begin[own], spans[own])
                new = np.zeros(len(own), bool)
                new[:1] = True
                for c in columns:  # differences to the context before, as long as it begins alike
                    c = c[own]
                    step = np.where(new, c, c - np.append(c[:1], c[:-1]))
                    found[k].append(pack(step))
                    new[1:] |= c[1:] != c[:-1]
                w = words[grams]
                head = np.zeros(len(w), bool)
                head[np.cumsum(span) - span] = True
                found[k] += [pack(span.astype(np.uint64)), pack(np.where(head, w, w - np.append(w[:1], w[:-1]))), pack(counts[grams])]
        for k, x in enumerate(found):
            yield k, b"".join(x)


def _sums(steps: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Running sums that begin anew where ``new`` holds."""
    total = np.cumsum(steps, dtype=np.uint64)
    at = np.flatnonzero(new)
    return total - np.repeat(total[at] - steps[at], np.diff(np.append(at, len(steps)))) if len(steps) else total


def unpack_grams(data: bytes, length: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(columns of contexts, numbers of words, words, counts) of the n-grams of this length."""
    at = 0
    for k in range(1, length - 1):
        for _ in range(k + 3):
            at = skip(data, at)
    columns, new = [], None
    for _ in range(length - 1):
        steps, at = unpack(data, at)
        if new is None:
            new = np.zeros(len(steps), bool)
            new[:1] = True
        columns.append(_small(_sums(steps.astype(np.uint64), new)))
        new[1:] |= columns[-1][1:] != columns[-1][:-1]
    span, at = unpack(data, at)
    steps, at = unpack(data, at)
    span = span.astype(np.int64)
    head = np.zeros(len(steps), bool)
    head[np.cumsum(span) - span] = True
    return columns, span, _small(_sums(steps.astype(np.uint64), head)), unpack(data, at)[0]


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32) if not len(values) or int(values.max()) < 1 << 32 else values


class Merged:
    """The n-grams of one length of all chunks, each once: contexts and n-grams in order, training
    counts, and for each chunk where its own are among them."""

    def __init__(self, parts: list[bytes], length: int):
        every = [unpack_grams(part, length) for part in parts]
        columns = [np.concatenate([e[0][i] for e in every]) for i in range(length - 1)]
        sizes, word, count = (np.concatenate([e[i] for e in every]) for i in (1, 2, 3))
        self.rows, self.grams = np.cumsum([0, *(len(e[1]) for e in every)]), np.cumsum([0, *(len(e[2]) for e in every)])
        del every
        top = max([int(x.max()) for x in (word, *columns) if len(x)], default=0)
        self.width = max(1, top.bit_length())
        if len(columns) == 1:
            order = np.argsort(columns[0])
        elif len(columns) == 2 and self.width <= 32:
            order = np.argsort(columns[0].astype(np.uint64) << np.uint64(32) | columns[1])
        else:
            order = np.lexsort(columns[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in columns:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
        self.contexts = [c[order][new] for c in columns]
        self.of_row = np.empty(len(order), np.int32)
        self.of_row[order] = np.cumsum(new) - 1
        del columns, order, new
        keys, _, place = _distinct(np.repeat(self.of_row, sizes).astype(np.uint64) << np.uint64(self.width) | word)
        self.of_gram = place.astype(np.int32)
        self.count = np.bincount(place, count, len(keys))
        self.owner, self.word = (keys >> np.uint64(self.width)).astype(np.int64), _small(keys & np.uint64((1 << self.width) - 1))

    def trie(self) -> Trie:
        return Trie.of(self.contexts, self.owner, self.word, self.count, self.width)

    def answers(self, trie: Trie) -> Iterator[bytes]:
        """What the trie has of each chunk's n-grams; each is looked up once for all chunks."""
        p, w, least = trie.ask(self.contexts, np.bincount(self.owner, minlength=len(self.contexts[0])), self.word)
        # Probabilities as what they are above the least of their context: few values, most of them one.
        above = np.where(p > 0, p.astype(np.int64) - least[self.owner] + 1, 0).astype(np.uint16)
        for k in range(len(self.rows) - 1):
            row, gram = self.of_row[self.rows[k] : self.rows[k + 1]], self.of_gram[self.grams[k] : self.grams[k + 1]]
            yield pack_codes(least[row]) + pack_codes(w[row]) + pack_codes(above[gram])


def answer_grams(at: str, order: int):
    def answer(shard: int, parts: list[bytes]) -> Iterator[tuple[bytes, int, int]]:
        """Builds and stores a shard's tries and answers the chunks from their file."""
        levels, data = [], []
        for n in range(2, order + 1):
            levels.append(Merged(parts, n))
            data.append(levels[-1].trie().bytes())
        put(f"{at}/{shard:06d}", data)
        del data
        file, i, found = mapped(f"{at}/{shard:06d}"), 0, []
        for level in levels:
            trie, i = Trie.read(file, i)
            found.append(level.answers(trie))
        for own in zip(*found, strict=True):
            yield b"".join(own), 0, 0
        del levels, found
        trim()

    return answer


def score(docs: DataFrame, held_out: Column, order: int = 3, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", from_files: bool = False) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where ``held_out`` is false. ``chunk`` bounds the bytes of text that
    a scan task holds; the number of shards is that of shuffle partitions. ``from_files``:
    ``docs`` is read from files as it is.
    """
    spark = docs.sparkSession
    modest_batches(spark, 500)
    at = scratch(spark, "lm")
    given = rescannable(docs.select(F.col(id_col).alias("id"), (~F.coalesce(held_out, F.lit(False))).alias("learn"), whole(text_col).alias("text")), from_files)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = ask(given, send_words, number_words(shards), f"{at}/words", chunk)
    sums = words.agg(F.sum("a").alias("n"), F.sum("b").alias("v")).first()
    n, v = int(sums["n"] or 0), int(sums["v"] or 0)
    grams = lambda name, rows: Grams(rows, answers(f"{at}/words", name), order)
    ask(given, lambda name, rows, shards: grams(name, rows).parts(shards), answer_grams(f"{at}/tries", order), f"{at}/grams", chunk)
    kind = given.schema["id"].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in chunks(batches, chunk):
            g, got = grams(name, rows), answers(f"{at}/grams", name)
            where = [0] * len(got)
            # By distinct n-grams, shorter ones first; the last ones' values go to the tokens.
            chance = base = (g.known + 0.5) / (n + 0.5 * (v + 1))
            known, below = g.known > 0, np.log10(base)
            for (turn, _), lower, span in zip(g.orders(len(got)), g.lower, g.spans, strict=True):
                p, w, a = [], [], 0
                for k, part in enumerate(got):
                    least, where[k] = unpack_codes(part, where[k])
                    weight, where[k] = unpack_codes(part, where[k])
                    above, where[k] = unpack_codes(part, where[k])
                    own = span[turn[a : a + len(least)]]
                    a += len(least)
                    p.append(np.where(above > 0, above + np.repeat(least, own) - 1, 0).astype(np.uint16))
                    w.append(weight)
                weight, own = np.empty(len(span)), np.empty(len(lower))
                weight[turn] = restore(np.concatenate(w))
                own[ranges((np.cumsum(span) - span)[turn], span[turn])] = restore(np.concatenate(p))
                weight = np.repeat(weight, span)
                chance = np.where(weight > 0, own + weight * chance[lower], chance[lower])
                known, below = known[lower], below[lower]
            first = np.cumsum(g.sizes) - g.sizes
            total = lambda x: np.add.reduceat(x[g.place], first)  # noqa: B023, E731
            yield from pa.Table.from_arrays(
                [rows.column("id"), pc.invert(rows.column("learn")), pa.array(g.sizes), pa.array(total(known.astype(np.int64))), pa.array(np.full(rows.num_rows, n, np.int64)), pa.array(total(below)), pa.array(total(np.log10(np.minimum(chance, 1.0))))],
                [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            ).to_batches(10_000)
            del g, got, chance, base, known, below
            trim()

    return given.mapInArrow(finish, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
