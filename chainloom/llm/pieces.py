"""Texts as runs of numbered pieces, the matches of the pattern of byte-level BPE.

Where a single space stands between two characters that aren't white space, the pattern
always ends a match before the space. So a text falls into chunks there, and chunks repeat
far more often than texts: a batch's distinct chunks are found in Arrow, those of Latin
letters with at most one ASCII mark at the end are split by one regular expression for all,
and only the others go through the pattern. A text with other white space beside a space
goes through the pattern whole.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters below U+0250, which every version of Unicode calls letters, then at most one ASCII mark.
SIMPLE = "^(?P<body>[A-Za-zªµºÀ-ÖØ-öø-ɏ]+)(?P<mark>[!-/:-@\\[-`{-~]?)$"


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


class Pieces(NamedTuple):
    words: pa.StringArray  #: the distinct pieces of a batch of texts
    numbers: np.ndarray  #: of each text's pieces, one text after another, the place in ``words``
    sizes: np.ndarray  #: how many pieces each text has


def _strings(x: pa.Array | pa.ChunkedArray) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def split(texts: pa.Array, find: Callable[[str], list[str]]) -> Pieces:
    """``find`` gives the pieces of a string, an empty list for an empty one."""
    parts = pc.split_pattern(texts.cast(pa.large_string()), " ")
    offsets = parts.offsets.to_numpy().astype(np.int64)
    begin, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    coded = parts.flatten().dictionary_encode()
    at, kinds = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    first = at[begin]
    plain = np.ones(len(at), bool)
    plain[begin] = False
    used = np.zeros(len(kinds), bool)
    used[at[plain]] = True
    simple = pc.extract_regex(kinds, SIMPLE)
    fits = simple.is_valid().to_numpy(zero_copy_only=False) & used if len(kinds) else used
    taken = simple.filter(pa.array(fits))
    body, mark = taken.field("body"), taken.field("mark")
    marked = pc.not_equal(mark, "").to_numpy(zero_copy_only=False) if len(taken) else np.zeros(0, bool)

    # Chunks for the pattern: other spaced ones, then those that begin a text, then whole texts.
    spaced = np.flatnonzero(used & ~fits)
    strings = kinds.take(pa.array(spaced)).to_pylist()
    sound = [bool(s) and not s[0].isspace() and not s[-1].isspace() for s in strings]
    heads, head = np.unique(first, return_inverse=True)
    openings = kinds.take(pa.array(heads)).to_pylist()
    ok = np.ones(len(kinds), bool)
    ok[spaced] = sound
    ok_head = np.array([not s or not s[-1].isspace() for s in openings], bool)
    bad = np.zeros(len(begin), bool)
    if len(begin):
        wrong = plain & ~ok[at]
        wrong[begin] |= ~ok_head[head] & (sizes > 1)
        bad = np.add.reduceat(wrong, begin) > 0
    alone = np.flatnonzero(bad)
    lists = [find(" " + s) if good else [] for s, good in zip(strings, sound, strict=True)]
    lists += map(find, openings)
    lists += map(find, texts.take(pa.array(alone)).to_pylist())
    n = np.fromiter(map(len, lists), np.int64, len(lists))

    every = [pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), body, pa.scalar("", pa.large_string())), mark.filter(pa.array(marked)), pa.array(list(chain.from_iterable(lists)), pa.large_string())]
    numbered = _strings(pa.chunked_array(every, pa.large_string())).dictionary_encode()
    number = numbered.indices.to_numpy().astype(np.int64)
    # The pieces of each chunk, in one array: those of ``kinds`` first, then openings and whole texts.
    count = np.zeros(len(kinds) + len(heads) + len(alone), np.int64)
    count[np.flatnonzero(fits)] = 1 + marked
    count[spaced] = n[: len(spaced)]
    count[len(kinds) :] = n[len(spaced) :]
    start = np.cumsum(count) - count
    flat = np.empty(int(count.sum()), np.int64)
    where = np.flatnonzero(fits)
    flat[start[where]] = number[: len(where)]
    flat[start[where[marked]] + 1] = number[len(where) : len(where) + int(marked.sum())]
    rest = np.concatenate([spaced, np.arange(len(kinds), len(count))])
    flat[ranges(start[rest], count[rest])] = number[len(where) + int(marked.sum()) :]

    at[begin] = len(kinds) + head
    keep = np.ones(len(at), bool)
    if len(alone):
        keep[ranges(begin[alone], sizes[alone])] = False
        keep[begin[alone]] = True
        at[begin[alone]] = len(kinds) + len(heads) + np.arange(len(alone))
    here = count[at] * keep
    per_text = np.add.reduceat(here, begin) if len(begin) else np.zeros(0, np.int64)
    at = at[keep]
    return Pieces(numbered.dictionary.cast(pa.string()), flat[ranges(start[at], count[at])].astype(np.int32), per_text)


class Codes:
    """The ids of pieces, encoded once each as long as the table has room.

    ``encode`` maps a list of strings to (starts, sizes, ids): the ids of the i-th string are
    ids[starts[i] : starts[i] + sizes[i]]. Beyond ``most`` pieces or ``most_ids`` ids the
    table starts anew.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], most: int = 600_000, most_ids: int = 5_000_000):
        self.encode, self.most, self.most_ids = encode, most, most_ids
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``encode``."""
        if len(self.known) > self.most or len(self.flat) > self.most_ids:
            self.reset()
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            starts, sizes, ids = self.encode(new)
            known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
            self.starts, self.sizes, self.flat = np.concatenate([self.starts, starts + len(self.flat)]), np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return self.starts[at], self.sizes[at], self.flat


def compose(found: Pieces, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): the ids of all texts one after another, and where each text's begin and end."""
    own = sizes[found.numbers]
    ids = flat[ranges(starts[found.numbers], own)]
    ends = np.concatenate([[0], np.cumsum(own)])
    return ids, ends[np.concatenate([[0], np.cumsum(found.sizes)])]
