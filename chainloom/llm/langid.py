"""Language identification by a small byte convolutional network.

Bytes of the lower-cased text are embedded, filters of several widths slide over them, each filter's largest answer
in a window is kept, and a linear layer with softmax gives the languages. The languages are
all that labelled rows have. The network's first weights come from windows of at most about
``sample`` labelled documents, as many of each language as there are; from there every task
trains it on all windows of all its labelled texts, and the mean of the tasks' weights, by
their windows, is the network. It is applied to every window of every text: the texts of a batch lie one after
another in one byte array, each padded to whole windows, and the embedding and filters are
folded into tables that are looked up by byte pairs. A text's answer is the softmax of the
mean over its windows, weighted by their bytes.

A text that is null, empty or without a letter is ``und`` with score 0, as is everything if
no labelled row is there to learn from. Equal texts get equal answers; of equal scores the
language that sorts first wins. Rows keep their number, and only id, text and (to learn
from) the label are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import modest_batches, whole
from .exchange import trim

WINDOW, EMBED, FILTERS, WIDTHS = 256, 8, 16, (2, 3, 4)
NONE = "und"


class Network:
    def __init__(self, languages: list[str], seed: int = 11):
        self.languages = languages
        r = np.random.default_rng(seed)
        self.p = {"embed": r.normal(0, 0.5, (256, EMBED))}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["out"] = r.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages)))
        self.p["bias"] = np.zeros(len(languages))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.tables: dict | None = None

    def _step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients for windows x (padded with zero bytes) of classes y."""
        p, n = self.p, len(x)
        e = p["embed"][x]
        real = x != 0
        pooled, where = [], []
        for w in WIDTHS:
            span = x.shape[1] - w + 1
            z = sum(e[:, i : i + span] @ p[f"w{w}"][i] for i in range(w)) + p[f"b{w}"]
            z = np.where(real[:, :span, None], z, -1e9)
            at = z.argmax(1)
            pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
            where.append(at)
        h = np.concatenate(pooled, 1)
        a = np.tanh(h / 2)
        z = a @ p["out"] + p["bias"]
        z -= z.max(1, keepdims=True)
        soft = np.exp(z)
        soft /= soft.sum(1, keepdims=True)
        soft[np.arange(n), y] -= 1
        dz = soft * (weight / weight.sum())[:, None]
        g = {"out": a.T @ dz, "bias": dz.sum(0), "embed": np.zeros_like(p["embed"])}
        dh = (dz @ p["out"].T) * (1 - a * a) / 2
        rows = np.arange(n)[:, None]
        for k, w in enumerate(WIDTHS):
            d = dh[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"b{w}"], g[f"w{w}"] = d.sum(0), np.empty_like(p[f"w{w}"])
            for i in range(w):
                byte = x[rows, where[k] + i].astype(np.intp)
                g[f"w{w}"][i] = np.einsum("nfe,nf->ef", p["embed"][byte], d)
                met = np.bincount((byte * FILTERS + np.arange(FILTERS)).ravel(), d.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                g["embed"] += (met @ p[f"w{w}"][i].T).astype(np.float32)
        return g

    def fit(self, windows: list[bytes], labels: list[int], steps: int = 900, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        x = np.zeros((len(windows), WINDOW), np.uint8)
        for i, b in enumerate(windows):
            x[i, : len(b)] = np.frombuffer(b, np.uint8)
        y = np.array(labels)
        weight = (1 / np.sqrt(np.bincount(y, minlength=len(self.languages)) + 1))[y]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(u) for k, u in self.p.items()}
        step, total = 0, steps
        while step < total:
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                if step == total:
                    break
                own = order[i : i + batch]
                part = x[own].copy()
                for row, keep in enumerate(r.integers(12, WINDOW * 2, len(own))):  # some windows are short, as short texts are
                    part[row, keep:] = 0
                step += 1
                self._move(self._step(part, y[own], weight[own]), m, v, step, rate * (1 - step / (total + 1)))
        return self

    def _move(self, gradients: dict[str, np.ndarray], m: dict, v: dict, step: int, rate: float) -> None:
        for k, g in gradients.items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def fit_all(self, texts: Iterator[tuple[list[bytes], list[int]]], weight: np.ndarray, batch: int = 64, chunk: int = 4096, rate: float = 0.001, seed: int = 5) -> int:
        """Trains on every window of all texts once, in mixed order within chunks, and returns how many there were."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(u) for k, u in self.p.items()} for _ in range(2))
        step = n = 0
        for x, y in _chunks(texts, chunk):
            order, n = r.permutation(len(x)), n + len(x)
            for i in range(0, len(x), batch):
                own = order[i : i + batch]
                part = x[own]
                for row, keep in enumerate(r.integers(12, WINDOW * 2, len(own))):
                    part[row, keep:] = 0
                step += 1
                self._move(self._step(part, y[own], weight[y[own]]), m, v, step, rate / np.sqrt(1 + step / 50))
        return n

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def set(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            self.p[k] = flat[at : at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32)
            at += self.p[k].size
        self.tables = None

    def _folded(self) -> dict:
        """For each width the tables of byte pairs (and of the odd byte) that give its filters' answers."""
        if self.tables is None:
            self.tables = {}
            for w in WIDTHS:
                one = [self.p["embed"] @ self.p[f"w{w}"][i] for i in range(w)]
                one[0] = one[0] + self.p[f"b{w}"]
                one[0][0] = -1e9  # nothing begins in the padding
                two = [np.ascontiguousarray((one[i][:, None] + one[i + 1][None]).reshape(65536, FILTERS), np.float32) for i in range(0, w - 1, 2)]
                self.tables[w] = two, (one[-1].astype(np.float32) if w % 2 else None)
        return self.tables

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Logits of each window of a byte array whose length is a multiple of the window."""
        tables, step = self._folded(), WINDOW * 128
        out = np.empty((len(data) // WINDOW, len(self.languages)), np.float32)
        wide = np.concatenate([data, np.zeros(8, np.uint8)])
        for start in range(0, len(data), step):
            n = min(step, len(data) - start)
            part = wide[start : start + n + 8]
            pair = part[:-1].astype(np.intp) << 8 | part[1:]
            kept = []
            for w in WIDTHS:
                two, odd = tables[w]
                z = two[0][pair[:n]]
                for k in range(1, len(two)):
                    z += two[k][pair[2 * k : 2 * k + n]]
                if odd is not None:
                    z += odd[part[w - 1 : w - 1 + n]]
                kept.append(z.reshape(-1, WINDOW, FILTERS).max(1))
            out[start // WINDOW : (start + n) // WINDOW] = np.tanh(np.concatenate(kept, 1) / 2) @ self.p["out"] + self.p["bias"]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Languages and scores; empty texts give ``und`` and 0."""
        raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.array([len(b) for b in raw], np.int64)
        counts = -(-sizes // WINDOW)
        logits = self.windows(np.frombuffer(b"".join(b + bytes(-len(b) % WINDOW) for b in raw), np.uint8))
        names, scores, at = [], [], 0
        for size, n in zip(sizes.tolist(), counts.tolist(), strict=True):
            if not n:
                names.append(NONE)
                scores.append(0.0)
                continue
            weight = np.full(n, float(WINDOW))
            weight[-1] = size - WINDOW * (n - 1)
            z = weight @ logits[at : at + n].astype(float) / weight.sum()
            at += n
            z = np.exp(z - z.max())
            best = int(z.argmax())
            names.append(self.languages[best])
            scores.append(float(z[best] / z.sum()))
        return names, scores


def _chunks(texts: Iterator[tuple[list[bytes], list[int]]], chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The windows of texts and their classes, by arrays of at most ``chunk`` windows."""
    held: list[tuple[bytes, int]] = []
    for data, classes in texts:
        for b, y in zip(data, classes, strict=True):
            for at in range(0, len(b), WINDOW):
                held.append((b[at : at + WINDOW], y))
                if len(held) == chunk:
                    yield _windows([w for w, _ in held]), np.array([c for _, c in held])
                    held = []
    if held:
        yield _windows([w for w, _ in held]), np.array([c for _, c in held])


def _windows(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in parts), np.uint8).reshape(-1, WINDOW)


class Familiar:
    """Whether a text is written like those that were learned: the mean logarithm of its letters' chances.

    The network can only choose among its languages. This one has the chance of a letter after
    two others over all languages together, learned from four in five of the labelled texts as wholes. All
    windows of the fifth, which it hasn't seen, and the same with their letters shuffled, give the least score
    for each size of text: a quarter of the way down from what 99 % of texts reach to gibberish.
    """

    KINDS = 155  # anything else, a to z, and bytes of other letters
    SIZES = tuple(2**i for i in range(3, 9))
    STEP = 1 / 4096  # scores are counted by this unit

    def __init__(self, at: np.ndarray, value: np.ndarray):
        """``value`` has the counts of the threes of kinds in a row whose places are ``at``; the rest weren't met.

        The table is made by the threes of one first kind after another, as the driver's memory is small.
        """
        n = self.KINDS
        order = np.argsort(at, kind="stable")
        at, value, self.total = at[order], value[order], int(value.sum())
        two = np.bincount(at % (n * n), value, n * n).reshape(n, n)
        p = (two.sum(0) + 1) / (two.sum() + n)
        p = (two + p) / (two.sum(1, keepdims=True) + 1)
        self.table = np.empty(n**3, np.float16)
        ends = np.searchsorted(at, np.arange(n + 1) * n * n)
        for first in range(n):
            own = slice(ends[first], ends[first + 1])
            three = np.bincount(at[own] - first * n * n, value[own], n * n).reshape(n, n)
            self.table[first * n * n : (first + 1) * n * n] = np.log((three + p) / (three.sum(1, keepdims=True) + 1)).ravel()
        self.least = np.full(len(self.SIZES), -np.inf)

    @classmethod
    def count(cls, texts: list[bytes], three: np.ndarray) -> None:
        """Adds the threes of whole texts to ``three``."""
        k = np.concatenate([[0], cls._kinds(b"\0\0".join(texts)), [0]]).astype(np.int32)  # no three of letters spans two texts
        for at in range(0, len(k) - 2, 1 << 20):
            np.add.at(three, cls._threes(k[at : at + (1 << 20) + 2]), 1)

    def bars(self, texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
        """For each size (its number) and kind (0: as written, 1: shuffled) the scores, in units, of the windows that have it."""
        parts = [b[at : at + WINDOW] for b in texts for at in range(0, len(b), WINDOW)]
        for start in range(0, len(parts), 1024):
            own = parts[start : start + 1024]
            kinds, sizes = _KINDS[_windows(own)], np.array([len(w) for w in own])
            mixed = np.stack([self._mixed(k, np.random.default_rng(zlib.crc32(w))) for k, w in zip(kinds, own, strict=True)])
            for wild, x in enumerate((kinds, mixed)):
                x = np.concatenate([np.zeros((len(x), 1), np.int32), x, np.zeros((len(x), 1), np.int32)], 1)
                some = (x[:, :-2] > 0).astype(np.int8) + (x[:, 1:-1] > 0) + (x[:, 2:] > 0) >= 2
                found = np.where(some, self.table[(x[:, :-2] * self.KINDS + x[:, 1:-1]) * self.KINDS + x[:, 2:]].astype(float), 0).cumsum(1)
                n = some.cumsum(1)
                for j, size in enumerate(self.SIZES):
                    a, b = x[:, size - 1], x[:, size]  # the last three of a prefix ends in what is no letter
                    last = (a > 0) & (b > 0)
                    total = found[:, size - 2] + np.where(last, self.table[(a * self.KINDS + b) * self.KINDS].astype(float), 0)
                    m = n[:, size - 2] + last
                    fits = (sizes >= size) & (m > 0)
                    yield j, wild, np.floor(total[fits] / m[fits] / self.STEP).astype(np.int64)

    def settle(self, bars: dict[tuple[int, int], list[tuple[int, int]]]) -> Familiar:
        """Sets the least scores from the counts (unit, count) of ``bars`` over all texts."""
        for j in range(len(self.SIZES)):
            if (j, 0) in bars and (j, 1) in bars:
                low, gibberish = (self._reached(bars[j, wild], part) for wild, part in ((0, 0.01), (1, 0.5)))
                self.least[j] = low - (low - gibberish) / 4 if gibberish < low else -np.inf
        return self

    def _reached(self, counted: list[tuple[int, int]], part: float) -> float:
        units, counts = np.array(sorted(counted)).T
        return float(units[np.searchsorted(counts.cumsum(), part * counts.sum())] * self.STEP)

    @staticmethod
    def _kinds(data: bytes) -> np.ndarray:
        return _KINDS[np.frombuffer(data, np.uint8)]

    @staticmethod
    def _mixed(kinds: np.ndarray, r: np.random.Generator) -> np.ndarray:
        out = kinds.copy()
        at = np.flatnonzero(out)
        out[at] = r.permutation(out[at])
        return out

    def _places(self, k: np.ndarray) -> np.ndarray:
        """Places in the table of each three in a row of which two at least are letters."""
        return self._threes(np.concatenate([[0], k, [0]]).astype(np.int32))

    @classmethod
    def _threes(cls, k: np.ndarray) -> np.ndarray:
        a, b, c = k[:-2], k[1:-1], k[2:]
        return ((a * cls.KINDS + b) * cls.KINDS + c)[(a > 0).astype(np.int8) + (b > 0) + (c > 0) >= 2]

    def _score(self, kinds: np.ndarray) -> tuple[float, int]:
        total, n = 0.0, 0
        for at in range(0, len(kinds), 1 << 20):
            found = self.table[self._places(kinds[at : at + (1 << 20)])]
            total, n = total + float(found.sum(dtype=float)), n + len(found)
        return (total / n if n else 0.0), n

    def knows(self, text: str) -> bool:
        """True if nothing speaks against it, as with texts that are too short to tell."""
        data = self._kinds(text.lower().encode("utf-8", "surrogatepass"))
        place = min(len(data), self.SIZES[-1]).bit_length() - self.SIZES[0].bit_length()
        if place < 0:
            return True
        score, n = self._score(data)
        return not n or bool(score >= self.least[place])


_KINDS = np.array([0] * 97 + list(range(1, 27)) + [0] * 5 + list(range(27, 155)), np.uint8)


def train(docs: DataFrame, may_learn: Column, sample: int = 6000, crops: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """The network, trained on all windows of all labelled texts; ``crops`` windows of each document of the sample give its first weights."""
    return learn(docs, may_learn, sample, crops, id_col, text_col, lang_col, familiar=False)[0]


def learn(docs: DataFrame, may_learn: Column, sample: int = 6000, crops: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", familiar: bool = True) -> tuple[Network | None, Familiar | None]:
    """The network, and what tells texts that are like all the labelled ones from others."""
    spot = F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.greatest(F.length(text_col) - WINDOW, F.lit(0)) + 1)
    again = F.pmod(F.xxhash64(F.lit(4), F.col(id_col)), F.greatest(F.length(text_col) - WINDOW, F.lit(0)) + 1)
    labelled = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    lot = F.xxhash64(F.lit(1), F.col(id_col))
    sums = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text_col))).alias("size")).orderBy("lang").collect()
    if not sums:
        return None, None
    languages = sorted(r["lang"] for r in sums)
    number = {x: i for i, x in enumerate(languages)}
    quota = max(1, sample // len(languages))
    # Only hashes that a language's part of the sample can need are sorted, so tasks send their share and no more.
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(2**63 - 1, int(min(1.0, (3 * quota + 60) / r["n"]) * 2**64) - 2**63)) for r in sums], "lang string, most long")
    cut = [F.substring(F.col(text_col), (s + 1).cast("int"), F.lit(WINDOW)).alias(f"crop{i}") for i, s in enumerate((spot, again)[:crops])]
    own = labelled.select(lot.alias("lot"), F.col(lang_col).alias("lang"), *cut).join(F.broadcast(shares), "lang").where("lot <= most")
    first = own.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("lot", "crop0"))).where(F.col("place") <= quota)
    rows = first.orderBy("lang", "place").select("lang", *(f"crop{k}" for k in range(crops))).collect()
    crop = [(r[f"crop{k}"].lower().encode("utf-8", "ignore")[:WINDOW], number[r["lang"]]) for k in range(crops) for r in rows]
    network = Network(languages).fit([b for b, _ in crop], [y for _, y in crop])
    del rows, crop
    trim()
    size = {r["lang"]: r["size"] for r in sums}
    weight = 1 / np.sqrt(np.array([-(-size[x] // WINDOW) for x in languages]) + 1)
    modest_batches(docs.sparkSession, 500)
    part = F.pmod(F.xxhash64(F.lit(5), F.col(id_col)), F.lit(5)).cast("int").alias("part")
    texts = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), part)
    found = _summed(texts, lambda batches: _trained(batches, network, number, weight, familiar))
    moved = np.zeros(len(network.flat()))
    (at, value), (threes, counts) = (found.loc[found["kind"] == kind, ["at", "value"]].to_numpy().T for kind in ("weights", "threes"))
    moved[at] = value
    network.set(moved / found.loc[found["kind"] == "windows", "value"].sum() * UNIT)
    if not familiar:
        return network, None
    known = Familiar(threes, counts)
    del found, at, value, threes, counts
    trim()
    bars: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for kind, unit, count in _summed(texts.where("part = 4"), lambda batches: _scored(batches, known)).itertuples(index=False):
        bars.setdefault(tuple(map(int, kind.split("-"))), []).append((unit, count))
    trim()
    return network, known.settle(bars)


#: Weights are summed as whole numbers of this unit, so their sum doesn't depend on the order of tasks.
UNIT = 2.0**-24


def _summed(texts: DataFrame, run) -> pd.DataFrame:
    """The sums over all tasks of what ``run`` counts: kind, at, value."""
    return texts.mapInArrow(run, "kind string, at long, value long").groupBy("kind", "at").agg(F.sum("value").alias("value")).toPandas()


def _counts(kind: str, at: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(value, pa.int64())], ["kind", "at", "value"])


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [t.lower().encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]


def _trained(batches: Iterator[pa.RecordBatch], network: Network, number: dict[str, int], weight: np.ndarray, familiar: bool) -> Iterator[pa.RecordBatch]:
    """A task's weights, times its windows, and, if asked for, the threes of letters of the texts that ``Familiar`` learns from."""
    three = np.zeros(Familiar.KINDS**3, np.int64) if familiar else None

    def texts() -> Iterator[tuple[list[bytes], list[int]]]:
        for batch in batches:
            data = _bytes(batch)
            if three is not None:
                Familiar.count([b for b, p in zip(data, batch.column(2).to_pylist(), strict=True) if p < 4], three)
            yield data, [number[x] for x in batch.column(1).to_pylist()]

    n = network.fit_all(texts(), weight)
    if n:
        flat = np.rint(network.flat().astype(float) / UNIT).astype(np.int64) * n
        yield _counts("weights", np.arange(len(flat)), flat)
        yield _counts("windows", np.array([0]), np.array([n]))
    if three is not None:
        at = np.flatnonzero(three)
        yield _counts("threes", at, three[at])
    trim()


def _scored(batches: Iterator[pa.RecordBatch], familiar: Familiar) -> Iterator[pa.RecordBatch]:
    """How many windows of a task have each score, by ``size-shuffled``."""
    bars: dict[tuple[int, int], Counter] = {}
    for batch in batches:
        for j, wild, units in familiar.bars(_bytes(batch)):
            unit, n = np.unique(units, return_counts=True)
            own = bars.setdefault((j, wild), Counter())
            for u, c in zip(unit.tolist(), n.tolist(), strict=True):
                own[u] += c
    for (j, wild), own in bars.items():
        yield _counts(f"{j}-{wild}", np.array(list(own)), np.array(list(own.values())))
    trim()


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", familiar: Familiar | None = None) -> DataFrame:
    """All columns of ``docs`` but ``lang_pred`` and ``score``, which are set anew; texts that ``familiar`` doesn't know are ``und``."""
    kept = docs.drop("lang_pred", "score")
    if network is None:
        return kept.withColumns({"lang_pred": F.lit(NONE), "score": F.lit(0.0)})
    modest_batches(docs.sparkSession, 500)
    names = kept.columns
    seen = "seen" + "_" * max(map(len, names))  # no column has this name
    shown = kept.select("*", F.when(F.col(text_col).rlike(r"\p{L}"), whole(text_col)).otherwise("").alias(seen))
    schema = kept.schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found, scores = network.predict(texts)
            if familiar is not None:
                known = [familiar.knows(t) for t in texts]
                found, scores = [x if k else NONE for x, k in zip(found, known, strict=True)], [x if k else 0.0 for x, k in zip(scores, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])
        trim()

    return shown.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether the CRC-32 of the id, as text, leaves this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == part
