"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source gets a target of words. Its documents lie in shards by a hash of their row; in
a shard they follow each other in seeded order, ``epochs`` times over, and are cut into
blocks of equal length. Apportionments by highest quotients, of the whole mix among sources,
of a source's blocks among groups of shards and of a group's among its shards, give each
shard an integer quota. Of a shard's blocks that many are taken, as evenly spaced as whole
numbers allow, from a seeded place on (what is left behind the last full block is taken if
all blocks are); so what the mix takes of the first x words of a shard
is a formula, and a document's part is its value at the document's end less that at its
start, at most ``epochs`` times its size. Nothing is expanded by block or sent to all tasks.

A null or empty text has size 0 and gives nothing; a very long one spans many blocks. A null
source is a source of its own, after all others. Equal rows take different places in a
shard's order, so repeated rows may differ in what is taken of them; which of them gets
which part is not fixed, but the parts are. Other columns aren't read. Empty input gives no
rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, whole

WEIGHTS = (3, 1, 2)


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words for each source: ``share`` of all words by weight, no source above ``most`` times
    its size; what is above goes to the others by weight, until none is above."""
    left, open_, out = share * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def sainte_lague(votes: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2 k + 1); equal quotients go to the earlier party.

    The quotients above a bar count most of the seats at once; the few left go one by one.
    """
    v = np.asarray(votes, float)
    cap = np.full(len(v), seats, np.int64) if caps is None else np.asarray(caps, np.int64)
    seats = min(seats, int(cap[v > 0].sum()))
    if seats <= 0:
        return [0] * len(v)
    count = lambda bar: np.minimum(np.ceil(np.maximum((v / bar - 1) / 2, 0)).astype(np.int64), cap)  # noqa: E731  quotients above it
    low, high = v[v > 0].min() / (2 * seats + 3), float(v.max())
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if count(mid).sum() > seats else (low, mid)
    got = count(high)
    while (short := seats - int(got.sum())) > 0:
        quotient = np.where(got < cap, v / (2 * got + 1), -1.0)
        best = np.argsort(-quotient, kind="stable")[: max(1, min(short, int((quotient == quotient.max()).sum())))]
        got[best] += 1
    return got.tolist()


def _seeded(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def source_plan(words: list[tuple[str | None, int]], weights=WEIGHTS, share: float = 1.5, epochs: int = 2, block: int = 1000) -> list[tuple]:
    """(source, its number, words, target, quota of blocks, words of a block), sources by code point and null last.

    Words are apportioned, and each source's are cut into blocks of its own length: ``block``,
    or less for a source whose target is not many of them.
    """
    names = sorted(words, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    sizes = [n for _, n in names]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, epochs)
    own = sainte_lague(want, round(sum(want)), [epochs * n for n in sizes])
    steps = [max(1, min(block, int(t) // 200)) if t else block for t in want]
    quotas = [min(round(w / step), math.ceil(epochs * n / step)) for w, step, n in zip(own, steps, sizes, strict=True)]
    return [(s, i, n, t, q, step) for i, ((s, n), t, q, step) in enumerate(zip(names, want, quotas, steps, strict=True))]


def _taken(x: Column, step: Column, full: Column, quota: Column, begin: Column) -> Column:
    """How many of the first x words lie in taken blocks. Of the ``full`` blocks, block j is taken
    if the count up to j + 1 exceeds that up to j; a shorter last one only if all others are."""
    some, among = F.least(quota, full), F.greatest(full, F.lit(1))
    count = lambda j: F.call_function("div", j * some + begin, among)
    block = F.call_function("div", x, step)
    within = F.when(block < full, (count(block + 1) - count(block)) * (x - block * step)).when(quota > full, x - full * step).otherwise(0)
    return step * count(F.least(block, full)) + within


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: int = 2, seed: int = 7, block: int = 1000, shard_words: int = 500_000, group: int = 4096) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies, print.

    ``taken`` counts words, ``copies`` how often the document's first word is taken. A
    source's blocks are a two-hundredth of its target, ``block`` words at most. The driver
    sees one sum per source; a source's shards, of ``shard_words`` words on average, are
    planned in groups of ``group``, so a task plans ``group`` shards or the groups of a
    source, and no window holds more than a shard, whatever a source's part of the rows.
    """
    spark = docs.sparkSession
    sized = stored(docs.select("doc_id", "source", F.regexp_count(whole("text"), F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("print")), "sizes")
    sums = [(r["source"], r["words"]) for r in sized.groupBy("source").agg(F.sum("size").alias("words")).collect()]
    rows = [(s, i, n, t, q, b, max(1, -(-n // shard_words))) for s, i, n, t, q, b in source_plan(sums, weights, share, epochs, block)]
    sources = spark.createDataFrame(rows, "of string, src long, source_size long, target double, quota long, step long, shards long")
    known = F.col("source").eqNullSafe(F.col("of"))
    dealt = sized.join(sources.drop("quota"), known).withColumn("shard", F.pmod(_seeded(seed, F.col("doc_id"), F.col("print")), F.col("shards"))).drop("of", "shards")
    shards = dealt.groupBy("src", "shard").agg(F.sum("size").alias("words")).withColumn("part", F.floor(F.col("shard") / group)).join(sources.select("src", "step"), "src")
    shards = stored(shards.withColumn("blocks", F.ceil(epochs * F.col("words") / F.col("step")).cast("long")), "shards")

    def quotas(cells):
        """Gives the seats of a source, or of a group of its shards, to its parts by their words."""
        cells = cells.sort_values("part", ignore_index=True)
        cells["quota"] = sainte_lague(cells["words"].tolist(), int(cells["seats"].iloc[0]), cells["blocks"].tolist())
        return cells[["src", "of", "part", "quota"]]

    plan = "src long, of long, part long, quota long"
    groups = shards.groupBy("src", "part").agg(F.sum("words").alias("words"), F.sum("blocks").alias("blocks")).join(sources.select("src", F.col("quota").alias("seats")), "src")
    groups = groups.select("src", F.lit(0).cast("long").alias("of"), "part", "words", "blocks", "seats").groupBy("src").applyInPandas(quotas, plan)
    seats = groups.select("src", F.col("part").alias("of"), F.col("quota").alias("seats"))
    cells = shards.select("src", F.col("part").alias("of"), F.col("shard").alias("part"), "words", "blocks").join(seats, ["src", "of"]).groupBy("src", "of").applyInPandas(quotas, plan)
    quota = shards.drop("part", "step").join(cells.select("src", F.col("part").alias("shard"), "quota"), ["src", "shard"])

    order = Window.partitionBy("src", "shard").orderBy(_seeded(seed + 2, F.col("doc_id"), F.col("print")), "doc_id", "print", "size")
    placed = dealt.withColumn("stop", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(quota, ["src", "shard"])
    step, seats = F.col("step"), F.col("quota")
    full = F.call_function("div", epochs * F.col("words"), step)
    begin = F.pmod(_seeded(seed + 1, F.col("src"), F.col("shard")), F.greatest(full, F.lit(1)))  # a seeded place to begin at
    taken, copies = F.lit(0).cast("long"), F.lit(0).cast("long")
    for epoch in range(epochs):
        start = F.col("stop") - F.col("size") + epoch * F.col("words")
        at = lambda x: _taken(x, step, full, seats, begin)
        taken = taken + at(start + F.col("size")) - at(start)
        copies = copies + F.when(F.col("size") > 0, at(start + 1) - at(start)).otherwise(0)
    return placed.select("doc_id", "source", "size", "source_size", "target", "print", taken.cast("long").alias("taken"), copies.cast("long").alias("copies"))
