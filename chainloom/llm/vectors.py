"""Embedding near-duplicates by an epsilon grid order join.

Vectors of one label and length are scaled to length one, where a cosine of c is a distance
of sqrt(2 - 2 c), the epsilon. They are sorted by their cells, of that width, on leading
principal dimensions; cut into blocks of consecutive rows within one cell of the first
three; and a block meets those of the 27 cells around it whose boxes lie no further apart
than epsilon. Two blocks that meet are joined recursively: each
interval of the sequence is halved, and pairs of intervals whose boxes lie too far apart are
skipped. What is left is compared by cosine in double precision.

The dimensions come from a sample of ``sample`` vectors. They decide only what is skipped
early: a projection never lengthens a distance, so any sample gives the same result.

Links with nothing: vectors that are null, empty, zero, or hold a null or non-finite number,
and those whose label or id is null; a null id also has a null component and isn't kept.
Equal vectors of a label are joined once, under a number of their own, with their number of
rows as weight. Repeated rows with one id count as vectors of their own, whether they are
equal or not. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, partitions, stored
from .graph import components, least_values, roots

AXES, BLOCK, LEAF = 6, 2048, 64
#: Blocks end where the cell on so many leading dimensions does.
NEAR = 3
#: Bytes of vectors in a block.
BLOCK_BYTES = 1 << 20
SLACK = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal(sample: np.ndarray, axes: int = AXES) -> np.ndarray:
    """Orthonormal leading directions, one per column."""
    x = unit(sample)
    return np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:axes].T


def apart(a: tuple, b: tuple, epsilon: float) -> bool:
    """Whether two boxes (low, high) lie provably further apart than epsilon."""
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return bool((gap * gap).sum() > epsilon * epsilon + SLACK)


def box(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return grid.min(0), grid.max(0)


def join_intervals(x: np.ndarray, gx: np.ndarray, y: np.ndarray, gy: np.ndarray, cosine: float, same: bool) -> np.ndarray:
    """The boolean matrix of links between two sequences in grid order; ``same``: they are one, and no row meets itself."""
    epsilon, out = float(np.sqrt(2 - 2 * cosine)), np.zeros((len(x), len(y)), bool)

    def meet(a0: int, a1: int, b0: int, b1: int) -> None:
        if same and b1 <= a0 or apart(box(gx[a0:a1]), box(gy[b0:b1]), epsilon):
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            out[a0:a1, b0:b1] = x[a0:a1] @ y[b0:b1].T >= cosine
        elif a1 - a0 >= b1 - b0:
            mid = (a0 + a1) // 2
            meet(a0, mid, b0, b1)
            meet(mid, a1, b0, b1)
        else:
            mid = (b0 + b1) // 2
            meet(a0, a1, b0, mid)
            meet(a0, a1, mid, b1)

    if len(x) and len(y):
        meet(0, len(x), 0, len(y))
    if same:
        out |= out.T
        np.fill_diagonal(out, False)
    return out


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, sample: int = 4096, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    modest_batches(spark, 256)
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    marked = given.withColumn("sound", F.coalesce(sound, F.lit(False)))
    distinct = marked.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    distinct = stored(distinct.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    axes: dict[int, np.ndarray] = {}
    # Only hashes that a sample of this size can need are sorted, so tasks send their share and no more.
    lot, share = F.xxhash64("embedding"), min(1.0, 3 * sample / max(1, distinct.count()))
    seen = distinct.where(lot <= min(2**63 - 1, int(share * 2**64) - 2**63)).select("embedding").orderBy(lot).limit(sample).collect()
    for size in {len(r[0]) for r in seen}:
        own = [r[0] for r in seen if len(r[0]) == size]
        if len(own) > 1:
            axes[size] = principal(np.array(own))
    epsilon = float(np.sqrt(2 - 2 * cosine))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            grid = []
            for row in rows:
                turn = axes.get(len(row))
                g = np.zeros(AXES)
                u = unit(np.array([row]))[0]
                v = u[:AXES] if turn is None else u @ turn
                g[: len(v)] = v
                grid.append(g)
            sizes = pa.array([len(r) for r in rows], pa.int32())
            cells = [np.floor(g / epsilon).astype(np.int32).tolist() for g in grid]
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, batch.column(2), batch.column(3), pa.array(cells, pa.list_(pa.int32())), pa.array([np.array(r).tobytes() for r in rows], pa.binary()), pa.array([g.tobytes() for g in grid], pa.binary())], ["label", "dims", "rep", "copies", "cell", "vector", "grid"])

    label = distinct.schema["label"].dataType.simpleString()
    placed = distinct.select("label", "embedding", "rep", "copies").mapInArrow(place, f"label {label}, dims int, rep long, copies long, cell array<int>, vector binary, grid binary")
    order = ["label", "dims", "cell", "rep"]
    ranged = placed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []

        def made(rows: list[dict]) -> pa.RecordBatch:
            nonlocal number
            grid = np.stack([np.frombuffer(r["grid"]) for r in rows])
            low, high = box(grid)
            number += 1
            return pa.RecordBatch.from_pylist([{"block": number, "label": rows[0]["label"], "dims": rows[0]["dims"], "low": low.tolist(), "high": high.tolist(), "cell": rows[0]["cell"][:NEAR], "reps": [r["rep"] for r in rows], "copies": [r["copies"] for r in rows], "vectors": b"".join(r["vector"] for r in rows), "grid": grid.tobytes()}], schema=blocks_arrow)

        kind = None
        for batch in batches:
            if kind is None:
                kind = batch.schema.field("label").type
                blocks_arrow = pa.schema([("block", pa.int64()), ("label", kind), ("dims", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("cell", pa.list_(pa.int32())), ("reps", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("vectors", pa.binary()), ("grid", pa.binary())])
            for row in batch.to_pylist():
                if held and (len(held) >= max(LEAF, min(block, BLOCK_BYTES // (8 * row["dims"]))) or (held[-1]["label"], held[-1]["dims"], held[-1]["cell"][:NEAR]) != (row["label"], row["dims"], row["cell"][:NEAR])):
                    yield made(held)
                    held = []
                held.append(row)
        if held:
            yield made(held)

    blocks = stored(ranged.mapInArrow(cut, f"block long, label {label}, dims int, low array<double>, high array<double>, cell array<int>, reps array<long>, copies array<long>, vectors binary, grid binary"), "blocks")
    # A block lies in one cell of the first dimensions, so it meets those of the cells around only.
    steps = F.array(*(F.array(*(F.lit(x - 1) for x in near)) for near in np.ndindex(*[3] * NEAR)))
    outline = blocks.select("block", "label", "dims", "low", "high", "cell")
    left = outline.select("label", "dims", F.col("block").alias("a"), F.col("low").alias("al"), F.col("high").alias("ah"), "cell", F.explode(steps).alias("near")).withColumn("cell", F.zip_with("cell", "near", lambda x, y: x + y)).drop("near")
    right = outline.select("label", "dims", F.col("block").alias("b"), F.col("low").alias("bl"), F.col("high").alias("bh"), "cell")
    gap = F.aggregate(F.sequence(F.lit(0), F.lit(AXES - 1)), F.lit(0.0), lambda s, i: s + F.pow(F.greatest(F.lit(0.0), F.col("al")[i] - F.col("bh")[i], F.col("bl")[i] - F.col("ah")[i]), F.lit(2.0)))
    pairs = left.join(right, ["label", "dims", "cell"]).where("a <= b").where(gap <= epsilon * epsilon + SLACK).select("a", "b")
    # A block goes to its own task once, and to those of the blocks before it that it meets.
    sent = blocks.select(F.col("block").alias("a"), F.lit(0).alias("turn"), "block").unionByName(pairs.where("a < b").select("a", F.lit(1).alias("turn"), F.col("b").alias("block")))
    met = sent.join(blocks.select("block", "dims", "reps", "copies", "vectors", "grid"), "block").repartition(partitions(spark), "a").sortWithinPartitions("a", "turn", "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                now = unit(np.frombuffer(r["vectors"]).reshape(-1, r["dims"])), np.frombuffer(r["grid"]).reshape(-1, AXES), np.array(r["reps"], np.int64), np.array(r["copies"], np.int64)
                if r["turn"] == 0:
                    own = now
                (x, gx, ra, ca), (y, gy, rb, cb), same = own, now, r["turn"] == 0
                linked = join_intervals(x, gx, y, gy, cosine, same)
                found = [(ra, linked @ cb, roots(linked, ra, None if same else rb)[0])]
                if not same:
                    found.append((rb, ca @ linked, roots(linked, ra, rb)[1]))
                for ids, links, root in found:
                    hit = links > 0
                    if hit.any():
                        yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(root[hit])], ["rep", "links", "root"])

    found = stored(met.mapInArrow(compare, "rep long, links long, root long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    first = least_values(comps, distinct.select(F.col("rep").alias("node"), F.col("low").alias("value")))
    per_rep = distinct.join(links, "rep", "left").join(first.withColumnRenamed("node", "rep"), "rep", "left").select("label", "embedding", "low", "copies", "links", "least")
    m, d = marked.alias("m"), per_rep.withColumnRenamed("label", "l2").withColumnRenamed("embedding", "e2").alias("d")
    out = m.join(d, F.col("m.sound") & (F.col("m.label") == F.col("d.l2")) & (F.col("m.embedding") == F.col("d.e2")), "left")
    component = F.coalesce("least", "low", "vec_id")
    return out.select("vec_id", F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def oracle(cosine: float = 0.98) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.k AS a, b.k AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.k <> b.k WHERE list_cosine_similarity(a.e, b.e) >= {cosine}),
reach AS (SELECT k AS a, k AS r FROM v UNION SELECT p.a, reach.r FROM pairs p JOIN reach ON p.b = reach.a),
comp AS (SELECT a, min(r) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, top.vec_id AS component_id, coalesce(v.vec_id = top.vec_id, false) AS kept
FROM v LEFT JOIN n ON v.k = n.a LEFT JOIN comp ON v.k = comp.a LEFT JOIN v top ON top.k = comp.c"""
