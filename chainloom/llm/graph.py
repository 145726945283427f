"""Links and components, shared by the near-duplicate joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row (and column) reaches over links within one boolean matrix.

    ``right`` is left out where rows and columns are the same things, linked symmetrically.
    """
    top = np.iinfo(np.int64).max
    a, b = left.copy(), (left if right is None else right).copy()
    while True:
        b2 = np.minimum(b, np.where(linked, a[:, None], top).min(0, initial=top))
        a2 = np.minimum(a, np.where(linked, b2[None], top).min(1, initial=top))
        if right is None:
            a2 = b2 = np.minimum(a2, b2)
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def _met(edges: DataFrame, low: DataFrame, salts: int = 8) -> DataFrame:
    """``edges`` with the row of ``low`` of their node; a node of very many edges is dealt over salts."""
    salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(salted, ["u", "salt"]).drop("salt")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that each node of an edge reaches; roots have no row of their own.

    Alternating large-star and small-star steps: in turn, larger and smaller neighbours of a
    node are hung on its smallest one, until nothing changes. A step sends each edge once;
    its minimum is aggregated before the shuffle. Each round is a checkpoint in the shared folder.
    """
    shared_dir(edges.sparkSession)
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct().checkpoint()
    size, before = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))), None
    for _ in range(rounds):
        state = tuple(now.agg(size.alias("s")).first()["s"])
        if not state[0] or state == before:
            break
        before = state
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        now = _met(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        met = _met(now, low)
        now = met.select("u", F.col("m").alias("v")).union(met.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def least_values(comps: DataFrame, values: DataFrame) -> DataFrame:
    """node, least: the smallest ``value`` in the component of each node of ``comps`` (node, root), its roots included.

    ``values`` has node and value. A component of very many nodes is dealt over salts.
    """
    nodes = comps.select("node", "root").union(comps.select("root", "root").distinct())
    least = nodes.join(values, "node").groupBy("root").agg(F.min("value").alias("m"))
    return _met(nodes.select(F.col("root").alias("u"), F.col("node").alias("v")), least.withColumnRenamed("root", "u")).select(F.col("v").alias("node"), F.col("m").alias("least"))
