"""Strongly connected components of any size, and an order of work in which each node has a level.

A round first trims nodes without a way in or without a way out, which are components of
their own. Then it contracts: a node with one edge in and one out, whose hash is below those of
such neighbours, gives way to an edge across it, so that chains and rings of any length shrink by
a share each round. It belongs to its neighbours' component if that is one for both, which is
settled on the way back. What remains is coloured: each node takes the least node that
reaches it, along edges until nothing changes, and the nodes of a colour from which its first
node can be reached are a component. Nothing is collected; every round's tables are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Rounds of trimming and contraction end when fewer than one in so many edges went.
SHARE = 10


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (src, dst): the least node with which it lies on a cycle, else itself."""
    given = cut(edges.select("src", "dst").distinct())
    left = cut(given.where("src <> dst"))
    every = given.select(F.col("src").alias("node")).union(given.select("dst")).distinct()
    size, contracted, known, n = left.count(), [], [], 0
    while size:
        left, gone = _contracted(left, n)
        contracted.append(gone)
        n += 1
        before, size = size, left.count()
        if size * SHARE > before * (SHARE - 1):
            left, found = _coloured(left)
            known.append(found)
            size = left.count()
    settled = None
    for found in known:
        settled = found if settled is None else settled.unionByName(found)
    settled = cut(settled) if settled is not None else cut(every.limit(0).select("node", F.col("node").alias("component")))
    for gone in reversed(contracted):
        # Between two nodes of one component: it is theirs. A node that was trimmed or never met is its own.
        a, b = (settled.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component")) for c in ("a", "b"))
        own = lambda c: F.coalesce(f"{c}_component", c)
        met = gone.join(a, "a", "left").join(b, "b", "left").where(own("a") == own("b")).select("node", own("a").alias("component"))
        settled = cut(settled.unionByName(met).unionByName(met.select(F.col("component").alias("node"), "component").distinct()).distinct())
    # Contracted nodes may be less than those that stayed: the least member names a component.
    least = settled.groupBy("component").agg(F.min("node").alias("least"))
    named = settled.join(least, "component").select("node", F.least("least", "component").alias("component"))
    return cut(every.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def _contracted(left: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Edges without the nodes that a round takes out, and of the contracted ones (node, a, b) with their neighbours."""
    ins = left.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ins"), F.min("src").alias("a"))
    outs = left.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outs"), F.min("dst").alias("b"))
    nodes = cut(ins.join(outs, "node"))  # others have no way in or none out
    inner = nodes.select("node")
    kept = left.join(inner.select(F.col("node").alias("src")), "src", "left_semi").join(inner.select(F.col("node").alias("dst")), "dst", "left_semi")
    single = nodes.where("ins = 1 and outs = 1").join(inner.select(F.col("node").alias("a")), "a", "left_semi").join(inner.select(F.col("node").alias("b")), "b", "left_semi").select("node", "a", "b", F.xxhash64("node", F.lit(turn)).alias("h"))
    near = single.select(F.explode(F.array("a", "b")).alias("node"), F.col("h").alias("other"), F.col("node").alias("n")).groupBy("node").agg(F.min(F.struct("other", "n")).alias("low"))
    chosen = cut(single.join(near, "node", "left").where("low is null or h < low.other or h = low.other and node < low.n").select("node", "a", "b"))
    gone = chosen.select("node")
    rest = kept.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
    across = chosen.select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src <> dst")
    return cut(rest.select("src", "dst").union(across).distinct()), chosen


def _coloured(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between nodes that are still open, and the components (node, component) that one colouring settles."""
    colours = cut(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("colour", F.col("node")))
    new = colours
    while True:
        met = new.join(left, new.node == left.src).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("other"))
        new = cut(met.join(colours, "node").where("other < colour").select("node", F.col("other").alias("colour")))
        if new.isEmpty():
            break
        colours = cut(colours.join(new.withColumnRenamed("colour", "less"), "node", "left").select("node", F.coalesce("less", "colour").alias("colour")))
    of = lambda end: colours.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))
    back = cut(left.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour").select("src", "dst"))
    found = new = cut(colours.where("node = colour").select("node", F.col("colour").alias("component")))
    while not new.isEmpty():
        met = new.join(back, new.node == back.dst).select(F.col("src").alias("node"), "component").distinct()
        new = cut(met.join(found, ["node", "component"], "left_anti"))
        found = cut(found.unionByName(new))
    gone = found.select("node")
    open_ = left.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
    return cut(open_.select("src", "dst")), found


def levels(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(node, component, level): 0 for what leads to nothing but its own cycle, else one more than the highest that it leads to."""
    of = cut(components if components is not None else strong_components(edges))
    end = lambda c: of.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    above = cut(edges.join(end("src"), "src").join(end("dst"), "dst").where("src_c <> dst_c").select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).distinct())
    known = cut(of.select("component").distinct().withColumn("level", F.lit(0)))
    new = known
    while True:
        met = new.join(above, new.component == above.dst).groupBy(F.col("src").alias("component")).agg((F.max("level") + 1).alias("higher"))
        new = cut(met.join(known, "component").where("higher > level").select("component", F.col("higher").alias("level")))
        if new.isEmpty():
            break
        known = cut(known.join(new.withColumnRenamed("level", "higher"), "component", "left").select("component", F.coalesce("higher", "level").alias("level")))
    return of.join(known, "component").select("node", "component", "level")
