"""Forward propagation: seeds, effects of each kind of step, order of work, and what is reached by which step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Fixed names of the methods that deserialization starts by itself, with their descriptors.
MAGIC = (("readObject", "(Ljava/io/ObjectInputStream;)V"), ("readResolve", "()Ljava/lang/Object;"), ("readExternal", "(Ljava/io/ObjectInput;)V"), ("readObjectNoData", "()V"), ("validateObject", "()V"))


def magic_entries(methods: DataFrame, serializable: DataFrame, magic=MAGIC) -> DataFrame:
    """(owner, name): methods of serialisable classes that deserialization calls."""
    spark = methods.sparkSession
    known = F.broadcast(spark.createDataFrame(list(magic), "name string, descriptor string"))
    return methods.join(known, ["name", "descriptor"], "left_semi").join(serializable.select(F.col("name").alias("owner")), "owner", "left_semi").select("owner", "name").distinct()


def effects(args: DataFrame, writes: DataFrame, reads: DataFrame, returns: DataFrame, models: DataFrame) -> DataFrame:
    """(src, dst, kind): one table of all steps that a value may take: into a parameter, a field, out of
    a field, out of a call, and through a modelled call."""
    out = None
    for rows, kind in ((args, "argument"), (writes, "write"), (reads, "read"), (returns, "return"), (models, "model")):
        own = rows.select("src", "dst").distinct().withColumn("kind", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    return out


def propagate(seeds: DataFrame, steps: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """(node, depth, kind): everything within ``rounds`` steps of a seed, at its least depth, with the first kind by
    name of the steps that get there then; and whether nothing lies beyond. Each round sends the new nodes only."""
    hops = cut(steps.select("src", "dst", "kind").distinct())
    seen = frontier = cut(seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit("seed").alias("kind")))
    for d in range(1, rounds + 1):
        met = frontier.select("node").join(hops, frontier.node == hops.src).groupBy(F.col("dst").alias("node")).agg(F.min("kind").alias("kind"))
        frontier = cut(met.join(seen, "node", "left_anti").select("node", F.lit(d).alias("depth"), "kind"))
        if frontier.isEmpty():
            return seen, True
        seen = seen.unionByName(frontier)
    return seen, False


def levels(edges: DataFrame, rounds: int = 128) -> tuple[DataFrame, bool]:
    """(node, level): an order of work in which what a node calls comes before it; level 0 calls nothing. Nodes on or
    above a cycle have none. Also whether ``rounds`` were enough.

    A round takes the nodes all of whose callees are done and sends them to their callers, so
    each edge is sent once; callers count what is still open.
    """
    hops = cut(edges.select("src", "dst").distinct())
    nodes = hops.select(F.col("src").alias("node")).union(hops.select("dst")).distinct()
    open_ = cut(hops.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")))
    ready = cut(nodes.join(open_, "node", "left_anti").withColumn("level", F.lit(0)))
    done = ready
    for level in range(1, rounds + 1):
        less = hops.join(ready.select(F.col("node").alias("dst")), "dst").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("k"))
        open_ = cut(open_.join(less, "node", "left").select("node", (F.col("n") - F.coalesce("k", F.lit(0))).alias("n")))
        ready = cut(open_.where("n = 0").select("node", F.lit(level).alias("level")))
        open_ = open_.where("n > 0")
        if ready.isEmpty():
            return done, True
        done = done.unionByName(ready)
    return done, False


def summarised(facts: DataFrame, calls: DataFrame, models: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """(node, depth, kind) of facts carried through modelled calls again and again until nothing new comes:
    ``calls`` has model, from and to places by slot; ``models`` which slots a model connects."""
    steps = calls.alias("a").join(models, "model").where("slot_in = source").select("call", "place_in", "target")
    out = calls.select("call", F.col("slot_out").alias("target"), "place_out").distinct()
    met = steps.join(out, ["call", "target"]).select(F.col("place_in").alias("src"), F.col("place_out").alias("dst"), F.lit("model").alias("kind"))
    return propagate(facts, met, rounds)
