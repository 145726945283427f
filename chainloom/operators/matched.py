"""Search along calls and returns that match: a value goes back only to the call that it came from.

Edges are of three kinds. ``flow`` (src, dst) stays within a method, ``calls`` (site, src, dst)
goes from an argument to a parameter, ``returns`` (site, src, dst) from a result to where the
site uses it. Plain reachability lets a value enter a method at one call and leave it at another.

``summaries`` tabulates what a call does for its caller: from each parameter the nodes of its
method that it reaches, through flow and through the summaries of calls made there; a result
among them is an edge from the argument to the use of the result, at the sites that call with
that parameter only. Then a search has two phases: in the first it goes back to any caller, as
it began within the method, in the second it only goes into calls; what a call does and undoes is
an edge of its caller in both. Both are semi-naive: a round joins what the one before found.

Rounds of a search go from method to method. A node's method is its name up to the first ``|``; what
is reached within a method is worked out by one task, and edges between nodes of different methods,
or of methods with very many edges, are taken by rounds. In the second phase all keys share what a
parameter reaches in its method, so only keys and parameters are sent, and their nodes come last.

A value in a global place, such as a static field, has no caller any more: ``globals`` (node)
begin the first phase anew, and tabulation stops there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, held

#: Edges of a method that one task takes; nodes that it remembers as reached, and rows that it gives at once, at most.
MOST_EDGES, MOST_KEPT, BATCH = 50_000, 1_000_000, 50_000


def _joint(parts: list[DataFrame]) -> DataFrame:
    """All of what rounds have written; of many parts it makes one."""
    if len(parts) > 16:
        parts[:] = [cut(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)


def _tabulated(flow: DataFrame, calls: DataFrame, returns: DataFrame, globals_: DataFrame | None, rounds: int) -> tuple[DataFrame, DataFrame, bool]:
    """(src, dst) of ``summaries``, (entry, node): what each parameter reaches in its method, and whether both are whole."""
    hops = flow.select("src", "dst")
    if globals_ is not None:
        hops = hops.join(globals_.select(F.col("node").alias("dst")), "dst", "left_anti").join(globals_.select(F.col("node").alias("src")), "src", "left_anti")
    hops, outs = held(hops.select("src", "dst"), "src"), held(returns.select("site", "src", "dst"), "src")
    ins = held(calls.select("site", F.col("dst").alias("entry"), "src"), "site", "entry")
    new = cut(calls.select(F.col("dst").alias("entry"), F.col("dst").alias("node")).distinct())
    paths, found, whole = [new], [cut(flow.select("src", "dst").limit(0))], False
    for _ in range(rounds):
        done = new.join(outs, new.node == outs.src).select("site", "entry", F.col("dst").alias("used"))
        made = done.join(ins, ["site", "entry"]).select("src", F.col("used").alias("dst"))
        known, had = _joint(found), _joint(paths)
        more = cut(made.distinct().join(known, ["src", "dst"], "left_anti"))
        from_ = new.withColumnRenamed("node", "src")
        along = from_.join(hops, "src").select("entry", F.col("dst").alias("node")).union(from_.join(known, "src").select("entry", F.col("dst").alias("node")))
        late = had.join(more, had.node == more.src).select("entry", F.col("dst").alias("node"))
        new = cut(along.union(late).distinct().join(had, ["entry", "node"], "left_anti"))
        found.append(more)
        if new.isEmpty():
            whole = True
            break
        paths.append(new)
    for df in (hops, outs, ins):
        df.unpersist()
    return _joint(found), _joint(paths), whole


def summaries(flow: DataFrame, calls: DataFrame, returns: DataFrame, globals_: DataFrame | None = None, rounds: int = 200) -> tuple[DataFrame, bool]:
    """(src, dst): from arguments to uses of results, as some call makes them, and whether all were found."""
    found, _, whole = _tabulated(flow, calls, returns, globals_, rounds)
    return found, whole


def _method(node: str) -> Column:
    return F.substring_index(node, "|", 1)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) for rows (method, key, src, dst) sorted by method, its edges (no dst: a start of a key) first."""
    method, ahead, kept, size, kind = None, {}, {}, 0, None
    keys, nodes = [], []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(nodes, pa.string())], ["key", "node"])
    for rows in batches:
        kind = rows.schema.field("key").type
        for m, key, src, dst in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if m != method:
                method, ahead, kept, size = m, {}, {}, 0
            if dst is not None:
                ahead.setdefault(src, []).append(dst)
                continue
            met = kept.get(src)
            if met is None:
                met, todo = {src}, [src]
                while todo:
                    for at in ahead.get(todo.pop(), ()):
                        if at not in met:
                            met.add(at)
                            todo.append(at)
                if size < MOST_KEPT:
                    kept[src], size = met, size + len(met)
            keys += [key] * len(met)
            nodes += met
            if len(keys) >= BATCH:
                yield batch()
                keys, nodes = [], []
    if keys:
        yield batch()


def _within(starts: DataFrame, inner: DataFrame) -> DataFrame:
    """(key, node) that each key's starts (key, node) reach along the edges (method, src, dst) within methods."""
    at = starts.select(_method("node").alias("method"), "key", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"))
    kind = starts.schema["key"].dataType
    own = inner.join(at.select("method").distinct(), "method", "left_semi").select("method", F.lit(None).cast(kind).alias("key"), "src", "dst")
    n = int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = own.union(at).repartition(n, "method").sortWithinPartitions("method", F.col("dst").isNull())
    return rows.mapInArrow(_spread, f"key {kind.simpleString()}, node string")


def _climbed(starts: DataFrame, inner: DataFrame, up: DataFrame, first: list[DataFrame], rounds: int) -> tuple[DataFrame, bool]:
    """(key, node) that the first phase reaches from new starts, which it adds to the parts ``first``, and whether it ended."""
    found = []
    for _ in range(rounds):
        new = _within(starts, inner).distinct()
        new = cut(new.join(_joint(first), ["key", "node"], "left_anti") if first else new)
        first.append(new)
        found.append(new)
        met = new.join(up, new.node == up.src).select("key", F.col("dst").alias("node")).distinct()
        starts = cut(met.join(_joint(first), ["key", "node"], "left_anti"))
        if starts.isEmpty():
            return _joint(found), True
    return _joint(found), False


def reach(seeds: DataFrame, flow: DataFrame, calls: DataFrame, returns: DataFrame, globals_: DataFrame | None = None, rounds: int = 200) -> tuple[DataFrame, bool]:
    """(key, node) that each key's seeds (key, node) reach along matching calls and returns, and whether that is all."""
    flow, calls, returns = cut(flow.select("src", "dst")), cut(calls.select("site", "src", "dst")), cut(returns.select("site", "src", "dst"))
    known, paths, whole = _tabulated(flow, calls, returns, globals_, rounds)
    level = flow.union(known.select("src", "dst")).where("src <> dst").withColumn("method", _method("src")).withColumn("inner", _method("src") == _method("dst"))
    large = cut(level.where("inner").groupBy("method").count().where(F.col("count") > MOST_EDGES).select("method"))
    inner = level.where("inner").join(large, "method", "left_anti").select("method", "src", "dst")
    cross = level.where("not inner").select("src", "dst").union(level.where("inner").join(large, "method", "left_semi").select("src", "dst"))
    # Where the first phase goes from a node: on within it, or down into the second.
    up, into = held(returns.select("src", "dst").union(cross), "src"), held(calls.select("src", "dst"), "src")
    # Where the second phase goes from a parameter: down, or over a global place into the first.
    below = paths.join(into, paths.node == into.src).select("entry", "dst").withColumn("down", F.lit(True))
    if globals_ is not None:
        reset = cut(globals_.select(F.col("node").alias("dst")).distinct())
        freed = paths.join(flow.join(reset, "dst", "left_semi"), F.col("node") == F.col("src")).select("entry", "dst")
        freed = freed.union(paths.select("entry", F.col("node").alias("dst")).join(reset, "dst", "left_semi").select("entry", "dst"))
        below = below.union(freed.withColumn("down", F.lit(False)))
    below = cut(below.distinct())
    leads = below.select(F.col("entry").alias("dst"), F.lit(True).alias("leads")).distinct()
    below = held(below.join(leads, "dst", "left").select("entry", "dst", "down", F.coalesce("leads", F.lit(False)).alias("leads")), "entry")
    first, second, ended = [], [], True
    starts = cut(seeds.select("key", "node").distinct())
    while starts is not None:
        new, done = _climbed(starts, inner, up, first, rounds)
        ended, starts = ended and done, None
        met, freed = new.join(into, new.node == into.src).select("key", F.col("dst").alias("node")).withColumn("leads", F.lit(True)), []
        for turn in range(rounds + 1):
            if turn == rounds:
                ended = False
                break
            met = met.groupBy("key", "node").agg(F.max("leads").alias("leads"))
            new = cut(met.join(_joint(second).select("key", "node"), ["key", "node"], "left_anti") if second else met)
            if new.isEmpty():
                break
            second.append(new)
            # What leads nowhere isn't sent again.
            new = new.where("leads")
            if new.isEmpty():
                break
            ahead = new.select("key", F.col("node").alias("entry")).join(below, "entry")
            met = ahead.where("down").select("key", F.col("dst").alias("node"), "leads")
            freed.append(ahead.where("not down").select("key", F.col("dst").alias("node")))
        if globals_ is not None and freed:
            starts = cut(reduce(DataFrame.union, freed).distinct().join(_joint(first), ["key", "node"], "left_anti"))
            starts = None if starts.isEmpty() else starts
    for df in (up, into, below):
        df.unpersist()
    seen = _joint(first).select("key", "node")
    if not second:
        return seen, ended and whole
    # A node of one parameter only, and in no key's first phase, is found once by a key; others are compared.
    of = paths.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("entry").alias("entry")).join(seen.select("node").distinct().withColumn("met", F.lit(True)), "node", "left")
    of = cut(of.select("node", "entry", (F.col("met").isNull() & (F.col("n") == 1)).alias("once")))
    down = _joint(second).select("key", F.col("node").alias("entry"))
    shared = paths.join(of.where("not once").select("node"), "node", "left_semi")
    several = seen.union(down.join(shared, "entry").select("key", "node")).distinct()
    return down.join(of.where("once").select("entry", "node"), "entry").select("key", "node").unionByName(several), ended and whole


def backward(seeds: DataFrame, flow: DataFrame, calls: DataFrame, returns: DataFrame, globals_: DataFrame | None = None, rounds: int = 200) -> tuple[DataFrame, bool]:
    """(key, node) from which each key's seeds can be reached, by the same search over turned edges: a use of a result leads into its callee."""
    turned = lambda df, *more: df.select(*more, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(seeds, turned(flow), turned(returns, "site"), turned(calls, "site"), globals_, rounds)
