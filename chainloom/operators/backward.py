"""Backward search from sinks to entries, bridges through frameworks, and the slices that bound both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, held
from . import fixpoint

MOST_CALLERS, MOST_WRITERS, MOST_TARGETS, MOST_DEPTH, MOST_DYNAMIC, MOST_CHAINS = 10_000, 10, 8, 64, 40, 20


def first_of(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key, and whether that was all: ``whole``."""
    first = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= most)
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
    return first.join(total, by).withColumn("whole", F.col("_total") <= most).drop("_rank", "_total")


def all_steps(args: DataFrame, writes: DataFrame, returns: DataFrame) -> DataFrame:
    """(place, source): where the value at a place may come from, each once; all callers, writers and targets count."""
    return args.select("place", "source").union(writes.select("place", "source")).union(returns.select("place", "source")).distinct()


def steps_back(args: DataFrame, writes: DataFrame, returns: DataFrame) -> DataFrame:
    """(place, source, kind, whole): where the value at a place may come from, the first of each kind; ``all_steps`` has all.

    A parameter's comes from the arguments of its callers (``args``: place, source), in order of
    their names up to a bound; a field's from its first writers (``writes``); a call's
    result from what its targets return (``returns``).
    """
    parts = [(args, "param", MOST_CALLERS), (writes, "field", MOST_WRITERS), (returns, "return", MOST_TARGETS)]
    out = None
    for rows, kind, most in parts:
        own = first_of(rows.select("place", "source").distinct(), ["place"], ["source"], most).withColumn("kind", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    return out.select("place", "source", "kind", "whole")


def entered(sinks: DataFrame, steps: DataFrame, entries: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """(sink, entry, depth) as ``controlled`` gives them. What ``controlled`` also tells asks for all places of all
    searches; here one search from all entries tells first how far each place is from one, and a
    search goes on only where the steps that it has left lead to an entry."""
    places = entries.select("place").distinct()
    ahead = steps.select(F.col("source").alias("src"), F.col("place").alias("dst"))
    near = fixpoint.least_depth(places.select(F.col("place").alias("node")), ahead, depth)[0].select(F.col("node").alias("source"), F.col("depth").alias("left"))
    back = held(ahead.select(F.col("dst").alias("at"), F.col("src").alias("source")).join(near, "source"), "at")
    seen = frontier = cut(sinks.select("sink", "place").distinct().withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        met = frontier.join(back, frontier.place == back["at"]).where(F.col("left") + d <= depth).select("sink", F.col("source").alias("place")).distinct()
        frontier = cut(met.join(seen, ["sink", "place"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    back.unpersist()
    return seen.join(places, "place", "left_semi").select("sink", F.col("place").alias("entry"), "depth")


def controlled(sinks: DataFrame, steps: DataFrame, entries: DataFrame, depth: int = MOST_DEPTH) -> tuple[DataFrame, bool]:
    """(sink, entry, depth) for every entry place whose value may reach a sink's place, by its least
    number of steps, and whether no search was cut by ``depth`` or went over a place whose
    steps were left out beyond their bound (``whole`` of ``steps``, if it is there).

    ``sinks`` has sink and place, ``entries`` place. Each round sends the frontier of all
    sinks at once; a place is met once for each sink, so cycles end.
    """
    back = cut(steps.select(F.col("place").alias("at"), "source").distinct())
    seen = frontier = cut(sinks.select("sink", "place").distinct().withColumn("depth", F.lit(0)))
    ended = False
    for d in range(1, depth + 1):
        met = frontier.join(back, frontier.place == back["at"]).select("sink", F.col("source").alias("place")).distinct()
        frontier = cut(met.join(seen, ["sink", "place"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            ended = True
            break
        seen = seen.unionByName(frontier)
    if ended and "whole" in steps.columns:
        ended = seen.join(steps.where("not whole").select("place"), "place", "left_semi").isEmpty()
    return seen.join(entries.select("place").distinct(), "place", "left_semi").select("sink", F.col("place").alias("entry"), "depth"), ended


def framework_paths(starts: DataFrame, edges: DataFrame, packages: DataFrame, sinks: DataFrame, rounds: int = 12) -> tuple[DataFrame, bool]:
    """(start, sink, depth, path) to the nearest sink that a start reaches within its own package, and whether all searches ended.

    The walk goes on through nodes of the start's package only; the first level that calls a
    sink decides, the first path by name of that level is kept, and its start is done.
    """
    hops = cut(edges.select("src", "dst").distinct())
    own = cut(packages.select("node", "package"))
    frontier = cut(starts.select(F.col("node").alias("start"), "node", F.col("node").alias("path")).join(own, "node"))
    seen, found, ended = frontier.select("start", "node"), None, False
    for d in range(rounds):
        ahead = frontier.join(hops, frontier.node == hops.src).select("start", "package", F.col("dst").alias("node"), "path")
        hit = ahead.join(sinks.select("node").distinct(), "node", "left_semi")
        best = cut(hit.groupBy("start").agg(F.min(F.struct(F.concat_ws(">", "path", "node").alias("path"), F.col("node").alias("sink"))).alias("b")).select("start", "b.sink", F.lit(d + 1).alias("depth"), "b.path"))
        found = best if found is None else found.unionByName(best)
        on = ahead.join(best.select("start"), "start", "left_anti").join(own, ["node", "package"], "left_semi").join(seen, ["start", "node"], "left_anti")
        frontier = cut(on.groupBy("start", "package", "node").agg(F.min(F.concat_ws(">", "path", "node")).alias("path")))
        if frontier.isEmpty():
            ended = True
            break
        seen = seen.unionByName(frontier.select("start", "node"))
    return found, ended


def nearest_entry(hosts: DataFrame, edges: DataFrame, entries: DataFrame, most: int = 3) -> DataFrame:
    """(host, entry, depth): the nearest entry at most ``most`` calls above a host, the first by name."""
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("above")).distinct()
    level = seen = hosts.select(F.col("node").alias("host"), "node").distinct().withColumn("depth", F.lit(0))
    for d in range(1, most + 1):
        level = cut(level.join(back, level.node == back["at"]).select("host", F.col("above").alias("node")).distinct().join(seen, ["host", "node"], "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(level)
    met = seen.join(entries.select("node").distinct(), "node", "left_semi")
    return met.groupBy("host").agg(F.min(F.struct("depth", "node")).alias("m")).select("host", F.col("m.node").alias("entry"), F.col("m.depth").alias("depth"))


def reaches(starts: DataFrame, edges: DataFrame, hits: DataFrame, rounds: int) -> DataFrame:
    """(node, reaches): whether a start gets to a hit within ``rounds`` edges; one closure from the hits serves all starts."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    near = fixpoint.least_depth(hits.select("node"), back, rounds)[0].select("node", F.lit(True).alias("hit"))
    return starts.select("node").distinct().join(near, "node", "left").select("node", F.coalesce("hit", F.lit(False)).alias("reaches"))


def program_slice(entries: DataFrame, terminals: DataFrame, edges: DataFrame, owners: DataFrame, rounds: int, most: int) -> DataFrame:
    """(owner, methods, near, kept): owners of methods on some way from an entry to a terminal, nearest to a terminal
    first; ``kept`` is false for those beyond ``most``."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    fore = fixpoint.least_depth(entries.select("node"), edges, rounds)[0].select("node")
    rear = fixpoint.least_depth(terminals.select("node"), back, rounds)[0]
    met = rear.join(fore, "node", "left_semi").join(owners, "node")
    counted = cut(met.groupBy("owner").agg(F.count(F.lit(1)).alias("methods"), F.min("depth").alias("near")))
    first = counted.orderBy("near", "owner").limit(most).select("owner", F.lit(True).alias("kept"))
    return counted.join(first, "owner", "left").select("owner", "methods", "near", F.coalesce("kept", F.lit(False)).alias("kept"))


def demand(scoped: bool, known: Column, forward: Column, indexed: Column, reverse: Column, meets: Column, continues: Column) -> Column:
    """Why a pair of entry and terminal is admitted or not; the first check that fails says so."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    if not scoped:
        return F.lit("APPLICATION_SCOPE_UNKNOWN")
    return (
        F.when(~yes(known), "ENTRY_NOT_APPLICATION").when(~yes(forward), "ENTRY_NOT_FORWARD_REACHABLE").when(~yes(indexed), "TERMINAL_NOT_INDEXED").when(~yes(reverse), "TERMINAL_NOT_REVERSE_REACHABLE")
        .when(yes(meets), "ENTRY_TERMINAL_INTERSECTION").when(yes(continues), "BRIDGE_CONTINUATION").otherwise("ENTRY_NOT_IN_TERMINAL_DEMAND")
    )


def producer_store(admitted: Column, trigger: Column, declared: Column, intermediate: Column, continues: Column, application: Column, reverse: Column) -> Column:
    """Which store a candidate chain goes to: the application's, one for bridges, suffixes of dependencies, or none."""
    return (
        F.when(admitted & trigger, "BRIDGE_CONTINUATION").when(declared, F.when(application, "APPLICATION_CHAIN").otherwise("BRIDGE_CONTINUATION")).when(admitted, "APPLICATION_CHAIN")
        .when(intermediate & continues, F.when(application, "APPLICATION_CHAIN").otherwise("BRIDGE_CONTINUATION")).when(reverse & ~application, "DEPENDENCY_SUFFIX").otherwise("REJECTED")
    )


def completed(traces: DataFrame, dynamic: int = MOST_DYNAMIC, most: int = MOST_CHAINS) -> DataFrame:
    """(sink, trace, status): traces of too many dynamic hops are TOO_LONG; of the others a sink keeps the first ``most``, by length and name."""
    long = F.col("dynamic") > dynamic
    order = Window.partitionBy("sink", long).orderBy("n_hops", "trace")
    return traces.withColumn("_at", F.row_number().over(order)).select("sink", "trace", F.when(long, "TOO_LONG").when(F.col("_at") <= most, "CHAIN").otherwise("BEYOND").alias("status"))
