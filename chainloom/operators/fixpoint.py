"""Recursion over edges as semi-naive rounds: only what is new joins in the next round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, held


def least_depth(seeds: DataFrame, edges: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """(node, depth) of all nodes within ``rounds`` edges of a seed, and whether nothing lies beyond.

    ``seeds`` has node, ``edges`` has src and dst. The edges are worked out once; each round
    sends the frontier alone, and the first round that meets a node gives its least depth.
    """
    seen = frontier = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    hops, ended = held(edges.select("src", "dst"), "src"), False
    for depth in range(1, rounds + 1):
        met = frontier.join(hops, frontier.node == hops.src).select(F.col("dst").alias("node")).distinct()
        frontier = cut(met.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            ended = True
            break
        seen = seen.unionByName(frontier)
    hops.unpersist()
    return seen, ended


def closure(edges: DataFrame, rounds: int = 64) -> tuple[DataFrame, bool]:
    """(ancestor, descendant, depth) over (parent, child) edges, at least depth, and whether it ended."""
    below = cut(edges.select("parent", "child").distinct())
    pairs = frontier = below.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).withColumn("depth", F.lit(1))
    for depth in range(2, rounds + 1):
        met = frontier.join(below, frontier.descendant == below.parent).select("ancestor", F.col("child").alias("descendant")).where("ancestor <> descendant").distinct()
        frontier = cut(met.join(pairs, ["ancestor", "descendant"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return pairs, True
        pairs = pairs.unionByName(frontier)
    return pairs, False


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component): the least node reachable over src-dst edges in either direction.

    A round hangs every node on the one around it with the lowest hash, and then on what that one
    hangs on, and goes on with the edges between what nodes hang on. Hashes are anew in each round,
    so a share of the nodes goes whatever their order, and all rounds together send a few times the edges.
    """
    given = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    left, levels = given.where("src <> dst"), []
    while not left.isEmpty():
        if len(levels) == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        at = lambda c, turn=len(levels): F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("to"))
        both = left.select("src", "dst").union(left.select("dst", "src"))
        near = cut(both.groupBy("src").agg(F.min(at("dst")).alias("low")).select(F.col("src").alias("node"), F.least("low", at("src")).getField("to").alias("to")))
        hung = cut(near.join(near.select(F.col("node").alias("to"), F.col("to").alias("label")), "to").select("node", "label"))
        levels.append(hung)
        end = lambda c, hung=hung: hung.select(F.col("node").alias(c), F.col("label").alias(f"{c}_l"))
        met = left.join(end("src"), "src").join(end("dst"), "dst").where("src_l <> dst_l")
        left = cut(met.select(F.least("src_l", "dst_l").alias("src"), F.greatest("src_l", "dst_l").alias("dst")).distinct())
    of = given.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("label"))
    if levels:
        top = levels[-1]
        for hung in reversed(levels[:-1]):
            top = cut(hung.join(top.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label")))
        of = top.unionByName(of.join(top, "node", "left_anti"))
    least = of.groupBy("label").agg(F.min("node").alias("component"))
    return of.join(least, "label").select("node", "component")


def parts(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, part): as ``components``, but nodes are 64-bit hashes, edges may be repeated, and a part's name is any of its nodes.

    A round orders nodes by their bits with some turned over, so hashes needn't be sent beside the nodes.
    """
    left, levels = edges.select("src", "dst").where("src <> dst"), []
    while not left.isEmpty():
        if len(levels) == rounds:
            raise RuntimeError(f"parts did not settle in {rounds} rounds")
        turned = lambda c, mask=F.xxhash64(F.lit(len(levels))): F.col(c).bitwiseXOR(mask)
        both = left.select("src", "dst").union(left.select("dst", "src"))
        near = cut(both.groupBy("src").agg(F.min(turned("dst")).alias("low")).select(F.col("src").alias("node"), F.least("low", turned("src")).alias("low")).select("node", turned("low").alias("to")))
        hung = cut(near.join(near.select(F.col("node").alias("to"), F.col("to").alias("part")), "to").select("node", "part"))
        levels.append(hung)
        end = lambda c, hung=hung: hung.select(F.col("node").alias(c), F.col("part").alias(f"{c}_p"))
        met = left.join(end("src"), "src").join(end("dst"), "dst").where("src_p <> dst_p")
        left = cut(met.select(F.least("src_p", "dst_p").alias("src"), F.greatest("src_p", "dst_p").alias("dst")).distinct())
    top = levels[-1] if levels else edges.limit(0).select(F.col("src").alias("node"), F.col("dst").alias("part"))
    for hung in reversed(levels[:-1]):
        top = cut(hung.join(top.select(F.col("node").alias("part"), F.col("part").alias("top")), "part", "left").select("node", F.coalesce("top", "part").alias("part")))
    return top


def k_paths(seeds: DataFrame, edges: DataFrame, rounds: int, k: int) -> DataFrame:
    """(node, rank, hops, path): the k best paths to each node, shorter first, then by their text.

    ``path`` is the nodes joined by '>'. Paths don't meet a node twice. Each round extends
    what the round before kept. Without cycles the best k of each length are exact; with them
    a path may be missing whose beginnings lost to k others that its end can't follow:
    ``k_simple_paths`` keeps those.
    """
    kept = frontier = cut(seeds.select(F.col("node"), F.lit(0).alias("hops"), F.col("node").alias("path")).distinct())
    hops = cut(edges.select("src", "dst").distinct())
    for _ in range(rounds):
        met = frontier.join(hops, frontier.node == hops.src).where(~F.array_contains(F.split("path", ">"), F.col("dst")))
        grown = met.select(F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops"), F.concat_ws(">", "path", "dst").alias("path"))
        frontier = cut(best(grown, k).drop("rank"))
        if frontier.isEmpty():
            break
        kept = kept.unionByName(frontier)
    return best(kept, k)


def keyed_paths(seeds: DataFrame, edges: DataFrame, rounds: int, k: int) -> tuple[DataFrame, bool, bool]:
    """(key, node, rank, hops, path), whether no longer path exists, and whether paths were left out at a full node.

    ``seeds`` has key and node. Each key has ``k`` places at each node, which the shortest paths
    take, then the first by text; every node that a key reaches within ``rounds`` edges keeps its
    best path, however many other keys reach it.
    """
    hops = cut(edges.select("src", "dst").distinct())
    kept = frontier = cut(seeds.select("key", "node").distinct().select("key", "node", F.lit(0).alias("hops"), F.col("node").alias("path")))
    ended = over = False
    for n in range(1, rounds + 2):
        met = frontier.join(hops, frontier.node == hops.src).where(~F.array_contains(F.split("path", ">"), F.col("dst")))
        grown = met.select("key", F.col("dst").alias("node"), F.lit(n).alias("hops"), F.concat_ws(">", "path", "dst").alias("path"))
        if n > rounds:
            ended = grown.isEmpty()
            break
        taken = kept.groupBy("key", "node").agg(F.count(F.lit(1)).alias("taken"))
        order = F.row_number().over(Window.partitionBy("key", "node").orderBy("path"))
        ranked = cut(grown.withColumn("rank", order).join(taken, ["key", "node"], "left").withColumn("fits", F.col("rank") + F.coalesce("taken", F.lit(0)) <= k))
        over = over or not ranked.where("not fits").isEmpty()
        frontier = ranked.where("fits").select("key", "node", "hops", "path")
        if frontier.isEmpty():
            ended = True
            break
        kept = kept.unionByName(frontier)
    rank = F.row_number().over(Window.partitionBy("key", "node").orderBy("hops", "path"))
    return kept.withColumn("rank", rank).select("key", "node", "rank", "hops", "path"), ended, over


def k_simple_paths(seeds: DataFrame, edges: DataFrame, rounds: int, k: int) -> tuple[DataFrame, bool]:
    """(node, rank, hops, path) as ``k_paths`` gives, exact with cycles too, and whether more hops would change nothing.

    A path may only be dropped for k better ones that can go on wherever it can. What goes on
    from a node meets a path again only at nodes of a cycle that closes within the bound, so the k
    best are kept for each node and each set of such nodes on the way. Edges into a node on
    no such cycle are given up when it has its k paths.
    """
    hops = cut(edges.select("src", "dst").where("src <> dst").distinct())
    within = least_depth(seeds, hops, rounds + 1)[0].select(F.col("node").alias("src"))
    hops = cut(hops.join(within, "src", "left_semi"))
    circling = _looping(hops)
    rings, some_long = _short_cycles(circling, rounds + 1)
    found, full, whole = _k_simple(seeds, hops, rings, rounds, k)
    if whole and some_long:
        # Beyond the bound a longer cycle may stop the better paths, which matters if it leads to nodes that have fewer.
        every = cut(circling.select(F.col("src").alias("node")).distinct())
        if _more(every, full, hops):
            found, _, whole = _k_simple(seeds, hops, every, rounds, k)
    return found, whole


def _k_simple(seeds: DataFrame, hops: DataFrame, rings: DataFrame, rounds: int, k: int) -> tuple[DataFrame, DataFrame, bool]:
    """The paths of ``k_simple_paths`` with the sets of ``rings`` (node) kept, the nodes that have k, and whether no more hops are needed."""
    given, hops = hops, cut(hops.join(rings.select(F.col("node").alias("dst"), F.lit(True).alias("loops")), "dst", "left").select("src", "dst", F.coalesce("loops", F.lit(False)).alias("loops")))
    start = seeds.select("node").distinct().join(rings.withColumn("loops", F.lit(True)), "node", "left")
    none = F.array().cast("array<string>")
    kept = frontier = cut(start.select("node", F.lit(0).alias("hops"), F.col("node").cast("string").alias("path"), F.when(F.col("loops"), F.array(F.col("node").cast("string"))).otherwise(none).alias("met"), F.lit(1).alias("rank")))
    taken = frontier.select("node", "met", F.lit(1).alias("taken"))
    order = Window.partitionBy("node", "met").orderBy("path")
    for n in range(1, rounds + 2):
        filled = frontier.where((F.col("rank") == k) & (F.size("met") == 0)).select(F.col("node").alias("dst"))
        if not filled.isEmpty():
            hops = cut(hops.join(filled, "dst", "left_anti").select("src", "dst", "loops"))
        # Only nodes of short cycles can be met again.
        grown = frontier.join(hops, frontier.node == hops.src).where(~F.col("loops") | ~F.array_contains("met", F.col("dst").cast("string")))
        met = F.when(F.col("loops"), F.array_sort(F.concat("met", F.array(F.col("dst").cast("string"))))).otherwise(none)
        grown = grown.select(F.col("dst").alias("node"), F.lit(n).alias("hops"), F.concat_ws(">", "path", "dst").alias("path"), met.alias("met"))
        ranked = grown.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(taken, ["node", "met"], "left")
        frontier = cut(ranked.withColumn("rank", F.col("rank") + F.coalesce("taken", F.lit(0))).where(F.col("rank") <= k).select("node", "hops", "path", "met", "rank"))
        if frontier.isEmpty():
            break
        if n <= rounds:
            kept = kept.unionByName(frontier)
            taken = cut(taken.unionByName(frontier.groupBy("node", "met").agg(F.max("rank").alias("taken"))).groupBy("node", "met").agg(F.max("taken").alias("taken")).where((F.col("taken") < k) | (F.size("met") > 0)))
    alone = kept.where("size(met) = 0").select("node", "rank", "hops", "path")
    found = cut(alone.unionByName(best(kept.where("size(met) > 0").drop("met", "rank"), k).select("node", "rank", "hops", "path")))
    full = cut(found.where(F.col("rank") == k).select("node"))
    # The last round went one hop further: it tells whether some node would get another path.
    return found, full, frontier.isEmpty() or not _more(frontier, full, given)


def deviating_paths(seeds: DataFrame, targets: DataFrame, edges: DataFrame, rounds: int, k: int) -> DataFrame:
    """(node, rank, hops, path): the k best simple paths from a seed to each target, of ``rounds`` hops at most.

    The next best path leaves one of the better ones at some node: it has that one's beginning,
    which it doesn't meet again, and goes on by an edge that no better path with this beginning
    took. So each path that is taken asks one search for each of its nodes, from where it itself left
    another on, and the best of all that the searches found is taken next. What is kept for a
    target is k paths and a path for each of their nodes, whatever cycles there are; a search
    holds one path for each node that may still lead to its target in time.
    """
    hops = cut(edges.select(F.col("src").cast("string"), F.col("dst").cast("string")).distinct())
    starts = cut(seeds.select(F.col("node").cast("string").alias("next")).distinct())
    near = _distances(targets, hops, rounds)
    none = F.array().cast("array<string>")
    asked = near.select("target").distinct().select("target", none.alias("prefix"), none.alias("banned"))
    taken, open_ = None, None
    order = Window.partitionBy("target").orderBy(F.size("nodes"), F.concat_ws(">", "nodes"))
    for rank in range(1, k + 1):
        found = _completions(asked, starts, hops, near, rounds)
        ranked = cut((found if open_ is None else open_.unionByName(found)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k - rank + 1))
        best_, open_ = ranked.where("place = 1").drop("place"), ranked.where("place > 1").drop("place")
        now = best_.select(F.col("target").alias("node"), F.lit(rank).alias("rank"), (F.size("nodes") - 1).alias("hops"), F.concat_ws(">", "nodes").alias("path"))
        taken = now if taken is None else taken.unionByName(now)
        if rank == k or best_.isEmpty():
            break
        left = F.explode(F.sequence(F.size("prefix"), F.size("nodes") - 1)).alias("i")
        at = best_.select("*", left).withColumn("next", F.try_element_at("nodes", F.col("i") + 1))
        banned = F.when(F.col("i") == F.size("prefix"), F.concat("banned", F.array("next"))).otherwise(F.array("next"))
        asked = cut(at.select("target", F.slice("nodes", F.lit(1), F.col("i")).alias("prefix"), banned.alias("banned")))
    return taken


def _distances(targets: DataFrame, hops: DataFrame, rounds: int) -> DataFrame:
    """(target, node, left): hops that a node needs to a target, if ``rounds`` are enough."""
    seen = new = cut(targets.select(F.col("node").cast("string").alias("target")).distinct().select("target", F.col("target").alias("node"), F.lit(0).alias("left")))
    for n in range(1, rounds + 1):
        met = new.join(hops, new.node == hops.dst).select("target", F.col("src").alias("node")).distinct()
        new = cut(met.join(seen, ["target", "node"], "left_anti").withColumn("left", F.lit(n)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return cut(seen)


def _completions(asked: DataFrame, starts: DataFrame, hops: DataFrame, near: DataFrame, rounds: int) -> DataFrame:
    """(target, prefix, banned, nodes): of each search the shortest, then first by text, path that begins with its
    prefix, goes on by no banned node and meets none twice."""
    begun = near.join(starts.withColumnRenamed("next", "node"), "node").select("target", F.col("node").alias("next"))
    first = asked.where("size(prefix) = 0").join(begun, "target")
    on = asked.where("size(prefix) > 0").withColumn("src", F.try_element_at("prefix", F.lit(-1))).join(hops, "src").drop("src").withColumnRenamed("dst", "next")
    grown = first.select("target", "prefix", "banned", "next").unionByName(on.select("target", "prefix", "banned", "next"))
    ahead = grown.where(~F.array_contains("banned", F.col("next")) & ~F.array_contains("prefix", F.col("next"))).withColumn("nodes", F.concat("prefix", F.array("next")))
    done = None
    while True:
        in_time = ahead.join(near.withColumnRenamed("node", "next"), ["target", "next"]).where(F.size("nodes") - 1 + F.col("left") <= rounds)
        text = F.concat_ws(">", "nodes")
        level = cut(in_time.groupBy("target", F.size("prefix").alias("i"), "next").agg(F.min_by(F.struct("prefix", "banned", "nodes"), text).alias("of")))
        if level.isEmpty():
            break
        ended = level.where("next = target")
        row = ended.select("target", "of.prefix", "of.banned", "of.nodes")
        done = row if done is None else done.unionByName(row)
        rest = level.join(ended.select("target", "i"), ["target", "i"], "left_anti")
        ahead = rest.join(hops, rest.next == hops.src).where(~F.array_contains("of.nodes", F.col("dst"))).select("target", "of.prefix", "of.banned", F.col("dst").alias("next"), F.concat("of.nodes", F.array("dst")).alias("nodes"))
    return done if done is not None else ahead.select("target", "prefix", "banned", "nodes").limit(0)


def _more(frontier: DataFrame, full: DataFrame, hops: DataFrame) -> bool:
    """Whether paths beyond the bound could be among the best: at their node or, further on, at one that isn't full."""
    ahead, seen = frontier.select("node").distinct(), None
    while not ahead.isEmpty():
        if not ahead.join(full, "node", "left_anti").isEmpty():
            return True
        seen = ahead if seen is None else seen.unionByName(ahead)
        ahead = cut(ahead.join(hops, ahead.node == hops.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
    return False


def _looping(hops: DataFrame, rounds: int = 64) -> DataFrame:
    """The edges of all cycles and, if ``rounds`` don't suffice to trim what only leads there or comes from there, of some more."""
    turned = lambda df: df.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return turned(_trimmed(turned(_trimmed(hops.select("src", "dst"), rounds)), rounds))


def _trimmed(hops: DataFrame, rounds: int) -> DataFrame:
    """``hops`` without the nodes that no cycle leads to. An edge is sent once, when its source goes; what stays is a count for each node."""
    out = held(hops, "src")
    left = cut(out.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")))
    gone = new = cut(out.select(F.col("src").alias("node")).distinct().join(left, "node", "left_anti"))
    for _ in range(rounds):
        went = new.join(out, new.node == out.src).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("went"))
        left = cut(left.where("n > 0").join(went, "node", "left").select("node", (F.col("n") - F.coalesce("went", F.lit(0))).alias("n")))
        new = left.where("n = 0").select("node")
        if new.isEmpty():
            break
        gone = gone.unionByName(new)
    rest = cut(out.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").select("src", "dst"))
    out.unpersist()
    return rest


def _short_cycles(edges: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """(node) of all nodes on a cycle of ``most`` edges at most, and whether ``edges`` have other nodes.

    Each node is followed until it is met again, and then no more, so what is held are the ways of those that aren't.
    """
    found = cut(edges.limit(0).select(F.col("src").alias("node")))
    ahead = edges.select(F.col("src").alias("start"), F.col("dst").alias("node"))
    for n in range(2, most + 1):
        ahead = cut(ahead.join(edges, ahead.node == edges.src).select("start", F.col("dst").alias("node")).distinct())
        back = ahead.where("start = node").select("node")
        if not back.isEmpty():
            found = found.unionByName(back)
            ahead = ahead.join(back.withColumnRenamed("node", "start"), "start", "left_anti")
        if ahead.isEmpty():
            break
    every = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return cut(found), not every.join(found, "node", "left_anti").isEmpty()


def best(paths: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("node").orderBy("hops", "path")
    return paths.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positions(rows: DataFrame, by: list[str], leading: list[str], rest: list, name: str) -> DataFrame:
    """``rows`` with ``name``: the position of each, from 1, within ``by`` in the order of ``leading`` and then ``rest``.

    ``leading`` are columns of few values. Their counts, one row for each combination, give
    where each begins, so that a window holds the rows of one combination and never all of a key.
    """
    counts = rows.groupBy(*by, *leading).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*by).orderBy(*leading).rowsBetween(Window.unboundedPreceding, -1)
    begun = counts.withColumn("_begin", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*by, *leading).orderBy(*rest))
    return rows.withColumn("_at", within).join(begun, [*by, *leading]).withColumn(name, (F.col("_at") + F.col("_begin")).cast("int")).drop("_at", "_begin")
