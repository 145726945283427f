"""Composition: chains that meet are joined by a bridge or an overlap, fragments are instantiated, chains re-rooted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import positions

BRIDGES = ("INVOKE", "TRIGGER", "TEMPLATE", "DESER", "JNDI_RMI", "JDBC_XML")
MOST_HOPS, MOST_CHAINS = 64, 400
#: Turns that each front has, and chains that it makes of them.
TURNS, PER_FRONT = 8, 2


def bridge_kind(category: Column, entry_kind: Column) -> Column:
    """The first bridge that applies, from the front's category and the back's entry."""
    return (
        F.when(category == "reflection", "INVOKE").when(entry_kind.isin("hashCode", "compareTo", "toString"), "TRIGGER").when(category == "template", "TEMPLATE")
        .when(entry_kind == "readObject", "DESER").when(category == "lookup", "JNDI_RMI").when(category == "file", "JDBC_XML")
    )


def bridged(fronts: DataFrame, backs: DataFrame, most_hops: int = MOST_HOPS, per_front: int = 2) -> DataFrame:
    """Front and back chains that meet where the front's sink belongs to the back's entry region.

    Both have chain_key, region, n_hops; the join is on the region, and a front keeps its
    ``per_front`` best backs: shortest, then by key. The bridge replaces the back's last hop.
    All fronts order backs alike, so of a region's backs only the first few of each kind of
    entry, one more than a front keeps, meet the fronts.
    """
    f = fronts.select(F.col("chain_key").alias("front"), "region", F.col("n_hops").alias("fn"), F.col("category").alias("fc"), F.col("unresolved").alias("fu"))
    b = backs.select(F.col("chain_key").alias("back"), "region", F.col("n_hops").alias("bn"), F.col("entry_kind").alias("bk"), F.col("unresolved").alias("bu"))
    first = F.row_number().over(Window.partitionBy("region", "bk").orderBy("bn", "back"))
    b = b.withColumn("at", first).where(F.col("at") <= per_front + 1).drop("at")
    met = f.join(b, "region").where("front <> back").withColumn("bridge", bridge_kind(F.col("fc"), F.col("bk"))).where("bridge is not null")
    met = met.withColumn("n_hops", F.col("fn") + F.col("bn")).where(F.col("n_hops") <= most_hops)
    order = Window.partitionBy("front").orderBy("n_hops", "back")
    return met.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_front).select("front", "back", F.concat(F.lit("bridge-"), F.lower("bridge")).alias("reason"), "n_hops", (F.col("fu") + F.col("bu")).alias("unresolved"))


def overlaps(hops: DataFrame, per_chain: int = 2) -> DataFrame:
    """Pairs of chains of which one's entry side meets the other's sink side in the same method.

    A chain meets a method once, so of a method's backs the first of each chain, one more than a front keeps, are enough.
    """
    a = hops.where("ord = 0").select(F.col("chain_key").alias("front"), F.col("from_name").alias("spot"))
    b = hops.where("ord >= 1").select(F.col("chain_key").alias("back"), F.col("to_name").alias("spot"), F.col("ord").alias("cut"))
    once = b.groupBy("spot", "back").agg(F.min("cut").alias("cut"))
    first = F.row_number().over(Window.partitionBy("spot").orderBy("cut", "back"))
    met = a.join(once.withColumn("at", first).where(F.col("at") <= per_chain + 1).drop("at"), "spot").where("front <> back")
    order = Window.partitionBy("front").orderBy("cut", "back")
    return met.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_chain).select("front", "back", "spot", "cut")


def fragments(anchors: DataFrame, present: DataFrame) -> DataFrame:
    """Fragments all of whose anchor classes are present."""
    need = anchors.groupBy("fragment").agg(F.countDistinct("anchor").alias("need"))
    got = anchors.join(present.select(F.col("name").alias("anchor")).distinct(), "anchor", "left_semi").groupBy("fragment").agg(F.countDistinct("anchor").alias("got"))
    return need.join(got, "fragment", "left").select("fragment", "need", F.coalesce("got", F.lit(0)).alias("got"), (F.col("need") == F.coalesce("got", F.lit(0))).alias("active"))


def reroot(chains: DataFrame, members: DataFrame, holders: DataFrame, per_chain: int = 20) -> DataFrame:
    """(chain_key, root): holders of the entry class, the first ``per_chain`` in order.

    ``members`` has held and region, ``holders`` region and root: a class may be held by all
    holders of its regions. Only a region's first few meet its classes, and only those of chains.
    """
    first = lambda df, by: df.distinct().withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy("root"))).where(F.col("rn") <= per_chain).drop("rn")
    entered = chains.select("chain_key", F.col("entry_class").alias("held"))
    own = members.select("held", "region").join(entered.select("held").distinct(), "held", "left_semi").distinct()
    met = entered.join(first(own.join(first(holders.select("region", "root"), "region"), "region").select("held", "root"), "held"), "held")
    order = Window.partitionBy("chain_key").orderBy("root")
    return met.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_chain).select("chain_key", "root")


def by_turns(fronts: DataFrame, backs: DataFrame, hops: DataFrame, turns: int = TURNS, per_front: int = PER_FRONT, most: int = MOST_CHAINS, most_hops: int = MOST_HOPS) -> tuple[DataFrame, bool]:
    """(front, back, reason, turn, n_hops) of the chains that are joined, and whether no bound left one out.

    Fronts and backs meet in a region, both in order of length and key. In turn t the front at
    place i is offered the back at place (t + i) modulo the region's backs, so that no front and no
    back takes all: a front's place and turn name one back, which makes each offer a row and an
    equal join. An offer is taken if there is a bridge, it isn't too long, and the back's
    entry isn't on the front's way already. A front keeps its first ``per_front``; of all, the
    first ``most`` by turn, region and place stay. ``hops`` has chain_key, from_name, to_name.
    """
    column = lambda df: df.select("chain_key", "region", "category", "entry_kind", "entry_method", "n_hops")
    f = positions(column(fronts), ["region"], ["n_hops"], ["chain_key"], "i").select(F.col("chain_key").alias("front"), "region", "category", F.col("n_hops").alias("fn"), (F.col("i") - 1).alias("i"))
    b = positions(column(backs), ["region"], ["n_hops"], ["chain_key"], "j").select(F.col("chain_key").alias("back"), "region", "entry_kind", F.col("entry_method").alias("entered"), F.col("n_hops").alias("bn"), (F.col("j") - 1).alias("j"))
    sizes = backs.groupBy("region").agg(F.count(F.lit(1)).cast("int").alias("nb"))
    offered = f.join(sizes, "region").withColumn("turn", F.explode(F.sequence(F.lit(0), F.least(F.col("nb"), F.lit(turns)) - 1))).withColumn("j", F.pmod(F.col("turn") + F.col("i"), F.col("nb")))
    met = offered.join(b, ["region", "j"]).where("front <> back").withColumn("bridge", bridge_kind(F.col("category"), F.col("entry_kind"))).withColumn("n_hops", F.col("fn") + F.col("bn"))
    met = met.where("bridge is not null").where(F.col("n_hops") <= most_hops)
    on_way = hops.select(F.col("chain_key").alias("front"), F.explode(F.array("from_name", "to_name")).alias("entered")).distinct()
    met = met.join(on_way, ["front", "entered"], "left_anti")
    first = met.withColumn("rn", F.row_number().over(Window.partitionBy("front").orderBy("turn"))).where(F.col("rn") <= per_front)
    ranked = first.select("front", "back", F.concat(F.lit("bridge-"), F.lower("bridge")).alias("reason"), "turn", "n_hops", "region", "i").orderBy("turn", "region", "i").limit(most + 1)
    # At most one row more than are kept: a sort of so few that any session has room for it.
    kept = ranked.withColumn("place", F.row_number().over(Window.orderBy("turn", "region", "i")))
    whole = sizes.where(F.col("nb") > turns).isEmpty() and kept.where(F.col("place") > most).isEmpty()
    return kept.where(F.col("place") <= most).drop("place", "region", "i"), whole


def spliced(pairs: DataFrame, hops: DataFrame) -> DataFrame:
    """(chain_key, ord, from_name, to_name, kind, reason): the hops of joined chains, 0 at the sink, as of all chains.

    The back keeps its hops but for the one at its entry, whose place the bridge takes: it
    leads from the front's sink to where that hop led. The front's hops come behind it.
    """
    top = hops.groupBy("chain_key").agg(F.max("ord").alias("top"))
    key = F.concat_ws("+", "front", "back").alias("chain_key")
    ends = pairs.join(top.withColumnRenamed("chain_key", "back"), "back").select(key, "front", "back", "top", F.col("reason").alias("bridge"))
    of = lambda c: hops.select(F.col("chain_key").alias(c), "ord", "from_name", "to_name", "kind", "reason")
    behind = ends.join(of("back"), "back")
    kept = behind.where("ord < top").select("chain_key", "ord", "from_name", "to_name", "kind", "reason")
    sink = of("front").where("ord = 0").select("front", F.col("to_name").alias("sink"))
    across = behind.where("ord = top").join(sink, "front").select("chain_key", "ord", F.col("sink").alias("from_name"), "to_name", "kind", F.col("bridge").alias("reason"))
    ahead = ends.join(of("front"), "front").select("chain_key", (F.col("ord") + F.col("top") + 1).alias("ord"), "from_name", "to_name", "kind", "reason")
    return kept.union(across).union(ahead)


def overlapped(pairs: DataFrame, hops: DataFrame) -> DataFrame:
    """(chain_key, ord, from_name, to_name, kind, reason): chains that meet in a method (``overlaps``: front, back, spot, cut).

    The back's hops from its entry to the spot come first, then the front's from the spot to its sink.
    """
    key = F.concat_ws("&", "front", "back").alias("chain_key")
    of = lambda c: hops.select(F.col("chain_key").alias(c), "ord", "from_name", "to_name", "kind", "reason")
    last = pairs.join(of("front").where("ord = 0"), "front").select(key, "ord", "from_name", "to_name", "kind", "reason")
    first = pairs.join(of("back"), "back").where("ord >= cut").select(key, (F.col("ord") - F.col("cut") + 1).alias("ord"), "from_name", "to_name", "kind", "reason")
    return last.union(first)
