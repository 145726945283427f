"""Facts about typed calls joined by the identity of the values that flow between them, and relations of arrays and containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sharing

MOST_CANDIDATES, MOST_VIEWS = 10_000, 8


def decision(unreachable: Column, over_budget: Column, completed: Column) -> Column:
    """Of a check whether something can be reached: only a proof that it can't rejects."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(unreachable), "PROVABLY_UNREACHABLE").when(yes(over_budget), "BUDGET_EXCEEDED").when(yes(completed), "PROVEN_RETAINED").otherwise("UNKNOWN")


def passing(flows: DataFrame, decisions: DataFrame, by: str) -> DataFrame:
    """Flows that no decision blocks."""
    return flows.join(decisions.where("decision = 'PROVABLY_UNREACHABLE'").select(by), by, "left_anti")


def meetings(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(producer, consumer): calls that hand on one value, by its identity within a method."""
    p = producers.select("method", "identity", F.col("call").alias("producer"))
    return p.join(consumers.select("method", "identity", F.col("call").alias("consumer")), ["method", "identity"]).where("producer <> consumer").select("producer", "consumer").distinct()


def bridges(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(consumer, producer, status): PROVED where a consumer's value comes from one producer of its artifact, PARTIAL where the
    artifact differs or several do, UNKNOWN without a producer; the first producer stands for all."""
    # Whether there is one producer, and of which artifact, is told by the least and the greatest of an identity: no pair is made.
    of = F.col("artifact")
    p = producers.groupBy("identity").agg(F.min("call").alias("producer"), F.max("call").alias("last"), F.when(F.count(F.lit(1)) == F.count(of), F.min(of)).alias("of"), F.max(of).alias("to"))
    met = consumers.select("identity", F.col("call").alias("consumer"), "artifact").join(p, "identity", "left")
    same = F.coalesce((F.col("of") == of) & (F.col("to") == of), F.lit(False))
    out = met.groupBy("consumer").agg(F.min("producer").alias("producer"), F.max("last").alias("last"), F.min(same).alias("same"))
    return out.select("consumer", "producer", F.when(F.col("producer").isNull(), "UNKNOWN").when((F.col("producer") == F.col("last")) & F.col("same"), "PROVED").otherwise("PARTIAL").alias("status"))


def factory_constraints(references: DataFrame, loads: DataFrame) -> DataFrame:
    """(reference, load, status): class loads by the name that a reference gives for its factory. PROVED by the identity
    of the name's value, PARTIAL by equal text only."""
    # References that have the same identities and names are met once for all, and so are loads; then each kind, which is
    # named by its first member, is replaced by its own. Nothing is broadcast: by their files all of these look small.
    alike = lambda df, key: df.groupBy(key).agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in ("identity", "name")))
    refs, met = alike(references, "reference"), alike(loads, "load")
    first = lambda df, key, kind: df.groupBy("identity", "name").agg(F.min(key).alias(kind))
    ref_kinds, load_kinds = first(refs, "reference", "references"), first(met, "load", "loads")
    held = lambda kinds, kind, c: kinds.select(kind, F.explode(c).alias(c))
    both = [held(ref_kinds, "references", c).join(held(load_kinds, "loads", c).hint("merge"), c).select("references", "loads", F.lit(status).alias("status")) for c, status in (("identity", "PROVED"), ("name", "PARTIAL"))]
    found = both[0].unionByName(both[1]).groupBy("references", "loads").agg(F.max("status").alias("status"))
    own = lambda df, key, kinds, kind: df.join(kinds.hint("merge"), ["identity", "name"]).select(key, kind)
    refs, met = own(refs, "reference", ref_kinds, "references"), own(met, "load", load_kinds, "loads")
    return sharing.dealt(refs.join(found.hint("merge"), "references").drop("references"), met, "loads").select("reference", "load", "status")


def remote_proxies(references: DataFrame, addresses: DataFrame, creations: DataFrame) -> DataFrame:
    """(reference, creation): references of one type and one URL address whose URL a proxy factory is given."""
    kinds = addresses.groupBy("reference").agg(F.sum((F.col("kind") == "type").cast("int")).alias("types"), F.sum((F.col("kind") == "url").cast("int")).alias("urls"), F.max(F.when(F.col("kind") == "url", F.col("identity"))).alias("url"))
    whole = kinds.where("types = 1 and urls = 1").join(references.select("reference").distinct(), "reference", "left_semi")
    return whole.join(creations.select("creation", F.col("identity").alias("url")), "url").select("reference", "creation").distinct()


def callback_targets(calls: DataFrame, implementers: DataFrame, declared: DataFrame, most: int) -> DataFrame:
    """(call, target): what a lookup may call back on the implementers of its callback type, the first ``most`` by name."""
    met = calls.join(implementers.select("callback", "type"), "callback").join(declared.select("type", "method"), ["type", "method"])
    order = Window.partitionBy("call").orderBy("type")
    return met.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).select("call", F.concat_ws("#", "type", "method").alias("target"))


def invoke_handlers(calls: DataFrame, creations: DataFrame, handlers: DataFrame) -> DataFrame:
    """(call, handler): calls on a proxy lead to the invoke method of the one handler type it was made with."""
    one = creations.groupBy("identity").agg(F.min("handler").alias("handler"), F.countDistinct("handler").alias("n")).where("n = 1")
    return calls.join(one, "identity").join(handlers.select(F.col("name").alias("handler")).distinct(), "handler", "left_semi").select("call", "handler")


def raw_candidates(asked: DataFrame, pairs: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """(owner, candidate, complete): a type and those below it, the first ``most`` by depth and name."""
    own = asked.select("owner").distinct()
    below = own.join(pairs.select(F.col("ancestor").alias("owner"), F.col("descendant").alias("candidate"), "depth"), "owner")
    every = own.select("owner", F.col("owner").alias("candidate"), F.lit(0).alias("depth")).unionByName(below)
    first = every.withColumn("at", F.row_number().over(Window.partitionBy("owner").orderBy("depth", "candidate"))).where(F.col("at") <= most)
    return first.join(every.groupBy("owner").agg(F.count(F.lit(1)).alias("n")), "owner").select("owner", "candidate", (F.col("n") <= most).alias("complete"))


def declared_targets(calls: DataFrame, resolved: DataFrame) -> DataFrame:
    """(src, dst, type): static and special calls to the declarer of their method, or to the owner they name where none is found."""
    met = calls.join(resolved.select("owner", "name", "declarer"), ["owner", "name"], "left")
    return met.select(F.col("host").alias("src"), F.concat_ws("#", F.coalesce("declarer", "owner"), "name").alias("dst"), F.lit("INVOKES").alias("type")).distinct()


def array_flows(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """(read, value): what an array read may give. A constant index meets equal ones and unknown ones; an unknown one meets all."""
    known, every = reads.where("place is not null"), writes.select("array", "value")
    same = known.join(writes.where("place is not null").select("array", "place", "value").distinct(), ["array", "place"])
    blind = known.join(writes.where("place is null").select("array", "value").distinct(), "array")
    free = reads.where("place is null").join(every.distinct(), "array")
    return same.select("read", "value").union(blind.select("read", "value")).union(free.select("read", "value")).distinct()


def unwrapped(views: DataFrame, deep: int = MOST_VIEWS) -> tuple[DataFrame, bool]:
    """(view, container, depth): what views, iterators and copies were made of, through at most ``deep`` steps, and whether that was all."""
    from .fixpoint import closure

    found, ended = closure(views.select(F.col("made_of").alias("parent"), F.col("view").alias("child")), deep)
    return found.select(F.col("descendant").alias("view"), F.col("ancestor").alias("container"), "depth"), ended


def element_sources(adds: DataFrame, takes: DataFrame, views: DataFrame, deep: int = MOST_VIEWS) -> DataFrame:
    """(take, value): what may be taken from a container or any view of it: all that was added to it, to
    what it was made of, or to other views of that."""
    up = unwrapped(views, deep)[0].select("view", "container")
    nodes = adds.select(F.col("container").alias("view")).union(takes.select("container")).distinct()
    roots = up.union(nodes.select("view", F.col("view").alias("container"))).distinct()
    of = roots.select(F.col("view").alias("container"), F.col("container").alias("root"))
    added = adds.select("container", "value").distinct().join(of, "container").select("root", "value").distinct()
    # What each container gives is worked out once, however many take from it.
    given = takes.select("container").distinct().join(of, "container").join(added, "root").select("container", "value").distinct()
    return sharing.through(takes, given, "take", "container", "value")


def method_slices(insns: DataFrame, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """(method, one array of positions for each kind of instruction); a method has 65,535 positions at most."""
    cols = [F.array_sort(F.collect_list(F.when(F.col("op").isin(*ops), F.col("pos")))).alias(name) for name, ops in kinds.items()]
    return insns.groupBy("method").agg(*cols)


def all_of(rows: DataFrame, by: str, holds: Column) -> DataFrame:
    """(by, bound): whether something holds of every row of a key."""
    return rows.groupBy(by).agg((F.min(F.coalesce(holds, F.lit(False)).cast("int")) == 1).alias("bound"))


def resolved_risk(declared: Column, inferred: Column) -> Column:
    """HIGH where either says so by inference, else what was declared, else what was inferred."""
    return F.when(inferred == "HIGH", "HIGH").otherwise(F.coalesce(declared, inferred))
