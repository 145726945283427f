"""Lookups by key, edge orders, components, and walks up the superclass chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def at_keys(asked: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Each asked key with the row of ``table`` that has it, and whether there is one."""
    return asked.select(*keys).distinct().join(table.withColumn("found", F.lit(True)), keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def writers_by_name(writes: DataFrame) -> DataFrame:
    """(owner, name, writers, descriptors, first): the writers of a field whatever its descriptor."""
    return writes.groupBy("owner", "name").agg(F.countDistinct("writer").alias("writers"), F.countDistinct("descriptor").alias("descriptors"), F.min("writer").alias("first"))


def edge_offsets(edges: DataFrame) -> DataFrame:
    """(method, src, begin, n): where a position's edges begin among those of its method, and how many they are."""
    counted = edges.groupBy("method", "src").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("method").orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("begin", F.sum("n").over(order) - F.col("n")).select("method", "src", "begin", "n")


def reverse_edges(edges: DataFrame) -> DataFrame:
    """(method, dst, n, first): how many edges lead to a position, and from where the first does."""
    return edges.groupBy("method", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("first"))


def same_component(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """(a, b, same): whether both lie in one component; a node without one is its own."""
    of = lambda c: components.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    met = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return met.select("a", "b", (F.coalesce("of_a", "a") == F.coalesce("of_b", "b")).alias("same"))


def marked_below(names: DataFrame, pairs: DataFrame, marker: str) -> DataFrame:
    """Names at or below the marker type."""
    below = pairs.where(F.col("ancestor") == marker).select(F.col("descendant").alias("name"))
    return names.select("name").distinct().where(F.col("name") == marker).unionByName(names.select("name").distinct().join(below, "name", "left_semi").where(F.col("name") != marker))


def superclass_chain(owners: DataFrame, pairs: DataFrame, present: DataFrame) -> DataFrame:
    """(owner, resolvable): whether every class on the way up is there."""
    up = owners.select(F.col("name").alias("owner"), F.col("name").alias("at")).union(pairs.select("descendant", "ancestor"))
    there = present.select(F.col("name").alias("at"), F.lit(1).alias("there")).distinct()
    return up.join(owners.select(F.col("name").alias("owner")), "owner", "left_semi").join(there, "at", "left").groupBy("owner").agg((F.min(F.coalesce("there", F.lit(0))) == 1).alias("resolvable"))


def resolve_field(asked: DataFrame, pairs: DataFrame, declared: DataFrame, present: DataFrame) -> DataFrame:
    """(owner, name, declarer): the nearest class on the superclass chain that declares the field;
    null if none does, or if a class of the chain is missing."""
    up = asked.withColumn("at", F.col("owner")).withColumn("depth", F.lit(0)).unionByName(asked.join(pairs.select(F.col("descendant").alias("owner"), F.col("ancestor").alias("at"), "depth"), "owner"))
    met = up.join(declared.select(F.col("owner").alias("at"), "name"), ["at", "name"]).groupBy("owner", "name").agg(F.min_by("at", F.struct("depth", "at")).alias("declarer"))
    sound = superclass_chain(asked.select(F.col("owner").alias("name")).distinct(), pairs, present).where("resolvable").select("owner")
    return asked.join(met.join(sound, "owner", "left_semi"), ["owner", "name"], "left")


def artifact_of(members: DataFrame) -> DataFrame:
    """(class, selected, candidates, resolution): the first artifact that holds a class, and whether others do."""
    out = members.groupBy("class").agg(F.min("artifact").alias("selected"), F.countDistinct("artifact").alias("candidates"))
    return out.withColumn("resolution", F.when(F.col("candidates") > 1, "DUPLICATE").otherwise("UNIQUE"))


def hop_provenance(hops: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Hops with the artifacts of both ends; classes without one are UNKNOWN."""
    of = lambda c: artifacts.select(F.col("class").alias(f"{c}_owner"), F.col("selected").alias(f"{c}_artifact"))
    met = hops.join(of("from"), "from_owner", "left").join(of("to"), "to_owner", "left")
    return met.select("chain_key", "ord", *(F.coalesce(f"{c}_artifact", F.lit("UNKNOWN")).alias(f"{c}_artifact") for c in ("from", "to")))
