"""Type hierarchy: closures, resolution, implementers and access predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import closure

PRIVATE, PROTECTED, STATIC, FINAL, PUBLIC = 2, 4, 8, 16, 1


def parent_edges(types: DataFrame) -> DataFrame:
    """(parent, child) of types with name and super."""
    return types.where(F.col("super").isNotNull()).select(F.col("super").alias("parent"), F.col("name").alias("child"))


def direct_subtypes(types: DataFrame) -> DataFrame:
    """(parent, child, n): a row for each child, with how many its parent has."""
    edges = parent_edges(types).distinct()
    return edges.join(edges.groupBy("parent").agg(F.count(F.lit(1)).alias("n")), "parent")


def type_closure(types: DataFrame) -> DataFrame:
    return closure(parent_edges(types))[0]


def capped(pairs: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` descendants of each ancestor by depth and name; ``complete`` tells whether that is all."""
    order = Window.partitionBy("ancestor").orderBy("depth", "descendant")
    total = pairs.groupBy("ancestor").agg(F.count(F.lit(1)).alias("total"))
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)  # cut before the exchange, too
    return ranked.join(total, "ancestor").select("ancestor", "descendant", "depth", (F.col("total") <= cap).alias("complete"))


def is_subtype(names: DataFrame, pairs: DataFrame, of: str) -> DataFrame:
    """Reflexive membership of each name below ``of``."""
    below = pairs.where(F.col("ancestor") == of).select(F.col("descendant").alias("name"), F.lit(True).alias("hit"))
    return names.select("name").distinct().join(below, "name", "left").select("name", (F.coalesce("hit", F.lit(False)) | (F.col("name") == of)).alias("is_subtype"))


def resolve_method(owners: DataFrame, pairs: DataFrame, declared: DataFrame) -> DataFrame:
    """(owner, name, declarer, depth): the nearest type on the way up, itself included, that declares the method."""
    up = owners.select(F.col("name").alias("owner"), F.col("name").alias("at"), F.lit(0).alias("depth")).union(pairs.select("descendant", "ancestor", "depth"))
    met = up.join(declared.select(F.col("owner").alias("at"), F.col("method").alias("name")), "at")
    return met.groupBy("owner", "name").agg(F.min_by(F.struct("at", "depth"), F.struct("depth", "at")).alias("m")).select("owner", "name", F.col("m.at").alias("declarer"), F.col("m.depth").alias("depth"))


def implementers(pairs: DataFrame, concrete: DataFrame, cap: int) -> DataFrame:
    """(ancestor, n, implementers): concrete descendants in order, null where there are more than ``cap``."""
    met = pairs.join(concrete.select(F.col("name").alias("descendant")), "descendant", "left_semi")
    counted = met.groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"))
    small = counted.where(F.col("n") <= cap).join(met, "ancestor").groupBy("ancestor").agg(F.concat_ws(",", F.array_sort(F.collect_list("descendant"))).alias("implementers"))
    return counted.join(small, "ancestor", "left").select("ancestor", "n", "implementers")


def has(access: Column, flag: int) -> Column:
    return access.bitwiseAND(flag) != 0


def overridable(access: Column, same_package: Column) -> Column:
    """Private, static and final methods can't be overridden; public and protected ones can; others in their package; unknown counts as yes."""
    return F.when(access.isNull() | (access < 0), True).when(has(access, PRIVATE) | has(access, STATIC) | has(access, FINAL), False).when(has(access, PUBLIC) | has(access, PROTECTED), True).otherwise(same_package)
