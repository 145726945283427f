"""Call graph: one edge family for each kind of invocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hierarchy import FINAL, PRIVATE, STATIC, has

CAP = 200


def invoke_kind(op: Column) -> Column:
    """The kind of an invoke opcode, null for other opcodes."""
    return F.when(op == "INVOKESTATIC", "STATIC").when(op == "INVOKESPECIAL", "SPECIAL").when(op == "INVOKEVIRTUAL", "VIRTUAL").when(op == "INVOKEINTERFACE", "INTERFACE").when(op == "INVOKEDYNAMIC", "DYNAMIC")


def fixed_dispatch(access: Column, final_owner: Column) -> Column:
    return has(access, FINAL) | has(access, PRIVATE) | has(access, STATIC) | final_owner


def dispatch_plan(signatures: DataFrame, pairs: DataFrame, concrete: DataFrame, cap: int = CAP) -> DataFrame:
    """(receiver, target, status) for distinct receivers: every concrete type at or below it, or itself
    as 'fallback' where there is none and 'capped' where there are more than ``cap``."""
    own = signatures.select("receiver").distinct()
    down = pairs.select(F.col("ancestor").alias("receiver"), F.col("descendant").alias("target")).union(own.select("receiver", F.col("receiver").alias("target")))
    met = own.join(down, "receiver").join(concrete.select(F.col("name").alias("target")), "target", "left_semi")
    n = met.groupBy("receiver").agg(F.count(F.lit(1)).alias("n"))
    sized = own.join(n, "receiver", "left").withColumn("status", F.when(F.coalesce("n", F.lit(0)) == 0, "fallback").when(F.col("n") > cap, "capped").otherwise("dispatch"))
    open_ = sized.where("status = 'dispatch'").join(met, "receiver").select("receiver", "target", "status")
    return open_.union(sized.where("status <> 'dispatch'").select("receiver", F.col("receiver").alias("target"), "status"))


def external(calls: DataFrame, loaded: DataFrame) -> DataFrame:
    """Called methods that no loaded class declares."""
    return calls.select("callee").distinct().join(loaded.select(F.col("name").alias("callee")), "callee", "left_anti")


def receiver_precision(kind: Column, exact: Column, platform_bound: Column, skipped: Column) -> Column:
    """How well a call's receiver is known, from the number of exact types and what else is proved."""
    return (
        F.when(kind.isin("STATIC", "SPECIAL", "DYNAMIC") | (exact == 1), "CONCRETE").when(exact > 1, "SEALED_SET")
        .when(platform_bound, "POINTS_TO_BOUNDED").when(skipped, "UNKNOWN").otherwise("CHA_BOUNDED")
    )
