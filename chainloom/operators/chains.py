"""Chains and their hops: identity, merging, evidence, confidence, precision and rank.

A chain is a row with its entry, its sink and its rule; its hops are rows of their own,
numbered from the sink to the entry, at most some dozens for a chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import positions

PATTERN_BONUS = 2
KEY = ("rule_id", "category", "severity", "entry_kind", "entry_class", "entry_method", "sink_class", "sink_method", "sink_role", "sink_risk")
MERGE = ("rule_id", "category", "severity", "entry_class", "entry_method", "entry_kind", "sink_class", "sink_method", "sink_role")
TRIGGERS = ("hashCode", "equals", "compareTo", "compare", "toString")


def shown(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("<null>"))


def hop_text(hops: DataFrame) -> DataFrame:
    """(chain_key, hop_text): the hops' fields in order, each followed by a bar."""
    one = F.concat(*(F.concat(shown(c), F.lit("|")) for c in ("from_name", "to_name", "kind", "field", "descriptor")))
    listed = F.array_sort(F.collect_list(F.struct("ord", one.alias("t"))))
    return hops.groupBy("chain_key").agg(F.concat_ws("", F.transform(listed, lambda x: x["t"])).alias("hop_text"))


def identity(chains: DataFrame, hops: DataFrame, fields: tuple[str, ...] = KEY) -> DataFrame:
    """(chain_key, identity, short_id): the identity text of a chain and the first eight digits of its SHA-1."""
    head = F.concat(*(F.concat(shown(c), F.lit("|")) for c in fields))
    met = chains.join(hop_text(hops), "chain_key").withColumn("identity", F.concat(head, "hop_text"))
    return met.select("chain_key", "identity", F.substring(F.sha1("identity"), 1, 8).alias("short_id"))


def missing_evidence(hops: DataFrame) -> DataFrame:
    """(chain_key, missing): blank descriptors, and field flows without a field."""
    blank = F.when(F.coalesce(F.trim("descriptor"), F.lit("")) == "", 1).otherwise(0)
    loose = F.when((F.col("kind") == "FIELD_FLOW") & F.col("field").isNull(), 1).otherwise(0)
    return hops.groupBy("chain_key").agg(F.sum(blank + loose).cast("long").alias("missing"))


def preferred(chains: DataFrame, hops: DataFrame, by: list[str]) -> DataFrame:
    """Of the chains that agree in ``by``: fewest unresolved, least missing, most hops, first key."""
    order = Window.partitionBy(*by).orderBy("unresolved", "missing", F.desc("n_hops"), "chain_key")
    return chains.join(missing_evidence(hops), "chain_key").withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def reasons(hops: DataFrame) -> DataFrame:
    return hops.groupBy("chain_key").agg(F.concat_ws(",", F.array_sort(F.collect_set("reason"))).alias("reasons"))


def entry_weight(kind: Column) -> Column:
    return F.when(kind.isNull(), 0).when(kind.isin("readObject", "readResolve", "readExternal", "hashCode", "proxyInvoke"), 2).otherwise(1)


def scores(chains: DataFrame, hops: DataFrame, notes: DataFrame) -> DataFrame:
    """(chain_key, score, rank): one for each direct call or field flow, the entry's weight, one for a high
    severity, two for each pattern note, two off for each unresolved hop; rank 0 from 5, 1 from 3, else 2."""
    sure = hops.groupBy("chain_key").agg(F.sum(F.when(F.col("kind").isin("DIRECT_CALL", "FIELD_FLOW"), 1).otherwise(0)).alias("sure"))
    found = notes.where(F.startswith("note", F.lit("pattern:"))).groupBy("chain_key").agg(F.count(F.lit(1)).alias("patterns"))
    score = F.col("sure") + entry_weight(F.col("entry_kind")) + F.when(F.col("severity") == "HIGH", 1).otherwise(0) + PATTERN_BONUS * F.coalesce("patterns", F.lit(0)) - 2 * F.col("unresolved")
    out = chains.join(sure, "chain_key").join(found, "chain_key", "left").withColumn("score", score.cast("int"))
    return out.select("chain_key", "score", F.when(F.col("score") >= 5, 0).when(F.col("score") >= 3, 1).otherwise(2).alias("rank"), "unresolved")


def confidence(scored: DataFrame, notes: DataFrame) -> DataFrame:
    """NOT_FEASIBLE, DEGRADED with its first reason, or FEASIBLE: feasible needs a rank below 2 and
    no more than half as many unresolved hops as the score allows."""
    worst = notes.where(F.startswith("note", F.lit("degrade:"))).groupBy("chain_key").agg(F.min("note").alias("worst"))
    fit = (F.col("rank") < 2) & (2 * F.col("unresolved") <= F.greatest(F.lit(0), F.col("score")))
    bucket = F.when(F.col("score").isNull(), "UNKNOWN").when(~fit, "NOT_FEASIBLE").when(F.col("worst").isNotNull(), F.concat(F.lit("DEGRADED("), F.expr("substring(worst, 9)"), F.lit(")"))).otherwise("FEASIBLE")
    return scored.join(worst, "chain_key", "left").select("chain_key", bucket.alias("bucket"))


def precision(hops: DataFrame) -> DataFrame:
    """(chain_key, dispatch, flow, proof, precision): ordinal positions, 0 best, and their sum."""
    has = lambda c: F.max(F.when(c, 1).otherwise(0))
    dispatch = F.when(has(F.col("kind") == "NATIVE_CALLBACK") == 1, 2).when(has(F.col("kind") == "VIRTUAL_DISPATCH") == 1, 1).otherwise(0)
    flow = F.when(has((F.col("kind") == "FIELD_FLOW") & F.col("field").isNull()) == 1, 2).when(has(F.col("kind") == "FIELD_FLOW") == 1, 1).otherwise(0)
    proof = F.when(has(F.startswith("reason", F.lit("model:"))) == 1, 1).otherwise(0)
    out = hops.groupBy("chain_key").agg(dispatch.alias("dispatch"), flow.alias("flow"), proof.alias("proof"))
    return out.withColumn("precision", F.col("dispatch") + F.col("flow") + F.col("proof"))


def ranked(chains: DataFrame, scored: DataFrame, precise: DataFrame, preference: Column) -> DataFrame:
    """Position of each chain within its category. After role, unresolved hops and path preference the
    order is precision, length, score where the preference is 0 or 2, else score, precision, length."""
    near = F.col("preference").isin(0, 2)
    tail = [F.when(near, F.col("n_hops")).otherwise(F.col("precision")), F.when(near, -F.col("score")).otherwise(F.col("n_hops")), F.col("chain_key")]
    met = chains.join(scored.select("chain_key", "score"), "chain_key").join(precise.select("chain_key", "precision"), "chain_key").withColumn("preference", preference)
    met = met.withColumn("role", F.when(F.col("sink_role") == "TERMINAL", 0).otherwise(1)).withColumn("first", F.when(near, F.col("precision")).otherwise(-F.col("score")))
    return positions(met, ["category"], ["role", "unresolved", "preference", "first"], tail, "position").select("category", "chain_key", "position")
