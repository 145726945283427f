"""Calibration: reasons to reject or annotate a chain; the first reason by priority stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chains import TRIGGERS, missing_evidence
from .fixpoint import positions

DEEP, MOST_DYNAMIC = 14, 40
DYNAMIC = ("VIRTUAL_DISPATCH", "FIELD_FLOW", "NATIVE_CALLBACK")


def without_trigger(chains: DataFrame, reached: DataFrame) -> DataFrame:
    """Chains whose entry only runs if something calls it, and whose class nothing reaches."""
    return chains.where(F.col("entry_kind").isin(*TRIGGERS)).join(reached.select(F.col("owner").alias("entry_class")).distinct(), "entry_class", "left_anti").select("chain_key", F.lit("no-trigger").alias("reason"))


def deep(chains: DataFrame, hops: DataFrame, most: int = DEEP) -> DataFrame:
    """Chains of more than ``most`` hops of which field flows are less than a sixth."""
    flows = hops.groupBy("chain_key").agg(F.sum(F.when(F.col("kind") == "FIELD_FLOW", 1).otherwise(0)).alias("flows"))
    return chains.join(flows, "chain_key").where((F.col("n_hops") > most) & (F.col("flows") * 6 < F.col("n_hops"))).select("chain_key", F.lit("deep-incoherent").alias("reason"))


def same_mechanism(chains: DataFrame, scored: DataFrame, by: list[str]) -> DataFrame:
    """All but the first of the chains that share a mechanism: least unresolved, fewest hops, best score, first key."""
    order = Window.partitionBy(*by).orderBy("unresolved", "n_hops", F.desc("score"), "chain_key")
    met = chains.join(scored.select("chain_key", "score"), "chain_key")
    return met.withColumn("rn", F.row_number().over(order)).where("rn > 1").select("chain_key", F.lit("mechanism-duplicate").alias("reason"))


def cascade(chains: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """(chain_key, reason): the reason of the first step, in order, that has one; null if none has."""
    out, names = chains.select("chain_key"), []
    for i, step in enumerate(steps):
        names.append(f"r{i}")
        out = out.join(step.groupBy("chain_key").agg(F.min("reason").alias(f"r{i}")), "chain_key", "left")
    return out.select("chain_key", F.coalesce(*names).alias("reason"))


def broken_type_flow(hops: DataFrame, kind_of: Column, fits: Column) -> DataFrame:
    """(chain_key, ord): the first hop, from the sink, whose target's kind doesn't fit what its caller may call."""
    bad = hops.withColumn("to_kind", kind_of).where(~fits)
    return bad.groupBy("chain_key").agg(F.min("ord").alias("ord"))


def patterns(paths: DataFrame, required: DataFrame) -> DataFrame:
    """(chain_key, pattern): the first pattern of which every prefix begins some element of the path.

    Relational division: distinct required prefixes met are counted against those required.
    """
    need = required.groupBy("pattern").agg(F.countDistinct("prefix").alias("need"))
    small = F.broadcast(required.join(need, "pattern")) if required.limit(10_001).count() <= 10_000 else required.join(need, "pattern")
    met = paths.join(small, F.startswith(paths.element, F.col("prefix"))).groupBy("chain_key", "pattern", "need").agg(F.countDistinct("prefix").alias("got"))
    return met.where("got = need").groupBy("chain_key").agg(F.min("pattern").alias("pattern"))


def verdict(found: Column, truncated: Column, too_long: Column, unresolved: Column) -> Column:
    """Of a sink's backward search."""
    return F.when(found > 0, "CHAIN").when(truncated, "TRUNCATED").when(too_long, "TOO_LONG").when(unresolved > 0, "UNRESOLVED").otherwise("NO_PATH")


def fair_budget(sinks: DataFrame, total: int, least: int = 2048, most: int = 200_000) -> DataFrame:
    """(sink, budget): the least for everyone, the rest spread evenly in order of depth and name.

    The position comes from counts per depth and beginning of the name and a window within
    each of these, so no window holds all sinks of a depth.
    """
    n = F.lit(int(sinks.count() or 1))
    placed = positions(sinks.withColumn("_start", F.substring("sink", 1, 4)), [], ["depth", "_start"], ["sink"], "at").withColumn("at", F.col("at") - 1)
    first = F.least(F.lit(least), F.floor(F.lit(total) / n))
    extra = F.lit(total) - first * n
    share = F.floor(extra / n) + F.when(F.col("at") < F.pmod(extra, n), 1).otherwise(0)
    return placed.select("sink", F.least(F.lit(most), first + share).cast("long").alias("budget"))


def missing(hops: DataFrame) -> DataFrame:
    return missing_evidence(hops).where("missing > 0").select("chain_key", F.lit("missing-evidence").alias("reason"))
