"""Reports: admission, eligibility, audits, run differences, baselines, gates and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gates(checks: list[tuple[Column, str]], passed: str) -> Column:
    """The reason of the first check that fails, in order."""
    out = F.lit(passed)
    for ok, reason in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), reason).otherwise(out)
    return out


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chain_key, change) by a full outer join on identity and a comparison of fingerprints."""
    a, b = old.select("chain_key", F.col("fingerprint").alias("before")), new.select("chain_key", F.col("fingerprint").alias("after"))
    change = F.when(F.col("before").isNull(), "ADDED").when(F.col("after").isNull(), "REMOVED").when(F.col("before") != F.col("after"), "CHANGED").otherwise("UNCHANGED")
    return a.join(b, "chain_key", "full_outer").select("chain_key", change.alias("change"))


def baseline(old: DataFrame, new: DataFrame, suppressed: DataFrame) -> DataFrame:
    """(chain_key, status) of a run against a baseline and a list of suppressed identities."""
    hit = suppressed.select("chain_key", F.lit(True).alias("hit")).distinct()
    both = new.select("chain_key", F.lit(True).alias("now")).join(old.select("chain_key", F.lit(True).alias("was")), "chain_key", "full_outer").join(hit, "chain_key", "left")
    status = F.when(F.col("now").isNull(), "REMOVED").when(F.col("hit"), F.when(F.col("was"), "SUPPRESSED_KNOWN").otherwise("SUPPRESSED_NEW")).when(F.col("was"), "UNCHANGED").otherwise("NEW")
    return both.select("chain_key", status.alias("status"))


def audit(hops: DataFrame) -> DataFrame:
    """(chain_key, ord, issues): what each hop leaves open, as codes in order."""
    codes = F.array(
        F.when(F.coalesce(F.trim("descriptor"), F.lit("")) == "", "BLANK_DESCRIPTOR"),
        F.when((F.col("kind") == "FIELD_FLOW") & F.col("field").isNull(), "FIELD_UNKNOWN"),
        F.when(F.col("kind") == "NATIVE_CALLBACK", "NATIVE"),
        F.when(F.startswith("reason", F.lit("model:")), "MODELLED"),
    )
    return hops.select("chain_key", "ord", F.concat_ws(",", F.filter(codes, lambda c: c.isNotNull())).alias("issues"))


def percentiles(samples: DataFrame, by: str, value: str, limits: tuple[int, int]) -> DataFrame:
    """Nearest-rank median and 95th percentile, and whether both keep their limits; nothing passes without samples."""
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")
    out = samples.groupBy(by).agg(at(0.5).cast("long").alias("p50"), at(0.95).cast("long").alias("p95"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("passed", F.coalesce((F.col("p50") <= limits[0]) & (F.col("p95") <= limits[1]), F.lit(False)))


def outcome(chains: Column, unresolved: Column, bounded: Column) -> Column:
    return F.when(chains == 0, "UNKNOWN").when((unresolved > 0) | bounded, "PARTIAL").otherwise("COMPLETE")


def duplicate_owners(members: DataFrame) -> DataFrame:
    """(sha, owner, losers): contents held by several owners, the first of them in order and how many others."""
    return members.where("sha is not null").groupBy("sha").agg(F.min("owner").alias("owner"), (F.countDistinct("owner") - 1).alias("losers")).where("losers > 0")


def inventory(members: DataFrame) -> DataFrame:
    """(owner, classes, distinct_classes, digest): counts and a digest that doesn't depend on row order.

    The digest of an owner is that of the sorted digests of 256 buckets of its members, so
    only short lists are gathered for it, whatever an owner's share of the rows.
    """
    bucketed = members.groupBy("owner", F.substring("sha", 1, 2).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sha").alias("d"), F.sum(F.conv(F.substring("sha", 3, 12), 16, 10).cast("decimal(38,0)")).alias("s"))
    line = F.concat_ws(":", "bucket", F.col("n").cast("string"), F.col("s").cast("string"))
    return bucketed.groupBy("owner").agg(F.sum("n").alias("classes"), F.sum("d").alias("distinct_classes"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(line))), 256).alias("digest"))
