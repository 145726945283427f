"""Declarative rules: matching, specificity, the best rule, risk and safe configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST_INPUT, MOST_WORK = 16_384, 4_000_000


def matches(value: Column, mode: Column, pattern: Column) -> Column:
    """Literal equality, or a pattern that must match as a whole.

    Null never matches, nor does a pattern on an input that is too long or too much work.
    """
    small = (F.length(value) <= LONGEST_INPUT) & (F.length(value) * F.length(pattern) <= MOST_WORK)
    anchored = F.concat(F.lit("^(?:"), pattern, F.lit(")$"))
    return F.coalesce(F.when(mode == "exact", value == pattern).otherwise(small & F.regexp_like(value, anchored)), F.lit(False))


def owner_score(mode: Column, same: Column) -> Column:
    """100 for the type itself, 40 for one below it, 20 by pattern; 16 more for a literal, 1 for a pattern."""
    return F.when(mode == "regex", 21).when(same, 116).otherwise(56)


def name_score(mode: Column) -> Column:
    return F.when(mode == "exact", 16).otherwise(2)


def _descriptor(value: Column, wanted: Column) -> tuple[Column, Column]:
    """Whether a descriptor fits a literal or a ~pattern, which null always does, and what that adds to the score."""
    pattern = F.startswith(wanted, F.lit("~"))
    fits = wanted.isNull() | F.when(pattern, matches(value, F.lit("regex"), F.expr("substring(descriptor_pat, 2)"))).otherwise(F.coalesce(value == wanted, F.lit(False)))
    return fits, F.when(wanted.isNull(), 0).when(pattern, 2).otherwise(12)


def scores(sites: DataFrame, rules: DataFrame, pairs: DataFrame) -> DataFrame:
    """(method, rule_id, score, ...) of every rule that matches.

    A literal owner matches its own type, and in mode subtype all that ``pairs``, the closure of
    the hierarchy, puts below it; both are equi-joins on the types at or above a site's owner. Patterns are a
    catalogue of some hundreds of rows, checked before they are broadcast. Sites are
    deduplicated by their text first.
    """
    if "descriptor" not in rules.columns:
        rules = rules.withColumn("descriptor", F.lit(None).cast("string"))
    if "descriptor" not in sites.columns:
        sites = sites.withColumn("descriptor", F.lit(None).cast("string"))
    own = rules.withColumnRenamed("descriptor", "descriptor_pat")
    kinds = sites.select("owner", "name", "descriptor").distinct()
    owners = kinds.select("owner").distinct()
    above = owners.withColumn("owner_pat", F.col("owner")).withColumn("same", F.lit(True)).unionByName(pairs.select(F.col("descendant").alias("owner"), F.col("ancestor").alias("owner_pat")).distinct().withColumn("same", F.lit(False)))
    literal = above.join(own.where("owner_mode <> 'regex'"), "owner_pat").where("same or owner_mode = 'subtype'").join(owners, "owner", "left_semi")
    patterns = own.where("owner_mode = 'regex'")
    small = F.broadcast(patterns) if patterns.limit(10_001).count() <= 10_000 else patterns
    by_pattern = owners.join(small, matches(F.col("owner"), F.col("owner_mode"), F.col("owner_pat"))).withColumn("same", F.lit(False))
    hit = kinds.join(literal.unionByName(by_pattern), "owner").where(matches(F.col("name"), F.col("name_mode"), F.col("name_pat")))
    fits, more = _descriptor(F.col("descriptor"), F.col("descriptor_pat"))
    score = owner_score(F.col("owner_mode"), F.col("same")) + name_score(F.col("name_mode")) + more
    scored = hit.where(fits).select("owner", "name", "descriptor", "rule_id", score.alias("score"), "role", "category", "severity").distinct()
    met = sites.join(scored, (sites.owner == scored.owner) & (sites.name == scored.name) & sites.descriptor.eqNullSafe(scored.descriptor))
    return met.select("method", "rule_id", "score", "role", "category", "severity")


def best_rule(scored: DataFrame) -> DataFrame:
    """The highest score, the lower rule id of equal ones."""
    order = Window.partitionBy("method").orderBy(F.desc("score"), "rule_id")
    return scored.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def sink_risk(category: Column, severity: Column, owner: Column) -> Column:
    """HIGH where severity or the owner says so, CONTROLLED for what needs a path or a name, else SAFE."""
    inferred = F.when((severity == "HIGH") | F.lower(owner).contains("runtime"), "HIGH").when(category.isin("file", "lookup"), "CONTROLLED").otherwise("SAFE")
    return inferred


def lint(rules: DataFrame) -> DataFrame:
    """Problems of a rule set: repeated ids, and matchers that another rule of lower id repeats."""
    ids = rules.groupBy("rule_id").count().where("count > 1").select(F.lit("DUPLICATE_ID").alias("code"), "rule_id")
    same = Window.partitionBy("owner_pat", "owner_mode", "name_pat", "name_mode").orderBy("rule_id")
    shadowed = rules.withColumn("rn", F.row_number().over(same)).where("rn > 1").select(F.lit("SHADOWED").alias("code"), "rule_id")
    return ids.union(shadowed)


def safe_before_use(calls: DataFrame, safe: Column, use: Column) -> DataFrame:
    """Hosts whose first safe call stands before their first use; a host without one is never suppressed."""
    first = calls.groupBy("host").agg(F.min(F.when(safe, F.col("pos"))).alias("safe_at"), F.min(F.when(use, F.col("pos"))).alias("use_at"))
    return first.where("use_at is not null").select("host", "safe_at", "use_at", F.coalesce(F.col("safe_at") < F.col("use_at"), F.lit(False)).alias("suppressed"))


def model_flow(facts: DataFrame, calls: DataFrame, actions: DataFrame) -> DataFrame:
    """One step of declarative summaries: what flows from a tainted argument or receiver of a modelled call."""
    return calls.join(actions, "kind").join(facts.select(F.col("node").alias("host"), F.col("slot").alias("source")), ["host", "source"], "left_semi").select("host", "pos", "target").distinct()
