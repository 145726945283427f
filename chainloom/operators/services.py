"""What a program offers to the outside: HTTP contexts and handlers, service endpoints, filters before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOAP = "SOAP/CXF"
RANKS = ("NOT_PRESENT", "UNKNOWN", "DOES_NOT_DOMINATE", "DOMINATES")


def http_sites(registrations: DataFrame, lambdas: DataFrame, allocated: DataFrame, handlers: DataFrame) -> DataFrame:
    """(host, pos, path, handler, via): registrations of contexts with the method that answers.

    A handler value is a lambda, whose implementation answers, or an allocated object, whose
    class must be a handler type; others have no handler.
    """
    made = allocated.join(handlers.select(F.col("name").alias("type")).distinct(), "type", "left_semi").select("value", F.concat(F.col("type"), F.lit("#handle")).alias("made"))
    met = registrations.join(lambdas.select("value", F.col("implementation").alias("lambda")), "value", "left").join(made, "value", "left")
    return met.select("host", "pos", "path", F.coalesce("lambda", "made").alias("handler"), F.when(F.col("lambda").isNotNull(), "lambda").when(F.col("made").isNotNull(), "allocated").otherwise("unknown").alias("via"))


def endpoints(facts: DataFrame) -> DataFrame:
    """(host, pos, address, bean): publications of services with the last address and the last
    implementation that were set before them in their method."""
    before = Window.partitionBy("host").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda kind: F.last(F.when(F.col("fact") == kind, F.col("value")), ignorenulls=True).over(before)
    return facts.withColumn("address", last("address")).withColumn("bean", last("bean")).where("fact = 'publish'").select("host", "pos", "address", "bean")


def _path(c: Column) -> Column:
    """With one slash before it and none behind."""
    bare = F.regexp_replace(F.coalesce(F.trim(c), F.lit("")), "^/+|/+$", "")
    return F.when(bare == "", "").otherwise(F.concat(F.lit("/"), bare))


def filter_verdicts(offered: DataFrame, controls: DataFrame) -> DataFrame:
    """(endpoint, verdict): whether the filters before an endpoint stop its calls.

    ``offered`` has endpoint, route, protocol; ``controls`` prefix, blocked_path, blocked_method,
    passes, ord. Of the filters over the route the first that decides counts: one that blocks the route dominates; one
    that blocks its own prefix and passes the rest doesn't, but for SOAP, which is stopped
    where POST is. No filters at all: NOT_PRESENT; none that decides: UNKNOWN.
    """
    any_ = controls.limit(1).count() > 0
    c = controls.select(_path(F.col("prefix")).alias("prefix"), _path(F.col("blocked_path")).alias("blocked"), F.upper(F.coalesce(F.trim("blocked_method"), F.lit(""))).alias("method"), "passes", "ord")
    route = _path(F.col("route"))
    o = offered.withColumn("route", route)
    # A route meets the prefixes that it begins with, segment by segment: an equi-join.
    parts = F.split(F.substring(F.col("route"), 2, 100_000), "/")
    starts = F.when(F.col("route") != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    met = o.withColumn("prefix", F.explode(starts)).join(c, "prefix")
    soap = F.col("protocol") == SOAP
    decided = (
        F.when(F.col("blocked") == F.col("route"), "DOMINATES").when((F.col("blocked") != F.col("prefix")) | ~F.col("passes"), F.lit(None))
        .when((F.col("method") == "") | soap & (F.col("method") == "GET"), "DOES_NOT_DOMINATE").when(soap & (F.col("method") == "POST"), "DOMINATES")
    )
    first = met.withColumn("decided", decided).where("decided is not null").groupBy("endpoint").agg(F.min_by("decided", F.struct("ord", "prefix")).alias("decided"))
    return offered.select("endpoint").distinct().join(first, "endpoint", "left").select("endpoint", F.coalesce("decided", F.lit("UNKNOWN" if any_ else "NOT_PRESENT")).alias("verdict"))


def merged_verdict(verdicts: DataFrame, by: str) -> DataFrame:
    """(by, verdict): the strongest verdict of several."""
    rank = F.array_position(F.array(*(F.lit(r) for r in RANKS)), F.col("verdict"))
    return verdicts.groupBy(by).agg(F.max_by("verdict", rank).alias("verdict"))


def axes(rules: DataFrame) -> DataFrame:
    """(rule_id, axes): what a rule says of capability, boundary and terminal effect, as sorted names."""
    found = F.array(
        F.when(F.col("role") == "TERMINAL", F.concat(F.lit("terminal:"), "category")),
        F.when(F.col("role") == "CAPABILITY", F.concat(F.lit("capability:"), "category")),
        F.when(F.col("category").isin("reflection", "bean"), F.lit("bridge:invoke")),
        F.when(F.col("category").isin("lookup", "network"), F.lit("boundary:remote")),
        F.when(F.col("severity") == "HIGH", F.lit("risk:high")),
    )
    return rules.select("rule_id", F.array_join(F.array_sort(F.filter(found, lambda x: x.isNotNull())), ",").alias("axes"))
