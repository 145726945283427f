"""What reports say of chains: decompositions, ranks, construction, priorities, atoms and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chains import PATTERN_BONUS, entry_weight, shown

#: Fixed scores of kinds of entries that something else must trigger.
TRIGGER_SCORES = {"hashCode": 12, "equals": 10, "compareTo": 8, "compare": 7, "toString": 5}
SEVERITY_SCORES = {"CRITICAL": 16, "HIGH": 8, "MEDIUM": 2}
UNSURE = ("TRUNCATED", "TOO_LONG", "UNRESOLVED", "NO_STATE")


def _by(c: Column, scores: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, score in scores.items():
        out = F.when(c == name, score).otherwise(out)
    return F.coalesce(out, F.lit(0))


def decomposition(chains: DataFrame, hops: DataFrame, notes: DataFrame) -> DataFrame:
    """(chain_key, evidence): hops by kind with what they add, the entry's weight, severity, unresolved hops and patterns, as text."""
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0))
    named = F.array_sort(F.collect_list(F.when((F.col("kind") == "FIELD_FLOW") & F.col("field").isNotNull(), F.struct("ord", "field"))))
    counted = hops.groupBy("chain_key").agg(n("DIRECT_CALL").alias("d"), n("VIRTUAL_DISPATCH").alias("v"), n("NATIVE_CALLBACK").alias("c"), n("FIELD_FLOW").alias("f"), F.array_join(F.transform(named, lambda x: x["field"]), ",").alias("fields"))
    found = notes.where(F.startswith("note", F.lit("pattern:"))).groupBy("chain_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.expr("substring(note, 9)"))), lambda x: F.concat(F.lit(";pattern:"), x, F.lit(f"+{PATTERN_BONUS}"))), "").alias("patterns"))
    met = chains.join(counted, "chain_key").join(found, "chain_key", "left")
    text = F.concat(
        F.format_string("hops:direct=%d+%d,virtual=%d+0,native=%d+0,field=%d+%d", "d", "d", "v", "c", "f", "f"),
        F.when(F.col("fields") != "", F.concat(F.lit("("), "fields", F.lit(")"))).otherwise(""),
        F.format_string(";entry:%s+%d", F.coalesce("entry_kind", F.lit("?")), entry_weight(F.col("entry_kind"))),
        F.when(F.col("severity") == "HIGH", ";sev:HIGH+1").otherwise(""),
        F.when(F.col("unresolved") > 0, F.format_string(";unresolved:%d-%d", F.col("unresolved"), 2 * F.col("unresolved"))).otherwise(""),
        F.coalesce("patterns", F.lit("")),
    )
    return met.select("chain_key", text.alias("evidence"))


def semantic_rank(hops: DataFrame) -> DataFrame:
    """(chain_key, semantic_rank): 0 if a fragment was activated by call and by deserialization over a nested bridge, 1 without the deserialization, else 2."""
    has = lambda c: F.max(F.when(c, 1).otherwise(0)) == 1
    r = F.col("reason")
    flags = hops.groupBy("chain_key").agg(has(r == "fragment-activation-invoke").alias("i"), has(r == "fragment-activation-deserialize").alias("d"), has((r == "bridge-deser") | F.startswith(r, F.lit("bridge-second-deserialization"))).alias("b"))
    return flags.select("chain_key", F.when(F.col("i") & F.col("d") & F.col("b"), 0).when(F.col("i") & F.col("b"), 1).otherwise(2).alias("semantic_rank"))


def frontier_quality(hops: DataFrame, platform, triggers: tuple[str, ...], serial: tuple[str, ...]) -> DataFrame:
    """(chain_key, quality): a path's worth by its hops; ``platform`` tells whether an owner belongs to the runtime."""
    r, a, b = F.col("reason"), F.col("from_owner"), F.col("to_owner")
    trigger = F.col("to_name").isin(*triggers)
    each = (
        F.when(r.isin("serialized-proxy-handler", "serialized-proxy-interface"), 100).otherwise(0) - F.when((F.col("kind") == "ENTRY") & (r == "proxyInvoke"), 10).otherwise(0)
        + F.when(trigger, 4 + F.when(platform(a) & ~platform(b), 24).when((a == "java/lang/Object") & ~platform(b), 12).otherwise(0)).otherwise(0)
        + F.when(r == "serialized-field", 2).when(F.startswith(r, F.lit("method-collection")), F.when(r.contains("-exact"), 1).otherwise(-1)).otherwise(0)
    )
    first = F.min_by(F.struct(a.alias("owner"), r.alias("reason")), F.when(F.col("kind") == "ENTRY", F.col("ord")))
    out = hops.groupBy("chain_key").agg(F.sum(each).alias("sum"), first.alias("entry"))
    bonus = F.when(platform(F.col("entry.owner")) & F.col("entry.reason").isin(*serial), 8).otherwise(0)
    return out.select("chain_key", (F.col("sum") + F.coalesce(bonus, F.lit(0))).cast("long").alias("quality"))


def plan_shape(fields: DataFrame) -> DataFrame:
    """(plan, nodes, fields, references, resolved, owners_unresolved, valid, fingerprint) of construction plans.

    ``fields`` has a row per assignment: plan, node, field, target (null: a value), owner_known. A reference is
    resolved if its target is a node of the plan; a plan whose references all are is valid.
    """
    nodes = fields.select("plan", F.col("node").alias("target")).distinct().withColumn("there", F.lit(1))
    line = F.concat_ws(":", shown("node"), shown("field"), shown("target"))
    out = fields.join(nodes, ["plan", "target"], "left").groupBy("plan").agg(
        F.countDistinct("node").alias("nodes"), F.count("field").alias("fields"), F.count("target").alias("references"), F.count("there").alias("resolved"),
        F.sum(F.when(F.col("field").isNotNull() & ~F.col("owner_known"), 1).otherwise(0)).alias("owners_unresolved"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(line))), 256).alias("fingerprint"),
    )
    return out.withColumn("valid", F.col("references") == F.col("resolved"))


def construction(chains: DataFrame, shapes: DataFrame) -> DataFrame:
    """(chain_key, type_status, field_status, trigger_status, control_status, overall): how much of a chain's object could be built."""
    met = chains.join(shapes.withColumnRenamed("fields", "n_fields"), "plan", "left")
    none, bad = F.col("plan").isNull(), ~F.coalesce(F.col("valid"), F.lit(False))
    kind = F.when(none, "NOT_DECLARED").when(bad, "PARTIAL").otherwise("DECLARED_SHAPE")
    fields = F.when(none, "NOT_DECLARED").when(bad | (F.col("owners_unresolved") > 0), "PARTIAL").when(F.col("n_fields") == 0, "NO_FIELD_ASSIGNMENTS").otherwise("DECLARED_ASSIGNMENTS")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    trigger = F.when((F.col("n_hops") > 0) & ~blank("entry_class"), "STATIC_PATH_ONLY").otherwise("NOT_PROVEN")
    control = F.when(F.col("sink_role") != "TERMINAL", "CAPABILITY_ONLY").when(blank("sink_descriptor") | (F.col("unresolved") > 0) | (F.col("n_hops") == 0), "STATIC_UNCERTAIN").otherwise("STATIC_ARGUMENT_FLOW")
    overall = F.when((kind == "PARTIAL") | (fields == "PARTIAL") | (F.col("unresolved") > 0) | F.coalesce("degraded", F.lit(False)), "PARTIAL").when(~none, "DECLARED").otherwise("NOT_EVALUATED")
    return met.select("chain_key", kind.alias("type_status"), fields.alias("field_status"), trigger.alias("trigger_status"), control.alias("control_status"), overall.alias("overall"))


def high_confidence(assessed: DataFrame) -> DataFrame:
    """Chains without unresolved hops whose assessment is complete and known in every respect."""
    known = lambda c, *also: ~F.coalesce(F.col(c), F.lit("UNKNOWN")).isin("UNKNOWN", *also)
    return assessed.where((F.col("unresolved") == 0) & (F.col("completeness") == "COMPLETE") & known("control") & known("dispatch") & known("flow") & known("construction", "PARTIAL", "PLAN_PARTIAL")).select("chain_key")


def trigger_priority(primary: Column, entry_kind: Column, fragment: Column, unresolved: Column) -> Column:
    """Of chains that a container may trigger: application classes, then by kind, fragments and certainty."""
    return F.when(primary, 32).otherwise(0) + _by(entry_kind, TRIGGER_SCORES) + F.when(fragment, 8).otherwise(0) + F.when(unresolved == 0, 4).otherwise(0)


def terminal_priority(terminal: Column, unresolved: Column, severity: Column, n_hops: Column) -> Column:
    """Of suffixes to join: those that end in an effect, certain, severe and short."""
    return F.when(terminal, 1256).otherwise(0) + F.when(unresolved == 0, 32).otherwise(0) + _by(severity, SEVERITY_SCORES) - F.least(F.lit(128), n_hops)


def semantic_identity(findings: DataFrame, fields: list[str]) -> DataFrame:
    """``findings`` with the joined ``identity`` of the fields and its SHA-256."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields))
    return findings.withColumn("identity", text).withColumn("variant", F.sha2("identity", 256))


def atoms(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``rows`` with ``atom``: a name from the canonical JSON of the fields, keys in order and nulls left out."""
    return rows.withColumn("atom", F.concat(F.lit("atom-"), F.sha2(F.to_json(F.struct(*sorted(fields))), 256)))


def graph_digest(edges: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """(by, edges, loose, digest) of evidence graphs: how many edges lack a node at an end, and a digest of
    distinct edges that doesn't depend on their order; sums of hashes, so no graph is gathered in one row."""
    known = nodes.select(by, "node").distinct()
    at = lambda end: known.select(by, F.col("node").alias(end), F.lit(1).alias(f"has_{end}"))
    met = edges.select(by, "src", "dst", "type").distinct().join(at("src"), [by, "src"], "left").join(at("dst"), [by, "dst"], "left")
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", "src", "dst", "type"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    loose = F.when(F.col("has_src").isNull() | F.col("has_dst").isNull(), 1).otherwise(0)
    return met.groupBy(by).agg(F.count(F.lit(1)).alias("edges"), F.sum(loose).alias("loose"), F.sum(h).cast("string").alias("digest"))


def proof_completeness(chains: DataFrame, verdicts: DataFrame, bounded: bool) -> DataFrame:
    """One row, completeness: NO_SURVIVING_CHAIN, PARTIAL if a hop, a sink's verdict or a bound leaves something open, else COMPLETE."""
    c = chains.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("unresolved") > 0, 1).otherwise(0)).alias("open"))
    v = verdicts.agg(F.max(F.when(F.col("verdict").isin(*UNSURE), 1).otherwise(0)).alias("unsure"))
    both = c.join(v, F.lit(True))  # one row each
    return both.select(F.when(F.col("n") == 0, "NO_SURVIVING_CHAIN").when((F.coalesce("open", F.lit(0)) == 1) | (F.coalesce("unsure", F.lit(0)) == 1) | F.lit(bounded), "PARTIAL").otherwise("COMPLETE").alias("completeness"))


def completeness_of(scopes: DataFrame, chains: DataFrame, verdicts: DataFrame, bounds: DataFrame) -> DataFrame:
    """(scope, completeness) as ``proof_completeness`` says it, for each of ``scopes`` (scope) by what it has of
    ``chains`` (scope, unresolved), ``verdicts`` (scope, verdict) and met ``bounds`` (scope)."""
    c = chains.groupBy("scope").agg(F.max((F.col("unresolved") > 0).cast("int")).alias("open"))
    v = verdicts.groupBy("scope").agg(F.max(F.col("verdict").isin(*UNSURE).cast("int")).alias("unsure"))
    met = scopes.select("scope").distinct().join(c, "scope", "left").join(v, "scope", "left").join(bounds.select("scope", F.lit(1).alias("bound")).distinct(), "scope", "left")
    left = F.greatest(F.col("open"), F.coalesce("unsure", F.lit(0)), F.coalesce("bound", F.lit(0)))
    return met.select("scope", F.when(F.col("open").isNull(), "NO_SURVIVING_CHAIN").when(left == 1, "PARTIAL").otherwise("COMPLETE").alias("completeness"))


def stable(samples: DataFrame, by: str, measured: list[str]) -> DataFrame:
    """(by, runs, stable): whether all runs agree in everything measured; nothing is stable without runs."""
    same = [F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit("<null>"))) == 1 for c in measured]
    out = same[0]
    for s in same[1:]:
        out = out & s
    return samples.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), out.alias("stable"))


def overhead(samples: DataFrame, by: str, base: Column, own: Column, most: float) -> DataFrame:
    """(by, ratio, status): mean time with evidence against without; NO_BASE where there is nothing to compare with."""
    out = samples.groupBy(by).agg(F.avg(F.when(own, F.col("value"))).alias("own"), F.avg(F.when(base, F.col("value"))).alias("base"))
    ratio = F.round(F.col("own") / F.col("base"), 6)
    status = F.when(F.col("base").isNull() | (F.col("base") <= 0), "NO_BASE").when(F.col("own").isNull(), "NO_SAMPLE").when(ratio <= most, "WITHIN").otherwise("ABOVE")
    return out.select(by, F.when(F.col("base") > 0, ratio).alias("ratio"), status.alias("status"))
