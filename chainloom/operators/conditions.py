"""Reasons to reject or annotate a chain by declarations, types, constraints and conditions of components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def undeclared(hops: DataFrame, resolved: DataFrame, provable: DataFrame) -> DataFrame:
    """(chain_key, reason): the first hop whose target is declared nowhere on its owner's superclass chain, where that chain is whole."""
    open_ = hops.join(resolved.select(F.col("owner").alias("to_owner"), F.col("name").alias("to_name")).distinct(), ["to_owner", "to_name"], "left_anti")
    sure = open_.join(provable.select(F.col("owner").alias("to_owner")).distinct(), "to_owner", "left_semi")
    return sure.groupBy("chain_key").agg(F.min(F.struct("ord", F.concat(F.lit("undeclared:"), "to_owner", F.lit("#"), "to_name").alias("r"))).alias("m")).select("chain_key", F.col("m.r").alias("reason"))


def type_breaks(hops: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chain_key, ord): the first hop whose value's type is neither at nor below, nor above, the type that takes it."""
    up = pairs.select(F.col("ancestor").alias("a"), F.col("descendant").alias("b"))
    typed = hops.where("value_type is not null and taken_type is not null and value_type <> taken_type")
    fits = up.select(F.col("a").alias("taken_type"), F.col("b").alias("value_type")).union(up.select(F.col("b"), F.col("a"))).distinct()
    return typed.join(fits, ["taken_type", "value_type"], "left_anti").groupBy("chain_key").agg(F.min("ord").alias("ord"))


def unserializable_fields(hops: DataFrame, serializable: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chain_key, reason): the first field flow whose declared type has no serialisable type at or below it."""
    fit = serializable.select(F.col("name").alias("field_type")).union(pairs.join(serializable.select(F.col("name").alias("descendant")), "descendant", "left_semi").select("ancestor")).distinct()
    bad = hops.where("kind = 'FIELD_FLOW' and field_type is not null").join(fit, "field_type", "left_anti")
    return bad.groupBy("chain_key").agg(F.min(F.struct("ord", F.concat(F.lit("not-serializable:"), "field_type").alias("r"))).alias("m")).select("chain_key", F.col("m.r").alias("reason"))


def contradictions(constraints: DataFrame, classes: DataFrame, pairs: DataFrame, least: int = 3) -> DataFrame:
    """(chain_key, reason): of chains with ``least`` field constraints or more, the first one between two
    classes, not interfaces, of which neither is below the other and that have no type below both."""
    own = classes.where("not interface").select("name").distinct()
    two = constraints.where("field_type <> source_type").select("field_type", "source_type").distinct()
    for c in ("field_type", "source_type"):
        two = two.join(own.select(F.col("name").alias(c)), c, "left_semi")
    named = two.select(F.explode(F.array("field_type", "source_type")).alias("ancestor")).distinct()
    reflexive = pairs.select("ancestor", "descendant").union(classes.select(F.col("name").alias("ancestor"), F.col("name").alias("descendant")))
    # A type below both covers the case that one is below the other. A type has few above it, however many
    # are below those, so pairs come from what is above each type; types with the same above them count once.
    above = reflexive.join(named, "ancestor", "left_semi").groupBy("descendant").agg(F.array_sort(F.collect_set("ancestor")).alias("above")).where(F.size("above") > 1).select("above").distinct()
    joint = above.select("above", F.explode("above").alias("field_type")).select("field_type", F.explode("above").alias("source_type")).distinct()
    bad = two.join(joint, ["field_type", "source_type"], "left_anti").withColumn("bad", F.lit(True))
    text = F.concat(F.lit("constraint-cycle:"), "field_type", F.lit("-x-"), "source_type")
    met = constraints.join(bad, ["field_type", "source_type"], "left")
    found = met.groupBy("chain_key").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("bad"), F.struct("ord", text.alias("r")))).alias("m"))
    return found.where((F.col("n") >= least) & F.col("m").isNotNull()).select("chain_key", F.col("m.r").alias("reason"))


def equals_guards(chains: DataFrame, hops: DataFrame, aliased: DataFrame, longer_than: int = 4) -> DataFrame:
    """(chain_key, note): long chains that call equals, whose entry compares an object with itself."""
    calls = hops.where((F.col("kind") == "DIRECT_CALL") & (F.col("to_name") == "equals")).select("chain_key").distinct()
    met = chains.where(F.col("n_hops") > longer_than).join(calls, "chain_key", "left_semi").join(aliased.select(F.col("method").alias("entry_method")).distinct(), "entry_method", "left_semi")
    return met.select("chain_key", F.lit("degrade:guard-equals").alias("note"))


def matched(paths: DataFrame, conditions: DataFrame, most: int = 10_000) -> DataFrame:
    """(chain_key, condition, spec, class): the classes on a chain's path that a condition is about.

    Conditions are a catalogue, checked before it is broadcast; classes meet it once each.
    """
    small = F.broadcast(conditions) if conditions.limit(most + 1).count() <= most else conditions
    hit = paths.select("class").distinct().join(small, F.regexp_like("class", F.concat(F.lit("^(?:"), "pattern", F.lit(")$"))))
    return paths.join(hit, "class").select("chain_key", "condition", "spec", "class").distinct()


def decide(found: DataFrame, serializable: DataFrame, guarded: DataFrame, boundary: DataFrame) -> DataFrame:
    """(chain_key, action, reason): the first condition, by name, that rejects a chain, else the first that makes it conditional.

    serializable: rejects a chain over a boundary if a class of its path isn't; guard: notes
    a chain over a boundary with a guarded class; class-name-guard: rejects such a chain.
    """
    met = found.join(boundary.select("chain_key").distinct(), "chain_key", "left_semi")
    plain = met.where("spec = 'serializable'").join(serializable.select(F.col("name").alias("class")), "class", "left_anti").withColumn("action", F.lit("REJECT"))
    watched = met.where("spec in ('guard', 'class-name-guard')").join(guarded.select(F.col("name").alias("class")).distinct(), "class", "left_semi").withColumn("action", F.when(F.col("spec") == "guard", "NOTE").otherwise("REJECT"))
    both = plain.unionByName(watched).withColumn("reason", F.concat_ws(":", F.concat(F.lit("condition-"), "spec"), "condition", "class"))
    first = F.min(F.struct(F.when(F.col("action") == "REJECT", 0).otherwise(1).alias("o"), "condition", "class", "action", "reason"))
    return both.groupBy("chain_key").agg(first.alias("m")).select("chain_key", F.col("m.action").alias("action"), F.col("m.reason").alias("reason"))


def untrusted(paths: DataFrame, serializable: DataFrame, trusted: list[str]) -> DataFrame:
    """(chain_key, reason): the first class of a path, in its order, that is serialisable and lies in no trusted package."""
    fine = F.lit(False)
    for prefix in trusted:
        fine = fine | F.startswith("class", F.lit(prefix))
    bad = paths.where(~fine).join(serializable.select(F.col("name").alias("class")), "class", "left_semi")
    return bad.groupBy("chain_key").agg(F.min(F.struct("ord", "class")).alias("m")).select("chain_key", F.concat(F.lit("condition-package-policy:"), F.col("m.class")).alias("reason"))


def machinery(hops: DataFrame, internals: list[str]) -> DataFrame:
    """(chain_key, reason): chains that lead through an owner of the runtime's own machinery."""
    inside = F.lit(False)
    for prefix in internals:
        inside = inside | F.startswith("from_owner", F.lit(prefix)) | F.startswith("to_owner", F.lit(prefix))
    return hops.where(inside).select("chain_key", F.lit("machinery").alias("reason")).distinct()


def fronts(hops: DataFrame) -> DataFrame:
    """(chain_key, fields, dynamic, reflective, fragment): what a front chain has, for the choice of its bridges."""
    has = lambda c: (F.max(F.when(c, 1).otherwise(0)) == 1)
    kind: Column = F.col("kind")
    return hops.groupBy("chain_key").agg(has(kind == "FIELD_FLOW").alias("fields"), has(kind == "VIRTUAL_DISPATCH").alias("dynamic"), has(kind == "NATIVE_CALLBACK").alias("reflective"), has(F.startswith("reason", F.lit("model:"))).alias("modelled"))


def key_slots(containers: DataFrame, entries: DataFrame, pairs: DataFrame, ordered: tuple[str, ...], comparable: str) -> DataFrame:
    """(container, entry, accepts): whether a container may hold an entry class as key; ordered ones ask for a comparable class."""
    fit = pairs.where(F.col("ancestor") == comparable).select(F.col("descendant").alias("entry"), F.lit(True).alias("fit")).distinct()
    met = containers.join(entries, "region").join(fit, "entry", "left")
    return met.select("container", "entry", (~F.col("container").isin(*ordered) | F.coalesce("fit", F.lit(False)) | (F.col("entry") == comparable)).alias("accepts")).distinct()


def container_fields(fields: DataFrame) -> DataFrame:
    """(type, owner, field): fields by their declared type and by the types of its arguments."""
    return fields.select(F.explode(F.array_distinct(F.concat(F.array("type"), F.coalesce("arguments", F.array().cast("array<string>"))))).alias("type"), "owner", "field").distinct()
