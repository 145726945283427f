"""Scans, run differences and performance gates as functions and as a command.

``python -m chainloom.plans.scan scan INPUT --rules RULES --output OUT`` reads archives,
follows values from application entries to the sinks of a rule catalogue and commits findings,
evidence of each entry, problems and metadata as a whole, with the changes against an earlier output if
``--baseline`` names one; ``diff OLD NEW`` compares two outputs; ``performance`` times a scan. Exit codes: 0
whole, 2 partial, 3 unknown (no finding can be ruled in or out), 1 a failed gate or a change.
"""

from __future__ import annotations

import argparse
import sys
import time
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import constants, dynamic, entries, fixpoint, heapfacts, hierarchy, matched, pointsto, report, rules, valueflow
from ..session import cut, ship
from ..sources import archive, catalogue, classfile, reports

#: Edges of a path, and paths that an entry keeps to a place.
ROUNDS, ALTERNATIVES = 20, 8
EXIT = {"COMPLETE": 0, "PARTIAL": 2, "UNKNOWN": 3}


class Scan(NamedTuple):
    findings: DataFrame  # chain_key, fingerprint, rule_id, category, severity, entry, sink, hops, path
    entries: DataFrame
    problems: DataFrame
    outcome: str
    reasons: list[str]


def dispatch(inputs: DataFrame, methods: DataFrame, pairs: DataFrame) -> DataFrame:
    """(target, callee): for virtual and interface calls the same method of every type at or below the named one, as
    far as it may be overridden; for others, and where nothing is loaded, nothing."""
    called = inputs.where("op in ('INVOKEVIRTUAL', 'INVOKEINTERFACE')").select("target").distinct().withColumn("owner", F.substring_index("target", "#", 1)).withColumn("signature", F.substring_index("target", "#", -1))
    below = pairs.select(F.col("ancestor").alias("owner"), F.col("descendant").alias("at")).union(called.select("owner", F.col("owner").alias("at")).distinct())
    own = methods.select(F.col("owner").alias("at"), F.concat("name", "descriptor").alias("signature"), F.col("method").alias("callee"), "access")
    met = called.join(below, "owner").join(own, ["at", "signature"])
    return met.where((F.col("at") == F.col("owner")) | hierarchy.overridable(F.col("access"), F.lit(True))).where(~hierarchy.has(F.col("access"), 0x400)).select("target", "callee").distinct()


def models(inputs: DataFrame, catalogue_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(target, ordinal, into): what the best model rule of a called method lets flow from an input (-1: the receiver) into
    its result, ``return``, or into another input, by its ordinal."""
    sites = inputs.where("op like 'INVOKE%'").select(F.col("target").alias("method"), F.substring_index("target", "#", 1).alias("owner"), F.regexp_extract("target", r"#([^(]+)\(", 1).alias("name"), F.regexp_extract("target", r"(\(.*)$", 1).alias("descriptor")).where("method is not null").distinct()
    best = rules.best_rule(rules.scores(sites, catalogue_rows.where("kind = 'model'"), pairs))
    acts = catalogue_rows.where("kind = 'model'").select("rule_id", F.explode("actions").alias("what", "targets")).select("rule_id", "what", F.explode("targets").alias("to"))
    ordinal = lambda c: F.when(F.col(c) == "this", -1).otherwise(F.regexp_extract(c, r"^arg(\d+)$", 1).try_cast("int"))
    met = best.join(acts, "rule_id").select(F.col("method").alias("target"), ordinal("what").alias("ordinal"), F.when(F.col("to") == "return", "return").otherwise(ordinal("to").cast("string")).alias("into"))
    return met.where("ordinal is not null and into is not null").distinct()


def model_flow(inputs: DataFrame, found: DataFrame) -> DataFrame:
    """(src, dst, reason) of modelled calls between places: into the result of a call of that target, or from input to
    input at each site, through objects that a method makes if need be."""
    static = F.col("op").isin("INVOKESTATIC", "INVOKEDYNAMIC")
    slot = lambda c: F.when(F.col(c) < 0, 0).otherwise(names.slot_of(F.regexp_extract("target", r"(\(.*)$", 1), F.greatest(F.col(c), F.lit(0)), static))
    met = inputs.where("op like 'INVOKE%'").select("op", "target", "ordinal").distinct().join(found.where("into = 'return'"), ["target", "ordinal"])
    results = met.select(F.concat_ws("|", "target", slot("ordinal").cast("string")).alias("src"), F.concat_ws("|", "target", F.lit("return")).alias("dst"))
    used = inputs.withColumn("origin", F.explode("origins"))
    made = F.concat_ws("|", "method", "origin")
    placed = valueflow.placed(used, inputs).select("method", "pos", "op", "target", "ordinal", "origin", "src").unionByName(used.where("origin like '2:%'").select("method", "pos", "op", "target", "ordinal", "origin", made.alias("src")))
    into = found.where("into <> 'return'").select("target", "ordinal", F.col("into").cast("int").alias("other"))
    filled = placed.join(into, ["target", "ordinal"]).select("method", "pos", "src", F.col("other").alias("ordinal")).join(placed.select("method", "pos", "ordinal", F.col("src").alias("dst"), "origin"), ["method", "pos", "ordinal"])
    fresh = filled.where("origin like '2:%'").select("method", "origin").distinct()
    later = placed.where("op like 'INVOKE%' and origin like '2:%'").join(fresh, ["method", "origin"], "left_semi").select("src", F.concat_ws("|", "target", slot("ordinal").cast("string")).alias("dst"))
    kept = used.where("op in ('PUTFIELD', 'PUTSTATIC') and ordinal = 0").join(fresh, ["method", "origin"], "left_semi").select(made.alias("src"), F.concat(F.lit("field:"), F.regexp_replace("target", "#", ":")).alias("dst"))
    return results.union(filled.select("src", "dst")).union(later).union(kept).where("src <> dst").withColumn("reason", F.lit("model")).distinct()


class Flows(NamedTuple):
    edges: DataFrame  # src, dst
    labelled: heapfacts.Labelled
    inputs: DataFrame  # those of places that can be reached
    bounds: list[str]  # bounds that were met


def flows(files: DataFrame, headers: DataFrame, inputs: DataFrame, summaries: DataFrame, methods: DataFrame, pairs: DataFrame, starts: DataFrame, catalogue_rows: DataFrame) -> Flows:
    """How values get from place to place, and by which calls.

    Which callees a call has follows from the objects in its receiver, if all of them are known,
    and from the hierarchy else; lambdas are called wherever they are held. Entries, and methods that nothing
    loaded calls, get arguments from outside. What constants rule out, those of callers included, is left out.
    """
    slots = cut(dynamic.lambda_slots(dynamic.lambda_status(classfile.call_sites(files))))
    targets = cut(dispatch(inputs, methods, pairs))
    calls = cut(heapfacts.called(inputs, targets))
    lambdas = slots.select(F.col("impl").alias("method")).distinct()
    entered = starts.select(F.concat(F.col("owner"), F.lit("#"), F.col("name"), F.col("descriptor")).alias("method"))
    called = calls.select(F.col("callee").alias("method")).union(lambdas).distinct()
    outside = methods.select("method").join(called, "method", "left_anti").union(entered).distinct()
    unseen = constants.open_slots(methods, outside.union(lambdas), pairs, headers)
    pruned = constants.prune(files.join(headers.where("name is not null").select("sha256", "name"), "sha256"), constants.call_targets(classfile.instructions(files), targets), unseen)
    inputs, calls = (cut(t.join(pruned.dead, ["method", "pos"], "left_anti").select(t.columns)) for t in (inputs, calls))
    slots = cut(slots.join(pruned.dead.withColumnRenamed("method", "host"), ["host", "pos"], "left_anti").select(slots.columns))
    facts = heapfacts.facts(inputs, summaries, classfile.instructions(files), slots, calls, outside)
    pts, complete = pointsto.solve(facts.allocs, facts.copies, facts.stores, facts.loads)
    calls = cut(heapfacts.narrowed(calls, pts, facts.sites, pairs, methods))
    used = valueflow.placed(inputs.withColumn("origin", F.explode("origins")), inputs)
    modelled = cut(models(inputs, catalogue_rows, pairs).join(summaries.select(F.col("method").alias("target")), "target", "left_anti"))
    edges = valueflow.flow_edges(inputs, summaries, calls).unionByName(heapfacts.lambda_flow(inputs, slots, pts, used)).unionByName(model_flow(inputs, modelled))
    bounds = ([] if complete else ["OBJECT_BOUND"]) + ([] if pruned.complete else ["CONSTANT_BOUND"])
    return Flows(edges.select("src", "dst").distinct(), heapfacts.labelled(inputs, summaries, calls, slots, pts, modelled), inputs, bounds)


def sink_places(inputs: DataFrame, catalogue_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(place, sink, rule_id, category, severity): the argument places that the best sink rule of a call names."""
    calls = inputs.where("op like 'INVOKE%'").select("target", (F.col("op") == "INVOKESTATIC").alias("static")).distinct()
    sites = calls.select(F.col("target").alias("method"), F.substring_index("target", "#", 1).alias("owner"), F.regexp_extract("target", r"#([^(]+)\(", 1).alias("name"), F.regexp_extract("target", r"(\(.*)$", 1).alias("descriptor")).distinct()
    best = rules.best_rule(rules.scores(sites, catalogue_rows.where("kind = 'sink' and role = 'TERMINAL'"), pairs))
    tainted = catalogue_rows.select("rule_id", F.explode("tainted").alias("what"))
    met = best.join(tainted, "rule_id").join(calls.withColumnRenamed("target", "method"), "method")
    ordinal = F.when(F.col("what") == "this", -1).otherwise(F.regexp_extract("what", r"arg(\d+)", 1).try_cast("int"))
    slot = F.when(ordinal < 0, 0).otherwise(names.slot_of(F.regexp_extract("method", r"(\(.*)$", 1), ordinal, F.col("static")))
    return met.select(F.concat_ws("|", "method", slot.cast("string")).alias("place"), F.col("method").alias("sink"), "rule_id", "category", "severity").distinct()


def findings(seeds: DataFrame, flow: DataFrame, places: DataFrame, rounds: int = ROUNDS, k: int = ALTERNATIVES) -> tuple[DataFrame, list[str]]:
    """(rule_id, category, severity, entry, sink, hops, path, alternatives) of every entry that gets to a sink's place,
    and what bounds leave open. ``seeds`` has entry and node, ``flow`` src and dst.

    Each entry keeps its own ``k`` paths to a place; of a finding's paths the shortest, then the
    first by text is shown, so equal inputs give equal findings. Only edges on some way to a
    place are followed.
    """
    back = flow.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    near, _ = fixpoint.least_depth(places.select(F.col("place").alias("node")), back, rounds)
    useful = flow.join(near.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    paths, ended, over = fixpoint.keyed_paths(seeds.select(F.col("entry").alias("key"), "node"), useful, rounds, k)
    met = paths.join(places.withColumnRenamed("place", "node"), "node").withColumnRenamed("key", "entry")
    first = F.min(F.struct("hops", "path", "category", "severity")).alias("m")
    found = met.groupBy("rule_id", "entry", "sink").agg(first, F.count(F.lit(1)).alias("alternatives"))
    out = found.select("rule_id", "m.category", "m.severity", "entry", "sink", "m.hops", "m.path", "alternatives")
    return out, (["PATH_BOUND"] if not ended else []) + (["ALTERNATIVE_BOUND"] if over else [])


def scan(spark: SparkSession, path: str, rules_text: str, feature: int = 17, rounds: int = ROUNDS) -> Scan:
    """Everything from files to findings. What can't be read or isn't analysed whole becomes a reason."""
    ship(spark)
    found = cut(archive.class_files(spark, path))
    files = archive.for_release(found, feature).dropDuplicates(["sha256"]).select("sha256", "content")
    headers, methods = cut(classfile.classes(files)), cut(classfile.methods(files))
    inputs, summaries = cut(valueflow.call_inputs(files)), cut(valueflow.summaries(files))
    pairs, closed = fixpoint.closure(classfile.type_edges(files).select("parent", "child"))
    rule_rows = catalogue.rules_table(spark, rules_text)
    starts = cut(entries.entries(methods, pairs))
    flow = flows(files, headers, inputs, summaries, methods, pairs, starts, rule_rows)
    key = F.concat(F.col("owner"), F.lit("#"), F.col("name"), F.col("descriptor"))
    first = F.sequence(F.lit(0), F.size(names.parameter_types(F.col("descriptor"))))
    seeds = starts.where("controlled").join(methods.select("owner", "name", "descriptor", "access"), ["owner", "name", "descriptor"]).select(key.alias("m"), F.explode(first).alias("i"), "descriptor", hierarchy.has(F.col("access"), 8).alias("static"))
    seeds = seeds.where("i < size(regexp_extract_all(regexp_extract(descriptor, '^\\\\(([^)]*)\\\\)', 1), '\\\\[*(?:[BCDFIJSZ]|L[^;]+;)', 0))").select(F.concat_ws("|", "m", names.slot_of(F.col("descriptor"), F.col("i"), F.col("static")).cast("string")).alias("node"))
    entry = F.substring_index("node", "|", 1)
    seeds, places = cut(seeds.select(entry.alias("entry"), "node").distinct()), cut(sink_places(flow.inputs, rule_rows, pairs))
    met, bounds = findings(seeds, flow.edges, places, rounds)
    # Of these only what gets there by calls that return to where they came from.
    reached, whole = matched.reach(seeds.withColumnRenamed("entry", "key"), *flow.labelled)
    real = reached.join(places.select(F.col("place").alias("node"), "sink", "rule_id"), "node").select(F.col("key").alias("entry"), "sink", "rule_id").distinct()
    met, bounds = met.join(real, ["entry", "sink", "rule_id"], "left_semi"), bounds + ([] if whole else ["CALL_BOUND"])
    findings_ = cut(met.withColumn("chain_key", F.sha2(F.concat_ws("|", "rule_id", "entry", "sink"), 256)).withColumn("fingerprint", F.sha2(F.concat_ws("|", "severity", "path"), 256)))
    problems = found.where("problem is not null").select("origin", "member", "problem").union(headers.where("problem is not null").select("sha256", F.lit(None).cast("string"), F.lit("CLASS_FORMAT")))
    codes = problems.select("problem").union(summaries.select(F.explode("reasons"))).distinct().collect()  # a fixed set of codes
    reasons = sorted({r[0] for r in codes} | (set() if closed else {"HIERARCHY_BOUND"}) | set(flow.bounds) | set(bounds))
    n = methods.limit(1).count()
    return Scan(findings_, starts, problems, "UNKNOWN" if not n else "PARTIAL" if reasons else "COMPLETE", reasons)


def performance(run, runs: int = 5, warmups: int = 1, limits: tuple[float, float] = (0, 0)) -> dict:
    """Nearest-rank median and 95th percentile of wall milliseconds; limits of 0 only measure."""
    took = []
    for i in range(warmups + runs):
        began = time.perf_counter()
        run()
        if i >= warmups:
            took.append((time.perf_counter() - began) * 1000)
    took.sort()
    at = lambda p: took[max(0, -(-int(p * 100 * len(took)) // 100) - 1)] if took else None
    p50, p95 = at(0.5), at(0.95)
    passed = bool(took) and all(not limit or value <= limit for limit, value in zip(limits, (p50, p95), strict=True))
    return {"runs": len(took), "p50_ms": p50, "p95_ms": p95, "passed": passed}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scan")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("scan", "performance"):
        p = sub.add_parser(name)
        p.add_argument("input")
        p.add_argument("--rules", required=True)
        p.add_argument("--release", type=int, default=17)
        if name == "scan":
            p.add_argument("--output", required=True)
            p.add_argument("--baseline")
        else:
            p.add_argument("--runs", type=int, default=5)
            p.add_argument("--warmups", type=int, default=1)
            p.add_argument("--limits", type=float, nargs=2, default=(0, 0))
    p = sub.add_parser("diff")
    p.add_argument("old")
    p.add_argument("new")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if given.command == "diff":
        chains = lambda at: spark.read.schema("chain_key string, fingerprint string").json(f"{at}/chains")
        changes = report.diff(chains(given.old), chains(given.new)).groupBy("change").count().collect()
        for r in sorted(changes):
            print(r["change"], r["count"])
        return int(any(r["change"] != "UNCHANGED" for r in changes))
    with open(given.rules, encoding="utf-8") as file:
        text = file.read()
    if given.command == "performance":
        out = performance(lambda: scan(spark, given.input, text, given.release).findings.count(), given.runs, given.warmups, tuple(given.limits))
        print(out)
        return int(not out["passed"])
    began = time.perf_counter()
    done = scan(spark, given.input, text, given.release)
    n = done.findings.count()
    took = (time.perf_counter() - began) * 1000
    rows = done.findings.select(F.col("chain_key").alias("id"), "rule_id", "severity", "entry", F.col("sink").alias("impact"), F.split("path", ">").alias("graph"), F.col("hops").alias("position"))
    started = done.entries.select(F.concat(F.col("owner"), F.lit("#"), F.col("name"), F.col("descriptor")).alias("entry"), "entry_kind")
    tables = {"chains": done.findings, "findings": rows, "evidence": reports.evidence_rows(started, done.findings), "problems": done.problems}
    if given.baseline:
        old = spark.read.schema(done.findings.schema).json(f"{given.baseline}/chains")
        tables["baseline"], tables["baseline_counts"] = reports.baseline_rows(report.diff(old, done.findings).select("chain_key", F.col("change").alias("status")))
    reports.commit(spark, tables, {"run": reports.metadata({"scan": took}, {"findings": n}, done.outcome, done.reasons)}, given.output)
    print(done.outcome, n, *done.reasons)
    return EXIT[done.outcome]


if __name__ == "__main__":
    sys.exit(main())
