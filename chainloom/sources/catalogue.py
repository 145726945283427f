"""Rule catalogues, reports and lists as tables, and the sinks that write results."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .reports import unsafe_pattern

#: Limits of a catalogue's text: bytes, nesting, nodes.
MOST_BYTES, MOST_DEPTH, MOST_NODES = 4 << 20, 32, 200_000
RULES = "rule_id string, kind string, category string, severity string, role string, owner_pat string, owner_mode string, name_pat string, name_mode string, descriptor string, tainted array<string>, actions map<string,array<string>>, bridge string"
KINDS = ("sink", "source", "model", "magic-entry", "condition", "chain-fragment")


class CatalogueError(ValueError):
    pass


def _measure(node: Any, depth: int = 0) -> int:
    if depth > MOST_DEPTH:
        raise CatalogueError("nested too deeply")
    parts = node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()
    return 1 + sum(_measure(x, depth + 1) for x in parts)


def _matcher(text: Any) -> tuple[str | None, str | None]:
    """A pattern after ~, a subtype literal after +, else a literal."""
    if text is None:
        return None, None
    text = str(text)
    return (text[1:], "regex") if text.startswith("~") else (text[1:], "subtype") if text.startswith("+") else (text, "exact")


def parse_rules(text: str) -> list[tuple]:
    """Rows of a YAML catalogue: a list of rules with id, kind, match and what their kind needs.

    Aliases are refused, as are repeated ids, unknown kinds, and texts beyond the limits.
    """
    import yaml

    if len(text.encode()) > MOST_BYTES:
        raise CatalogueError("too long")
    if any(isinstance(e, yaml.AliasEvent) for e in yaml.parse(text, yaml.SafeLoader)):
        raise CatalogueError("aliases aren't allowed")
    data = yaml.safe_load(text) or []
    if _measure(data) > MOST_NODES or not isinstance(data, list):
        raise CatalogueError("not a list of rules, or too large")
    rows, ids = [], set()
    for rule in data:
        if not isinstance(rule, dict) or not rule.get("id") or rule["id"] in ids:
            raise CatalogueError(f"a rule without an id of its own: {str(rule)[:80]}")
        if rule.get("kind") not in KINDS:
            raise CatalogueError(f"{rule['id']}: unknown kind {rule.get('kind')}")
        ids.add(rule["id"])
        match = rule.get("match") or {}
        owner, name = _matcher(match.get("owner")), _matcher(match.get("name"))
        if owner[1] == "exact":
            owner = owner[0], "subtype"  # a literal type stands for those below it too
        for pattern, mode in (owner, name):
            if mode == "regex" and (why := unsafe_pattern(pattern)):
                raise CatalogueError(f"{rule['id']}: {why} in {pattern[:80]}")
        tainted = ["this" if t.get("receiver") else f"arg{t['arg']}" for t in rule.get("tainted") or []]
        actions = {str(k): [str(x) for x in ([v] if isinstance(v, str) else v)] for k, v in (rule.get("actions") or {}).items()}
        rows.append((str(rule["id"]), rule["kind"], rule.get("category"), rule.get("severity"), (rule.get("role") or "terminal").upper() if rule["kind"] == "sink" else None, *owner, *name, match.get("descriptor"), tainted, actions, rule.get("bridge")))
    return rows


def rules_table(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_rules(text), RULES)


REPORT = "schema_version string, mode string, result struct<outcome:string,coverage:string,candidates:bigint,exported:bigint,limits:array<string>>, findings array<struct<id:string,status:string,entry:string,impact:string,graph:array<string>,limits:array<string>>>"


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """One row per finding of canonical reports; a report that exports more than it has candidates, or
    repeats an id, raises when its rows are read."""
    report = spark.read.schema(REPORT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    sound = (F.col("result.exported") <= F.col("result.candidates")) & (F.size(F.array_distinct(F.transform("findings", lambda f: f["id"]))) == F.size("findings"))
    checked = report.withColumn("findings", F.when(F.coalesce(sound, F.lit(False)), F.col("findings")).otherwise(F.raise_error(F.lit("unsound report")).cast(report.schema["findings"].dataType)))
    return checked.select("schema_version", F.col("result.outcome").alias("outcome"), F.posexplode("findings").alias("position", "f")).select("schema_version", "outcome", "position", "f.*")


def read_suppressions(spark: SparkSession, path: str) -> DataFrame:
    """(kind, selector) of a text file of ``rule:<id>``, ``sha256:<digest>`` or identities; # begins a comment."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    kind = F.when(F.startswith(line, F.lit("rule:")), "rule").when(F.startswith(line, F.lit("sha256:")), "sha256").otherwise("identity")
    return spark.read.text(path).where(line != "").select(kind.alias("kind"), F.regexp_replace(line, "^(rule|sha256):", "").alias("selector")).distinct()


def write_report(findings: DataFrame, path: str, outcome: str, limits: list[str]) -> None:
    """One JSON line per finding, in rank order, and a small summary file; Spark's committer makes each
    appear as a whole. ``findings`` has id and position."""
    spark = findings.sparkSession
    findings.repartitionByRange("position").sortWithinPartitions("position").write.mode("overwrite").json(f"{path}/findings")
    n = spark.read.schema(findings.schema).json(f"{path}/findings").count()
    summary = json.dumps({"schema_version": "1", "outcome": outcome, "exported": n, "limits": sorted(limits)}, sort_keys=True)
    spark.createDataFrame([(summary,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")


def markdown(findings: DataFrame) -> DataFrame:
    """(position, line): each finding as lines of a text graph, for a text writer."""
    head = F.concat(F.lit("## "), F.col("id"))
    path = F.transform("graph", lambda x: F.concat(F.lit("- "), x))
    return findings.select("position", F.posexplode(F.concat(F.array(head), path)).alias("at", "line")).orderBy("position", "at").select("position", "line")


def write_inventory(owners: DataFrame, path: str) -> None:
    owners.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def sbom(artifacts: DataFrame) -> DataFrame:
    """(component): one JSON component for each artifact (name, version, sha256), in the usual bill-of-materials form."""
    hashes = F.array(F.struct(F.lit("SHA-256").alias("alg"), F.col("sha256").alias("content")))
    return artifacts.select(F.to_json(F.struct(F.lit("library").alias("type"), "name", "version", hashes.alias("hashes"))).alias("component"))


def scan_identity(*parts: Column) -> Column:
    """The cache key of a run: inputs, rules, engine and platform in order, null shown."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("<null>")) for p in parts)), 256)


def cached(spark: SparkSession, root: str, key: str, build) -> DataFrame:
    """The stored result of a run of this key, else what ``build`` gives, stored; only whole results count,
    which the committer's success file tells."""
    at = f"{root}/{key}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
