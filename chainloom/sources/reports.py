"""Sinks of a scan's evidence, baselines and metadata, and their commit as a whole."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def recover(spark: SparkSession, target: str) -> None:
    """Ends a commit that was broken off: what stood at ``target`` before comes back if nothing stands there."""
    store, path = _files(spark, target)
    backup = path(f"{target}.before")
    if store.exists(backup):
        if store.exists(path(target)):
            store.delete(backup, True)
        else:
            store.rename(backup, path(target))


def commit(spark: SparkSession, tables: dict[str, DataFrame], texts: dict[str, str], target: str) -> None:
    """Writes tables (JSON lines) and texts below a new folder, then puts that in the place of ``target``.

    Readers see the report before or the one after, never parts of both; ``recover`` ends
    what a lost driver left.
    """
    recover(spark, target)
    store, path = _files(spark, target)
    draft = f"{target}.draft-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.json(f"{draft}/{name}")
    for name, text in texts.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{draft}/{name}")
    if store.exists(path(target)) and not store.rename(path(target), path(f"{target}.before")):
        raise OSError(f"{target} could not be set aside")
    if not store.rename(path(draft), path(target)):
        recover(spark, target)
        raise OSError(f"{target} could not be written")
    store.delete(path(f"{target}.before"), True)


def finding_rows(findings: DataFrame) -> DataFrame:
    """Whole findings for the output: one row each, its path as a list."""
    return findings.select("chain_key", "rule_id", "category", "severity", "entry", "sink", F.split("path", ">").alias("path"), "hops")


def evidence_rows(entries: DataFrame, findings: DataFrame) -> DataFrame:
    """(entry, entry_kind, findings, sinks): what was found from each application entry, with 0 where nothing was."""
    of = findings.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sink").alias("sinks"))
    return entries.select("entry", "entry_kind").distinct().join(of, "entry", "left").select("entry", "entry_kind", F.coalesce("n", F.lit(0)).alias("findings"), F.coalesce("sinks", F.lit(0)).alias("sinks"))


def baseline_rows(statuses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(identity and status of each chain, how many there are of each status)."""
    return statuses.select("chain_key", "status"), statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def metadata(phases: dict[str, float], metrics: dict[str, int], outcome: str, reasons: list[str]) -> str:
    """Milliseconds of phases, counts and completeness as canonical JSON."""
    return json.dumps({"phases_ms": {k: round(v, 3) for k, v in phases.items()}, "metrics": metrics, "outcome": outcome, "reasons": sorted(reasons)}, sort_keys=True)


#: Fixed limits of a rule's pattern.
MOST_QUANTIFIERS, MOST_ALTERNATIVES, MOST_REPEATS = 128, 256, 4096


def unsafe_pattern(text: str) -> str | None:
    """Why a rule's pattern may take too long, or None: back references, looking around, more
    repetitions or alternatives than the limits, a repetition or alternatives within a
    repeated group or beside each other in one group, or two repetitions that are neighbours."""
    plain = re.sub(r"\\[^0-9k]", "a", text)
    plain = re.sub(r"\[\^?\]?[^\]]*\]", "a", plain)
    if re.search(r"\\[0-9k]", plain):
        return "back reference"
    if re.search(r"\(\?(?:[=!>]|<[=!])", plain):
        return "looking around"
    plain = plain.replace("(?:", "(")
    if len(re.findall(r"[*+?]|\{", plain)) > MOST_QUANTIFIERS:
        return "too many repetitions"
    if plain.count("|") > MOST_ALTERNATIVES:
        return "too many alternatives"
    if any(int(n) > MOST_REPEATS for n in re.findall(r"\{(\d+)", plain) + re.findall(r"\{\d*,(\d+)\}", plain)):
        return "too long a repetition"
    if re.search(r"[*+}][*+{]", plain):
        return "repetition of a repetition"
    # One letter stands for an atom, R for a group with a repetition in it, A for one with alternatives.
    flat = re.sub(r"[^()|*+?]", "a", re.sub(r"\{[0-9, ]*\}", "*", plain))
    flat = re.sub(r"([*+?])[?+]", r"\1", flat)
    while True:
        group = re.search(r"\(([^()]*)\)", flat)
        body = group[1] if group else flat
        repeats, splits = bool(re.search(r"[*+?R]", body)), bool(re.search(r"[|A]", body))
        if re.search(r"A[*+?]", body):
            return "alternatives within a repetition"
        if re.search(r"R[*+?]", body):
            return "repetition within a repetition"
        if re.search(r"[*+?][aAR][*+?]", body):
            return "neighbouring repetitions"
        if not group:
            return None
        if repeats and splits:
            return "alternatives and a repetition in one group"
        flat = flat[: group.start()] + ("A" if splits else "R" if repeats else "a") + flat[group.end() :]
