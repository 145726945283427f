"""Sinks, their commit, and the safety of patterns."""

import json

import pytest

from chainloom.sources import catalogue, reports


def test_commit_replaces_as_a_whole(spark, tmp_path):
    at = f"file://{tmp_path}/report"
    table = lambda n: spark.createDataFrame([(i,) for i in range(n)], "id int")
    for n in (3, 5):
        reports.commit(spark, {"findings": table(n)}, {"run": reports.metadata({"scan": 1.23456}, {"findings": n}, "COMPLETE", ["b", "a"])}, at)
        assert spark.read.json(f"{at}/findings").count() == n
        assert json.loads(spark.read.text(f"{at}/run").first()[0]) == {"phases_ms": {"scan": 1.235}, "metrics": {"findings": n}, "outcome": "COMPLETE", "reasons": ["a", "b"]}
    assert sorted(x.name for x in tmp_path.iterdir()) == ["report"]
    (tmp_path / "report").rename(tmp_path / "report.before")  # as a lost driver leaves it
    reports.recover(spark, at)
    assert spark.read.json(f"{at}/findings").count() == 5 and sorted(x.name for x in tmp_path.iterdir()) == ["report"]


def test_rows_of_sinks(spark):
    found = spark.createDataFrame([("k", "r", "c", "HIGH", "e1", "s", "e1>x>s", 2), ("l", "r", "c", "HIGH", "e1", "t", "e1>t", 1)], "chain_key string, rule_id string, category string, severity string, entry string, sink string, path string, hops int")
    assert reports.finding_rows(found).first().path == ["e1", "x", "s"]
    entries = spark.createDataFrame([("e1", "main"), ("e2", "http")], "entry string, entry_kind string")
    assert {tuple(r) for r in reports.evidence_rows(entries, found).collect()} == {("e1", "main", 2, 2), ("e2", "http", 0, 0)}
    rows, counts = reports.baseline_rows(spark.createDataFrame([("a", "NEW"), ("b", "NEW"), ("c", "REMOVED")], "chain_key string, status string"))
    assert rows.count() == 3 and {tuple(r) for r in counts.collect()} == {("NEW", 2), ("REMOVED", 1)}


@pytest.mark.parametrize(("pattern", "safe"), [("a/b/.*", True), ("(get|set)[A-Z]+", True), ("(a|b){2,5}c", False), ("(?:a|aa)+b", False), ("((a|b)c)*", False), ("a*a*b", False), ("a?b?", False), ("[a-z]+\\d*x", False), ("(a+|b)c", False), ("((a|b))d", True), (".*a.*bc+", True), ("a+?bc+", True), ("(a{2}b)(c{3}d)", True), ("x(a(b|c)d)e+", True), ("(a+)+", False), ("((a*)b)*", False), ("a**", False), (r"(a)\1", False), ("(?=a)b", False), ("(?<!a)b", False), ("a{5000}", False), ("a{1,9999}", False), ("|".join("a" * 300), False), ("a?" * 130, False), (r"a\+\+", True), ("[*+]+", True)])
def test_pattern_safety(pattern, safe):
    assert (reports.unsafe_pattern(pattern) is None) == safe


def test_unsafe_rules_are_refused():
    pytest.importorskip("yaml")
    with pytest.raises(catalogue.CatalogueError):
        catalogue.parse_rules("- {id: a, kind: sink, match: {owner: '~(a+)+', name: b}}")
