"""Backward control against a plain search over all facts."""

import os
from collections import defaultdict

import pytest

import __spark_entry__  # noqa: F401  it loads the plans in their order
from chainloom.operators import backward
from chainloom.plans import program_queries, queries, views

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_all_steps_have_no_bound(spark):
    frame = lambda kind, n: spark.createDataFrame([(kind, f"{kind}{i:02}") for i in range(n)] * 2, "place string, source string")
    args, writes, returns = frame("p", 3), frame("f", 25), frame("r", 12)
    assert backward.steps_back(args, writes, returns).count() == 3 + 10 + 8
    got = sorted(tuple(r) for r in backward.all_steps(args, writes, returns).collect())
    assert got == sorted((kind, f"{kind}{i:02}") for kind, n in (("p", 3), ("f", 25), ("r", 12)) for i in range(n))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_control_goes_over_all_writers(spark):
    p = views.Program(spark, SF)
    back, fields = defaultdict(set), defaultdict(set)
    for text in (program_queries._ARGS, program_queries._FIELDS, program_queries._RETURNS):
        for place, source in p.sql("SELECT * FROM " + text).collect():
            back[place].add(source)
            if text is program_queries._FIELDS:
                fields[place].add(source)
    assert max(map(len, fields.values())) > 10
    entries, want = {f"p|{r.method}" for r in p.sources.collect()}, set()
    for sink in {r.method for r in p.sinks.collect()}:
        seen, level = {f"p|{sink}"}, {f"p|{sink}"}
        for depth in range(6):
            want |= {(sink, place, depth) for place in level & entries}
            level = {s for place in level for s in back[place]} - seen
            seen |= level
    assert {tuple(r) for r in queries.QUERIES["backward_control"](spark, SF).collect()} == want
