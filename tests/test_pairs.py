"""Pairs through kinds: no side is broadcast, however small its files look, and members of a kind are all met."""

from chainloom.operators import dynamic, sharing, typed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_references_and_loads_are_never_broadcast(spark):
    refs = [(i, i % 7, f"x{i % 5}" if i % 3 else None) for i in range(200)] + [(0, 9, "y"), (300, None, None)]
    loads = [(i, i % 9, f"x{i % 4}") for i in range(60)] + [(3, None, "y"), (400, None, None)]
    got = typed.factory_constraints(spark.createDataFrame(refs, "reference int, identity int, name string"), spark.createDataFrame(loads, "load int, identity int, name string"))
    assert "Broadcast" not in plan(got)
    want = {}
    for r, i, n in refs:
        for load, j, m in loads:
            if n is not None and n == m:
                want.setdefault((r, load), "PARTIAL")
            if i is not None and i == j:
                want[r, load] = "PROVED"
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and {(r, load): s for r, load, s in rows} == want


def test_targets_of_dealt_keys_are_not_broadcast(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    calls = frame([(f"c{i}", "I", "m") for i in range(50)], "call_id string, interface string, method string")
    got = dynamic.interface_targets(calls, frame([("I", "m", 1025)], "owner string, name string, access int"), frame([("I", f"t{i}") for i in range(30)], "interface string, target string"))
    joins = [line for line in plan(got).splitlines() if "Join" in line and "_part" in line]
    assert joins and not any("Broadcast" in line for line in joins)
    assert got.count() == 50 * 30


def test_a_screen_keeps_all_rows_of_its_keys(spark):
    rows = spark.createDataFrame([(i % 500 if i % 50 else None, i) for i in range(2000)], "k long, v int")
    keys = spark.createDataFrame([(i,) for i in range(3, 500, 10)] * 2 + [(None,), (9999,)], "k long")
    got = {tuple(r) for r in sharing.screened(rows, keys, "k").collect()}
    want = {(i % 500 if i % 50 else None, i) for i in range(2000) if i % 50 == 0 or i % 500 % 10 == 3}
    assert got == want
    assert {tuple(r) for r in sharing.screened(rows, keys, "k", 8).collect()} >= want  # few bits let more through
    none = sharing.screened(rows, keys.limit(0), "k").collect()
    assert {r.v for r in none} == {i for i in range(2000) if i % 50 == 0}


def test_only_hosts_of_such_calls_are_dealt_out(spark):
    from chainloom.plans.queries import QUERIES

    df = QUERIES["interface_lambda_targets"](spark, "/root/testdata/sf0.001")
    windows = plan(df).split("Window", 1)[1].split("FileScan parquet", 1)[0]
    assert "_bucket" in windows  # the screen comes before the calls of a host are counted

