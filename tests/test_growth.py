"""Joins of steps whose results are small make no more rows than their inputs and results have."""

import pytest

from chainloom.operators import backward, compose, conditions, dynamic, fixpoint, matched, sharing, typed


def joined(spark, df):
    """The rows of ``df`` and how many the largest join of its plan made."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = [tuple(r) for r in df.collect()]
        most, left = 0, [df._jdf.queryExecution().executedPlan()]
        while left:
            node = left.pop()
            found = node.metrics().get("numOutputRows")
            if "Join" in node.nodeName() and found.isDefined():
                most = max(most, found.get().value())
            kids = node.children()
            left += [kids.apply(i) for i in range(kids.size())]
            if node.nodeName() == "ReusedExchange":
                left.append(node.child())
        return sorted(got, key=str), most
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.fixture
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def test_contradictions_meet_no_type_below(spark, frame):
    below = [(f"N{i % 2}", f"C{i}") for i in range(2000)]
    classes = frame([("N0", False), ("N1", False), *((c, False) for _, c in below)], "name string, interface boolean")
    limits = [(f"k{i}", o, "N0", f"C{i}") for i in range(300) for o in range(3)]
    got, most = joined(spark, conditions.contradictions(frame(limits, "chain_key string, ord int, field_type string, source_type string"), classes, frame(below, "ancestor string, descendant string")))
    assert got == sorted(((f"k{i}", f"constraint-cycle:N0-x-C{i}") for i in range(1, 300, 2)), key=str)
    assert most <= 2 * 2002


def test_contradictions_of_types_with_a_joint_one(spark, frame):
    pairs = frame([("A", "X"), ("B", "X"), ("C", "Y")], "ancestor string, descendant string")
    classes = frame([(c, c == "I") for c in "ABCXYI"], "name string, interface boolean")
    limits = [("k", 0, "A", "B"), ("k", 1, "A", "C"), ("k", 2, "B", "C"), ("few", 0, "A", "C"), ("few", 1, "A", "A"), ("same", 0, "A", "A"), ("same", 1, None, "C"), ("same", 2, "A", "I"), ("same", 3, "A", "gone")]
    got = conditions.contradictions(frame(limits, "chain_key string, ord int, field_type string, source_type string"), classes, pairs)
    assert [tuple(r) for r in got.collect()] == [("k", "constraint-cycle:A-x-C")]


def test_rerooted_chains_meet_the_first_holders_only(spark, frame):
    chains = frame([(f"k{i}", f"C{i % 50}") for i in range(100)], "chain_key string, entry_class string")
    members = frame([(f"C{i}", "N") for i in range(50)] + [("C0", "M")], "held string, region string")
    holders = frame([("N", f"S{i:03}") for i in range(900)] + [("M", "S0005"), ("M", "S000")], "region string, root string")
    got, most = joined(spark, compose.reroot(chains, members, holders, 3))
    assert [r for r in got if r[0] == "k1"] == [("k1", "S000"), ("k1", "S001"), ("k1", "S002")]
    assert [r for r in got if r[0] == "k50"] == [("k50", "S000"), ("k50", "S0005"), ("k50", "S001")] and len(got) == 300
    assert most <= 300


def test_callers_of_callbacks_are_counted_without_their_pairs(spark, frame):
    calls = frame([(f"m{i}", "N", 257) for i in range(300)] + [("m0", "S1", 257), ("m0", "S1", 257), ("a", "S1", 257), ("b", "S2", 1)], "caller string, owner string, access int")
    methods = frame([(f"S{i}", f"S{i}#cb", 1, "()V") for i in range(200)], "owner string, name string, access int, descriptor string")
    pairs = frame([("N", f"S{i}") for i in range(200)], "ancestor string, descendant string")
    none = calls.access.isNull()
    got, most = joined(spark, dynamic.callback_callers(calls, methods, pairs, none))
    assert ("S1#cb", 301, "a") in got and ("S2#cb", 300, "m0") in got and len(got) == 200
    assert most <= 1000


def test_callbacks_join_what_an_owner_may_call_back(spark, frame):
    calls = frame([(f"m{i}", "N", 257) for i in range(300)], "caller string, owner string, access int")
    methods = frame([("S1", "S1#cb", 1, "()V"), ("S2", "S2#cb", 2, "()V")], "owner string, name string, access int, descriptor string")
    pairs = frame([("N", f"S{i}") for i in range(200)], "ancestor string, descendant string")
    got, most = joined(spark, dynamic.native_callbacks(calls, methods, pairs, calls.access.isNull()))
    assert got == sorted((f"m{i}", "S1#cb") for i in range(300))
    assert most <= 300


def shuffled(df):
    """The result columns that the plan deals out anew."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_lambda_targets_are_paired_without_a_shuffle_of_pairs(spark, frame):
    calls = frame([("c1", "I", "m"), ("c1", "I", "m"), ("c1", "J", "m"), ("c2", "I", "m"), ("c3", "I", "x")], "call_id string, interface string, method string")
    methods = frame([("I", "m", 1025), ("J", "m", 1025)], "owner string, name string, access int")
    targets = frame([("I", "t1"), ("I", "t1"), ("J", "t1"), ("J", "t2")], "interface string, target string")
    got = dynamic.interface_targets(calls, methods, targets)
    assert not [x for x in shuffled(got) if "call_id" in x and "target" in x]
    assert joined(spark, got)[0] == [("c1", "t1"), ("c1", "t2"), ("c2", "t1")]


def test_elements_are_joined_by_container_once(spark, frame):
    adds = frame([("v1", f"x{i % 3}") for i in range(300)], "container string, value string")
    takes = frame([("v1", i) for i in range(300)], "container string, take int")
    got, most = joined(spark, typed.element_sources(adds, takes, frame([("v2", "v1")], "view string, made_of string")))
    assert got == sorted(((i, f"x{j}") for i in range(300) for j in range(3)), key=str)
    assert most <= 900


def test_sites_meet_the_nearest_getters_only(spark, frame):
    sites = frame([(f"s{i}", "B") for i in range(100)] + [("s0", "C")], "site string, owner string")
    getters = frame([("B", f"p{i:03}") for i in range(500)] + [("C", "q")], "owner string, target string")
    got, most = joined(spark, dynamic.collection_targets(sites, getters, frame([("p400", 1), ("q", 0)], "target string, distance int"), 2))
    assert got[:4] == [("s0", "p400", 2), ("s0", "q", 1), ("s1", "p000", 2), ("s1", "p400", 1)] and len(got) == 200
    assert most <= 501


def test_bridges_make_no_pair_of_calls(spark, frame):
    made = frame([(i, 1, 0) for i in range(300)] + [(900, 2, 1), (900, 2, 1), (901, 3, 1), (901, 3, 0), (902, 4, None)], "call int, identity int, artifact int")
    used = frame([(i, 1, 0) for i in range(300)] + [(1002, 2, 1), (1003, 3, 1), (1004, 4, 1), (1005, 5, 1), (1006, 2, 0), (1007, 2, 1), (1007, 5, 1)], "call int, identity int, artifact int")
    got, most = joined(spark, typed.bridges(made, used))
    assert {r[0]: r[1:] for r in got if r[0] > 999} == {1002: (900, "PROVED"), 1003: (901, "PARTIAL"), 1004: (902, "PARTIAL"), 1005: (None, "UNKNOWN"), 1006: (900, "PARTIAL"), 1007: (900, "PARTIAL")}
    assert {r[1:] for r in got if r[0] < 300} == {(0, "PARTIAL")} and most <= 400


def test_factories_and_loads_are_paired_without_a_shuffle_of_pairs(spark, frame):
    refs = frame([(1, 7, "x"), (1, 8, None), (2, 9, "y"), (3, None, None)], "reference int, identity int, name string")
    loads = frame([(10, 7, "y"), (11, 9, "x"), (12, 5, "x")], "load int, identity int, name string")
    got = typed.factory_constraints(refs, loads)
    assert not [x for x in shuffled(got) if "reference#" in x and "load#" in x]
    assert joined(spark, got)[0] == [(1, 10, "PROVED"), (1, 11, "PARTIAL"), (1, 12, "PARTIAL"), (2, 10, "PARTIAL"), (2, 11, "PROVED")]


def test_heavy_keys_are_dealt_to_parts(spark, frame):
    got, _ = joined(spark, sharing.dealt(frame([(i, "k") for i in range(50)], "a int, k string"), frame([("k", 1), ("k", 2), ("l", 3)], "k string, b int"), "k"))
    assert sorted(got, key=str) == sorted((("k", i, b) for i in range(50) for b in (1, 2)), key=str)


def test_control_goes_only_where_an_entry_is_in_reach(spark, frame, monkeypatch):
    steps = [("s", f"x{i}") for i in range(50)] + [(f"x{i}", f"y{i}") for i in range(50)] + [("y7", "e"), ("s", "e2"), ("e2", "e"), ("x9", "e3"), ("e3", "late")]
    frames = [frame([("S", "s")], "sink string, place string"), frame(steps, "place string, source string"), frame([("e",), ("e2",), ("late",)], "place string")]
    want = sorted(tuple(r) for r in backward.controlled(*frames, 2)[0].collect())
    sizes, plain = [], backward.cut

    def counted(df):
        out = plain(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(backward, "cut", counted)
    assert sorted(tuple(r) for r in backward.entered(*frames, 2).collect()) == want == [("S", "e", 2), ("S", "e2", 1)]
    assert max(sizes) == 1


def test_long_methods_take_few_rounds(spark, frame):
    flow = frame([(f"m|{i:03}", f"m|{i + 1:03}") for i in range(60)], "src string, dst string")
    none = frame([], "site string, src string, dst string")
    got, complete = matched.reach(frame([("k", "m|000")], "key string, node string"), flow, none, none, rounds=10)
    assert complete and sorted(r.node for r in got.collect()) == [f"m|{i:03}" for i in range(61)]


@pytest.mark.parametrize("order", ["rising", "mixed"])
def test_components_write_a_few_times_their_edges(spark, monkeypatch, order):
    rows, kept = [], fixpoint.cut

    def counted(df):
        out = kept(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(fixpoint, "cut", counted)
    n = 1500
    place = list(range(n)) if order == "rising" else [i * 701 % n for i in range(n)]
    edges = [(f"n{place[i]:04}", f"n{place[i + 1]:04}") for i in range(n - 1) if i % 500 != 499] + [("x", "x"), ("n0000", "n0000")]
    got = {r.node: r.component for r in fixpoint.components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    want = {"x": "x"}
    for at in range(0, n, 500):
        own = [f"n{place[i]:04}" for i in range(at, at + 500)]
        want |= dict.fromkeys(own, min(own))
    assert got == want
    assert sum(rows) < 9 * n  # with all edges and labels in each round it was more
