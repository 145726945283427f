"""The path queries to the reference's bounds, against brute force."""

import os
import random
from types import SimpleNamespace

import pytest

from chainloom.operators import fixpoint
from chainloom.plans import queries
from chainloom.plans.views import Program

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def every_path(seeds, edges, rounds):
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, []).append(b)
    found, level = {s: [(0, s)] for s in seeds}, [(s,) for s in seeds]
    for n in range(1, rounds + 1):
        level = [(*p, b) for p in level for b in ahead.get(p[-1], ()) if b not in p]
        for p in level:
            found.setdefault(p[-1], []).append((n, ">".join(p)))
    return found


@pytest.mark.parametrize("seed", range(2))
def test_k_simple_paths_are_exact_with_cycles(spark, seed):
    r = random.Random(seed)
    edges = sorted({(r.choice("abcdefg"), r.choice("abcdefg")) for _ in range(15)} | {("s", "a"), ("t", "b"), ("c", "y"), ("y", "z")})
    got, complete = fixpoint.k_simple_paths(spark.createDataFrame([("s",), ("t",), ("a",)], "node string"), spark.createDataFrame(edges, "src string, dst string"), 9, 3)
    want = {(n, i + 1, h, p) for n, paths in every_path(["s", "t", "a"], edges, 9).items() for i, (h, p) in enumerate(sorted(paths)[:3])}
    assert {(x.node, x["rank"], x.hops, x.path) for x in got.collect()} == want and complete


@pytest.mark.parametrize(("seed", "rounds"), [(0, 9), (1, 4)])
def test_deviating_paths_are_those_of_full_enumeration(spark, seed, rounds):
    r = random.Random(seed)
    edges = sorted({(r.choice("abcdefg"), r.choice("abcdefg")) for _ in range(18)} | {("s", "a"), ("t", "b"), ("c", "y"), ("y", "z")})
    targets = ["z", "c", "g", "s", "nowhere"]
    frame = lambda nodes: spark.createDataFrame([(n,) for n in nodes], "node string")
    got = fixpoint.deviating_paths(frame(["s", "t", "a"]), frame(targets), spark.createDataFrame(edges, "src string, dst string"), rounds, 4)
    paths = every_path(["s", "t", "a"], edges, rounds)
    assert {(x.node, x["rank"], x.hops, x.path) for x in got.collect()} == {(n, i + 1, h, p) for n in targets for i, (h, p) in enumerate(sorted(paths.get(n, []))[:4])}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_path_queries_reach_the_bounds(spark):
    p = Program(spark, SF)
    edges = {(x.src, x.dst) for x in p.edges.where("type <> 'LAMBDA'").collect()}
    sources, sinks = ({x.method for x in t.collect()} for t in (p.sources, p.sinks))

    def depths(seeds, pairs, rounds):
        ahead = {}
        for a, b in pairs:
            ahead.setdefault(a, []).append(b)
        seen = level = dict.fromkeys(seeds, 0)
        for d in range(1, rounds + 1):
            level = {b: d for a in level for b in ahead.get(a, ()) if b not in seen}
            seen = seen | level
        return seen

    fore, back = depths(sources, edges, 20), depths(sinks, {(b, a) for a, b in edges}, 40)
    assert max(fore.values()) > 6 or max(back.values()) > 6
    run = lambda name: queries.QUERIES[name](spark, SF).collect()
    reach, dist, both = run("reach_min_depth_full"), run("sink_distance_full"), run("entry_sink_intersection_full")
    assert {x.node: x.depth for x in reach} == fore and {x.node: x.depth for x in dist} == back
    assert {(x.node, x.entry_depth, x.distance) for x in both} == {(n, fore[n], back[n]) for n in fore.keys() & back.keys() if fore[n] + back[n] <= 20}
    assert {x.complete for x in reach} == {depths(sources, edges, 21) == fore}


def test_registered_paths_have_up_to_twenty_hops(spark):
    names = [f"n{i:02}" for i in range(50)]
    chain = [*zip(names, names[1:]), ("n05", "n02"), ("n01", "n03"), ("n00", "n04")]
    frame = lambda nodes: spark.createDataFrame([(n,) for n in nodes], "method string")
    p = SimpleNamespace(sources=frame(["n00"]), sinks=frame(["n15", "n49"]), edges=spark.createDataFrame([(a, b, "INVOKES") for a, b in chain], "src string, dst string, type string"))
    found = every_path(["n00"], chain, 20)
    eight = {(n, i + 1, h, w) for n, paths in found.items() for i, (h, w) in enumerate(sorted(paths)[:8])}
    got = queries.taint_forward_k8_full(p).collect()
    assert {(x.node, x["rank"], x.hops, x.path) for x in got} == eight and max(x.hops for x in got) == 20
    assert not any(x.complete for x in got)  # the chain goes on
    assert {(x.node, x.hops, x.path) for x in queries.taint_forward_best_full(p).collect()} == {(n, h, w) for n, i, h, w in eight if i == 1}
    assert [x.sink for x in queries.bounded_call_path_full(p).collect()] == ["n15"]
    far = {x.node: x.depth for x in queries.sink_distance_full(p).collect()}
    assert far["n16"] == 33 and far["n10"] == 5 and far["n09"] == 6


@pytest.mark.parametrize(("seed", "rounds"), [(0, 3), (2, 5)])
def test_k_simple_paths_are_exact_where_cycles_are_longer_than_the_bound(spark, seed, rounds):
    r = random.Random(seed)
    ring = [f"r{i}" for i in range(8)]
    edges = sorted({*zip(ring, ring[1:] + ring[:1]), ("s", "r0"), ("t", "r3"), ("r5", "x"), *((r.choice(ring[:4]), r.choice(["x", "y", "r6"])) for _ in range(3)), ("x", "y")})
    got, complete = fixpoint.k_simple_paths(spark.createDataFrame([("s",), ("t",)], "node string"), spark.createDataFrame(edges, "src string, dst string"), rounds, 2)
    best = lambda n: {(v, i + 1, h, p) for v, paths in every_path(["s", "t"], edges, n).items() for i, (h, p) in enumerate(sorted(paths)[:2])}
    assert {(x.node, x["rank"], x.hops, x.path) for x in got.collect()} == best(rounds)
    assert not complete or best(rounds) == best(20)


def test_paths_into_full_nodes_are_not_worked_out(spark, monkeypatch):
    """A ring of 60 nodes with 40 ways into each and 12 hops: a node has k paths in the second round, and no set of ring nodes is kept."""
    ring = [(f"r{i}", f"r{(i + 1) % 60}") for i in range(60)]
    into = [(f"p{j}", f"r{i}") for i in range(60) for j in range(i, i + 40)]
    starts = [(f"o{j}", f"p{j}") for j in range(100)]
    rows, kept = [], fixpoint.cut
    monkeypatch.setattr(fixpoint, "cut", lambda df: (rows.append(out.count()) if "path" in df.columns and "rank" in df.columns else None, out)[1] if (out := kept(df)) is not None else None)
    got, _ = fixpoint.k_simple_paths(spark.createDataFrame([(a,) for a, _ in starts], "node string"), spark.createDataFrame(ring + into + starts, "src string, dst string"), 12, 2)
    assert got.where("node = 'r7'").count() == 2 and got.count() == 100 + 100 + 120
    assert sum(rows) <= 2 * got.count()
