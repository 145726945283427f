"""Points-to sets against a plain fixpoint on random facts."""

import random

import pytest

from chainloom.operators import fixpoint, pointsto


def plain(allocs, copies, stores, loads):
    pts, edges = set(allocs), set(copies)
    while True:
        cells = {(s, f"{o}.{f}") for b, f, s in stores for v, o in pts if v == b}
        cells |= {(f"{o}.{f}", d) for b, f, d in loads for v, o in pts if v == b}
        cells |= {(pointsto.UNKNOWN, d) for b, f, d in loads if (b, pointsto.UNKNOWN) in pts}
        now = pts | {(d, o) for s, d in edges | cells for v, o in pts if v == s} | {(d, pointsto.UNKNOWN) for s, d in edges | cells if s == pointsto.UNKNOWN}
        if now == pts and cells <= edges:
            return pts
        pts, edges = now, edges | cells


def solved(spark, allocs, copies, stores, loads, **more):
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((allocs, "var string, site string"), (copies, "src string, dst string"), (stores, "base string, field string, src string"), (loads, "base string, field string, dst string"))]
    pts, complete = pointsto.solve(*frames, **more)
    return {(r.var, r.site) for r in pts.collect()}, complete, pts


@pytest.mark.parametrize("seed", range(2))
def test_random_facts(spark, seed):
    r = random.Random(seed)
    v = [f"v{i}" for i in range(9)]
    allocs = [(r.choice(v), f"o{i}") for i in range(5)] + ([(r.choice(v), pointsto.UNKNOWN)] if seed % 2 else [])
    copies = [(r.choice(v), r.choice(v)) for _ in range(5)]
    stores, loads = ([(r.choice(v), r.choice("fg"), r.choice(v)) for _ in range(6)] for _ in range(2))
    got, complete, _ = solved(spark, allocs, copies, stores, loads)
    assert complete and got == plain(allocs, copies, stores, loads)


def test_fields_of_two_objects_stay_apart(spark):
    # a.f = x; b.f = y; u = a.f; w = b.f
    allocs = [("a", "A"), ("b", "B"), ("x", "X"), ("y", "Y")]
    stores, loads = [("a", "f", "x"), ("b", "f", "y")], [("a", "f", "u"), ("b", "f", "w"), ("a", "g", "z")]
    got, complete, pts = solved(spark, allocs, [("b", "c")], stores, loads)
    assert complete and {p for p in got if p[0] in "uwz"} == {("u", "X"), ("w", "Y")}
    asked = spark.createDataFrame([("a", "b"), ("b", "c"), ("u", "x"), ("u", "w")], "a string, b string")
    assert {tuple(r) for r in pointsto.aliases(pts, asked).collect()} == {("b", "c"), ("u", "x")}
    sites = spark.createDataFrame([("X", "T"), ("Y", "S"), ("A", "R"), ("B", "R")], "site string, type string")
    assert {(r.var, r.type, r.exact) for r in pointsto.types_of(pts, sites).collect() if r.var in "abuw"} == {("a", "R", True), ("b", "R", True), ("u", "T", True), ("w", "S", True)}


def test_cyclic_structures_end_and_bounds_are_told(spark):
    # n.next = n, walked; then a chain longer than the bound
    got, complete, _ = solved(spark, [("n", "N")], [("m", "n")], [("n", "next", "n")], [("n", "next", "m")])
    assert complete and got == {("n", "N"), ("m", "N"), ("N.next", "N")}
    chain = [(f"v{i}", f"v{i + 1}") for i in range(9)]
    got, complete, _ = solved(spark, [("v0", "O")], chain, [], [], rounds=4)
    assert not complete and got < plain([("v0", "O")], chain, [], [])
    assert solved(spark, [], [], [], [])[:2] == (set(), True)


@pytest.mark.parametrize("small", [0, 12, pointsto.SMALL])
def test_small_and_large_parts_give_what_rounds_give(spark, monkeypatch, small):
    # Four programs, the last one with names that go on from objects of the others; one part is larger than 12 facts.
    r = random.Random(7)
    allocs, copies, stores, loads = [], [], [], []
    for k, n in enumerate((3, 4, 9)):
        v = [f"v{k}.{i}" for i in range(n)]
        allocs += [(r.choice(v), f"o{k}-{i}") for i in range(n // 2 + 1)]
        copies += [(r.choice(v), r.choice(v)) for _ in range(n)]
        stores += [(r.choice(v), r.choice("fg"), r.choice(v)) for _ in range(n)]
        loads += [(r.choice(v), r.choice("fg"), r.choice(v)) for _ in range(n)]
    copies += [(f"o{k}-{i}.f", "z") for k in range(2) for i in range(2)]
    monkeypatch.setattr(pointsto, "SMALL", small)
    got, complete, _ = solved(spark, allocs, copies, stores, loads)
    assert complete and got == plain(allocs, copies, stores, loads)


def test_many_small_parts_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(pointsto, "_solve", None)
    allocs = [(f"v{k}.0", f"o{k}") for k in range(40)]
    copies = [(f"v{k}.{i}", f"v{k}.{i + 1}") for k in range(40) for i in range(k)]
    got, complete, _ = solved(spark, allocs, copies, [], [])
    assert complete and got == {(f"v{k}.{i}", f"o{k}") for k in range(40) for i in range(k + 1)}


def test_parts_hold_what_components_hold(spark):
    r = random.Random(9)
    edges = [(r.getrandbits(62) if i % 5 == 0 else i, i + 1) for i in range(60) if i % 9] + [(70, 70)] + [(200, 201)] * 3
    df = spark.createDataFrame(edges, "src long, dst long")
    sets = lambda rows: {frozenset(n for n, q in rows if q == p) for _, p in rows}
    got = sets([tuple(x) for x in fixpoint.parts(df).collect()])
    assert got == sets([tuple(x) for x in fixpoint.components(df).collect()]) - {frozenset([70])}
