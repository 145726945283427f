"""Strong components, levels and matched calls against plain versions."""

import random

import pytest

from chainloom.operators import cycles, matched


def closure(edges):
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    out = {}
    for a in {x for e in edges for x in e}:
        seen, todo = set(), [a]
        while todo:
            for b in ahead.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[a] = seen
    return out


def plain_components(edges):
    reach = closure(edges)
    return {a: min([a, *(b for b in reach[a] if a in reach[b])]) for a in reach}


def plain_levels(edges, of):
    above = {}
    for a, b in edges:
        if of[a] != of[b]:
            above.setdefault(of[a], set()).add(of[b])
    level = {}

    def at(c):
        if c not in level:
            level[c] = 1 + max(map(at, above[c])) if c in above else 0
        return level[c]

    return {n: at(c) for n, c in of.items()}


def graph(seed):
    r = random.Random(seed)
    if seed == 0:  # a ring with a tail on either side and a longer way round
        return [(i, (i + 1) % 60) for i in range(60)] + [(100, 3), (101, 100), (7, 200), (200, 201), (3, 50), (50, 51), (9, 9), (300, 300)]
    n = 14 if seed < 3 else 40
    return [(r.randrange(n), r.randrange(n)) for _ in range(n + 6 * seed)]


@pytest.mark.parametrize("seed", [0, 1, 3])
def test_components_and_levels(spark, seed):
    edges = graph(seed)
    df = spark.createDataFrame(edges, "src long, dst long")
    want = plain_components(edges)
    got = cycles.levels(df).collect()
    assert {r.node: r.component for r in got} == want
    assert {r.node: r.level for r in got} == plain_levels(edges, want)


def test_no_edges(spark):
    assert cycles.levels(spark.createDataFrame([], "src string, dst string")).count() == 0


def call_strings(seeds, flow, calls, returns, globals_=(), most=6):
    """Every state by explicit call strings up to a depth."""
    seen = {(k, n, ()) for k, n in seeds}
    todo = list(seen)
    while todo:
        k, n, stack = todo.pop()
        found = [(b, stack) for a, b in flow if a == n]
        found += [(b, (*stack, s)) for s, a, b in calls if a == n and len(stack) < most]
        found += [(b, stack[:-1]) for s, a, b in returns if a == n and (not stack or stack[-1] == s)]
        for b, now in found:
            state = (k, b, () if b in globals_ else now)
            if state not in seen:
                seen.add(state)
                todo.append(state)
    return {(k, n) for k, n, _ in seen}


def both(spark, seeds, flow, calls, returns, globals_=(), search=matched.reach):
    f = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    reset = f([(g,) for g in globals_], "node string") if globals_ else None
    got, complete = search(f(seeds, "key string, node string"), f(flow, "src string, dst string"), f(calls, "site string, src string, dst string"), f(returns, "site string, src string, dst string"), reset)
    return {tuple(r) for r in got.collect()}, complete


#: id(x) called twice: what goes in at one site must not come out at the other.
TWICE = ([("p", "r")], [("s1", "a", "p"), ("s2", "b", "p")], [("s1", "r", "a2"), ("s2", "r", "b2")])


def test_values_return_to_their_own_call(spark):
    got, complete = both(spark, [("k", "a")], *TWICE)
    assert complete and got == {("k", n) for n in ("a", "p", "r", "a2")}
    assert "b2" in closure([*TWICE[0], *(e[1:] for e in TWICE[1] + TWICE[2])])["a"]  # plain reachability has it
    assert both(spark, [("k", "p")], *TWICE)[0] == {("k", n) for n in ("p", "r", "a2", "b2")}  # began within: any caller
    assert both(spark, [("k", "a2")], *TWICE, search=matched.backward)[0] == {("k", n) for n in ("a2", "r", "p", "a")}


def test_globals_forget_their_caller(spark):
    flow, calls, returns = [("p", "G"), ("G", "q"), ("q", "r")], [("s1", "a", "p")], [("s1", "r", "a2"), ("s2", "r", "b2")]
    got, _ = both(spark, [("k", "a")], flow, calls, returns, ("G",))
    assert got == {("k", n) for n in ("a", "p", "G", "q", "r", "a2", "b2")}


@pytest.mark.parametrize("seed", range(2))
def test_random_programs(spark, seed):
    # Methods m0..m4 of three nodes each; calls go to any method, also the own one.
    r = random.Random(seed)
    node = lambda m, i: f"m{m}.{i}"
    flow = [(node(m, r.randrange(4)), node(m, r.randrange(4))) for m in range(5) for _ in range(4)]
    calls, returns = [], []
    for s in range(7):
        a, b = r.randrange(5), r.randrange(5)
        calls.append((f"s{s}", node(a, r.randrange(4)), node(b, 0)))
        if r.random() < 0.8:
            returns.append((f"s{s}", node(b, 3), node(a, r.randrange(4))))
    seeds = [(node(m, i), node(m, i)) for m in range(3) for i in range(2)]
    got, complete = both(spark, seeds, flow, calls, returns)
    assert complete and got == call_strings(seeds, flow, calls, returns, most=8)
