"""The search over matching calls by methods: what it writes, its random programs, edges between methods and of large ones."""

import random

import pytest

from chainloom.operators import matched
from tests.test_cycles_and_calls import both, call_strings


def test_keys_share_what_a_callee_reaches(spark, monkeypatch):
    rows, kept = [], matched.cut

    def counted(df):
        out = kept(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(matched, "cut", counted)
    # Each of 150 hosts calls p, whose value goes on over 40 places and into q, which has 40 too.
    flow = [(f"{m}|{i}", f"{m}|{i + 1}") for m in "pq" for i in range(40)]
    calls = [(f"h{i}@", f"h{i}|a", "p|0") for i in range(150)] + [("p@", "p|40", "q|0")]
    seeds = [(f"k{i}", f"h{i}|a") for i in range(150)]
    got, complete = both(spark, seeds, flow, calls, [])
    assert complete and got == {(k, n) for k, h in seeds for n in (h, *(f"{m}|{i}" for m in "pq" for i in range(41)))}
    assert sum(rows) < len(got) / 4  # with the nodes of all keys in the rounds it was more than all of them


@pytest.mark.parametrize(("seed", "edges"), [(0, 50_000), (1, 50_000), (2, 2)])
def test_random_programs_by_methods(spark, monkeypatch, seed, edges):
    monkeypatch.setattr(matched, "MOST_EDGES", edges)
    r = random.Random(seed)
    node = lambda m, i: f"m{m}|{i}"
    flow = [(node(m, r.randrange(5)), node(m, r.randrange(5))) for m in range(5) for _ in range(4)] + [(node(0, 2), node(3, 1))]
    flow += [(node(1, 1), "G"), ("G", node(2, 2)), (node(4, 0), "m4|g"), ("m4|g", node(4, 2))]
    calls, returns = [], []
    for s in range(7):
        a, b = r.randrange(5), r.randrange(5)
        calls.append((f"s{s}", node(a, r.randrange(4)), node(b, 0)))
        if r.random() < 0.8:
            returns.append((f"s{s}", node(b, 3), node(a, r.randrange(4))))
    seeds = [(f"k{m % 2}", node(m, i)) for m in range(3) for i in range(2)]
    for globals_ in ((), ("G", "m4|g", node(2, 0))):
        got, complete = both(spark, seeds, flow, calls, returns, globals_)
        assert complete and got == call_strings(seeds, flow, calls, returns, globals_, most=6)
