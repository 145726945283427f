"""Shapes of strings: against concrete texts of random programs, and from compiled classes."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_dynamic import compiled

from chainloom.operators import strings
from chainloom.sources import classfile

TEXT = st.text(alphabet="ab/", max_size=6)


def fits(shape, text):
    prefix, suffix, exact, parts = shape
    return text.startswith(prefix) and text.endswith(suffix) and (not exact or text == prefix) and all(p in text for p in parts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(TEXT, min_size=1, max_size=3), min_size=1, max_size=4), st.randoms(use_true_random=False))
def test_pieces_joined_and_met_hold_for_every_choice(pieces, r):
    shape = strings._evaluated([[f"c:{t}" for t in p] + (["?"] if len(p) == 3 else []) for p in pieces], [], [])
    for _ in range(20):
        text = "".join(r.choice([*p, "xyz"] if len(p) == 3 else p) for p in pieces)
        assert fits(shape, text), (shape, text)


def run(r, eqs, copies, var, depth):
    """A text that a variable can have, or None if this way has none in time."""
    ways = [("eq", p) for v, p in eqs if v == var] + [("copy", s) for s, d in copies if d == var]
    if not ways or depth == 0:
        return None
    kind, what = r.choice(ways)
    if kind == "copy":
        return run(r, eqs, copies, what, depth - 1)
    out = ""
    for alternatives in what:
        atom = r.choice(alternatives)
        text = atom[2:] if atom[0] == "c" else r.choice(["", "q", "any"]) if atom == "?" else run(r, eqs, copies, atom[2:], depth - 1)
        if text is None:
            return None
        out += text
    return out


@pytest.mark.parametrize("seed", range(2))
def test_random_programs(spark, seed):
    r = random.Random(seed)
    names = [f"x{i}" for i in range(6)]
    atom = lambda: r.choice(["c:/a", "c:b", "c:/a/b", f"v:{r.choice(names)}", f"v:{r.choice(names)}", "?" if r.random() < 0.3 else "c:/"])
    eqs = [(r.choice(names), [[atom() for _ in range(r.randint(1, 2))] for _ in range(r.randint(1, 3))]) for _ in range(9)] + [("x0", [["c:/a/b"], ["v:x0", "c:b"]])]
    copies = [(r.choice(names), r.choice(names)) for _ in range(3)]
    found, complete = strings.shapes(spark.createDataFrame(eqs, strings.EQUATIONS), spark.createDataFrame(copies, "src string, dst string"), spark.createDataFrame([], "var string"))
    got = {x.var: (x.prefix, x.suffix, x.exact, tuple(x.parts)) for x in found.collect()}
    tried = [(v, t) for _ in range(3000) for v in [r.choice(names)] if (t := run(r, eqs, copies, v, 12)) is not None]
    assert complete and len(tried) > 100
    assert [(v, t, got.get(v)) for v, t in tried if v not in got or not fits(got[v], t)] == []


SOURCE = """package app;
class Paths {
  static String base = "/srv/"; String kept;
  static String under(String name) { return "/srv/data/" + name + ".txt"; }
  static String one() { return under("a"); }
  String built(int n) { StringBuilder b = new StringBuilder("/tmp/"); return b.append("x").append(n).append(".log").toString(); }
  String loop(int n) { String s = "r"; for (int i = 0; i < n; i++) s = s + "a"; return s; }
  String either(boolean b) { return b ? "jdbc:h2:mem" : "jdbc:pg:db"; }
  String mutated(String x) { StringBuilder b = new StringBuilder("k"); b.append(x); b.reverse(); b.append("e"); return b.toString(); }
  void keep() { kept = "v1"; kept = "v2"; }
  String read() { return kept.concat("!"); }
  static void sink(String s) { }
  void use(String s) { sink("ldap://" + s); sink("ldap:x"); }
}
"""


def test_shapes_of_compiled_classes(spark, tmp_path):
    for release in ("8", "11"):  # builders, then concatenation as a dynamic call
        (tmp_path / release).mkdir()
        try:
            files = compiled(tmp_path / release, release, Paths=SOURCE)
        except Exception:
            if release == "8":
                continue  # newer compilers don't know it any more
            raise
        table = spark.createDataFrame([(bytearray(b),) for b in files.values()], "content binary")
        copies = spark.createDataFrame([("app/Paths#one()Ljava/lang/String;@1:0", "app/Paths#under(Ljava/lang/String;)Ljava/lang/String;|0"), ("app/Paths#under(Ljava/lang/String;)Ljava/lang/String;|return", "app/Paths#one()Ljava/lang/String;|3:call:1")], "src string, dst string")
        calls = [(f"app/Paths#{m.name}{m.descriptor}@{x.offset}:0", "app/Paths#sink(Ljava/lang/String;)V|0") for m in classfile.parse(files["Paths"]).methods for x in m.instructions if x.name == "sink"]
        copies = copies.union(spark.createDataFrame(calls, "src string, dst string"))
        open_ = spark.createDataFrame([("app/Paths#use(Ljava/lang/String;)V|1",), ("app/Paths#mutated(Ljava/lang/String;)Ljava/lang/String;|1",)], "var string")
        found, complete = strings.shapes(strings.equations(table), copies, open_)
        got = {x.var: x for x in found.collect()}
        of = lambda name, end="|return": next((x.prefix, x.suffix, x.exact) for v, x in got.items() if v.startswith(f"app/Paths#{name}(") and v.endswith(end))  # noqa: E731, B023
        assert complete and of("under") == of("one") == ("/srv/data/a.txt", "/srv/data/a.txt", True)
        assert of("built") == ("/tmp/x", ".log", False) and of("either") == ("jdbc:", "", False)
        assert of("loop")[0] == "r" and not of("loop")[2] and of("mutated") == ("", "", False)
        assert of("read") == ("v", "!", False) and of("sink", "|0") == ("ldap:", "", False)
