"""Constants through calls: against plain iteration, from compiled classes, and what a scan leaves out by them."""

import random

import pytest
from test_dynamic import compiled
from test_valueflow import insn

from chainloom.operators import constants, feasibility
from chainloom.operators.feasibility import Linear
from chainloom.sources import classfile
from chainloom.sources.classfile import Method

EQS = "var string, src string, mul int, add int, free boolean"


def wrap(n):
    return (n + 2**31) % 2**32 - 2**31


def plain(eqs):
    """What each variable can have, by plain iteration; more than one number is None."""
    known = {}
    while True:
        heard = {}
        for var, src, mul, add, free in eqs:
            if free:
                heard.setdefault(var, set()).add(None)
            elif src is None:
                heard.setdefault(var, set()).add(add)
            elif src in known:
                heard.setdefault(var, set()).add(None if known[src] is None else wrap(mul * known[src] + add))
        now = {v: next(iter(s)) if len(s) == 1 and known.get(v, next(iter(s))) is not None else None for v, s in heard.items()}
        now = {v: None if v in known and known[v] != x else x for v, x in now.items()}
        if now == known:
            return known
        known = now


@pytest.mark.parametrize("seed", range(3))
def test_random_equations(spark, seed):
    r = random.Random(seed)
    name = lambda: f"v{r.randrange(40)}"
    eqs = [(name(), None, None, r.choice([3, 3, 2**31 - 1]), False) for _ in range(8)] + [(name(), name(), r.choice([1, 1, 2, -1]), r.choice([0, 0, 1, 2**31 - 1]), False) for _ in range(45)] + [(name(), None, None, None, True)]
    eqs += [eqs[0], ("loop", "loop", 1, 0, False), ("loop", None, None, 7, False), ("grows", "grows", 1, 1, False), ("grows", None, None, 0, False), ("never", "nothing", 1, 0, False), (None, None, None, 1, False)]
    found, complete = constants.solve(spark.createDataFrame(eqs, EQS))
    got = {x.var: x.value for x in found.collect()}
    assert complete and got == plain([e for e in eqs if e[0]]) and got["loop"] == 7 and got["grows"] is None and "never" not in got


def test_bounds_and_nothing(spark):
    chain = [("a0", None, None, 1, False)] + [(f"a{i + 1}", f"a{i}", 1, 0, False) for i in range(6)]
    found, complete = constants.solve(spark.createDataFrame(chain, EQS), rounds=2)
    assert not complete and {x.value for x in found.collect()} == {None}
    found, complete = constants.solve(spark.createDataFrame([], EQS))
    assert complete and found.count() == 0


def test_linear_forms_and_calm_handlers():
    x = Linear("x", 1, 0)
    assert feasibility._arithmetic(96, 5, x) == Linear("x", 1, 5) and feasibility._arithmetic(100, 5, x) == Linear("x", -1, 5)
    assert feasibility._arithmetic(104, Linear("x", 3, 1), -2) == Linear("x", -6, -2) and feasibility._arithmetic(104, x, 0) == 0
    assert feasibility._arithmetic(96, x, x) is None and feasibility._arithmetic(108, x, 2) is None
    code = [insn(0, 4, "CONST", constant="int:1"), insn(1, 60, local=1), insn(2, 177, "RETURN"), insn(3, 87), insn(4, 177, "RETURN")]
    m = Method("m", "()V", 9, code, [(0, 2, 3, None)])
    assert constants._dead("k", m, {}) == [("k", 3), ("k", 4)] and (0, 3) not in feasibility.edges(m, {})
    assert constants._dead("k", m._replace(handlers=[(0, 3, 3, None)]), {}) == []  # a return may throw


SOURCE = """package app;
public class Modes {
  static boolean debug() { return false; }
  static int next(int n) { return n + 1; }
  static void sink(String s) { }
  static void guarded(int mode, String s) { if (mode > 2) sink(s); }
  static void mixed(int mode, String s) { if (mode > 2) sink(s); }
  static void passed(int mode, long skip, String s) { guarded(next(mode), s); }
  static void only(int level, String s) { if (level == 9) sink(s); }
  static void first(String s) { if (debug()) only(9, s); only(1, s); }
  static void caught(String s) { int n; try { n = 1; } catch (RuntimeException e) { sink(s); } }
  static void open(int mode, String s) { if (mode > 2) sink(s); }
  static void entry(String s, int any) { passed(1, 5L, s); mixed(1, s); mixed(3, s); first(s); caught(s); open(1, s); }
}
"""


def test_pruned_places_of_compiled_classes(spark, tmp_path):
    data = compiled(tmp_path, Modes=SOURCE)["Modes"]
    parsed = {m.name: m for m in classfile.parse(data).methods}
    files = spark.createDataFrame([("app/Modes", bytearray(data))], "name string, content binary")
    calls = constants.call_targets(classfile.instructions(files), spark.createDataFrame([], "target string, callee string"))
    open_ = spark.createDataFrame([("app/Modes#open(ILjava/lang/String;)V|0",), ("app/Modes#entry(Ljava/lang/String;I)V|1",)], "var string")
    done = constants.prune(files, calls, open_)
    dead = {(x.method, x.pos) for x in done.dead.collect()}
    sinks = {m.name: (f"app/Modes#{m.name}{m.descriptor}", x.offset) in dead for m in parsed.values() for x in m.instructions if x.name == "sink"}
    # ``only`` has one caller left once the other is found to be unreachable.
    assert done.complete and sinks == {"guarded": True, "mixed": False, "only": True, "caught": True, "open": False}
    known = {x.var: x.value for x in done.known.collect()}
    assert known["app/Modes#guarded(ILjava/lang/String;)V|0"] == 2 and known["app/Modes#mixed(ILjava/lang/String;)V|0"] is None and known["app/Modes#debug()Z|return"] == 0


HANDLERS = """package app;
import com.sun.net.httpserver.*;
class Exec { static void start(String s) { } static void guarded(int mode, String s) { if (mode > 2) start(s); } static void run(int mode, String s) { if (mode > 2) start(s); } }
class Kept implements HttpHandler { public void handle(HttpExchange x) { Exec.run(3, x.getRequestMethod()); } }
class Never implements HttpHandler { public void handle(HttpExchange x) { Exec.guarded(1, x.getRequestMethod()); } }
"""
RULES = """
- {id: exec, kind: sink, category: command, severity: HIGH, match: {owner: app/Exec, name: start}, tainted: [{arg: 0}]}
- {id: method, kind: model, match: {owner: com/sun/net/httpserver/HttpExchange, name: getRequestMethod}, actions: {this: [return]}}
"""


def test_scan_leaves_out_what_a_callers_constant_rules_out(spark, tmp_path):
    pytest.importorskip("yaml")
    from chainloom.plans import scan

    at = tmp_path / "in"
    at.mkdir()
    for name, data in compiled(tmp_path, Handlers=HANDLERS).items():
        (at / f"{name}.class").write_bytes(data)
    done = scan.scan(spark, str(at), RULES)
    assert {r.entry.split("#")[0] for r in done.findings.collect()} == {"app/Kept"} and done.outcome == "COMPLETE"
