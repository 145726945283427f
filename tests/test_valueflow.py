"""Value flow on public class files and on hand-made instructions."""

from test_operators import small_classes

from chainloom.operators import fixpoint, valueflow
from chainloom.sources.classfile import Instruction, Method, parse


def insn(pos, op, kind="OTHER", owner=None, name=None, descriptor=None, constant=None, targets=(), local=-1):
    return Instruction(pos, op, kind, owner, name, descriptor, constant, targets, local)


def call(pos, op, owner, name, descriptor):
    return insn(pos, op, "INVOKESTATIC" if op == 184 else "INVOKEVIRTUAL", owner, name, descriptor)


def test_public_methods_have_consistent_stacks():
    methods = [m for b in small_classes() for m in parse(b).methods if m.instructions]
    flows = [valueflow.interpret(m) for m in methods]
    assert len(flows) > 200
    assert not [(m.name, f.reasons) for m, f in zip(methods, flows, strict=True) if f.reasons]
    for m, f in zip(methods, flows, strict=True):
        seen = {}
        for pos, ordinal, origins in f.inputs:
            assert origins == sorted(set(origins)) and origins
            seen.setdefault(pos, set()).add(ordinal)
        for pos, ordinals in seen.items():
            x = m.instructions[pos]
            if x.kind.startswith("INVOKE"):
                n = len(valueflow.parameters(x.descriptor))
                assert ordinals == set(range(0 if x.kind in ("INVOKESTATIC", "INVOKEDYNAMIC") else -1, n))


def test_branches_meet_and_wide_parameters_take_two_slots():
    code = [insn(0, 21, local=0), insn(1, 153, "BRANCH", targets=(4,)), insn(2, 25, local=3), insn(3, 167, "GOTO", targets=(5,)), insn(4, 18, "CONST", constant="string:x"), call(5, 184, "A", "sink", "(Ljava/lang/Object;)V"), insn(6, 177, "RETURN")]
    flow = valueflow.interpret(Method("m", "(IJLjava/lang/Object;)V", 8, code, []))
    assert flow.inputs == [(5, 0, ["1:param:3", "5:constant:string:x"])] and flow.reasons == []


def test_loops_end_and_handlers_know_nothing():
    code = [insn(0, 25, local=0), call(1, 182, "B", "next", "()LB;"), insn(2, 58, local=0), insn(3, 167, "GOTO", targets=(0,)), call(4, 184, "C", "log", "(LT;)V"), insn(5, 177, "RETURN")]
    flow = valueflow.interpret(Method("m", "()V", 1, code, [(0, 4, 4, None)]))
    assert flow.inputs == [(1, -1, ["1:param:0", "3:call:1"]), (4, 0, [valueflow.UNKNOWN])]


def test_problems_have_reasons():
    assert valueflow.interpret(Method("m", "()V", 8, [insn(0, 87)], [])).reasons == ["STACK_UNDERFLOW"]
    assert valueflow.interpret(Method("m", "()V", 8, [insn(0, 254)], [])).reasons == ["UNMODELED_OPCODE"]
    nested = valueflow.field_origin("O", "f", "D", True, frozenset())
    for _ in range(20):
        nested = valueflow.field_origin("O", "f", "D", False, frozenset([nested]))
    assert nested.count("4:field:") <= valueflow.MOST_NESTING + 1 and "9:depth" in nested


def test_flow_reaches_through_calls_fields_and_returns(spark):
    inputs = spark.createDataFrame([("a#in(JLO;)V", 3, "INVOKEVIRTUAL", "b#pass(JLO;)LO;", 1, ["1:param:3"]), ("a#in(JLO;)V", 5, "PUTFIELD", "a#f:LO;", 0, ["3:call:3"]), ("c#out()V", 2, "INVOKESTATIC", "s#sink(LO;)V", 0, ["4:field:a:f:LO;:false:<1:param:0>", "5:constant:int:1"])], valueflow.INPUTS)
    methods = spark.createDataFrame([("b#pass(JLO;)LO;", 1, ["1:param:3"], [])], valueflow.METHODS)
    edges = valueflow.flow_edges(inputs, methods)
    seen, complete = fixpoint.least_depth(spark.createDataFrame([("a#in(JLO;)V|3",)], "node string"), edges, 10)
    got = {r.node: r.depth for r in seen.collect()}
    assert complete and got["b#pass(JLO;)LO;|3"] == 1 and got["field:a:f:LO;"] == 3 and got["s#sink(LO;)V|0"] == 4


def test_tables_over_class_files(spark):
    files = spark.createDataFrame([(bytearray(b),) for b in small_classes()[:40]] + [(bytearray(b"junk"),)], "content binary")
    inputs, methods = valueflow.call_inputs(files), valueflow.summaries(files)
    assert inputs.where("op like 'INVOKE%' and target is null").count() == 0
    assert methods.where("size(reasons) > 0").count() == 0 and valueflow.flow_edges(inputs, methods).count() > 0
