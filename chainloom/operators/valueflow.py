"""Where values come from: a bounded abstract interpretation of each method, and what follows from it.

A state is the stack and the local variables, each value a set of origins. Origins have one
canonical text, whose order is the order of kinds: a parameter, an instruction, a call's
result, a field's content with its receiver's origin, a constant, or unknown. States meet by
union up to a bound; what is cut off sets a flag, so every result tells whether it is whole.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.classfile import ClassFormatError, Instruction, Method, parse

MOST_ORIGINS, MOST_STEPS, MOST_NESTING = 512, 100_000, 8
UNKNOWN = "6:unknown"
Origins = frozenset
_TYPE = re.compile(r"\[*(?:[BCDFIJSZ]|L[^;]+;)")


class Flow(NamedTuple):
    """What one method does: origins of every call's and field write's inputs and of what it returns."""

    inputs: list[tuple[int, int, list[str]]]  # instruction, ordinal (-1: receiver), origins
    returns: list[str]
    reasons: list[str]


def parameters(descriptor: str) -> list[str]:
    return _TYPE.findall(descriptor[1 : descriptor.index(")")])


def is_wide(kind: str) -> bool:
    return kind in ("J", "D")


def _bounded(origins: set, reasons: set) -> Origins:
    if len(origins) > MOST_ORIGINS:
        reasons.add("ORIGINS_TRUNCATED")
        origins = set(sorted(origins)[:MOST_ORIGINS])
    return frozenset(origins)


def field_origin(owner: str, name: str, descriptor: str, static: bool, receivers: Origins) -> str:
    """A field's origin names its receiver's, down to a depth."""
    inner = "" if static else min(receivers, default=UNKNOWN)
    if inner.count("4:field:") >= MOST_NESTING:
        inner = "9:depth"
    return f"4:field:{owner}:{name}:{descriptor}:{str(static).lower()}:<{inner}>"


class _Machine:
    """Runs the instructions of one method on sets of origins."""

    def __init__(self, method: Method):
        self.method, self.code = method, method.instructions
        self.reasons: set[str] = set()
        self.inputs: dict[tuple[int, int], set] = {}
        self.returns: set = set()

    def start(self) -> tuple[tuple, dict]:
        slots, at = {}, 0
        if not self.method.access & 8:
            slots[0], at = frozenset(["1:param:0"]), 1
        for kind in parameters(self.method.descriptor):
            slots[at] = frozenset([f"1:param:{at}"])
            at += 2 if is_wide(kind) else 1
        return (), slots

    def note(self, pos: int, ordinal: int, origins: Origins) -> None:
        self.inputs.setdefault((pos, ordinal), set()).update(origins)

    def run(self) -> Flow:
        seen: dict[int, tuple[tuple, dict]] = {}
        todo, steps = [], 0

        def reach(pos: int, stack: tuple, local: dict) -> None:
            if pos >= len(self.code):
                return
            if pos not in seen:
                seen[pos] = (stack, local)
                todo.append(pos)
                return
            old_stack, old_local = seen[pos]
            if len(old_stack) != len(stack) or any(a[1] != b[1] for a, b in zip(old_stack, stack, strict=True)):
                self.reasons.add("STACK_MISMATCH")
                return
            new_stack = tuple((a if a[0] >= b[0] else (_bounded(set(a[0] | b[0]), self.reasons), a[1])) for a, b in zip(old_stack, stack, strict=True))
            new_local = dict(old_local)
            for slot, origins in local.items():
                if not new_local.get(slot, frozenset()) >= origins:
                    new_local[slot] = _bounded(set(new_local.get(slot, frozenset()) | origins), self.reasons)
            if new_stack != old_stack or new_local != old_local:
                seen[pos] = (new_stack, new_local)
                todo.append(pos)

        if self.code:
            reach(0, *self.start())
        while todo:
            steps += 1
            if steps > MOST_STEPS:
                self.reasons.add("STEPS_EXCEEDED")
                break
            pos = todo.pop()
            stack, local = seen[pos]
            for begin, end, handler, _ in self.method.handlers:
                if begin <= pos < end:
                    reach(handler, ((frozenset([UNKNOWN]), False),), local)
            try:
                stack, local = self.step(pos, self.code[pos], list(stack), dict(local))
            except IndexError:
                self.reasons.add("STACK_UNDERFLOW")
                continue
            x = self.code[pos]
            for target in x.targets:
                reach(target, stack, local)
            if x.kind not in ("RETURN", "THROW", "GOTO", "SWITCH") and x.op != 169:
                if x.kind == "JSR":
                    stack = stack[:-1]
                reach(pos + 1, stack, local)
        inputs = [(pos, ordinal, sorted(o)) for (pos, ordinal), o in sorted(self.inputs.items())]
        return Flow(inputs, sorted(self.returns), sorted(self.reasons))

    def step(self, pos: int, x: Instruction, stack: list, local: dict) -> tuple[tuple, dict]:
        op, own = x.op, frozenset([f"2:insn:{pos}"])
        push = lambda origins, wide=False: stack.append((origins, wide))
        pop = lambda: stack.pop()[0]

        def drop(n: int) -> None:
            for _ in range(n):
                stack.pop()

        def under(values: int, depth: int) -> None:
            """Copies the top values below the next ones; both count single slots."""

            def take(slots: int) -> list:
                out = []
                while slots > 0:
                    out.append(stack.pop())
                    slots -= 2 if out[-1][1] else 1
                return out[::-1]

            top, below = take(values), take(depth)
            stack.extend(top + below + top)

        if 1 <= op <= 20:
            push(frozenset([f"5:constant:{x.constant}"]), op in (9, 10, 14, 15, 20))
        elif 21 <= op <= 45:
            kind = op - 21 if op <= 25 else (op - 26) // 4
            push(local.get(x.local, frozenset([UNKNOWN])), kind in (1, 3))
        elif 46 <= op <= 53:
            drop(1)
            array = pop()
            if op == 50:
                self.note(pos, -1, array)
            push(array | own if op == 50 else own, op in (47, 49))
        elif 54 <= op <= 78:
            kind = op - 54 if op <= 58 else (op - 59) // 4
            local[x.local] = pop()
            if kind in (1, 3):
                local.pop(x.local + 1, None)
        elif 79 <= op <= 86:
            value = pop()
            drop(1)
            array = pop()
            if op == 83:
                self.note(pos, -1, array)
                self.note(pos, 0, value)
        elif op == 87:
            drop(1)
        elif op == 88:
            drop(1 if stack[-1][1] else 2)
        elif 89 <= op <= 91:
            under(1, op - 89)
        elif 92 <= op <= 94:
            under(2, op - 92)
        elif op == 95:
            stack[-1], stack[-2] = stack[-2], stack[-1]
        elif 96 <= op <= 115:
            drop(2)
            push(own, op % 2 == 1)
        elif 116 <= op <= 119:
            drop(1)
            push(own, op % 2 == 1)
        elif 120 <= op <= 131:
            drop(2)
            push(own, op % 2 == 1)
        elif op == 132:
            local[x.local] = own
        elif 133 <= op <= 147:
            drop(1)
            push(own, op in (133, 135, 138, 140, 141, 143))
        elif 148 <= op <= 152:
            drop(2)
            push(own)
        elif 153 <= op <= 158 or op in (170, 171, 198, 199, 191, 194, 195):
            drop(1)
        elif 159 <= op <= 166:
            drop(2)
        elif op in (168, 201):
            push(own)
        elif 172 <= op <= 176:
            self.returns |= pop()
        elif op in (178, 180):
            receivers = pop() if op == 180 else frozenset()
            push(frozenset([field_origin(x.owner, x.name, x.descriptor, op == 178, receivers)]), is_wide(x.descriptor))
        elif op in (179, 181):
            self.note(pos, 0, pop())
            if op == 181:
                self.note(pos, -1, pop())
        elif 182 <= op <= 186:
            kinds = parameters(x.descriptor)
            for ordinal in range(len(kinds) - 1, -1, -1):
                self.note(pos, ordinal, pop())
            if op in (182, 183, 185):
                self.note(pos, -1, pop())
            result = x.descriptor[x.descriptor.index(")") + 1 :]
            if result != "V":
                push(frozenset([f"3:call:{pos}"]), is_wide(result))
        elif op == 187:
            push(own)
        elif op in (188, 189, 190, 193):
            drop(1)
            push(own)
        elif op == 197:
            drop(x.dims)
            push(own)
        elif op not in (0, 167, 169, 177, 192, 200):
            self.reasons.add("UNMODELED_OPCODE")
        return tuple(stack), local


def interpret(method: Method) -> Flow:
    return _Machine(method).run()


INPUTS = "method string, pos int, op string, target string, ordinal int, origins array<string>"
METHODS = "method string, access int, returns array<string>, reasons array<string>"


def _methods(files: DataFrame, schema: str, rows) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                try:
                    c = parse(bytes(content))
                except (ClassFormatError, UnicodeDecodeError, IndexError, struct.error):
                    continue
                found = [r for m in c.methods for r in rows(f"{c.name}#{m.name}{m.descriptor}", m)]
                if found:
                    yield pd.DataFrame(found, columns=names)

    return files.select("content").mapInPandas(run, schema)


def call_inputs(files: DataFrame) -> DataFrame:
    """One row per input of every call, field write and array store, and the array of every array load, of class files (content)."""

    def rows(key: str, m: Method) -> Iterator[tuple]:
        for pos, ordinal, origins in interpret(m).inputs:
            x = m.instructions[pos]
            target = None if x.owner is None and x.name is None else f"{x.owner}#{x.name}{x.descriptor}" if x.op >= 182 else f"{x.owner}#{x.name}:{x.descriptor}"
            yield key, pos, x.kind, target, ordinal, origins

    return _methods(files, INPUTS, rows)


def summaries(files: DataFrame) -> DataFrame:
    """One row per method: what it may return, and why its analysis isn't whole, if it isn't."""

    def rows(key: str, m: Method) -> Iterator[tuple]:
        flow = interpret(m)
        yield key, m.access, flow.returns, flow.reasons

    return _methods(files, METHODS, rows)


def placed(used: DataFrame, inputs: DataFrame) -> DataFrame:
    """``used`` (method, origin and more) with ``src``: the place of each origin that has one, a parameter, a field or a call's result."""
    kind = F.substring("origin", 1, 1)
    slot = F.regexp_extract("origin", "^1:param:([0-9]+)$", 1)
    place = F.when(kind == "1", F.concat_ws("|", "method", slot)).when(kind == "4", F.concat(F.lit("field:"), F.regexp_extract("origin", "^4:field:([^:]+:[^:]+:[^:]+):", 1)))
    callee_pos = F.regexp_extract("origin", "^3:call:([0-9]+)$", 1)
    calls = inputs.where("op like 'INVOKE%'").select("method", F.col("pos").alias("at"), F.when(F.col("op") != "INVOKEDYNAMIC", F.col("target")).alias("called")).distinct()
    local = used.where(kind.isin("1", "4")).withColumn("src", place)
    result = used.where(kind == "3").withColumn("at", callee_pos.cast("int")).join(calls, ["method", "at"], "left")
    return local.unionByName(result.withColumn("src", F.concat_ws("|", F.coalesce("called", F.concat_ws("@", "method", "at")), F.lit("return"))).drop("at", "called"))


def flow_edges(inputs: DataFrame, methods: DataFrame, dispatch: DataFrame | None = None) -> DataFrame:
    """(src, dst, reason): values that flow from one place to another, as edges for a fixpoint.

    Places are ``method|slot`` for parameters, ``method|return``, and fields by owner, name and
    type. An argument flows to its parameter, a field write to its field, a field's content to
    where it is used, and a result to where the call's value is used. ``dispatch``
    widens calls to more callees; without it a call goes to its own target. It has target and
    callee, and where it also has method and pos it is for single calls. A dynamic call's result
    is a place of its own.
    """
    both = placed(inputs.withColumn("origin", F.explode("origins")), inputs)
    static = F.col("op").isin("INVOKESTATIC", "INVOKEDYNAMIC")
    # A parameter's slot follows from the widths of those before it.
    before = F.slice(F.regexp_extract_all(F.regexp_extract("target", r"#[^(]*\(([^)]*)\)", 1), F.lit(r"\[*(?:[BCDFIJSZ]|L[^;]+;)"), F.lit(0)), F.lit(1), F.greatest("ordinal", F.lit(0)))
    width = F.size(before) + F.size(F.filter(before, lambda t: t.isin("J", "D")))
    to_slot = F.when(F.col("ordinal") < 0, 0).otherwise(width + F.when(static, 0).otherwise(1))
    to_field = F.concat(F.lit("field:"), F.regexp_replace("target", "#", ":"))
    passed = both.where("op like 'INVOKE%'")
    more = None
    if dispatch is not None:
        by = [c for c in ("method", "pos", "target") if c in dispatch.columns]
        passed = passed.join(dispatch.select(*by, "callee"), by, "left").withColumn("into", F.coalesce("callee", "target")).drop("callee")
        more = dispatch.where("callee <> target").select(F.concat_ws("|", "callee", F.lit("return")).alias("src"), F.concat_ws("|", "target", F.lit("return")).alias("dst"), F.lit("return").alias("reason"))
    else:
        passed = passed.withColumn("into", F.col("target"))
    arguments = passed.select("src", F.concat_ws("|", "into", to_slot.cast("string")).alias("dst"), F.lit("argument").alias("reason"))
    writes = both.where("op in ('PUTFIELD', 'PUTSTATIC') and ordinal = 0").select("src", to_field.alias("dst"), F.lit("field").alias("reason"))
    back = placed(methods.select("method", F.explode("returns").alias("origin")), inputs)
    returned = back.select("src", F.concat_ws("|", "method", F.lit("return")).alias("dst"), F.lit("return").alias("reason"))
    found = arguments.unionByName(writes).unionByName(returned)
    return (found if more is None else found.unionByName(more)).distinct()
