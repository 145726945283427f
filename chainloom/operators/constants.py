"""Integer constants through calls, and what they make unreachable.

A jump function says what a call's argument, or a method's result, is in terms of the method's
own parameters and of the results of its calls: a number, a linear form ``mul * x + add`` of one
of them, or anything. ``equations`` reads jump functions off class files, ``solve`` finds for each
variable the one number that it always has, as a fixpoint over tables, and ``unreachable`` the
instructions that these numbers rule out. Calls there don't happen, so that ``prune`` solves
again without them, which may find more.

Variables are parameters ``method|slot``, results ``method|return`` and results of calls
``method@pos``. What code that isn't loaded may call has to be named by the caller; methods
that are called by reflection only are no part of this, as elsewhere in the library.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.classfile import ClassFormatError, Method, _table, parse
from . import feasibility
from .feasibility import Linear, is_int
from .hierarchy import has
from .valueflow import is_wide, parameters

JUMPS = "method string, pos int, slot int, src string, mul int, add int, free boolean"
KNOWN = "var string, value int"
DEAD = "method string, pos int"


def _slots(descriptor: str, static: bool) -> list[tuple[int, str]]:
    at, out = 0 if static else 1, []
    for kind in parameters(descriptor):
        out.append((at, kind))
        at += 2 if is_wide(kind) else 1
    return out


def _returns_int(descriptor: str) -> bool:
    return is_int(descriptor[descriptor.index(")") + 1 :])


def _jumps(key: str, m: Method) -> Iterator[tuple]:
    """Jump functions of one method; slot -1 is its own result. What can't be reached has none."""
    given = {at: Linear(f"{key}|{at}", 1, 0) for at, kind in _slots(m.descriptor, bool(m.access & 8)) if is_int(kind)}
    results = {x.offset: Linear(f"{key}@{x.offset}", 1, 0) for x in m.instructions if 182 <= x.op <= 186 and _returns_int(x.descriptor)}
    found = feasibility.states(m, given, results)

    def row(pos: int, slot: int, value: feasibility.Value) -> tuple:
        src, mul, add = value if isinstance(value, Linear) else (None, None, value)
        return key, pos, slot, src, mul, add, value is None

    for x in m.instructions:
        if found.complete and x.offset not in found.at:
            continue
        stack = found.at[x.offset][0] if found.complete else ()
        if 182 <= x.op <= 185:
            slots = _slots(x.descriptor, x.op == 184)
            held = stack[len(stack) - len(slots) :] if slots and found.complete else [None] * len(slots)
            yield from (row(x.offset, at, value) for (at, kind), value in zip(slots, held, strict=True) if is_int(kind))
        elif x.kind == "RETURN" and _returns_int(m.descriptor):
            yield row(x.offset, -1, stack[-1] if stack else None)


def jumps(files: DataFrame) -> DataFrame:
    """Jump functions of class files (content): (method, pos, slot, src, mul, add, free).

    ``slot`` is that of the callee's parameter, -1 for the method's own result; ``src`` is null
    for a number, which ``add`` holds, and for anything.
    """
    return _table(files, JUMPS, lambda c: [row for m in c.methods for row in _jumps(f"{c.name}#{m.name}{m.descriptor}", m)])


def call_targets(instructions: DataFrame, dispatch: DataFrame) -> DataFrame:
    """(method, pos, callee) of all calls, those without inputs too, with each method that they may reach, their target if none is known."""
    calls = instructions.where("op like 'INVOKE%' and op <> 'INVOKEDYNAMIC'").select(F.concat("class", F.lit("#"), "method", "descriptor").alias("method"), "pos", F.concat("owner", F.lit("#"), "name", "target_descriptor").alias("target"))
    return calls.join(dispatch, "target", "left").select("method", "pos", F.coalesce("callee", "target").alias("callee"))


def equations(found: DataFrame, calls: DataFrame, dead: DataFrame | None = None) -> DataFrame:
    """(var, src, mul, add, free) of jump functions and ``calls`` (method, pos, callee), but for places of ``dead``.

    The result of a call that may reach a method without a body may be anything.
    """
    if dead is not None:
        found, calls = (t.join(dead, ["method", "pos"], "left_anti") for t in (found, calls))
    arguments = found.where("slot >= 0").join(calls.select("method", "pos", "callee").distinct(), ["method", "pos"])
    passed = arguments.select(F.concat_ws("|", "callee", F.col("slot").cast("string")).alias("var"), "src", "mul", "add", "free")
    own = F.concat_ws("|", "method", F.lit("return"))
    back = found.where("slot = -1").select(own.alias("var"), "src", "mul", "add", "free")
    bodies = back.select(F.col("var").alias("src")).distinct().withColumn("body", F.lit(True))
    results = calls.where(F.col("callee").rlike(r"\)[ISBCZ]$")).select(F.concat(F.col("method"), F.lit("@"), F.col("pos").cast("string")).alias("var"), F.concat_ws("|", "callee", F.lit("return")).alias("src")).distinct()
    heard = results.join(bodies, "src", "left").select("var", F.when(F.col("body"), F.col("src")).alias("src"), F.lit(1).alias("mul"), F.lit(0).alias("add"), F.col("body").isNull().alias("free"))
    return passed.unionByName(back).unionByName(heard)


def _wrapped(value: Column) -> Column:
    """The low 32 bits of a long, with their sign."""
    return F.shiftright(F.shiftleft(value, 32), 32).cast("int")


def solve(found: DataFrame, rounds: int = 200) -> tuple[DataFrame, bool]:
    """(var, value) of ``found`` (var, src, mul, add, free): value is the one number that a variable has, null if it varies.

    Variables that nothing reaches have no row. A variable changes twice at most, from nothing
    to a number to varying, and each round follows only those that changed. If ``rounds`` don't suffice,
    no number is sure: the flag is false and every value null. Null variables are left out,
    and equal equations count once.
    """
    eqs = cut(found.where("var is not null").distinct())
    hops = cut(eqs.where("src is not null and not free").select("var", "src", "mul", "add"))
    # Candidates meet before the shuffle: least, greatest and whether one of them varies.
    meet = lambda t: t.groupBy("var").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max("varies").alias("varies")).select("var", "low", (F.col("varies") | (F.col("low") < F.col("high"))).alias("varies"))
    start = eqs.where("free or src is null").select("var", F.when(~F.col("free"), F.col("add")).alias("value"), F.col("free").alias("varies"))
    # All variables are there from the start, so that a round looks what changed up in the state, which needn't be shuffled.
    now = cut(eqs.select("var").distinct().join(meet(start), "var", "left").select("var", "low", "varies", F.col("varies").isNotNull().alias("fresh")))
    sure = lambda c: F.coalesce(c, F.lit(False))
    for _ in range(rounds):
        new = now.where("fresh").select(F.col("var").alias("src"), "low", F.col("varies"))
        value = _wrapped(F.col("mul").cast("long") * F.col("low") + F.col("add"))
        moved = new.join(hops, "src").select("var", F.when(~F.col("varies"), value).alias("value"), "varies")
        heard = meet(moved).select("var", F.col("low").alias("other"), F.col("varies").alias("loose"))
        both = now.join(heard, "var", "left")
        varies = sure(F.col("varies")) | sure(F.col("loose")) | sure(F.col("low") != F.col("other"))
        met = F.when(F.coalesce("varies", "loose").isNotNull(), varies)
        fresh = met.isNotNull() & (F.col("varies").isNull() | (varies & ~F.col("varies")))
        now = cut(both.select("var", F.coalesce("low", "other").alias("low"), met.alias("varies"), fresh.alias("fresh")))
        if now.where("fresh").isEmpty():
            return now.where("varies is not null").select("var", F.when(~F.col("varies"), F.col("low")).alias("value")), True
    return now.where("varies is not null").select("var", F.lit(None).cast("int").alias("value")), False


def open_slots(methods: DataFrame, outside: DataFrame, pairs: DataFrame, loaded: DataFrame) -> DataFrame:
    """(var) of parameters that code out of sight may set: of the methods in ``outside`` (method), and of those that
    can override a method of a type that isn't loaded. ``methods`` is as ``classfile`` gives it, ``pairs`` has ancestor and
    descendant, ``loaded`` name."""
    foreign = pairs.where("ancestor <> 'java/lang/Object'").join(loaded.select(F.col("name").alias("ancestor")), "ancestor", "left_anti").select(F.col("descendant").alias("owner")).distinct()
    called_back = methods.join(foreign, "owner", "left_semi").where(~has(F.col("access"), 8) & ~has(F.col("access"), 2) & (F.col("name") != "<init>")).select("method")
    at = methods.join(outside.select("method").union(called_back).distinct(), "method", "left_semi")
    # Slots up to twice the number of parameters hold all that there are; the others match nothing.
    n = F.size(F.regexp_extract_all(F.regexp_extract("descriptor", r"^\(([^)]*)\)", 1), F.lit(r"\[*(?:[BCDFIJSZ]|L[^;]+;)"), F.lit(0)))
    return at.select("method", F.explode(F.sequence(F.lit(0), 2 * n)).alias("slot")).select(F.concat_ws("|", "method", F.col("slot").cast("string")).alias("var"))


def unreachable(files: DataFrame, known: DataFrame) -> DataFrame:
    """(method, pos) of instructions that nothing reaches, given ``known`` (var, value); null values say nothing.

    Class files have content and name; what a class is told fits in one row, as its methods do. Handlers whose
    instructions can't throw, or can't be reached, are not reached either. A method whose search
    is not completed has no rows.
    """
    var = F.col("var")
    told = known.where("value is not null and not endswith(var, '|return')").groupBy(F.substring_index(var, "#", 1).alias("name")).agg(F.map_from_entries(F.collect_list(F.struct("var", "value"))).alias("known"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    columns = [c.split()[0] for c in DEAD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, pairs in zip(batch["content"], batch["known"], strict=True):
                at = dict(pairs)
                rows = []
                for m in parse_or_none(content):
                    rows += _dead(*m, at)
                yield pd.DataFrame(rows, columns=columns).astype({"pos": "Int32"})

    def parse_or_none(content) -> list[tuple[str, Method]]:
        try:
            c = parse(bytes(content))
        except (ClassFormatError, UnicodeDecodeError, IndexError):
            return []
        return [(f"{c.name}#{m.name}{m.descriptor}", m) for m in c.methods]

    return files.select("name", "content").join(told, "name", "left").select("content", F.coalesce("known", empty).alias("known")).mapInPandas(run, DEAD)


def _dead(key: str, m: Method, at: dict[str, int]) -> list[tuple[str, int]]:
    given = {slot: at[f"{key}|{slot}"] for slot, kind in _slots(m.descriptor, bool(m.access & 8)) if is_int(kind) and f"{key}|{slot}" in at}
    results = {x.offset: at[f"{key}@{x.offset}"] for x in m.instructions if 182 <= x.op <= 186 and f"{key}@{x.offset}" in at}
    found = feasibility.states(m, given, results)
    return [(key, x.offset) for x in m.instructions if x.offset not in found.at] if found.complete else []


class Pruned(NamedTuple):
    dead: DataFrame  # method, pos
    known: DataFrame  # var, value
    complete: bool


def prune(files: DataFrame, calls: DataFrame, open_: DataFrame, turns: int = 3) -> Pruned:
    """Places that constants rule out. ``files`` has name and content, ``calls`` method, pos and callee, ``open_`` var.

    At most ``turns`` times the places found so far are taken out and the rest is solved again;
    each turn's result is sound, so that stopping early only finds less. If one can't be
    completed, what is known stays what the turn before found.
    """
    found = cut(jumps(files))
    free = open_.select("var", F.lit(None).cast("string").alias("src"), F.lit(None).cast("int").alias("mul"), F.lit(None).cast("int").alias("add"), F.lit(True).alias("free"))
    dead, size, known = None, -1, None
    for _ in range(turns):
        now, complete = solve(equations(found, calls, dead).unionByName(free))
        if known is None or complete:
            known = now
        if not complete:
            return Pruned(dead if dead is not None else unreachable(files, known), known, False)
        dead = cut(unreachable(files, known))
        n = dead.count()
        if n == size:
            break
        size = n
    return Pruned(dead, known, True)
