"""Control flow and instruction windows. Instructions have method, pos, op and const."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_method() -> WindowSpec:
    return Window.partitionBy("method").orderBy("pos")


def normal_edges(insns: DataFrame, target: Column) -> DataFrame:
    """(method, src, dst, label): none after a return; a jump goes to its target and falls through."""
    after = F.lead("pos").over(in_method())
    step = insns.withColumn("after", after).withColumn("to", target)
    seq = F.struct(F.col("after").alias("dst"), F.when(F.col("op") == "JUMP", "FALSE").otherwise("SEQ").alias("label"))
    jump = F.struct(F.col("to").alias("dst"), F.lit("JUMP").alias("label"))
    out = F.when(F.col("op") == "RETURN", F.array().cast("array<struct<dst:int,label:string>>")).when(F.col("op") == "JUMP", F.array(seq, jump)).otherwise(F.array(seq))
    return step.select("method", F.col("pos").alias("src"), F.explode(out).alias("e")).select("method", "src", F.col("e.dst").alias("dst"), F.col("e.label").alias("label")).where("dst is not null")


def exception_edges(insns: DataFrame, handlers: DataFrame, throws: Column) -> DataFrame:
    """A range join within the method: every instruction of [start_at, end_at) that may throw goes to the handler."""
    i = insns.where(throws).select("method", "pos")
    return i.join(handlers, "method").where("pos >= start_at and pos < end_at").select("method", F.col("pos").alias("src"), F.col("handler").alias("dst"), F.lit("EXCEPTION").alias("label"))


def constants_before(insns: DataFrame, op: str, rows: int) -> DataFrame:
    """The constants loaded in the ``rows`` instructions before each ``op``, in order."""
    window = in_method().rowsBetween(-rows, -1)
    seen = F.collect_list(F.when(F.col("op") == "CONST", F.col("const"))).over(window)
    return insns.withColumn("constants", F.concat_ws(",", seen)).where(F.col("op") == op).select("method", "pos", "constants")


def last_constant(insns: DataFrame, op: str, rows: int) -> DataFrame:
    """The constant nearest before each ``op``, within ``rows`` instructions: an as-of lookup."""
    window = in_method().rowsBetween(-rows, -1)
    return insns.withColumn("pushed", F.last(F.when(F.col("op") == "CONST", F.col("const")), ignorenulls=True).over(window)).where(F.col("op") == op).select("method", "pos", "pushed")


def array_writers(insns: DataFrame, store: str = "PUTFIELD", read: str = "GETFIELD", back: int = 3) -> DataFrame:
    """Stores whose instruction ``back`` earlier reads a field: they write that field's array."""
    return insns.withColumn("before", F.lag("op", back).over(in_method())).where((F.col("op") == store) & (F.col("before") == read)).select("method", "pos")


def field_writers(fields: DataFrame) -> DataFrame:
    """(owner, name, writer, n): a row for each writer of a field, with how many it has."""
    each = fields.select("owner", "name", "writer").distinct()
    return each.join(each.groupBy("owner", "name").agg(F.count(F.lit(1)).alias("n")), ["owner", "name"])


def immediate_dominators(edges: DataFrame) -> DataFrame:
    """(method, pos, dominator): the last position that every way from position 0 to ``pos`` passes before
    it, for what is reachable; position 0 has none.

    Methods lie together in sorted partitions and are taken from the batches one by one, as
    there are far too many small ones to start a function for each.
    """
    return _by_method(edges, lambda own: [(n, d) for n, d in sorted(_immediate(own).items()) if d is not None])


def dominators(edges: DataFrame) -> DataFrame:
    """(method, pos, dominator) of all dominators, a position itself included: the ways up the immediate ones."""

    def every(own: list[tuple[int, int]]) -> list[tuple]:
        above, out = _immediate(own), []
        for n in sorted(above):
            d: int | None = n
            while d is not None:
                out.append((n, d))
                d = above[d]
        return out

    return _by_method(edges, every)


def _by_method(edges: DataFrame, f: Callable[[list[tuple[int, int]]], list[tuple]], most: int = 100_000) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, out = None, [], []
        for batch in batches:
            for method, a, b in zip(batch["method"], batch["src"], batch["dst"], strict=True):
                if method != now:
                    out += [(now, *r) for r in f(held)] if held else []
                    now, held = method, []
                    if len(out) > most:
                        yield _frame(out)
                        out = []
                held.append((a, b))
        yield _frame(out + ([(now, *r) for r in f(held)] if held else []))

    dealt = edges.select("method", "src", "dst").repartition("method").sortWithinPartitions("method")
    return dealt.mapInPandas(run, "method string, pos int, dominator int")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["method", "pos", "dominator"]).astype({"pos": "Int32", "dominator": "Int32"})


def _immediate(edges: list[tuple[int, int]]) -> dict[int, int | None]:
    """The immediate dominator of each position that 0 reaches; None for 0."""
    out: dict[int, list[int]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    # Positions in the order in which a walk leaves them, last first.
    left, seen, stack = [], {0}, [(0, iter(out.get(0, ())))]
    while stack:
        node, ahead = stack[-1]
        for b in ahead:
            if b not in seen:
                seen.add(b)
                stack.append((b, iter(out.get(b, ()))))
                break
        else:
            left.append(node)
            stack.pop()
    order = left[::-1]
    at = {n: i for i, n in enumerate(order)}
    into: list[list[int]] = [[] for _ in order]
    for a, b in edges:
        if a in at:
            into[at[b]].append(at[a])
    above = [0] + [-1] * (len(order) - 1)
    changed = True
    while changed:
        changed = False
        for n in range(1, len(order)):
            best = -1
            for p in into[n]:
                if above[p] < 0:
                    continue
                q = p if best < 0 else best
                while best >= 0 and p != q:  # where the ways up meet
                    if p > q:
                        p = above[p]
                    else:
                        q = above[q]
                best = q
            if best != above[n]:
                above[n], changed = best, True
    return {n: None if i == 0 else order[above[i]] for i, n in enumerate(order)}


def dominates(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(method, a, b, dominates): whether every way to b passes a; ``found`` has all dominators."""
    known = found.select("method", F.col("dominator").alias("a"), F.col("pos").alias("b"), F.lit(True).alias("yes"))
    return pairs.select("method", "a", "b").distinct().join(known, ["method", "a", "b"], "left").select("method", "a", "b", F.coalesce("yes", F.lit(False)).alias("dominates"))
