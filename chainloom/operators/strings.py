"""What is known of the text of a string, through concatenation, builders, fields and calls.

A shape is a prefix, a suffix, whether that is the whole text, and parts that surely lie in it.
Shapes meet by their common prefix, common suffix and common parts; what isn't bounded in
length is cut, and a shape that has changed several times is widened to what no longer does.

``equations`` reads them off class files: a variable is one of a sequence of pieces, each of
which is a constant, another variable or unknown. ``shapes`` solves them and the copies that
calls make as a fixpoint over tables. The common prefix of any number of texts is that of the
least and the greatest of them, so that meeting is a plain aggregate, before the shuffle too.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.classfile import ClassFile, Method, _table
from .valueflow import interpret, parameters

MOST, MOST_PARTS = 128, 8
#: Changes of a variable's shape before what still changes is given up.
WIDEN_AFTER = 6
EQUATIONS = "var string, pieces array<array<string>>"
SHAPE = "prefix string, suffix string, exact boolean, parts array<string>"
BUILDERS = ("java/lang/StringBuilder", "java/lang/StringBuffer")
_TEXT = ("Ljava/lang/String;", "Ljava/lang/Object;", "Ljava/lang/CharSequence;")
#: A shape: prefix, suffix, whether both are the whole text, parts within.
Shape = tuple[str, str, bool, tuple[str, ...]]
ANY: Shape = ("", "", False, ())


def constant(text: str) -> Shape:
    return (text, text, True, ()) if len(text) <= MOST else (text[:MOST], text[-MOST:], False, ())


def joined(a: Shape, b: Shape) -> Shape:
    """The shape of one text followed by another."""
    prefix = a[0] + b[0] if a[2] else a[0]
    suffix = a[1] + b[1] if b[2] else b[1]
    if a[2] and b[2]:
        return constant(prefix)
    # What is known in the middle becomes a part.
    middle = [a[1] + b[0]] if a[1] + b[0] else []
    parts = sorted({*a[3], *b[3], *middle}, key=lambda p: (-len(p), p))[:MOST_PARTS]
    return prefix[:MOST], suffix[-MOST:] if suffix else "", False, tuple(sorted(p[:MOST] for p in parts))


def holds(shape: Shape, part: str) -> bool:
    """Whether every text of this shape surely has ``part`` in it."""
    return any(part in known for known in (shape[0], shape[1], *shape[3]))


def met(a: Shape, b: Shape) -> Shape:
    """The least shape that both texts have."""
    if a == b:
        return a
    prefix = os.path.commonprefix([a[0], b[0]])
    suffix = os.path.commonprefix([a[1][::-1], b[1][::-1]])[::-1]
    known = {*a[3], *b[3], *(x for s in (a, b) for x in s[:2] if x)}
    parts = sorted((p for p in known if holds(a, p) and holds(b, p)), key=lambda p: (-len(p), p))[:MOST_PARTS]
    return prefix, suffix, False, tuple(sorted(p for p in parts if p not in (prefix, suffix)))


def _method(key: str, m: Method, c: ClassFile) -> Iterator[tuple[str, list[list[str]]]]:
    flow, code = interpret(m), m.instructions
    inputs = {(pos, ordinal): origins for pos, ordinal, origins in flow.inputs}
    touched: dict[str, int] = {}
    for (pos, ordinal), origins in inputs.items():
        if ordinal == -1 and code[pos].owner in BUILDERS and code[pos].name not in ("<init>", "toString", "length"):
            for o in origins:
                touched[o] = touched.get(o, 0) + 1

    def atoms(origins: list[str], kind: str = _TEXT[0]) -> list[str]:
        out = []
        for o in origins:
            tag, _, rest = o.partition(":")
            if tag == "5":
                what, _, text = rest.partition(":")[2].partition(":")
                known = what == "string" and kind in _TEXT or what in ("int", "long") and kind in ("I", "J", "S", "B") or what == "int" and kind == "C" and 0 <= int(text) < 0xD800
                out.append("?" if not known else f"c:{chr(int(text))}" if kind == "C" else f"c:{text}")
            elif tag == "1" and kind in _TEXT:
                out.append(f"v:{key}|{rest.partition(':')[2]}")
            elif tag == "4" and kind in _TEXT:
                out.append("v:field:" + ":".join(rest.split(":")[1:4]))
            elif tag in ("2", "3") and kind in _TEXT:
                out.append(f"v:{key}|{o}")
            else:
                out.append("?")
        return sorted(set(out)) or ["?"]

    for x in code:
        at, pos = f"{key}|3:call:{x.offset}", x.offset
        given = lambda ordinal, kind=_TEXT[0]: atoms(inputs.get((pos, ordinal), []), kind)  # noqa: E731, B023
        if x.kind == "NEW":
            own = f"2:insn:{pos}"
            made = [q for (q, ordinal), o in inputs.items() if ordinal == -1 and code[q].name == "<init>" and o == [own]]
            if x.owner in BUILDERS and len(made) == 1 and touched.get(own, 0) <= 1:
                start = code[made[0]].descriptor
                yield f"{key}|{own}", [["c:"]] if start in ("()V", "(I)V") else [atoms(inputs.get((made[0], 0), []))] if start == "(Ljava/lang/String;)V" else [["?"]]
            else:
                yield f"{key}|{own}", [["?"]]
        elif x.kind == "INVOKEDYNAMIC":
            factory = c.bootstraps[x.bootstrap]
            if factory.factory.name == "makeConcatWithConstants" and factory.arguments and factory.arguments[0].startswith("string:"):
                pieces, plain, n, fixed, kinds = [], "", 0, iter(factory.arguments[1:]), parameters(x.descriptor)
                for ch in factory.arguments[0][7:]:
                    if ch not in "\x01\x02":
                        plain += ch
                        continue
                    pieces += [[f"c:{plain}"]] if plain else []
                    plain = ""
                    if ch == "\x01":
                        pieces.append(given(n, kinds[n]))
                        n += 1
                    else:
                        text = next(fixed, "")
                        pieces.append([f"c:{text[7:]}" if text.startswith("string:") else "?"])
                yield at, pieces + ([[f"c:{plain}"]] if plain or not pieces else [])
            else:
                yield at, [["?"]]
        elif x.kind.startswith("INVOKE"):
            result, kinds = x.descriptor[x.descriptor.index(")") + 1 :], parameters(x.descriptor)
            if x.owner in BUILDERS and x.name == "append" and len(kinds) == 1:
                receivers = inputs.get((pos, -1), [])
                free = all(touched.get(o, 0) <= 1 for o in receivers)  # else another call may have changed it meanwhile
                yield at, [given(-1), given(0, kinds[0])] if free else [["?"]]
            elif x.owner in BUILDERS and x.name == "toString":
                yield at, [given(-1)]
            elif x.owner == "java/lang/String" and x.name == "concat":
                yield at, [given(-1), given(0)]
            elif x.owner == "java/lang/String" and x.name in ("valueOf", "toString", "intern") and (kinds or [_TEXT[0]])[0] in (*_TEXT, "I", "J", "C"):
                yield at, [given(0, kinds[0]) if kinds else given(-1)]
            elif x.owner in BUILDERS and result != "V":
                yield at, [["?"]]
            for ordinal, kind in enumerate(kinds):
                if kind in _TEXT:
                    yield f"{key}@{pos}:{ordinal}", [given(ordinal)]
        elif x.kind in ("PUTFIELD", "PUTSTATIC") and x.descriptor in _TEXT:
            yield f"field:{x.owner}:{x.name}:{x.descriptor}", [given(0)]
        elif x.kind in ("AALOAD", "NEWARRAY"):
            yield f"{key}|2:insn:{pos}", [["?"]]
    if m.descriptor[m.descriptor.index(")") + 1 :] in _TEXT and flow.returns:
        yield f"{key}|return", [atoms(flow.returns)]


def equations(files: DataFrame) -> DataFrame:
    """(var, pieces): what the strings of class files are made of. Variables are named as in ``heapfacts``."""
    return _table(files, EQUATIONS, lambda c: [row for m in c.methods for row in _method(f"{c.name}#{m.name}{m.descriptor}", m, c)])


def _evaluated(pieces, names, shapes) -> Shape | None:
    known = dict(zip(names, shapes, strict=True))
    out = constant("")
    for alternatives in pieces:
        found = None
        for atom in alternatives:
            one = constant(atom[2:]) if atom[0] == "c" else ANY if atom == "?" else known.get(atom[2:])
            if one is not None:
                found = one if found is None else met(found, one)
        if found is None:
            return None
        out = joined(out, found)
    return out


def _shape(s) -> Shape:
    return s["prefix"], s["suffix"], bool(s["exact"]), tuple(s["parts"])


def _evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [_evaluated(p, [k["name"] for k in known], [_shape(k) for k in known]) for p, known in zip(b["pieces"], b["known"], strict=True)]
        rows = [(v, *s[:3], list(s[3])) for v, s in zip(b["var"], found, strict=True) if s is not None]
        yield pd.DataFrame(rows, columns=["var", "prefix", "suffix", "exact", "parts"])


def _all_met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One shape out of the least and greatest prefix and suffix, and what was known before."""
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            same = r.exact and r.low == r.high
            prefix = r.low if same else os.path.commonprefix([r.low, r.high])
            suffix = prefix if same else os.path.commonprefix([r.back_low, r.back_high])[::-1]
            now: Shape = (prefix, suffix, bool(same), tuple(p for p in (r.parts if r.parts is not None else ()) if p not in (prefix, suffix)))
            age = 0
            if r.old is not None:
                before, age = _shape(r.old), r.old["age"]
                now = met(before, now)
                age += now != before
                if age > WIDEN_AFTER and now != before:
                    now = now[0] if now[0] == before[0] else "", now[1] if now[1] == before[1] else "", False, now[3] if now[3] == before[3] else ()
            rows.append((r.var, *now[:3], list(now[3]), age))
        yield pd.DataFrame(rows, columns=["var", "prefix", "suffix", "exact", "parts", "age"])


def shapes(found: DataFrame, copies: DataFrame, open_: DataFrame, rounds: int = 60) -> tuple[DataFrame, bool]:
    """(var, prefix, suffix, exact, parts) of every variable that can have a text, and whether all rounds that it takes were taken.

    ``found`` has var and pieces, ``copies`` src and dst, such as from arguments to parameters;
    the variables of ``open_`` (var) may be any text.
    """
    eqs = cut(found.withColumn("id", F.monotonically_increasing_id()))
    refs = cut(eqs.select("id", F.explode(F.array_distinct(F.flatten("pieces"))).alias("atom")).where("atom like 'v:%'").select("id", F.substring("atom", 3, 1 << 30).alias("name")))
    hops = cut(copies.select("src", "dst").distinct())
    free = open_.select("var", F.lit("").alias("prefix"), F.lit("").alias("suffix"), F.lit(False).alias("exact"), F.array().cast("array<string>").alias("parts"))
    schema = f"var string, {SHAPE}"
    now = cut(free.distinct().withColumn("age", F.lit(0)))
    of: Column = F.struct("prefix", "suffix", "exact", "parts", "age")
    for _ in range(rounds):
        known = refs.join(now.withColumnRenamed("var", "name"), "name").groupBy("id").agg(F.collect_list(F.struct("name", "prefix", "suffix", "exact", "parts")).alias("known"))
        empty = F.array().cast(f"array<struct<name: string, {SHAPE.replace(' string', ': string').replace(' boolean', ': boolean').replace(' array', ': array')}>>")
        made = eqs.join(known, "id", "left").select("var", "pieces", F.coalesce("known", empty).alias("known")).mapInPandas(_evaluate, schema)
        moved = now.join(hops, now.var == hops.src).select(F.col("dst").alias("var"), "prefix", "suffix", "exact", "parts")
        every = cut(made.unionByName(moved).unionByName(free))
        back = F.reverse("suffix")
        ends = every.groupBy("var").agg(F.min("prefix").alias("low"), F.max("prefix").alias("high"), F.min(back).alias("back_low"), F.max(back).alias("back_high"), F.min("exact").alias("exact"), F.count(F.lit(1)).alias("n"))
        # A part is kept if every text has it, as a part or within what is known at its ends.
        asked = every.select("var", F.explode(F.concat("parts", F.array("prefix", "suffix"))).alias("part")).where("part <> ''").distinct()
        sure = asked.join(every, "var").groupBy("var", "part").agg(F.min(F.exists(F.concat("parts", F.array("prefix", "suffix")), lambda k: F.contains(k, F.col("part")))).alias("all")).where("all")
        order = F.array_sort(F.collect_list(F.struct((-F.length("part")).alias("l"), "part")))
        parts = sure.groupBy("var").agg(F.array_sort(F.transform(F.slice(order, 1, MOST_PARTS), lambda s: s["part"])).alias("parts"))
        old = now.select("var", of.alias("old"))
        after = cut(ends.join(parts, "var", "left").join(old, "var", "left").mapInPandas(_all_met, f"{schema}, age int"))
        same = after.join(now, ["var", "prefix", "suffix", "exact", "parts"], "left_anti").isEmpty()
        now = after
        if same:
            return now.drop("age"), True
    return now.drop("age"), False
