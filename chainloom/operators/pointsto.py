"""Points-to sets by inclusion: which allocated objects a variable can hold, field by field.

Facts are four tables. ``allocs`` (var, site) puts an object into a variable, ``copies`` (src,
dst) makes dst hold what src holds, ``stores`` (base, field, src) and ``loads`` (base, field,
dst) write and read a field of every object that base holds. Objects are named by the place
that allocates them. Elements of arrays and containers are fields with a name of their own.

A field of an object is a variable too, its cell. Stores and loads of a base become copies into
and out of the cells of what the base holds, so a round has two joins: new objects go along
known copies, and copies that are new take along all objects that their source has. Both send
only what the round before added. What a variable can hold, however large, is rows and never a
list; a base, a site or a variable that most rows share is a skewed join, which adaptive
execution splits.

Facts that share no variable and no object, over any number of steps, can't meet. So they are parted
into what hangs together first. A part of at most ``SMALL`` facts goes to a task as it is, which
ends its rounds there; nothing of it is sent again. The rounds above are those of the larger parts.

The object ``UNKNOWN`` stands for all that analysis didn't see being made. It is in every field
of itself, and what is stored into it is kept in its cells as for any object.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import fixpoint

UNKNOWN = "unknown"
ELEMENT = "[]"
FEW = 8
#: Facts of a part that one task can take: its sets are bits; where each of 666 objects meets each of 1,334 uses it took about 520 MB.
SMALL = 2000
ALLOC, COPY, STORE, LOAD = range(4)
#: Fixed names: methods of the platform's containers by what they do with an element: put the argument
#: of this ordinal in, take one out, or give a view that has the same elements.
CONTAINER_METHODS = {
    **dict.fromkeys(("add", "addFirst", "addLast", "addElement", "offer", "offerFirst", "offerLast", "push"), 0),
    **dict.fromkeys(("put", "putIfAbsent", "set", "insertElementAt", "replace"), 1),
    **dict.fromkeys(("get", "getFirst", "getLast", "getOrDefault", "next", "previous", "nextElement", "poll", "pollFirst", "pollLast", "pop", "peek", "peekFirst", "peekLast", "remove", "removeFirst", "removeLast", "take", "element", "elementAt", "first", "last", "firstElement", "lastElement", "getValue"), "take"),
    **dict.fromkeys(("iterator", "listIterator", "descendingIterator", "values", "entrySet", "elements", "stream", "subList", "toArray", "unmodifiableList", "unmodifiableCollection", "unmodifiableSet", "unmodifiableMap", "synchronizedList", "synchronizedMap", "asList"), "view"),
}


def cell(site: Column, field: Column) -> Column:
    """The variable that is a field of an object."""
    return F.concat(site, F.lit("."), field)


def solve(allocs: DataFrame, copies: DataFrame, stores: DataFrame, loads: DataFrame, rounds: int = 200) -> tuple[DataFrame, bool]:
    """(var, site), cells included, and whether all of it was found within ``rounds``."""
    row = lambda df, kind, a, b, c=None: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), (F.col(c) if c else F.lit(None).cast("string")).alias("c"))
    facts = row(allocs, ALLOC, "var", "site").union(row(copies, COPY, "src", "dst")).union(row(stores, STORE, "base", "src", "field")).union(row(loads, LOAD, "base", "dst", "field"))
    parted = cut(_parted(cut(facts)))
    large = cut(parted.groupBy("part").count().where(F.col("count") > SMALL).select("part"))
    small = parted.join(large, "part", "left_anti").repartition("part").sortWithinPartitions("part")
    ended = cut(small.mapInArrow(lambda batches: _ended(batches, rounds), "var string, site string, complete boolean"))
    pts, complete = ended.select("var", "site"), ended.where("not complete").isEmpty()
    if large.isEmpty():
        return pts, complete
    rest = cut(parted.join(large, "part", "left_semi"))
    of = lambda kind, a, b, c: rest.where(F.col("kind") == kind).select(F.col("a").alias(a), F.col("c").alias(c), F.col("b").alias(b))
    more, settled = _solve(of(ALLOC, "var", "site", "none"), of(COPY, "src", "dst", "none"), of(STORE, "base", "src", "field"), of(LOAD, "base", "dst", "field"), rounds)
    return pts.unionByName(more), complete and settled


def _parted(facts: DataFrame) -> DataFrame:
    """``facts`` with ``part``, equal for those that share a variable or an object over any number of steps.

    Variables and objects are known by hashes; where two agree, parts are larger than they need be.
    """
    site = lambda c: F.xxhash64(F.lit("site"), c)
    var = lambda c: F.when(F.col(c) == UNKNOWN, site(F.col(c))).otherwise(F.xxhash64(F.lit("var"), F.col(c)))
    other = F.when(F.col("kind") == ALLOC, site(F.col("b"))).otherwise(var("b"))
    # A name that goes on from an object's with a dot is or may be that of a cell.
    dotted = facts.select(F.explode(F.array(F.struct(F.col("a").alias("name"), var("a").alias("src")), F.struct(F.col("b").alias("name"), other.alias("src")))).alias("x")).select("x.*").where("name like '%.%'")
    steps = F.split("name", r"\.")
    begins = dotted.distinct().select("src", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "."))).alias("site"))
    cells = begins.join(facts.where(F.col("kind") == ALLOC).select(F.col("b").alias("site")).distinct(), "site").select("src", site(F.col("site")).alias("dst"))
    of = fixpoint.parts(facts.select(var("a").alias("src"), other.alias("dst")).union(cut(cells)))
    return facts.withColumn("node", var("a")).join(of, "node", "left").withColumn("part", F.coalesce("part", "node")).drop("node")


def _ended(batches: Iterator[pa.RecordBatch], rounds: int) -> Iterator[pa.RecordBatch]:
    """What the variables of parts hold, from their facts, sorted by part."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "a", "b", "c")), strict=True))
    out: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_()))], ["var", "site", "complete"])

    for _, part in groupby(rows, lambda row: row[0]):
        sites, pts, complete = _closed([row[1:] for row in part], rounds)
        for var, held in pts.items():
            for site in _bits(held):
                out.append((var, sites[site], complete))
                if len(out) == 10_000:
                    yield made()
                    out = []
    if out:
        yield made()


def _bits(held: int) -> Iterator[int]:
    while held:
        low = held & -held
        yield low.bit_length() - 1
        held ^= low


def _closed(facts: list[tuple], rounds: int) -> tuple[list[str], dict[str, int], bool]:
    """The objects, which of them (as bits) each variable holds, and whether it is all; the rounds are those of ``_solve``."""
    number: dict[str, int] = {}
    pts, known, uses = defaultdict(int), defaultdict(set), defaultdict(set)
    for kind, a, b, c in facts:
        if kind == ALLOC:
            pts[a] |= 1 << number.setdefault(b, len(number))
        elif kind == COPY:
            known[a].add(b)
        else:
            uses[a].add((c, b, kind == STORE))
    sites, new = list(number), dict(pts)
    for _ in range(rounds):
        new.pop(None, None)  # no variable
        more, grown = set(), defaultdict(int)
        for var, held in new.items():
            for field, other, into in uses.get(var, ()):
                for site in map(sites.__getitem__, _bits(held)):
                    cell = None if site is None or field is None else f"{site}.{field}"
                    more.add((other, cell) if into else (cell, other))
                    if site == UNKNOWN and not into:
                        more.add((UNKNOWN, other))
            for dst in known.get(var, ()):
                grown[dst] |= held
        more = [(src, dst) for src, dst in more if src is not None and dst not in known.get(src, ())]
        for src, dst in more:
            grown[dst] |= pts.get(src, 0) | (1 << number[UNKNOWN] if src == UNKNOWN else 0)
            known[src].add(dst)
        new = {var: own for var, held in grown.items() if (own := held & ~pts.get(var, 0))}
        if not new:
            return sites, pts, True
        for var, held in new.items():
            pts[var] |= held
    return sites, pts, False


def _solve(allocs: DataFrame, copies: DataFrame, stores: DataFrame, loads: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """As ``solve``, by rounds that join all facts."""
    uses = cut(stores.select("base", "field", F.col("src").alias("other"), F.lit(True).alias("into")).union(loads.select("base", "field", "dst", F.lit(False))).distinct())
    named = copies.select("src", "dst").distinct()
    known = cut(named)
    pts = cut(allocs.select("var", "site").distinct())
    new = pts
    for n in range(rounds):
        # Copies that the objects added last make, in and out of their cells.
        met = new.join(uses, new.var == uses.base).select(cell(F.col("site"), F.col("field")).alias("cell"), "other", "into", "site")
        made = met.select(F.when(F.col("into"), F.col("other")).otherwise(F.col("cell")).alias("src"), F.when(F.col("into"), F.col("cell")).otherwise(F.col("other")).alias("dst"))
        unknown = met.where((F.col("site") == UNKNOWN) & ~F.col("into")).select(F.lit(UNKNOWN).alias("src"), F.col("other").alias("dst"))
        more = cut(made.union(unknown).distinct().join(known, ["src", "dst"], "left_anti"))
        # Objects along known copies, and all objects of their source along new ones.
        along = new.join(known, new.var == known.src).select(F.col("dst").alias("var"), "site")
        everything = pts.join(more, pts.var == more.src).select(F.col("dst").alias("var"), "site")
        source = more.where(F.col("src") == UNKNOWN).select(F.col("dst").alias("var"), F.lit(UNKNOWN).alias("site"))
        new = cut(along.union(everything).union(source).distinct().join(pts, ["var", "site"], "left_anti"))
        if new.isEmpty():
            return pts, True
        pts, known = pts.unionByName(new), known.unionByName(more)
        if n % FEW == FEW - 1:  # what all rounds found is read as few tables
            pts, known = cut(pts), cut(known)
    return pts, False


def types_of(pts: DataFrame, sites: DataFrame) -> DataFrame:
    """(var, type, exact): the types of the objects that each variable can hold, and whether it is one type and nothing unknown.

    ``sites`` has site and type. Variables that may hold unknown objects have no row.
    """
    open_ = pts.where(F.col("site") == UNKNOWN).select("var").distinct()
    each = pts.join(sites, "site").select("var", "type").distinct().join(open_, "var", "left_anti")
    n = each.groupBy("var").agg((F.count(F.lit(1)) == 1).alias("exact"))
    return each.join(n, "var")


def aliases(pts: DataFrame, asked: DataFrame) -> DataFrame:
    """(a, b) of ``asked`` that can hold one and the same object."""
    left, right = (pts.select(F.col("var").alias(c), "site") for c in ("a", "b"))
    return asked.join(left, "a").join(right, ["b", "site"], "left_semi").select("a", "b").distinct()
