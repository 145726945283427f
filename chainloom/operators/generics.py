"""Generic types: signatures read from class files, and type arguments carried up the hierarchy.

A type is its signature's text, in which the variables of the class that it stands in are
``{0}``, ``{1}`` and so on by their place; a wildcard is its upper bound, and a variable of a
method or an outer class, like what has no bound, is ``Ljava/lang/Object;``. With that, what a
supertype's arguments are for given arguments of a class is a plain replacement, which Spark does in
columns: ``ascend`` goes up from given types, and ``element_types`` reads off what containers
hold at any place of a field's type. A raw type's arguments are the erased bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources.classfile import ClassFile, _table

OBJECT = "Ljava/lang/Object;"
#: Longer types, which only come from variables that occur several times, are given up as ``OBJECT``.
MOST = 4096
EDGES = "child string, bounds array<string>, parent string, args array<string>"
FIELDS = "owner string, field string, descriptor string, type string"

# How the platform's containers pass on their arguments.
_CONTAINERS = {
    "java/util/Collection": ("java/lang/Iterable", 1),
    "java/util/List": ("java/util/Collection", 1),
    "java/util/Set": ("java/util/Collection", 1),
    "java/util/SortedSet": ("java/util/Set", 1),
    "java/util/NavigableSet": ("java/util/SortedSet", 1),
    "java/util/Queue": ("java/util/Collection", 1),
    "java/util/Deque": ("java/util/Queue", 1),
    "java/util/AbstractCollection": ("java/util/Collection", 1),
    "java/util/AbstractList": ("java/util/List", 1),
    "java/util/AbstractSet": ("java/util/Set", 1),
    "java/util/ArrayList": ("java/util/List", 1),
    "java/util/LinkedList": ("java/util/List", 1),
    "java/util/Vector": ("java/util/List", 1),
    "java/util/HashSet": ("java/util/Set", 1),
    "java/util/LinkedHashSet": ("java/util/HashSet", 1),
    "java/util/TreeSet": ("java/util/NavigableSet", 1),
    "java/util/PriorityQueue": ("java/util/Queue", 1),
    "java/util/ArrayDeque": ("java/util/Deque", 1),
    "java/util/SortedMap": ("java/util/Map", 2),
    "java/util/AbstractMap": ("java/util/Map", 2),
    "java/util/HashMap": ("java/util/Map", 2),
    "java/util/LinkedHashMap": ("java/util/HashMap", 2),
    "java/util/TreeMap": ("java/util/SortedMap", 2),
    "java/util/Hashtable": ("java/util/Map", 2),
    "java/util/concurrent/ConcurrentMap": ("java/util/Map", 2),
    "java/util/concurrent/ConcurrentHashMap": ("java/util/concurrent/ConcurrentMap", 2),
}
_ROLES = {"java/lang/Iterable": ("element",), "java/util/Map": ("key", "value"), "java/util/Map$Entry": ("key", "value"), "java/util/Iterator": ("element",), "java/util/Optional": ("element",), "java/lang/ref/Reference": ("element",)}


class SignatureError(ValueError):
    pass


class _Reader:
    """Reads one signature; ``variables`` has the places of the class's own variables."""

    def __init__(self, text: str, variables: dict[str, int] | None = None):
        self.text, self.at, self.variables = text, 0, dict(variables or {})

    def peek(self) -> str:
        if self.at >= len(self.text):
            raise SignatureError(self.text)
        return self.text[self.at]

    def until(self, stops: str) -> str:
        start = self.at
        while self.peek() not in stops:
            self.at += 1
        return self.text[start : self.at]

    def parameters(self) -> list[str]:
        """Erased first bounds of the variables that are declared here, if any are."""
        if self.peek() != "<":
            return []
        start, names, bounds = self.at, [], []
        # Bounds may name variables that follow, so that names are read first.
        for _ in range(2):
            self.at = start + 1
            bounds = []
            while self.peek() != ">":
                name, first = self.until(":"), None
                while self.peek() == ":":
                    self.at += 1
                    if self.peek() == ":":
                        continue
                    bound = self.type()
                    first = first or bound
                names.append(name)
                bounds.append(first or OBJECT)
            self.variables |= {n: i for i, n in enumerate(names[: len(bounds)])}
        self.at += 1
        # A bound that is a variable is that one's bound.
        for _ in bounds:
            bounds = [bounds[int(b[1:-1])] if b.startswith("{") else b for b in bounds]
        return [OBJECT if b.startswith("{") else erased(b) for b in bounds]

    def type(self) -> str:
        ch = self.peek()
        self.at += 1
        if ch in "BCDFIJSZV":
            return ch
        if ch == "[":
            return "[" + self.type()
        if ch == "T":
            name = self.until(";")
            self.at += 1
            return f"{{{self.variables[name]}}}" if name in self.variables else OBJECT
        if ch != "L":
            raise SignatureError(self.text)
        name, args = self.until("<.;"), []
        while True:
            ch = self.peek()
            self.at += 1
            if ch == ";":
                return f"L{name}<{''.join(args)}>;" if args else f"L{name};"
            if ch == ".":
                name, args = f"{name}${self.until('<.;')}", []
            else:
                while self.peek() != ">":
                    args.append(self.argument())
                self.at += 1

    def argument(self) -> str:
        ch = self.peek()
        if ch not in "*+-":
            return self.type()
        self.at += 1
        bound = self.type() if ch != "*" else OBJECT
        return bound if ch == "+" else OBJECT


def erased(text: str) -> str:
    head = text.partition("<")[0]
    return head if head == text else head + ";"


def parts(text: str) -> tuple[str, list[str]]:
    """A type's class name, or its descriptor where it is an array, a variable or primitive, and its arguments."""
    if not text.startswith("L"):
        return text, []
    name, _, rest = text[1:-1].partition("<")
    r, out = _Reader(rest[:-1] + ";") if rest else None, []
    while r is not None and r.at < len(rest) - 1:
        if r.peek() == "{":
            out.append(r.until("}") + "}")
            r.at += 1
            continue
        start, depth = r.at, 0
        while True:  # up to this argument's end, past the arguments within
            ch = r.peek()
            r.at += 1
            depth += (ch == "<") - (ch == ">")
            if ch == ";" and depth == 0 or ch in "BCDFIJSZ" and set(r.text[start : r.at - 1]) <= {"["} or ch == "}" and r.text[start : r.at].lstrip("[").startswith("{"):
                break
        out.append(r.text[start : r.at])
    return name, out


def _edges(c: ClassFile) -> Iterator[tuple]:
    plain = [p for p in (c.parent, *c.interfaces) if p]
    try:
        r = _Reader(c.signature or "")
        bounds = r.parameters() if c.signature else []
        read = [parts(r.type()) for _ in plain] if c.signature else [(p, []) for p in plain]
        if r.at != len(r.text) or [name for name, _ in read] != plain:
            raise SignatureError(c.signature)
    except SignatureError:  # what no compiler writes counts as not being there
        bounds, read = [], [(p, []) for p in plain]
    for name, args in read:
        yield c.name, bounds, name, args


def edges(files: DataFrame) -> DataFrame:
    """(child, bounds, parent, args) of class files (content): erased bounds of the class's variables and what each supertype gets of them."""
    return _table(files, EDGES, _edges)


def fields(files: DataFrame) -> DataFrame:
    """(owner, field, descriptor, type): the field's generic type, its descriptor where it has none."""

    def rows(c: ClassFile) -> Iterator[tuple]:
        try:
            r = _Reader(c.signature or "L;")
            r.parameters()
            variables = r.variables
        except SignatureError:
            variables = {}
        for name, descriptor, _ in c.fields:
            try:
                kind = _Reader(c.field_signatures.get(name, descriptor), variables).type()
            except SignatureError:
                kind = descriptor
            yield c.name, name, descriptor, kind

    return _table(files, FIELDS, rows)


def platform_edges(spark: SparkSession) -> DataFrame:
    """Edges of the platform's containers, whose class files needn't be there."""
    rows = [(child, [OBJECT] * n, parent, [f"{{{i}}}" for i in range(n)]) for child, (parent, n) in _CONTAINERS.items()]
    return spark.createDataFrame(rows, EDGES)


def substituted(text: Column, args: Column) -> Column:
    """``text`` with its variables replaced by ``args``, which have none themselves."""
    put = F.aggregate(F.sequence(F.lit(1), F.size(args)), text, lambda t, i: F.replace(t, F.concat(F.lit("{"), (i - 1).cast("string"), F.lit("}")), F.element_at(args, i)))
    done = F.when(F.size(args) == 0, text).otherwise(put)
    return F.when(F.length(done) > MOST, OBJECT).otherwise(F.regexp_replace(done, r"\{[0-9]+\}", OBJECT))


def ascend(types: DataFrame, hierarchy: DataFrame, rounds: int = 64) -> tuple[DataFrame, bool]:
    """(name, args, at, at_args): each of ``types`` (name, args) with every supertype and its arguments, itself included, and
    whether the rounds sufficed. Only distinct types go up; a number of arguments that isn't the class's
    makes the type raw. Null names are left out.
    """
    declared = hierarchy.select(F.col("child").alias("at"), "bounds").distinct()
    # Arguments are of their class's number from here on.
    fit = lambda args: F.when(F.col("bounds").isNull() | (F.size(args) == F.size("bounds")), F.col(args)).otherwise(F.col("bounds"))
    up = hierarchy.where("child <> parent").select("child", "parent", "args").join(declared.withColumnRenamed("at", "parent"), "parent", "left")
    up = cut(up.select(F.col("child").alias("at"), "parent", fit("args").alias("to")).distinct())
    start = types.where("name is not null").select("name", "args").distinct().withColumn("at", F.col("name")).join(declared, "at", "left").withColumn("own", fit("args"))
    frontier = cut(start.select("name", "args", "at", F.col("own").alias("at_args")).distinct())
    found = [frontier]
    for _ in range(rounds):
        new = frontier.join(up, "at").select("name", "args", F.col("parent").alias("at"), F.transform("to", lambda t: substituted(t, F.col("at_args"))).alias("at_args"))
        frontier = cut(new.distinct())
        if frontier.isEmpty():
            break
        found.append(frontier)
    else:
        return _all(found), False
    return _all(found), True


def _all(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def split(types: DataFrame) -> DataFrame:
    """``types`` (type) with name and args."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            read = [parts(t) for t in b["type"]]
            yield pd.DataFrame({"type": b["type"], "name": [n for n, _ in read], "args": [a for _, a in read]})

    return types.select("type").where("type is not null").distinct().mapInPandas(run, "type string, name string, args array<string>")


def element_types(declared: DataFrame, hierarchy: DataFrame, levels: int = 4) -> tuple[DataFrame, bool]:
    """(owner, field, path, type) of what containers hold in the fields of ``declared`` (owner, field, type), and whether it is all.

    ``path`` says where: element, key or value, and component of an array, with a slash for
    each further level; containers nested deeper than ``levels`` make the flag false.
    """
    now, found, whole = cut(declared.select("owner", "field", F.lit("").alias("path"), substituted(F.col("type"), F.array().cast("array<string>")).alias("type"))), [], True
    roles = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*(F.lit(r) for r in x)) for pair in _ROLES.items() for x in pair))
    for level in range(levels + 1):
        known = cut(split(now))
        up, ended = ascend(known, hierarchy)
        whole = whole and ended
        named = up.withColumn("roles", F.try_element_at(roles, F.col("at"))).where("roles is not null and size(roles) = size(at_args)")
        held = named.select("name", "args", F.posexplode("roles").alias("i", "role"), "at_args").select("name", "args", "role", F.expr("at_args[i]").alias("held"))
        inner = known.join(held, ["name", "args"]).select("type", "role", "held").unionByName(known.where("name like '[%'").select("type", F.lit("component").alias("role"), F.substring("type", 2, MOST).alias("held"))).distinct()
        now = cut(now.join(inner, "type").select("owner", "field", F.concat_ws("/", F.when(F.col("path") != "", F.col("path")), "role").alias("path"), F.col("held").alias("type")).distinct())
        if now.isEmpty():
            break
        if level == levels:
            whole = False
            break
        found.append(now)
    return (_all(found) if found else now.limit(0)), whole
