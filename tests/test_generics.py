"""Generic signatures of compiled classes, and arguments carried up the hierarchy."""

import pytest
from test_dynamic import compiled

from chainloom.operators import generics
from chainloom.sources import classfile

SOURCE = """package app;
import java.util.*;
public class Kept<E, N extends Number> {
  static class Box<T extends Comparable<T>> implements Iterable<T> { public Iterator<T> iterator() { return null; } }
  static class Rows<K extends Comparable<K>> extends ArrayList<Map<K, ? extends Number>> { }
  static class Names extends TreeMap<String, List<Names>> { }
  class Inner<X> extends ArrayList<E> { }
  List<String> texts; Box<Integer> box; Box raw; Rows<String> rows; Names names; List<?>[] array; List<? super Integer> lower;
  N number; List<N> numbers; Map<int[], E[]> map; int plain; String text; Kept<String, Long>.Inner<Byte> inner;
}
"""
S, O, N = "Ljava/lang/String;", "Ljava/lang/Object;", "Ljava/lang/Number;"


def test_types_are_read_and_split():
    r = generics._Reader("<A:Ljava/lang/Object;B::Ljava/util/List<TA;>;C:TB;>Lx/Y<TC;[TA;*+TB;-[ILo/T<TA;>.In<[[J>;>;")
    assert r.parameters() == [O, "Ljava/util/List;", "Ljava/util/List;"] and r.variables == {"A": 0, "B": 1, "C": 2}
    kind = r.type()
    assert kind == f"Lx/Y<{{2}}[{{0}}{O}{{1}}{O}Lo/T$In<[[J>;>;" and r.at == len(r.text)
    assert generics.parts(kind) == ("x/Y", ["{2}", "[{0}", O, "{1}", O, "Lo/T$In<[[J>;"])
    assert generics.parts("[I") == ("[I", []) and generics.parts("La;") == ("a", []) and generics.parts("La<[I[[Lb<Lc;>;Ld;>;")[1] == ["[I", "[[Lb<Lc;>;", "Ld;"]
    for bad in ("L", "Lx<", "<A", "Q;", "T", "Lx<Ly;", ""):
        with pytest.raises(generics.SignatureError):
            generics._Reader(bad).type()


def test_fields_of_compiled_classes(spark, tmp_path):
    files = compiled(tmp_path, Kept=SOURCE)
    assert classfile.parse(files["Kept"]).signature.startswith("<E:Ljava/lang/Object;N:Ljava/lang/Number;>")
    assert classfile.parse(files["Kept$Box"]).methods[1].signature == "()Ljava/util/Iterator<TT;>;"
    table = spark.createDataFrame([(bytearray(b),) for b in files.values()], "content binary")
    own = generics.edges(table)
    edges = {(r.child.rpartition("/")[2], r.parent): (r.bounds, r.args) for r in own.collect()}
    assert edges["Kept$Box", "java/lang/Iterable"] == (["Ljava/lang/Comparable;"], ["{0}"]) and edges["Kept", "java/lang/Object"] == ([O, N], [])
    assert edges["Kept$Rows", "java/util/ArrayList"][1] == [f"Ljava/util/Map<{{0}}{N}>;"] and edges["Kept$Inner", "java/util/ArrayList"] == ([O], [O])
    declared = generics.fields(table).where("owner = 'app/Kept'")
    kinds = {r.field: r.type for r in declared.collect()}
    assert kinds["numbers"] == "Ljava/util/List<{1}>;" and kinds["map"] == "Ljava/util/Map<[I[{0}>;" and kinds["plain"] == "I" and kinds["inner"] == "Lapp/Kept$Inner<Ljava/lang/Byte;>;"
    found, whole = generics.element_types(declared, own.unionByName(generics.platform_edges(spark)))
    got = {(r.field, r.path): r.type for r in found.collect()}
    assert got["texts", "element"] == S and got["box", "element"] == "Ljava/lang/Integer;" and got["raw", "element"] == "Ljava/lang/Comparable;"
    assert got["rows", "element/key"] == S and got["rows", "element/value"] == N and got["array", "component/element"] == O and got["lower", "element"] == O
    assert got["names", "key"] == S and got["names", "value/element"] == "Lapp/Kept$Names;" and got["numbers", "element"] == O
    assert got["map", "key/component"] == "I" and got["map", "value"] == f"[{O}" and not {f for f, _ in got} & {"plain", "text", "number"}
    assert not whole  # names hold names, which hold names
    found, whole = generics.element_types(declared.where("field <> 'names'"), own.unionByName(generics.platform_edges(spark)))
    assert whole and found.count() == len([k for k in got if k[0] != "names"])


def test_growth_cycles_and_nothing(spark):
    grow = [(f"g{i}", [O], f"g{i + 1}", ["Lp<{0}{0}>;"]) for i in range(14)] + [("loop", [O], "pool", ["{0}"]), ("pool", [O], "loop", ["{0}"]), ("self", [], "self", [])]
    hierarchy = spark.createDataFrame(grow, generics.EDGES)
    types = lambda *names: spark.createDataFrame([(n, ["La;"]) for n in names], "name string, args array<string>")
    found, ended = generics.ascend(types("g0", None, "self", "none"), hierarchy)
    got = {(r.name, r.at): r.at_args for r in found.collect()}
    assert ended and got["g0", "g2"] == ["Lp<Lp<La;La;>;Lp<La;La;>;>;"] and all(len(a) <= generics.MOST for args in got.values() for a in args)
    assert got["self", "self"] == [] and got["none", "none"] == ["La;"] and len(got) == 17
    found, ended = generics.ascend(types("loop"), hierarchy, rounds=3)
    assert not ended and {r.at for r in found.collect()} == {"loop", "pool"}
    found, ended = generics.ascend(types("g0").limit(0), hierarchy.limit(0))
    assert ended and found.count() == 0
