"""Dynamic calls of compiled classes: bootstrap methods, lambdas and what they capture."""

import glob
import os
import shutil
import subprocess
import zipfile

import pyspark
import pytest
from pyspark.sql import functions as F

from chainloom.operators import dynamic
from chainloom.sources import classfile


def compiled(folder, release="11", **sources):
    """Class files of Java sources."""
    javac = shutil.which("javac")
    if not javac:
        pytest.skip("no compiler")
    paths = []
    for name, text in sources.items():
        path = folder / "src" / f"{name}.java"
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
        paths.append(str(path))
    subprocess.run([javac, "--release", release, "-d", str(folder / "out"), *paths], check=True, capture_output=True, timeout=120)
    return {os.path.basename(p)[:-6]: open(p, "rb").read() for p in glob.glob(f"{folder}/out/**/*.class", recursive=True)}


LAMBDAS = """package app;
import java.util.function.*;
import java.io.Serializable;
class Lambdas {
  interface Two { String apply(long n, String s); }
  int field; Lambdas(int n) { field = n; }
  String own(String s) { return s + field; }
  static void sink(String s) { }
  Runnable capture(long n, String s) { return () -> sink(s + n); }
  Function<String, String> bound() { return this::own; }
  BiFunction<Lambdas, String, String> unbound() { return Lambdas::own; }
  IntFunction<Lambdas> made() { return Lambdas::new; }
  Two two(double d, Object o) { return (n, s) -> s + n + d + o; }
  Two mine(String t) { return (n, s) -> s + t + field; }
  Runnable marked(String s) { return (Runnable & Serializable) () -> sink(s); }
}
"""


def test_lambdas_of_compiled_classes(spark, tmp_path):
    files = compiled(tmp_path, Lambdas=LAMBDAS)
    table = spark.createDataFrame([(bytearray(b),) for b in files.values()] + [(bytearray(b"\xca\xfe"),)], "content binary")
    sites = dynamic.lambda_status(classfile.call_sites(table)).where("host not like '%#$deserializeLambda$(%'")
    status = {(r.host.split("#")[1].split("(")[0], r.factory_name): r.status for r in sites.collect()}
    assert {k for (k, f), s in status.items() if s == "RESOLVED"} == {"capture", "bound", "unbound", "made", "two", "mine", "marked"}
    assert all(s == "NOT_LAMBDA_METAFACTORY" for (_, f), s in status.items() if f == "makeConcatWithConstants")
    marked = sites.where("host like '%#marked(%' and status = 'RESOLVED'").first()
    assert marked.factory_name == "altMetafactory" and marked.flags & 1 and marked.interface == "java/lang/Runnable"
    got = {}
    for r in dynamic.lambda_slots(sites).collect():
        got.setdefault(r.host.split("#")[1].split("(")[0], []).append((r.part, r.ordinal, r.slot))
    assert {k: sorted(v) for k, v in got.items()} == {
        "capture": [("capture", 0, 0), ("capture", 1, 1)],
        "bound": [("argument", 0, 1), ("capture", 0, 0)],
        "unbound": [("argument", 0, 0), ("argument", 1, 1)],
        "made": [("argument", 0, 1)],
        "two": [("argument", 0, 3), ("argument", 1, 5), ("capture", 0, 0), ("capture", 1, 2)],
        "mine": [("argument", 0, 2), ("argument", 1, 4), ("capture", 0, 0), ("capture", 1, 1)],
        "marked": [("capture", 0, 0)],
    }
    parsed = classfile.parse(files["Lambdas"])
    assert all(x.bootstrap >= 0 for m in parsed.methods for x in m.instructions if x.kind == "INVOKEDYNAMIC") and len(parsed.bootstraps) >= 7


def test_dynamic_calls_of_public_archives(spark):
    jar = next(p for p in glob.glob(f"{os.path.dirname(pyspark.__file__)}/jars/spark-network-common*.jar"))
    with zipfile.ZipFile(jar) as z:
        files = [(bytearray(z.read(n)),) for n in z.namelist() if n.endswith(".class")]
    sites = dynamic.lambda_status(classfile.call_sites(spark.createDataFrame(files, "content binary"))).cache()
    assert sites.count() > 20 and sites.where("status = 'RESOLVED'").count() > 10
    assert sites.where("status <> 'RESOLVED' and factory_owner = 'java/lang/invoke/LambdaMetafactory'").count() == 0
    slots = dynamic.lambda_slots(sites)
    n = sites.where("status = 'RESOLVED'").select(F.sum(F.size(F.regexp_extract_all(F.concat(F.regexp_extract("descriptor", r"^\((.*)\)", 1), F.regexp_extract("sam_descriptor", r"^\((.*)\)", 1)), F.lit(r"\[*(?:[BCDFIJSZ]|L[^;]+;)"), F.lit(0))))).first()[0]
    assert slots.count() == n  # each capture and argument has its place


def test_extras_of_alternate_factories():
    three = ["type:()V", "handle:6:A#f()V", "type:()V"]
    assert classfile._extras(three) == (None, [], [], True)
    assert classfile._extras([*three, "int:1"]) == (1, [], [], True)
    assert classfile._extras([*three, "int:7", "int:1", "class:M", "int:2", "type:()V", "type:(I)V"]) == (7, ["M"], ["()V", "(I)V"], True)
    for more in (["string:x"], ["int:2"], ["int:2", "int:2", "class:M"], ["int:2", "int:1", "type:()V"], ["int:1", "int:1"], ["int:4", "int:-1"]):
        assert not classfile._extras([*three, *more])[3], more


PROGRAM = """package app;
import com.sun.net.httpserver.*;
import java.util.*;
import java.util.function.*;
class Exec { static void start(Object o) { } }
class Captured implements HttpHandler { public void handle(HttpExchange x) { long n = 1; Runnable r = () -> Exec.start(x == null ? n : x); r.run(); } }
class Passed implements HttpHandler { public void handle(HttpExchange x) { Consumer<Object> c = o -> Exec.start(o); new Passer().pass(c, x); } }
class Passer { Consumer<Object> kept; void pass(Consumer<Object> c, Object o) { kept = c; later(o); } void later(Object o) { kept.accept(o); } }
class Returned implements HttpHandler { public void handle(HttpExchange x) { Function<Object, Object> same = o -> o; Exec.start(same.apply(x)); } }
class Dropped implements HttpHandler { public void handle(HttpExchange x) { Consumer<Object> c = o -> { }; c.accept(x); Consumer<Object> d = o -> Exec.start(o); d.accept("constant"); } }
class Narrow implements HttpHandler { public void handle(HttpExchange x) { Base b = new Safe(); b.take(x); } }
class Wide implements HttpHandler { Base b; public void handle(HttpExchange x) { b.take(x); } }
class Stored implements HttpHandler { public void handle(HttpExchange x) { List<Base> l = new ArrayList<>(); l.add(new Unsafe()); Base[] a = { l.get(0) }; a[0].take(x); } }
class Apart implements HttpHandler { public void handle(HttpExchange x) { Holder h = new Holder(), g = new Holder(); h.b = new Safe(); g.b = new Unsafe(); h.b.take(x); } }
class Holder { Base b; }
class Twice implements HttpHandler { public void handle(HttpExchange x) { Same.id(x); Exec.start(Same.id("constant")); } }
class Once implements HttpHandler { public void handle(HttpExchange x) { Exec.start(Same.id(x)); } }
class Same { static Object id(Object o) { return o; } }
class Built implements HttpHandler { public void handle(HttpExchange x) { StringBuilder b = new StringBuilder(); b.append((Object) x); Exec.start(b.toString()); } }
class Plain implements HttpHandler { public void handle(HttpExchange x) { StringBuilder b = new StringBuilder(); b.append("a"); new StringBuilder().append((Object) x); Exec.start(b.toString()); } }
class Base { void take(Object o) { } }
class Safe extends Base { void take(Object o) { } }
class Unsafe extends Base { void take(Object o) { Exec.start(o); } }
"""
RULES = """- {id: exec, kind: sink, category: command, severity: HIGH, match: {owner: app/Exec, name: start}, tainted: [{arg: 0}]}
- {id: append, kind: model, match: {owner: java/lang/StringBuilder, name: append}, actions: {arg0: [this, return], this: [return]}}
- {id: text, kind: model, match: {owner: java/lang/StringBuilder, name: toString}, actions: {this: [return]}}"""


def test_scan_follows_lambdas_and_narrows_receivers(spark, tmp_path):
    pytest.importorskip("yaml")
    from chainloom.plans import scan

    files = compiled(tmp_path, Program=PROGRAM)
    at = tmp_path / "in"
    at.mkdir()
    for name, data in files.items():
        (at / f"{name}.class").write_bytes(data)
    done = scan.scan(spark, str(at), RULES)
    paths = {r.entry.split("#")[0].split("/")[1]: r.path for r in done.findings.collect()}
    # Twice and Plain mix calls of one method: a value comes back only to the call that it went into.
    assert set(paths) == {"Captured", "Passed", "Returned", "Wide", "Stored", "Once", "Built"}, (paths, done.reasons)
    assert "lambda$handle$0" in paths["Captured"] and "Passer#later" in paths["Passed"]
    assert done.outcome == "COMPLETE"
