"""Operators on small hand-made inputs with known answers."""

import glob
import io
import json
import os
import random
import zipfile

import pyspark
import pytest
from pyspark.sql import functions as F

from chainloom.operators import calibrate, callgraph, cfg, chains, compose, fixpoint, hierarchy, report, rules
from chainloom.sources import archive, catalogue, classfile
from chainloom.streaming import samples


def rows(df):
    return sorted(tuple(r) for r in df.collect())


DIAMOND = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 2)]


def test_least_depth_on_a_diamond_with_a_cycle(spark):
    edges, seed = spark.createDataFrame(DIAMOND, "src long, dst long"), spark.createDataFrame([(1,)], "node long")
    seen, complete = fixpoint.least_depth(seed, edges, 10)
    assert rows(seen) == [(1, 0), (2, 1), (3, 1), (4, 2)] and complete
    seen, complete = fixpoint.least_depth(seed, edges, 1)
    assert rows(seen) == [(1, 0), (2, 1), (3, 1)] and not complete
    assert fixpoint.least_depth(seed.limit(0), edges, 3)[0].count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    got = dict(rows(fixpoint.components(spark.createDataFrame(edges, "src long, dst long"))))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200, 202: 200}


def test_k_paths_are_simple_and_ordered(spark):
    edges = spark.createDataFrame([(str(a), str(b)) for a, b in DIAMOND], "src string, dst string")
    got = fixpoint.k_paths(spark.createDataFrame([("1",)], "node string"), edges, 5, 2)
    assert rows(got.where("node = '4'").select("rank", "path")) == [(1, "1>2>4"), (2, "1>3>4")]
    assert rows(got.where("node = '2'").select("rank", "path")) == [(1, "1>2"), (2, "1>3>4>2")]


LADDER = [("R", None, "i"), ("A", "R", "c"), ("B", "A", "c"), ("C", "B", "c"), ("D", "I", "c"), ("I", "R", "i"), ("E", "D", "c")]


def test_hierarchy_on_an_override_ladder(spark):
    types = spark.createDataFrame(LADDER, "name string, super string, kind string")
    pairs = hierarchy.type_closure(types)
    assert rows(pairs.where("ancestor = 'A'")) == [("A", "B", 1), ("A", "C", 2)]
    concrete = types.where("kind = 'c'")
    assert dict((a, x) for a, _, x in rows(hierarchy.implementers(pairs, concrete, 3)))["I"] == "D,E"
    assert dict((a, x) for a, _, x in rows(hierarchy.implementers(pairs, concrete, 1)))["I"] is None
    declared = spark.createDataFrame([("A", "m"), ("R", "m"), ("R", "n"), ("C", "m")], "owner string, method string")
    got = {(o, n): (d, k) for o, n, d, k in rows(hierarchy.resolve_method(types, pairs, declared))}
    assert got[("C", "m")] == ("C", 0) and got[("B", "m")] == ("A", 1) and got[("B", "n")] == ("R", 2) and got[("E", "m")] == ("R", 3)
    capped = hierarchy.capped(pairs, 2).where("ancestor = 'R'").collect()
    assert len(capped) == 2 and not any(r.complete for r in capped)


def test_dispatch_falls_back_and_caps(spark):
    types = spark.createDataFrame(LADDER, "name string, super string, kind string")
    plan = callgraph.dispatch_plan(spark.createDataFrame([("I",), ("A",), ("X",)], "receiver string"), hierarchy.type_closure(types), types.where("kind = 'c'"), 2)
    assert rows(plan) == [("A", "A", "capped"), ("I", "D", "dispatch"), ("I", "E", "dispatch"), ("X", "X", "fallback")]


@pytest.mark.parametrize(("access", "package", "want"), [(1, False, True), (2, True, False), (9, True, False), (17, True, False), (4, False, True), (0, True, True), (0, False, False), (-1, False, True), (None, False, True)])
def test_overridable(spark, access, package, want):
    assert spark.createDataFrame([(access, package)], "a int, p boolean").select(hierarchy.overridable(F.col("a"), F.col("p"))).first()[0] is want


def test_dominators_match_removal(spark):
    r = random.Random(1)
    edges = [(f"m{k}", a, b) for k in range(12) for a, b in {(r.randint(0, 9), r.randint(0, 9)) for _ in range(16)}]
    got = set(rows(cfg.dominators(spark.createDataFrame(edges, "method string, src int, dst int"))))
    for m in {e[0] for e in edges}:
        own = [(a, b) for x, a, b in edges if x == m]

        def reach(without):
            seen, todo = set(), [0] if without != 0 else []
            while todo:
                n = todo.pop()
                if n not in seen and n != without:
                    seen.add(n)
                    todo += [b for a, b in own if a == n]
            return seen

        live = reach(None)
        assert {(n, d) for x, n, d in got if x == m} == {(n, d) for n in live for d in live if n == d or n not in reach(d)}
    big = spark.createDataFrame([("m", i, i + 1) for i in range(20)], "method string, src int, dst int")
    assert len(rows(cfg.immediate_dominators(big))) == big.select("dst").distinct().count()


def test_safe_configuration_order(spark):
    calls = [("a", 3, "safe"), ("a", 7, "use"), ("b", 7, "safe"), ("b", 3, "use"), ("c", 1, "use"), ("d", 1, "safe")]
    got = rules.safe_before_use(spark.createDataFrame(calls, "host string, pos int, what string"), F.col("what") == "safe", F.col("what") == "use")
    assert {r.host: r.suppressed for r in got.collect()} == {"a": True, "b": False, "c": False}


def test_rule_matching_and_ties(spark):
    given = [(None, "exact", "a"), ("ab", "exact", "ab"), ("xab", "regex", "ab"), ("ab", "regex", "a|ab"), ("a" * 20000, "regex", "a+")]
    got = [r[0] for r in spark.createDataFrame([(i, *x) for i, x in enumerate(given)], "i int, v string, m string, p string").orderBy("i").select(rules.matches(F.col("v"), F.col("m"), F.col("p"))).collect()]
    assert got == [False, True, False, True, False]
    sites = spark.createDataFrame([("m1", "lib/ExecHelper", "run", "()V"), ("m2", "app/MyExec", "run", "()V"), ("m3", "lib/Exec", "run", None)], "method string, owner string, name string, descriptor string")
    rule = "rule_id int, owner_pat string, owner_mode string, name_pat string, name_mode string, role string, category string, severity string, descriptor string"
    catalogue = spark.createDataFrame([(1, "lib/Exec", "subtype", "run", "exact", "T", "c", "S", None), (2, "lib/Exec", "subtype", "r.*", "regex", "T", "c", "S", "()V"), (3, "lib/.*", "regex", "run", "exact", "T", "c", "S", "~.*V"), (4, "lib/Exec", "exact", "run", "exact", "T", "c", "S", None)], rule)
    pairs = spark.createDataFrame([("lib/Exec", "app/MyExec"), ("lib/Exec", "app/Other")], "ancestor string, descendant string")
    assert {(r.method, r.rule_id, r.score) for r in rules.scores(sites, catalogue, pairs).collect()} == {("m1", 3, 39), ("m2", 1, 72), ("m2", 2, 70), ("m3", 1, 132), ("m3", 4, 132)}
    scored = spark.createDataFrame([("m", 2, 10), ("m", 1, 10), ("m", 3, 5)], "method string, rule_id int, score int")
    assert [r.rule_id for r in rules.best_rule(scored).collect()] == [1]


def test_preferred_duplicate_and_identity(spark):
    cols = "chain_key string, rule_id int, category string, severity string, entry_class string, entry_method string, entry_kind string, sink_class string, sink_method string, sink_role string, sink_risk string, unresolved int, n_hops int"
    base = [1, "c", "HIGH", "E", "e", "readObject", "S", "s", "TERMINAL", "HIGH"]
    table = spark.createDataFrame([("long", *base, 0, 2), ("short", *base, 0, 1), ("open", *base, 1, 9), ("null", 1, None, *base[2:], 2, 1)], cols)
    hops = spark.createDataFrame([("long", 0, "a", "b", "DIRECT_CALL", None, "d"), ("long", 1, "a", "b", "DIRECT_CALL", None, "d"), ("short", 0, "a", "b", "DIRECT_CALL", None, "d"), ("open", 0, "a", "b", "DIRECT_CALL", None, "d"), ("null", 0, None, "b", "FIELD_FLOW", None, " ")], "chain_key string, ord int, from_name string, to_name string, kind string, field string, descriptor string")
    assert {r.chain_key for r in chains.preferred(table, hops, ["category", "sink_class"]).collect()} == {"long", "null"}
    ids = {r.chain_key: r for r in chains.identity(table, hops).collect()}
    assert ids["null"].identity == "1|<null>|HIGH|readObject|E|e|S|s|TERMINAL|HIGH|<null>|b|FIELD_FLOW|<null>| |" and len(ids["null"].short_id) == 8
    assert dict(rows(chains.missing_evidence(hops)))["null"] == 2


def test_budget_is_fair_and_whole(spark):
    got = {r.sink: r.budget for r in calibrate.fair_budget(spark.createDataFrame([(f"s{i}", i % 3) for i in range(7)], "sink string, depth int"), 20_000).collect()}
    assert sum(got.values()) == 20_000 and max(got.values()) - min(got.values()) <= 1
    assert calibrate.fair_budget(spark.createDataFrame([], "sink string, depth int"), 10).count() == 0


def test_pattern_division(spark):
    paths = spark.createDataFrame([("c", "a1"), ("c", "b1"), ("d", "a1")], "chain_key string, element string")
    need = spark.createDataFrame([(1, "a"), (1, "z"), (2, "a"), (2, "b"), (3, "a")], "pattern int, prefix string")
    assert rows(calibrate.patterns(paths, need)) == [("c", 2), ("d", 3)]


def test_fragments_need_all_anchors(spark):
    got = compose.fragments(spark.createDataFrame([("f", "A"), ("f", "B"), ("g", "A")], "fragment string, anchor string"), spark.createDataFrame([("A",)], "name string"))
    assert {r.fragment: r.active for r in got.collect()} == {"f": False, "g": True}


def test_percentiles_are_nearest_rank(spark):
    got = report.percentiles(spark.createDataFrame([("a", v) for v in (10, 20, 30, 40)], "phase string, ms long"), "phase", "ms", (20, 39)).first()
    assert (got.p50, got.p95, got.passed) == (20, 40, False)


def test_run_difference(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "chain_key string, fingerprint string")
    new = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], "chain_key string, fingerprint string")
    assert dict(rows(report.diff(old, new))) == {"a": "REMOVED", "b": "UNCHANGED", "c": "CHANGED", "d": "ADDED"}
    assert dict(rows(report.baseline(old, new, new.where("chain_key = 'd'")))) == {"a": "REMOVED", "b": "UNCHANGED", "c": "UNCHANGED", "d": "SUPPRESSED_NEW"}


# Sources and sinks -------------------------------------------------------------------------


def jars():
    return sorted(glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "*.jar")), key=os.path.getsize)


def small_classes():
    found = []
    for jar in jars():
        with zipfile.ZipFile(jar) as z:
            found += [z.read(n) for n in z.namelist() if n.endswith(".class")]
        if len(found) > 150:
            return found[:150]
    return found


def test_class_files_of_public_jars_parse():
    found = [classfile.parse(b) for b in small_classes()]
    assert len(found) > 50 and any(m.instructions for c in found for m in c.methods)
    for c in found:
        for m in c.methods:
            assert [x.offset for x in m.instructions] == list(range(len(m.instructions)))
            assert all(0 <= t < len(m.instructions) for x in m.instructions for t in x.targets)
            assert all(x.owner and x.name and x.descriptor for x in m.instructions if x.kind.startswith("INVOKE") and x.kind != "INVOKEDYNAMIC")


def test_damaged_class_files_raise_typed_errors_only():
    r, data = random.Random(3), small_classes()[0]
    for _ in range(300):
        bad = bytearray(data)
        for _ in range(r.randint(1, 8)):
            bad[r.randrange(len(bad))] = r.randrange(256)
        try:
            classfile.parse(bytes(bad[: r.choice([len(bad), r.randrange(len(bad))])]))
        except (classfile.ClassFormatError, UnicodeDecodeError, IndexError):
            pass


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_archive_scan(spark, tmp_path):
    body = small_classes()[0]
    inner = zipped({"in/C.class": body, "META-INF/versions/9/in/C.class": body, "META-INF/versions/17/in/C.class": body})
    (tmp_path / "a.jar").write_bytes(zipped({"BOOT-INF/lib/x.jar": inner, "BOOT-INF/classes/D.class": body, "readme.txt": b"no", "lib/bad.jar": b"broken"}))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "E.class").write_bytes(body)
    (tmp_path / "broken.jar").write_bytes(b"PK nothing")
    found = archive.class_files(spark, str(tmp_path))
    assert sorted((r.logical, r.version) for r in found.where("problem is null").collect()) == [("D.class", 0), ("E.class", 0), ("in/C.class", 0), ("in/C.class", 9), ("in/C.class", 17)]
    assert sorted(r.problem for r in found.where("problem is not null").collect()) == ["BAD_ARCHIVE", "BAD_ARCHIVE"]
    assert sorted((r.logical, r.version) for r in archive.for_release(found, 11).collect()) == [("D.class", 0), ("E.class", 0), ("in/C.class", 9)]
    assert {r.problem for r in classfile.classes(found.where("problem is null")).collect()} == {None}
    assert classfile.instructions(found.where("problem is null")).where("op like 'INVOKE%'").count() > 0
    codes = {r[-1] for r in archive.entries(zipped({"A.class": b"x" * 50, "B.class": b"y"}), "o", archive.Budget(entry=10, entries=1))}
    assert codes == {"ENTRY_BYTES", "ENTRIES"}


def test_first_artifact_wins(spark):
    found = spark.createDataFrame([(0, "a.jar", "X"), (1, "b.jar", "X"), (1, "b.jar", "Y")], "artifact_index int, origin string, logical string")
    assert sorted((r.logical, r.origin, r.shadowed) for r in archive.first_wins(found).collect()) == [("X", "a.jar", ["b.jar"]), ("Y", "b.jar", [])]


def test_manifest_continuations():
    assert archive.manifest("Main-Class: a.b\r\n .C\r\nX: y\r\n\r\nName: z\r\n") == {"Main-Class": "a.b.C", "X": "y"}


def test_rule_catalogue(spark):
    pytest.importorskip("yaml")
    text = "- {id: r1, kind: sink, category: c, match: {owner: +a/B, name: ~run.*}, tainted: [{arg: 1}, {receiver: true}]}\n- {id: r2, kind: model, match: {owner: x, name: y}, actions: {return: [this, arg0], arg1: this}}"
    got = {r.rule_id: r for r in catalogue.rules_table(spark, text).collect()}
    assert (got["r1"].owner_mode, got["r1"].owner_pat, got["r1"].name_mode, got["r1"].tainted, got["r1"].role) == ("subtype", "a/B", "regex", ["arg1", "this"], "TERMINAL")
    assert got["r2"].actions == {"return": ["this", "arg0"], "arg1": ["this"]}
    for bad in ("- {id: a, kind: nope}", "- {kind: sink}", "- {id: a, kind: sink}\n- {id: a, kind: sink}", "a: 1", "- &x {id: a, kind: sink}\n- *x", "- {id: a, kind: sink, m: " + "[" * 40 + "]" * 40 + "}"):
        with pytest.raises(catalogue.CatalogueError):
            catalogue.parse_rules(bad)


def test_reports(spark, tmp_path):
    finding = {"id": "1", "status": "S", "entry": "e", "impact": "i", "graph": ["a", "b"], "limits": []}
    whole = {"schema_version": "1", "mode": "m", "result": {"outcome": "COMPLETE", "coverage": "c", "candidates": 2, "exported": 1, "limits": []}, "findings": [finding]}
    (tmp_path / "ok.json").write_text(json.dumps(whole))
    (tmp_path / "bad.json").write_text(json.dumps(whole | {"findings": [finding, finding]}))
    assert [(r.id, r.graph) for r in catalogue.read_findings(spark, str(tmp_path / "ok.json")).collect()] == [("1", ["a", "b"])]
    with pytest.raises(Exception, match="unsound report"):
        catalogue.read_findings(spark, str(tmp_path / "bad.json")).collect()
    findings = catalogue.read_findings(spark, str(tmp_path / "ok.json"))
    assert [r.line for r in catalogue.markdown(findings).collect()] == ["## 1", "- a", "- b"]
    catalogue.write_report(findings, str(tmp_path / "out"), "COMPLETE", ["b", "a"])
    assert json.loads(spark.read.text(str(tmp_path / "out/summary")).first()[0])["limits"] == ["a", "b"]
    (tmp_path / "list").write_text("# all\nrule:r1\n sha256:ab # why\n\nE|x\n")
    assert rows(catalogue.read_suppressions(spark, str(tmp_path / "list"))) == [("identity", "E|x"), ("rule", "r1"), ("sha256", "ab")]
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    assert [catalogue.cached(spark, f"file://{tmp_path}/cache", "k", build).count() for _ in range(2)] == [3, 3] and len(calls) == 1
    component = json.loads(catalogue.sbom(spark.createDataFrame([("n", "1", "ab")], "name string, version string, sha256 string")).first()[0])
    assert component["hashes"] == [{"alg": "SHA-256", "content": "ab"}]


def test_stream_of_samples(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", 1, "a", 2.5, ""), (2, "2024-01-01 00:20:00", 1, "a", 1.0, ""), (3, "2024-01-01 02:00:00", 1, "b", 7.0, "")], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    samples.run_once(samples.windowed(samples.read_samples(spark, str(tmp_path / "in"))), "stream_test", str(tmp_path / "state"))
    got = rows(spark.table("stream_test").select("phase", "n", "wall_ms"))
    assert got == rows(samples.windowed(events).select("phase", "n", "wall_ms")) == [("a", 2, 3), ("b", 1, 7)]
