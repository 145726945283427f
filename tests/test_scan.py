"""A scan of class files that the test writes itself."""

import struct

import pytest

from chainloom.plans import scan
from chainloom.sources import classfile


class Writer:
    """Just enough of an assembler: a constant pool, methods of raw code, no attributes but Code."""

    def __init__(self, name, parent="java/lang/Object", interfaces=()):
        self.pool, self.known = [], {}
        self.head = struct.pack(">HHH", 0x21, self.type(name), self.type(parent)) + struct.pack(">H", len(interfaces)) + b"".join(struct.pack(">H", self.type(i)) for i in interfaces)
        self.methods = []

    def add(self, key, body):
        if key not in self.known:
            self.pool.append(body)
            self.known[key] = len(self.pool)
        return self.known[key]

    def text(self, s):
        return self.add(("t", s), b"\x01" + struct.pack(">H", len(s)) + s.encode())

    def type(self, s):
        return self.add(("c", s), b"\x07" + struct.pack(">H", self.text(s)))

    def ref(self, tag, owner, name, descriptor):
        pair = self.add(("n", name, descriptor), b"\x0c" + struct.pack(">HH", self.text(name), self.text(descriptor)))
        return struct.pack(">H", self.add((tag, owner, name, descriptor), bytes([tag]) + struct.pack(">HH", self.type(owner), pair)))

    def method(self, access, name, descriptor, code):
        code = b"".join(c if isinstance(c, bytes) else bytes([c]) for c in code)
        body = struct.pack(">HHI", 8, 8, len(code)) + code + b"\0\0\0\0"
        self.methods.append(struct.pack(">HHHHHI", access, self.text(name), self.text(descriptor), 1, self.text("Code"), len(body)) + body)

    def bytes(self):
        tail = b"\0\0" + struct.pack(">H", len(self.methods)) + b"".join(self.methods) + b"\0\0"
        return struct.pack(">IHHH", 0xCAFEBABE, 0, 52, len(self.pool) + 1) + b"".join(self.pool) + self.head + tail


def program():
    handler = Writer("app/Handler", interfaces=("com/sun/net/httpserver/HttpHandler",))
    # handle(x) { new-free: service.run(x) through an interface; a constant goes to the sink too }
    handler.method(1, "handle", "(Ljava/lang/String;)V", [42, 43, 0xB5, handler.ref(9, "app/Handler", "kept", "Ljava/lang/String;"), 0xB8, handler.ref(10, "app/Services", "get", "()Lapp/Service;"), 42, 0xB4, handler.ref(9, "app/Handler", "kept", "Ljava/lang/String;"), 0xB9, handler.ref(11, "app/Service", "run", "(Ljava/lang/String;)V"), b"\x02\x00", 0xB1])
    handler.method(1, "safe", "(Ljava/lang/String;)V", [43, 0xB8, handler.ref(10, "lib/Exec", "start", "(Ljava/lang/String;)V"), 0xB1])
    service = Writer("app/Service")
    service.head = struct.pack(">HHH", 0x601, service.type("app/Service"), service.type("java/lang/Object")) + b"\0\0"
    impl = Writer("app/Impl", interfaces=("app/Service",))
    impl.method(1, "run", "(Ljava/lang/String;)V", [43, 0xB8, impl.ref(10, "app/Impl", "same", "(Ljava/lang/String;)Ljava/lang/String;"), 0xB8, impl.ref(10, "lib/Exec", "start", "(Ljava/lang/String;)V"), 0xB1])
    impl.method(9, "same", "(Ljava/lang/String;)Ljava/lang/String;", [42, 0xB0])
    return {"app/Handler": handler, "app/Service": service, "app/Impl": impl}


RULES = "- {id: exec, kind: sink, category: command, severity: HIGH, match: {owner: lib/Exec, name: start}, tainted: [{arg: 0}]}\n- {id: other, kind: sink, category: file, severity: LOW, match: {owner: ~lib/.*, name: ~.*}, tainted: [{arg: 0}]}"


def test_scan_follows_fields_interfaces_and_returns(spark, tmp_path, monkeypatch, capsys):
    pytest.importorskip("yaml")
    at = tmp_path / "in"
    at.mkdir()
    for name, w in program().items():
        classfile.parse(w.bytes())
        (at / f"{name.rpartition('/')[2]}.class").write_bytes(w.bytes())
    (at / "bad.class").write_bytes(b"\xca\xfe")
    done = scan.scan(spark, str(at), RULES)
    found = done.findings.collect()
    assert [(r.rule_id, r.entry, r.sink) for r in found] == [("exec", "app/Handler#handle(Ljava/lang/String;)V", "lib/Exec#start(Ljava/lang/String;)V")]
    assert found[0].path.split(">") == ["app/Handler#handle(Ljava/lang/String;)V|1", "field:app/Handler:kept:Ljava/lang/String;", "app/Impl#run(Ljava/lang/String;)V|1", "app/Impl#same(Ljava/lang/String;)Ljava/lang/String;|0", "app/Impl#same(Ljava/lang/String;)Ljava/lang/String;|return", "lib/Exec#start(Ljava/lang/String;)V|0"]
    assert done.outcome == "PARTIAL" and done.reasons == ["CLASS_FORMAT"]
    (tmp_path / "rules.yaml").write_text(RULES)
    monkeypatch.setattr(spark, "stop", lambda: None)
    monkeypatch.setattr(scan, "scan", lambda *_: done)
    assert scan.main(["scan", str(at), "--rules", str(tmp_path / "rules.yaml"), "--output", str(tmp_path / "out")]) == 2
    assert scan.main(["diff", str(tmp_path / "out"), str(tmp_path / "out")]) == 0
    assert "UNCHANGED 1" in capsys.readouterr().out
    assert scan.main(["scan", str(at), "--rules", str(tmp_path / "rules.yaml"), "--output", str(tmp_path / "again"), "--baseline", str(tmp_path / "out")]) == 2
    read = lambda name: [r.asDict() for r in spark.read.json(f"{tmp_path}/again/{name}").collect()]
    assert [r["n"] for r in read("baseline_counts")] == [1] and [r["findings"] for r in read("evidence") if r["findings"]] == [1]
    assert {r["problem"] for r in read("problems")} == {"CLASS_FORMAT"} and sorted(x.name for x in tmp_path.iterdir() if "draft" in x.name or "before" in x.name) == []


def test_performance_gates():
    assert scan.performance(lambda: None, 3, 1, (10_000, 10_000))["passed"] and not scan.performance(lambda: None, 0)["passed"]
    assert not scan.performance(lambda: __import__("time").sleep(0.01), 2, 0, (1, 1))["passed"]


def test_findings_keep_every_entry_and_say_what_bounds_leave_open(spark):
    flow = spark.createDataFrame([("e1", "s"), ("e2", "s"), ("e3", "e2"), ("e1", "x"), ("x", "s"), ("s", "e1"), ("e1", "away")], "src string, dst string")
    seeds = spark.createDataFrame([(e, e) for e in ("e1", "e2", "e3")], "entry string, node string")
    places = spark.createDataFrame([("s", "sink", "r", "c", "HIGH")], "place string, sink string, rule_id string, category string, severity string")
    got, bounds = scan.findings(seeds, flow, places)
    assert {(r.entry, r.path, r.alternatives) for r in got.collect()} == {("e1", "e1>s", 2), ("e2", "e2>s", 1), ("e3", "e3>e2>s", 1)} and not bounds
    got, bounds = scan.findings(seeds, flow, places, rounds=1, k=1)
    assert {(r.entry, r.path) for r in got.collect()} == {("e1", "e1>s"), ("e2", "e2>s")} and bounds == ["PATH_BOUND"]
    got, bounds = scan.findings(seeds, flow, places, k=1)
    assert got.count() == 3 and bounds == ["ALTERNATIVE_BOUND"]
    names = [f"n{i:02}" for i in range(30)]
    chain = spark.createDataFrame(list(zip(names, names[1:])), "src string, dst string")
    far = spark.createDataFrame([("n20", "sink", "r", "c", "HIGH")], places.schema)
    got, bounds = scan.findings(spark.createDataFrame([("n00", "n00")], seeds.schema), chain, far)
    assert [r.hops for r in got.collect()] == [20] and not bounds
