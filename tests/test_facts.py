"""Protocol facts, entries and feasibility."""

from test_operators import rows, small_classes
from test_valueflow import insn

from chainloom.operators import entries, feasibility, fixpoint, protocols, valueflow
from chainloom.sources import classfile
from chainloom.sources.classfile import Method, parse


def test_call_facts_and_identities(spark):
    data = [
        ("m", 1, "INVOKESTATIC", "java/lang/Class#forName(Ljava/lang/String;)Ljava/lang/Class;", 0, ["5:constant:string:a.b.C"]),
        ("m", 2, "INVOKEVIRTUAL", "java/lang/Class#getMethod(Ljava/lang/String;[Ljava/lang/Class;)Ljava/lang/reflect/Method;", 0, ["5:constant:string:run"]),
        ("m", 3, "INVOKEVIRTUAL", "java/lang/reflect/Method#invoke(Ljava/lang/Object;[Ljava/lang/Object;)Ljava/lang/Object;", 0, ["1:param:1", "3:call:9"]),
        ("m", 4, "INVOKEVIRTUAL", "java/io/ObjectInputStream#readObject()Ljava/lang/Object;", -1, ["6:unknown"]),
        ("m", 5, "INVOKEVIRTUAL", "x/Y#use()V", -1, ["3:call:4"]),
        ("m", 6, "INVOKEVIRTUAL", "x/Y#use()V", -1, ["3:call:4", "6:unknown"]),
        ("n", 1, "INVOKESTATIC", "java/lang/Class#other()V", 0, ["6:unknown"]),
    ]
    inputs = spark.createDataFrame(data, valueflow.INPUTS)
    facts = protocols.call_facts(inputs)
    assert rows(facts.select("fact", "pos", "status")) == [("class-lookup", 1, "PROVED"), ("object-read", 4, "UNKNOWN"), ("reflective-call", 3, "PARTIAL")]
    assert facts.where("fact = 'class-lookup'").first().constant == "a.b.C"
    assert rows(protocols.same_value(facts, inputs).select("fact", "used_at", "status")) == [("object-read", 5, "PROVED"), ("object-read", 6, "PARTIAL")]
    methods = spark.createDataFrame([("a/b/C#run(I)V",), ("a/b/C#run()V",), ("a/b/C#stop()V",)], "method string")
    assert rows(protocols.reflective_targets(inputs, methods)) == [("m", 3, "a/b/C#run()V"), ("m", 3, "a/b/C#run(I)V")]


def test_entries_in_order(spark):
    pairs = spark.createDataFrame([(entries.HTTP_HANDLER, "H", 1), ("javax/servlet/http/HttpServlet", "S", 2)], "ancestor string, descendant string, depth int")
    m = [("A", "main", "([Ljava/lang/String;)V", 9, [], []), ("A", "main", "()V", 9, [], []), ("H", "handle", "(LX;)V", 1, [], []), ("S", "doGet", "(LR;LS;)V", 4, [], []), ("S", "init", "()V", 1, [], []), ("S", "other", "()V", 1, [], []), ("C", "get", "()V", 1, ["Lorg/x/GetMapping;"], []), ("C", "hidden", "()V", 2, ["Lorg/x/GetMapping;"], []), ("W", "op", "()V", 1, [], ["Ljavax/jws/WebService;"]), ("W", "op2", "()V", 1, ["Ljavax/jws/WebMethod;"], ["Ljavax/jws/WebService;"])]
    got = entries.entries(spark.createDataFrame(m, "owner string, name string, descriptor string, access int, annotations array<string>, class_annotations array<string>"), pairs)
    assert rows(got.select("owner", "name", "entry_kind", "controlled")) == [("A", "main", "lifecycle-main", False), ("C", "get", "framework-http", True), ("H", "handle", "http-handler", True), ("S", "doGet", "servlet-lifecycle", True), ("S", "init", "servlet-lifecycle", False), ("W", "op", "framework-service", False), ("W", "op2", "framework-service", True)]
    routes = spark.createDataFrame([("/a", "A", "main"), ("/c", "C", "get")], "route string, owner string, name string")
    assert rows(entries.resource_entries(routes, spark.createDataFrame(m, "owner string, name string, descriptor string, access int, annotations array<string>, class_annotations array<string>"))) == [("/c", "C", "get", "()V")]


def const(pos, value):
    return insn(pos, 16, "CONST", constant=f"int:{value}")


def test_known_branches_and_unreachable_sinks():
    # if (2 * 3 > 5) { sink } else { other }
    code = [const(0, 2), const(1, 3), insn(2, 104), const(3, 5), insn(4, 164, "BRANCH", targets=(7,)), insn(5, 0), insn(6, 177, "RETURN"), insn(7, 177, "RETURN")]
    m = Method("m", "()V", 8, code, [])
    assert feasibility.branches(m) == ({4: False}, True)
    assert feasibility.path_proof(m, 5) == "PROVEN_RETAINED" and feasibility.path_proof(m, 7) == "PROVABLY_UNREACHABLE"
    unknown = Method("m", "(I)V", 8, [insn(0, 21, local=0), insn(1, 153, "BRANCH", targets=(3,)), insn(2, 0), insn(3, 177, "RETURN")], [])
    assert feasibility.branches(unknown) == ({}, True) and feasibility.path_proof(unknown, 2) == "PROVEN_RETAINED"
    # A loop changes the local, so the branch isn't known.
    loop = Method("m", "()V", 8, [const(0, 0), insn(1, 54, local=0), insn(2, 21, local=0), insn(3, 153, "BRANCH", targets=(6,)), insn(4, 132, local=0), insn(5, 167, "GOTO", targets=(2,)), insn(6, 132, local=0), insn(7, 167, "GOTO", targets=(2,))], [])
    assert feasibility.branches(loop) == ({}, True)


def test_integer_arithmetic_wraps():
    assert feasibility._arithmetic(104, 1 << 30, 4) == 0 and feasibility._arithmetic(96, 2**31 - 1, 1) == -(2**31)
    assert feasibility._arithmetic(108, -7, 2) == -3 and feasibility._arithmetic(112, -7, 2) == -1 and feasibility._arithmetic(108, 1, 0) is None
    assert feasibility._arithmetic(124, -1, 28) == 15 and feasibility._arithmetic(122, -8, 1) == -4


def test_public_methods_are_never_broken_by_proofs():
    methods = [m for b in small_classes() for m in parse(b).methods if m.instructions]
    found = [feasibility.branches(m) for m in methods]
    assert sum(done for _, done in found) > 0.8 * len(found)
    proofs = [feasibility.path_proof(m, i) for m in methods[:300] for i, x in enumerate(m.instructions) if x.kind == "RETURN"]
    assert set(proofs) <= {"PROVEN_RETAINED", "UNKNOWN", "BUDGET_EXCEEDED", "PROVABLY_UNREACHABLE"} and proofs.count("PROVABLY_UNREACHABLE") < 0.02 * len(proofs)


def test_tables_for_hierarchy_and_entries(spark):
    found = small_classes()
    files = spark.createDataFrame([(f"s{i}", bytearray(b)) for i, b in enumerate(found)] + [("bad", bytearray(b"junk"))], "sha256 string, content binary")
    parsed = [parse(b) for b in found]
    assert classfile.methods(files).count() == sum(len(c.methods) for c in parsed)
    edges = rows(classfile.type_edges(files).select("parent", "child"))
    assert edges == sorted((p, c.name) for c in parsed for p in [c.parent, *c.interfaces] if p)
    defined = {c.name for c in parsed}
    missing = {r.name for r in classfile.missing_types(files).collect()}
    assert not missing & defined and not any(n.startswith("java/") for n in missing)
    pairs = fixpoint.closure(classfile.type_edges(files))[0]
    assert entries.entries(classfile.methods(files), pairs).count() >= 0
