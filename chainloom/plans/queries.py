"""Registered queries: the operators applied to the test tables seen as a program, each with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import calibrate, callgraph, cfg, chains, compose, fixpoint, hierarchy, report, rules
from ..session import ship
from ..sources import catalogue
from ..streaming import samples
from .views import Program, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROUNDS = 6
#: The reference's bounds on hops: forward and backward.
FORWARD, BACKWARD = 20, 40


def query(oracle: str | None = None):
    def add(f: Callable[[Program], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Program(ship(spark), sf_dir))
        if oracle:
            ORACLES[f.__name__] = duck(oracle)
        return f

    return add


# Reachability ---------------------------------------------------------------------------

_REACH = f"""WITH r AS (SELECT method AS node, 0 AS depth FROM {{sources}} UNION SELECT e.dst, r.depth + 1 FROM r JOIN {{edges}} e ON e.src = r.node WHERE e.type <> 'LAMBDA' AND r.depth < {ROUNDS}),
reach AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)"""
_DIST = f"""d AS (SELECT method AS node, 0 AS depth FROM {{sinks}} UNION SELECT e.src, d.depth + 1 FROM d JOIN {{edges}} e ON e.dst = d.node WHERE e.type <> 'LAMBDA' AND d.depth < {ROUNDS}),
dist AS (SELECT node, min(depth) AS depth FROM d GROUP BY node)"""


def _reach(p: Program) -> DataFrame:
    return fixpoint.least_depth(p.sources.select(F.col("method").alias("node")), p.edges.where("type <> 'LAMBDA'"), ROUNDS)[0]


def _distance(p: Program) -> DataFrame:
    back = p.edges.where("type <> 'LAMBDA'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return fixpoint.least_depth(p.sinks.select(F.col("method").alias("node")), back, ROUNDS)[0]


@query(_REACH + " SELECT node, depth FROM reach")
def reach_min_depth(p):
    return _reach(p)


@query("WITH " + _DIST + " SELECT node, depth FROM dist")
def sink_distance(p):
    return _distance(p)


@query(_REACH + ", " + _DIST + " SELECT reach.node, reach.depth AS entry_depth, dist.depth AS distance FROM reach JOIN dist ON reach.node = dist.node WHERE reach.depth + dist.depth <= 4")
def entry_sink_intersection(p):
    return _reach(p).withColumnRenamed("depth", "entry_depth").join(_distance(p).withColumnRenamed("depth", "distance"), "node").where("entry_depth + distance <= 4")


@query("SELECT src AS node FROM {edges} INTERSECT SELECT dst FROM {edges}")
def slice_intersection(p):
    return p.edges.select(F.col("src").alias("node")).intersect(p.edges.select("dst"))


@query("WITH " + _DIST + """, n AS (SELECT s.method, dist.depth FROM {sources} s LEFT JOIN dist ON dist.node = s.method)
SELECT CASE WHEN depth IS NULL THEN -1 ELSE depth END AS distance, count(*) AS methods FROM n GROUP BY 1""")
def entry_distance_histogram(p):
    met = p.sources.join(_distance(p), F.col("method") == F.col("node"), "left")
    return met.groupBy(F.coalesce("depth", F.lit(-1)).alias("distance")).agg(F.count(F.lit(1)).alias("methods"))


@query("""WITH both_ AS MATERIALIZED (SELECT src, dst FROM {followers} UNION SELECT dst, src FROM {followers}), walk AS (SELECT src AS node, src AS low FROM both_ UNION SELECT b.dst, w.low FROM walk w JOIN both_ b ON b.src = w.node)
SELECT node, min(low) AS component FROM walk GROUP BY node""")
def region_components(p):
    return fixpoint.components(p.followers)


_PATHS = """WITH p AS (SELECT method AS node, 0 AS hops, method AS path FROM {sources} UNION ALL SELECT e.dst, p.hops + 1, p.path || '>' || e.dst FROM p JOIN (SELECT DISTINCT src, dst FROM {edges} WHERE type <> 'LAMBDA') e ON e.src = p.node WHERE p.hops < 2 AND NOT list_contains(string_split(p.path, '>'), e.dst)),
k AS (SELECT node, hops, path, row_number() OVER (PARTITION BY node ORDER BY hops, path) AS rank FROM p)"""


def _paths(p: Program, k: int) -> DataFrame:
    return fixpoint.k_paths(p.sources.select(F.col("method").alias("node")), p.edges.where("type <> 'LAMBDA'"), 2, k)


@query(_PATHS + " SELECT node, hops, path FROM k WHERE rank = 1")
def taint_forward_best(p):
    return _paths(p, 1).select("node", "hops", "path")


@query(_PATHS + " SELECT node, CAST(rank AS INT) AS rank, hops, path FROM k WHERE rank <= 8")
def taint_forward_k8(p):
    return _paths(p, 8).select("node", "rank", "hops", "path")


@query(_PATHS + " SELECT k.node AS sink, path FROM k JOIN {sinks} s ON s.method = k.node WHERE rank = 1")
def bounded_call_path(p):
    return _paths(p, 1).join(p.sinks, F.col("node") == F.col("method")).select(F.col("node").alias("sink"), "path")


# The same to the reference's bounds. DuckDB would list all walks of that length, so these have
# no SQL; the tests compare them with brute force. ``complete`` says whether nothing lies beyond.


def _reach_full(p: Program, rounds: int = FORWARD) -> DataFrame:
    return _bounded(p.sources, p.edges.where("type <> 'LAMBDA'"), rounds)


def _distance_full(p: Program, rounds: int = BACKWARD) -> DataFrame:
    return _bounded(p.sinks, p.edges.where("type <> 'LAMBDA'").select(F.col("dst").alias("src"), F.col("src").alias("dst")), rounds)


def _bounded(seeds: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """One round more than asked for tells whether anything lies beyond."""
    seen, complete = fixpoint.least_depth(seeds.select(F.col("method").alias("node")), edges, rounds + 1)
    return seen.where(F.col("depth") <= rounds).withColumn("complete", F.lit(complete))


def _paths_full(p: Program, k: int) -> DataFrame:
    paths, complete = fixpoint.k_simple_paths(p.sources.select(F.col("method").alias("node")), p.edges.where("type <> 'LAMBDA'"), FORWARD, k)
    return paths.withColumn("complete", F.lit(complete))


@query()
def reach_min_depth_full(p):
    return _reach_full(p)


@query()
def sink_distance_full(p):
    return _distance_full(p)


@query()
def entry_sink_intersection_full(p):
    """Nodes on a way of at most as many hops as a forward path may have; what lies beyond those bounds isn't on one."""
    ahead, back = _reach_full(p), _distance_full(p, FORWARD)
    met = ahead.select("node", F.col("depth").alias("entry_depth"), "complete").join(back.select("node", F.col("depth").alias("distance"), F.col("complete").alias("ended")), "node")
    return met.where(F.col("entry_depth") + F.col("distance") <= FORWARD).select("node", "entry_depth", "distance", (F.col("complete") & F.col("ended")).alias("complete"))


@query()
def taint_forward_best_full(p):
    return _paths_full(p, 1).select("node", "hops", "path", "complete")


@query()
def taint_forward_k8_full(p):
    return _paths_full(p, 8).select("node", "rank", "hops", "path", "complete")


@query()
def bounded_call_path_full(p):
    return _paths_full(p, 1).join(p.sinks, F.col("node") == F.col("method")).select(F.col("node").alias("sink"), "path", "complete")


# Hierarchy and dispatch ------------------------------------------------------------------

_CLOSURE = """WITH c AS (SELECT super AS ancestor, name AS descendant, 1 AS depth FROM {types} WHERE super IS NOT NULL UNION SELECT c.ancestor, t.name, c.depth + 1 FROM c JOIN {types} t ON t.super = c.descendant),
pairs AS (SELECT ancestor, descendant, min(depth) AS depth FROM c GROUP BY ancestor, descendant)"""


@query("SELECT super AS parent, name AS child, count(*) OVER (PARTITION BY super) AS n FROM (SELECT DISTINCT super, name FROM {types} WHERE super IS NOT NULL) x")
def direct_subtypes(p):
    return hierarchy.direct_subtypes(p.types)


@query(_CLOSURE + " SELECT ancestor, descendant, depth FROM pairs")
def type_closure(p):
    return hierarchy.type_closure(p.types)


@query(_CLOSURE + """, r AS (SELECT *, row_number() OVER (PARTITION BY ancestor ORDER BY depth, descendant) AS rank, count(*) OVER (PARTITION BY ancestor) AS total FROM pairs)
SELECT ancestor, descendant, depth, total <= 200 AS complete FROM r WHERE rank <= 200""")
def type_closure_capped(p):
    return hierarchy.capped(hierarchy.type_closure(p.types), 200)


@query(_CLOSURE + " SELECT t.name, (t.name = 'R1' OR t.name IN (SELECT descendant FROM pairs WHERE ancestor = 'R1')) AS is_subtype FROM {types} t")
def is_subtype_pairs(p):
    return hierarchy.is_subtype(p.types, hierarchy.type_closure(p.types), "R1")


_DECLARED = "(SELECT name AS owner, 'run' AS method FROM {types} WHERE kind = 'R' OR (kind = 'N' AND CAST(substr(name, 2) AS INT) % 3 = 0) UNION ALL SELECT name, 'get' FROM {types} WHERE kind = 'N')"


@query(_CLOSURE + f""", up AS (SELECT name AS owner, name AS at, 0 AS depth FROM {{types}} UNION ALL SELECT descendant, ancestor, depth FROM pairs),
m AS (SELECT up.owner, d.method AS name, up.at AS declarer, up.depth, row_number() OVER (PARTITION BY up.owner, d.method ORDER BY up.depth, up.at) AS rn FROM up JOIN {_DECLARED} d ON d.owner = up.at)
SELECT owner, name, declarer, depth FROM m WHERE rn = 1""")
def resolve_method(p):
    return hierarchy.resolve_method(p.types, hierarchy.type_closure(p.types), p.sql("SELECT * FROM " + _DECLARED))


@query(_CLOSURE + """, m AS (SELECT ancestor, descendant FROM pairs JOIN {types} t ON t.name = descendant WHERE t.kind IN ('S', 'C'))
SELECT ancestor, count(*) AS n, CASE WHEN count(*) <= 70 THEN string_agg(descendant, ',' ORDER BY descendant) END AS implementers FROM m GROUP BY ancestor""")
def implementers(p):
    return hierarchy.implementers(hierarchy.type_closure(p.types), p.types.where("kind in ('S', 'C')"), 70)


@query("""SELECT name, CASE WHEN access < 0 THEN true WHEN (access & 2) <> 0 OR (access & 8) <> 0 OR (access & 16) <> 0 THEN false WHEN (access & 1) <> 0 OR (access & 4) <> 0 THEN true ELSE owner < 'S5' END AS overridable FROM {methods}""")
def overridable_targets(p):
    return p.methods.select("name", hierarchy.overridable(F.col("access"), F.col("owner") < "S5").alias("overridable"))


_SIGNATURES = "(SELECT c.call_id, t.super AS receiver FROM {calls} c JOIN {methods} m ON m.name = c.host JOIN {types} t ON t.name = m.owner WHERE c.kind IN ('VIRTUAL', 'INTERFACE'))"


@query(_CLOSURE + f""", s AS (SELECT * FROM {_SIGNATURES} x), own AS (SELECT DISTINCT receiver FROM s),
down AS (SELECT ancestor AS receiver, descendant AS target FROM pairs UNION ALL SELECT receiver, receiver FROM own),
m AS (SELECT own.receiver, d.target FROM own JOIN down d ON d.receiver = own.receiver JOIN {{types}} t ON t.name = d.target AND t.kind = 'S'),
n AS (SELECT own.receiver, count(m.target) AS n FROM own LEFT JOIN m ON m.receiver = own.receiver GROUP BY own.receiver),
plan AS (SELECT n.receiver, m.target, 'dispatch' AS status FROM n JOIN m ON m.receiver = n.receiver WHERE n.n BETWEEN 1 AND 5 UNION ALL SELECT receiver, receiver, CASE WHEN n = 0 THEN 'fallback' ELSE 'capped' END FROM n WHERE n = 0 OR n > 5)
SELECT s.receiver, plan.target, plan.status, count(*) AS calls FROM s JOIN plan ON plan.receiver = s.receiver GROUP BY ALL""")
def cha_dispatch(p):
    signatures = p.sql("SELECT * FROM " + _SIGNATURES)
    plan = callgraph.dispatch_plan(signatures, hierarchy.type_closure(p.types), p.types.where("kind = 'S'"), 5)
    return signatures.groupBy("receiver").agg(F.count(F.lit(1)).alias("calls")).join(plan, "receiver").select("receiver", "target", "status", "calls")


@query("SELECT c.call_id, ((m.access & 16) <> 0 OR (m.access & 2) <> 0 OR (m.access & 8) <> 0 OR m.owner IN ('S1', 'S2')) AS fixed FROM {calls} c JOIN {methods} m ON m.name = c.callee WHERE c.kind IN ('VIRTUAL', 'INTERFACE')")
def fixed_dispatch(p):
    met = p.calls.where("kind in ('VIRTUAL', 'INTERFACE')").join(p.methods, p.calls.callee == p.methods.name)
    return met.select("call_id", callgraph.fixed_dispatch(F.col("access"), F.col("owner").isin("S1", "S2")).alias("fixed"))


@query("SELECT DISTINCT callee FROM {calls} WHERE callee NOT IN (SELECT 'P' || CAST(p_partkey AS STRING) FROM {part} WHERE p_size <= 25)")
def external_nodes(p):
    return callgraph.external(p.calls, p.sql("SELECT 'P' || CAST(p_partkey AS STRING) AS name FROM {part} WHERE p_size <= 25"))


@query("""SELECT kind, CASE WHEN kind IN ('STATIC', 'SPECIAL', 'DYNAMIC') OR quantity % 5 = 1 THEN 'CONCRETE' WHEN quantity % 5 > 1 THEN 'SEALED_SET' WHEN line = 1 THEN 'POINTS_TO_BOUNDED' WHEN line = 2 THEN 'UNKNOWN' ELSE 'CHA_BOUNDED' END AS label, count(*) AS n FROM {calls} GROUP BY ALL""")
def receiver_precision(p):
    label = callgraph.receiver_precision(F.col("kind"), F.col("quantity") % 5, F.col("line") == 1, F.col("line") == 2)
    return p.calls.groupBy("kind", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT host, string_agg(CAST(pos AS STRING) || ':' || callee, ',' ORDER BY pos) AS calls FROM {calls} GROUP BY host""")
def calls_of_method(p):
    listed = F.array_sort(F.collect_list(F.struct("pos", "callee")))
    return p.calls.groupBy("host").agg(F.concat_ws(",", F.transform(listed, lambda x: F.concat_ws(":", x["pos"].cast("string"), x["callee"]))).alias("calls"))


@query("""SELECT coalesce(o.node, i.node) AS node, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM (SELECT src AS node, count(*) AS n FROM {edges} GROUP BY src) o FULL JOIN (SELECT dst AS node, count(*) AS n FROM {edges} GROUP BY dst) i ON o.node = i.node""")
def adjacency_degrees(p):
    out, into = p.edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o")), p.edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i"))
    return out.join(into, "node", "full_outer").select("node", F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("i", F.lit(0)).alias("in_degree"))


# Control flow and windows ------------------------------------------------------------------


@query("""SELECT method, src, dst, label FROM (SELECT method, pos AS src, lead(pos) OVER (PARTITION BY method ORDER BY pos) AS dst, CASE WHEN op = 'JUMP' THEN 'FALSE' ELSE 'SEQ' END AS label, op FROM {insns}) x WHERE op <> 'RETURN' AND dst IS NOT NULL
UNION ALL SELECT method, pos, CAST(floor(pos / 2.0) AS INT), 'JUMP' FROM {insns} WHERE op = 'JUMP'""")
def cfg_edges(p):
    return cfg.normal_edges(p.insns, F.floor(F.col("pos") / 2).cast("int"))


@query("SELECT i.method, i.pos AS src, h.handler AS dst, 'EXCEPTION' AS label FROM {insns} i JOIN {handlers} h ON h.method = i.method AND i.pos >= h.start_at AND i.pos < h.end_at WHERE i.op IN ('INVOKE', 'GETFIELD', 'PUTFIELD')")
def cfg_exception_edges(p):
    return cfg.exception_edges(p.insns, p.handlers, F.col("op").isin("INVOKE", "GETFIELD", "PUTFIELD"))


@query("""SELECT method, pos, constants FROM (SELECT method, pos, op, coalesce(array_to_string(list_filter(list(CASE WHEN op = 'CONST' THEN const END) OVER (PARTITION BY method ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL), ','), '') AS constants FROM {insns}) x WHERE op = 'RETURN'""")
def literal_window(p):
    return cfg.constants_before(p.insns, "RETURN", 6)


@query("SELECT method, pos FROM (SELECT method, pos, op, lag(op, 3) OVER (PARTITION BY method ORDER BY pos) AS b FROM {insns}) x WHERE op = 'PUTFIELD' AND b = 'GETFIELD'")
def array_writer_lag(p):
    return cfg.array_writers(p.insns)


@query("""SELECT method, pos, pushed FROM (SELECT method, pos, op, last_value(CASE WHEN op = 'CONST' THEN const END IGNORE NULLS) OVER (PARTITION BY method ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS pushed FROM {insns}) x WHERE op = 'RETURN'""")
def asof_pushed_bool(p):
    return cfg.last_constant(p.insns, "RETURN", 6)


@query("SELECT owner, name, writer, count(*) OVER (PARTITION BY owner, name) AS n FROM (SELECT DISTINCT owner, name, writer FROM {fields}) x")
def field_writers(p):
    return cfg.field_writers(p.fields)


@query("""WITH e AS (SELECT method, src, dst FROM (SELECT method, pos AS src, lead(pos) OVER (PARTITION BY method ORDER BY pos) AS dst, op FROM {insns}) x WHERE op <> 'RETURN' AND dst IS NOT NULL
UNION SELECT method, pos, CAST(floor(pos / 2.0) AS INT) FROM {insns} WHERE op = 'JUMP'),
n AS (SELECT method, 0 AS node FROM e UNION SELECT n.method, e.dst FROM n JOIN e ON e.method = n.method AND e.src = n.node),
w AS (SELECT DISTINCT method, node AS cut, 0 AS node FROM n WHERE node <> 0 UNION SELECT w.method, w.cut, e.dst FROM w JOIN e ON e.method = w.method AND e.src = w.node AND e.dst <> w.cut)
SELECT n.method, n.node AS pos, d.node AS dominator FROM n JOIN n d ON d.method = n.method WHERE d.node IN (0, n.node) OR NOT EXISTS (SELECT 1 FROM w WHERE w.method = n.method AND w.cut = d.node AND w.node = n.node)""")
def dominators(p):
    return cfg.dominators(cfg.normal_edges(p.insns, F.floor(F.col("pos") / 2).cast("int")))


# Rules -------------------------------------------------------------------------------------

_SCORED = """WITH up AS (SELECT name AS descendant, super AS ancestor FROM {brands} UNION SELECT up.descendant, b.super FROM up JOIN {brands} b ON b.name = up.ancestor),
hit AS (SELECT s.method, s.owner, r.*, s.owner = r.owner_pat AS same FROM {sites} s JOIN {rules} r ON CASE r.owner_mode WHEN 'exact' THEN s.owner = r.owner_pat
WHEN 'subtype' THEN s.owner = r.owner_pat OR EXISTS (SELECT 1 FROM up WHERE up.descendant = s.owner AND up.ancestor = r.owner_pat) ELSE regexp_full_match(s.owner, r.owner_pat) END
WHERE CASE r.name_mode WHEN 'exact' THEN s.name = r.name_pat ELSE regexp_full_match(s.name, r.name_pat) END AND (r.descriptor IS NULL OR regexp_full_match(s.descriptor, substr(r.descriptor, 2)))),
scored AS (SELECT method, rule_id, CASE WHEN owner_mode = 'regex' THEN 21 WHEN same THEN 116 ELSE 56 END + CASE name_mode WHEN 'exact' THEN 16 ELSE 2 END + CASE WHEN descriptor IS NULL THEN 0 ELSE 2 END AS score, role, category, severity, owner FROM hit)"""
_BEST = _SCORED + ", b AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, rule_id) AS rn FROM scored)"


def _rule_scores(p: Program) -> DataFrame:
    return rules.scores(p.sites, p.rules, hierarchy.type_closure(p.brands))


@query(_SCORED + " SELECT method, rule_id, score, role, category, severity FROM scored")
def rule_scores(p):
    return _rule_scores(p)


@query(_BEST + " SELECT method, rule_id, score, role, category, severity FROM b WHERE rn = 1")
def rule_best_match(p):
    return rules.best_rule(_rule_scores(p))


@query(_BEST + " SELECT method, CASE WHEN severity = 'HIGH' OR contains(lower(owner), 'runtime') THEN 'HIGH' WHEN category IN ('file', 'lookup') THEN 'CONTROLLED' ELSE 'SAFE' END AS risk FROM b WHERE rn = 1")
def sink_risk(p):
    best = rules.best_rule(_rule_scores(p)).join(p.sites.select("method", "owner"), "method")
    return best.select("method", rules.sink_risk(F.col("category"), F.col("severity"), F.col("owner")).alias("risk"))


@query("""SELECT 'SHADOWED' AS code, rule_id FROM (SELECT rule_id, row_number() OVER (PARTITION BY owner_pat, owner_mode, name_pat, name_mode ORDER BY rule_id) AS rn FROM {rules} UNION ALL SELECT 99, 2) x WHERE rn > 1""")
def rule_lint(p):
    return rules.lint(p.rules.unionByName(p.rules.where("rule_id = 5").withColumn("rule_id", F.lit(99))))


_ENTRY = "CASE (access & 31) WHEN 1 THEN 'readObject' WHEN 2 THEN 'hashCode' WHEN 4 THEN 'compareTo' WHEN 9 THEN 'main' ELSE 'toString' END"


@query(_CLOSURE + f", m AS (SELECT name, owner, access, {_ENTRY} AS kind FROM {{methods}} WHERE owner LIKE 'C%') SELECT m.name, m.kind, CASE WHEN owner IN (SELECT descendant FROM pairs WHERE ancestor = 'R2') THEN 20 ELSE 16 END AS score FROM m WHERE kind IN ('readObject', 'hashCode', 'compareTo') AND (kind <> 'hashCode' OR (access & 2) <> 0)")
def entry_match(p):
    typed = hierarchy.type_closure(p.types).where("ancestor = 'R2'").select(F.col("descendant").alias("owner"), F.lit(4).alias("typed"))
    m = p.methods.where("owner like 'C%'").withColumn("kind", F.expr(_ENTRY)).where("kind in ('readObject', 'hashCode', 'compareTo') and (kind <> 'hashCode' or (access & 2) <> 0)")
    return m.join(typed, "owner", "left").select("name", "kind", (F.lit(16) + F.coalesce("typed", F.lit(0))).alias("score"))


@query("""SELECT host, safe_at, use_at, coalesce(safe_at < use_at, false) AS suppressed FROM (SELECT host, min(CASE WHEN kind = 'STATIC' AND quantity > 25 THEN pos END) AS safe_at, min(CASE WHEN kind = 'DYNAMIC' THEN pos END) AS use_at FROM {calls} GROUP BY host) x WHERE use_at IS NOT NULL""")
def safe_config(p):
    return rules.safe_before_use(p.calls, (F.col("kind") == "STATIC") & (F.col("quantity") > 25), F.col("kind") == "DYNAMIC")


_ACTIONS = "(SELECT * FROM (VALUES ('STATIC', 'arg0', 'return'), ('VIRTUAL', 'this', 'return'), ('VIRTUAL', 'arg0', 'this'), ('INTERFACE', 'this', 'this')) AS t(kind, source, target))"


@query(f"""SELECT DISTINCT c.host, c.pos, a.target FROM {{calls}} c JOIN {_ACTIONS} a ON a.kind = c.kind JOIN {{sources}} s ON s.method = c.host AND (CASE WHEN CAST(substr(s.method, 2) AS INT) % 2 = 0 THEN 'this' ELSE 'arg0' END) = a.source""")
def model_flow_step(p):
    facts = p.sources.select(F.col("method").alias("node"), F.when(F.expr("CAST(substr(method, 2) AS INT)") % 2 == 0, "this").otherwise("arg0").alias("slot"))
    return rules.model_flow(facts, p.calls, p.sql("SELECT * FROM " + _ACTIONS))


# Chains ------------------------------------------------------------------------------------

_TEXT = "t AS (SELECT chain_key, string_agg(coalesce(from_name, '<null>') || '|' || coalesce(to_name, '<null>') || '|' || coalesce(kind, '<null>') || '|' || coalesce(field, '<null>') || '|' || coalesce(descriptor, '<null>') || '|', '' ORDER BY ord) AS hop_text FROM {hops} GROUP BY chain_key)"
_ID = "identity_ AS (SELECT c.chain_key, " + " || ".join(f"coalesce(CAST({c} AS STRING), '<null>') || '|'" for c in chains.KEY) + " || t.hop_text AS identity FROM {chains} c JOIN t ON t.chain_key = c.chain_key)"
_MISSING = "miss AS (SELECT chain_key, CAST(sum(CASE WHEN trim(coalesce(descriptor, '')) = '' THEN 1 ELSE 0 END + CASE WHEN kind = 'FIELD_FLOW' AND field IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM {hops} GROUP BY chain_key)"
_SCORE = """sure AS (SELECT chain_key, sum(CASE WHEN kind IN ('DIRECT_CALL', 'FIELD_FLOW') THEN 1 ELSE 0 END) AS sure FROM {hops} GROUP BY chain_key),
pat AS (SELECT chain_key, count(*) AS n FROM {notes} WHERE note LIKE 'pattern:%' GROUP BY chain_key),
s0 AS (SELECT c.*, CAST(sure.sure + CASE WHEN entry_kind IN ('readObject', 'readResolve', 'readExternal', 'hashCode', 'proxyInvoke') THEN 2 ELSE 1 END + CASE WHEN severity = 'HIGH' THEN 1 ELSE 0 END + 2 * coalesce(pat.n, 0) - 2 * unresolved AS INT) AS score
  FROM {chains} c JOIN sure ON sure.chain_key = c.chain_key LEFT JOIN pat ON pat.chain_key = c.chain_key),
score AS (SELECT *, CASE WHEN score >= 5 THEN 0 WHEN score >= 3 THEN 1 ELSE 2 END AS rank FROM s0)"""
_PRECISION = """prec AS (SELECT chain_key, CASE WHEN bool_or(kind = 'NATIVE_CALLBACK') THEN 2 WHEN bool_or(kind = 'VIRTUAL_DISPATCH') THEN 1 ELSE 0 END AS dispatch,
CASE WHEN bool_or(kind = 'FIELD_FLOW' AND field IS NULL) THEN 2 WHEN bool_or(kind = 'FIELD_FLOW') THEN 1 ELSE 0 END AS flow, CASE WHEN bool_or(starts_with(reason, 'model:')) THEN 1 ELSE 0 END AS proof FROM {hops} GROUP BY chain_key)"""


def _scores(p: Program) -> DataFrame:
    return chains.scores(p.chains, p.hops, p.notes)


@query(f"WITH {_TEXT}, {_ID} SELECT chain_key, identity, substr(sha1(identity), 1, 8) AS short_id FROM identity_")
def chain_key(p):
    return chains.identity(p.chains, p.hops)


@query(f"WITH {_MISSING}, r AS (SELECT c.chain_key, entry_class, sink_class, category, unresolved, missing, n_hops, row_number() OVER (PARTITION BY entry_class, sink_class, category ORDER BY unresolved, missing, n_hops DESC, c.chain_key) AS rn FROM {{chains}} c JOIN miss ON miss.chain_key = c.chain_key) SELECT entry_class, sink_class, category, chain_key, unresolved, missing FROM r WHERE rn = 1")
def chain_merge_preferred(p):
    return chains.preferred(p.chains, p.hops, ["entry_class", "sink_class", "category"]).select("entry_class", "sink_class", "category", "chain_key", "unresolved", "missing")


@query("SELECT chain_key, string_agg(reason, ',' ORDER BY reason) AS reasons FROM (SELECT DISTINCT chain_key, reason FROM {hops}) x GROUP BY chain_key")
def reasons_union(p):
    return chains.reasons(p.hops)


@query(f"WITH {_SCORE} SELECT chain_key, score, rank FROM score")
def evidence_score(p):
    return _scores(p).select("chain_key", "score", "rank")


@query(f"""WITH {_SCORE}, w AS (SELECT chain_key, min(note) AS worst FROM {{notes}} WHERE note LIKE 'degrade:%' GROUP BY chain_key)
SELECT s.chain_key, CASE WHEN NOT (rank < 2 AND 2 * unresolved <= greatest(0, score)) THEN 'NOT_FEASIBLE' WHEN worst IS NOT NULL THEN 'DEGRADED(' || substr(worst, 9) || ')' ELSE 'FEASIBLE' END AS bucket FROM score s LEFT JOIN w ON w.chain_key = s.chain_key""")
def confidence_bucket(p):
    return chains.confidence(_scores(p), p.notes)


@query(f"WITH {_PRECISION} SELECT chain_key, dispatch, flow, proof, dispatch + flow + proof AS precision FROM prec")
def precision_dims(p):
    return chains.precision(p.hops)


@query(f"""WITH {_SCORE}, {_PRECISION}, j AS (SELECT s.category, s.chain_key, s.sink_role, s.unresolved, s.n_hops, s.score, dispatch + flow + proof AS precision, CAST(s.rule_id % 3 AS INT) AS pp FROM score s JOIN prec ON prec.chain_key = s.chain_key)
SELECT category, chain_key, CAST(row_number() OVER (PARTITION BY category ORDER BY CASE WHEN sink_role = 'TERMINAL' THEN 0 ELSE 1 END, unresolved, pp, CASE WHEN pp IN (0, 2) THEN precision ELSE -score END, CASE WHEN pp IN (0, 2) THEN n_hops ELSE precision END, CASE WHEN pp IN (0, 2) THEN -score ELSE n_hops END, chain_key) AS INT) AS position FROM j""")
def ranking_order(p):
    return chains.ranked(p.chains, _scores(p), chains.precision(p.hops), (F.col("rule_id") % 3).cast("int"))


@query("SELECT chain_key, size FROM (SELECT chain_key, count(*) AS size, sum(CASE WHEN kind IN ('VIRTUAL_DISPATCH', 'FIELD_FLOW', 'NATIVE_CALLBACK') THEN 1 ELSE 0 END) AS d FROM {hops} GROUP BY chain_key) x WHERE d <= 1")
def dynamic_hop_limit(p):
    dynamic = F.sum(F.when(F.col("kind").isin(*calibrate.DYNAMIC), 1).otherwise(0))
    return p.hops.groupBy("chain_key").agg(F.count(F.lit(1)).alias("size"), dynamic.alias("d")).where("d <= 1").select("chain_key", "size")


# Calibration -------------------------------------------------------------------------------

_TRIGGER = "trig AS (SELECT c.chain_key, 'no-trigger' AS reason FROM {chains} c WHERE entry_kind IN ('hashCode', 'equals', 'compareTo', 'compare', 'toString') AND entry_class NOT IN (SELECT DISTINCT m.owner FROM {fields} f JOIN {methods} m ON m.name = f.reader WHERE CAST(substr(f.reader, 2) AS INT) % 4 = 0))"
_DUP = f"{_SCORE}, dup AS (SELECT chain_key, 'mechanism-duplicate' AS reason FROM (SELECT chain_key, row_number() OVER (PARTITION BY entry_class, category, call_kind ORDER BY unresolved, n_hops, score DESC, chain_key) AS rn FROM score) x WHERE rn > 1)"
_DEEP = "deep AS (SELECT c.chain_key, 'deep-incoherent' AS reason FROM {chains} c JOIN (SELECT chain_key, sum(CASE WHEN kind = 'FIELD_FLOW' THEN 1 ELSE 0 END) AS f FROM {hops} GROUP BY chain_key) h ON h.chain_key = c.chain_key WHERE n_hops > 1 AND f * 6 < n_hops)"


def _trigger(p: Program) -> DataFrame:
    readers = p.fields.where("CAST(substr(reader, 2) AS INT) % 4 = 0").select(F.col("reader").alias("name")).distinct()
    return calibrate.without_trigger(p.chains, p.methods.join(readers, "name", "left_semi").select("owner"))


@query(f"WITH {_TRIGGER} SELECT chain_key, reason FROM trig")
def prune_no_trigger(p):
    return _trigger(p)


@query(f"WITH {_DEEP} SELECT chain_key, reason FROM deep")
def prune_deep(p):
    return calibrate.deep(p.chains, p.hops, 1)


@query(f"WITH {_DUP} SELECT chain_key, reason FROM dup")
def prune_mechanism_dup(p):
    return calibrate.same_mechanism(p.chains, _scores(p), ["entry_class", "category", "call_kind"])


@query(f"WITH {_TRIGGER}, {_DEEP}, {_DUP} SELECT c.chain_key, coalesce(t.reason, d.reason, u.reason) AS reason FROM {{chains}} c LEFT JOIN trig t ON t.chain_key = c.chain_key LEFT JOIN deep d ON d.chain_key = c.chain_key LEFT JOIN dup u ON u.chain_key = c.chain_key")
def calibrate_cascade(p):
    return calibrate.cascade(p.chains, [_trigger(p), calibrate.deep(p.chains, p.hops, 1), calibrate.same_mechanism(p.chains, _scores(p), ["entry_class", "category", "call_kind"])])


@query("""SELECT chain_key, min(ord) AS ord FROM {hops} WHERE NOT (kind = 'DIRECT_CALL' OR (kind = 'VIRTUAL_DISPATCH' AND substr(to_name, 1, 1) = 'P') OR (kind = 'FIELD_FLOW' AND substr(to_name, 1, 1) = 'O')) GROUP BY chain_key""")
def typeflow_reject(p):
    k, to = F.col("kind"), F.col("to_kind")
    return calibrate.broken_type_flow(p.hops, F.substring("to_name", 1, 1), (k == "DIRECT_CALL") | ((k == "VIRTUAL_DISPATCH") & (to == "P")) | ((k == "FIELD_FLOW") & (to == "O")))


_REQUIRED = "(SELECT * FROM (VALUES (1, 'O1'), (1, 'P1'), (2, 'O1'), (2, 'P'), (3, 'O2'), (3, 'P2'), (3, 'O3')) AS t(pattern, prefix))"


@query(f"""WITH e AS (SELECT chain_key, from_name AS element FROM {{hops}} UNION SELECT chain_key, to_name FROM {{hops}}), r AS (SELECT * FROM {_REQUIRED} x), n AS (SELECT pattern, count(DISTINCT prefix) AS need FROM r GROUP BY pattern),
g AS (SELECT e.chain_key, r.pattern, count(DISTINCT r.prefix) AS got FROM e JOIN r ON starts_with(e.element, r.prefix) GROUP BY ALL) SELECT chain_key, min(g.pattern) AS pattern FROM g JOIN n ON n.pattern = g.pattern AND n.need = g.got GROUP BY chain_key""")
def pattern_match(p):
    elements = p.hops.select("chain_key", F.col("from_name").alias("element")).union(p.hops.select("chain_key", "to_name"))
    return calibrate.patterns(elements, p.sql("SELECT * FROM " + _REQUIRED))


_VERDICT = "(SELECT s.method AS sink, count(c.chain_key) AS found, coalesce(sum(c.unresolved), 0) AS unresolved, CAST(substr(s.method, 2) AS INT) AS n FROM {sinks} s LEFT JOIN {chains} c ON c.sink_method = s.method AND c.severity <> 'LOW' GROUP BY s.method)"


@query(f"SELECT sink, found, CASE WHEN found > 0 THEN 'CHAIN' WHEN n % 7 = 0 THEN 'TRUNCATED' WHEN n % 5 = 0 THEN 'TOO_LONG' WHEN unresolved > 0 THEN 'UNRESOLVED' ELSE 'NO_PATH' END AS verdict FROM {_VERDICT} x")
def backward_verdicts(p):
    x = p.sql("SELECT * FROM " + _VERDICT)
    return x.select("sink", "found", calibrate.verdict(F.col("found"), F.col("n") % 7 == 0, F.col("n") % 5 == 0, F.col("unresolved")).alias("verdict"))


@query("""WITH s AS (SELECT method AS sink, CAST(substr(method, 2) AS INT) % 4 AS depth FROM {sinks}), r AS (SELECT sink, row_number() OVER (ORDER BY depth, sink) - 1 AS place, count(*) OVER () AS n FROM s),
f AS (SELECT *, least(2048, 3000000 // n) AS first FROM r), x AS (SELECT *, 3000000 - first * n AS extra FROM f) SELECT sink, CAST(least(200000, first + extra // n + CASE WHEN place < extra % n THEN 1 ELSE 0 END) AS BIGINT) AS budget FROM x""")
def fair_budget(p):
    return calibrate.fair_budget(p.sinks.select(F.col("method").alias("sink"), (F.expr("CAST(substr(method, 2) AS INT)") % 4).alias("depth")), 3_000_000)


# Composition -------------------------------------------------------------------------------

_REGION = "(SELECT chain_key, category, entry_kind, n_hops, unresolved, CAST(substr(sink_method, 2) AS INT) AS sink_region, CAST(substr(entry_class, 2) AS INT) AS entry_region FROM {chains})"
_KIND = "CASE WHEN f.category = 'reflection' THEN 'INVOKE' WHEN b.entry_kind IN ('hashCode', 'compareTo', 'toString') THEN 'TRIGGER' WHEN f.category = 'template' THEN 'TEMPLATE' WHEN b.entry_kind = 'readObject' THEN 'DESER' WHEN f.category = 'lookup' THEN 'JNDI_RMI' WHEN f.category = 'file' THEN 'JDBC_XML' END"


@query(f"""WITH x AS MATERIALIZED (SELECT * FROM {_REGION} y), m AS (SELECT f.chain_key AS front, b.chain_key AS back, {_KIND} AS bridge, f.n_hops + b.n_hops AS n_hops, f.unresolved + b.unresolved AS unresolved FROM x f JOIN x b ON f.sink_region = b.entry_region AND f.chain_key <> b.chain_key),
r AS (SELECT *, row_number() OVER (PARTITION BY front ORDER BY n_hops, back) AS rn FROM m WHERE bridge IS NOT NULL AND n_hops <= 64) SELECT front, back, 'bridge-' || lower(bridge) AS reason, n_hops, unresolved FROM r WHERE rn <= 2""")
def compose_bridge(p):
    x = p.sql("SELECT * FROM " + _REGION)
    return compose.bridged(x.withColumnRenamed("sink_region", "region"), x.withColumnRenamed("entry_region", "region"))


@query("""WITH a AS (SELECT chain_key AS front, from_name AS spot FROM {hops} WHERE ord = 0), b AS (SELECT chain_key AS back, to_name AS spot, ord AS cut FROM {hops} WHERE ord >= 1),
r AS (SELECT front, back, a.spot, cut, row_number() OVER (PARTITION BY front ORDER BY cut, back) AS rn FROM a JOIN b ON a.spot = b.spot WHERE front <> back) SELECT front, back, spot, cut FROM r WHERE rn <= 2""")
def compose_overlap(p):
    return compose.overlaps(p.hops)


_ANCHORS = "(SELECT * FROM (VALUES ('f1', 'S1'), ('f1', 'S2'), ('f2', 'S3'), ('f2', 'X9'), ('f3', 'N1'), ('f3', 'R1'), ('f3', 'C5'), ('f4', 'X1')) AS t(fragment, anchor))"


@query(f"SELECT a.fragment, count(DISTINCT a.anchor) AS need, count(DISTINCT t.name) AS got, count(DISTINCT a.anchor) = count(DISTINCT t.name) AS active FROM {_ANCHORS} a LEFT JOIN {{types}} t ON t.name = a.anchor GROUP BY a.fragment")
def fragment_division(p):
    return compose.fragments(p.sql("SELECT * FROM " + _ANCHORS), p.types)


@query("""WITH h AS (SELECT DISTINCT m.owner AS held, n.name AS root FROM {methods} m JOIN {types} t ON t.name = m.owner JOIN {types} n ON n.super = t.super AND n.kind = 'S'),
r AS (SELECT c.chain_key, h.root, row_number() OVER (PARTITION BY c.chain_key ORDER BY h.root) AS rn FROM {chains} c JOIN h ON h.held = c.entry_class) SELECT chain_key, root FROM r WHERE rn <= 3""")
def reroot(p):
    held = p.types.select(F.col("name").alias("held"), F.col("super").alias("region")).join(p.methods.select(F.col("owner").alias("held")), "held", "left_semi")
    return compose.reroot(p.chains, held, p.types.where("kind = 'S'").select(F.col("super").alias("region"), F.col("name").alias("root")), 3)


# Reports -----------------------------------------------------------------------------------


@query("""SELECT chain_key, CASE WHEN entry_kind = 'main' THEN 'ENTRY_NOT_CONTROLLED' WHEN entry_class < 'C1' THEN 'ENTRY_NOT_APPLICATION' WHEN sink_role <> 'TERMINAL' THEN 'TERMINAL_INTERMEDIATE' WHEN sink_class >= 'S9' THEN 'TERMINAL_NOT_REVERSE' WHEN unresolved > 1 THEN 'NOT_IN_DEMAND' ELSE 'ADMITTED' END AS decision FROM {chains}""")
def candidate_admission(p):
    c = F.col
    checks = [(c("entry_kind") != "main", "ENTRY_NOT_CONTROLLED"), (c("entry_class") >= "C1", "ENTRY_NOT_APPLICATION"), (c("sink_role") == "TERMINAL", "TERMINAL_INTERMEDIATE"), (c("sink_class") < "S9", "TERMINAL_NOT_REVERSE"), (c("unresolved") <= 1, "NOT_IN_DEMAND")]
    return p.chains.select("chain_key", report.gates(checks, "ADMITTED").alias("decision"))


@query("""SELECT c.chain_key, CASE WHEN s.method IS NULL THEN 'NO_ENTRY' WHEN m.access IS NULL OR (m.access & 1) = 0 THEN 'NO_SITE' WHEN k.method IS NULL THEN 'NO_TERMINAL' ELSE 'JOINED' END AS decision FROM {chains} c
LEFT JOIN (SELECT DISTINCT method FROM {sources} WHERE CAST(substr(method, 2) AS INT) % 3 <> 0) s ON s.method = c.entry_method LEFT JOIN {methods} m ON m.name = c.last LEFT JOIN (SELECT method FROM {sinks} WHERE CAST(substr(method, 2) AS INT) % 4 <> 1) k ON k.method = c.sink_method""")
def join_gates(p):
    n = F.expr("CAST(substr(method, 2) AS INT)")
    entry = p.sources.where(n % 3 != 0).select(F.col("method").alias("entry_method"), F.lit(True).alias("e"))
    site = p.methods.select(F.col("name").alias("last"), "access")
    terminal = p.sinks.where(n % 4 != 1).select(F.col("method").alias("sink_method"), F.lit(True).alias("t"))
    met = p.chains.join(entry, "entry_method", "left").join(site, "last", "left").join(terminal, "sink_method", "left")
    return met.select("chain_key", report.gates([(F.col("e"), "NO_ENTRY"), (hierarchy.has(F.col("access"), 1), "NO_SITE"), (F.col("t"), "NO_TERMINAL")], "JOINED").alias("decision"))


@query("""SELECT chain_key, CASE WHEN entry_kind IS NULL THEN 'NO_ENTRY' WHEN entry_kind = 'main' THEN 'ENTRY_NOT_EXTERNAL' WHEN rule_id = 5 THEN 'UNSAT' WHEN unresolved = 2 THEN 'NOT_SAT' WHEN n_hops = 3 THEN 'PROGRESS' WHEN unresolved = 1 THEN 'NOT_COMPLETE' WHEN sink_risk = 'SAFE' THEN 'RISK_NONE' ELSE 'ELIGIBLE' END AS eligibility FROM {chains}""")
def eligibility(p):
    c = F.col
    checks = [(c("entry_kind").isNotNull(), "NO_ENTRY"), (c("entry_kind") != "main", "ENTRY_NOT_EXTERNAL"), (c("rule_id") != 5, "UNSAT"), (c("unresolved") != 2, "NOT_SAT"), (c("n_hops") != 3, "PROGRESS"), (c("unresolved") != 1, "NOT_COMPLETE"), (c("sink_risk") != "SAFE", "RISK_NONE")]
    return p.chains.select("chain_key", report.gates(checks, "ELIGIBLE").alias("eligibility"))


@query("""SELECT chain_key, ord, concat_ws(',', CASE WHEN trim(coalesce(descriptor, '')) = '' THEN 'BLANK_DESCRIPTOR' END, CASE WHEN kind = 'FIELD_FLOW' AND field IS NULL THEN 'FIELD_UNKNOWN' END, CASE WHEN kind = 'NATIVE_CALLBACK' THEN 'NATIVE' END, CASE WHEN starts_with(reason, 'model:') THEN 'MODELLED' END) AS issues FROM {hops}""")
def hop_audit(p):
    return report.audit(p.hops)


@query("""SELECT coalesce(o.chain_key, n.chain_key) AS chain_key, CASE WHEN o.chain_key IS NULL THEN 'ADDED' WHEN n.chain_key IS NULL THEN 'REMOVED' WHEN o.fingerprint <> n.fingerprint THEN 'CHANGED' ELSE 'UNCHANGED' END AS change FROM {run_old} o FULL JOIN {run_new} n ON o.chain_key = n.chain_key""")
def diff_runs(p):
    return report.diff(p.run_old, p.run_new)


@query("""SELECT coalesce(o.chain_key, n.chain_key) AS chain_key, CASE WHEN n.chain_key IS NULL THEN 'REMOVED' WHEN x.chain_key IS NOT NULL THEN CASE WHEN o.chain_key IS NOT NULL THEN 'SUPPRESSED_KNOWN' ELSE 'SUPPRESSED_NEW' END WHEN o.chain_key IS NOT NULL THEN 'UNCHANGED' ELSE 'NEW' END AS status
FROM {run_old} o FULL JOIN {run_new} n ON o.chain_key = n.chain_key LEFT JOIN (SELECT chain_key FROM {chains} WHERE rule_id IN (3, 6)) x ON x.chain_key = coalesce(o.chain_key, n.chain_key)""")
def baseline_status(p):
    return report.baseline(p.run_old, p.run_new, p.chains.where("rule_id in (3, 6)"))


@query("SELECT phase, CAST(quantile_disc(wall_ms, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(wall_ms, 0.95) AS BIGINT) AS p95, count(*) AS n, quantile_disc(wall_ms, 0.5) <= 20 AND quantile_disc(wall_ms, 0.95) <= 90 AS passed FROM {samples} GROUP BY phase")
def nearest_rank_gate(p):
    return report.percentiles(p.samples, "phase", "wall_ms", (20, 90))


@query("SELECT category, CASE WHEN count(*) = 0 THEN 'UNKNOWN' WHEN sum(unresolved) > 0 OR count(*) > 400 THEN 'PARTIAL' ELSE 'COMPLETE' END AS outcome, count(*) AS chains FROM {chains} GROUP BY category")
def outcome_class(p):
    n = F.count(F.lit(1))
    return p.chains.groupBy("category").agg(report.outcome(n, F.sum("unresolved"), n > 400).alias("outcome"), n.alias("chains"))


@query("SELECT DISTINCT code FROM (SELECT 'UNRESOLVED_HOPS' AS code FROM {chains} WHERE unresolved > 0 UNION ALL SELECT 'NATIVE_CALLBACK' FROM {hops} WHERE kind = 'NATIVE_CALLBACK' UNION ALL SELECT upper(replace(substr(note, 9), '-', '_')) FROM {notes} WHERE note LIKE 'degrade:%') x")
def completeness_reasons(p):
    a = p.chains.where("unresolved > 0").select(F.lit("UNRESOLVED_HOPS").alias("code"))
    b = p.hops.where("kind = 'NATIVE_CALLBACK'").select(F.lit("NATIVE_CALLBACK"))
    c = p.notes.where("note like 'degrade:%'").select(F.upper(F.regexp_replace(F.expr("substring(note, 9)"), "-", "_")))
    return a.union(b).union(c).distinct()


@query("SELECT sha, min(owner) AS owner, count(DISTINCT owner) - 1 AS losers FROM {members} WHERE sha IS NOT NULL GROUP BY sha HAVING count(DISTINCT owner) > 1")
def duplicate_owner(p):
    return report.duplicate_owners(p.members)


@query("""WITH b AS (SELECT owner, substr(sha, 1, 2) AS bucket, count(*) AS n, count(DISTINCT sha) AS d, sum(CAST(('0x' || substr(sha, 3, 12)) AS HUGEINT)) AS s FROM {members} GROUP BY ALL)
SELECT owner, CAST(sum(n) AS BIGINT) AS classes, CAST(sum(d) AS BIGINT) AS distinct_classes, sha256(string_agg(bucket || ':' || n || ':' || s, ',' ORDER BY bucket || ':' || n || ':' || s)) AS digest FROM b GROUP BY owner""")
def digest_inventory(p):
    return report.inventory(p.members)


@query("SELECT category, severity, count(*) AS n, CAST(grouping(category) + grouping(severity) AS INT) AS level FROM {chains} GROUP BY ROLLUP (category, severity)")
def finding_rollup(p):
    return p.chains.rollup("category", "severity").agg(F.count(F.lit(1)).alias("n"), (F.grouping("category") + F.grouping("severity")).cast("int").alias("level"))


@query("SELECT kind, count(*) AS calls, count(DISTINCT host) AS hosts, count(DISTINCT callee) AS callees, CAST(sum(quantity) AS BIGINT) AS quantity FROM {calls} GROUP BY kind")
def scan_statistics(p):
    return p.calls.groupBy("kind").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("host").alias("hosts"), F.countDistinct("callee").alias("callees"), F.sum("quantity").cast("long").alias("quantity"))


@query("SELECT id, digest, packages FROM (SELECT page_id AS id, sha256(html) AS digest, len(regexp_extract_all(html, 'L?[a-z]+/[a-z]+')) AS packages FROM {pages}) x")
def text_digests(p):
    return p.pages.select(F.col("page_id").alias("id"), F.sha2("html", 256).alias("digest"), F.size(F.regexp_extract_all("html", F.lit("L?[a-z]+/[a-z]+"), F.lit(0))).cast("long").alias("packages"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM {events}")
def json_scalars(p):
    return p.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT entry_method, count(*) AS n, string_agg(sink_method, ',' ORDER BY position) AS sinks FROM (SELECT entry_method, sink_method, chain_key, row_number() OVER (PARTITION BY entry_method ORDER BY n_hops, unresolved, chain_key) AS position FROM {chains}) x WHERE position <= 4 GROUP BY entry_method")
def top_sinks_per_entry(p):
    order = Window.partitionBy("entry_method").orderBy("n_hops", "unresolved", "chain_key")
    top = p.chains.withColumn("position", F.row_number().over(order)).where("position <= 4")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "sink_method"))), lambda x: x["sink_method"])
    return top.groupBy("entry_method").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", listed).alias("sinks"))


# Streams and sources -----------------------------------------------------------------------


@query("""SELECT date_trunc('hour', ts) AS start, event_type AS phase, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS wall_ms, max(value) AS worst FROM {events} GROUP BY ALL""")
def windowed_samples(p):
    return samples.windowed(p.events)


_KEYED = "(SELECT m.name, m.owner, m.access, CASE WHEN (m.access & 16) <> 0 THEN 'final' WHEN (m.access & 8) <> 0 THEN 'static' ELSE 'plain' END AS shape FROM {methods} m)"


@query(f"SELECT shape, count(*) AS n, min(name) AS first, max(owner) AS last FROM {_KEYED} x GROUP BY shape")
def method_shapes(p):
    return p.sql("SELECT * FROM " + _KEYED).groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"), F.max("owner").alias("last"))


@query("SELECT sha256(concat_ws(chr(10), r_name, CAST(r_regionkey AS STRING), '<null>')) AS identity, r_regionkey FROM {region}")
def scan_identity(p):
    return p.region.select(catalogue.scan_identity(F.col("r_name"), F.col("r_regionkey"), F.lit(None)).alias("identity"), "r_regionkey")


@query("""SELECT c.host, CAST(floor(count(DISTINCT c.callee) / 2.0) AS BIGINT) AS half, bool_or(c.kind = 'DYNAMIC') AS dynamic, bool_and(c.quantity > 5) AS bulky FROM {calls} c GROUP BY c.host""")
def host_summaries(p):
    return p.calls.groupBy("host").agg(F.floor(F.countDistinct("callee") / 2).alias("half"), F.bool_or(F.col("kind") == "DYNAMIC").alias("dynamic"), F.bool_and(F.col("quantity") > 5).alias("bulky"))


@query("SELECT DISTINCT c.callee AS method FROM {calls} c WHERE NOT EXISTS (SELECT 1 FROM {calls} d WHERE d.callee = c.callee AND d.kind = 'STATIC' AND d.quantity < 4)")
def never_static(p):
    return p.calls.select(F.col("callee").alias("method")).distinct().join(p.calls.where("kind = 'STATIC' and quantity < 4").select(F.col("callee").alias("method")), "method", "left_anti")


@query("SELECT chain_key FROM {run_old} EXCEPT ALL SELECT chain_key FROM {run_new}")
def removed_chains(p):
    return p.run_old.select("chain_key").exceptAll(p.run_new.select("chain_key"))


@query("""SELECT m.name AS method, coalesce(k.n, 0) AS callers, coalesce(k.first_caller, '<null>') AS first_caller FROM {methods} m LEFT JOIN (SELECT dst, count(*) AS n, min(src) AS first_caller FROM {edges} WHERE type = 'INVOKES' GROUP BY dst) k ON k.dst = m.name""")
def canonical_callers(p):
    callers = p.edges.where("type = 'INVOKES'").groupBy(F.col("dst").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("first_caller"))
    return p.methods.join(callers, "name", "left").select(F.col("name").alias("method"), F.coalesce("n", F.lit(0)).alias("callers"), F.coalesce("first_caller", F.lit("<null>")).alias("first_caller"))


@query("""WITH p1 AS (SELECT chain_key, string_agg(from_name, '>' ORDER BY ord DESC) || '>' || max(CASE WHEN ord = 0 THEN to_name END) AS trace FROM {hops} GROUP BY chain_key) SELECT chain_key, trace, len(string_split(trace, '>')) AS n FROM p1""")
def application_trace(p):
    listed = F.array_sort(F.collect_list(F.struct((-F.col("ord")).alias("o"), "from_name")))
    out = p.hops.groupBy("chain_key").agg(F.concat_ws(">", F.concat(F.transform(listed, lambda x: x["from_name"]), F.array(F.max(F.when(F.col("ord") == 0, F.col("to_name")))))).alias("trace"))
    return out.withColumn("n", F.size(F.split("trace", ">")).cast("long"))


@query("""SELECT chain_key, hop, unbroken FROM (SELECT chain_key, ord AS hop, coalesce(to_name = lag(from_name) OVER (PARTITION BY chain_key ORDER BY ord), true) AS unbroken FROM {hops}) x""")
def hop_connectivity(p):
    w = Window.partitionBy("chain_key").orderBy("ord")
    return p.hops.select("chain_key", F.col("ord").alias("hop"), F.coalesce(F.col("to_name") == F.lag("from_name").over(w), F.lit(True)).alias("unbroken"))


@query("""SELECT sink_method, CAST(count(*) AS BIGINT) AS chains, CAST(sum(unresolved) AS BIGINT) AS unresolved, max(n_hops) AS longest, string_agg(DISTINCT severity, ',' ORDER BY severity) AS severities FROM {chains} GROUP BY sink_method""")
def sink_outcomes(p):
    return p.chains.groupBy("sink_method").agg(F.count(F.lit(1)).alias("chains"), F.sum("unresolved").cast("long").alias("unresolved"), F.max("n_hops").alias("longest"), F.concat_ws(",", F.array_sort(F.collect_set("severity"))).alias("severities"))


_DESC = "(SELECT call_id, CASE quantity % 5 WHEN 0 THEN '(IJLjava/lang/String;)V' WHEN 1 THEN '()Ljava/util/List;' WHEN 2 THEN '([[D[Lcom/acme/Box;Z)I' WHEN 3 THEN '(DJ)J' ELSE '(Lorg/x/Y;)[B' END AS descriptor, CASE line WHEN 1 THEN 'com.acme.app.Main' WHEN 2 THEN 'Lorg/x/y/z/Deep;' WHEN 3 THEN 'Plain' ELSE 'java/util/Map' END AS type_name FROM {calls})"


@query(f"""SELECT call_id, array_to_string(regexp_extract_all(regexp_extract(descriptor, '^\\(([^)]*)\\)', 1), '\\[*(?:[BCDFIJSZ]|L[^;]+;)'), ',') AS kinds, regexp_extract(descriptor, '\\)(.+)$', 1) AS result,
CAST(len(regexp_extract_all(regexp_extract(descriptor, '^\\(([^)]*)\\)', 1), '\\[*(?:[BCDFIJSZ]|L[^;]+;)')) + len(list_filter(regexp_extract_all(regexp_extract(descriptor, '^\\(([^)]*)\\)', 1), '\\[*(?:[BCDFIJSZ]|L[^;]+;)'), lambda t: t IN ('J', 'D'))) AS INT) AS slots FROM {_DESC} x""")
def descriptor_parse(p):
    d = F.col("descriptor")
    return p.sql("SELECT * FROM " + _DESC).select("call_id", F.concat_ws(",", names.parameter_types(d)).alias("kinds"), names.return_type(d).alias("result"), names.slots(d).alias("slots"))


@query(f"""WITH t AS (SELECT call_id, replace(regexp_replace(type_name, '^L(.*);$', '\\1'), '.', '/') AS id FROM {_DESC} x) SELECT call_id, id, regexp_extract(id, '^(.*)/[^/]*$', 1) AS package, array_to_string(string_split(regexp_extract(id, '^(.*)/[^/]*$', 1), '/')[1:3], '/') AS prefix FROM t""")
def type_names(p):
    t = p.sql("SELECT * FROM " + _DESC).withColumn("id", names.type_id(F.col("type_name")))
    return t.select("call_id", "id", names.package_of(F.col("id")).alias("package"), names.package_prefix(F.col("id"), 3).alias("prefix"))


@query("SELECT 'x' || p_partkey AS id, substr(sha1(p_name || '|' || p_brand), 1, 8) AS short_id FROM {part}")
def short_ids(p):
    return p.part.select(F.concat(F.lit("x"), F.col("p_partkey")).alias("id"), names.short_id(F.concat_ws("|", "p_name", "p_brand")).alias("short_id"))

from . import program_queries  # noqa: E402, F401  registers its queries here
from . import typed_queries  # noqa: E402, F401
from . import flow_queries  # noqa: E402, F401
from . import object_queries  # noqa: E402, F401
from . import compose_queries  # noqa: E402, F401
from . import string_queries  # noqa: E402, F401
from . import constant_queries  # noqa: E402, F401
from . import generic_queries  # noqa: E402, F401
