"""Registered queries over typed facts, relations of arrays and containers, scopes and resources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forward, hierarchy, rules, typed
from ..sources import programs
from .program_queries import _UP
from .queries import query

_CHECKS = "(SELECT l_orderkey AS id, l_linenumber AS line, l_returnflag = 'A' AS dead, CASE WHEN l_quantity > 40 THEN l_linestatus = 'F' END AS bound, l_linestatus = 'O' AS done FROM {lineitem})"
_DECIDED = f"(SELECT id, line, CASE WHEN dead THEN 'PROVABLY_UNREACHABLE' WHEN coalesce(bound, false) THEN 'BUDGET_EXCEEDED' WHEN done THEN 'PROVEN_RETAINED' ELSE 'UNKNOWN' END AS decision FROM {_CHECKS} c)"


def _decided(p):
    return p.sql("SELECT * FROM " + _CHECKS).select("id", "line", typed.decision(F.col("dead"), F.col("bound"), F.col("done")).alias("decision"))


@query(f"SELECT decision, count(*) AS n FROM {_DECIDED} d GROUP BY decision")
def filter_decisions(p):
    return _decided(p).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT o_orderkey AS id, o_custkey AS customer FROM {{orders}} WHERE o_orderkey NOT IN (SELECT id FROM {_DECIDED} d WHERE decision = 'PROVABLY_UNREACHABLE')")
def constraint_gate(p):
    return typed.passing(p.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer")), _decided(p), "id")


_GIVES = "(SELECT host AS method, quantity % 7 AS identity, call_id AS call, supplier AS artifact FROM {calls} WHERE kind = 'STATIC')"
_TAKES = "(SELECT host AS method, quantity % 7 AS identity, call_id AS call, supplier AS artifact FROM {calls} WHERE kind = 'VIRTUAL')"


@query(f"SELECT DISTINCT g.call AS producer, t.call AS consumer FROM {_GIVES} g JOIN {_TAKES} t ON t.method = g.method AND t.identity = g.identity")
def value_meetings(p):
    return typed.meetings(p.sql("SELECT * FROM " + _GIVES), p.sql("SELECT * FROM " + _TAKES))


_FROM = "(SELECT c_custkey AS call, c_custkey % 211 AS identity, c_nationkey % 2 AS artifact FROM {customer})"
_TO = "(SELECT s_suppkey AS call, s_suppkey * 3 % 260 AS identity, s_nationkey % 2 AS artifact FROM {supplier})"


@query(f"""SELECT consumer, producer, CASE WHEN n = 0 THEN 'UNKNOWN' WHEN n = 1 AND same = 1 THEN 'PROVED' ELSE 'PARTIAL' END AS status FROM (SELECT t.call AS consumer, min(f.call) AS producer, count(DISTINCT f.call) AS n, min(CASE WHEN f.artifact = t.artifact THEN 1 ELSE 0 END) AS same
FROM {_TO} t LEFT JOIN {_FROM} f ON f.identity = t.identity GROUP BY t.call) x""")
def typed_bridges(p):
    return typed.bridges(p.sql("SELECT * FROM " + _FROM), p.sql("SELECT * FROM " + _TO))


_REFS = "(SELECT c_custkey AS reference, c_custkey % 97 AS identity, CASE WHEN c_custkey % 3 = 0 THEN 'x' || CAST(c_custkey % 31 AS STRING) END AS name FROM {customer})"
_LOADS = "(SELECT s_suppkey AS load, s_suppkey * 5 % 120 AS identity, 'x' || CAST(s_suppkey % 40 AS STRING) AS name FROM {supplier})"


@query(f"SELECT reference, load, max(status) AS status FROM (SELECT r.reference, l.load, 'PROVED' AS status FROM {_REFS} r JOIN {_LOADS} l ON l.identity = r.identity UNION ALL SELECT r.reference, l.load, 'PARTIAL' FROM {_REFS} r JOIN {_LOADS} l ON l.name = r.name) x GROUP BY reference, load")
def factory_constraints(p):
    return typed.factory_constraints(p.sql("SELECT * FROM " + _REFS), p.sql("SELECT * FROM " + _LOADS))


_ADDRESSES = "(SELECT o_custkey AS reference, CASE WHEN o_orderkey % 2 = 0 THEN 'url' ELSE 'type' END AS kind, o_orderkey % 150 AS identity FROM {orders})"


@query(f"""SELECT DISTINCT a.reference, s.s_suppkey AS creation FROM (SELECT reference, max(CASE WHEN kind = 'url' THEN identity END) AS url FROM {_ADDRESSES} a GROUP BY reference HAVING count(*) = 2 AND count(*) FILTER (kind = 'url') = 1) a
JOIN {{supplier}} s ON s.s_suppkey % 150 = a.url WHERE a.reference % 4 <> 0""")
def remote_proxies(p):
    references = p.customer.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("reference"))
    return typed.remote_proxies(references, p.sql("SELECT * FROM " + _ADDRESSES), p.supplier.select(F.col("s_suppkey").alias("creation"), (F.col("s_suppkey") % 150).alias("identity")))


@query("""SELECT call, type || '#' || method AS target FROM (SELECT n.n_nationkey AS call, s.s_name AS type, 'm' || CAST(s.s_suppkey % 2 AS STRING) AS method, row_number() OVER (PARTITION BY n.n_nationkey ORDER BY s.s_name) AS at_
FROM {nation} n JOIN {supplier} s ON s.s_nationkey % 5 = n.n_regionkey WHERE s.s_suppkey % 2 = n.n_nationkey % 2) x WHERE at_ <= 3""")
def callback_targets(p):
    method = lambda c: F.format_string("m%d", (F.col(c) % 2).cast("int")).alias("method")
    calls = p.nation.select(F.col("n_nationkey").alias("call"), F.col("n_regionkey").alias("callback"), method("n_nationkey"))
    types = p.supplier.select((F.col("s_nationkey") % 5).alias("callback"), F.col("s_name").alias("type"))
    return typed.callback_targets(calls, types, p.supplier.select(F.col("s_name").alias("type"), method("s_suppkey")), 3)


@query("""SELECT o.o_orderkey AS call, m.handler FROM {orders} o JOIN (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 300 ELSE c_custkey END AS identity, min(c_nationkey) AS handler FROM {customer} GROUP BY 1 HAVING count(DISTINCT c_nationkey) = 1) m ON m.identity = o.o_custkey WHERE m.handler % 3 <> 0""")
def invoke_handlers(p):
    calls = p.orders.select(F.col("o_orderkey").alias("call"), F.col("o_custkey").alias("identity"))
    key = F.col("c_custkey")
    made = p.customer.select(F.when(key % 3 == 0, key % 300).otherwise(key).alias("identity"), F.col("c_nationkey").alias("handler"))
    return typed.invoke_handlers(calls, made, p.nation.where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("name")))


@query(f"""WITH {_UP}, e AS (SELECT name AS owner, name AS candidate, 0 AS depth FROM {{types}} WHERE kind IN ('N', 'R') UNION ALL SELECT ancestor, descendant, depth FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY depth, candidate) AS rn, count(*) OVER (PARTITION BY owner) AS n FROM e) SELECT owner, candidate, n <= 60 AS complete FROM r WHERE rn <= 60""")
def raw_candidates(p):
    return typed.raw_candidates(p.types.where("kind in ('N', 'R')").select(F.col("name").alias("owner")), hierarchy.type_closure(p.types), 60)


@query("""SELECT DISTINCT c.host AS src, coalesce(s.super, c.supplier) || '#' || c.callee AS dst, 'INVOKES' AS type FROM {calls} c LEFT JOIN (SELECT name, super FROM {types} WHERE kind = 'S' AND CAST(substr(name, 2) AS INT) % 3 = 0) s ON s.name = c.supplier AND CAST(substr(c.callee, 2) AS INT) % 2 = 0 WHERE c.kind = 'STATIC'""")
def declared_targets(p):
    calls = p.calls.where("kind = 'STATIC'").select("host", F.col("supplier").alias("owner"), F.col("callee").alias("name"))
    resolved = calls.select("owner", "name").distinct().where("CAST(substr(owner, 2) AS INT) % 3 = 0 AND CAST(substr(name, 2) AS INT) % 2 = 0").join(p.types.select(F.col("name").alias("owner"), F.col("super").alias("declarer")), "owner")
    return typed.declared_targets(calls, resolved)


_STORES = "(SELECT host AS array, CASE WHEN quantity % 5 <> 0 THEN line % 3 END AS place, callee AS value FROM {calls} WHERE kind = 'STATIC')"
_FETCHES = "(SELECT host AS array, CASE WHEN quantity % 4 <> 0 THEN line % 3 END AS place, call_id AS read FROM {calls} WHERE kind <> 'STATIC')"


@query(f"SELECT DISTINCT r.read, w.value FROM {_FETCHES} r JOIN {_STORES} w ON w.array = r.array AND (r.place IS NULL OR w.place IS NULL OR r.place = w.place)")
def array_flows(p):
    return typed.array_flows(p.sql("SELECT * FROM " + _STORES), p.sql("SELECT * FROM " + _FETCHES))


_MADE = "(SELECT 'v' || CAST(s_suppkey AS STRING) AS view, 'v' || CAST(CAST(floor(s_suppkey / 2.0) AS BIGINT) AS STRING) AS made_of FROM {supplier} WHERE s_suppkey % 7 <> 0 AND s_suppkey > 1)"
_VIEWS = f"u AS (SELECT view, made_of AS container, 1 AS depth FROM {_MADE} m UNION SELECT u.view, m.made_of, u.depth + 1 FROM u JOIN {_MADE} m ON m.view = u.container WHERE u.depth < 8)"


@query(f"WITH {_VIEWS} SELECT view, container, depth FROM u")
def container_views(p):
    return typed.unwrapped(p.sql("SELECT * FROM " + _MADE))[0]


@query(f"""WITH {_VIEWS}, a AS (SELECT 'v' || CAST(p_partkey % 40 AS STRING) AS container, p_brand AS value FROM {{part}} WHERE p_size < 10), t AS (SELECT 'v' || CAST(c_custkey % 50 AS STRING) AS container, c_custkey AS take FROM {{customer}} WHERE c_custkey % 5 = 0),
r AS (SELECT view, container FROM u UNION SELECT container, container FROM a UNION SELECT container, container FROM t)
SELECT DISTINCT t.take, a.value FROM t JOIN r x ON x.view = t.container JOIN r y ON y.container = x.container JOIN a ON a.container = y.view""")
def element_sources(p):
    adds = p.part.where("p_size < 10").select(F.format_string("v%d", F.col("p_partkey") % 40).alias("container"), F.col("p_brand").alias("value"))
    takes = p.customer.where("c_custkey % 5 = 0").select(F.format_string("v%d", F.col("c_custkey") % 50).alias("container"), F.col("c_custkey").alias("take"))
    return typed.element_sources(adds, takes, p.sql("SELECT * FROM " + _MADE))


@query("""SELECT method, coalesce(string_agg(CASE WHEN op = 'GETFIELD' THEN CAST(pos AS STRING) END, ',' ORDER BY pos), '') AS reads, coalesce(string_agg(CASE WHEN op IN ('PUTFIELD', 'INVOKE') THEN CAST(pos AS STRING) END, ',' ORDER BY pos), '') AS effects FROM {insns} GROUP BY method""")
def method_slices(p):
    found = typed.method_slices(p.insns, {"reads": ("GETFIELD",), "effects": ("PUTFIELD", "INVOKE")})
    return found.select("method", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("reads", "effects")))


@query("SELECT p_brand AS field, bool_and(p_size > 3) AS bound FROM {part} WHERE p_type <> 'PROMO' GROUP BY p_brand")
def platform_bound(p):
    return typed.all_of(p.part.where("p_type <> 'PROMO'").select(F.col("p_brand").alias("field"), "p_size"), "field", F.col("p_size") > 3)


@query("""SELECT rule_id, CASE WHEN (category IN ('command', 'script')) THEN 'HIGH' ELSE coalesce(CASE WHEN severity <> 'LOW' THEN severity END, CASE WHEN category IN ('file', 'lookup') THEN 'CONTROLLED' ELSE 'SAFE' END) END AS risk FROM {rules}""")
def resolved_risk(p):
    inferred = F.when(F.col("category").isin("command", "script"), "HIGH").when(F.col("category").isin("file", "lookup"), "CONTROLLED").otherwise("SAFE")
    return p.rules.select("rule_id", typed.resolved_risk(F.when(F.col("severity") != "LOW", F.col("severity")), inferred).alias("risk"))


@query("""WITH up AS (SELECT name AS descendant, super AS ancestor FROM {brands} UNION SELECT up.descendant, b.super FROM up JOIN {brands} b ON b.name = up.ancestor)
SELECT method, rule_id FROM (SELECT s.method, v.rule_id, row_number() OVER (PARTITION BY s.method ORDER BY CASE WHEN s.owner = v.pat THEN 132 ELSE 72 END DESC, v.rule_id) AS rn FROM {sites} s JOIN (VALUES ('s1', 'Brand#', 'PROMO'), ('s2', 'Brand#2', 'PROMO'), ('s3', 'Brand#12', 'LARGE'), ('s4', 'Brand#21', 'PROMO')) AS v(rule_id, pat, name) ON v.name = s.name
WHERE s.owner = v.pat OR EXISTS (SELECT 1 FROM up WHERE up.descendant = s.owner AND up.ancestor = v.pat)) x WHERE rn = 1""")
def source_match(p):
    rows = [("s1", "Brand#", "PROMO"), ("s2", "Brand#2", "PROMO"), ("s3", "Brand#12", "LARGE"), ("s4", "Brand#21", "PROMO")]
    sources = p.spark.createDataFrame([(i, o, "subtype", n, "exact", "SOURCE", "input", "LOW") for i, o, n in rows], "rule_id string, owner_pat string, owner_mode string, name_pat string, name_mode string, role string, category string, severity string")
    return rules.best_rule(rules.scores(p.sites, sources, hierarchy.type_closure(p.brands))).select("method", "rule_id")


@query(f"WITH {_UP} SELECT descendant AS name, string_agg(ancestor, ',' ORDER BY depth, ancestor) AS ancestors FROM c GROUP BY descendant")
def ancestors_of(p):
    listed = F.array_sort(F.collect_list(F.struct("depth", "ancestor")))
    return hierarchy.type_closure(p.types).groupBy(F.col("descendant").alias("name")).agg(F.array_join(F.transform(listed, lambda x: x["ancestor"]), ",").alias("ancestors"))


_HELD = "(SELECT 'C' || CAST(l_partkey AS STRING) AS class, l_suppkey % 9 AS artifact FROM {lineitem})"


@query(f"SELECT class, CASE WHEN bool_or(artifact = 0) THEN 'application' ELSE 'dependency' END AS scope FROM {_HELD} h GROUP BY class")
def class_scopes(p):
    return programs.scoped(p.sql("SELECT * FROM " + _HELD), p.spark.range(1).select(F.col("id").alias("artifact")))


@query("""WITH h AS (SELECT name, super AS up FROM {types} UNION ALL SELECT name, 'R' || CAST(CAST(substr(name, 2) AS INT) % 5 AS STRING) FROM {types} WHERE kind = 'S'),
n AS (SELECT name, 0 AS depth FROM {types} WHERE kind = 'S' AND CAST(substr(name, 2) AS INT) % 4 = 0 UNION SELECT h.up, n.depth + 1 FROM n JOIN h ON h.name = n.name WHERE h.up IS NOT NULL) SELECT name AS class, min(depth) AS depth FROM n GROUP BY name""")
def needed_classes(p):
    number = F.expr("CAST(substr(name, 2) AS INT)")
    heads = p.types.select(F.col("name").alias("class"), "super", F.when(F.col("kind") == "S", F.array(F.format_string("R%d", number % 5))).alias("interfaces"))
    seeds = p.types.where((F.col("kind") == "S") & (number % 4 == 0)).select(F.col("name").alias("class"))
    return programs.needed(seeds, programs.headers(heads))[0]


@query("SELECT owner, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT p_brand AS owner, p_name AS name FROM {part} WHERE p_size % 3 = 0) x GROUP BY owner")
def native_index(p):
    return programs.native_methods(p.part.select(F.col("p_brand").alias("owner"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, 257).otherwise(1).alias("access")))


@query("SELECT s_suppkey AS origin, '/r' || CAST(s_nationkey AS STRING) || '/*' AS route, 'app/web/S' || CAST(s_suppkey AS STRING) AS owner FROM {supplier} WHERE s_suppkey % 3 <> 0 UNION SELECT s_suppkey, '/more', 'app/web/S' || CAST(s_suppkey AS STRING) FROM {supplier} WHERE s_suppkey % 3 = 1")
def web_routes(p):
    k = F.col("s_suppkey")
    line = lambda route: F.format_string("<servlet-mapping><servlet-name>n</servlet-name><url-pattern> %s </url-pattern></servlet-mapping>", route)
    text = F.concat(F.lit("<web-app><servlet><servlet-name>n</servlet-name><servlet-class>"), F.format_string("app.web.S%d", k), F.lit("</servlet-class></servlet>"), F.when(k % 3 != 0, line(F.format_string("/r%d/*", F.col("s_nationkey")))).otherwise(""), F.when(k % 3 == 1, line(F.lit("/more"))).otherwise(""), F.lit("</web-app>"))
    return programs.web_routes(p.supplier.select(k.alias("origin"), F.when(k % 30 == 3, "no xml <").otherwise(text).alias("text")))


# Forward propagation -----------------------------------------------------------------------

_MAGIC = """(SELECT 'S' || CAST(s_suppkey AS STRING) AS owner, CASE s_suppkey % 4 WHEN 0 THEN 'readObject' WHEN 1 THEN 'readResolve' WHEN 2 THEN 'readExternal' ELSE 'run' END AS name,
CASE WHEN s_suppkey % 5 = 0 THEN '()V' WHEN s_suppkey % 4 = 0 THEN '(Ljava/io/ObjectInputStream;)V' WHEN s_suppkey % 4 = 1 THEN '()Ljava/lang/Object;' ELSE '(Ljava/io/ObjectInput;)V' END AS descriptor FROM {supplier})"""


@query(f"WITH {_UP} SELECT owner, name FROM {_MAGIC} m WHERE name <> 'run' AND descriptor <> '()V' AND owner IN (SELECT descendant FROM c WHERE ancestor IN ('R1', 'R3'))")
def magic_entries(p):
    below = hierarchy.type_closure(p.types).where("ancestor in ('R1', 'R3')").select(F.col("descendant").alias("name"))
    return forward.magic_entries(p.sql("SELECT * FROM " + _MAGIC), below)


_STEPS = """(SELECT DISTINCT 'p|' || host AS src, 'p|' || callee AS dst, 'argument' AS kind FROM {calls} WHERE quantity % 3 = 0 UNION ALL SELECT DISTINCT 'p|' || host, 'f|' || supplier, 'write' FROM {calls} WHERE quantity % 5 = 0
UNION ALL SELECT DISTINCT 'f|' || supplier, 'p|' || host, 'read' FROM {calls} WHERE quantity % 11 = 0 UNION ALL SELECT DISTINCT 'p|' || callee, 'r|' || callee, 'return' FROM {calls} UNION ALL SELECT DISTINCT 'r|' || callee, 'p|' || host, 'model' FROM {calls} WHERE quantity % 13 = 0)"""


@query(f"""WITH e AS (SELECT * FROM {_STEPS} s), w AS (SELECT 'p|' || method AS node, 0 AS depth FROM {{sources}} WHERE CAST(substr(method, 2) AS INT) % 3 = 0 UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 6),
m AS (SELECT node, min(depth) AS depth FROM w GROUP BY node)
SELECT m.node, m.depth, coalesce(min(e.kind), 'seed') AS kind FROM m LEFT JOIN e ON e.dst = m.node AND m.depth > 0 AND EXISTS (SELECT 1 FROM m q WHERE q.node = e.src AND q.depth = m.depth - 1) GROUP BY m.node, m.depth""")
def forward_effects(p):
    c = p.calls
    rows = lambda a, b, where: c.where(where).select(F.concat(*a).alias("src"), F.concat(*b).alias("dst"))
    at = lambda k, n: (F.lit(f"{k}|"), F.col(n))
    steps = forward.effects(rows(at("p", "host"), at("p", "callee"), "quantity % 3 = 0"), rows(at("p", "host"), at("f", "supplier"), "quantity % 5 = 0"), rows(at("f", "supplier"), at("p", "host"), "quantity % 11 = 0"), rows(at("p", "callee"), at("r", "callee"), "true"), rows(at("r", "callee"), at("p", "host"), "quantity % 13 = 0"))
    seeds = p.sources.where("CAST(substr(method, 2) AS INT) % 3 = 0").select(F.concat(F.lit("p|"), F.col("method")).alias("node"))
    return forward.propagate(seeds, steps, 6)[0]


@query("""WITH e AS (SELECT src, dst FROM {followers} UNION SELECT DISTINCT host, callee FROM {calls} WHERE quantity > 30), w AS (SELECT dst AS node, 0 AS len FROM e WHERE dst NOT IN (SELECT src FROM e) UNION SELECT e.src, w.len + 1 FROM w JOIN e ON e.dst = w.node)
SELECT node, max(len) AS level FROM w GROUP BY node""")
def work_levels(p):
    return forward.levels(p.followers.select("src", "dst").union(p.calls.where("quantity > 30").select("host", "callee")))[0]


_MODELLED = "(SELECT call_id AS call, kind AS model, 'arg0' AS slot_in, 'p|' || host AS place_in, 'return' AS slot_out, 'p|' || CASE WHEN quantity % 2 = 0 THEN callee ELSE 'O' || CAST(quantity AS STRING) END AS place_out FROM {calls})"


@query(f"""WITH e AS (SELECT DISTINCT place_in AS src, place_out AS dst FROM {_MODELLED} c WHERE model IN ('STATIC', 'VIRTUAL')), w AS (SELECT 'p|' || method AS node, 0 AS depth FROM {{sources}} UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 8)
SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def model_summaries(p):
    models = p.spark.createDataFrame([("STATIC", "arg0", "return"), ("VIRTUAL", "arg0", "return"), ("INTERFACE", "this", "return")], "model string, source string, target string")
    facts = p.sources.select(F.concat(F.lit("p|"), F.col("method")).alias("node"))
    return forward.summarised(facts, p.sql("SELECT * FROM " + _MODELLED), models, 8)[0].select("node", "depth")
