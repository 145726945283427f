"""Registered queries over cycles and over calls that match their returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cycles, fixpoint, matched
from .queries import query

# Orders of a customer follow each other, some lead back, and suppliers stand in a ring with chords.
_GRAPH = """(SELECT src, dst FROM {followers} UNION SELECT dst, src FROM {followers} WHERE CAST(substr(src, 2) AS INT) % 5 < 2
UNION SELECT 'S' || CAST(s_suppkey AS STRING), 'S' || CAST((s_suppkey + 1) % (SELECT count(*) FROM {supplier}) AS STRING) FROM {supplier}
UNION SELECT 'S' || CAST(s_suppkey AS STRING), 'T' || CAST(s_suppkey AS STRING) FROM {supplier} WHERE s_suppkey % 3 = 0
UNION SELECT 'T' || CAST(s_suppkey AS STRING), 'T' || CAST(s_suppkey + 3 AS STRING) FROM {supplier} WHERE s_suppkey % 4 < 3)"""
_REACH = f"""WITH e AS (SELECT * FROM {_GRAPH} g), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b),
c AS (SELECT n.node, least(n.node, coalesce(min(r.b), n.node)) AS component FROM n LEFT JOIN (SELECT x.a, x.b FROM r x JOIN r y ON y.a = x.b AND y.b = x.a) r ON r.a = n.node GROUP BY n.node)"""


@query(_REACH + " SELECT node, component FROM c")
def cycle_components(p):
    return p.shared("cycle_components", lambda: cycles.strong_components(p.sql("SELECT * FROM " + _GRAPH + " g")))


@query(_REACH + """, up AS (SELECT DISTINCT x.component AS src, y.component AS dst FROM e JOIN c x ON x.node = e.src JOIN c y ON y.node = e.dst WHERE x.component <> y.component),
l AS (SELECT DISTINCT component, 0 AS level FROM c UNION SELECT up.src, l.level + 1 FROM l JOIN up ON up.dst = l.component)
SELECT node, c.component, m.level FROM c JOIN (SELECT component, max(level) AS level FROM l GROUP BY component) m ON m.component = c.component""")
def component_levels(p):
    return cycles.levels(p.sql("SELECT * FROM " + _GRAPH + " g"), cycle_components(p))


# An order is a method with a value before and after each of its calls, a part returns what it gets and asks its
# supplier, which returns it too; so three levels of calls share their callees among thousands of sites.
_FLOW = """(SELECT host || '|r' || CAST(pos AS STRING) AS src, host || '|' || CAST(pos + 1 AS STRING) AS dst FROM {calls} WHERE line % 4 <> 3
UNION SELECT DISTINCT callee || '|0', callee || '|a' FROM {calls} UNION SELECT DISTINCT callee || '|b', callee || '|ret' FROM {calls} WHERE CAST(substr(callee, 2) AS INT) % 5 <> 0
UNION SELECT 'S' || CAST(s_suppkey AS STRING) || '|0', 'S' || CAST(s_suppkey AS STRING) || '|ret' FROM {supplier} WHERE s_suppkey % 4 <> 1)"""
_INTO = """(SELECT call_id AS site, host || '|' || CAST(pos AS STRING) AS src, callee || '|0' AS dst FROM {calls}
UNION SELECT DISTINCT callee || '@' || supplier, callee || '|a', supplier || '|0' FROM {calls})"""
_OUT = """(SELECT call_id AS site, callee || '|ret' AS src, host || '|r' || CAST(pos AS STRING) AS dst FROM {calls}
UNION SELECT DISTINCT callee || '@' || supplier, supplier || '|ret', callee || '|b' FROM {calls})"""
_SEEDS = """(SELECT 'O' || CAST(o_orderkey AS STRING) AS key, 'O' || CAST(o_orderkey AS STRING) || '|0' AS node FROM {orders} WHERE o_orderkey % 7 < 2
UNION SELECT 'P' || CAST(p_partkey AS STRING), 'P' || CAST(p_partkey AS STRING) || '|b' FROM {part} WHERE p_partkey % 40 = 1)"""
_ASKED = """(SELECT call_id AS key, host || '|' || CAST(pos + 1 AS STRING) AS node FROM {calls} WHERE CAST(substr(host, 2) AS INT) % 9 = 2
UNION SELECT 'P' || CAST(p_partkey AS STRING), 'P' || CAST(p_partkey AS STRING) || '|a' FROM {part} WHERE p_partkey % 40 = 3)"""


def _strings(seeds: str, flow: str, into: str, out: str) -> str:
    """Oracle: every state by its explicit string of open calls; no string is deeper than two here."""
    return f"""WITH flow AS (SELECT * FROM {flow} x), into_ AS (SELECT * FROM {into} x), out_ AS (SELECT * FROM {out} x),
step AS (SELECT src, dst, CAST(NULL AS STRING) AS opened, CAST(NULL AS STRING) AS closed FROM flow UNION ALL SELECT src, dst, site, NULL FROM into_ UNION ALL SELECT src, dst, NULL, site FROM out_),
w AS (SELECT key, node, '' AS stack FROM {seeds} s UNION
SELECT w.key, e.dst, CASE WHEN e.opened IS NOT NULL THEN w.stack || '/' || e.opened WHEN e.closed IS NOT NULL AND w.stack <> '' THEN left(w.stack, length(w.stack) - length(e.closed) - 1) ELSE w.stack END
FROM w JOIN step e ON e.src = w.node WHERE e.closed IS NULL OR w.stack = '' OR w.stack LIKE '%/' || e.closed)
SELECT DISTINCT key, node, true AS complete FROM w"""


def _matched(p, search, seeds):
    """The search over the edges; repeated rows don't matter to it, so it does without the unions' comparing of rows."""
    p.store("calls")
    found, complete = search(p.sql(f"SELECT * FROM {seeds} s"), *(p.sql(f"SELECT * FROM {t.replace('UNION', 'UNION ALL')} x") for t in (_FLOW, _INTO, _OUT)))
    return found.withColumn("complete", F.lit(complete))


@query(_strings(_SEEDS, _FLOW, _INTO, _OUT))
def matched_reach(p):
    return _matched(p, matched.reach, _SEEDS)


_TURNED = ["(SELECT dst AS src, src AS dst FROM {t} x)", "(SELECT site, dst AS src, src AS dst FROM {t} x)"]


@query(_strings(_ASKED, _TURNED[0].replace("{t}", _FLOW), _TURNED[1].replace("{t}", _OUT), _TURNED[1].replace("{t}", _INTO)))
def matched_control(p):
    return _matched(p, matched.backward, _ASKED)


_FIRST = "(SELECT src AS node FROM {followers} WHERE src NOT IN (SELECT dst FROM {followers}) UNION SELECT 'S0')"
_LAST = "(SELECT dst AS node FROM {followers} WHERE CAST(substr(dst, 2) AS INT) % 11 = 3 UNION SELECT 'S' || CAST(s_suppkey AS STRING) FROM {supplier} WHERE s_suppkey % 3 = 1)"


@query(f"""WITH e AS (SELECT DISTINCT src, dst FROM {_GRAPH} g WHERE src <> dst), w AS (SELECT node, 0 AS hops, node AS path, [node] AS met FROM {_FIRST} f
UNION ALL SELECT e.dst, w.hops + 1, w.path || '>' || e.dst, list_append(w.met, e.dst) FROM w JOIN e ON e.src = w.node WHERE w.hops < 6 AND NOT list_contains(w.met, e.dst))
SELECT node, CAST(rank AS INT) AS rank, hops, path FROM (SELECT w.node, hops, path, row_number() OVER (PARTITION BY w.node ORDER BY hops, path) AS rank FROM w JOIN {_LAST} l ON l.node = w.node) x WHERE rank <= 3""")
def target_paths(p):
    return fixpoint.deviating_paths(p.sql("SELECT * FROM " + _FIRST + " f"), p.sql("SELECT * FROM " + _LAST + " l"), p.sql("SELECT * FROM " + _GRAPH + " g WHERE src <> dst"), 6, 3)
