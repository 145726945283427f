"""Registered queries over objects: points-to sets, contents of arrays and containers, receiver types."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pointsto
from .queries import query

# Orders are variables; a third of them allocate. What follows an order of a customer is copied, stored or loaded.
_N = "CAST(substr({}, 2) AS INT)"
_FACTS = {
    "allocs": f"SELECT name AS var, 'A' || substr(name, 2) AS site FROM {{methods}} WHERE substr(name, 1, 1) = 'O' AND {_N.format('name')} % 5 < 2",
    "copies": f"SELECT src, dst FROM {{followers}} WHERE {_N.format('src')} % 3 <> 0 UNION SELECT 'L' || substr(src, 2), dst FROM {{followers}} WHERE {_N.format('src')} % 2 = 0",
    "stores": f"SELECT f.src AS base, CASE {_N.format('f.src')} % 3 WHEN 0 THEN '[]' WHEN 1 THEN 'f' ELSE 'g' END AS field, g.dst AS src FROM {{followers}} f JOIN {{followers}} g ON g.src = f.dst WHERE {_N.format('f.dst')} % 4 <> 1",
    "loads": f"SELECT f.dst AS base, CASE {_N.format('f.dst')} % 3 WHEN 0 THEN '[]' WHEN 1 THEN 'f' ELSE 'g' END AS field, 'L' || substr(f.src, 2) AS dst FROM {{followers}} f UNION SELECT src, 'f', 'L' || substr(src, 2) FROM {{followers}} WHERE {_N.format('src')} % 2 = 1",
}
_SITES = f"SELECT 'A' || substr(name, 2) AS site, 'T' || CAST({_N.format('name')} % 7 AS STRING) AS type FROM {{methods}} WHERE substr(name, 1, 1) = 'O'"
_SOLVED = f"""WITH RECURSIVE allocs AS ({_FACTS["allocs"]}), copies AS ({_FACTS["copies"]}), stores AS ({_FACTS["stores"]}), loads AS ({_FACTS["loads"]}), sites AS ({_SITES}),
known(kind, a, b) USING KEY (kind, a, b) AS (SELECT 'p' AS kind, var AS a, site AS b FROM allocs UNION SELECT 'e', src, dst FROM copies UNION (
SELECT 'p', e.b, p.b FROM known p JOIN recurring.known e ON e.kind = 'e' AND e.a = p.a WHERE p.kind = 'p'
UNION SELECT 'p', e.b, p.b FROM known e JOIN recurring.known p ON p.kind = 'p' AND p.a = e.a WHERE e.kind = 'e'
UNION SELECT 'e', s.src, p.b || '.' || s.field FROM known p JOIN stores s ON s.base = p.a WHERE p.kind = 'p'
UNION SELECT 'e', p.b || '.' || l.field, l.dst FROM known p JOIN loads l ON l.base = p.a WHERE p.kind = 'p')) """


def _solved(p):
    """(var, site, complete)."""

    def build():
        pts, complete = pointsto.solve(*(p.sql(_FACTS[name]) for name in ("allocs", "copies", "stores", "loads")))
        return pts.withColumn("complete", F.lit(complete))

    return p.shared("points_to", build)


@query(_SOLVED + "SELECT a AS var, b AS site, true AS complete FROM known WHERE kind = 'p'")
def points_to(p):
    return _solved(p)


@query(_SOLVED + "SELECT split_part(a, '.', 1) AS container, b AS content, type FROM known JOIN sites ON site = b WHERE kind = 'p' AND a LIKE '%.[]'")
def element_contents(p):
    held = _solved(p).where(F.endswith("var", F.lit("." + pointsto.ELEMENT))).select(F.substring_index("var", ".", 1).alias("container"), F.col("site").alias("content"))
    return held.join(p.sql(_SITES).withColumnRenamed("site", "content"), "content").select("container", "content", "type")


@query(_SOLVED + "SELECT DISTINCT a AS var, type, min(type) OVER (PARTITION BY a) = max(type) OVER (PARTITION BY a) AS exact FROM known JOIN sites ON site = b WHERE kind = 'p' AND a LIKE 'O%'")
def receiver_types(p):
    return pointsto.types_of(_solved(p).where("var like 'O%'").select("var", "site"), p.sql(_SITES))
