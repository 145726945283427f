"""Registered query over generic types: arguments carried up the hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generics
from .queries import query

# A customer or supplier has one variable, a nation two, a region one. What each hands on depends on its number; some
# hand on nothing, so that what is above them is raw.
_K = "CAST(substr(name, 2) AS INT)"
_V0, _V1 = ("(chr(123) || '%d' || chr(125))" % i for i in range(2))
_LOW = f"SELECT name, super, {_K} % 9 = 0 AS raw, CASE WHEN {_K} % 2 = 0 THEN {_V0} ELSE 'LList<' || {_V0} || '>;' END AS a, CASE WHEN {_K} % 3 = 0 THEN {_V0} ELSE 'LText;' END AS b FROM {{types}} WHERE kind IN ('C', 'S')"
_MIDDLE = f"SELECT name, super, CASE {_K} % 3 WHEN 0 THEN {_V0} WHEN 1 THEN {_V1} ELSE 'LMap<' || {_V1} || {_V0} || '>;' END AS a FROM {{types}} WHERE kind = 'N'"
_USED = "SELECT DISTINCT 'C' || CAST(o_custkey AS STRING) AS name, 'LP' || substr(o_orderpriority, 1, 1) || ';' AS arg FROM {orders} UNION SELECT 'S' || CAST(s_suppkey AS STRING), 'LSupplied<LP' || CAST(s_suppkey % 4 AS STRING) || ';>;' FROM {supplier}"


@query(f"""WITH low AS ({_LOW}), middle AS ({_MIDDLE}), used AS ({_USED}),
one AS (SELECT u.name, u.arg, l.super AS above, CASE WHEN raw THEN 'Ljava/lang/Object;' ELSE replace(a, {_V0}, u.arg) END AS a, CASE WHEN raw THEN 'LText;' ELSE replace(b, {_V0}, u.arg) END AS b FROM used u JOIN low l ON l.name = u.name)
SELECT name, arg, name AS above, arg AS above_args FROM used
UNION ALL SELECT name, arg, above, a || ',' || b FROM one
UNION ALL SELECT o.name, o.arg, m.super, replace(replace(m.a, {_V0}, o.a), {_V1}, o.b) FROM one o JOIN middle m ON m.name = o.above""")
def type_arguments(p):
    low, middle = p.sql(_LOW), p.sql(_MIDDLE)
    none = F.array().cast("array<string>")
    hierarchy = low.select(F.col("name").alias("child"), F.array(F.lit(generics.OBJECT)).alias("bounds"), F.col("super").alias("parent"), F.when(F.col("raw"), none).otherwise(F.array("a", "b")).alias("args"))
    hierarchy = hierarchy.union(middle.select("name", F.array(F.lit(generics.OBJECT), F.lit("LText;")), "super", F.array("a")))
    found, _ = generics.ascend(p.sql(_USED).select("name", F.array("arg").alias("args")), hierarchy)
    return found.select("name", F.concat_ws(",", "args").alias("arg"), F.col("at").alias("above"), F.concat_ws(",", "at_args").alias("above_args"))
