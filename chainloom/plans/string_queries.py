"""Registered query over shapes of strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import strings
from .queries import query

# An order's text has a fixed length; a customer may be any of its orders' texts, a nation names what its customers are.
_ORDER = "SELECT o_custkey AS customer, CAST(o_custkey % 25 AS STRING) AS nation, CAST(o_orderkey AS STRING) AS id, o_orderstatus || '/' || substr(o_orderpriority, 1, 3) || '/' || CAST(o_custkey % 10 AS STRING) || ';' AS text FROM {orders}"
_COMMON = "len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda n: left({a}, n) = left({b}, n)))"


def _met(key: str) -> str:
    a, b, ra, rb = "min(text)", "max(text)", "min(reverse(text))", "max(reverse(text))"
    lead, back = (_COMMON.format(a=x, b=y) for x, y in ((a, b), (ra, rb)))
    return f"SELECT {key} AS k, left({a}, {lead}) AS prefix, reverse(left({ra}, {back})) AS suffix, {a} = {b} AS exact FROM o GROUP BY {key}"


@query(f"""WITH o AS ({_ORDER}), c AS ({_met("customer")}), n AS ({_met("nation")})
SELECT 'c' || CAST(k AS STRING) AS var, prefix, suffix, exact FROM c
UNION ALL SELECT 'n' || k, 'n:' || prefix, CASE WHEN exact THEN 'n:' || suffix ELSE suffix END, exact FROM n""")
def string_shapes(p):
    orders = p.sql(_ORDER)
    piece = lambda *atoms: F.array(*(F.array(a) for a in atoms))
    made = orders.select(F.concat(F.lit("o"), "id").alias("var"), piece(F.concat(F.lit("c:"), "text")).alias("pieces"))
    nations = orders.select("nation").distinct().select(F.concat(F.lit("n"), "nation").alias("var"), piece(F.lit("c:n:"), F.concat(F.lit("v:in"), "nation")).alias("pieces"))
    customer = F.concat(F.lit("c"), F.col("customer").cast("string"))
    copies = orders.select(F.concat(F.lit("o"), "id").alias("src"), customer.alias("dst")).union(orders.select(customer, F.concat(F.lit("in"), "nation")).distinct())
    found, _ = strings.shapes(made.union(nations), copies, orders.select(F.col("id").alias("var")).limit(0))
    return found.where("var like 'c%' or var like 'n%'").select("var", "prefix", "suffix", "exact")
