"""Registered query over constants through calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constants
from .queries import query

_N = "CAST(substr({}, 2) AS INT)"
_DST = _N.format("dst")
_SAME = f"{_DST} % 3 <> 0 AND {_DST} % 4 <> 1 AND {_DST} % 5 <> 0"
# A customer's first order is a number; what follows is a linear form of the one before, or a number again. Some copy
# back, so that there are cycles; some may be anything. A nation is all that its customers' orders are.
_EQUATIONS = f"""SELECT name AS var, CAST(NULL AS STRING) AS src, 1 AS mul, CAST({_N.format("name")} % 5 + 2147483640 AS INT) AS add, false AS free FROM {{methods}} WHERE substr(name, 1, 1) = 'O' AND name NOT IN (SELECT dst FROM {{followers}})
UNION ALL SELECT dst, src, CASE WHEN {_DST} % 3 = 0 THEN -1 ELSE 1 END, CASE WHEN {_DST} % 4 = 1 THEN 9 ELSE 0 END, false FROM {{followers}} WHERE {_DST} % 5 <> 0
UNION ALL SELECT dst, CAST(NULL AS STRING), 1, {_DST} % 2, false FROM {{followers}} WHERE {_DST} % 5 = 0
UNION ALL SELECT src, dst, 1, 0, false FROM {{followers}} WHERE {_DST} % 7 = 0 AND {_SAME}
UNION ALL SELECT 'O' || CAST(o_orderkey AS STRING), CAST(NULL AS STRING), CAST(NULL AS INT), CAST(NULL AS INT), true FROM {{orders}} WHERE o_orderkey % 13 = 0
UNION ALL SELECT 'N' || CAST(o_custkey % 1000 AS STRING), 'O' || CAST(o_orderkey AS STRING), 1, 0, false FROM {{orders}} WHERE o_orderkey % 4 = 0"""


@query(f"""WITH RECURSIVE eqs AS ({_EQUATIONS}), known(var, value, free) AS (SELECT var, CAST(CASE WHEN NOT free THEN add END AS BIGINT), free FROM eqs WHERE src IS NULL
UNION SELECT e.var, ((e.mul * k.value + e.add + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, k.free FROM known k JOIN eqs e ON e.src = k.var)
SELECT var, bool_or(free) OR count(DISTINCT value) > 1 AS varies, CAST(CASE WHEN bool_or(free) OR count(DISTINCT value) > 1 THEN 0 ELSE min(value) END AS INT) AS value FROM known GROUP BY var""")
def constant_values(p):
    found, _ = constants.solve(p.sql(_EQUATIONS))
    return found.select("var", F.col("value").isNull().alias("varies"), F.coalesce("value", F.lit(0)).alias("value"))
