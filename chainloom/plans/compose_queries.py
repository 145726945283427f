"""Registered queries over composed chains: who joins whom by turns, and the hops of what comes of it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import compose
from ..session import cut
from .queries import _KIND, _REGION, query

_ENDS = f"(SELECT r.*, c.entry_method FROM {_REGION} r JOIN {{chains}} c ON c.chain_key = r.chain_key)"
_TURNS = f"""WITH x AS MATERIALIZED (SELECT * FROM {_ENDS} y), h AS MATERIALIZED (SELECT * FROM {{hops}}),
f AS (SELECT *, row_number() OVER (PARTITION BY sink_region ORDER BY n_hops, chain_key) - 1 AS i FROM x),
b AS (SELECT *, row_number() OVER (PARTITION BY entry_region ORDER BY n_hops, chain_key) - 1 AS j, count(*) OVER (PARTITION BY entry_region) AS nb FROM x),
m AS (SELECT f.chain_key AS front, b.chain_key AS back, sink_region AS region, i, (j - i % nb + nb) % nb AS turn, {_KIND} AS bridge, f.n_hops + b.n_hops AS n_hops, b.entry_method AS entered
  FROM f JOIN (SELECT * RENAME (sink_region AS s2) FROM b) b ON f.sink_region = b.entry_region AND f.chain_key <> b.chain_key),
ok AS (SELECT *, row_number() OVER (PARTITION BY front ORDER BY turn) AS rn FROM m WHERE turn < {compose.TURNS} AND bridge IS NOT NULL AND n_hops <= 64
  AND NOT EXISTS (SELECT 1 FROM h WHERE h.chain_key = m.front AND (h.from_name = m.entered OR h.to_name = m.entered))),
chosen AS (SELECT front, back, 'bridge-' || lower(bridge) AS reason, CAST(turn AS INT) AS turn, n_hops FROM ok WHERE rn <= {compose.PER_FRONT} ORDER BY turn, region, i LIMIT {compose.MOST_CHAINS})"""


def _chosen(p):
    x = p.sql("SELECT * FROM " + _ENDS)
    return p.shared("compose_turns", lambda: compose.by_turns(x.withColumnRenamed("sink_region", "region"), x.withColumnRenamed("entry_region", "region"), p.hops)[0])


@query(_TURNS + " SELECT * FROM chosen")
def compose_turns(p):
    return _chosen(p)


_SPLICED = """, k AS (SELECT chain_key, max(ord) AS top FROM h GROUP BY chain_key),
e AS (SELECT front || '+' || back AS key, front, back, top, reason AS bridge FROM chosen JOIN k ON k.chain_key = back),
s AS (SELECT key AS chain_key, ord, from_name, to_name, kind, reason FROM e JOIN h ON h.chain_key = back WHERE ord < top
UNION ALL SELECT key, h.ord, z.to_name, h.to_name, h.kind, bridge FROM e JOIN h ON h.chain_key = back AND h.ord = top JOIN h z ON z.chain_key = front AND z.ord = 0
UNION ALL SELECT key, ord + top + 1, from_name, to_name, kind, reason FROM e JOIN h ON h.chain_key = front)"""


@query(_TURNS + _SPLICED + " SELECT * FROM s")
def composed_hops(p):
    return compose.spliced(_chosen(p), p.hops)


@query(_TURNS + _SPLICED + " SELECT chain_key, count(*) AS n, true AS unbroken FROM s GROUP BY chain_key")
def composed_connectivity(p):
    found = compose.spliced(_chosen(p), p.hops)
    before = F.lag("from_name").over(Window.partitionBy("chain_key").orderBy("ord"))
    return found.withColumn("ok", F.coalesce(F.col("to_name") == before, F.lit(True))).groupBy("chain_key").agg(F.count(F.lit(1)).alias("n"), F.min("ok").alias("unbroken"))


_MEET = """WITH h AS MATERIALIZED (SELECT * FROM {hops}), a AS (SELECT chain_key AS front, from_name AS spot FROM h WHERE ord = 0), b AS (SELECT chain_key AS back, to_name AS spot, ord AS cut FROM h WHERE ord >= 1),
r AS (SELECT front, back, cut FROM (SELECT front, back, cut, row_number() OVER (PARTITION BY front ORDER BY cut, back) AS rn FROM a JOIN b ON a.spot = b.spot WHERE front <> back) y WHERE rn <= 2)"""


@query(_MEET + """ SELECT front || '&' || back AS chain_key, ord, from_name, to_name, kind, reason FROM r JOIN h ON h.chain_key = front WHERE ord = 0
UNION ALL SELECT front || '&' || back, ord - cut + 1, from_name, to_name, kind, reason FROM r JOIN h ON h.chain_key = back WHERE ord >= cut""")
def overlapped_hops(p):
    return compose.overlapped(cut(compose.overlaps(p.hops)), p.hops)
