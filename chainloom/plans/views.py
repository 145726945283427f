"""The test tables seen as a program: types, methods, calls, edges, rules, chains.

Each view is one SQL text that Spark and DuckDB both read, with ``{name}`` for a table or
another view. Spark gets DataFrames for the names, DuckDB gets them as common table
expressions, so both engines start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import cut

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "types": """SELECT 'R' || CAST(r_regionkey AS STRING) AS name, CAST(NULL AS STRING) AS super, 'R' AS kind FROM {region}
        UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'R' || CAST(n_regionkey AS STRING), 'N' FROM {nation}
        UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'N' || CAST(c_nationkey AS STRING), 'C' FROM {customer}
        UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), 'N' || CAST(s_nationkey AS STRING), 'S' FROM {supplier}""",
    "methods": """SELECT 'O' || CAST(o_orderkey AS STRING) AS name, 'C' || CAST(o_custkey AS STRING) AS owner,
            CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 4 WHEN '4' THEN 9 ELSE 17 END AS access FROM {orders}
        UNION ALL SELECT 'P' || CAST(p_partkey AS STRING), 'S' || CAST(p_partkey % (SELECT count(*) FROM {supplier}) AS STRING),
            CASE WHEN p_size <= 10 THEN 1 WHEN p_size <= 20 THEN 0 WHEN p_size <= 30 THEN 4 WHEN p_size <= 40 THEN 10 ELSE 1025 END FROM {part}
        UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), 'S' || CAST(s_suppkey AS STRING), 1 FROM {supplier}""",
    "calls": """SELECT host || '@' || CAST(pos AS STRING) AS call_id, host, pos, callee, supplier, line, quantity,
            CASE WHEN flag = 'A' THEN 'STATIC' WHEN flag = 'R' THEN 'VIRTUAL' WHEN status = 'F' THEN 'INTERFACE' ELSE 'DYNAMIC' END AS kind
        FROM (SELECT 'O' || CAST(l_orderkey AS STRING) AS host, 'P' || CAST(l_partkey AS STRING) AS callee, 'S' || CAST(l_suppkey AS STRING) AS supplier,
            l_linenumber AS line, CAST(l_quantity AS INT) AS quantity, l_returnflag AS flag, l_linestatus AS status,
            CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS INT) AS pos
            FROM {lineitem}) x""",
    "followers": """SELECT src, dst FROM (SELECT 'O' || CAST(o_orderkey AS STRING) AS src,
            'O' || CAST(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS STRING) AS dst FROM {orders}) x WHERE dst IS NOT NULL""",
    "edges": """SELECT DISTINCT host AS src, callee AS dst, CASE kind WHEN 'STATIC' THEN 'INVOKES' WHEN 'DYNAMIC' THEN 'LAMBDA' ELSE 'DISPATCHES' END AS type FROM {calls}
        UNION ALL SELECT DISTINCT callee, supplier, 'DISPATCHES' FROM {calls}
        UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), 'S' || CAST((s_suppkey + 1) % (SELECT count(*) FROM {supplier}) AS STRING), 'INVOKES' FROM {supplier}
        UNION ALL SELECT src, dst, 'INVOKES' FROM {followers}""",
    "insns": """SELECT host AS method, pos, CASE line % 6 WHEN 0 THEN 'CONST' WHEN 1 THEN 'GETFIELD' WHEN 2 THEN 'PUTFIELD' WHEN 3 THEN 'INVOKE' WHEN 4 THEN 'JUMP' ELSE 'RETURN' END AS op, quantity AS const FROM {calls}""",
    "handlers": """SELECT method, 0 AS start_at, CAST(floor(n / 2.0) AS INT) AS end_at, CAST(n - 1 AS INT) AS handler
        FROM (SELECT host AS method, count(*) AS n FROM {calls} GROUP BY host) x
        JOIN {orders} o ON method = 'O' || CAST(o.o_orderkey AS STRING) WHERE o_orderstatus = 'F' AND n >= 2""",
    "rules": """SELECT * FROM (VALUES
        (1, 'Brand#1', 'subtype', 'ECONOMY', 'exact', 'TERMINAL', 'command', 'HIGH', NULL),
        (2, 'Brand#1.*', 'regex', 'ECONOMY', 'exact', 'TERMINAL', 'command', 'MEDIUM', NULL),
        (3, 'Brand#2', 'subtype', '.*', 'regex', 'TERMINAL', 'lookup', 'HIGH', '~.*e.*'),
        (4, 'Brand#2.*', 'regex', 'SMALL', 'exact', 'CAPABILITY', 'lookup', 'LOW', NULL),
        (5, 'Brand#', 'subtype', 'PROMO', 'exact', 'TERMINAL', 'file', 'MEDIUM', NULL),
        (6, 'Brand#3', 'subtype', 'LARGE|MEDIUM', 'regex', 'TERMINAL', 'file', 'LOW', NULL),
        (7, '.*7', 'regex', '.*', 'regex', 'CAPABILITY', 'reflection', 'LOW', NULL),
        (8, 'Brand#14', 'exact', 'STANDARD', 'exact', 'TERMINAL', 'script', 'HIGH', NULL),
        (9, '.*', 'regex', 'STANDARD', 'exact', 'CAPABILITY', 'bean', 'LOW', NULL),
        (10, 'Brand#2', 'exact', 'ECON.*', 'regex', 'TERMINAL', 'template', 'MEDIUM', NULL),
        (11, 'Brand#14', 'subtype', 'STANDARD', 'exact', 'TERMINAL', 'xml', 'LOW', '~.*a.*'),
        (12, 'Brand#[45].*', 'regex', '(ECONOMY|SMALL)', 'regex', 'TERMINAL', 'network', 'MEDIUM', NULL)
        ) AS t(rule_id, owner_pat, owner_mode, name_pat, name_mode, role, category, severity, descriptor)""",
    "brands": """SELECT DISTINCT p_brand AS name, CASE WHEN CAST(substr(p_brand, 8, 1) AS INT) % 5 = 2 THEN 'Brand#' || CAST(CAST(substr(p_brand, 7, 1) AS INT) % 5 + 1 AS STRING) ELSE substr(p_brand, 1, 7) END AS super FROM {part} WHERE length(p_brand) = 8
        UNION ALL SELECT DISTINCT p_brand, 'Brand#' FROM {part} WHERE length(p_brand) = 7""",
    "brand_pairs": """SELECT super AS ancestor, name AS descendant FROM {brands} UNION SELECT u.super, b.name FROM {brands} b JOIN {brands} u ON u.name = b.super""",
    "sites": """SELECT 'P' || CAST(p_partkey AS STRING) AS method, p_brand AS owner, p_type AS name, p_name AS descriptor FROM {part}""",
    "sources": """SELECT 'O' || CAST(o_orderkey AS STRING) AS method FROM {orders} WHERE o_custkey IN (SELECT user_id FROM {events} WHERE event_type = 'signup')""",
    "best": """SELECT method, rule_id, role, category, severity FROM (SELECT s.method, r.rule_id, r.role, r.category, r.severity,
            row_number() OVER (PARTITION BY s.method ORDER BY CASE WHEN r.owner_mode = 'regex' THEN 21 WHEN s.owner = r.owner_pat THEN 116 ELSE 56 END + CASE r.name_mode WHEN 'exact' THEN 16 ELSE 2 END + CASE WHEN r.descriptor IS NULL THEN 0 ELSE 2 END DESC, r.rule_id) AS rn
            FROM {sites} s CROSS JOIN {rules} r LEFT JOIN {brand_pairs} b ON b.ancestor = r.owner_pat AND b.descendant = s.owner
            WHERE (CASE r.owner_mode WHEN 'exact' THEN s.owner = r.owner_pat WHEN 'subtype' THEN s.owner = r.owner_pat OR b.ancestor IS NOT NULL ELSE regexp_like_(s.owner, '^(?:' || r.owner_pat || ')$') END)
                AND (CASE r.name_mode WHEN 'exact' THEN s.name = r.name_pat ELSE regexp_like_(s.name, '^(?:' || r.name_pat || ')$') END)
                AND (r.descriptor IS NULL OR regexp_like_(s.descriptor, '^(?:' || substr(r.descriptor, 2) || ')$'))) x WHERE rn = 1""",
    "sinks": """SELECT method FROM {best} WHERE role = 'TERMINAL'""",
    "fields": """SELECT DISTINCT w.owner, w.name, w.writer, r.writer AS reader FROM
            (SELECT DISTINCT m.owner, s.owner AS name, c.host AS writer FROM {calls} c JOIN {methods} m ON m.name = c.host JOIN {sites} s ON s.method = c.callee) w
            JOIN (SELECT DISTINCT m.owner, s.owner AS name, c.host AS writer FROM {calls} c JOIN {methods} m ON m.name = c.host JOIN {sites} s ON s.method = c.callee) r
            ON w.owner = r.owner AND w.name = r.name AND w.writer <> r.writer""",
    "walks": """SELECT s.method AS entry, s.method AS last, CAST(NULL AS STRING) AS via, 0 AS steps FROM {sources} s
        UNION ALL SELECT s.method, f.dst, CAST(NULL AS STRING), 1 FROM {sources} s JOIN {followers} f ON f.src = s.method
        UNION ALL SELECT s.method, g.dst, f.dst, 2 FROM {sources} s JOIN {followers} f ON f.src = s.method JOIN {followers} g ON g.src = f.dst""",
    "chains": """SELECT w.entry || '>' || w.last || '>' || c.callee || ':' || c.kind AS chain_key, b.rule_id, b.category, b.severity, m.owner AS entry_class, w.entry AS entry_method,
            CASE m.access WHEN 1 THEN 'readObject' WHEN 2 THEN 'hashCode' WHEN 4 THEN 'compareTo' WHEN 9 THEN 'main' ELSE 'toString' END AS entry_kind,
            p.owner AS sink_class, c.callee AS sink_method, b.role AS sink_role, CASE WHEN b.severity = 'HIGH' THEN 'HIGH' WHEN b.category IN ('file', 'lookup') THEN 'CONTROLLED' ELSE 'SAFE' END AS sink_risk,
            CASE WHEN c.kind = 'DYNAMIC' THEN 1 ELSE 0 END + CASE WHEN w.steps = 2 THEN 1 ELSE 0 END AS unresolved, w.steps + 1 AS n_hops, w.last, w.via, w.steps, c.kind AS call_kind
        FROM {walks} w JOIN (SELECT DISTINCT host, callee, kind FROM {calls}) c ON c.host = w.last JOIN {best} b ON b.method = c.callee AND b.role = 'TERMINAL'
        JOIN {methods} m ON m.name = w.entry JOIN {methods} p ON p.name = c.callee""",
    "hops": """SELECT chain_key, 0 AS ord, last AS from_name, sink_method AS to_name, CASE call_kind WHEN 'STATIC' THEN 'DIRECT_CALL' WHEN 'DYNAMIC' THEN 'NATIVE_CALLBACK' ELSE 'VIRTUAL_DISPATCH' END AS kind,
            CAST(NULL AS STRING) AS field, 'call-' || lower(call_kind) AS reason, CASE WHEN call_kind = 'DYNAMIC' THEN '' ELSE '(I)V' END AS descriptor FROM {chains}
        UNION ALL SELECT chain_key, 1, CASE WHEN steps = 1 THEN entry_method ELSE via END, last, CASE WHEN sink_risk = 'HIGH' THEN 'FIELD_FLOW' ELSE 'DIRECT_CALL' END,
            CASE WHEN sink_risk = 'HIGH' THEN 'next' END, 'follow', CASE WHEN sink_risk = 'SAFE' THEN '' ELSE '()V' END FROM {chains} WHERE steps >= 1
        UNION ALL SELECT chain_key, 2, entry_method, via, 'VIRTUAL_DISPATCH', CAST(NULL AS STRING), 'model:7', '()V' FROM {chains} WHERE steps = 2""",
    "notes": """SELECT chain_key, CASE entry_kind WHEN 'readObject' THEN 'pattern:first' WHEN 'hashCode' THEN 'degrade:guard-equals' WHEN 'main' THEN 'pattern:second' ELSE 'degrade:depth' END AS note FROM {chains} WHERE severity <> 'LOW'
        UNION ALL SELECT chain_key, 'degrade:conditional' FROM {chains} WHERE unresolved > 1""",
    "run_old": """SELECT chain_key, sha2_(entry_class || '|' || sink_class || '|' || severity) AS fingerprint FROM {chains} WHERE CAST(substr(entry_method, 2) AS INT) % 2 = 0 OR CAST(substr(sink_method, 2) AS INT) % 3 = 0""",
    "run_new": """SELECT chain_key, sha2_(entry_class || '|' || sink_class || '|' || CASE WHEN CAST(substr(entry_method, 2) AS INT) % 7 = 0 THEN 'CHANGED' ELSE severity END) AS fingerprint FROM {chains} WHERE CAST(substr(sink_method, 2) AS INT) % 5 <> 0""",
    "samples": """SELECT event_type AS phase, CAST(CASE WHEN value > 0 THEN floor(value) ELSE 0 END AS BIGINT) AS wall_ms FROM {events}""",
    "members": """SELECT source AS owner, doc_id AS class, sha2_(text) AS sha FROM {documents}""",
}
#: Functions that the engines spell differently.
SPARK = {"regexp_like_(": "regexp_like(", "sha2_(": "_sha256("}
DUCK = {"regexp_like_(": "regexp_matches(", "sha2_(": "sha256("}
_NAME = re.compile(r"\{(\w+)\}")


def _spark_text(sql: str) -> str:
    sql = re.sub(r"sha2_\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", r"sha2(\1, 256)", sql)
    return sql.replace("regexp_like_(", "regexp_like(")


#: Views that many queries join several times: stored once for each application and state of the tables' files.
STORED = ("best", "chains", "hops")
_stored: dict[tuple, DataFrame] = {}


class Program:
    """The views as DataFrames of one session and folder; each is built when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._known = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES and name not in VIEWS:
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet") if name in TABLES else self._stored(name) if name in STORED else self.sql(VIEWS[name])
        return self._known[name]

    def _files(self) -> tuple:
        """Paths, sizes and times of the tables' files as they are now; what was stored from others isn't used."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        system = path(self.sf_dir).getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = []
        for name in TABLES:
            at = path(f"{self.sf_dir}/{name}.parquet")
            listed = system.listFiles(at, True) if system.exists(at) else None
            while listed is not None and listed.hasNext():
                file = listed.next()
                found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
        return tuple(sorted(found))

    def _stored(self, name: str) -> DataFrame:
        return self.shared(name, lambda: self.sql(VIEWS[name]))

    def store(self, name: str) -> None:
        """From here on a view is read as stored, for a query that reads it several times."""
        self._known[name] = self.shared(name, lambda: getattr(self, name))

    def shared(self, name: str, build) -> DataFrame:
        """What ``build`` gives, stored under a name for all queries over the same files."""
        key = self.spark.sparkContext.applicationId, self._files(), name
        if key not in _stored:
            _stored[key] = cut(build())
        return _stored[key]

    def sql(self, text: str, **own: DataFrame) -> DataFrame:
        """A text over the tables and views that it names; ``own`` stand for some of them in this text."""
        return self.spark.sql(_spark_text(text), **{n: own[n] if n in own else getattr(self, n) for n in set(_NAME.findall(text))})


def duck(body: str) -> str:
    """DuckDB SQL: ``body``, which may begin with WITH, over the views that it names."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in _NAME.findall(text):
            if name in VIEWS and name not in needed:
                add(VIEWS[name])
                needed.append(name)

    add(body)
    plain = lambda t: _NAME.sub(r"\1", t)
    parts = [f"{n} AS MATERIALIZED ({plain(VIEWS[n])})" for n in needed]
    own = plain(body).strip()
    if own[:5].upper() == "WITH ":
        own = re.sub(r"^WITH (RECURSIVE )?", "", own, flags=re.IGNORECASE)
        text = "WITH RECURSIVE " + ", ".join([*parts, own])
    else:
        text = ("WITH " + ", ".join(parts) + " " if parts else "") + own
    for a, b in DUCK.items():
        text = text.replace(a, b)
    return text
