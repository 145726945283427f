"""Typed facts about well-known calls, from the inputs that value flow gives.

Input tables are those of ``valueflow.call_inputs``: method, pos, op, target, ordinal and
origins. A fact names its place and what is known of the values; what isn't known is null,
and ``status`` says PROVED where there is exactly one origin of the needed kind, PARTIAL
where it is one of several, UNKNOWN else. Two values are the same if they come from the same
instruction or call of one method; ``identity`` is that origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed names of the platform's interfaces: fact, owner, method, ordinal of the value that matters.
CALLS = (
    ("class-lookup", "java/lang/Class", "forName", 0),
    ("object-read", "java/io/ObjectInputStream", "readObject", -1),
    ("object-read", "java/io/ObjectInputStream", "readUnshared", -1),
    ("proxy", "java/lang/reflect/Proxy", "newProxyInstance", 2),
    ("reflective-call", "java/lang/reflect/Method", "invoke", 0),
    ("reflective-new", "java/lang/reflect/Constructor", "newInstance", -1),
    ("naming-lookup", "javax/naming/Context", "lookup", 0),
    ("naming-lookup", "javax/naming/InitialContext", "lookup", 0),
    ("naming-reference", "javax/naming/Reference", "<init>", 1),
    ("connection", "java/sql/DriverManager", "getConnection", 0),
    ("connection", "java/sql/Driver", "connect", 0),
    ("login", "javax/security/auth/login/LoginContext", "<init>", 0),
    ("naming-search", "javax/naming/directory/DirContext", "search", 0),
    ("naming-next", "javax/naming/NamingEnumeration", "next", -1),
    ("remote-proxy", "com/caucho/hessian/client/HessianProxyFactory", "create", 1),
    ("http-context", "com/sun/net/httpserver/HttpServer", "createContext", 1),
)


def _of(kind: str) -> Column:
    return F.filter("origins", lambda o: F.startswith(o, F.lit(kind)))


def call_facts(inputs: DataFrame, calls=CALLS) -> DataFrame:
    """(fact, method, pos, target, identity, constant, status) of every call in the list."""
    spark = inputs.sparkSession
    known = F.broadcast(spark.createDataFrame(list(calls), "fact string, owner string, called string, ordinal int"))
    split = inputs.where("op like 'INVOKE%'").withColumn("owner", F.substring_index("target", "#", 1)).withColumn("called", F.regexp_extract("target", r"#([^(]+)\(", 1))
    met = split.join(known, ["owner", "called", "ordinal"])
    constants = _of("5:constant:string:")
    constant = F.when(F.size(constants) >= 1, F.regexp_replace(constants[0], "^5:constant:string:", ""))
    status = F.when((F.size("origins") == 1) & (F.col("origins")[0] != "6:unknown"), "PROVED").when(F.array_contains("origins", "6:unknown") & (F.size("origins") == 1), "UNKNOWN").otherwise("PARTIAL")
    return met.select("fact", "method", "pos", "target", F.when(F.size("origins") == 1, F.col("origins")[0]).alias("identity"), constant.alias("constant"), status.alias("status"))


def same_value(facts: DataFrame, inputs: DataFrame, ordinal: int = -1) -> DataFrame:
    """(fact, made_at, method, used_at, target, status): calls whose receiver (or other input) is the result of
    a fact's call in the same method: PROVED if it can be nothing else."""
    used = inputs.where(F.col("ordinal") == ordinal).select("method", F.col("pos").alias("used_at"), F.col("target").alias("called"), F.explode("origins").alias("origin"), (F.size("origins") == 1).alias("only"))
    made = facts.select("fact", "method", F.col("pos").alias("made_at"), F.concat(F.lit("3:call:"), F.col("pos").cast("string")).alias("origin"))
    met = made.join(used, ["method", "origin"])
    return met.select("fact", "made_at", "method", "used_at", F.col("called").alias("target"), F.when(F.col("only"), "PROVED").otherwise("PARTIAL").alias("status"))


def reflective_targets(inputs: DataFrame, methods: DataFrame) -> DataFrame:
    """(method, pos, callee): reflective calls whose class and method names are constants of the calling method.

    A name counts from the last ``forName`` and ``getMethod`` at or before the call; ``methods`` has method as
    ``owner#namedescriptor``.
    """
    facts = call_facts(inputs, (*CALLS, ("method-lookup", "java/lang/Class", "getMethod", 0), ("method-lookup", "java/lang/Class", "getDeclaredMethod", 0)))
    from pyspark.sql import Window

    before = Window.partitionBy("method").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda fact: F.last(F.when(F.col("fact") == fact, F.col("constant")), ignorenulls=True).over(before)
    seen = facts.withColumn("owner", F.regexp_replace(last("class-lookup"), r"\.", "/")).withColumn("name", last("method-lookup")).where("fact = 'reflective-call' and owner is not null and name is not null")
    declared = methods.select(F.col("method").alias("callee"), F.substring_index("method", "#", 1).alias("owner"), F.regexp_extract("method", r"#([^(]+)\(", 1).alias("name"))
    return seen.join(declared, ["owner", "name"]).select("method", "pos", "callee")


def boundary(fact: Column) -> Column:
    """Direction and kind of the trust boundary that a fact stands for."""
    return F.when(fact == "object-read", "IN:deserialize").when(fact.isin("naming-lookup", "naming-reference"), "IN:naming").when(fact == "connection", "OUT:database").when(fact == "login", "IN:identity").otherwise("NONE")
