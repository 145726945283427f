"""What of the inputs belongs to a scan: scopes, the closure of needed classes, header and native indexes, routes of resources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fixpoint

WEB_XML = "`servlet` array<struct<`servlet-name`: string, `servlet-class`: string>>, `servlet-mapping` array<struct<`servlet-name`: string, `url-pattern`: string>>"


def scoped(classes: DataFrame, application: DataFrame) -> DataFrame:
    """``classes`` with ``scope``: application for those of an application artifact, dependency for others; a class of both is the application's."""
    own = classes.join(application.select("artifact").distinct().withColumn("app", F.lit(1)), "artifact", "left")
    return own.groupBy("class").agg(F.when(F.max(F.coalesce("app", F.lit(0))) == 1, "application").otherwise("dependency").alias("scope"))


def headers(classes: DataFrame) -> DataFrame:
    """(class, super, interfaces, refers): what the choice of classes needs of each; bodies aren't read."""
    return classes.select("class", "super", "interfaces")


def needed(seeds: DataFrame, heads: DataFrame, rounds: int = 64) -> tuple[DataFrame, bool]:
    """(class, depth): seeds and all that they extend or implement, as far as it is there, and whether that was all."""
    up = heads.select(F.col("class").alias("src"), F.explode(F.array_compact(F.concat(F.array("super"), F.coalesce("interfaces", F.array().cast("array<string>"))))).alias("dst"))
    found, ended = fixpoint.least_depth(seeds.select(F.col("class").alias("node")), up, rounds)
    return found.join(heads.select(F.col("class").alias("node")), "node", "left_semi").select(F.col("node").alias("class"), "depth"), ended


def native_methods(methods: DataFrame) -> DataFrame:
    """(owner, names): the native methods of each class, in order."""
    return methods.where(F.col("access").bitwiseAND(0x100) != 0).groupBy("owner").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def web_routes(resources: DataFrame) -> DataFrame:
    """(origin, route, owner): routes that web descriptors give to servlet classes; what isn't such XML gives none."""
    parsed = resources.withColumn("x", F.from_xml("text", WEB_XML, {"mode": "PERMISSIVE"}))
    classes = parsed.select("origin", F.explode("x.servlet").alias("s")).select("origin", F.col("s.servlet-name").alias("name"), F.trim("s.servlet-class").alias("owner"))
    routes = parsed.select("origin", F.explode("x.servlet-mapping").alias("m")).select("origin", F.col("m.servlet-name").alias("name"), F.trim("m.url-pattern").alias("route"))
    return routes.join(classes, ["origin", "name"]).select("origin", "route", F.translate("owner", ".", "/").alias("owner")).distinct()
