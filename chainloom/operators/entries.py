"""Application entries: which methods the outside can start, and with what control over their inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hierarchy import PROTECTED, PUBLIC, STATIC, has

#: Fixed names of the frameworks' interfaces and annotations.
HTTP_HANDLER, SERVLET = "com/sun/net/httpserver/HttpHandler", ("javax/servlet/Servlet", "jakarta/servlet/Servlet", "javax/servlet/http/HttpServlet", "jakarta/servlet/http/HttpServlet")
LIFECYCLE = ("service", "doGet", "doPost", "doPut", "doDelete", "doHead", "doOptions", "doTrace", "init")
MAPPED = ("RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "Path", "GET", "POST", "PUT", "DELETE")
SERVICE_TYPE, SERVICE_METHOD = ("WebService",), ("WebMethod",)


def _any(annotations: Column, names: tuple[str, ...]) -> Column:
    return F.exists(annotations, lambda a: F.regexp_extract(a, r"([^/;]+);?$", 1).isin(*names))


def entries(methods: DataFrame, pairs: DataFrame) -> DataFrame:
    """(owner, name, descriptor, entry_kind, controlled), the first kind that fits.

    ``methods`` has owner, name, descriptor, access, annotations and class_annotations, all
    arrays possibly empty; ``pairs`` is the type closure. In order: main, which proves no
    control over its inputs; HTTP handlers; servlet methods, controlled if they take a
    reference; mapped public methods; public service operations, controlled if the method
    itself is marked.
    """
    below = lambda names, flag: pairs.where(F.col("ancestor").isin(*names)).select(F.col("descendant").alias("owner")).distinct().withColumn(flag, F.lit(True))
    m = methods.join(below((HTTP_HANDLER,), "handler"), "owner", "left").join(below(SERVLET, "servlet"), "owner", "left")
    access, public = F.col("access"), has(F.col("access"), PUBLIC)
    main = public & has(access, STATIC) & (F.col("name") == "main") & (F.col("descriptor") == "([Ljava/lang/String;)V")
    handle = F.coalesce("handler", F.lit(False)) & (F.col("name") == "handle")
    servlet = F.coalesce("servlet", F.lit(False)) & F.col("name").isin(*LIFECYCLE) & (public | has(access, PROTECTED))
    mapped = public & _any(F.col("annotations"), MAPPED)
    service = public & (_any(F.col("class_annotations"), SERVICE_TYPE) | _any(F.col("annotations"), SERVICE_METHOD))
    kind = F.when(main, "lifecycle-main").when(handle, "http-handler").when(servlet, "servlet-lifecycle").when(mapped, "framework-http").when(service, "framework-service")
    control = F.when(F.col("entry_kind") == "lifecycle-main", False).when(F.col("entry_kind") == "servlet-lifecycle", F.col("descriptor").rlike(r"^\([^)]*L")).when(F.col("entry_kind") == "framework-service", _any(F.col("annotations"), SERVICE_METHOD)).otherwise(True)
    return m.withColumn("entry_kind", kind).where("entry_kind is not null").select("owner", "name", "descriptor", "entry_kind", control.alias("controlled"))


def resource_entries(routes: DataFrame, methods: DataFrame) -> DataFrame:
    """(route, owner, name, descriptor): bindings of a route to a method that has exactly one overload."""
    named = methods.groupBy("owner", "name").agg(F.count(F.lit(1)).alias("n"), F.min("descriptor").alias("descriptor")).where("n = 1")
    return routes.join(named, ["owner", "name"]).select("route", "owner", "name", "descriptor")
