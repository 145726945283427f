"""Facts of ``pointsto`` out of what value flow finds in class files, and what follows for calls.

A variable is a parameter ``method|slot``, a result ``method|return``, a static field
``field:owner:name:type``, another origin of a method ``method|origin``, or an input of an
instruction ``method@pos:ordinal``, in which the origins of that input meet. A lambda is an
object whose fields are the arguments and the result of its interface's method: calling
that method on whatever holds the lambda stores its arguments, which the implementation's
parameters copy. So lambdas are followed wherever they are kept and passed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from . import pointsto
from .dynamic import ABSTRACT
from .hierarchy import has
from .valueflow import MOST_NESTING

_INNER = r"^4:field:[^:]+:[^:]+:[^:]+:false:<(.*)>$"


class Facts(NamedTuple):
    allocs: DataFrame  # var, site
    copies: DataFrame  # src, dst
    stores: DataFrame  # base, field, src
    loads: DataFrame  # base, field, dst
    sites: DataFrame  # site, type


def input_place(method: str = "method", pos: str = "pos", ordinal: Column | int = -1) -> Column:
    """The variable of an instruction's input; ordinal -1 is its receiver or array."""
    return F.concat(F.col(method), F.lit("@"), F.col(pos).cast("string"), F.lit(":"), (F.lit(ordinal) if isinstance(ordinal, int) else ordinal).cast("string"))


def variable(method: Column, origin: Column) -> Column:
    """The variable of an origin, null for a constant."""
    slot = F.regexp_extract(origin, "^1:param:([0-9]+)$", 1)
    return F.when(F.startswith(origin, F.lit("1:")), F.concat(method, F.lit("|"), slot)).when(F.startswith(origin, F.lit("6:")), pointsto.UNKNOWN).when(~F.startswith(origin, F.lit("5:")), F.concat(method, F.lit("|"), origin))


def _result(pos: str = "pos") -> Column:
    return F.concat(F.col("method"), F.lit("|3:call:"), F.col(pos).cast("string"))


def called(inputs: DataFrame, dispatch: DataFrame) -> DataFrame:
    """(method, pos, op, target, callee): every call with each method that it may reach, its target if none is known."""
    calls = inputs.where("op like 'INVOKE%' and op <> 'INVOKEDYNAMIC'").select("method", "pos", "op", "target").distinct()
    return calls.join(dispatch, "target", "left").withColumn("callee", F.coalesce("callee", "target"))


def facts(inputs: DataFrame, summaries: DataFrame, instructions: DataFrame, slots: DataFrame, calls: DataFrame, open_methods: DataFrame) -> Facts:
    """``inputs`` and ``summaries`` as ``valueflow`` gives them, ``instructions`` as ``classfile``, ``slots`` as ``lambda_slots``,
    ``calls`` as ``called``; the parameters of ``open_methods`` (method) may hold what analysis doesn't see."""
    used = inputs.select("method", "pos", "op", "target", "ordinal", F.explode("origins").alias("origin"))
    back = summaries.select("method", F.explode("returns").alias("origin"))
    # Fields of fields: each origin with the receivers that it names within.
    inner = lambda all_, _: F.when(F.element_at(all_, -1).rlike(_INNER), F.concat(all_, F.array(F.regexp_extract(F.element_at(all_, -1), _INNER, 1)))).otherwise(all_)
    nested = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_NESTING + 1)), F.array("origin"), inner)
    origins = used.select("method", "origin").union(back).distinct().select("method", F.explode(nested).alias("origin")).distinct()
    field = lambda i: F.regexp_extract("origin", "^4:field:([^:]+):([^:]+):([^:]+):", i)
    key = F.concat_ws(":", field(2), field(3))
    read = origins.where("origin like '4:field:%'")
    instance = read.where(F.col("origin").rlike(_INNER))
    at = lambda ordinal: input_place(ordinal=ordinal)
    method_of = F.regexp_extract("target", r"#([^(]+)\(", 1)
    owner = F.substring_index("target", "#", 1)
    # Calls of containers, by what they do with an element.
    kinds = F.create_map(*(F.lit(x) for pair in pointsto.CONTAINER_METHODS.items() for x in map(str, pair)))
    container = inputs.where("op like 'INVOKE%' and target like 'java/util/%'").select("method", "pos", "op", "target").distinct().withColumn("role", F.try_element_at(kinds, method_of)).where("role is not null")
    first = at(F.when(F.col("op") == "INVOKESTATIC", 0).otherwise(-1))
    modelled = container.where("role in ('take', 'view')").select("method", "pos")
    # Lambdas and the calls of their interfaces' methods.
    lambdas = slots.select(F.col("host").alias("method"), "pos", "interface", "sam", "impl", "part", "ordinal", "slot")
    made = lambdas.select("method", "pos", "interface", "sam", "impl").distinct()
    site = F.concat(F.col("method"), F.lit("@"), F.col("pos").cast("string"))
    invoked = inputs.where("op in ('INVOKEINTERFACE', 'INVOKEVIRTUAL')").withColumn("interface", owner).withColumn("sam", F.substring_index("target", "#", -1)).join(lambdas.select("interface", "sam").distinct(), ["interface", "sam"])
    argument = lambda ordinal: F.concat(F.lit("arg"), ordinal.cast("string"), F.lit(":"), F.col("sam"))
    result = F.concat(F.lit("result:"), F.col("sam"))
    place = F.concat(F.col("impl"), F.lit("|"), F.col("slot").cast("string"))

    arguments = inputs.where("op like 'INVOKE%' and op <> 'INVOKEDYNAMIC'").select("method", "pos", "ordinal").join(calls, ["method", "pos"])
    slot = F.when(F.col("ordinal") < 0, 0).otherwise(names.slot_of(F.regexp_extract("callee", r"(\(.*)$", 1), F.greatest("ordinal", F.lit(0)), F.col("op") == "INVOKESTATIC"))
    static_field = F.concat(F.lit("field:"), F.regexp_replace("target", "#", ":"))
    copies = (
        used.select(variable(F.col("method"), F.col("origin")).alias("src"), at(F.col("ordinal")).alias("dst")).where("src is not null")
        .union(arguments.select(at(F.col("ordinal")), F.concat(F.col("callee"), F.lit("|"), slot.cast("string"))))
        .union(lambdas.where("part = 'capture'").select(at(F.col("ordinal")), place))
        .union(calls.select(F.concat(F.col("callee"), F.lit("|return")), _result()))
        .union(inputs.where("op = 'PUTSTATIC' and ordinal = 0").select(at(0), static_field))
        .union(read.where(~F.col("origin").rlike(_INNER)).select(F.concat_ws(":", F.lit("field"), field(1), field(2), field(3)), variable(F.col("method"), F.col("origin"))))
        .union(back.select(variable(F.col("method"), F.col("origin")).alias("v"), F.concat(F.col("method"), F.lit("|return"))).where("v is not null"))
        .union(container.where("role = 'view'").select(first, _result()))
        .union(lambdas.where("part = 'argument'").select(pointsto.cell(site, argument(F.col("ordinal"))), place))
        .union(made.select(F.concat(F.col("impl"), F.lit("|return")), pointsto.cell(site, result)))
    )
    put = inputs.where("op = 'PUTFIELD' and ordinal = 0").select(at(-1).alias("base"), F.regexp_extract("target", "#(.*)$", 1).alias("field"), at(0).alias("src"))
    elements = inputs.where("op = 'AASTORE' and ordinal = 0").select(at(-1), F.lit(pointsto.ELEMENT), at(0)).union(container.where("role in ('0', '1')").select(at(-1), F.lit(pointsto.ELEMENT), at(F.col("role"))))
    stores = put.union(elements).union(invoked.where("ordinal >= 0").select(at(-1), argument(F.col("ordinal")), at(F.col("ordinal"))))
    loads = (
        instance.select(variable(F.col("method"), F.regexp_extract("origin", _INNER, 1)).alias("base"), key.alias("field"), variable(F.col("method"), F.col("origin")).alias("dst")).where("base is not null")
        .union(inputs.where("op = 'AALOAD'").select(at(-1), F.lit(pointsto.ELEMENT), F.concat(F.col("method"), F.lit("|2:insn:"), F.col("pos").cast("string"))))
        .union(container.where("role = 'take'").select(at(-1), F.lit(pointsto.ELEMENT), _result()))
        .union(invoked.where("ordinal = -1").select(at(-1), result, _result()))
    )
    new = instructions.where("op in ('NEW', 'NEWARRAY')").select(F.concat(F.col("class"), F.lit("#"), F.col("method"), F.col("descriptor")).alias("method"), "pos", F.when(F.col("op") == "NEW", F.col("owner")).otherwise(F.concat(F.lit("[]"), F.col("owner"))).alias("type"))
    # Results of methods that aren't loaded and that no model describes.
    loaded = summaries.select(F.col("method").alias("callee"))
    away = calls.join(loaded, "callee", "left_anti").select("method", "pos").distinct().join(modelled, ["method", "pos"], "left_anti").join(invoked.select("method", "pos").distinct(), ["method", "pos"], "left_anti")
    parameters = summaries.join(open_methods, "method", "left_semi").select("method", F.explode(F.sequence(F.lit(0), names.slots(F.regexp_extract("method", r"(\(.*)$", 1)))).alias("slot"))
    unknown = F.lit(pointsto.UNKNOWN)
    allocs = (
        new.select(F.concat(F.col("method"), F.lit("|2:insn:"), F.col("pos").cast("string")).alias("var"), site.alias("site"))
        .union(made.select(_result(), site))
        .union(away.select(_result(), unknown))
        .union(parameters.select(F.concat(F.col("method"), F.lit("|"), F.col("slot").cast("string")), unknown))
        .union(inputs.sparkSession.range(1).select(unknown, unknown))
    )
    return Facts(allocs, copies.distinct(), stores.distinct(), loads.distinct(), new.select(site.alias("site"), "type").union(made.select(site, "interface")).distinct())


def narrowed(calls: DataFrame, pts: DataFrame, sites: DataFrame, pairs: DataFrame, methods: DataFrame) -> DataFrame:
    """``calls`` without the callees that no object in the receiver leads to; calls whose receiver isn't fully known keep all."""
    virtual = calls.where("op in ('INVOKEVIRTUAL', 'INVOKEINTERFACE')").withColumn("var", input_place())
    types = pointsto.types_of(pts, sites).select("var", "type")
    own = methods.where(~has(F.col("access"), ABSTRACT)).select(F.col("owner").alias("at"), F.concat("name", "descriptor").alias("signature"), "method")
    asked = virtual.select("var", F.substring_index("target", "#", -1).alias("signature")).distinct().join(types, "var").select("type", "signature").distinct()
    up = pairs.select(F.col("descendant").alias("type"), F.col("ancestor").alias("at"), "depth")
    above = asked.withColumn("at", F.col("type")).withColumn("depth", F.lit(0)).unionByName(asked.join(up, "type").select("type", "signature", "at", "depth"))
    nearest = above.join(own.withColumnRenamed("method", "callee"), ["at", "signature"]).groupBy("type", "signature").agg(F.min(F.struct("depth", "callee")).alias("m")).select("type", "signature", "m.callee")
    fits = virtual.select("method", "pos", "var", F.substring_index("target", "#", -1).alias("signature")).distinct().join(types, "var").join(nearest, ["type", "signature"]).select("method", "pos", "callee").distinct()
    known = virtual.join(types.select("var").distinct(), "var", "left_semi").select("method", "pos").distinct()
    return calls.join(known, ["method", "pos"], "left_anti").unionByName(calls.join(fits, ["method", "pos", "callee"], "left_semi").select(*calls.columns))


def lambda_flow(inputs: DataFrame, slots: DataFrame, pts: DataFrame, placed: DataFrame) -> DataFrame:
    """(src, dst, reason) for ``valueflow.flow_edges``: captured values go to their lambda's implementation, and so do the
    arguments of calls on a receiver that can hold it; its result goes to theirs. ``placed`` has the inputs with their ``src``."""
    into = F.concat(F.col("impl"), F.lit("|"), F.col("slot").cast("string")).alias("dst")
    capture = placed.where("op = 'INVOKEDYNAMIC'").join(slots.where("part = 'capture'").select(F.col("host").alias("method"), "pos", "ordinal", "impl", "slot"), ["method", "pos", "ordinal"])
    made = slots.select(F.concat(F.col("host"), F.lit("@"), F.col("pos").cast("string")).alias("site"), "interface", "sam", "impl", "part", "ordinal", "slot")
    call = inputs.where("op in ('INVOKEINTERFACE', 'INVOKEVIRTUAL') and ordinal = -1").select("method", "pos", "target", input_place().alias("var"), F.substring_index("target", "#", -1).alias("sam"))
    held = call.join(pts, "var").join(made.withColumnRenamed("ordinal", "n"), ["site", "sam"])
    passed = placed.where("op in ('INVOKEINTERFACE', 'INVOKEVIRTUAL')").select("method", "pos", F.col("ordinal").alias("n"), "src").join(held.where("part = 'argument'").select("method", "pos", "n", "impl", "slot"), ["method", "pos", "n"])
    returned = call.join(pts, "var").join(made.select("site", "sam", "impl").distinct(), ["site", "sam"]).select(F.concat(F.col("impl"), F.lit("|return")).alias("src"), F.concat(F.col("target"), F.lit("|return")).alias("dst"))
    edges = capture.select("src", into, F.lit("lambda-capture").alias("reason")).union(passed.select("src", into, F.lit("lambda-argument"))).union(returned.select("src", "dst", F.lit("lambda-result")))
    return edges.distinct()


class Labelled(NamedTuple):
    """Edges between variables for ``matched``: within methods, into callees and back by call site, and global places."""

    flow: DataFrame  # src, dst
    calls: DataFrame  # site, src, dst
    returns: DataFrame  # site, src, dst
    globals_: DataFrame  # node


def labelled(inputs: DataFrame, summaries: DataFrame, calls: DataFrame, slots: DataFrame, pts: DataFrame, models: DataFrame) -> Labelled:
    """How values get from variable to variable, with the site of each call and return.

    ``models`` (target, ordinal, into) says what a call of a method that isn't loaded does: the
    input of this ordinal goes into its result (``return``) or into another input, by its ordinal.
    """
    used = inputs.select("method", "pos", "op", "target", "ordinal", F.explode("origins").alias("origin"))
    back = summaries.select("method", F.explode("returns").alias("origin"))
    at = lambda ordinal: input_place(ordinal=ordinal)
    local = variable(F.col("method"), F.col("origin"))
    fields = used.select("method", "origin").union(back).where("origin like '4:field:%'").distinct().select(F.concat(F.lit("field:"), F.regexp_extract("origin", "^4:field:([^:]+:[^:]+:[^:]+):", 1)).alias("src"), local.alias("dst"))
    written = inputs.where("op in ('PUTFIELD', 'PUTSTATIC') and ordinal = 0").select(at(0).alias("src"), F.concat(F.lit("field:"), F.regexp_replace("target", "#", ":")).alias("dst"))
    modelled = inputs.where("op like 'INVOKE%'").select("method", "pos", "target", "ordinal").join(models, ["target", "ordinal"])
    given = modelled.where("into = 'return'").select(at(F.col("ordinal")).alias("src"), _result().alias("dst"))
    # What a call puts into another input is in all that this input may be.
    put = modelled.where("into <> 'return'").select("method", "pos", at(F.col("ordinal")).alias("src"), F.col("into").cast("int").alias("ordinal"))
    put = put.join(used.select("method", "pos", "ordinal", "origin"), ["method", "pos", "ordinal"]).select("src", local.alias("dst"))
    known = F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != pointsto.UNKNOWN) & (F.col("dst") != pointsto.UNKNOWN)
    flow = used.select(local.alias("src"), at(F.col("ordinal")).alias("dst")).union(back.select(local, F.concat(F.col("method"), F.lit("|return")))).union(fields).union(written).union(given).union(put).where(known)
    site = F.concat(F.col("method"), F.lit("@"), F.col("pos").cast("string")).alias("site")
    arguments = inputs.where("op like 'INVOKE%' and op <> 'INVOKEDYNAMIC'").select("method", "pos", "ordinal").join(calls, ["method", "pos"])
    slot = F.when(F.col("ordinal") < 0, 0).otherwise(names.slot_of(F.regexp_extract("callee", r"(\(.*)$", 1), F.greatest("ordinal", F.lit(0)), F.col("op") == "INVOKESTATIC"))
    into = F.concat(F.col("impl"), F.lit("|"), F.col("slot").cast("string")).alias("dst")
    captured = slots.where("part = 'capture'").select(F.col("host").alias("method"), "pos", "ordinal", "impl", "slot")
    made = slots.select(F.concat(F.col("host"), F.lit("@"), F.col("pos").cast("string")).alias("made"), "sam", "impl", "part", "ordinal", "slot")
    call = inputs.where("op in ('INVOKEINTERFACE', 'INVOKEVIRTUAL') and ordinal = -1").select("method", "pos", input_place().alias("var"), F.substring_index("target", "#", -1).alias("sam"))
    held = call.join(pts.select("var", F.col("site").alias("made")), "var").join(made, ["made", "sam"])
    ins = (
        arguments.select(site, at(F.col("ordinal")).alias("src"), F.concat(F.col("callee"), F.lit("|"), slot.cast("string")).alias("dst"))
        .union(captured.select(site, at(F.col("ordinal")), into))
        .union(held.where("part = 'argument'").select(site, at(F.col("ordinal")), into))
    )
    outs = calls.select(site, F.concat(F.col("callee"), F.lit("|return")).alias("src"), _result().alias("dst")).union(held.select(site, F.concat(F.col("impl"), F.lit("|return")), _result()))
    return Labelled(flow.distinct(), ins.distinct(), outs.distinct(), fields.select(F.col("src").alias("node")).union(written.select("dst")).distinct())
