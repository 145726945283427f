"""Column functions on names, and plans of phases."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from chainloom.functions import names
from chainloom.plans import phases
from chainloom.plans.views import Program

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_names(spark):
    one = lambda f, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(f(*(F.col(f"c{i}") for i in range(len(v)))).alias("x")).first().x
    assert [one(names.type_id, v) for v in ("a.b.C", "La/b/C;", " a/b/C ", None)] == ["a/b/C", "a/b/C", "a/b/C", None]
    assert [one(names.package_of, v) for v in ("a/b/C", "C", "")] == ["a/b", "", ""]
    assert one(lambda c: names.package_prefix(c, 2), "a/b/c/D") == "a/b"
    assert one(names.parameter_types, "(I[[JLa/B;D)V") == ["I", "[[J", "La/B;", "D"] and one(names.return_type, "()[La/B;") == "[La/B;"
    assert one(names.slots, "(I[[JLa/B;DJ)V") == 7
    assert [one(lambda c, i=i: names.slot_of(c, F.lit(i), F.lit(False)), "(IJD)V") for i in range(3)] == [1, 2, 4]
    assert one(names.referenced_types, "Ljava/util/Map<La/K;Ljava/util/List<La/V;>;>;") == ["a/K", "a/V", "java/util/List", "java/util/Map"]
    assert [tuple(one(names.model_source, v)) for v in ("this", "arg12", "element(arg0)", "element(this)", "arg", "x", "element(arg1")] == [("this", None, False), ("arg", 12, False), ("arg", 0, True), ("this", None, True), (None, None, False), (None, None, False), (None, None, False)]


def op(id, phase="ANALYSIS", needs=(), gives=(), **more):
    return phases.Operator(id, phase, lambda x: {g: (id, sorted(x)) for g in gives}, needs, gives, **more)


def test_plans_run_in_order_of_needs():
    plan = [op("z", gives=("a",), priority=1), op("b", needs=("a", "in"), gives=("b",), priority=0), op("c", "COMPOSITION", needs=("b",), gives=("c",))]
    out = phases.run(plan, {"in": 1})
    assert out.order == ["z", "b", "c"] and not out.reasons and out.products["b"] == ("b", ["a", "in"])
    assert phases.digest(plan) == phases.digest(plan[::-1]) != phases.digest(plan[:2])


@pytest.mark.parametrize("plan", [[op("a"), op("a")], [op("a", gives=("x",)), op("b", gives=("x",))], [op("a", needs=("x",))], [op("a", needs=("x",)), op("b", "COMPOSITION", gives=("x",))], [op("a", needs=("x",), gives=("y",)), op("b", needs=("y",), gives=("x",))], [op("a", "LATER")], [op("a", contract=9)]])
def test_unsound_plans_are_refused(plan):
    with pytest.raises(phases.PlanError):
        phases.validate(plan)


def test_failures_are_reasons():
    def fail(_):
        raise RuntimeError

    out = phases.run([phases.Operator("f", "ANALYSIS", fail, (), ("x",)), op("g", needs=("x",), gives=("y",)), phases.Operator("w", "ANALYSIS", lambda _: {}, (), ("q",)), op("h", gives=("z",))], {})
    assert out.reasons == {"SOURCE_FAILED:f:RuntimeError", "SKIPPED:g", "WRONG_PRODUCTS:w"} and out.order == ["h"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stored_views_follow_their_files(spark, tmp_path):
    at = tmp_path / "sf"
    shutil.copytree(SF, at)
    count = lambda: Program(spark, str(at)).chains.count()
    before = count()
    assert before > 0 and count() == before
    orders = spark.read.parquet(f"{SF}/orders.parquet").limit(30).cache()
    orders.count()
    os.remove(at / "orders.parquet")
    orders.write.parquet(str(at / "orders.parquet"))
    assert count() < before
