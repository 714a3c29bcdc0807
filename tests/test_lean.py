"""Findings are decided once, and hold no more than the query reads."""

from pyspark.sql import functions as F

from parapet.catalog import QUERIES
from parapet.functions import geometry as g
from parapet.operators import checks as c

SF = "/root/testdata/sf0.001"


def test_findings_are_not_built_to_be_filtered(spark):
    plan = QUERIES["E08_projection_max"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "projection_max" in plan
    assert not [x for x in plan.splitlines() if "Filter " in x and "struct(item" in x]


def test_unread_fields_are_null():
    with c.only("title"):
        some = c.make("'pass'", obs="height", suffix="' (x)'")
    assert "height" not in some and "(x)" in some
    assert "height" in c.make("'pass'", obs="height")


def test_usual_rings_measure_like_others(spark):
    ring = [(0.1, 0.2), (7.3, 0.2), (7.3, 4.7), (0.1, 4.7), (0.1, 0.2)]
    rows = [(ring,), ([*ring[:2], (None, 1.0), *ring[3:]],), (ring[:4],), (ring[:2],), (None,)]
    df = spark.createDataFrame(rows, f"r {g.RING}")
    # a ring that is not a plain name takes the general path
    got = df.select(F.expr(g.area("r")).alias("a"), F.expr(g.bounds("r")).alias("b"), F.expr(g.area("coalesce(r, r)")).alias("a2"), F.expr(g.bounds("coalesce(r, r)")).alias("b2")).collect()
    assert [(x.a, x.b) for x in got] == [(x.a2, x.b2) for x in got]
    assert "aggregate" not in g.bounds("r").split(" else ")[0]
