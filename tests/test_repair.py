import pytest
from pyspark.sql import functions as F

from parapet.catalog import QUERIES
from parapet.functions import geometry as g
from parapet.operators import repair as r
from parapet.plans import repair as plan
from parapet.plans.evaluate import evaluate
from parapet.session import cut_lineage
from parapet.sources.packs import read_packs


@pytest.fixture(scope="module")
def solved(spark, tables):
    t = {k: v.filter("model_id = 2") for k, v in tables.items()}
    rules = read_packs(spark)
    base = cut_lineage(evaluate(t, rules))
    v = base.filter("status = 'violation'")
    return plan.search(t, base, v, rules).collect()


def best(solved, word):
    return min((c for c in solved if word in c.rule_id), key=lambda c: (c.area_lost_sqm, c.cand_order))


def test_rear_setback_clears_at_least_cost(solved):
    c = best(solved, ".setback.")
    assert (c.edge, round(c.delta_m, 2), round(c.area_lost_sqm, 2)) == ("rear", 0.2, 1.7)


def test_containment_clears_at_least_cost(solved):
    c = best(solved, ".containment.")
    assert (c.edge, round(c.delta_m, 2), round(c.area_lost_sqm, 2)) == ("rear", 1.2, 10.2)


def test_cap_keeps_enumeration_order(spark, tables):
    t = {k: v.filter("model_id = 2") for k, v in tables.items()}
    v = evaluate(t, read_packs(spark)).filter("status = 'violation'")
    x = r.cap_candidates(r.edit_grid(v, t), 50)
    rows = x.filter("rule_id like '%containment%'").orderBy("cand_order").collect()
    assert len(rows) == 50
    assert [(c.edge, c.delta_m) for c in rows[:2]] == [("front", 0.1), ("front", 0.2)]
    assert rows[30].edge == "rear"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stairs_shift_inside_any_plot(spark):
    pt = lambda *xy: [(float(x), float(y)) for x, y in xy]
    square = lambda x, y: pt((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y))
    shapes = {1: square(0, 0), 2: pt((0, 0), (4, 0), (4, 4), (0, 4)), 3: pt((0, 0), (8, 0), (0, 8)), 4: pt((0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6)), 5: None}
    plots = spark.createDataFrame(list(shapes.items()), f"model_id bigint, plot_polygon {g.RING}")
    at = [(m, i, use, None if i == 9 else square(x, y)) for m in shapes for i, (use, x, y) in enumerate([("stair", 0, 0), ("stair", 1, 1), ("stair", 3, 3), ("stair", 0.9, 0.9), ("stair", 1, 5), ("bedroom", 1, 1), ("stair", 2.8, 0.5), ("stair", 3.2, 2.7), ("stair", 0.1, 4.7), ("stair", 0, 0)])]
    rooms = spark.createDataFrame(at, f"model_id bigint, room_index int, use string, polygon {g.RING}")
    got = r.shift_stair(rooms, plots)
    # every offset as a row, then the whole test on the moved ring
    offs = [(10 + 4 * i + j, x, y) for i, x in enumerate(r.STAIR_OFFSETS) for j, y in enumerate(r.STAIR_OFFSETS)]
    every = rooms.filter("use = 'stair'").join(plots, "model_id").crossJoin(spark.createDataFrame(offs, "k int, dx double, dy double"))
    want = every.withColumn("moved", F.expr(g.translate("polygon", "dx", "dy"))).withColumn("ok", F.expr(g.within("moved", "plot_polygon"))).filter("ok")
    cols = ["model_id", "room_index", "k", "dx", "dy", "moved"]
    got, want = (sorted(map(str, x.select(cols).collect())) for x in (got, want))
    assert got == want and {x[:14] for x in want} >= {f"Row(model_id={m}" for m in (2, 3, 4)}


def test_edits_are_measured_once(spark):
    sf = "/root/testdata/sf0.001"
    # an offset that leaves the plot made a row and was moved anew in each comparison
    assert _plan(QUERIES["M06_shift_stair"](spark, sf)).count("transform(polygon") <= 2
    # all floors of a model were joined to all its edits, and summed
    plan_ = _plan(QUERIES["M10_area_lost"](spark, sf))
    assert "Aggregate" not in plan_ and plan_.count("SortMergeJoin") == 2
