import math
import random

import numpy as np
from pyspark.sql import functions as F

from parapet.functions import geometry as g


def ring(pts):
    return "array(" + ", ".join(g.point(x, y) for x, y in pts) + ")"


def one(spark, *exprs):
    return spark.range(1).select(*[F.expr(e).alias(f"c{i}") for i, e in enumerate(exprs)]).first()


L_SHAPE = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4), (0, 0)]


def test_area_and_bad_rings(spark):
    r = one(spark, g.area(ring(L_SHAPE)), g.area(ring([(0, 0), (1, 1)])), g.ring_ok(ring([(0, 0), (1, 1)])))
    assert r[0] == 12.0 and r[1] is None and r[2] is False


def test_rotated_rectangle_short_side(spark):
    a = 0.3
    pts = [(x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a)) for x, y in [(0, 0), (5, 0), (5, 2), (0, 2), (0, 0)]]
    assert abs(one(spark, g.mrr_short(ring(pts)))[0] - 2.0) < 1e-9


def test_within_non_convex(spark):
    inside, notch, touch = ring([(0.5, 0.5), (1.5, 0.5), (1.5, 3.5), (0.5, 3.5)]), ring([(1, 1), (3, 1), (3, 3), (1, 3)]), ring([(0, 0), (4, 0), (4, 2), (0, 2)])
    z = ring(L_SHAPE)
    r = one(spark, g.within(inside, z), g.within(notch, z), g.within(touch, z))
    assert tuple(r) == (True, False, True)


def test_point_in_polygon_excludes_outline(spark):
    z = ring(L_SHAPE)
    assert tuple(one(spark, g.pip("1D", "3D", z), g.pip("3D", "3D", z), g.pip("0D", "1D", z))) == (True, False, False)


def test_distance_general(spark):
    tri = ring([(2, 2), (4, 2), (3, 4), (2, 2)])
    r = one(spark, g.line_poly_dist(g.line(0, 0, 6, 0), tri), g.line_poly_dist(g.line(0, 0, 4, 4), tri), g.line_poly_dist(g.line(0, 1, 1, 0), tri))
    assert r[0] == 2.0 and r[1] == 0.0 and abs(r[2] - 3 / math.sqrt(2)) < 1e-12


def test_inset_and_clip_of_a_triangle(spark):
    tri = ring([(0, 0), (4, 0), (0, 3), (0, 0)])
    r = one(spark, g.area(g.inset(tri, "0.5D")), g.inset(tri, "1.5D"), g.area(g.clip_rect(tri, "named_struct('xmin', 0D, 'ymin', 0D, 'xmax', 2D, 'ymax', 3D)")))
    # inradius is 1, so half of it leaves a similar triangle of half the size
    assert abs(r[0] - 1.5) < 1e-9 and r[1] is None and abs(r[2] - 4.5) < 1e-9


def test_hull_matches_brute_force(spark):
    from parapet.operators.hull import hull

    rnd = random.Random(7)
    pts = [(k, float(rnd.randint(0, 12)), float(rnd.randint(0, 12))) for k in range(3) for _ in range(60)]
    got = hull(spark.createDataFrame(pts, "k int, x double, y double").repartition(4), "k").collect()
    for k in range(3):
        mine = {(r.x, r.y) for r in got if r.k == k}
        p = np.array(sorted({(x, y) for kk, x, y in pts if kk == k}))
        want = set()
        for a in p:
            for b in p:
                if (a == b).all():
                    continue
                cross = (b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0])
                on = p[cross == 0]
                if (cross >= 0).all():
                    want |= {tuple(on.min(axis=0) if (b - a)[0] * (b - a)[1] >= 0 else on[on[:, 0].argmin()]), tuple(on.max(axis=0) if (b - a)[0] * (b - a)[1] >= 0 else on[on[:, 0].argmax()])}
        assert mine == want


def test_hull_has_no_call_per_key(spark):
    from parapet.operators.hull import hull

    pts = spark.range(40).selectExpr("id div 4 as k", "cast(id % 2 as double) as x", "cast((id div 2) % 2 as double) as y")
    h = hull(pts, "k")
    assert "FlatMapGroupsInPandas" not in h._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r.n for r in h.groupBy("k").agg({"pos": "count"}).toDF("k", "n").collect()} == dict.fromkeys(range(10), 4)
