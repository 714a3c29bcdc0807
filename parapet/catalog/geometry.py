"""Queries for the geometry scalars (D1-D14) and point in layer (C11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parapet.catalog.base import query, with_model
from parapet.functions import geometry as g
from parapet.functions import polygons
from parapet.operators import gis
from parapet.operators.hull import box_corners, hull
from parapet.session import spread
from parapet.sources import derived as d

_KEY = ("model_id", "floor_pos")


def _floors(spark, sf_dir, *exprs):
    return d.floors(spark, sf_dir).selectExpr(*_KEY, *exprs)


def _with_plot(spark, sf_dir):
    p = d.plots(spark, sf_dir).select("model_id", "w", "l", "zoned_area", "plot_polygon")
    return d.floors(spark, sf_dir).join(spread(p), "model_id")


_CUT = "slice(footprint, 1, cast(model_id % 5 + 1 as int))"


@query("D01_ring_ok", with_model("SELECT model_id, floor_pos, model_id % 5 >= 2 AS ok FROM floors"))
def d01(spark, sf_dir):
    return _floors(spark, sf_dir, f"{_CUT} as cut").selectExpr(*_KEY, g.ring_ok("cut") + " as ok")


@query("D02_area", with_model("SELECT model_id, floor_pos, CASE WHEN model_id % 5 < 2 THEN NULL WHEN model_id % 5 = 2 THEN area / 2 ELSE area END AS area FROM floors"))
def d02(spark, sf_dir):
    return _floors(spark, sf_dir, f"{_CUT} as cut").selectExpr(*_KEY, g.area("cut") + " as area")


@query("D03_bounds", with_model("SELECT model_id, floor_pos, x0 AS xmin, y0 AS ymin, x1 AS xmax, y1 AS ymax, x1 - x0 AS width, y1 - y0 AS depth FROM floors"))
def d03(spark, sf_dir):
    return _floors(spark, sf_dir, g.bounds("footprint") + " as b").selectExpr(*_KEY, "b.*", g.width("b") + " as width", g.depth("b") + " as depth")


@query("D04_mrr_short", with_model("SELECT model_id, floor_pos, least(x1 - x0, y1 - y0) AS short_side FROM floors"))
def d04(spark, sf_dir):
    return _floors(spark, sf_dir, g.mrr_short("footprint") + " as short_side")


@query("D05_within", with_model("SELECT model_id, floor_pos, CASE WHEN has_zone THEN x0 >= 1.5 AND y0 >= 3 AND x1 <= w - 1.5 AND y1 <= l - 3 END AS in_zone, l * x1 + w * y1 <= 2 * w * l AS in_triangle FROM floors JOIN plots USING (model_id)"))
def d05(spark, sf_dir):
    tri = f"array({g.point(0, 0)}, {g.point('2 * w', 0)}, {g.point(0, '2 * l')}, {g.point(0, 0)})"
    x = _with_plot(spark, sf_dir).withColumn("tri", F.expr(tri))
    return x.selectExpr(*_KEY, g.within("footprint", "zoned_area") + " as in_zone", g.within("footprint", "tri") + " as in_triangle")


@query("D06_line_poly_dist", with_model("SELECT model_id, floor_pos, d_rear AS rear_gap FROM fdist"))
def d06(spark, sf_dir):
    x = _with_plot(spark, sf_dir).withColumn("b", F.expr(g.bounds("footprint")))
    return x.withColumn("rear", F.expr(g.line("w", "l", 0, "l"))).selectExpr(*_KEY, g.line_poly_dist("rear", "footprint", "b") + " as rear_gap")


_PTS = "SELECT s_suppkey, CAST(s_suppkey % 11 AS DOUBLE) AS px, CAST(s_suppkey % 7 AS DOUBLE) AS py FROM supplier"
_NAT = "SELECT n_nationkey AS pos, CAST(n_nationkey % 5 AS DOUBLE) * 2 AS x0, CAST(n_nationkey // 5 AS DOUBLE) * 1.5 AS y0 FROM nation"


@query("D07_pip", f"SELECT s_suppkey, pos, px > x0 AND px < x0 + 3 AND py > y0 AND py < y0 + 2 AS inside FROM ({_PTS}), ({_NAT}) WHERE px >= x0 AND px <= x0 + 3 AND py >= y0 AND py <= y0 + 2")
def d07(spark, sf_dir):
    p, f = _points(spark, sf_dir), _layer(spark, sf_dir)
    return gis.candidates(p, f).selectExpr("s_suppkey", "pos", g.pip("px", "py", "ring") + " as inside")


def _points(spark, sf_dir):
    return d.load(spark, sf_dir, "supplier").selectExpr("s_suppkey", "cast(s_suppkey % 11 as double) as px", "cast(s_suppkey % 7 as double) as py")


def _layer(spark, sf_dir):
    n = d.load(spark, sf_dir, "nation").selectExpr(
        "'zones' as layer", "n_nationkey as pos", "map('name', n_name) as props",
        "cast(n_nationkey % 5 as double) * 2 as x0", "cast(n_nationkey div 5 as double) * 1.5D as y0",
    )
    return n.selectExpr("layer", "pos", "props", g.rect_ring("x0", "y0", "x0 + 3", "y0 + 2") + " as ring")


@query("C11_point_in_layer", f"""SELECT s_suppkey, min(pos) IS NOT NULL AS inside, min(pos) AS pos, 'low' AS confidence FROM ({_PTS})
LEFT JOIN ({_NAT}) ON px > x0 AND px < x0 + 3 AND py > y0 AND py < y0 + 2 GROUP BY 1""")
def c11(spark, sf_dir):
    return gis.point_in_layer(_points(spark, sf_dir), _layer(spark, sf_dir), "s_suppkey").select("s_suppkey", "inside", "pos", "confidence")


_CLIP = "greatest(x0, 1.5) AS xmin, greatest(y0, 3.0) AS ymin, least(x1, w - 1.5) AS xmax, least(y1, l - 3) AS ymax"


@query("D08_clip_rect", with_model(f"SELECT model_id, floor_pos, CASE WHEN ok THEN xmin ELSE x0 END AS xmin, CASE WHEN ok THEN ymin ELSE y0 END AS ymin, CASE WHEN ok THEN xmax ELSE x1 END AS xmax, CASE WHEN ok THEN ymax ELSE y1 END AS ymax FROM (SELECT *, xmax > xmin AND ymax > ymin AS ok FROM (SELECT *, {_CLIP} FROM floors JOIN plots USING (model_id)))"))
def d08(spark, sf_dir):
    x = _with_plot(spark, sf_dir).withColumn("box", F.expr("named_struct('xmin', 1.5D, 'ymin', 3D, 'xmax', w - 1.5D, 'ymax', l - 3D)"))
    x = x.selectExpr(*_KEY, g.clip_rect("footprint", "box") + " as ring")
    return x.selectExpr(*_KEY, g.bounds("ring") + " as b").selectExpr(*_KEY, "b.*")


@query("D09_inset", with_model("SELECT model_id, pos, CASE WHEN cw > 3 AND cd > 3 THEN (cw - 3) * (cd - 3) END AS area FROM courtyards"))
def d09(spark, sf_dir):
    x = d.courtyards(spark, sf_dir).selectExpr("model_id", "pos", g.inset("ring", "1.5D") + " as inner_ring")
    return x.selectExpr("model_id", "pos", g.area("inner_ring") + " as area")


# Rings that are not convex: every footprint without its upper right part, from 3/8 of its width on.
_NOTCH = "x0 + 0.375::DOUBLE * (x1 - x0) AS xm, y0 + 0.5::DOUBLE * (y1 - y0) AS ym"
_BENT = f"SELECT *, {_NOTCH} FROM floors JOIN plots USING (model_id)"


def _bent(spark, sf_dir):
    x = _with_plot(spark, sf_dir).withColumn("b", F.expr(g.bounds("footprint")))
    x = x.selectExpr(*_KEY, "w", "l", "b", "b.xmin + 0.375D * (b.xmax - b.xmin) as xm", "b.ymin + 0.5D * (b.ymax - b.ymin) as ym")
    pts = [("b.xmin", "b.ymin"), ("b.xmax", "b.ymin"), ("b.xmax", "ym"), ("xm", "ym"), ("xm", "b.ymax"), ("b.xmin", "b.ymax"), ("b.xmin", "b.ymin")]
    return x.withColumn("ring", F.expr(f"array({', '.join(g.point(*p) for p in pts)})"))


_LEG = "greatest({x1} - {x0}, 0) * greatest({y1} - {y0}, 0)"
_BOX = dict(x0="greatest({0}, 1.5)", y0="greatest({1}, 3.0)", x1="least({2}, w - 1.5)", y1="least({3}, l - 3)")


def _boxed(x0, y0, x1, y1):
    return _LEG.format(**{k: v.format(x0, y0, x1, y1) for k, v in _BOX.items()})


@query("D08_clip_bent", with_model(f"""SELECT model_id, floor_pos, CASE WHEN a > 1e-9 THEN a ELSE (x1 - x0) * (y1 - y0) - (x1 - xm) * (y1 - ym) END AS area
FROM (SELECT *, {_boxed('x0', 'y0', 'x1', 'y1')} - {_boxed('xm', 'ym', 'x1', 'y1')} AS a FROM ({_BENT}))"""))
def d08_bent(spark, sf_dir):
    x = _bent(spark, sf_dir).withColumn("box", F.expr("named_struct('xmin', 1.5D, 'ymin', 3D, 'xmax', w - 1.5D, 'ymax', l - 3D)"))
    x = polygons.clip_any(x, "ring", "box")
    return x.selectExpr(*_KEY, g.area("ring") + " as area")


@query("D09_inset_bent", with_model(f"""SELECT model_id, floor_pos, CASE WHEN a > 1e-9 THEN a END AS area FROM (
  SELECT *, {_LEG.format(x0="(x0 + 1.5)", x1="(x1 - 1.5)", y0="(y0 + 1.5)", y1="(ym - 1.5)")} + {_LEG.format(x0="(x0 + 1.5)", x1="(xm - 1.5)", y0="(y0 + 1.5)", y1="(y1 - 1.5)")}
    - {_LEG.format(x0="(x0 + 1.5)", x1="(xm - 1.5)", y0="(y0 + 1.5)", y1="(ym - 1.5)")} AS a FROM ({_BENT}))"""))
def d09_bent(spark, sf_dir):
    x = polygons.inset_any(_bent(spark, sf_dir), "ring", "1.5D", "inner_ring")
    return x.selectExpr(*_KEY, g.area("inner_ring") + " as area")


@query("D10_translate", with_model("SELECT model_id, floor_pos, x0 + 0.5 AS xmin, x0 + 0.5 >= 0 AND y0 - 0.25 >= 0 AND x1 + 0.5 <= w AND y1 - 0.25 <= l AS stays FROM floors JOIN plots USING (model_id)"))
def d10(spark, sf_dir):
    x = _with_plot(spark, sf_dir).withColumn("moved", F.expr(g.translate("footprint", 0.5, -0.25)))
    return x.selectExpr(*_KEY, "moved[0].x as xmin", g.within("moved", "plot_polygon") + " as stays")


@query("D11_centroid", with_model("SELECT model_id, floor_pos, CAST(round((x0 + x1) / 2 * 1024) AS BIGINT) AS cx1024, CAST(round((y0 + y1) / 2 * 1024) AS BIGINT) AS cy1024 FROM floors"))
def d11(spark, sf_dir):
    x = _floors(spark, sf_dir, g.centroid("footprint") + " as c")
    return x.selectExpr(*_KEY, "cast(round(c.x * 1024) as bigint) as cx1024", "cast(round(c.y * 1024) as bigint) as cy1024")


@query("D12_hull", with_model("SELECT model_id, min(x0) AS xmin, max(y1) AS ymax, max(x1) AS xmax, min(y0) AS ymin FROM floors GROUP BY 1"))
def d12(spark, sf_dir):
    # The oracle checks the extremes; corner-by-corner equality with brute force is a unit test.
    f = _floors(spark, sf_dir, g.bounds("footprint") + " as b").selectExpr("model_id", "b.xmin as x0", "b.ymin as y0", "b.xmax as x1", "b.ymax as y1")
    h = hull(box_corners(f, "model_id"), "model_id")
    return h.groupBy("model_id").agg(F.min("x").alias("xmin"), F.max("y").alias("ymax"), F.max("x").alias("xmax"), F.min("y").alias("ymin"))


@query("D13_geom_type", with_model("SELECT model_id, floor_pos, CASE model_id % 5 WHEN 0 THEN 'Point' WHEN 4 THEN 'Polygon' ELSE 'LineString' END AS kind FROM floors"))
def d13(spark, sf_dir):
    return _floors(spark, sf_dir, f"{_CUT} as cut").selectExpr(*_KEY, g.geom_type("cut") + " as kind")


@query("D14_to_metres", with_model("SELECT model_id, floor_pos, (x0 - 1.0) / 4.0 AS xmin, (40.0 - y1) / 4.0 AS ymin, (x1 - 1.0) / 4.0 AS xmax, (40.0 - y0) / 4.0 AS ymax FROM floors"))
def d14(spark, sf_dir):
    x = _floors(spark, sf_dir, g.bounds("footprint") + " as b")
    x = x.selectExpr(*_KEY, g.to_metres("b", "1D", "40D", "4D") + " as ring").selectExpr(*_KEY, g.bounds("ring") + " as b")
    return x.selectExpr(*_KEY, "b.*")
