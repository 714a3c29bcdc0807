"""Queries for sheets, confirmations, mutations and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from parapet.catalog.base import query, with_model
from parapet.catalog.text import ROLE, SHEETS, guessed
from parapet.functions import geometry as g
from parapet.operators import cases as k
from parapet.operators import sheets as s
from parapet.sources import derived as d

_G = f"g AS (SELECT case_id, upload_pos, page_id, {ROLE} AS role FROM sheets)"
_A = "a AS (SELECT *, CASE WHEN k = 1 THEN role WHEN role LIKE 'elevation%' THEN role || '_' || k END AS role_key FROM (SELECT *, row_number() OVER (PARTITION BY case_id, role ORDER BY upload_pos) AS k FROM g WHERE role IS NOT NULL))"
_W = f"WITH {SHEETS}, {_G}, {_A}"
_LEVEL = "CASE role_key WHEN 'basement' THEN -1 WHEN 'stilt' THEN 0 WHEN 'ground' THEN 0 WHEN 'first' THEN 1 END"


def _guesses(spark, sf_dir):
    return guessed(spark, sf_dir).selectExpr("case_id", "upload_pos", "page_id", "g.role as role")


def _assigned(spark, sf_dir):
    return s.assign_roles(_guesses(spark, sf_dir))[0]


@query("G05_assign_roles", f"{_W} SELECT g.page_id, role_key FROM g LEFT JOIN (SELECT page_id, role_key FROM a) USING (page_id)")
def g05(spark, sf_dir):
    ok, bad = s.assign_roles(_guesses(spark, sf_dir))
    return ok.select("page_id", "role_key").unionByName(bad.selectExpr("page_id", "cast(null as string) as role_key"))


@query("C12_override_roles", f"{_W}, e AS (SELECT case_id, 'ground' AS role_key, -case_id AS page_id FROM (SELECT DISTINCT case_id FROM sheets) WHERE case_id % 2 = 0) SELECT case_id, role_key, page_id FROM e UNION ALL SELECT case_id, role_key, page_id FROM a WHERE role_key IS NOT NULL AND NOT (case_id % 2 = 0 AND role_key = 'ground')")
def c12(spark, sf_dir):
    inferred = _assigned(spark, sf_dir).select("case_id", "role_key", "page_id")
    explicit = d.sheets(spark, sf_dir).select("case_id").distinct().filter("case_id % 2 = 0").selectExpr("case_id", "'ground' as role_key", "-case_id as page_id")
    return s.override_roles(explicit, inferred)[0]


@query("K01_map_levels", f"{_W} SELECT case_id, {_LEVEL} AS level, count(*) AS n_sheets, bool_or(role_key = 'stilt') AS has_stilt FROM a WHERE {_LEVEL} IS NOT NULL GROUP BY 1, 2")
def k01(spark, sf_dir):
    x, _ = s.map_levels(_assigned(spark, sf_dir))
    return x.groupBy("case_id", "level").agg(F.count("*").alias("n_sheets"), F.bool_or("is_stilt").alias("has_stilt"))


@query("K01_level_clashes", f"{_W} SELECT case_id, {_LEVEL} AS level, count(*) AS n_sheets FROM a WHERE {_LEVEL} IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def k01c(spark, sf_dir):
    return s.map_levels(_assigned(spark, sf_dir))[1]


@query("K13_pick_site_sheet", f"{_W} SELECT case_id, arg_min(role_key, CASE WHEN role_key IN ('site','zoning') THEN 0 WHEN role_key = 'combined' THEN 1 WHEN role_key = 'ground' THEN 2 ELSE 3 END * 100 + upload_pos) AS role_key FROM a WHERE page_id % 4 <> 1 AND role_key IS NOT NULL GROUP BY 1")
def k13(spark, sf_dir):
    return s.pick_site_sheet(_assigned(spark, sf_dir).withColumn("usable", F.expr("page_id % 4 <> 1")))


@query("K15_fill_jurisdiction", f"WITH {SHEETS} SELECT case_id, arg_min(page_id, upload_pos) FILTER (WHERE page_id % 11 <> 0)::VARCHAR AS plot_no, 'Phase-' || arg_min(page_id % 9, upload_pos) FILTER (WHERE page_id % 11 <> 0 AND page_id % 7 <> 0) AS sector FROM sheets GROUP BY 1")
def k15(spark, sf_dir):
    from parapet.functions import text as t

    x = d.sheets(spark, sf_dir).selectExpr("case_id", "upload_pos", t.plot_no("text") + " as plot_no", t.sector("text") + " as sector")
    return s.fill_jurisdiction(x)


@query("K17_combined_fallback", "SELECT o_custkey AS case_id, min(o_orderkey) AS first_pos, CASE WHEN count(*) = 1 THEN 'combined' ELSE 'error' END AS outcome FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderkey % 5 = 0) = 0")
def k17(spark, sf_dir):
    x = d.load(spark, sf_dir, "orders").selectExpr("o_custkey as case_id", "o_orderkey as upload_pos", "case when o_orderkey % 5 = 0 then 'ground' end as role")
    return s.combined_fallback(x)


@query("C17_merge_plot", with_model("SELECT model_id, coalesce(plot_area_sqm, tw * tl) AS plot_area_sqm, CASE WHEN plot_area_sqm IS NULL THEN 'plot synthesised from the entered size' WHEN abs(tw * tl - plot_area_sqm) / plot_area_sqm > 0.05::DOUBLE THEN 'entered size disagrees with the measured plot' END AS note, CASE WHEN plot_area_sqm IS NULL THEN tw ELSE w END AS far_x FROM (SELECT *, w + CASE WHEN model_id % 5 = 0 THEN 1 ELSE 0 END AS tw, l + CASE WHEN model_id % 5 = 0 THEN 1 ELSE 0 END AS tl FROM plots)"))
def c17(spark, sf_dir):
    p = d.plots(spark, sf_dir)
    return s.merge_plot(p, d.entered_plot_sizes(p)).selectExpr("model_id", "plot_area_sqm", "note", "plot_polygon[1].x as far_x")


_EVS = f"SELECT event_id, event_id // 50 AS sheet, ({list(d.STROKE_COLOURS)})[1 + user_id % 4] AS color, ({list(d.LABEL_COLOURS)})[1 + user_id % 4] AS lcolor, CASE WHEN event_id % 2 = 0 THEN 'h' ELSE 'v' END AS axis, floor(value) + 0.25::DOUBLE * CAST(event_id % 4 AS DOUBLE) AS pos, CAST(event_id % 20 AS DOUBLE) AS lo, CAST(event_id % 20 + 1 + user_id % 30 AS DOUBLE) AS hi, event_id % 7 AS lab, user_id, floor(value) AS x FROM events"
_LC = "lc AS (SELECT sheet, CAST(sum(n) AS BIGINT) AS n_labels, arg_max(lcolor, n * 100000000 - lcolor) FILTER (WHERE lcolor <> 3158064) AS color FROM (SELECT sheet, lcolor, count(*) AS n FROM ev WHERE lab = 0 GROUP BY 1, 2) GROUP BY 1)"
_AX = "ax AS (SELECT sheet, color, axis, round_even(pos, 0) AS line_pos, min(lo) AS lo, max(hi) AS hi, sum(hi - lo) AS ink FROM ev GROUP BY 1, 2, 3, 4)"


@query("F12_label_colour", f"WITH ev AS ({_EVS}), {_LC} SELECT sheet, n_labels, CAST(color AS INT) AS color FROM lc")
def f12(spark, sf_dir):
    return s.label_colour(d.labels(spark, sf_dir), "plot line")


@query("C13_near_colours", f"WITH ev AS ({_EVS}), {_LC}, st AS (SELECT DISTINCT sheet, color AS sc FROM ev WHERE color <> 7369848), m AS (SELECT sheet, sc, greatest(abs(color // 65536 - sc // 65536), abs(color // 256 % 256 - sc // 256 % 256), abs(color % 256 - sc % 256)) AS dist FROM lc JOIN st USING (sheet)) SELECT sheet, CAST(sc AS INT) AS stroke_color, CAST(dist AS INT) AS dist, CAST(row_number() OVER (PARTITION BY sheet ORDER BY dist, sc) AS INT) AS rank FROM m WHERE dist <= 40")
def c13(spark, sf_dir):
    x = s.near_colours(s.label_colour(d.labels(spark, sf_dir), "plot line"), d.strokes(spark, sf_dir))
    return x.select("sheet", "stroke_color", "dist", "rank")


@query("F13_axis_lines", f"WITH ev AS ({_EVS}), {_AX} SELECT sheet, CAST(color AS INT) AS color, axis, line_pos, lo, hi, ink FROM ax")
def f13(spark, sf_dir):
    return s.axis_lines(d.strokes(spark, sf_dir))


_PR = "pr AS (SELECT sheet, color, max(p0) FILTER (WHERE axis = 'v') AS x0, max(p0) FILTER (WHERE axis = 'h') AS y0, max(p1) FILTER (WHERE axis = 'v') AS x1, max(p1) FILTER (WHERE axis = 'h') AS y1 FROM (SELECT sheet, color, axis, min(line_pos) AS p0, max(line_pos) AS p1, min(ink) AS wk, max(ink) AS sg, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY sheet, color, axis ORDER BY ink DESC, line_pos) AS k FROM ax) WHERE k <= 2 GROUP BY 1, 2, 3) WHERE n = 2 AND sg > 0 AND wk / sg >= 0.5 AND p1 - p0 >= 1 GROUP BY 1, 2 HAVING max(p0) FILTER (WHERE axis = 'v') IS NOT NULL AND max(p0) FILTER (WHERE axis = 'h') IS NOT NULL)"


@query("G07_plot_rect", f"WITH ev AS ({_EVS}), {_AX}, {_PR} SELECT sheet, CAST(color AS INT) AS color, x0, y0, x1, y1 FROM pr")
def g07(spark, sf_dir):
    return s.plot_rect(s.axis_lines(d.strokes(spark, sf_dir)))


@query("K10_zoning_envelope", f"WITH ev AS ({_EVS}), {_AX}, {_PR}, r AS (SELECT * FROM pr WHERE color = 14684192), z AS (SELECT a.*, r.x0, r.y0, r.x1, r.y1, a.hi - a.lo >= (CASE WHEN axis = 'h' THEN r.x1 - r.x0 ELSE r.y1 - r.y0 END) * 0.7::DOUBLE AS major, CASE WHEN axis = 'h' THEN (r.y0 + r.y1) / 2 ELSE (r.x0 + r.x1) / 2 END AS mid FROM r LEFT JOIN (SELECT * FROM ax WHERE color = 2109664) a ON a.sheet = r.sheet), q AS (SELECT r.sheet, r.x0, r.y0, r.x1, r.y1, coalesce(max(line_pos) FILTER (WHERE major AND axis = 'v' AND line_pos > z.x0 AND line_pos < mid), r.x0) AS zx0, coalesce(max(line_pos) FILTER (WHERE major AND axis = 'h' AND line_pos > z.y0 AND line_pos < mid), r.y0) AS zy0, coalesce(min(line_pos) FILTER (WHERE major AND axis = 'v' AND line_pos >= mid AND line_pos < z.x1), r.x1) AS zx1, coalesce(min(line_pos) FILTER (WHERE major AND axis = 'h' AND line_pos >= mid AND line_pos < z.y1), r.y1) AS zy1, count(*) FILTER (WHERE NOT major AND ink > 2.4) AS n_steps FROM r LEFT JOIN z ON z.sheet = r.sheet GROUP BY 1, 2, 3, 4, 5) SELECT sheet, n_steps, CASE WHEN NOT (zx0 = x0 AND zy0 = y0 AND zx1 = x1 AND zy1 = y1) THEN zx0 END AS zx0, CASE WHEN NOT (zx0 = x0 AND zy0 = y0 AND zx1 = x1 AND zy1 = y1) THEN zy0 END AS zy0, CASE WHEN NOT (zx0 = x0 AND zy0 = y0 AND zx1 = x1 AND zy1 = y1) THEN zx1 END AS zx1, CASE WHEN NOT (zx0 = x0 AND zy0 = y0 AND zx1 = x1 AND zy1 = y1) THEN zy1 END AS zy1 FROM q")
def k10(spark, sf_dir):
    ax = s.axis_lines(d.strokes(spark, sf_dir))
    rect = s.plot_rect(ax).filter(f"color = {d.STROKE_COLOURS[0]}").drop("color")
    return s.zoning_envelope(rect, ax.filter(f"color = {d.STROKE_COLOURS[2]}").drop("color"))


def _rects(spark, sf_dir):
    return d.strokes(spark, sf_dir).selectExpr(
        "sheet", "case when axis = 'h' then lo else pos end as x0", "case when axis = 'h' then pos else lo end as y0",
        "case when axis = 'h' then hi else pos end as x1", "case when axis = 'h' then pos else hi end as y1",
    )


_RC = "rc AS (SELECT sheet, CASE WHEN axis = 'h' THEN lo ELSE pos END AS x0, CASE WHEN axis = 'h' THEN pos ELSE lo END AS y0, CASE WHEN axis = 'h' THEN hi ELSE pos END AS x1, CASE WHEN axis = 'h' THEN pos ELSE hi END AS y1 FROM ev)"
_BB = "bb AS (SELECT sheet, coalesce(min(x0) FILTER (WHERE i), min(x0)) AS x0, coalesce(min(y0) FILTER (WHERE i), min(y0)) AS y0, coalesce(max(x1) FILTER (WHERE i), max(x1)) AS x1, coalesce(max(y1) FILTER (WHERE i), max(y1)) AS y1 FROM (SELECT *, x0 < f0 + (f1 - f0) * 0.85::DOUBLE AS i FROM (SELECT *, min(x0) OVER (PARTITION BY sheet) AS f0, max(x1) OVER (PARTITION BY sheet) AS f1 FROM rc)) GROUP BY 1)"
_SC = "sc AS (SELECT bb.*, greatest(x1 - x0, y1 - y0) / m AS scale FROM bb LEFT JOIN (SELECT event_id // 50 AS sheet, max((user_id % 40 + (event_id % 14) / 12::DOUBLE) * 0.3048::DOUBLE) FILTER (WHERE event_id % 5 <> 4 AND event_id % 14 < 12) AS m FROM events GROUP BY 1) USING (sheet))"


@query("F15_drawing_bbox", f"WITH ev AS ({_EVS}), {_RC}, {_BB} SELECT * FROM bb")
def f15(spark, sf_dir):
    return s.drawing_bbox(_rects(spark, sf_dir))


@query("H06_sheet_scale", f"WITH ev AS ({_EVS}), {_RC}, {_BB}, {_SC} SELECT sheet, scale FROM sc")
def h06(spark, sf_dir):
    return s.sheet_scale(d.text_spans(spark, sf_dir), s.drawing_bbox(_rects(spark, sf_dir))).select("sheet", "scale")


@query("K07_sheet_footprint", f"WITH ev AS ({_EVS}), {_RC}, {_BB}, {_SC} SELECT sheet, (x1 - x0) / scale AS far_x, (y1 - y0) / scale AS depth_m FROM sc")
def k07(spark, sf_dir):
    return s.sheet_footprint(d.text_spans(spark, sf_dir), _rects(spark, sf_dir)).selectExpr("sheet", "footprint[2].x as far_x", "depth_m")


@query("K09_elevation_width", f"WITH ev AS ({_EVS}), {_RC}, {_BB}, {_SC} SELECT sheet, (x1 - x0) / scale AS width_m FROM sc")
def k09(spark, sf_dir):
    return s.sheet_footprint(d.text_spans(spark, sf_dir), _rects(spark, sf_dir)).select("sheet", "width_m")


@query("G08_storey_estimate", "SELECT event_id // 50 AS sheet, CASE WHEN count(DISTINCT floor(value / 100)) - 1 BETWEEN 1 AND 8 THEN CAST(count(DISTINCT floor(value / 100)) - 1 AS INT) END AS storeys FROM events GROUP BY 1")
def g08(spark, sf_dir):
    # Long horizontals near every hundred points, each off by up to two points.
    y = "floor(value / 100) * 100D + event_id % 3"
    x = d.load(spark, sf_dir, "events").selectExpr("event_id div 50 as sheet", "0D as x0", f"{y} as y0", "400D + user_id % 5 as x1", f"{y} as y1")
    return s.storey_estimate(x)


@query("H05_largest_wall", with_model("SELECT model_id AS sheet, max(area) AS area FROM floors WHERE l_partkey % 3 = 0 GROUP BY 1"))
def h05(spark, sf_dir):
    x = d._floor_rows(spark, sf_dir).selectExpr("model_id as sheet", "floor_pos as pos", "case when l_partkey % 3 = 0 then 'A-WALL' else 'KIT' end as layer", "true as closed", g.rect_ring("x0", "y0", "x1", "y1") + " as points")
    return s.largest_wall(x).select("sheet", "area")


@query("F11_layer_counts", "SELECT p_type AS layer, 'unknown' AS category, count(*) AS n FROM part GROUP BY 1")
def f11(spark, sf_dir):
    return s.layer_counts(d.load(spark, sf_dir, "part").selectExpr("p_type as layer"))


@query("K05_reconcile_heights", with_model("SELECT model_id AS case_id, CASE WHEN max(height_m) - min(height_m) <= max(height_m) * 0.1::DOUBLE THEN max(height_m) END AS height_m FROM floors WHERE height_m IS NOT NULL GROUP BY 1"))
def k05(spark, sf_dir):
    return s.reconcile_heights(d.floors(spark, sf_dir).filter("height_m is not null").selectExpr("model_id as case_id", "height_m"))


@query("K06_storey_check", with_model("SELECT model_id AS case_id, count(*) AS n_plans, any_value(e) AS storeys, CASE WHEN any_value(e) IS NULL THEN 'inconclusive' WHEN any_value(e) = count(*) THEN 'agree' ELSE 'mismatch' END AS outcome FROM floors JOIN (SELECT o_orderkey AS model_id, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(1 + o_custkey % 5 AS INT) END AS e FROM orders) USING (model_id) GROUP BY 1"))
def k06(spark, sf_dir):
    e = d.load(spark, sf_dir, "orders").selectExpr("o_orderkey as case_id", "1 as upload_pos", "case when o_orderkey % 3 <> 0 then cast(1 + o_custkey % 5 as int) end as storeys")
    return s.storey_check(d.floors(spark, sf_dir).selectExpr("model_id as case_id"), e)


@query("G11_apportion_height", with_model("""
, fl AS (SELECT model_id, level, row_number() OVER (PARTITION BY model_id ORDER BY level DESC) - 1 AS tr, count(*) OVER (PARTITION BY model_id) AS nf FROM floors WHERE NOT is_stilt),
sg AS (SELECT l_orderkey AS model_id, rn AS seg, 0.5::DOUBLE + 0.125::DOUBLE * CAST(l_partkey % 8 AS DOUBLE) AS v, count(*) OVER (PARTITION BY l_orderkey) AS ns FROM lr)
SELECT fl.model_id AS case_id, level, CASE WHEN any_value(ns) % any_value(nf) = 0 THEN sum(v) FILTER (WHERE CAST(floor((seg - 1) / (ns / nf)) AS INT) = tr) WHEN any_value(tr) = 0 THEN sum(v) END AS height_m FROM fl JOIN sg USING (model_id) GROUP BY 1, 2""".lstrip()))
def g11(spark, sf_dir):
    seg = d._ranked_lines(spark, sf_dir).selectExpr("l_orderkey as case_id", "rn as seg", "0.5D + 0.125D * cast(l_partkey % 8 as double) as value_m")
    h = seg.groupBy("case_id").agg(F.sum("value_m").alias("height_m"))
    return s.apportion_height(h, seg, d.floors(spark, sf_dir).selectExpr("model_id as case_id", "level", "is_stilt"))


# ---------------------------------------------------------------- confirmations, mutations, evaluation

@query("B08_needs_confirmation", with_model("SELECT model_id, count(*) FILTER (WHERE confidence = 'low') AS n_low FROM rooms GROUP BY 1"))
def b08(spark, sf_dir):
    return k.needs_confirmation(d.rooms(spark, sf_dir))


@query("K16_auto_confirm", with_model("SELECT model_id, count(*) FILTER (WHERE confidence <> 'high') AS n_auto FROM rooms GROUP BY 1 HAVING count(*) FILTER (WHERE confidence <> 'high') > 0"))
def k16(spark, sf_dir):
    return k.auto_confirm(d.rooms(spark, sf_dir))[1]


_CORR = "corr AS (SELECT conv_id AS model_id, turn AS seq, CAST(turn % 3 AS INT) AS floor_level, CAST(turn % 2 AS INT) AS room_index, CASE WHEN turn % 4 <> 3 THEN (['bedroom','living','kitchen','bath','wc','store','stair','garage','other'])[1 + turn % 9] END AS use FROM conversations)"


def corrections(spark, sf_dir):
    uses = "array('bedroom','living','kitchen','bath','wc','store','stair','garage','other')"
    return d.load(spark, sf_dir, "conversations").selectExpr(
        "conv_id as model_id", "turn as seq", "cast(turn % 3 as int) as floor_level", "cast(turn % 2 as int) as room_index",
        f"case when turn % 4 <> 3 then {uses}[cast(turn % 9 as int)] end as use", "cast(null as string) as confidence",
    )


@query("C10_confirm", with_model(f", {_CORR} SELECT r.model_id, r.level, r.room_index, coalesce(c.use, r.use) AS use, CASE WHEN c.n > 0 THEN 'high' ELSE r.confidence END AS confidence FROM rooms r LEFT JOIN (SELECT model_id, floor_level AS level, room_index, count(*) AS n, arg_max(use, seq) FILTER (WHERE use IS NOT NULL) AS use FROM corr GROUP BY 1, 2, 3) c USING (model_id, level, room_index)"))
def c10(spark, sf_dir):
    return k.confirm(d.rooms(spark, sf_dir), corrections(spark, sf_dir))[0].select("model_id", "level", "room_index", "use", "confidence")


@query("C10_unmatched", with_model(f", {_CORR} SELECT model_id, seq FROM corr c WHERE NOT EXISTS (SELECT 1 FROM rooms r WHERE r.model_id = c.model_id AND r.level = c.floor_level AND r.room_index = c.room_index)"))
def c10u(spark, sf_dir):
    return k.confirm(d.rooms(spark, sf_dir), corrections(spark, sf_dir))[1].select("model_id", "seq")


def _mut(edge, delta, what):
    x0, y0, x1, y1 = {"north": ("x0", "y0", "x1", f"y1 + {delta}"), "east": ("x0", "y0", f"x1 + {delta}", "y1")}[edge]
    before, after = ("y1", y1) if edge == "north" else ("x1", x1)
    return with_model(f"SELECT model_id || ':' || floor_pos AS case_id, {before} AS edge_before, {after} AS edge_after, area AS area_before, ({x1} - {x0}) * ({y1} - {y0}) AS area_after, ({x1} - {x0}) * ({y1} - {y0}) - area AS area_delta FROM floors")


def _cases(spark, sf_dir):
    return d.floors(spark, sf_dir).selectExpr("concat(model_id, ':', floor_pos) as case_id", "footprint as points")


_TRUTH = ("case_id", "edge_before", "edge_after", "area_before", "area_after", "area_delta")


@query("N01_offset_edge", _mut("north", "1.25::DOUBLE", ""))
def n01(spark, sf_dir):
    return k.mutation_truth(_cases(spark, sf_dir), "offset_edge", "north", 1.25).select(*_TRUTH)


@query("N02_shrink_room", _mut("east", "(-0.75::DOUBLE)", ""))
def n02(spark, sf_dir):
    return k.mutation_truth(_cases(spark, sf_dir), "shrink_room", "east", 0.75).select(*_TRUTH)


@query("N04_mutation_truth", with_model("SELECT model_id || ':' || floor_pos AS case_id, 'synthetic' AS provenance, 'south' AS edge, y0 AS edge_before, y0 - 0.5 AS edge_after, (x1 - x0) * 0.5 AS area_delta FROM floors"))
def n04(spark, sf_dir):
    return k.mutation_truth(_cases(spark, sf_dir), "offset_edge", "south", 0.5).selectExpr("case_id", "provenance", "mutation.edge as edge", "edge_before", "edge_after", "area_delta")


@query("N03_check_rectangles", with_model("SELECT model_id AS sheet, CASE WHEN model_id % 5 < 3 THEN 'not a rectangle' END AS reason FROM floors WHERE floor_pos = 0 UNION ALL SELECT model_id, 'several closed rings' FROM floors WHERE floor_pos > 0 GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT model_id, NULL FROM floors WHERE floor_pos > 0 GROUP BY 1 HAVING count(*) = 1"))
def n03(spark, sf_dir):
    x = d.floors(spark, sf_dir).selectExpr("model_id as sheet", "case when floor_pos = 0 then 'ground' else 'upper' end as layer", "true as closed", "case when floor_pos = 0 then slice(footprint, 1, cast(model_id % 5 + 1 as int)) else footprint end as points")
    good, bad = k.check_rectangles(x)
    return good.selectExpr("sheet", "cast(null as string) as reason").unionByName(bad.select("sheet", "reason"))


_PRED = "SELECT CASE doc_id % 3 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'mutated_real' ELSE 'real' END AS provenance, toxic = 1 AS truth, quality = 0 AS predicted FROM labels"
_MET = f"SELECT provenance, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM (SELECT provenance, count(*) FILTER (WHERE truth AND predicted) AS tp, count(*) FILTER (WHERE NOT truth AND predicted) AS fp, count(*) FILTER (WHERE truth AND NOT predicted) AS fn FROM ({_PRED}) GROUP BY 1)"


def _pred(spark, sf_dir):
    return d.load(spark, sf_dir, "labels").selectExpr("case doc_id % 3 when 0 then 'synthetic' when 1 then 'mutated_real' else 'real' end as provenance", "toxic = 1 as truth", "quality = 0 as predicted")


@query("F16_eval_metrics", _MET)
def f16(spark, sf_dir):
    return k.eval_metrics(_pred(spark, sf_dir))


@query("N05_evaluate_by_provenance", f"SELECT *, false AS no_real_cases FROM ({_MET})")
def n05(spark, sf_dir):
    return k.evaluate_by_provenance(_pred(spark, sf_dir))


# ---------------------------------------------------------------- chains, scale and assembly

@query("G10_dxf_height", with_model("""
, v AS (SELECT l_orderkey AS sheet, 0.125::DOUBLE * l_quantity AS m, rn AS y FROM lr WHERE l_linenumber % 2 = 1 AND l_quantity > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY m DESC, y) AS k FROM v),
t AS (SELECT sheet, max(m) FILTER (WHERE k = 1) AS a, max(m) FILTER (WHERE k = 2) AS b FROM r GROUP BY 1),
p AS (SELECT r.sheet, a, m, row_number() OVER w AS i, sum(m) OVER w AS s FROM r JOIN t USING (sheet) WHERE k > 1 AND a < 1.5 * b WINDOW w AS (PARTITION BY r.sheet ORDER BY y))
SELECT sheet, a AS height_m, 1::BIGINT AS n_segments FROM t WHERE b IS NULL OR a >= 1.5 * b
UNION ALL SELECT e.sheet, e.a, max(e.i - q.i + 1) FROM p e JOIN p q ON q.sheet = e.sheet AND q.i <= e.i AND abs(e.s - (q.s - q.m) - e.a) <= 0.02 GROUP BY 1, 2""".lstrip()))
def g10(spark, sf_dir):
    return s.dxf_height(d.dxf_dimensions(spark, sf_dir))


@query("K03_dxf_rooms", "SELECT event_id, (['bedroom','wc','kitchen'])[1 + user_id % 5] AS use FROM events WHERE user_id % 5 < 3")
def k03(spark, sf_dir):
    x = d.load(spark, sf_dir, "events").selectExpr("event_id", "true as closed", "array('MBR', 'TOIL-2', 'Kit', 'WALL', 'NOTES')[cast(user_id % 5 as int)] as layer")
    return s.dxf_rooms(x).select("event_id", "use")


@query("K12_edge_roles", with_model("SELECT model_id AS sheet, side, CASE WHEN model_id % 3 = 0 THEN CASE side WHEN 'left' THEN 'side_a' WHEN 'right' THEN 'side_b' WHEN 'bottom' THEN CASE WHEN w <= l THEN 'front' ELSE 'rear' END ELSE CASE WHEN w <= l THEN 'rear' ELSE 'front' END END ELSE 'unknown' END AS role FROM plots, (VALUES ('bottom'), ('top'), ('left'), ('right')) t(side)"))
def k12(spark, sf_dir):
    x = d.plots(spark, sf_dir).selectExpr("model_id as sheet", "w as bottom", "l as top", "case when model_id % 3 = 0 then 0D else 1D end as left_", "0D as right_")
    return s.edge_roles(x).select("sheet", "side", "role")


@query("K11_built_extent", with_model("SELECT model_id AS sheet, min(d_rear / 2) AS bottom, min(d_front / 2) AS top, min(d_side_a / 2) AS left_, min(d_side_b / 2) AS right_ FROM fdist GROUP BY 1"))
def k11(spark, sf_dir):
    p = d.plots(spark, sf_dir).selectExpr("model_id as sheet", "0D as x0", "0D as y0", "w as x1", "l as y1", "2D as scale")
    f = d._floor_rows(spark, sf_dir).selectExpr("model_id as sheet", "x0", "y0", "x1", "y1")
    return s.built_extent(p, f)


@query("K02_build_floors", with_model("SELECT model_id AS case_id, CAST(floor_pos AS VARCHAR) AS role_key, CASE WHEN l_partkey % 4 = 0 THEN 'no usable outline' END AS note FROM floors"))
def k02(spark, sf_dir):
    f = d._floor_rows(spark, sf_dir).selectExpr("model_id as case_id", "cast(floor_pos as string) as role_key", "l_partkey", g.rect_ring("x0", "y0", "x1", "y1") + " as footprint")
    ok, bad = s.build_floors(f.select("case_id", "role_key"), f.filter("l_partkey % 4 <> 0").select("case_id", "role_key", "footprint"))
    return ok.selectExpr("case_id", "role_key", "cast(null as string) as note").unionByName(bad)


@query("K14_reanchor", with_model("SELECT model_id AS case_id, CAST(floor_pos AS VARCHAR) AS role_key, l_partkey % 3 = 0 AS upper_bound, CASE WHEN l_partkey % 3 = 0 THEN x1 + 1 ELSE x1 END AS far_x FROM floors"))
def k14(spark, sf_dir):
    f = d._floor_rows(spark, sf_dir).selectExpr("model_id as case_id", "cast(floor_pos as string) as role_key", "l_partkey", g.rect_ring("x0", "y0", "x1", "y1") + " as footprint", g.rect_ring("x0", "y0", "x1 + 1", "y1") + " as hull")
    out, _ = s.reanchor(f.select("case_id", "role_key", "footprint"), f.filter("l_partkey % 3 = 0").select("case_id", "role_key", "hull"))
    return out.selectExpr("case_id", "role_key", "footprint_is_upper_bound as upper_bound", "footprint[1].x as far_x")


@query("K04_label_rooms", """
WITH e AS (SELECT event_id // 50 AS sheet, event_id % 50 AS pos, event_id, user_id, floor(value) AS x FROM events),
t AS (SELECT *, event_id % 3 = 0 AS is_label, CASE WHEN user_id % 2 = 0 THEN 'bedroom' ELSE 'wc' END AS use FROM e)
SELECT a.sheet, a.pos, a.use, CASE WHEN b.pos IS NOT NULL AND c.pos IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN b.pos IS NOT NULL AND c.pos IS NOT NULL THEN (b.user_id % 20 + 6 / 12::DOUBLE) * 0.3048::DOUBLE WHEN a.use = 'bedroom' THEN 3.5 ELSE 2.0 END AS width_m, a.x / 4.0 AS x_m
FROM t a LEFT JOIN t b ON b.sheet = a.sheet AND b.pos = a.pos + 1 LEFT JOIN t c ON c.sheet = a.sheet AND c.pos = a.pos + 2 WHERE a.is_label""")
def k04(spark, sf_dir):
    x = d.load(spark, sf_dir, "events").selectExpr(
        "event_id div 50 as sheet", "event_id % 50 as pos", "floor(value) as x", "0D as y",
        "case when event_id % 3 = 0 then case when user_id % 2 = 0 then 'BED ROOM' else 'TOILET' end else concat(user_id % 20, char(39), '-6', char(34)) end as text",
    )
    sc = x.select("sheet").distinct().withColumn("scale", F.lit(4.0))
    return s.label_rooms(x, sc).select("sheet", "pos", "use", "confidence", "width_m", "x_m")


@query("F14_wall_thickness", with_model("""
, sh AS (SELECT l_orderkey % 20 AS sheet, CAST(l_suppkey % 3 AS INT) AS color, 1.0::DOUBLE + 0.125::DOUBLE * CAST(l_partkey % 10 AS DOUBLE) AS thin FROM lineitem),
m AS (SELECT sheet, color, round_even(thin, 0) AS pt, count(*) AS n FROM sh GROUP BY 1, 2, 3),
a AS (SELECT sheet, color, sum(n) AS n_all, arg_max(pt, n * 1000 - pt) AS modal, max(n) AS n_modal FROM m GROUP BY 1, 2),
q AS (SELECT sheet, color, n_all, n_modal, thin, row_number() OVER (PARTITION BY sheet, color ORDER BY thin) AS i FROM sh JOIN a USING (sheet, color) WHERE round_even(thin, 0) = modal),
z AS (SELECT *, thin / 10.0::DOUBLE AS th FROM q WHERE i = n_modal // 2 + 1 AND n_all >= 12 AND n_modal / n_all >= 0.3 AND thin / 10.0::DOUBLE BETWEEN 0.08 AND 0.45)
SELECT sheet, arg_max(color, n_all * 10 - color) AS color, arg_max(th, n_all * 10 - color) AS thickness_m FROM z GROUP BY 1""".lstrip()))
def f14(spark, sf_dir):
    x = d.load(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 20 as sheet", "cast(l_suppkey % 3 as int) as color", "1D + 0.125D * cast(l_partkey % 10 as double) as thin")
    return s.wall_thickness(x, x.select("sheet").distinct().withColumn("scale", F.lit(10.0)))


def _chain_tokens(spark, sf_dir):
    from parapet.functions import text as t

    return d.text_spans(spark, sf_dir).selectExpr("sheet", "pos", t.dim_inches("text") + " as inches", "x", "y").filter("inches is not null")


# The anchored clustering is a fold, so these have no SQL twin; tests check them on exact sheets.
@query("G09_dim_chains")
def g09(spark, sf_dir):
    return s.dim_chains(_chain_tokens(spark, sf_dir)).groupBy("sheet", "chain").agg(F.count("*").alias("n"), F.max("upto").alias("total_in"))


@query("C15_bracket_height")
def c15(spark, sf_dir):
    return s.bracket_height(_chain_tokens(spark, sf_dir))


def _metre_tokens(spark, sf_dir):
    from parapet.functions import text as t

    return d.text_spans(spark, sf_dir).selectExpr("sheet", f"inline(transform({t.feet_inches_all('text')}, m -> named_struct('m', m)))", "x", "y")


_TK = "tk AS (SELECT event_id // 50 AS sheet, (user_id % 40 + (event_id % 14) / 12::DOUBLE) * 0.3048::DOUBLE AS m, floor(value) AS x, CAST(event_id % 50 AS DOUBLE) AS y FROM events WHERE event_id % 5 <> 4 AND event_id % 14 < 12)"


@query("C14_verified_scale", f"""WITH ev AS ({_EVS}), {_AX}, {_PR}, {_TK}, lg AS (SELECT sheet, max(m) AS longest FROM tk GROUP BY 1),
sy AS (SELECT DISTINCT pr.*, m AS my FROM pr JOIN tk USING (sheet) WHERE m >= 3 AND abs(y - (y0 + y1) / 2) <= (y1 - y0) * 0.2::DOUBLE AND x >= x0 - (x1 - x0) * 0.35::DOUBLE AND x <= x1 + (x1 - x0) * 0.35::DOUBLE),
sx AS (SELECT DISTINCT pr.*, m AS mx FROM pr JOIN tk USING (sheet) WHERE m >= 3 AND abs(x - (x0 + x1) / 2) <= (x1 - x0) * 0.2::DOUBLE AND y >= y0 - (y1 - y0) * 0.35::DOUBLE AND y <= y1 + (y1 - y0) * 0.35::DOUBLE),
b AS (SELECT sy.*, mx FROM sy JOIN sx USING (sheet, color)),
c AS (SELECT sheet, color, x0, y0, x1, y1, (y1 - y0) / my AS scale, abs(mx - (x1 - x0) / ((y1 - y0) / my)) / ((x1 - x0) / ((y1 - y0) / my)) AS err, my + mx AS total FROM b
  UNION ALL SELECT sheet, color, x0, y0, x1, y1, (x1 - x0) / mx, abs(my - (y1 - y0) / ((x1 - x0) / mx)) / ((y1 - y0) / ((x1 - x0) / mx)), my + mx FROM b),
k AS (SELECT c.*, row_number() OVER (PARTITION BY sheet, color ORDER BY total DESC, err) AS rk FROM c JOIN lg USING (sheet) WHERE err <= 0.03::DOUBLE AND greatest(x1 - x0, y1 - y0) / scale >= longest * 0.98::DOUBLE)
SELECT sheet, CAST(color AS INT) AS color, scale FROM k WHERE rk = 1""")
def c14(spark, sf_dir):
    rect = s.plot_rect(s.axis_lines(d.strokes(spark, sf_dir)))
    return s.verified_scale(rect, _metre_tokens(spark, sf_dir)).select("sheet", "color", "scale")


@query("K08_plot_geometry")
def k08(spark, sf_dir):
    hint = d.strokes(spark, sf_dir).select("sheet").distinct().withColumn("hint", F.lit(4.0))
    return s.plot_geometry(d.labels(spark, sf_dir), d.strokes(spark, sf_dir), _metre_tokens(spark, sf_dir), hint)
