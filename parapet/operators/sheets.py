"""Sheet primitives to models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parapet.functions import geometry as g
from parapet.functions import text as t
from parapet.session import spread

# Plan roles with level and stilt flag, and drawing thresholds.
PLAN_LEVELS = {
    "basement": (-1, False),
    "stilt": (0, True),
    "ground": (0, False),
    "first": (1, False),
    "second": (2, False),
    "third": (3, False),
    "fourth": (4, False),
    "combined": (0, False),
}
TITLE_STRIP_FRACTION = 0.85
MIN_INK_RATIO = 0.5
MAJOR_LINE_FRACTION = 0.70
STEP_INK_PT = 2.4
HEIGHT_SPREAD = 0.10
CHAIN_X_PT = 15


def assign_roles(guesses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``guesses(case_id, upload_pos, role)`` -> (assigned, unresolved). The first file keeps a
    role; later elevations are numbered ``_2, _3 ...``, other repeats stay unresolved. A case holds
    the handful of files of one upload, so the window is small."""
    w = Window.partitionBy("case_id", "role").orderBy("upload_pos")
    x = guesses.withColumn("_k", F.when(F.col("role").isNotNull(), F.row_number().over(w)))
    key = "case when _k = 1 then role when startswith(role, 'elevation') then concat(role, '_', _k) end"
    x = x.withColumn("role_key", F.expr(key))
    return x.filter("role_key is not null").drop("_k"), x.filter("role_key is null").drop("_k", "role_key")


def override_roles(explicit: DataFrame, inferred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all roles, inferred ones that an explicit role pushed out)."""
    on = ["case_id", "role_key"]
    keep = inferred.join(spread(explicit.select(*on)), on, "left_anti")
    out = inferred.join(spread(explicit.select(*on)), on, "left_semi")
    return explicit.unionByName(keep), out


def _level(role: str, i: int) -> str:
    return "case " + role + " " + " ".join(f"when '{k}' then {str(v[i]).lower()}" for k, v in PLAN_LEVELS.items()) + " end"


def map_levels(sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K1: (plan sheets with level and stilt flag, levels claimed by more than one sheet)."""
    x = sheets.withColumn("level", F.expr(_level("role_key", 0))).withColumn("is_stilt", F.expr(_level("role_key", 1))).filter("level is not null")
    clash = x.groupBy("case_id", "level").agg(F.count("*").alias("n_sheets")).filter("n_sheets > 1")
    return x, clash


def combined_fallback(sheets: DataFrame) -> DataFrame:
    """A case with one unclassified file uses it as ``combined``; several are an error."""
    n = sheets.groupBy("case_id").agg(F.count("*").alias("n"), F.count("role").alias("n_known"), F.min("upload_pos").alias("first_pos"))
    return n.filter("n_known = 0").selectExpr("case_id", "first_pos", "case when n = 1 then 'combined' else 'error' end as outcome")


def fill_jurisdiction(title_blocks: DataFrame) -> DataFrame:
    """First known plot number and sector over a case's plan sheets."""
    first = lambda c: F.expr(f"min_by({c}, upload_pos) filter (where {c} is not null)").alias(c)
    return title_blocks.groupBy("case_id").agg(first("plot_no"), first("sector"))


def pick_site_sheet(geoms: DataFrame) -> DataFrame:
    """First usable sheet: site or zoning, then combined or ground, then other plans."""
    rank = "case when role_key in ('site', 'zoning') then 0 when role_key = 'combined' then 1 when role_key = 'ground' then 2 else 3 end"
    return geoms.filter("usable").groupBy("case_id").agg(F.expr(f"min_by(role_key, struct({rank}, upload_pos))").alias("role_key"))


def merge_plot(plots: DataFrame, entered: DataFrame, unit: str = "'m'") -> DataFrame:
    """C17: fill a missing plot from the entered size; note a disagreement over 5 %."""
    f = t.ui_unit_factor(unit)
    x = plots.join(spread(entered), "model_id", "left").withColumn("w_m", F.expr(f"width_m * {f}")).withColumn("l_m", F.expr(f"length_m * {f}"))
    typed = "w_m * l_m"
    note = (
        f"case when plot_area_sqm is null and {typed} is not null then 'plot synthesised from the entered size'"
        f" when {typed} <> 0 and abs({typed} - plot_area_sqm) / plot_area_sqm > 0.05D then 'entered size disagrees with the measured plot' end"
    )
    ring = f"case when plot_area_sqm is null and {typed} is not null then {g.rect_ring(0, 0, 'w_m', 'l_m')} else plot_polygon end"
    return x.select("model_id", F.expr(ring).alias("plot_polygon"), F.expr(f"coalesce(plot_area_sqm, {typed})").alias("plot_area_sqm"), F.expr(note).alias("note"))


# ---------------------------------------------------------------- strokes and labels

def label_colour(spans: DataFrame, word: str) -> DataFrame:
    """per sheet the labels found and their commonest chromatic colour (smaller code on a tie)."""
    hit = spans.filter(F.lower("text").contains(word))
    c = hit.groupBy("sheet", "color").agg(F.count("*").alias("n"))
    chromatic = f"case when not {t.achromatic('color')} then color end"
    return c.groupBy("sheet").agg(
        F.sum("n").alias("n_labels"),
        F.expr(f"max_by({chromatic}, case when {chromatic} is not null then struct(n, -color) end)").alias("color"),
    )


def near_colours(labels: DataFrame, strokes: DataFrame) -> DataFrame:
    """Chromatic stroke colours of the sheet within tolerance of the label colour, nearest first."""
    seen = strokes.select("sheet", F.col("color").alias("stroke_color")).distinct().filter(f"not {t.achromatic('stroke_color')}")
    x = labels.filter("color is not null").join(spread(seen), "sheet").withColumn("dist", F.expr(t.colour_dist("color", "stroke_color")))
    w = Window.partitionBy("sheet").orderBy("dist", "stroke_color")
    return x.filter(f"dist <= {t.COLOUR_TOLERANCE}").withColumn("rank", F.row_number().over(w))


def axis_lines(strokes: DataFrame) -> DataFrame:
    """dashed lines rebuilt by 1-point position buckets."""
    return (
        strokes.groupBy("sheet", "color", "axis", F.expr("bround(pos, 0)").alias("line_pos"))
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.expr("hi - lo")).alias("ink"))
    )


def plot_rect(lines: DataFrame) -> DataFrame:
    """The two strongest lines per axis, when both pairs carry comparable ink."""
    w = Window.partitionBy("sheet", "color", "axis").orderBy(F.desc("ink"), "line_pos")
    top = lines.withColumn("k", F.row_number().over(w)).filter("k <= 2")
    ax = top.groupBy("sheet", "color", "axis").agg(
        F.min("line_pos").alias("p0"), F.max("line_pos").alias("p1"), F.min("ink").alias("weak"), F.max("ink").alias("strong"), F.count("*").alias("n")
    )
    ok = ax.filter(f"n = 2 and strong > 0 and weak / strong >= {MIN_INK_RATIO} and p1 - p0 >= 1")
    return ok.groupBy("sheet", "color").agg(
        F.expr("max(p0) filter (where axis = 'v')").alias("x0"), F.expr("max(p0) filter (where axis = 'h')").alias("y0"),
        F.expr("max(p1) filter (where axis = 'v')").alias("x1"), F.expr("max(p1) filter (where axis = 'h')").alias("y1"),
    ).filter("x0 is not null and y0 is not null")


def zoning_envelope(rects: DataFrame, lines: DataFrame) -> DataFrame:
    """Clip the plot by zoning lines that span most of it; shorter runs are counted, not applied.
    ``rects(sheet, x0, y0, x1, y1)``; an envelope equal to the plot is NULL."""
    j = lines.join(spread(rects), "sheet", "right")
    side = "case when axis = 'h' then x1 - x0 else y1 - y0 end"
    x = j.withColumn("major", F.expr(f"hi - lo >= ({side}) * {MAJOR_LINE_FRACTION}D"))
    x = x.withColumn("mid", F.expr("case when axis = 'h' then (y0 + y1) / 2 else (x0 + x1) / 2 end"))
    low = "major and axis = '{}' and line_pos > {} and line_pos < mid"
    high = "major and axis = '{}' and line_pos >= mid and line_pos < {}"
    a = x.groupBy("sheet", "x0", "y0", "x1", "y1").agg(
        F.expr(f"coalesce(max(line_pos) filter (where {low.format('v', 'x0')}), first(x0))").alias("zx0"),
        F.expr(f"coalesce(max(line_pos) filter (where {low.format('h', 'y0')}), first(y0))").alias("zy0"),
        F.expr(f"coalesce(min(line_pos) filter (where {high.format('v', 'x1')}), first(x1))").alias("zx1"),
        F.expr(f"coalesce(min(line_pos) filter (where {high.format('h', 'y1')}), first(y1))").alias("zy1"),
        F.expr(f"count_if(not major and ink > {STEP_INK_PT}D)").alias("n_steps"),
    )
    same = "zx0 = x0 and zy0 = y0 and zx1 = x1 and zy1 = y1"
    return a.select("sheet", "n_steps", *[F.expr(f"case when not ({same}) then {c} end").alias(c) for c in ("zx0", "zy0", "zx1", "zy1")])


def drawing_bbox(rects: DataFrame) -> DataFrame:
    """bounds of what starts left of the title strip; the whole drawing when nothing does.
    ``rects(sheet, x0, y0, x1, y1)``."""
    full = rects.groupBy("sheet").agg(F.min("x0").alias("fx0"), F.max("x1").alias("fx1"))
    x = rects.join(spread(full), "sheet").withColumn("inside", F.expr(f"x0 < fx0 + (fx1 - fx0) * {TITLE_STRIP_FRACTION}D"))
    pick = lambda fn, c: F.expr(f"coalesce({fn}({c}) filter (where inside), {fn}({c}))").alias(c)
    return x.groupBy("sheet").agg(pick("min", "x0"), pick("min", "y0"), pick("max", "x1"), pick("max", "y1"))


def sheet_scale(spans: DataFrame, boxes: DataFrame) -> DataFrame:
    """H6: points per metre from the largest clean dimension; NULL without one."""
    m = spans.select("sheet", F.expr(f"array_max({t.feet_inches_all('text')})").alias("v")).groupBy("sheet").agg(F.max("v").alias("max_m"))
    return boxes.join(spread(m), "sheet", "left").withColumn("scale", F.expr("case when max_m > 0 then greatest(x1 - x0, y1 - y0) / max_m end"))


def sheet_footprint(spans: DataFrame, rects: DataFrame) -> DataFrame:
    """K7 / K9: outline rectangle and drawn width in metres; NULL without a scale."""
    x = sheet_scale(spans, drawing_bbox(rects))
    w, h = "(x1 - x0) / scale", "(y1 - y0) / scale"
    return x.selectExpr("sheet", "scale", f"case when scale is not null then {g.rect_ring(0, 0, w, h)} end as footprint", f"{w} as width_m", f"{h} as depth_m")


def anchored_clusters(values: str, gap: str, strict: str = ">") -> str:
    """Anchors of a sorted 1-D clustering: a value opens a cluster when it lies more than
    ``gap`` from the anchor (the first member) of the current one."""
    step = f"(ca, cv) -> case when size(ca) = 0 or cv - element_at(ca, -1) {strict} {gap} then concat(ca, array(cv)) else ca end"
    return f"aggregate(array_sort({values}), cast(array() as array<double>), {step})"


def storey_estimate(strokes: DataFrame) -> DataFrame:
    """Long thin horizontals clustered by position; clusters - 1 when that is 1..8. Positions are
    whole points, so the distinct set is bounded by the sheet size, not by the stroke count."""
    box = strokes.groupBy("sheet").agg(F.expr("greatest(max(x1) - min(x0), max(y1) - min(y0))").alias("axis"))
    x = strokes.join(spread(box), "sheet").filter("greatest(x1 - x0, y1 - y0) > 0.5D * axis and least(x1 - x0, y1 - y0) < 0.01D * axis + 1")
    a = x.groupBy("sheet").agg(F.first("axis").alias("axis"), F.collect_set(F.expr("bround((y0 + y1) / 2, 0)")).alias("ys"))
    a = a.withColumn("n", F.expr(f"size({anchored_clusters('ys', 'axis * 0.01D')}) - 1"))
    return a.selectExpr("sheet", "case when n between 1 and 8 then n end as storeys")


def largest_wall(polylines: DataFrame) -> DataFrame:
    """H5: largest closed wall outline per sheet, first on a tie. ``polylines(sheet, pos, layer, closed, points)``."""
    w = polylines.filter("closed").filter(f"{t.layer_category('layer')} = 'wall'").withColumn("a", F.expr(g.area("points")))
    return w.groupBy("sheet").agg(F.expr("max_by(points, struct(a, -pos))").alias("footprint"), F.max("a").alias("area"))


def layer_counts(entities: DataFrame) -> DataFrame:
    """F11."""
    return entities.groupBy("layer").agg(F.count("*").alias("n")).withColumn("category", F.expr(t.layer_category("layer")))


def reconcile_heights(readings: DataFrame) -> DataFrame:
    """K5: elevations of a case agree within a tenth of the tallest, which then governs; else NULL."""
    a = readings.groupBy("case_id").agg(F.max(F.expr("bround(height_m, 3)")).alias("hi"), F.min(F.expr("bround(height_m, 3)")).alias("lo"), F.max("height_m").alias("h"))
    return a.selectExpr("case_id", f"case when hi - lo <= hi * {HEIGHT_SPREAD}D then h end as height_m")


def storey_check(floors: DataFrame, estimates: DataFrame) -> DataFrame:
    """K6: plan storeys against the first elevation estimate."""
    n = floors.groupBy("case_id").agg(F.count("*").alias("n_plans"))
    e = estimates.groupBy("case_id").agg(F.expr("min_by(storeys, upload_pos) filter (where storeys is not null)").alias("storeys"))
    return n.join(spread(e), "case_id", "left").withColumn(
        "outcome", F.expr("case when storeys is null then 'inconclusive' when storeys = n_plans then 'agree' else 'mismatch' end")
    )


def apportion_height(heights: DataFrame, segments: DataFrame, floors: DataFrame) -> DataFrame:
    """Segments shared top-down over the storeys when they divide evenly, else all on the top
    floor. ``heights(case_id, height_m)``, ``segments(case_id, seg, value_m)`` top first (seg from 1)."""
    fl = floors.filter("not is_stilt").select("case_id", "level")
    w = Window.partitionBy("case_id").orderBy(F.desc("level"))
    fl = fl.withColumn("top_rank", F.row_number().over(w) - 1)
    n = fl.groupBy("case_id").agg(F.count("*").alias("n_floors"))
    s = segments.groupBy("case_id").agg(F.count("*").alias("n_seg"))
    even = "n_seg > 0 and n_seg % n_floors = 0"
    plan = heights.join(spread(n), "case_id").join(spread(s), "case_id", "left").withColumn("even", F.expr(f"coalesce({even}, false)"))
    per = segments.join(spread(plan.filter("even")), "case_id").withColumn("top_rank", F.expr("cast(floor((seg - 1) / (n_seg / n_floors)) as int)"))
    per = per.groupBy("case_id", "top_rank").agg(F.sum("value_m").alias("share"))
    x = fl.join(spread(plan), "case_id").join(spread(per), ["case_id", "top_rank"], "left")
    return x.selectExpr("case_id", "level", "case when even then share when top_rank = 0 then height_m end as height_m")


# ---------------------------------------------------------------- dimension chains and scale

def dxf_height(dimensions: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Overall height of a sheet from its vertical dimensions ``(sheet, measurement, angle, dx, dy, y)``:
    the largest when it is 1.5x the next, else the largest when a contiguous run of the others (by
    y) sums to it; the longest such run counts. Prefix sums turn runs into a range join that is keyed
    by sheet."""
    v = dimensions.filter("measurement > 0").filter(t.is_vertical("angle", "dx", "dy"))
    w = Window.partitionBy("sheet").orderBy(F.desc("measurement"), "y")
    r = v.withColumn("k", F.row_number().over(w))
    top = r.groupBy("sheet").agg(
        F.expr("max(measurement) filter (where k = 1)").alias("largest"), F.expr("max(measurement) filter (where k = 2)").alias("second")
    )
    sure = top.filter("second is null or largest >= 1.5D * second").selectExpr("sheet", "largest as height_m", "cast(1 as bigint) as n_segments")
    wy = Window.partitionBy("sheet").orderBy("y", "k")
    rest = r.filter("k > 1").join(spread(top.filter("largest < 1.5D * second").select("sheet", "largest")), "sheet")
    p = rest.withColumn("i", F.row_number().over(wy)).withColumn("upto", F.sum("measurement").over(wy.rowsBetween(Window.unboundedPreceding, 0)))
    # The start of a run is found by its prefix sum: an equi-join on buckets of the tolerance, never all
    # pairs of a sheet.
    cell = f"{2 * tolerance}D"
    s = p.select("sheet", F.col("i").alias("si"), (F.col("upto") - F.col("measurement")).alias("before")).withColumn("bk", F.expr(f"cast(floor(before / {cell}) as bigint)"))
    e = p.withColumn("need", F.expr("upto - largest")).withColumn("bk", F.expr(f"explode(array(cast(floor(need / {cell}) as bigint) - 1, cast(floor(need / {cell}) as bigint), cast(floor(need / {cell}) as bigint) + 1))"))
    run = e.join(spread(s), ["sheet", "bk"]).filter(f"i >= si and abs(upto - before - largest) <= {tolerance}D")
    chain = run.groupBy("sheet", "largest").agg(F.max(F.expr("cast(i - si + 1 as bigint)")).alias("n_segments"))
    return sure.unionByName(chain.selectExpr("sheet", "largest as height_m", "n_segments"))


def dim_chains(tokens: DataFrame) -> DataFrame:
    """Vertical dimension chains: tokens ``(sheet, pos, inches, x, y)`` clustered by x around the first
    member of each cluster, three or more members, ordered by y with running sums.

    Anchors come from the distinct whole-point positions of a sheet, so the fold is over a bounded set."""
    xs = tokens.groupBy("sheet").agg(F.collect_set("x").alias("xs"))
    anchors = xs.select("sheet", F.expr(anchored_clusters("xs", f"{CHAIN_X_PT}D", ">=")).alias("anchors"))
    x = tokens.join(spread(anchors), "sheet").withColumn("chain", F.expr(f"array_max(filter(anchors, ca -> ca <= x))")).drop("anchors")
    n = x.groupBy("sheet", "chain").agg(F.count("*").alias("n"), F.avg("x").alias("chain_x")).filter("n >= 3")
    w = Window.partitionBy("sheet", "chain").orderBy("y", "pos")
    return x.join(spread(n), ["sheet", "chain"]).withColumn("i", F.row_number().over(w)).withColumn(
        "upto", F.sum("inches").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )


def bracket_height(tokens: DataFrame) -> DataFrame:
    """The largest bracket (15 to 120 points beside a chain) that equals a contiguous run of two or
    more chain segments within half an inch, in metres. Dimensions are whole inches, so that is
    equality: the start of a run is looked up by its prefix sum instead of pairing all tokens."""
    c = dim_chains(tokens)
    b = tokens.selectExpr("sheet", "inches as total", "x as bx").distinct()
    ends = c.join(spread(b), "sheet").filter(f"abs(bx - chain_x) >= {CHAIN_X_PT} and abs(bx - chain_x) < 120")
    ends = ends.selectExpr("sheet", "chain", "i", "total", "upto - total as before").distinct()
    starts = c.selectExpr("sheet", "chain", "i as si", "upto - inches as before")
    hit = ends.join(spread(starts), ["sheet", "chain", "before"]).filter("i > si")
    return hit.groupBy("sheet").agg(F.max(F.expr(f"total * {t.M_PER_INCH}")).alias("height_m"))


def _spans(axis: str, c: str) -> str:
    a, b = ("y", "x") if axis == "y" else ("x", "y")
    return (
        f"(abs({c}.{a} - ({a}0 + {a}1) / 2) <= ({a}1 - {a}0) * 0.2D and {c}.{b} >= {b}0 - ({b}1 - {b}0) * 0.35D"
        f" and {c}.{b} <= {b}1 + ({b}1 - {b}0) * 0.35D)"
    )


def verified_scale(rects: DataFrame, tokens: DataFrame) -> DataFrame:
    """C14: scale of each rectangle, accepted only when printed dimensions account for both axes within
    3 %. ``tokens(sheet, m, x, y)``; tokens are first cut to the distinct values alongside each axis,
    which is what the pairing runs over."""
    longest = tokens.groupBy("sheet").agg(F.max("m").alias("longest"))
    j = rects.join(spread(tokens.filter("m >= 3")), "sheet").withColumn("tk", F.struct("x", "y"))
    key = [c for c in rects.columns]
    along = lambda axis, name: j.filter(_spans(axis, "tk")).select(*key, F.col("m").alias(name)).distinct()
    both = along("y", "my").join(spread(along("x", "mx")), key)
    w, h = "(x1 - x0)", "(y1 - y0)"
    rows = (
        f"inline(array(named_struct('scale', {h} / my, 'err', abs(mx - {w} / ({h} / my)) / ({w} / ({h} / my)), 'total', my + mx),"
        f" named_struct('scale', {w} / mx, 'err', abs(my - {h} / ({w} / mx)) / ({h} / ({w} / mx)), 'total', my + mx)))"
    )
    cand = both.select(*key, F.expr(rows)).join(spread(longest), "sheet").filter(f"err <= 0.03D and greatest({w}, {h}) / scale >= longest * 0.98D")
    return cand.groupBy(*key).agg(F.expr("min_by(scale, struct(-total, err))").alias("scale"))


def wall_thickness(shapes: DataFrame, scales: DataFrame) -> DataFrame:
    """masonry colour and thickness of a sheet. ``shapes(sheet, color, thin, ...)`` are long thin
    shapes inside the plot; the mode of whole points, the upper median inside the mode, a real masonry
    thickness (0.08-0.45 m), a 30 % share and 12 shapes decide; most shapes win.

    Counts per distinct thickness replace sorted lists, so a colour with very many shapes stays spread."""
    c = shapes.groupBy("sheet", "color", "thin").agg(F.count("*").alias("c")).withColumn("pt", F.expr("bround(thin, 0)"))
    m = c.groupBy("sheet", "color", "pt").agg(F.sum("c").alias("n"))
    a = m.groupBy("sheet", "color").agg(F.sum("n").alias("n_all"), F.expr("max_by(pt, struct(n, -pt))").alias("modal"), F.max("n").alias("n_modal"))
    inside = c.join(spread(a), ["sheet", "color"]).filter("pt = modal")
    w = Window.partitionBy("sheet", "color").orderBy("thin").rowsBetween(Window.unboundedPreceding, 0)
    med = inside.withColumn("upto", F.sum("c").over(w)).filter("upto > floor(n_modal / 2)")
    x = med.groupBy("sheet", "color", "n_all", "n_modal").agg(F.min("thin").alias("thin")).join(spread(scales), "sheet")
    x = x.withColumn("thickness_m", F.expr("thin / scale"))
    ok = x.filter("n_all >= 12 and thickness_m between 0.08D and 0.45D and n_modal / n_all >= 0.30D")
    return ok.groupBy("sheet").agg(F.expr("max_by(struct(color, thickness_m), struct(n_all, -color))").alias("b")).select("sheet", "b.*")


# ---------------------------------------------------------------- assembly

def build_floors(sheets: DataFrame, footprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K2: (floors, dropped plan sheets with a note). A sheet without an outline gives no floor."""
    x = sheets.join(spread(footprints), ["case_id", "role_key"], "left")
    return x.filter("footprint is not null"), x.filter("footprint is null").selectExpr("case_id", "role_key", "'no usable outline' as note")


def dxf_rooms(polylines: DataFrame) -> DataFrame:
    """K3: closed outlines on room layers."""
    use = "case " + t.layer_category("layer") + " when 'room_bath' then 'wc' else replace(" + t.layer_category("layer") + ", 'room_', '') end"
    return polylines.filter("closed").filter(f"startswith({t.layer_category('layer')}, 'room_')").withColumn("use", F.expr(use)).withColumn("confidence", F.lit("medium"))


def label_rooms(spans: DataFrame, scales: DataFrame) -> DataFrame:
    """K4: room labels sized by the next two lines, else by a default. ``spans(sheet, pos, text, x, y)`` with
    dense ``pos``; the look-ahead is a join on (sheet, pos), so no sheet is sorted in one task."""
    nxt = lambda n: spans.select("sheet", (F.col("pos") - n).alias("pos"), F.col("text").alias(f"t{n}"))
    x = spans.withColumn("u", F.expr(t.room_use("text"))).filter("u is not null").join(spread(nxt(1)), ["sheet", "pos"], "left").join(spread(nxt(2)), ["sheet", "pos"], "left")
    x = x.withColumn("dims", F.expr(t.feet_inches_all("concat_ws(' ', t1, t2)"))).join(spread(scales), "sheet")
    return x.selectExpr(
        "sheet", "pos", "u.use as use", "case when size(dims) >= 2 then 'medium' else 'low' end as confidence",
        "case when size(dims) >= 2 then dims[0] else u.w end as width_m", "case when size(dims) >= 2 then dims[1] else u.h end as depth_m",
        "x / scale as x_m", "y / scale as y_m",
    )


def edge_roles(setbacks: DataFrame) -> DataFrame:
    """``(sheet, bottom, top, left_, right_)`` zoning setbacks -> role of each side. Two flush sides
    (under 0.05 m) and two open ones identify the pair; the smaller open setback is the front."""
    sides = "array(" + ", ".join(f"named_struct('o', {i}, 'side', '{n}', 's', {c})" for i, (n, c) in enumerate((("bottom", "bottom"), ("top", "top"), ("left", "left_"), ("right", "right_")))) + ")"
    x = setbacks.withColumn("sides", F.expr(sides)).withColumn("flush", F.expr("filter(sides, s -> s.s < 0.05D)")).withColumn(
        "open", F.expr("array_sort(transform(filter(sides, s -> s.s >= 0.05D), s -> named_struct('s', s.s, 'o', s.o, 'side', s.side)))")
    )
    role = (
        "case when size(flush) = 2 and size(open) = 2 then case sd.side when open[0].side then 'front' when open[1].side then 'rear'"
        " when flush[0].side then 'side_a' else 'side_b' end else 'unknown' end"
    )
    return x.select("sheet", "flush", "open", F.expr("explode(sides)").alias("sd")).selectExpr("sheet", "sd.side as side", "sd.s as setback_m", f"{role} as role")


def built_extent(plots: DataFrame, walls: DataFrame) -> DataFrame:
    """Distance from each plot side to the nearest wall shape, in metres; the hull itself is
    :func:`parapet.operators.hull.hull` over the shapes' corners. ``plots(sheet, x0, y0, x1, y1, scale)``."""
    w = walls.selectExpr("sheet", "x0 as wx0", "y0 as wy0", "x1 as wx1", "y1 as wy1")
    x = plots.join(spread(w), "sheet")
    # distance of the shape's box to the side as a segment; a shape across the side touches it
    dx, dy = "greatest(0D, x0 - wx1, wx0 - x1)", "greatest(0D, y0 - wy1, wy0 - y1)"
    to_y = lambda s: f"min(sqrt(pow({dx}, 2) + pow(greatest(0D, wy0 - {s}, {s} - wy1), 2)) / scale)"
    to_x = lambda s: f"min(sqrt(pow({dy}, 2) + pow(greatest(0D, wx0 - {s}, {s} - wx1), 2)) / scale)"
    return x.groupBy("sheet").agg(F.expr(to_y("y1")).alias("bottom"), F.expr(to_y("y0")).alias("top"), F.expr(to_x("x0")).alias("left_"), F.expr(to_x("x1")).alias("right_"))


def reanchor(floors: DataFrame, geoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Floors re-anchored to their sheet's hull and marked as an upper bound; and the roles that
    could not be aligned. ``geoms(case_id, role_key, hull)``."""
    x = floors.join(spread(geoms), ["case_id", "role_key"], "left")
    out = x.withColumn("footprint", F.coalesce("hull", "footprint")).withColumn("footprint_is_upper_bound", F.col("hull").isNotNull()).drop("hull")
    return out, x.filter("hull is null").select("case_id", "role_key")


def plot_geometry(labels: DataFrame, strokes: DataFrame, tokens: DataFrame, hint: DataFrame | None = None) -> DataFrame:
    """K8: plot rectangle, scale and area per sheet: the nearest stroke colour whose rectangle a scale
    confirms. ``hint(sheet, hint)`` lends a scale from another sheet of the set."""
    near = near_colours(label_colour(labels, "plot line"), strokes).select("sheet", F.col("stroke_color").alias("color"), "rank")
    rect = plot_rect(axis_lines(strokes)).join(spread(near), ["sheet", "color"])
    sc = rect.join(spread(verified_scale(rect, tokens)), rect.columns, "left")
    if hint is not None:
        sc = sc.join(spread(hint), "sheet", "left").withColumn("scale", F.coalesce("scale", "hint")).drop("hint")
    best = sc.filter("scale is not null").groupBy("sheet").agg(F.min_by(F.struct("color", "x0", "y0", "x1", "y1", "scale"), "rank").alias("b")).select("sheet", "b.*")
    return best.withColumn("plot_area_sqm", F.expr("((x1 - x0) / scale) * ((y1 - y0) / scale)"))
