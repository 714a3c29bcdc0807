"""Repair search (M1-M16, C16, H3, H4, I2, J24): generate, re-evaluate, keep, rank.

Candidates are rows keyed by ``(model_id, cand_seq)``. The edited tables carry both keys and go through
the same :func:`parapet.plans.evaluate.evaluate` as ordinary models, so "re-run the whole rule set"
is one more job, not a loop. Only models with a violation enter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parapet.functions import geometry as g
from parapet.functions import polygons
from parapet.operators.running import running
from parapet.session import cut_lineage, spread

# The search grid.
STEPS = 30
STEP_M = 0.1
STAIR_OFFSETS = (-0.3, -0.1, 0.1, 0.3)
RELABEL_USES = ("bedroom", "living", "store", "other")
# Keywords that route a violation to edit operations.
ROUTES = {
    "wall": ("setback", "zon", "containment", "envelope"),
    "all_walls": ("far", "floor area ratio", "coverage"),
    "projection": ("projection", "chajja", "balcony"),
    "basement": ("basement",),
    "room": ("room", "light", "ventilation", "dimension"),
}
NOC_WORDS = ("periphery", "noc", "defence", "highway", "control line", "no-development", "mullanpur")

KEYS = ("model_id", "cand_seq")


def _mentions(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


def route_edit(text: str) -> dict[str, str]:
    """One predicate per edit class over the lower-cased rule id and title."""
    return {k: _mentions(text, ws) for k, ws in ROUTES.items()}


def violated_roles(text: str, roles: str) -> str:
    """Roles named in the text, else all known roles."""
    hit = f"filter({roles}, vr -> vr <> 'unknown' and contains({text}, vr))"
    return f"case when size({hit}) > 0 then {hit} else filter({roles}, vr -> vr <> 'unknown') end"


def targets(violations: DataFrame) -> DataFrame:
    """Last violation of each rule per model, with its routing text."""
    t = violations.filter("status = 'violation'").groupBy("model_id", "rule_id").agg(
        F.max_by("title", "finding_seq").alias("title"), F.min("finding_seq").alias("first_seq")
    )
    t = t.withColumn("text", F.expr("lower(concat(rule_id, ' ', title))"))
    return t.select("*", *[F.expr(e).alias(f"to_{k}") for k, e in route_edit("text").items()])


_EDIT = {
    "op": "string", "floor_pos": "int", "level": "int", "edge": "string", "pos": "int", "room_index": "int",
    "delta_m": "double", "dx": "double", "dy": "double", "new_use": "string",
}


def _edit(df: DataFrame, rank: int, order: list[str], **cols: str) -> DataFrame:
    """Common shape; ``ord`` is the enumeration order inside the target."""
    return df.select(
        "model_id", "rule_id", "first_seq",
        F.expr(f"struct({rank} as a, " + ", ".join(f"cast({c} as int) as o{i}" for i, c in enumerate((order + ['0'] * 4)[:4])) + ")").alias("ord"),
        *[F.expr(cols.get(c, "null")).cast(t).alias(c) for c, t in _EDIT.items()],
    )


def edit_grid(violations: DataFrame, tables: dict[str, DataFrame], furthest: bool = False) -> DataFrame:
    """M1: every candidate edit of every target; steps that would collapse a wall or the basement are cut
    off before ``explode``. With ``furthest`` only the wall edits, each at its last step.

    ``cand_seq`` is unique per model and follows the enumeration order of each target.
    """
    # Six branches read the targets; writing them once keeps the checks from being re-run for each.
    t = cut_lineage(targets(violations))
    step = f"explode(sequence(1, {STEPS}))"
    delta = "k / 10D"
    edges = tables["edges"].select("model_id", "edge_pos", "role", F.expr(f"case when {_horizontal('line')} then 'y' else 'x' end").alias("axis"))
    floors = tables["floors"].select("model_id", "floor_pos", "level", F.expr(g.bounds("footprint")).alias("b"))
    first = floors.groupBy("model_id", "level").agg(F.min_by(F.struct("floor_pos", "b"), "floor_pos").alias("f"))
    # steps before the outline collapses along the axis that the edge moves
    stay = "{1}.{0}min + k / 10D < {1}.{0}max and {1}.{0}min < {1}.{0}max - k / 10D"
    live = f"filter(sequence(1, {STEPS}), k -> case when axis = 'y' then {stay.format('y', 'b')} else {stay.format('x', 'b')} end)"
    if furthest:
        live = f"slice({live}, -1, 1)"

    # One wall, one floor: edges named by the violation, else all known ones.
    named = edges.join(spread(t.filter("to_wall").select("model_id", "rule_id", "first_seq", "text")), "model_id").filter("role <> 'unknown'")
    any_named = named.groupBy("model_id", "rule_id").agg(F.bool_or(F.expr("contains(text, role)")).alias("any_named"))
    wall = named.join(spread(any_named), ["model_id", "rule_id"]).filter("not any_named or contains(text, role)").drop("any_named")
    wall = wall.join(spread(first.selectExpr("model_id", "level", "f.floor_pos as floor_pos", "f.b as b")), "model_id").select("*", F.expr(f"explode({live})").alias("k"))
    parts = [_edit(wall, 1, ["edge_pos", "floor_pos", "k"], op="'shrink_wall'", floor_pos="floor_pos", level="level", edge="role", delta_m=delta)]

    # the narrowest floor along each axis bounds an edit of all floors
    narrow = floors.groupBy("model_id").agg(*[F.min_by(F.struct(f"b.{a}min", f"b.{a}max"), F.expr(f"b.{a}max - b.{a}min")).alias(a) for a in "xy"])
    narrow = narrow.selectExpr("model_id", "named_struct('xmin', x.xmin, 'xmax', x.xmax, 'ymin', y.ymin, 'ymax', y.ymax) as b")
    allw = t.filter("to_all_walls").join(spread(edges.filter("role <> 'unknown'")), "model_id").join(spread(narrow), "model_id").select("*", F.expr(f"explode({live})").alias("k"))
    parts.append(_edit(allw, 2, ["edge_pos", "k"], op="'shrink_wall_all_floors'", edge="role", delta_m=delta))

    if furthest:
        return _numbered(parts)

    pr = tables["projections"].select("model_id", "pos")
    trim = t.filter("to_projection").join(spread(pr), "model_id").select("*", F.expr(step).alias("k"))
    parts.append(_edit(trim, 3, ["pos", "k"], op="'trim_projection'", pos="pos", delta_m=delta))

    base = first.filter("level = -1").selectExpr("model_id", "f.floor_pos as floor_pos", "least(f.b.xmax - f.b.xmin, f.b.ymax - f.b.ymin) as span")
    # The inset vanishes once twice the step reaches the short side.
    dig = t.filter("to_basement").join(spread(base), "model_id").select("*", F.expr(step).alias("k")).filter(f"2 * {delta} < span")
    parts.append(_edit(dig, 4, ["k"], op="'reduce_basement_footprint'", floor_pos="floor_pos", level="-1", delta_m=delta))

    rooms = t.filter("to_room").join(spread(tables["rooms"].select("model_id", "floor_pos", "level", "room_index", "use", "polygon")), "model_id")
    new = f"explode(array_except(array({', '.join(repr(u) for u in RELABEL_USES)}), array(use)))"
    rel = rooms.select("*", F.expr(new).alias("new_use")).withColumn("k", F.expr(f"array_position(array({', '.join(repr(u) for u in RELABEL_USES)}), new_use)"))
    parts.append(_edit(rel, 5, ["floor_pos", "room_index", "k"], op="'reclassify_room'", floor_pos="floor_pos", level="level", room_index="room_index", new_use="new_use"))

    parts.append(_edit(shift_stair(rooms, tables["plots"]), 5, ["floor_pos", "room_index", "k"], op="'shift_stair'", floor_pos="floor_pos", level="level", room_index="room_index", dx="dx", dy="dy"))
    return _numbered(parts)


def _numbered(parts: list[DataFrame]) -> DataFrame:
    out = reduce(DataFrame.unionByName, parts)
    # 11+11+9 bits of step orders keep the sequence unique and ordered; positions are list positions.
    seq = "(((ord.a * 4194304L + ord.o0) * 4194304L + ord.o1) * 64L + ord.o2)"
    return out.withColumn("cand_order", F.expr(seq)).withColumn("cand_seq", F.expr("concat_ws(':', rule_id, cand_order)")).drop("ord")


def cap_candidates(candidates: DataFrame, n: int) -> DataFrame:
    """H4: the first ``n`` candidates of each target in enumeration order. The search itself has no cap."""
    x = running(candidates, ["model_id", "rule_id"], "cand_order", sums={"cand_rank": "1"}, block=1 << 26)
    return x.filter(F.col("cand_rank") <= n)


# ---------------------------------------------------------------- single edits

def _horizontal(line: str) -> str:
    return f"(abs(element_at({line}, -1).x - {line}[0].x) >= abs(element_at({line}, -1).y - {line}[0].y))"


def _facing(line: str, centre: str) -> tuple[str, str, str]:
    """Conditions on an edge: horizontal, at the top and at the right of the centre."""
    x0, y0, x1, y1 = f"{line}[0].x", f"{line}[0].y", f"element_at({line}, -1).x", f"element_at({line}, -1).y"
    return _horizontal(line), f"(({y0} + {y1}) / 2D >= {centre}.y)", f"(({x0} + {x1}) / 2D >= {centre}.x)"


def _moved_bounds(b: str, line: str, centre: str, d: str) -> str:
    """Bounds after pulling in the wall that faces an edge: a horizontal edge moves the y extent."""
    horizontal, top, right = _facing(line, centre)
    return (
        f"named_struct('xmin', case when not {horizontal} and not {right} then {b}.xmin + {d} else {b}.xmin end,"
        f" 'ymin', case when {horizontal} and not {top} then {b}.ymin + {d} else {b}.ymin end,"
        f" 'xmax', case when not {horizontal} and {right} then {b}.xmax - {d} else {b}.xmax end,"
        f" 'ymax', case when {horizontal} and {top} then {b}.ymax - {d} else {b}.ymax end)"
    )


def _moved_side(line: str, centre: str) -> str:
    """The name of the bound that :func:`_moved_bounds` moves."""
    horizontal, top, right = _facing(line, centre)
    return (
        f"(case when {horizontal} then case when {top} then 'ymax' when not {top} then 'ymin' end"
        f" when not {horizontal} then case when {right} then 'xmax' when not {right} then 'xmin' end end)"
    )


def _alive(nb: str) -> str:
    return f"({nb}.xmin < {nb}.xmax and {nb}.ymin < {nb}.ymax)"


def shrink_wall(floors: DataFrame, edges: DataFrame, plots: DataFrame, delta: str) -> DataFrame:
    """M2: every floor x known edge at ``delta``; a collapsed outline is dropped."""
    c = plots.select("model_id", F.expr(g.centroid("plot_polygon")).alias("centre"))
    # which side of an outline an edge moves is the same on all floors
    moved = edges.filter("role <> 'unknown'").join(spread(c), "model_id").select("model_id", "edge_pos", "role", F.expr(_moved_side("line", "centre")).alias("side"))
    x = floors.withColumn("b", F.expr(g.bounds("footprint"))).join(spread(moved), "model_id")
    pulled = {k: f"case when side = '{k}' then b.{k} {sign} {delta} else b.{k} end" for k, sign in (("xmin", "+"), ("ymin", "+"), ("xmax", "-"), ("ymax", "-"))}
    x = x.filter(f"{pulled['xmin']} < {pulled['xmax']} and {pulled['ymin']} < {pulled['ymax']}")
    return x.withColumn("nb", F.expr("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in pulled.items()) + ")")).drop("side")


def shrink_all(floors: DataFrame, edges: DataFrame, plots: DataFrame, delta: str) -> DataFrame:
    """M3: all floors of a model per edge; the candidate dies if one floor collapses."""
    one = shrink_wall(floors, edges, plots, delta)
    n = floors.groupBy("model_id").agg(F.count("*").alias("n_all"))
    done = one.groupBy("model_id", "role").agg(
        F.count("*").alias("n_left"), F.sum(F.expr("(nb.xmax - nb.xmin) * (nb.ymax - nb.ymin)")).alias("area_after")
    )
    return done.join(spread(n), "model_id").filter("n_left = n_all").select("model_id", "role", "area_after")


def trim_projection(projections: DataFrame, delta: str) -> DataFrame:
    """M4: a projection that vanishes gets a NULL outline and is dropped from the model."""
    return polygons.inset_any(projections, "polygon", delta, "trimmed")


def reclassify(rooms: DataFrame) -> DataFrame:
    """M5."""
    uses = ", ".join(f"'{u}'" for u in RELABEL_USES)
    return rooms.select("*", F.expr(f"explode(array_except(array({uses}), array(use)))").alias("new_use"))


def shift_stair(rooms: DataFrame, plots: DataFrame) -> DataFrame:
    """M6: stair rooms on the offset grid, kept only inside the plot.

    A shift moves the bounds of a room by as much, so that offsets out of the plot's bounds go before a row
    is made of them; in a rectangular plot the others are inside. Only rings of other plots are joined."""
    rect = f"coalesce({g.is_rect('plot_polygon', 'p_b')}, false)"
    p = plots.select("model_id", "plot_polygon", F.expr(g.bounds("plot_polygon")).alias("p_b"))
    p = p.select("model_id", "p_b", F.expr(f"case when not {rect} then plot_polygon end").alias("p_ring"))
    x = rooms.filter("use = 'stair'").withColumn("r_b", F.expr(g.bounds("polygon"))).join(spread(p), "model_id")

    def free(axis: str, at: str) -> str:
        offs = "array(" + ", ".join(f"named_struct('i', {i}, 'd', {d}D)" for i, d in enumerate(STAIR_OFFSETS)) + ")"
        return f"explode(filter({offs}, so -> r_b.{axis}min + so.d >= p_b.{axis}min and r_b.{axis}max + so.d <= p_b.{axis}max)) as {at}"

    x = x.selectExpr("*", free("x", "o_x")).selectExpr("*", free("y", "o_y")).selectExpr("*", "10 + 4 * o_x.i + o_y.i as k", "o_x.d as dx", "o_y.d as dy")
    # an array of one: the test refers to the moved ring many times
    bent = f"exists(array({g.translate('polygon', 'dx', 'dy')}), sm -> {g.within('sm', 'p_ring')})"
    return x.filter(f"p_ring is null or {bent}").drop("p_ring", "p_b", "r_b", "o_x", "o_y").withColumn("moved", F.expr(g.translate("polygon", "dx", "dy")))


def reduce_basement(floors: DataFrame, delta: str) -> DataFrame:
    """M7: first floor at level -1; a vanished basement is no candidate."""
    f = floors.filter("level = -1").groupBy("model_id").agg(F.min_by(F.struct("floor_pos", "footprint"), "floor_pos").alias("f"))
    f = f.selectExpr("model_id", "f.floor_pos", "f.footprint")
    return polygons.inset_any(f, "footprint", delta, "reduced").filter("reduced is not null")


# ---------------------------------------------------------------- edited tables

def apply_edits(candidates: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables of every candidate, keyed by (model_id, cand_seq). Edges and courtyards stay per model."""
    edit = candidates.select(*KEYS, *_EDIT)
    centre = tables["plots"].select("model_id", F.expr(g.centroid("plot_polygon")).alias("centre"))
    lines = tables["edges"].groupBy("model_id", F.col("role").alias("edge")).agg(F.min_by("line", "edge_pos").alias("edge_line"))
    e = edit.join(spread(lines), ["model_id", "edge"], "left").join(spread(centre), "model_id")
    short = e.select(*KEYS, "op", F.col("floor_pos").alias("e_floor"), F.col("level").alias("e_level"), "edge_line", "centre", "delta_m",
                     F.col("room_index").alias("e_room"), F.col("pos").alias("e_pos"), "new_use", "dx", "dy")

    fl = tables["floors"].withColumn("b", F.expr(g.bounds("footprint"))).join(spread(short), "model_id")
    hit = "(op = 'shrink_wall' and floor_pos = e_floor) or op = 'shrink_wall_all_floors'"
    fl = fl.withColumn("nb", F.expr(f"case when {hit} then {_moved_bounds('b', 'edge_line', 'centre', 'delta_m')} end"))
    dug = "(op = 'reduce_basement_footprint' and floor_pos = e_floor)"
    plain = (
        f"case when nb is not null then case when {_alive('nb')} then {g.rect_ring('nb.xmin', 'nb.ymin', 'nb.xmax', 'nb.ymax')} end"
        f" when {dug} then {g.inset('footprint', 'delta_m')} else footprint end"
    )
    fl = polygons.inset_any(fl, "footprint", "delta_m", "new_fp", when=dug, convex=plain)
    dead = fl.filter("new_fp is null and footprint is not null").select(*KEYS).distinct()
    floors = fl.select(*KEYS, "floor_pos", "level", "is_stilt", F.col("new_fp").alias("footprint"), "height_m", "footprint_is_upper_bound")

    changed = fl.filter(f"{hit} or (op = 'reduce_basement_footprint' and floor_pos = e_floor)").select(
        *KEYS, F.col("floor_pos"), F.expr(g.bounds("new_fp")).alias("box")
    )
    rm = tables["rooms"].join(spread(short.drop("edge_line", "centre", "delta_m", "e_level", "e_pos")), "model_id").join(spread(changed), [*KEYS, "floor_pos"], "left")
    mine = "floor_pos = e_floor and room_index = e_room"
    clipped = f"case when box is not null then {g.clip_rect('polygon', 'box')} else polygon end"
    rm = polygons.clip_any(rm, "polygon", "box", "clipped", when="box is not null", convex=clipped)
    rooms = rm.select(
        *KEYS, "floor_pos", "level", "room_index",
        F.expr(f"case when op = 'reclassify_room' and {mine} then new_use else use end").alias("use"),
        F.expr(
            f"case when op = 'shift_stair' and {mine} then {g.translate('polygon', 'dx', 'dy')}"
            " else clipped end"
        ).alias("polygon"),
        "openings_area_sqm", "confidence",
    )
    pj = tables["projections"].join(spread(short.select(*KEYS, "op", "e_pos", "delta_m")), "model_id")
    trimmed = "(op = 'trim_projection' and pos = e_pos)"
    plain = f"case when {trimmed} then {g.inset('polygon', 'delta_m')} else polygon end"
    pj = polygons.inset_any(pj, "polygon", "delta_m", when=trimmed, convex=plain)
    projections = pj.filter("not (op = 'trim_projection' and pos = e_pos and polygon is null)").select(*KEYS, "pos", "type", "floor", "polygon")
    plots = tables["plots"].join(spread(edit.select(*KEYS)), "model_id").join(spread(dead), list(KEYS), "left_anti")
    alive = plots.select(*KEYS)
    return {
        "plots": plots,
        "edges": tables["edges"],
        "floors": floors.join(spread(alive), list(KEYS), "left_semi"),
        "rooms": rooms.join(spread(alive), list(KEYS), "left_semi"),
        "projections": projections.join(spread(alive), list(KEYS), "left_semi"),
        "courtyards": tables["courtyards"],
    }


def _violated(findings: DataFrame, keys) -> DataFrame:
    return findings.filter("status = 'violation'").select(*keys, "rule_id").distinct()


def no_regress(cand_findings: DataFrame, base_findings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates that violate no rule the unedited model did not violate."""
    base = _violated(base_findings, ["model_id"])
    fresh = _violated(cand_findings, KEYS).join(spread(base), ["model_id", "rule_id"], "left_anti")
    return candidates.join(spread(fresh.select(*KEYS).distinct()), list(KEYS), "left_anti")


def rule_diff(base: DataFrame, new: DataFrame, key: str = "model_id") -> DataFrame:
    """Per key the rule ids cleared (base - new) and regressed (new - base); sets of rule ids are
    bounded by the rule table. Inputs: distinct (key, rule_id)."""
    b = base.groupBy(key).agg(F.collect_set("rule_id").alias("b"))
    n = new.groupBy(key).agg(F.collect_set("rule_id").alias("n"))
    none = F.array().cast("array<string>")
    return b.join(spread(n), key, "full").select(
        key,
        F.array_sort(F.array_except(F.coalesce("b", none), F.coalesce("n", none))).alias("cleared"),
        F.array_sort(F.array_except(F.coalesce("n", none), F.coalesce("b", none))).alias("regressed"),
    )


def area_lost(cand_floors: DataFrame, floors: DataFrame, keys=KEYS) -> DataFrame:
    """Drop in the sum of floor outlines (projections do not count)."""
    a = cand_floors.groupBy(*keys).agg(F.sum(F.expr(g.area("footprint"))).alias("after"))
    b = floors.groupBy("model_id").agg(F.sum(F.expr(g.area("footprint"))).alias("before"))
    return a.join(spread(b), "model_id").select(*keys, F.expr("abs(before - after)").alias("area_lost_sqm"))


def area_lost_on_floor(footprint: str, nb: str) -> str:
    """M10 of an edit that gives one floor the outline ``nb`` (bounds): all other floors cancel out."""
    return f"abs({g.area(footprint)} - {g.width(nb)} * {g.depth(nb)})"


def accept(candidates: DataFrame, cand_findings: DataFrame, base_findings: DataFrame) -> DataFrame:
    """M9: target cleared, nothing regressed; with the number of rules cleared."""
    now = _violated(cand_findings, KEYS)
    still = now.select(*KEYS, "rule_id")
    kept = no_regress(cand_findings, base_findings, candidates).join(spread(still), [*KEYS, "rule_id"], "left_anti")
    base_n = _violated(base_findings, ["model_id"]).groupBy("model_id").agg(F.count("*").alias("n_base"))
    left_n = now.groupBy(*KEYS).agg(F.count("*").alias("n_left"))
    return (
        kept.join(spread(base_n), "model_id")
        .join(spread(left_n), list(KEYS), "left")
        .withColumn("n_cleared", F.expr("n_base - coalesce(n_left, 0)"))
        .drop("n_base", "n_left")
    )


def top_candidates(candidates: DataFrame, n: int = 3) -> DataFrame:
    """H3: cheapest first, then enumeration order; Spark cuts each task's groups to ``n`` before the
    shuffle (window group limit)."""
    w = Window.partitionBy("model_id", "rule_id").orderBy("area_lost_sqm", "cand_order")
    return candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def describe_edit() -> str:
    """Wording of an edit from its own fields."""
    loss = "format_number(area_lost_sqm, 2)"
    d = "format_number(delta_m, 1)"
    return (
        f"case op when 'shrink_wall' then concat('Move the ', edge, ' wall of floor ', level, ' in by ', {d}, ' m; ', {loss}, ' sqm less.')"
        f" when 'shrink_wall_all_floors' then concat('Move the ', edge, ' wall in by ', {d}, ' m on all floors; ', {loss}, ' sqm less.')"
        f" when 'trim_projection' then concat('Cut projection ', pos, ' back by ', {d}, ' m.')"
        f" when 'reduce_basement_footprint' then concat('Draw the basement in by ', {d}, ' m all round; ', {loss}, ' sqm less.')"
        f" when 'reclassify_room' then concat('Relabel room ', room_index, ' on floor ', level, ' as ', new_use, '.')"
        f" when 'shift_stair' then concat('Move the stair on floor ', level, ' by (', format_number(dx, 1), ', ', format_number(dy, 1), ') m.') end"
    )


# ---------------------------------------------------------------- non-geometric remedies

_EXCESS = "(case when observed_num > required_num then observed_num - required_num end)"
_TEXT = "lower(concat(rule_id, ' ', title))"


def _remedy(df: DataFrame, kind: str, order: int, text: str, extra: str = "cast(null as double)") -> DataFrame:
    return df.selectExpr(
        "model_id", "rule_id", "finding_seq", f"'{kind}' as kind", f"{order} as kind_order", f"{text} as description", f"{extra} as excess_sqm"
    )


def remedy_far(findings: DataFrame, plots: DataFrame) -> DataFrame:
    """Extra covered area to buy, where it can be computed."""
    f = findings.filter(_mentions(_TEXT, ("far", "floor area ratio"))).join(spread(plots.select("model_id", "plot_area_sqm")), "model_id")
    area = f"(case when plot_area_sqm <> 0 then {_EXCESS} * plot_area_sqm end)"
    text = f"coalesce(concat('Buying extra ratio would have to cover ', format_number({area}, 1), ' sqm; rate and limits are not on file.'), 'Buying extra ratio may apply; the excess cannot be computed.')"
    return _remedy(f, "purchase_chargeable_far", 1, text, area)


def remedy_compound(findings: DataFrame) -> DataFrame:
    """M13."""
    text = "concat('May be regularised for a fee under ', citation.doc, ' clause ', citation.clause, '; the fee is not on file.')"
    return _remedy(findings.filter("compoundable"), "compounding", 2, text)


def remedy_noc(findings: DataFrame) -> DataFrame:
    """M14."""
    return _remedy(findings.filter(_mentions(_TEXT, NOC_WORDS)), "noc_route", 3, "'A clearance from the authority in charge is the usual route.'")


def remedy_zoning(findings: DataFrame, plots: DataFrame) -> DataFrame:
    """M15."""
    z = plots.select("model_id", F.col("zoned_area").isNull().alias("no_zone"))
    f = findings.filter(_mentions(_TEXT, ("zon", "containment", "envelope"))).join(spread(z), "model_id")
    return _remedy(f, "zoning_revision_request", 4, "case when no_zone then 'Obtain or trace the zoning plan first.' else 'Ask for a revision if the zoned area on file is out of date.' end")


def non_geometric(findings: DataFrame, plots: DataFrame) -> DataFrame:
    """M12-M15 of every violation, in their fixed order (``kind_order``)."""
    v = findings.filter("status = 'violation'")
    return remedy_far(v, plots).unionByName(remedy_compound(v)).unionByName(remedy_noc(v)).unionByName(remedy_zoning(v, plots))
