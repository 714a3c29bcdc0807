"""Incremental re-evaluation of edits (M8, M9).

An edit changes one wall, all walls of a side, a projection, the basement or a room. What it cannot change
keeps its base findings: ``TOUCHES`` names, per edit, the rule kinds decided from the facts row and the
kinds decided per item of a child table that it can. The facts row of an edit is the model's row with the
differences of the changed floors; other floors, rooms and projections are not copied. The least distance
to an edge without one floor comes from the least and the second least of the model.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.functions import geometry as g
from parapet.functions import polygons
from parapet.operators import checks as c
from parapet.operators.normalise import measure_floors, measure_rings, resolve_pack
from parapet.session import cut_lineage, spread

KEYS = ("model_id", "edit_id")
EDIT = ("op", "floor_pos", "level", "edge", "pos", "room_index", "delta_m", "dx", "dy", "new_use")

_OUTLINE = ("site_coverage_slab", "far_band", "far_band_gap", "stilt_far_definitional", "setback_formula", "height_vs_road", "area_relation")
_ROOMS_OF_FLOOR = ("light_ventilation_ratio", "staircase_min_width")
_USES = ("room_min_height", "light_ventilation_ratio", "staircase_min_width")
_PROJECTIONS = ("projection_max", "projection_width_fraction")
#: those of them whose findings can be violations
VIOLABLE = tuple(k for k in _OUTLINE if k not in ("far_band_gap", "stilt_far_definitional"))
#: edit -> (kinds of the facts row, kinds of items) it can change
TOUCHES = {
    "shrink_wall": (_OUTLINE, ("containment", *_ROOMS_OF_FLOOR)),
    "shrink_wall_all_floors": (_OUTLINE, ("containment", *_ROOMS_OF_FLOOR)),
    "reduce_basement_footprint": (_OUTLINE, ("containment", *_ROOMS_OF_FLOOR)),
    "trim_projection": (_PROJECTIONS, _PROJECTIONS),
    "reclassify_room": (_USES, _USES),
    "shift_stair": ((), ("staircase_min_width",)),
}
#: kinds that a wall edit clears at its furthest step if it does at any: the new outline lies in the old
#: one, so distances grow, areas shrink and what is inside stays inside
MONOTONE = ("containment", "site_coverage_slab", "far_band", "setback_formula", "height_vs_road", "area_relation")
WALLS = ("shrink_wall", "shrink_wall_all_floors", "reduce_basement_footprint")
#: kinds whose violations come from items
ITEM_KINDS = tuple(c.ITEM_LEVEL)


def edit_id() -> F.Column:
    """Name of an edit inside its model; the same edit made for several rules has one name."""
    return F.concat_ws("|", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in EDIT])


def touches(op: str = "op", kind: str = "kind") -> str:
    """Whether an edit can change findings of a kind."""
    arms = [f"when '{o}' then {kind} in ({', '.join(repr(k) for k in sorted({*row, *item}))})" for o, (row, item) in TOUCHES.items()]
    return f"(case {op} {' '.join(arms)} else false end)"


# ---------------------------------------------------------------- facts of edits


def _others(floors: DataFrame) -> DataFrame:
    """Per model and role the least distance with its floor, and the least of the other floors. Partial
    aggregates only, so a model with very many floors is spread."""
    least = [F.min(F.when(F.col(f"dist_{r}").isNotNull(), F.struct(F.col(f"dist_{r}").alias("d"), F.col("floor_pos").alias("at")))).alias(f"m_{r}") for r in c.ROLES]
    first = floors.groupBy("model_id").agg(*least)
    rest = [F.min(F.when(F.col("floor_pos") != F.col(f"m_{r}.at"), F.col(f"dist_{r}"))).alias(f"o_{r}") for r in c.ROLES]
    second = floors.join(spread(first), "model_id").groupBy("model_id").agg(*rest)
    return first.join(spread(second), "model_id")


class Base:
    """Facts, measured floors and base findings of the models that have edits, each written once."""

    def __init__(self, tables: dict[str, DataFrame], rules: DataFrame, findings: DataFrame, models: DataFrame) -> None:
        plots, _ = resolve_pack(tables["plots"].join(spread(models), "model_id", "left_semi"), rules)
        some = {k: v.join(spread(models), "model_id", "left_semi") for k, v in tables.items()}
        some["plots"] = plots.withColumn("rule_pack", F.col("pack")).drop("pack")
        facts = c.build_facts(some)
        lines = ", ".join(f"edge_{r}.line" for r in c.ROLES)
        edges = c.edge_by_role(some["edges"])
        fl = measure_floors(some["floors"]).join(spread(edges), "model_id", "left")
        fl = fl.withColumn("_d", F.expr(f"transform(array({lines}), el -> {g.line_poly_dist('el', 'footprint', 'b', 'area')})"))
        fl = fl.select("model_id", "floor_pos", "level", "is_stilt", "height_m", "footprint", "area", "b", *[F.col("_d")[i].alias(f"dist_{r}") for i, r in enumerate(c.ROLES)])
        self.floors = cut_lineage(fl)
        self.rules = rules
        self.header = cut_lineage(facts.header.join(spread(_others(self.floors)), "model_id", "left"))
        self.facts = replace(facts, keys=list(KEYS), header=self.header, light=self.header, floors=self.floors)
        self.rooms = some["rooms"]
        kinds = rules.select("rule_id", "kind").distinct()
        #: every violating item: an item's number is its place in the list order of its rule
        v = findings.filter("status = 'violation'").join(spread(models), "model_id", "left_semi").join(kinds, "rule_id")
        v = v.select("model_id", "rule_id", "kind", F.expr(f"finding_seq % {c.ITEM_SPAN}").alias("item"))
        v = v.withColumn("of_room", F.col("kind").isin(*_USES))
        v = v.withColumn("at", F.expr("cast(case when of_room then item div 2147483648 else item end as int)"))
        v = v.withColumn("room", F.expr("cast(case when of_room then item % 2147483648 end as int)"))
        levels = self.floors.select("model_id", F.col("floor_pos").alias("at"), "level")
        self.violations = cut_lineage(v.join(spread(levels), ["model_id", "at"], "left").select("model_id", "rule_id", "kind", "at", "room", "level"))
        self.violated = cut_lineage(self.violations.groupBy("model_id", "rule_id", "kind").agg(F.count("*").alias("n")))


def changed_floors(edits: DataFrame, base: Base) -> DataFrame:
    """(edit, floor) of wall and basement edits with the new outline ``new_fp`` and its ``nb``, ``new_area``."""
    from parapet.operators.repair import _alive, _moved_bounds

    head = base.header.select("model_id", F.expr(g.centroid("plot_polygon")).alias("centre"), *[f"edge_{r}" for r in c.ROLES])
    arms = " ".join(f"when '{r}' then edge_{r}.line" for r in c.ROLES)
    e = edits.filter(F.col("op").isin(*WALLS)).select(*KEYS, "op", "edge", "delta_m", F.col("floor_pos").alias("e_floor"))
    fl = base.floors.select("model_id", "floor_pos", "level", "is_stilt", "height_m", "footprint", "area", "b")
    one = e.filter("e_floor is not null").join(spread(fl.withColumn("e_floor", F.col("floor_pos"))), ["model_id", "e_floor"])
    every = e.filter("e_floor is null").drop("e_floor").join(spread(fl), "model_id")
    x = one.drop("e_floor").unionByName(every).join(spread(head), "model_id").withColumn("line", F.expr(f"case edge {arms} end"))
    wall = "op <> 'reduce_basement_footprint'"
    x = x.withColumn("nb", F.expr(f"case when {wall} then {_moved_bounds('b', 'line', 'centre', 'delta_m')} end"))
    plain = f"case when {wall} then case when {_alive('nb')} then {g.rect_ring('nb.xmin', 'nb.ymin', 'nb.xmax', 'nb.ymax')} end else {g.inset('footprint', 'delta_m')} end"
    x = polygons.inset_any(x, "footprint", "delta_m", "new_fp", when=f"not ({wall})", convex=plain)
    x = x.withColumn("nb", F.expr(f"case when {wall} then nb else {g.bounds('new_fp')} end"))
    area = f"case when {wall} then (nb.xmax - nb.xmin) * (nb.ymax - nb.ymin) else {g.area('new_fp')} end"
    return x.withColumn("new_area", F.expr(area)).drop("centre", "line", "edge", "delta_m")


def _wall_header(changed: DataFrame, base: Base) -> DataFrame:
    """Facts rows of wall and basement edits."""
    lines = ", ".join(f"edge_{r}.line" for r in c.ROLES)
    x = changed.withColumn("_d", F.expr(f"transform(array({lines}), el -> {g.line_poly_dist('el', 'new_fp', 'nb', 'new_area')})"))
    pick = F.struct("floor_pos", "level", "is_stilt", "height_m", F.col("new_area").alias("area"), F.col("new_fp").alias("footprint"))
    x = x.select(
        *KEYS, "op", (F.col("new_area") - F.col("area")).alias("d_incl"), F.when(~F.col("is_stilt"), F.col("new_area") - F.col("area")).alias("d_excl"),
        *[F.col("_d")[i].alias(f"n_{r}") for i, r in enumerate(c.ROLES)], pick.alias("now"),
    )
    one = x.filter("op <> 'shrink_wall_all_floors'").select("*", F.col("now").alias("ground_new"), F.col("now").alias("basement_new")).drop("now")
    first = lambda cond: F.min_by(F.when(cond, F.col("now")), F.when(cond, F.col("now.floor_pos")))
    every = x.filter("op = 'shrink_wall_all_floors'").groupBy(*KEYS, "op").agg(
        F.sum("d_incl").alias("d_incl"), F.sum("d_excl").alias("d_excl"), *[F.min(f"n_{r}").alias(f"n_{r}") for r in c.ROLES],
        first(F.col("now.level") == 0).alias("ground_new"), first(F.col("now.level") < 0).alias("basement_new"),
    )
    x = one.unionByName(every).join(spread(base.header), "model_id")
    gone = [f"case when op = 'shrink_wall_all_floors' then null when m_{r}.at = ground_new.floor_pos then o_{r} else m_{r}.d end" for r in c.ROLES]
    put = {
        "covered_incl": "covered_incl + coalesce(d_incl, 0D)",
        "covered_excl": "covered_excl + coalesce(d_excl, 0D)",
        "ground": "case when ground.floor_pos = ground_new.floor_pos then ground_new else ground end",
        "basement": "case when basement.floor_pos = basement_new.floor_pos then basement_new else basement end",
        **{f"setback_{r}": f"least(n_{r}, {gone[i]})" for i, r in enumerate(c.ROLES)},
    }
    return x.select(*KEYS, *[F.expr(put[k]).alias(k) if k in put else k for k in base.header.columns if k != "model_id"])


def _edited_room_header(edits: DataFrame, base: Base) -> DataFrame:
    """Facts rows of relabelled rooms: only the set of uses changes."""
    count = base.rooms.groupBy("model_id", F.col("use").alias("old")).agg(F.count("*").alias("n_old"))
    x = edits.join(spread(base.rooms.select("model_id", "floor_pos", "room_index", F.col("use").alias("old"))), ["model_id", "floor_pos", "room_index"])
    x = x.join(spread(count), ["model_id", "old"]).select(*KEYS, "old", "n_old", "new_use").join(spread(base.header), "model_id")
    uses = "array_union(case when n_old > 1 then uses else array_except(uses, array(old)) end, array(new_use))"
    return x.select(*KEYS, *[F.expr(uses).alias(k) if k == "uses" else k for k in base.header.columns if k != "model_id"])


def _trimmed_header(trimmed: DataFrame, base: Base) -> DataFrame:
    """Facts rows of trimmed projections: one less where the outline has vanished."""
    x = trimmed.select(*KEYS, F.expr("cast(polygon is null as int)").alias("lost")).join(spread(base.header), "model_id")
    put = {"n_proj": "n_proj - lost", "n_proj_ok": "n_proj_ok - lost"}
    return x.select(*KEYS, *[F.expr(put[k]).alias(k) if k in put else k for k in base.header.columns if k != "model_id"])


# ---------------------------------------------------------------- findings of edits


def _short(findings: DataFrame) -> DataFrame:
    return findings.select(*KEYS, "rule_id", "status")


def redo(edits: DataFrame, tables: dict[str, DataFrame], base: Base, outline=_OUTLINE) -> tuple[DataFrame, DataFrame]:
    """M8: (model_id, edit_id, rule_id, status) of every finding that an edit can change, re-evaluated; and
    (model_id, edit_id, area_lost_sqm) of the edits that live. ``edits`` has KEYS and EDIT, each edit once.

    An edit whose outline collapses is not in either. ``outline`` are the kinds of the facts row evaluated
    for wall edits.
    """
    with c.status_only():
        return _redo(edits, tables, base, outline)


def _redo(edits: DataFrame, tables: dict[str, DataFrame], base: Base, outline) -> tuple[DataFrame, DataFrame]:
    rules, facts = base.rules, base.facts
    # at most six values: branches for edits that do not occur are left out of the plan
    ops = {x.op for x in edits.select("op").distinct().collect()}
    found, rooms = [], []
    gone = lost = None
    if ops & {*WALLS}:
        changed = cut_lineage(changed_floors(edits, base))
        gone = changed.filter("new_fp is null").select(*KEYS).distinct()
        changed = changed.join(spread(gone), list(KEYS), "left_anti")
        lost = changed.groupBy(*KEYS).agg(F.abs(F.sum(F.col("area") - F.col("new_area"))).alias("area_lost_sqm"))
        found.append(c.model_level(replace(facts, header=_wall_header(changed, base)), rules, outline))
        moved = changed.select(*KEYS, "floor_pos", "level", F.col("new_fp").alias("footprint"), F.col("nb").alias("b"))
        found.append(c.floor_level(replace(facts, floors=moved), rules))
        seen = base.rooms.filter(F.col("use").isin(*c.HABITABLE_USES, "stair"))
        inside = seen.join(spread(moved.select(*KEYS, "floor_pos", F.col("b").alias("box"))), ["model_id", "floor_pos"])
        rooms.append(polygons.clip_any(inside, "polygon", "box").drop("box"))
    room = ["model_id", "floor_pos", "room_index"]
    if "reclassify_room" in ops:
        label = edits.filter("op = 'reclassify_room'")
        rooms.append(base.rooms.drop("use").join(spread(label.select(*KEYS, "floor_pos", "room_index", F.col("new_use").alias("use"))), room))
        # the first room of a level may be another one after a relabelling
        on_level = label.select(*KEYS, "level", F.struct("floor_pos", "room_index").alias("it"), "new_use").join(spread(base.rooms.drop("confidence")), ["model_id", "level"])
        on_level = on_level.withColumn("use", F.expr("case when it = struct(floor_pos, room_index) then new_use else use end")).drop("it", "new_use")
        found.append(c.room_height_level(replace(facts, rooms=on_level), rules))
        found.append(c.model_level(replace(facts, header=_edited_room_header(label, base)), rules, _USES))
    if "shift_stair" in ops:
        stairs = edits.filter("op = 'shift_stair'").select(*KEYS, "floor_pos", "room_index", "dx", "dy")
        rooms.append(base.rooms.join(spread(stairs), room).withColumn("polygon", F.expr(g.translate("polygon", "dx", "dy"))).drop("dx", "dy"))
    if rooms:
        found.append(c.room_level(replace(facts, rooms=reduce(DataFrame.unionByName, rooms)), rules))
    if "trim_projection" in ops:
        trim = edits.filter("op = 'trim_projection'").select(*KEYS, "pos", "delta_m")
        trimmed = cut_lineage(polygons.inset_any(tables["projections"].join(spread(trim), ["model_id", "pos"]), "polygon", "delta_m").drop("delta_m"))
        found.append(c.projection_level(replace(facts, projections=measure_rings(trimmed.filter("polygon is not null"), "polygon")), rules))
        found.append(c.model_level(replace(facts, header=_trimmed_header(trimmed, base)), rules, _PROJECTIONS))
    live = edits.select(*KEYS)
    if gone is None:
        live = live.withColumn("area_lost_sqm", F.lit(0.0))
    else:
        live = live.join(spread(gone), list(KEYS), "left_anti").join(spread(lost), list(KEYS), "left").withColumn("area_lost_sqm", F.coalesce("area_lost_sqm", F.lit(0.0)))
    if not found:
        none = edits.select(*KEYS, F.lit("").alias("rule_id"), F.lit("").alias("status")).limit(0)
        return none, live
    return reduce(DataFrame.unionByName, map(_short, found)), live


def spared(edits: DataFrame, base: Base) -> DataFrame:
    """(model_id, edit_id, rule_id, n): base violations of touched kinds whose items an edit changes."""
    v = base.violations
    e = edits.select(*KEYS, "op", "floor_pos", "level", "pos", "room_index")
    floor_kinds = ("containment", *_ROOMS_OF_FLOOR)
    on_floor = v.filter(F.col("kind").isin(*floor_kinds)).withColumn("floor_pos", F.col("at"))
    by_floor = on_floor.groupBy("model_id", "floor_pos", "rule_id").agg(F.count("*").alias("n"))
    by_model = on_floor.groupBy("model_id", "rule_id").agg(F.count("*").alias("n"))
    walls = e.filter(F.col("op").isin(*WALLS))
    parts = [walls.filter("floor_pos is not null").join(spread(by_floor), ["model_id", "floor_pos"]), walls.filter("floor_pos is null").join(spread(by_model), "model_id")]
    by_pos = v.filter(F.col("kind").isin(*_PROJECTIONS)).groupBy("model_id", F.col("at").alias("pos"), "rule_id").agg(F.count("*").alias("n"))
    parts.append(e.filter("op = 'trim_projection'").join(spread(by_pos), ["model_id", "pos"]))
    by_room = v.filter(F.col("kind").isin(*_ROOMS_OF_FLOOR)).groupBy("model_id", F.col("at").alias("floor_pos"), F.col("room").alias("room_index"), "rule_id", "kind").agg(F.count("*").alias("n"))
    in_room = e.filter("op in ('reclassify_room', 'shift_stair')").join(spread(by_room), ["model_id", "floor_pos", "room_index"])
    parts.append(in_room.filter("op <> 'shift_stair' or kind = 'staircase_min_width'"))
    by_level = v.filter("kind = 'room_min_height'").groupBy("model_id", "level", "rule_id").agg(F.count("*").alias("n"))
    parts.append(e.filter("op = 'reclassify_room'").join(spread(by_level), ["model_id", "level"]))
    return reduce(DataFrame.unionByName, [p.select(*KEYS, "rule_id", "n") for p in parts])


def clearable(candidates: DataFrame, base: Base) -> DataFrame:
    """Candidates (KEYS, EDIT, rule_id) that could clear their rule: the edit touches the rule's kind, and
    no violating item of the rule is out of its reach. The others can never be accepted."""
    x = candidates.join(spread(base.violated.withColumnRenamed("n", "n_base")), ["model_id", "rule_id"]).filter(touches())
    per_row = x.filter(~F.col("kind").isin(*ITEM_KINDS))
    items = x.filter(F.col("kind").isin(*ITEM_KINDS))
    reach = spared(items.select(*KEYS, *EDIT).distinct(), base)
    items = items.join(spread(reach), [*KEYS, "rule_id"]).filter("n = n_base").drop("n")
    return per_row.unionByName(items).drop("n_base", "kind")


def hopeful(candidates: DataFrame, furthest: DataFrame, tables: dict[str, DataFrame], base: Base) -> DataFrame:
    """Candidates without the wall edits that do not clear their rule even at the furthest step.

    ``furthest`` are the wall edits at their last steps; only those are evaluated here. Rules of other
    than ``MONOTONE`` kinds keep all their candidates.
    """
    line = ["model_id", "rule_id", "op", "edge", F.coalesce("floor_pos", F.lit(-1)).alias("at")]
    far = cut_lineage(clearable(furthest, base))
    found, _ = redo(cut_lineage(far.select(*KEYS, *EDIT).distinct()), tables, base, VIOLABLE)
    now = found.filter("status = 'violation'").select(*KEYS, "rule_id").distinct()
    lines = cut_lineage(far.join(spread(now), [*KEYS, "rule_id"], "left_anti").select(*line))
    kinds = base.rules.select("rule_id", "kind").distinct()
    x = candidates.join(kinds, "rule_id").withColumn("at", F.coalesce("floor_pos", F.lit(-1)))
    walls = f"op in ('shrink_wall', 'shrink_wall_all_floors') and kind in ({', '.join(repr(k) for k in MONOTONE)})"
    kept = x.filter(walls).join(spread(lines), ["model_id", "rule_id", "op", "edge", "at"], "left_semi")
    return kept.unionByName(x.filter(f"not ({walls})")).select(candidates.columns)


def accepted(candidates: DataFrame, found: DataFrame, live: DataFrame, base: Base) -> DataFrame:
    """M9: of ``clearable`` candidates those whose rule is not violated in ``found`` and whose edit violates
    nothing new; with area lost and ``n_cleared``, the number of base violations cleared."""
    now = found.filter("status = 'violation'").select(*KEYS, "rule_id").distinct()
    fresh = now.join(spread(base.violated), ["model_id", "rule_id"], "left_anti").select(*KEYS).distinct()
    good = candidates.join(spread(live), list(KEYS)).join(spread(now), [*KEYS, "rule_id"], "left_anti").join(spread(fresh), list(KEYS), "left_anti")
    good = cut_lineage(good)
    e = good.select(*KEYS, *EDIT).distinct()
    near = e.join(spread(base.violated.withColumnRenamed("n", "n_base")), "model_id").filter(touches())
    near = near.join(spread(spared(e, base)), [*KEYS, "rule_id"], "left").filter(~F.col("kind").isin(*ITEM_KINDS) | (F.col("n") == F.col("n_base")))
    cleared = near.join(spread(now), [*KEYS, "rule_id"], "left_anti").groupBy(*KEYS).agg(F.count("*").alias("n_cleared"))
    return good.join(spread(cleared), list(KEYS))
