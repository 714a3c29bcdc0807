"""Rule checks.

Data flow: every child table is reduced to one *facts* row per model (partial aggregation, so a
model with very many floors does not land in one task), the rule rows are broadcast, and the
status of each (model, rule) pair is decided by a ``when`` chain. Checks that yield one finding per
floor, room, projection or courtyard join the child table to the facts and to the rules of their
kind. Missing inputs are tested first; ``pass`` is never the fallback of a chain.

``finding_seq`` is a composite order key (rule position, item position): list order without a
per-model sort.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.functions import geometry as g
from parapet.operators.normalise import measure_floors, measure_rings
from parapet.schemas import CITATION, HABITABLE_USES, REMEDY
from parapet.session import in_place, spread

EPS = "1e-9D"
ROLES = ("front", "rear", "side_a", "side_b")
ITEM_SPAN = 1 << 46

FINDING_COLUMNS = (
    "finding_seq", "rule_id", "status", "severity", "title", "citation", "observed_num",
    "observed_txt", "required_num", "required_txt", "geometry_ref", "compoundable",
    "ambiguity_class", "remedies", "rule_pack",
)


# ---------------------------------------------------------------- rule-side projections

def enforced(rules: DataFrame) -> DataFrame:
    """B1."""
    return rules.filter("enforced")


def citation(rules: DataFrame) -> DataFrame:
    """Rules with a ``citation`` struct."""
    return rules.withColumn("citation", _citation())


def _citation() -> Column:
    return F.expr(
        "named_struct('doc', r.source.doc, 'clause', r.source.clause, 'version', coalesce(r.source.version, 'unknown'),"
        " 'url', r.source.url, 'status', coalesce(rule_status, 'seed_unverified'))"
    )


def rule_remedies(area_lost: str = "cast(null as double)") -> str:
    """The rule's remedy kinds as unverified remedies."""
    return (
        "transform(coalesce(r.remedies, cast(array() as array<string>)), k -> named_struct('kind', k, 'description',"
        f" concat('Possible remedy for ', rule_id, '; not re-checked.'), 'area_lost_sqm', {area_lost}, 'verified', false))"
    )


def one_remedy(kind: str, text: str) -> str:
    return (
        f"array(named_struct('kind', '{kind}', 'description', '{text}', 'area_lost_sqm', cast(null as double),"
        " 'verified', false))"
    )


NO_REMEDIES = f"cast(array() as array<{REMEDY}>)"


def is_footprint_dependent(rule_id: Column) -> Column:
    """B6."""
    low = F.lower(rule_id)
    return low.contains("containment") | low.contains("coverage") | low.contains("far") | low.contains("setback")


def unenforced(rules: DataFrame) -> DataFrame:
    """Rows that stay citable but never yield a finding."""
    return rules.filter("not enforced")


def skipped_rules(rules: DataFrame) -> DataFrame:
    """Enforced rules whose kind has no check (the reference drops them silently)."""
    has_check = F.col("kind").isin(*KINDS) & (
        (F.col("kind") != "area_relation") | F.col("rule_id").contains("basement")
    )
    return enforced(rules).filter((F.col("rule_status") != "conflict") & ~has_check)


def _lookup_rules(rules: DataFrame) -> DataFrame:
    return rules.select(
        F.col("rule_pack").alias("_pack"),
        F.col("authority").alias("_authority"),
        "rule_id", "rule_pos", "kind", "rule_status", "area_lo", "area_hi", "r",
        is_footprint_dependent(F.col("rule_id")).alias("_footprint"),
        *[c for c in ("role_pos", "role") if c in rules.columns],
    )


def applicable(plots: DataFrame, rules: DataFrame) -> DataFrame:
    """Plots x rules of their pack, authority and (inclusive, NULL-admitting) area band.

    The rule side carries its own size, so Spark broadcasts it below its broadcast threshold and
    shuffles it above.
    """
    r = _lookup_rules(rules)
    area = F.col("plot_area_sqm")
    return plots.join(
        r,
        (F.col("rule_pack") == F.col("_pack"))
        & (F.col("_authority").isNull() | (F.col("authority") == F.col("_authority")))
        & (
            area.isNull()
            | ((area >= F.coalesce("area_lo", area)) & (area <= F.coalesce("area_hi", area)))
        ),
    ).drop("_pack", "_authority")


# ---------------------------------------------------------------- facts

@dataclass
class Facts:
    """Per-model facts and the measured child tables, all keyed by ``keys``.

    ``light`` is the part of the facts that per-item checks need; it costs one small aggregate.
    """

    keys: list[str]
    header: DataFrame
    light: DataFrame
    floors: DataFrame
    rooms: DataFrame
    projections: DataFrame
    courtyards: DataFrame


def edge_by_role(edges: DataFrame, roles=ROLES) -> DataFrame:
    """First edge of each role, one row per model with ``edge_<role>`` structs."""
    e = F.struct("line", "faces_road", "road_width_m")
    return edges.filter(F.col("role").isin(*roles)).groupBy("model_id").agg(
        *[F.min_by(F.when(F.col("role") == r, e), F.when(F.col("role") == r, F.col("edge_pos"))).alias(f"edge_{r}") for r in roles]
    )


def _pick_floor(cond: Column) -> Column:
    s = F.struct("floor_pos", "level", "is_stilt", "height_m", "area", "footprint")
    return F.min_by(F.when(cond, s), F.when(cond, F.col("floor_pos")))


def ground(floors: DataFrame, keys=("model_id",)) -> DataFrame:
    """First floor at level 0 (a stilt counts)."""
    return floors.groupBy(*keys).agg(_pick_floor(F.col("level") == 0).alias("ground")).filter("ground is not null")


def basement(floors: DataFrame, keys=("model_id",)) -> DataFrame:
    """First floor below level 0, in list order."""
    return floors.groupBy(*keys).agg(_pick_floor(F.col("level") < 0).alias("basement")).filter("basement is not null")


def floor_facts(floors: DataFrame, keys, exclude_basement: bool = False) -> DataFrame:
    """One row per model: areas, height, picks and setbacks. ``floors`` must be measured and carry
    ``dist_<role>``."""
    counted = ~F.col("is_stilt")
    if exclude_basement:
        counted = counted & (F.col("level") >= 0)
    return floors.groupBy(*keys).agg(
        F.count("*").alias("n_floors"),
        F.count("area").alias("n_usable"),
        F.sum(F.when(counted, F.col("area"))).alias("covered_excl"),
        F.sum("area").alias("covered_incl"),
        F.sum(F.when(~F.col("is_stilt"), F.col("height_m"))).alias("height"),
        F.bool_or("is_stilt").alias("has_stilt"),
        F.bool_or("footprint_is_upper_bound").alias("any_upper"),
        _pick_floor(F.col("level") == 0).alias("ground"),
        _pick_floor(F.col("level") < 0).alias("basement"),
        *[F.min(f"dist_{r}").alias(f"setback_{r}") for r in ROLES if f"dist_{r}" in floors.columns],
    )


#: kinds decided from the facts row that read a part of it; the other parts are not joined for them
NEEDS = {
    "floors": {"containment", "site_coverage_slab", "far_band", "far_band_gap", "stilt_far_definitional", "setback_formula", "height_vs_road", "floor_min_height", "area_relation"},
    "edges": {"setback_formula", "height_vs_road"},
    "projections": {"projection_max", "projection_width_fraction"},
    "courtyards": {"courtyard_min_area", "courtyard_min_width"},
    "rooms": {"room_min_height", "light_ventilation_ratio", "staircase_min_width"},
}


def build_facts(tables: dict[str, DataFrame], keys=("model_id",), exclude_basement: bool = False, kinds=None) -> Facts:
    """Facts of every model; with ``kinds`` only the parts that these checks read. With extra keys
    (``cand_seq``) ``plots`` must carry them too; tables that lack them are joined on ``model_id``."""
    keys = list(keys)
    plots = tables["plots"]
    parts = {p for p, of in NEEDS.items() if kinds is None or of & {*kinds}}
    base = plots.join(spread(edge_by_role(tables["edges"])), "model_id", "left") if "edges" in parts else plots

    def on(df):
        return [k for k in keys if k in df.columns]

    measured = measure_floors(tables["floors"])
    fl = measured
    if "edges" in parts:
        edge_cols = [f"edge_{r}" for r in ROLES]
        fl = fl.join(spread(base.select(*on(fl), *edge_cols)), on(fl), "inner")
        fl = fl.select(*fl.columns[: -len(edge_cols)], *[F.expr(g.line_poly_dist(f"edge_{r}.line", "footprint", "b", "area")).alias(f"dist_{r}") for r in ROLES])
    ff = floor_facts(fl, keys, exclude_basement)

    pr = measure_rings(tables["projections"], "polygon")
    co = measure_rings(tables["courtyards"], "ring")
    rooms = tables["rooms"]
    pf = pr.groupBy(*on(pr)).agg(F.count("*").alias("n_proj"), F.count("area").alias("n_proj_ok"))
    cf = co.groupBy(*on(co)).agg(F.count("*").alias("n_court"))
    rf = rooms.groupBy(*on(rooms)).agg(F.collect_set("use").alias("uses"))

    upper = tables["floors"].groupBy(*keys).agg(F.bool_or("footprint_is_upper_bound").alias("any_upper"))
    header = base.join(spread(ff if "floors" in parts else upper), keys, "left")
    for part, counted, own in (("projections", pf, on(pr)), ("courtyards", cf, on(co)), ("rooms", rf, on(rooms))):
        if part in parts:
            header = header.join(spread(counted), own, "left")
    defaults = {
        "n_floors": "0L", "n_usable": "0L", "covered_excl": "0D", "covered_incl": "0D", "has_stilt": "false", "any_upper": "false",
        "n_proj": "0L", "n_proj_ok": "0L", "n_court": "0L", "uses": "cast(array() as array<string>)",
    }
    header = header.selectExpr(
        *[f"coalesce({c}, {defaults[c]}) as {c}" if c in defaults else c for c in header.columns],
        g.mrr_short("plot_polygon") + " as site_width",
    )
    light = (
        plots.join(spread(upper), keys, "left")
        .withColumn("any_upper", F.coalesce("any_upper", F.lit(False)))
        .withColumn("site_width", F.expr(g.mrr_short("plot_polygon")))
    )
    return Facts(keys, header, light, measured, rooms, pr, co)


# ---------------------------------------------------------------- finding construction (SQL text)

#: fields of :func:`make` that plans built inside ``only`` fill; None: all
_wanted: frozenset[str] | None = None
#: set while the condition under which there is a finding at all is built
_probing = False


@contextlib.contextmanager
def only(*fields: str):
    """Plans built inside give findings that hold their keys, order, rule and status, and of the check's own
    columns (title, ambiguity_class, observed_num, observed_txt, required_num, required_txt, geometry_ref,
    compoundable, remedies) those named; the others are null. For queries that read no more than that."""
    global _wanted
    before, _wanted = _wanted, frozenset(fields)
    try:
        yield
    finally:
        _wanted = before


def status_only():
    """Findings whose texts, numbers and highlights are null: for searches that read the status alone."""
    return only()


def _exists(o: Callable[[], str]) -> str:
    """The condition under which the finding that ``o`` builds is there, without its fields."""
    global _probing
    _probing = True
    try:
        return f"({o()}) is not null"
    finally:
        _probing = False


def make(status, amb="null", obs="null", obs_txt="null", req="null", req_txt="null", geom="null", comp="false", lost="null", rem=("null", "null"), item="0", suffix="''") -> str:
    """The check-specific part of a finding, as a struct expression. ``rem`` is a one-off remedy
    (kind, text); a violation otherwise gets the rule's own remedies in :func:`finish`."""
    if _probing:
        return "true"
    if _wanted is not None:
        held = lambda column, value, none="null": value if column in _wanted else none
        amb, geom, comp, suffix = held("ambiguity_class", amb), held("geometry_ref", geom), held("compoundable", comp, "false"), held("title", suffix, "''")
        obs, obs_txt, req, req_txt = held("observed_num", obs), held("observed_txt", obs_txt), held("required_num", req), held("required_txt", req_txt)
        lost, rem = held("remedies", lost), held("remedies", rem, ("null", "null"))
    return (
        f"named_struct('item', cast({item} as bigint), 'suffix', cast({suffix} as string), 'status', cast({status} as string),"
        f" 'amb', cast({amb} as string), 'obs', cast({obs} as double), 'obs_txt', cast({obs_txt} as string),"
        f" 'req', cast({req} as double), 'req_txt', cast({req_txt} as string), 'geom', cast({geom} as {g.RING}),"
        f" 'comp', cast({comp} as boolean), 'lost', cast({lost} as double), 'rem_kind', cast({rem[0]} as string),"
        f" 'rem_text', cast({rem[1]} as string))"
    )


def graded(ok: str, obs="null", req="null", comp="r.compoundable", **kw) -> str:
    """pass / violation; an undecided condition stays NULL and is never a pass."""
    return make(f"case ({ok}) when true then 'pass' when false then 'violation' end", obs=obs, req=req, comp=comp, **kw)


def _floor_suffix(level: str = "level") -> str:
    return f"concat(' (floor ', {level}, ')')"


def finish(df: DataFrame, keys) -> DataFrame:
    """Rows with the columns of :func:`make` -> findings schema: highlight only what is not a pass,
    remedies only on a violation, then one-sided softening (B7)."""
    df = df.withColumn(
        "_soft", (F.col("status") == "violation") & F.col("any_upper") & F.col("_footprint")
    )
    one_off = (
        "array(named_struct('kind', rem_kind, 'description', rem_text, 'area_lost_sqm', cast(null as double), 'verified', false))"
    )
    remedies = (
        f"case when rem_kind is not null then {one_off} when status = 'violation' then {rule_remedies('lost')} else {NO_REMEDIES} end"
    )
    return df.select(
        *keys,
        F.expr(f"cast(rule_pos as bigint) * {ITEM_SPAN} + item").alias("finding_seq"),
        "rule_id",
        F.expr("case when _soft then 'ambiguity' else status end").alias("status"),
        F.col("r.severity").alias("severity"),
        F.expr(f"concat(r.title, suffix, case when _soft then '{SOFT_SUFFIX}' else '' end)").alias("title"),
        _citation().alias("citation"),
        F.col("obs").alias("observed_num"),
        F.col("obs_txt").alias("observed_txt"),
        F.col("req").alias("required_num"),
        F.col("req_txt").alias("required_txt"),
        F.expr("case when status <> 'pass' then geom end").alias("geometry_ref"),
        F.expr("coalesce(comp, false)").alias("compoundable"),
        F.expr("case when _soft then 'extraction' else amb end").alias("ambiguity_class"),
        F.expr(remedies).alias("remedies"),
        "rule_pack",
    )


SOFT_SUFFIX = " - confirm against the drawing"


def soften(findings: DataFrame, floors: DataFrame, keys=("model_id",)) -> DataFrame:
    """B7 on a findings table: one-sided softening where any floor outline is an upper bound."""
    upper = floors.groupBy(*keys).agg(F.bool_or("footprint_is_upper_bound").alias("_upper"))
    hit = (F.col("status") == "violation") & F.coalesce("_upper", F.lit(False)) & is_footprint_dependent(F.col("rule_id"))
    j = findings.join(spread(upper), list(keys), "left").withColumn("_hit", hit)
    return (
        j.withColumn("status", F.when(F.col("_hit"), "ambiguity").otherwise(F.col("status")))
        .withColumn("ambiguity_class", F.when(F.col("_hit"), "extraction").otherwise(F.col("ambiguity_class")))
        .withColumn("title", F.concat("title", F.when(F.col("_hit"), SOFT_SUFFIX).otherwise("")))
        .drop("_hit", "_upper")
    )


# ---------------------------------------------------------------- per-model decisions, by kind

def slab_cap(area: str, table: str) -> str:
    """Progressive cap over ordered bands; a NULL band takes what remains."""
    chunk = "case when sb.band_sqm is null then sc.rest else least(sc.rest, sb.band_sqm) end"
    return (
        f"aggregate({table}, named_struct('rest', cast({area} as double), 'cap', 0D), (sc, sb) -> named_struct("
        f"'rest', sc.rest - {chunk}, 'cap', sc.cap + {chunk} * (sb.pct / 100D)), sc -> sc.cap)"
    )


def _containment() -> str:
    missing = make(
        "'unknown'", "'missing_input'", req_txt="'a traced zoned area'", geom="plot_polygon",
        rem=("'zoning_revision_request'", "'No zoning plan is traced for this plot, so containment stays undecided.'"),
    )
    return (
        f"case when zoned_area is null then {missing} when not {g.ring_ok('zoned_area')} then"
        f" {make(_UNK, _EXT)} when n_usable = 0 then {make(_UNK, _MISS)} end"
    )


_UNK, _EXT, _MISS, _PASS = "'unknown'", "'extraction'", "'missing_input'", "'pass'"


def _site_coverage() -> str:
    cap = "cap"  # computed once per pair in model_level
    good = graded(f"ground.area <= {cap} + {EPS}", "ground.area", cap, geom="ground.footprint", lost=f"case when ground.area > {cap} + {EPS} then ground.area - {cap} end")
    return (
        f"case when plot_area_sqm is null then {make(_UNK, _MISS)} when ground.area is null then"
        f" {make(_UNK, _EXT)} else {good} end"
    )


_FAR = "(covered_excl / plot_area_sqm)"


def _far_band() -> str:
    note = "case when has_stilt then ' (stilt storey left out of the ratio)' else '' end"
    good = graded(f"{_FAR} <= r.max_far + {EPS}", _FAR, "r.max_far", geom="plot_polygon", suffix=note)
    return f"case when plot_area_sqm is null then {make(_UNK, _MISS)} else {good} end"


def _far_band_gap() -> str:
    found = make(
        "'ambiguity'", "'instrument_conflict'", obs=_FAR, obs_txt="concat('superseded cap ', r.superseded_value)",
        geom="plot_polygon",
        rem=("'zoning_revision_request'", "'The amended text states no cap for this band and the earlier cap is superseded; cite both clauses.'"),
    )
    return f"case when plot_area_sqm >= coalesce(area_lo, 0D) then {found} end"


def _stilt_far() -> str:
    # required_num holds the second reading; neither is asserted.
    incl = "(covered_incl / plot_area_sqm)"
    text = f"concat('ratio without stilt ', format_number({_FAR}, 3), '; with stilt ', format_number({incl}, 3))"
    found = make("'ambiguity'", "'definitional'", obs=_FAR, obs_txt=text, req=incl)
    return f"case when has_stilt and plot_area_sqm is not null then {found} end"


def _by_role(expr: str) -> str:
    arms = " ".join(f"when '{r}' then {expr.format(r)}" for r in ROLES)
    return f"(case role {arms} end)"


def _setback() -> str:
    need, obs = "greatest(height * r.fraction_of_height, r.min_m)", _by_role("setback_{}")
    kw = dict(item="role_pos", suffix="concat(' (', role, ')')")
    good = graded(f"{obs} >= {need} - {EPS}", obs, need, geom=_by_role("edge_{}.line"), **kw)
    return f"case when {obs} is null or height is null then {make(_UNK, _EXT, **kw)} else {good} end"


def _height_vs_road() -> str:
    allowed = "(edge_front.road_width_m + setback_front)"
    good = graded(f"height <= {allowed} + {EPS}", "height", allowed, geom="plot_polygon")
    return f"case when {allowed} is null or height is null then {make(_UNK, _MISS)} else {good} end"


def _no_items(count: str, limit: str, what: str) -> str:
    return f"case when {count} = 0 then {make(_PASS, obs_txt=f'{chr(39)}no {what} in the model{chr(39)}', req=f'r.{limit}')} end"


def _projection_width() -> str:
    empty = make(_PASS, obs_txt="'no usable projections'")
    return (
        f"case when n_proj = 0 then {make(_PASS)} when site_width is null then {make(_UNK, _EXT)}"
        f" when n_proj_ok = 0 then {empty} end"
    )


def _room_height() -> str:
    none = make(_PASS, obs_txt="'no rooms of the listed uses'", req="r.min_m")
    return f"case when not arrays_overlap(uses, r.room_uses) then {none} end"


_HABITABLE = "array(" + ", ".join(f"'{u}'" for u in HABITABLE_USES) + ")"


def _light() -> str:
    none = make(_PASS, obs_txt="'no habitable rooms in the model'", req="r.min_ratio")
    return f"case when not arrays_overlap(uses, {_HABITABLE}) then {none} end"


def _stairs() -> str:
    return f"case when not array_contains(uses, 'stair') then {make(_UNK, _EXT, req='r.min_m')} end"


def _basement_height() -> str:
    h, lim = "basement.height_m", "r.min_m"
    none = make(_PASS, obs_txt="'no basement in the model'", req=lim)
    return (
        f"case when basement is null then {none} when {h} is null then {make(_UNK, _EXT, req=lim)}"
        f" else {graded(f'{h} >= {lim} - {EPS}', h, lim, geom='basement.footprint')} end"
    )


def _basement_area() -> str:
    ba, ga = "basement.area", "ground.area"
    none = make(_PASS, obs_txt="'no basement in the model'")
    return (
        f"case when contains(rule_id, 'basement') then case when basement is null then {none}"
        f" when {ba} is null or {ga} is null then {make(_UNK, _EXT)}"
        f" else {graded(f'{ba} <= {ga} + {EPS}', ba, ga, geom='basement.footprint')} end end"
    )


def _roof_recede() -> str:
    h, s = "mumty.height_m", "mumty.setback_m"
    need, limit = f"({h} * r.recede_ratio)", "r.height_threshold_m"
    none = make(_PASS, obs_txt="'no roof structure in the model'")
    exempt = make(_PASS, obs=h, req_txt=f"concat('exempt up to ', {limit}, ' m')")
    return (
        f"case when mumty is null then {none} when {h} is null or {s} is null then {make(_UNK, _EXT)}"
        f" when {h} <= {limit} then {exempt} else {graded(f'{s} >= {need} - {EPS}', s, need)} end"
    )


# kind -> finding decided from the facts row alone (NULL: none)
MODEL_LEVEL = {
    "containment": _containment,
    "site_coverage_slab": _site_coverage,
    "far_band": _far_band,
    "far_band_gap": _far_band_gap,
    "stilt_far_definitional": _stilt_far,
    "setback_formula": _setback,
    "height_vs_road": _height_vs_road,
    "projection_max": lambda: _no_items("n_proj", "max_m", "projections"),
    "projection_width_fraction": _projection_width,
    "courtyard_min_area": lambda: _no_items("n_court", "min_sqm", "closed courtyards"),
    "courtyard_min_width": lambda: _no_items("n_court", "min_m", "closed courtyards"),
    "room_min_height": _room_height,
    "light_ventilation_ratio": _light,
    "floor_min_height": _basement_height,
    "area_relation": _basement_area,
    "staircase_min_width": _stairs,
    "roof_projection_recede": _roof_recede,
}
KINDS = tuple(MODEL_LEVEL)


def _live(rules: DataFrame, kinds) -> DataFrame:
    return enforced(rules).filter((F.col("rule_status") != "conflict") & F.col("kind").isin(*kinds))


def _known(header: DataFrame) -> DataFrame:
    return header.filter(F.col("authority") != "UNKNOWN")


def _decide(x: DataFrame, o: Callable[[], str], keys) -> DataFrame:
    # a filter on the built finding would be pushed below it, and every finding built twice
    x = x.filter(_exists(o)).select(*[c for c in x.columns if c not in ("item", "status")], F.expr(o()).alias("o"))
    return finish(x.select("*", "o.*"), keys)


def _with_roles(rules: DataFrame) -> DataFrame:
    """Setback rules become one row per edge role, on the small side of the join."""
    roles = (
        "case when kind <> 'setback_formula' then array(cast(null as string))"
        " when contains(rule_id, 'front_rear') then array('front', 'rear') else array('side_a', 'side_b') end"
    )
    return rules.select("*", F.expr(f"posexplode({roles})").alias("role_pos", "role"))


def model_level(facts: Facts, rules: DataFrame, kinds=KINDS) -> DataFrame:
    """Findings that need only the facts row: one broadcast join, one pass, no shuffle."""
    pairs = applicable(_known(facts.header), _with_roles(_live(rules, kinds)))
    if "site_coverage_slab" in kinds:
        cap = f"case when kind = 'site_coverage_slab' then {slab_cap('plot_area_sqm', 'r.table')} end"
        pairs = pairs.withColumn("cap", F.expr(cap))

    def o() -> str:
        return "case kind " + " ".join(f"when '{kind}' then {MODEL_LEVEL[kind]()}" for kind in kinds) + " end"

    return _decide(pairs, o, facts.keys)


# ---------------------------------------------------------------- per-item decisions

_PAIR_COLS = ("authority", "rule_pack", "plot_area_sqm", "any_upper")


def _items(facts: Facts, items: DataFrame, rules: DataFrame, kinds, extra=()) -> DataFrame:
    head_keys = [k for k in facts.keys if k in facts.light.columns]
    head = _known(facts.light).select(*head_keys, *_PAIR_COLS, *extra)
    on = [k for k in head_keys if k in items.columns]
    return applicable(items.join(spread(head), on), _live(rules, kinds))


def floor_level(facts: Facts, rules: DataFrame) -> DataFrame:
    fl = facts.floors.select(*facts.keys, "floor_pos", "level", "footprint", "b").filter("b is not null")
    x = _items(facts, fl, rules, ["containment"], ["zoned_area"])
    x = x.withColumn("zb", F.expr(g.bounds("zoned_area"))).withColumn(
        "inside", F.expr(g.within("footprint", "zoned_area", "b", "zb"))
    )

    def o() -> str:
        return graded(
            "inside",
            geom="footprint",
            comp="false",
            obs_txt="case when inside then 'inside the zoned area' else 'outside the zoned area' end",
            req_txt="'inside the zoned area'",
            item="floor_pos",
            suffix=_floor_suffix(),
        )

    return _decide(x.filter("inside is not null"), o, facts.keys)


def projection_level(facts: Facts, rules: DataFrame, kinds=("projection_max", "projection_width_fraction")) -> DataFrame:
    x = _items(facts, facts.projections, rules, kinds, ["site_width"])
    d, lim = "short_side", "r.max_m"
    side, allowed = f"greatest({g.width('b')}, {g.depth('b')})", "(r.fraction * site_width)"

    def o() -> str:
        by_depth = (
            f"case when {d} is null then {make(_UNK, _EXT, req=lim, item='pos')}"
            f" else {graded(f'{d} <= {lim} + {EPS}', d, lim, geom='polygon', item='pos')} end"
        )
        by_width = (
            f"case when b is not null and site_width is not null then"
            f" {graded(f'{side} <= {allowed} + {EPS}', side, allowed, geom='polygon', item='pos')} end"
        )
        return f"case kind when 'projection_max' then {by_depth} else {by_width} end"

    return _decide(x, o, facts.keys)


def courtyard_level(facts: Facts, rules: DataFrame, kinds=("courtyard_min_area", "courtyard_min_width")) -> DataFrame:
    x = _items(facts, facts.courtyards, rules, kinds)

    def at_least(col, lim):
        return f"case when {col} is not null then {graded(f'{col} >= {lim} - {EPS}', col, lim, geom='ring', item='pos')} end"

    def o() -> str:
        return f"case kind when 'courtyard_min_area' then {at_least('area', 'r.min_sqm')} else {at_least('short_side', 'r.min_m')} end"

    return _decide(x, o, facts.keys)


_ROOM_ITEM = "cast({0}floor_pos as bigint) * 2147483648 + {0}room_index"


def first_room_per_level(rooms: DataFrame, keys=("model_id",), uses=None) -> DataFrame:
    """First room of each (model, level) in floor order, as an aggregate rather than a sort."""
    r = rooms if uses is None else rooms.filter(F.col("use").isin(*uses))
    first = F.expr("min_by(struct(floor_pos, room_index, use, polygon), struct(floor_pos, room_index))")
    return r.groupBy(*keys, "level").agg(first.alias("first")).select(*keys, "level", "first.*")


def room_height_level(facts: Facts, rules: DataFrame) -> DataFrame:
    live = _live(rules, ["room_min_height"])
    per_use = live.select(F.col("rule_id").alias("_rule"), F.explode("r.room_uses").alias("use")).distinct()
    # a ring is carried through the aggregate only where a finding shows it
    ring = "polygon" if _wanted is None or "geometry_ref" in _wanted else f"cast(null as {g.RING}) as polygon"
    on = [k for k in facts.keys if k in facts.rooms.columns]
    firsts = (
        facts.rooms.select(*on, "level", "floor_pos", "room_index", "use", "polygon")
        .join(per_use, "use")
        .groupBy(*on, "level", "_rule")
        .agg(F.expr(f"min_by(struct(floor_pos, room_index, {ring}), struct(floor_pos, room_index))").alias("first"))
        .withColumn("_fp", F.col("first.floor_pos"))
    )
    floor_keys = [k for k in on if k in facts.floors.columns]
    heights = facts.floors.select(*floor_keys, F.col("floor_pos").alias("_fp"), "height_m")
    x = in_place(firsts).join(spread(heights), [*floor_keys, "_fp"])
    x = _items(facts, x, rules, ["room_min_height"]).filter("rule_id = _rule")
    kw = dict(item=_ROOM_ITEM.format("first."), suffix=_floor_suffix())

    def o() -> str:
        return (
            f"case when height_m is null then {make(_UNK, _EXT, req='r.min_m', **kw)}"
            f" else {graded(f'height_m >= r.min_m - {EPS}', 'height_m', 'r.min_m', geom='first.polygon', **kw)} end"
        )

    return _decide(x, o, facts.keys)


def room_level(facts: Facts, rules: DataFrame, kinds=("light_ventilation_ratio", "staircase_min_width")) -> DataFrame:
    uses = (list(HABITABLE_USES) if "light_ventilation_ratio" in kinds else []) + (
        ["stair"] if "staircase_min_width" in kinds else []
    )
    rooms = measure_rings(facts.rooms.filter(F.col("use").isin(*uses)), "polygon")
    x = _items(facts, rooms, rules, kinds)
    lim, item, ratio = "r.min_ratio", _ROOM_ITEM.format(""), "(openings_area_sqm / area)"
    sfx = "concat(' (', use, ', floor ', level, ')')"
    # An opening area of zero cannot be told from "not measured", so it is unknown.
    w, wl = "short_side", "r.min_m"

    def o() -> str:
        light = (
            f"case when area is null or area = 0 or openings_area_sqm <= 0 then {make(_UNK, _EXT, req=lim, geom='polygon', item=item)}"
            f" else {graded(f'{ratio} >= {lim} - {EPS}', ratio, lim, geom='polygon', item=item, suffix=sfx)} end"
        )
        stair = (
            f"case when {w} is null then {make(_UNK, _EXT, req=wl, geom='polygon', item=item)}"
            f" else {graded(f'{w} >= {wl} - {EPS}', w, wl, geom='polygon', item=item)} end"
        )
        return (
            f"case when kind = 'light_ventilation_ratio' and array_contains({_HABITABLE}, use) then {light}"
            f" when kind = 'staircase_min_width' and use = 'stair' then {stair} end"
        )

    return _decide(x, o, facts.keys)


ITEM_LEVEL = {
    "containment": floor_level,
    "projection_max": lambda f, r: projection_level(f, r, ["projection_max"]),
    "projection_width_fraction": lambda f, r: projection_level(f, r, ["projection_width_fraction"]),
    "courtyard_min_area": lambda f, r: courtyard_level(f, r, ["courtyard_min_area"]),
    "courtyard_min_width": lambda f, r: courtyard_level(f, r, ["courtyard_min_width"]),
    "room_min_height": room_height_level,
    "light_ventilation_ratio": lambda f, r: room_level(f, r, ["light_ventilation_ratio"]),
    "staircase_min_width": lambda f, r: room_level(f, r, ["staircase_min_width"]),
}


def check(facts: Facts, rules: DataFrame, kind: str) -> DataFrame:
    """One check kind (E1-E17) on its own."""
    out = model_level(facts, rules, [kind])
    return out.unionByName(ITEM_LEVEL[kind](facts, rules)) if kind in ITEM_LEVEL else out


# ---------------------------------------------------------------- pack-level findings

def conflict_findings(plots: DataFrame, rules: DataFrame, keys=("model_id",)) -> DataFrame:
    """B2: rules in conflict give one unknown per model of the pack, before any band filter."""
    r = _lookup_rules(enforced(rules).filter("rule_status = 'conflict'")).drop("_authority")
    x = plots.filter("authority <> 'UNKNOWN'").join(r, F.col("rule_pack") == F.col("_pack"))
    return _decide(x.withColumn("any_upper", F.lit(False)), lambda: make("'unknown'", "'instrument_conflict'"), list(keys))


UNRESOLVED = "pack.unresolved"


def unresolved_pack(plots: DataFrame, keys=("model_id",)) -> DataFrame:
    """One blocking finding for a plot whose rule pack is not there; ``plots`` are the unresolved ones."""
    none = F.lit(None).cast("string")
    cite = F.struct(*[F.lit(v).alias(n) for n, v in (("doc", "n/a"), ("clause", "n/a"), ("version", "n/a"))], none.alias("url"), F.lit("seed_unverified").alias("status")).cast(CITATION)
    return _one_finding(plots.withColumn("cite", cite), keys, F.lit(UNRESOLVED), "No rule pack for this plot", F.col("cite"), F.col("rule_pack"), F.lit("a known rule pack"))


def unknown_authority(plots: DataFrame, rules: DataFrame, keys=("model_id",)) -> DataFrame:
    """Exactly one blocking finding for a plot whose authority is unknown."""
    packs = rules.groupBy(F.col("rule_pack").alias("_pack")).agg(
        F.first("pack_id").alias("pack_id"),
        F.first("pack_title").alias("pack_title"),
        F.first("jurisdiction").alias("jurisdiction"),
        F.first("pack_doc_id").alias("pack_doc_id"),
    )
    x = plots.filter("authority = 'UNKNOWN'").join(packs, F.col("rule_pack") == F.col("_pack"))
    cite = F.struct(
        F.col("pack_doc_id").alias("doc"), F.lit("n/a").alias("clause"), F.lit("n/a").alias("version"),
        F.lit(None).cast("string").alias("url"), F.lit("seed_unverified").alias("status"),
    ).cast(CITATION)
    return _one_finding(x, keys, F.concat("pack_id", F.lit(".jurisdiction.unknown")), "Authority of the plot is not known", cite, F.col("authority"), F.coalesce("jurisdiction", F.lit("an unspecified authority")))


def _one_finding(x: DataFrame, keys, rule_id: Column, title: str, cite: Column, observed: Column, required: Column) -> DataFrame:
    """A blocking ``unknown`` finding about the plot's jurisdiction for each row."""
    return x.select(
        *keys,
        F.lit(0).cast("bigint").alias("finding_seq"),
        rule_id.alias("rule_id"),
        F.lit("unknown").alias("status"),
        F.lit("blocking").alias("severity"),
        F.lit(title).alias("title"),
        cite.alias("citation"),
        F.lit(None).cast("double").alias("observed_num"),
        observed.alias("observed_txt"),
        F.lit(None).cast("double").alias("required_num"),
        required.alias("required_txt"),
        F.lit(None).cast(g.RING).alias("geometry_ref"),
        F.lit(False).alias("compoundable"),
        F.lit("missing_input").alias("ambiguity_class"),
        F.expr(
            one_remedy("zoning_revision_request", "Settle which authority governs the plot; no rule of this pack was evaluated.")
        ).alias("remedies"),
        "rule_pack",
    )


def assert_cited(findings: DataFrame) -> DataFrame:
    """Findings without a document or clause; must be empty."""
    return findings.filter(F.col("citation.doc").isNull() | F.col("citation.clause").isNull())


# Words a report may never contain.
BANNED_WORDS = ("approved", "compliant")


def banned_language(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text uses sanction language; must be empty."""
    return df.filter(F.lower(column).rlike("|".join(BANNED_WORDS)))


def rule_family(rule_id: Column) -> Column:
    """J23."""
    return F.split_part(rule_id, F.lit("."), F.lit(2))
