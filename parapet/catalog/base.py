"""Registry and the DuckDB side of the derived tables."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parapet.sources.packs import PACK_DIR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its DuckDB twin if there is one."""

    def deco(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return f"{float(v)!r}::DOUBLE"
    if isinstance(v, list):
        return "[" + ",".join(_lit(x) for x in v) + "]::VARCHAR[]"
    return "'" + str(v).replace("'", "''") + "'"


@functools.cache
def rules_values() -> str:
    """The rule packs as a DuckDB CTE named ``rules``."""
    out = []
    for name in sorted(os.listdir(PACK_DIR)):
        with open(os.path.join(PACK_DIR, name), encoding="utf-8") as f:
            pack = json.load(f)
        for pos, r in enumerate(pack["rules"]):
            band = r["applies_when"].get("plot_area_sqm") or {}
            sup = r.get("superseded_source") or {}
            vals = [
                _lit(name[:-5]), _lit(pack["pack_id"]), _lit(pack["title"]), _lit(pack["jurisdiction"]), str(pos),
                _lit(r["id"]), _lit(r["title"]), _lit(r["kind"]), _lit(r["source"]["doc"]), _lit(r["source"]["clause"]),
                _lit(r["source"]["version"]), _lit(r["status"]), _lit(r["applies_when"]["authority"]),
                _lit(band.get("min")), _lit(band.get("max")), _lit(r["severity"]), _lit(r["compoundable"]),
                str(len(r["remedies"])), _lit(r["enforced"]), _lit(r.get("max_far")), _lit(r.get("superseded_value")),
                _lit(r.get("fraction_of_height")), _lit(r.get("min_m")), _lit(r.get("max_m")), _lit(r.get("fraction")),
                _lit(r.get("min_sqm")), _lit(r.get("room_uses", [])), _lit(r.get("min_ratio")),
                _lit(r.get("height_threshold_m")), _lit(r.get("recede_ratio")), _lit(r["remedies"]), _lit(sup.get("clause")),
            ]
            out.append("(" + ",".join(vals) + ")")
    cols = (
        "rule_pack,pack_id,pack_title,jurisdiction,rule_pos,rule_id,title,kind,doc,clause,version,rule_status,"
        "rule_authority,area_lo,area_hi,severity,compoundable,n_rem,enforced,max_far,superseded_value,fof,min_m,"
        "max_m,fraction,min_sqm,room_uses,min_ratio,h_limit,recede,rem_kinds,superseded_clause"
    )
    return f"rules({cols}) AS (VALUES " + ",\n".join(out) + ")"


PLOTS = """
plots AS (
  SELECT o_orderkey AS model_id, o_custkey AS seed,
    CASE WHEN o_orderpriority LIKE '3-%' THEN 'CHANDIGARH' WHEN o_orderpriority LIKE '4-%' THEN 'UNKNOWN' ELSE 'GMADA' END AS authority,
    CASE WHEN o_orderpriority LIKE '3-%' THEN 'chandigarh_building_rules_urban_2017' ELSE 'puda_building_rules_1996' END AS rule_pack,
    CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderdate AS DATE) END AS allotment_date,
    CAST(8 + o_orderkey % 13 AS DOUBLE) AS w, CAST(15 + o_custkey % 17 AS DOUBLE) AS l,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(8 + o_orderkey % 13 AS DOUBLE) * CAST(15 + o_custkey % 17 AS DOUBLE) END AS plot_area_sqm,
    o_orderkey % 7 <> 0 AS has_zone,
    CASE WHEN o_orderkey % 4 = 0 THEN 1.5::DOUBLE + 0.125::DOUBLE * CAST(o_custkey % 12 AS DOUBLE) END AS mumty_h,
    CASE WHEN o_orderkey % 4 = 0 THEN 0.125::DOUBLE * CAST(o_orderkey % 24 AS DOUBLE) END AS mumty_s,
    o_orderkey % 3 = 0 AS has_rwh, CAST(o_custkey % 5 AS INT) AS tree_count
  FROM orders)"""
EDGES = """
edges AS (
  SELECT model_id, 0 AS edge_pos, 'front' AS role, 0::DOUBLE AS x0, 0::DOUBLE AS y0, w AS x1, 0::DOUBLE AS y1,
    CASE WHEN model_id % 23 <> 0 THEN CAST(6 + seed % 10 AS DOUBLE) END AS road_width_m FROM plots
  UNION ALL SELECT model_id, 1, 'rear', w, l, 0, l, NULL FROM plots
  UNION ALL SELECT model_id, 2, 'side_a', 0, l, 0, 0, NULL FROM plots
  UNION ALL SELECT model_id, 3, 'side_b', w, 0, w, l, NULL FROM plots)"""
LR = """
lr AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)"""
FLOORS = """
floors0 AS (
  SELECT *, l_orderkey AS model_id, CAST(rn - 1 AS INT) AS floor_pos,
    CAST(rn - 1 - (CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END) AS INT) AS level,
    0.25::DOUBLE * CAST(4 + l_partkey % 8 AS DOUBLE) AS x0, 0.25::DOUBLE * CAST(8 + l_suppkey % 12 AS DOUBLE) AS y0
  FROM lr),
floors AS (
  SELECT *, (x1 - x0) * (y1 - y0) AS area FROM (
    SELECT model_id, floor_pos, level, (level = 0 AND model_id % 6 = 0) AS is_stilt, x0, y0,
      x0 + 5.0::DOUBLE + 0.25::DOUBLE * CAST(l_partkey % 24 AS DOUBLE) AS x1, y0 + 6.0::DOUBLE + 0.25::DOUBLE * CAST(l_suppkey % 40 AS DOUBLE) AS y1,
      CASE WHEN l_suppkey % 9 <> 0 THEN 2.25::DOUBLE + 0.125::DOUBLE * CAST(l_partkey % 8 AS DOUBLE) END AS height_m,
      model_id % 17 = 0 AS footprint_is_upper_bound,
      l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag
    FROM floors0))"""
ROOMS = """
rooms AS (
  SELECT model_id, floor_pos, level, room_index, use, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) AS area,
    greatest(0.0::DOUBLE, 0.125::DOUBLE * (CAST(l_quantity AS DOUBLE) - 10.0::DOUBLE)) AS openings_area_sqm,
    CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS confidence
  FROM (
    SELECT * EXCLUDE (x1), (x0 + x1) / 2.0::DOUBLE AS x1, 0 AS room_index,
      (['bedroom','living','kitchen','bath','wc','store','stair','garage','other'])[1 + l_linenumber % 9] AS use FROM floors
    UNION ALL BY NAME
    SELECT * EXCLUDE (x0), (x0 + x1) / 2.0::DOUBLE AS x0, 1 AS room_index,
      (['bedroom','living','kitchen','bath','wc','store','stair','garage','other'])[1 + l_partkey % 9] AS use FROM floors))"""
PROJ = """
projections AS (
  SELECT l_orderkey AS model_id, rn AS pos, 0.25::DOUBLE * CAST(1 + l_partkey % 12 AS DOUBLE) AS d, 0.5::DOUBLE * CAST(1 + l_suppkey % 10 AS DOUBLE) AS pw
  FROM lr WHERE l_partkey % 2 = 0)"""
COURT = """
courtyards AS (
  SELECT l_orderkey AS model_id, rn AS pos, 1.5::DOUBLE + 0.25::DOUBLE * CAST(l_partkey % 10 AS DOUBLE) AS cw, 2.0::DOUBLE + 0.25::DOUBLE * CAST(l_suppkey % 12 AS DOUBLE) AS cd
  FROM lr WHERE l_partkey % 2 = 1)"""
FACTS = """
fdist AS (
  SELECT f.*,
    sqrt(pow2(greatest(0.0, x0 - w, -x1)) + pow2(greatest(0.0, y0, -y1))) AS d_front,
    sqrt(pow2(greatest(0.0, x0 - w, -x1)) + pow2(greatest(0.0, y0 - l, l - y1))) AS d_rear,
    sqrt(pow2(greatest(0.0, x0, -x1)) + pow2(greatest(0.0, y0 - l, -y1))) AS d_side_a,
    sqrt(pow2(greatest(0.0, x0 - w, w - x1)) + pow2(greatest(0.0, y0 - l, -y1))) AS d_side_b
  FROM floors f JOIN plots p USING (model_id)),
ff AS (
  SELECT model_id, count(*) AS n_floors, sum(CASE WHEN NOT is_stilt THEN area END) AS covered_excl, sum(area) AS covered_incl,
    sum(CASE WHEN NOT is_stilt THEN height_m END) AS height, bool_or(is_stilt) AS has_stilt, bool_or(footprint_is_upper_bound) AS any_upper,
    arg_min(area, floor_pos) FILTER (WHERE level = 0) AS g_area, min(floor_pos) FILTER (WHERE level = 0) AS g_pos,
    min(floor_pos) FILTER (WHERE level < 0) AS b_pos, arg_min(area, floor_pos) FILTER (WHERE level < 0) AS b_area,
    min(d_front) AS s_front, min(d_rear) AS s_rear, min(d_side_a) AS s_side_a, min(d_side_b) AS s_side_b
  FROM fdist GROUP BY model_id),
facts AS (
  SELECT p.*, coalesce(n_floors, 0) AS n_floors, coalesce(covered_excl, 0) AS covered_excl, coalesce(covered_incl, 0) AS covered_incl, height,
    coalesce(has_stilt, false) AS has_stilt, coalesce(any_upper, false) AS any_upper, g_area, g_pos, b_pos, b_area, b.height_m AS b_height,
    s_front, s_rear, s_side_a, s_side_b,
    (SELECT count(*) FROM projections x WHERE x.model_id = p.model_id) AS n_proj,
    (SELECT count(*) FROM courtyards x WHERE x.model_id = p.model_id) AS n_court,
    CASE WHEN p.model_id % 23 <> 0 THEN CAST(6 + p.seed % 10 AS DOUBLE) END AS road_w, least(p.w, p.l) AS site_w
  FROM plots p LEFT JOIN ff USING (model_id) LEFT JOIN floors b ON b.model_id = p.model_id AND b.floor_pos = ff.b_pos),
uses AS (SELECT DISTINCT model_id, use FROM rooms),
ap AS (
  SELECT f.*, r.* EXCLUDE (rule_pack) FROM facts f JOIN rules r
    ON r.rule_pack = f.rule_pack AND r.rule_authority = f.authority AND r.enforced AND r.rule_status <> 'conflict'
   AND (f.plot_area_sqm IS NULL OR (f.plot_area_sqm >= coalesce(r.area_lo, f.plot_area_sqm) AND f.plot_area_sqm <= coalesce(r.area_hi, f.plot_area_sqm)))
  WHERE f.authority <> 'UNKNOWN')"""


def _pow2(sql: str) -> str:
    """Expand ``pow2(x)`` to ``(x)*(x)`` so that both engines square by multiplication."""
    out = ""
    while "pow2(" in sql:
        i = sql.index("pow2(")
        depth, j = 1, i + 5
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        arg = sql[i + 5 : j - 1]
        out += sql[:i] + f"({arg})*({arg})"
        sql = sql[j:]
    return out + sql


def model_ctes() -> str:
    return _pow2(",".join([rules_values(), PLOTS, EDGES, LR, FLOORS, ROOMS, PROJ, COURT, FACTS]))


def with_model(body: str) -> str:
    return "WITH " + model_ctes() + "\n" + body


# One block per check kind: (model_id, rule_id, item, suffix, status, amb, obs, req, comp, n_rem, geom).
def _pv(ok: str) -> str:
    return f"CASE WHEN {ok} THEN 'pass' ELSE 'violation' END"


E = "1e-9::DOUBLE"
_HEAD = "SELECT model_id, rule_id, {item} AS item, {sfx} AS suffix, {status} AS status, {amb} AS amb, {obs} AS obs, {req} AS req, {comp} AS comp, {rem} AS n_rem, {geom} AS geom FROM {src} WHERE kind = '{kind}' {cond}"


def _blk(kind, status, amb="NULL::VARCHAR", obs="NULL::DOUBLE", req="NULL::DOUBLE", comp=None, rem=None, geom=None, item="0::BIGINT", sfx="''", src="ap", cond="", ok=None):
    """``ok``: the pass condition when it can be decided, used for compoundable/remedies/highlight."""
    comp = comp or (f"coalesce(({ok}) IS NOT NULL AND compoundable, false)" if ok else "false")
    rem = rem or (f"CASE WHEN NOT ({ok}) THEN n_rem ELSE 0 END" if ok else "0")
    geom = geom or (f"coalesce(NOT ({ok}), false)" if ok else "false")
    return _HEAD.format(**locals())


def _graded(kind, ok, obs, req, nulls="", amb="NULL::VARCHAR", **kw):
    status = f"CASE {nulls} WHEN {ok} THEN 'pass' WHEN NOT ({ok}) THEN 'violation' END"
    return _blk(kind, status, amb=amb, obs=obs, req=req, ok=ok, **kw)


_SLAB = "(CASE WHEN plot_area_sqm IS NOT NULL THEN least(plot_area_sqm,210.0)*(65.0::DOUBLE/100.0::DOUBLE) + least(greatest(plot_area_sqm-210.0,0.0),210.0)*(50.0::DOUBLE/100.0::DOUBLE) + greatest(plot_area_sqm-420.0,0.0)*(40.0::DOUBLE/100.0::DOUBLE) END)"
_FAR = "(covered_excl/plot_area_sqm)"
_NOAREA = "WHEN plot_area_sqm IS NULL THEN 'unknown'"


def _setback(role, i):
    need = "greatest(height*fof, min_m)"
    obs = f"s_{role}"
    ok = f"(height IS NOT NULL AND {obs} IS NOT NULL) AND {obs} >= {need} - {E}"
    und = f"(height IS NULL OR {obs} IS NULL)"
    fam = "rule_id LIKE '%front_rear%'" if role in ("front", "rear") else "rule_id NOT LIKE '%front_rear%'"
    return _blk(
        "setback_formula", f"CASE WHEN {und} THEN 'unknown' WHEN {ok} THEN 'pass' ELSE 'violation' END",
        amb=f"CASE WHEN {und} THEN 'extraction' END", obs=f"CASE WHEN NOT {und} THEN {obs} END",
        req=f"CASE WHEN NOT {und} THEN {need} END", comp=f"(NOT {und}) AND compoundable",
        rem=f"CASE WHEN NOT {und} AND NOT ({ok}) THEN n_rem ELSE 0 END", geom=f"NOT {und} AND NOT ({ok})",
        item=f"{i}::BIGINT", sfx=f"' ({role})'", cond="AND " + fam,
    )


def _lower_bound(kind, col, lim, src, item, **kw):
    return _graded(kind, f"{col} >= {lim} - {E}", col, lim, src=src, item=item, **kw)


_FL_SFX = "' (floor ' || level || ')'"
_ROOM_ITEM = "(floor_pos::BIGINT*2147483648 + room_index)"
_ZONE_IN = "(x0 >= 1.5 AND y0 >= 3.0 AND x1 <= w - 1.5 AND y1 <= l - 3.0)"

RAW: dict[str, list[str]] = {
    "containment": [
        _blk("containment", "'unknown'", "'missing_input'", rem="1", geom="true", cond="AND NOT has_zone"),
        _blk("containment", "'unknown'", "'missing_input'", cond="AND has_zone AND n_floors = 0"),
        _blk("containment", _pv(_ZONE_IN), comp="false", rem=f"CASE WHEN {_ZONE_IN} THEN 0 ELSE n_rem END", geom=f"NOT {_ZONE_IN}",
             item="floor_pos::BIGINT", sfx=_FL_SFX, src="(ap JOIN floors f USING (model_id))", cond="AND has_zone"),
    ],
    "site_coverage_slab": [
        _graded("site_coverage_slab", f"g_area <= {_SLAB} + {E}", "CASE WHEN plot_area_sqm IS NOT NULL THEN g_area END", f"CASE WHEN g_area IS NOT NULL THEN {_SLAB} END",
                _NOAREA + " WHEN g_area IS NULL THEN 'unknown'", amb="CASE WHEN plot_area_sqm IS NULL THEN 'missing_input' WHEN g_area IS NULL THEN 'extraction' END"),
    ],
    "far_band": [
        _graded("far_band", f"{_FAR} <= max_far + {E}", _FAR, "CASE WHEN plot_area_sqm IS NOT NULL THEN max_far END", _NOAREA,
                amb="CASE WHEN plot_area_sqm IS NULL THEN 'missing_input' END",
                sfx="CASE WHEN has_stilt AND plot_area_sqm IS NOT NULL THEN ' (stilt storey left out of the ratio)' ELSE '' END"),
    ],
    "far_band_gap": [_blk("far_band_gap", "'ambiguity'", "'instrument_conflict'", obs=_FAR, rem="1", geom="true", cond="AND plot_area_sqm >= coalesce(area_lo, 0)")],
    "stilt_far_definitional": [_blk("stilt_far_definitional", "'ambiguity'", "'definitional'", obs=_FAR, req="covered_incl/plot_area_sqm", cond="AND has_stilt AND plot_area_sqm IS NOT NULL")],
    "setback_formula": [_setback("front", 0), _setback("rear", 1), _setback("side_a", 0), _setback("side_b", 1)],
    "height_vs_road": [
        _graded("height_vs_road", f"height <= (road_w + s_front) + {E}", "CASE WHEN road_w + s_front IS NOT NULL THEN height END", "CASE WHEN height IS NOT NULL THEN road_w + s_front END",
                "WHEN road_w IS NULL OR s_front IS NULL OR height IS NULL THEN 'unknown'",
                amb="CASE WHEN road_w IS NULL OR s_front IS NULL OR height IS NULL THEN 'missing_input' END"),
    ],
    "projection_max": [
        _blk("projection_max", "'pass'", req="max_m", cond="AND n_proj = 0"),
        _graded("projection_max", f"least(d, pw) <= max_m + {E}", "least(d, pw)", "max_m", src="(ap JOIN projections USING (model_id))", item="pos::BIGINT"),
    ],
    "projection_width_fraction": [
        _blk("projection_width_fraction", "'pass'", cond="AND n_proj = 0"),
        _graded("projection_width_fraction", f"greatest(d, pw) <= fraction*site_w + {E}", "greatest(d, pw)", "fraction*site_w", src="(ap JOIN projections USING (model_id))", item="pos::BIGINT"),
    ],
    "courtyard_min_area": [
        _blk("courtyard_min_area", "'pass'", req="min_sqm", cond="AND n_court = 0"),
        _lower_bound("courtyard_min_area", "(cw*cd)", "min_sqm", "(ap JOIN courtyards USING (model_id))", "pos::BIGINT"),
    ],
    "courtyard_min_width": [
        _blk("courtyard_min_width", "'pass'", req="min_m", cond="AND n_court = 0"),
        _lower_bound("courtyard_min_width", "least(cw, cd)", "min_m", "(ap JOIN courtyards USING (model_id))", "pos::BIGINT"),
    ],
    "room_min_height": [
        _blk("room_min_height", "'pass'", req="min_m", cond="AND NOT EXISTS (SELECT 1 FROM uses u WHERE u.model_id = ap.model_id AND list_contains(ap.room_uses, u.use))"),
        _graded("room_min_height", f"height_m >= min_m - {E}", "height_m", "min_m", "WHEN height_m IS NULL THEN 'unknown'",
                amb="CASE WHEN height_m IS NULL THEN 'extraction' END", item=_ROOM_ITEM, sfx=_FL_SFX,
                src="(SELECT a.* EXCLUDE (height), fr.floor_pos, fr.room_index, fr.level, f.height_m FROM ap a JOIN (SELECT *, row_number() OVER (PARTITION BY x.model_id, x.level, r2.rule_id ORDER BY x.floor_pos, x.room_index) AS k, r2.rule_id AS rid "
                    "FROM rooms x JOIN (SELECT rule_id, unnest(room_uses) AS ru FROM rules WHERE kind = 'room_min_height' AND enforced) r2 ON r2.ru = x.use) fr ON fr.model_id = a.model_id AND fr.rid = a.rule_id AND fr.k = 1 "
                    "JOIN floors f ON f.model_id = fr.model_id AND f.floor_pos = fr.floor_pos)"),
    ],
    "light_ventilation_ratio": [
        _blk("light_ventilation_ratio", "'pass'", req="min_ratio", cond="AND NOT EXISTS (SELECT 1 FROM uses u WHERE u.model_id = ap.model_id AND u.use IN ('bedroom','living','kitchen'))"),
        _graded("light_ventilation_ratio", f"(openings_area_sqm > 0) AND openings_area_sqm/area >= min_ratio - {E}", "CASE WHEN openings_area_sqm > 0 THEN openings_area_sqm/area END", "min_ratio",
                "WHEN openings_area_sqm <= 0 THEN 'unknown'", amb="CASE WHEN openings_area_sqm <= 0 THEN 'extraction' END",
                comp="(openings_area_sqm > 0) AND compoundable", rem="CASE WHEN openings_area_sqm > 0 AND openings_area_sqm/area < min_ratio - 1e-9::DOUBLE THEN n_rem ELSE 0 END",
                geom="openings_area_sqm <= 0 OR openings_area_sqm/area < min_ratio - 1e-9::DOUBLE", item=_ROOM_ITEM,
                sfx="CASE WHEN openings_area_sqm > 0 THEN ' (' || use || ', floor ' || level || ')' ELSE '' END",
                src="(ap JOIN rooms USING (model_id))", cond="AND use IN ('bedroom','living','kitchen')"),
    ],
    "floor_min_height": [
        _blk("floor_min_height", "'pass'", req="min_m", cond="AND b_pos IS NULL"),
        _graded("floor_min_height", f"b_height >= min_m - {E}", "b_height", "min_m", "WHEN b_height IS NULL THEN 'unknown'", amb="CASE WHEN b_height IS NULL THEN 'extraction' END", cond="AND b_pos IS NOT NULL"),
    ],
    "area_relation": [
        _blk("area_relation", "'pass'", cond="AND rule_id LIKE '%basement%' AND b_pos IS NULL"),
        _graded("area_relation", f"b_area <= g_area + {E}", "CASE WHEN g_area IS NOT NULL THEN b_area END", "g_area", "WHEN g_area IS NULL THEN 'unknown'",
                amb="CASE WHEN g_area IS NULL THEN 'extraction' END", cond="AND rule_id LIKE '%basement%' AND b_pos IS NOT NULL"),
    ],
    "staircase_min_width": [
        _blk("staircase_min_width", "'unknown'", "'extraction'", req="min_m", cond="AND NOT EXISTS (SELECT 1 FROM uses u WHERE u.model_id = ap.model_id AND u.use = 'stair')"),
        _lower_bound("staircase_min_width", "least(x1-x0, y1-y0)", "min_m", "(ap JOIN rooms USING (model_id))", _ROOM_ITEM, cond="AND use = 'stair'"),
    ],
    "roof_projection_recede": [
        _blk("roof_projection_recede", "'pass'", cond="AND mumty_h IS NULL"),
        _blk("roof_projection_recede", "'pass'", obs="mumty_h", cond="AND mumty_h <= h_limit"),
        _graded("roof_projection_recede", f"mumty_s >= mumty_h*recede - {E}", "mumty_s", "mumty_h*recede", geom="false", cond="AND mumty_h > h_limit"),
    ],
}

_DEP = "(rule_id ILIKE '%containment%' OR rule_id ILIKE '%coverage%' OR rule_id ILIKE '%far%' OR rule_id ILIKE '%setback%')"
UNKNOWN_AUTHORITY = """SELECT p.model_id, 0::BIGINT AS finding_seq, k.pack_id || '.jurisdiction.unknown' AS rule_id, 'unknown' AS status, 'blocking' AS severity,
  'Authority of the plot is not known' AS title, NULL::DOUBLE AS observed_num, NULL::DOUBLE AS required_num, false AS compoundable, 'missing_input' AS ambiguity_class,
  1 AS n_remedies, false AS has_geometry
FROM plots p JOIN (SELECT DISTINCT rule_pack, pack_id FROM rules) k USING (rule_pack) WHERE p.authority = 'UNKNOWN'"""


def raw_sql(kinds) -> str:
    return " UNION ALL ".join(b for k in kinds for b in RAW[k])


def findings_select(kinds) -> str:
    return f"""SELECT x.model_id, r.rule_pos::BIGINT * 70368744177664 + x.item AS finding_seq, x.rule_id,
  CASE WHEN soft THEN 'ambiguity' ELSE status END AS status, r.severity,
  r.title || suffix || CASE WHEN soft THEN ' - confirm against the drawing' ELSE '' END AS title,
  obs AS observed_num, req AS required_num, comp AS compoundable,
  CASE WHEN soft THEN 'extraction' ELSE amb END AS ambiguity_class, x.n_rem::INT AS n_remedies, geom AS has_geometry
FROM (SELECT y.*, y.status = 'violation' AND coalesce(u.any_upper, false) AND {_DEP} AS soft
      FROM ({raw_sql(kinds)}) y LEFT JOIN ff u USING (model_id)) x JOIN rules r ON r.rule_id = x.rule_id"""


def findings_sql(kinds) -> str:
    return with_model(findings_select(kinds))


def all_findings_ctes() -> str:
    """CTEs up to ``findings``: every finding of every model."""
    return model_ctes() + f", findings AS ({findings_select(RAW)} UNION ALL {UNKNOWN_AUTHORITY})"


def with_findings(body: str) -> str:
    return "WITH " + all_findings_ctes() + "\n" + body
