"""Queries for the rule checks (A2, A3, A5, B1-B7, C1-C3, E, F7, G6, I1, J14, J23)."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.catalog.base import UNKNOWN_AUTHORITY, findings_sql, query, with_findings, with_model
from parapet.functions import geometry as g
from parapet.operators import checks as c
from parapet.operators import normalise as n
from parapet.operators import secondary as sec
from parapet.plans.evaluate import evaluate
from parapet.sources import derived as d
from parapet.sources.packs import read_packs

CHECKS = {
    "E01_containment": "containment",
    "E02_site_coverage_slab": "site_coverage_slab",
    "E03_far_band": "far_band",
    "E04_far_band_gap": "far_band_gap",
    "E05_stilt_far_definitional": "stilt_far_definitional",
    "E06_setback_formula": "setback_formula",
    "E07_height_vs_road": "height_vs_road",
    "E08_projection_max": "projection_max",
    "E09_projection_width_fraction": "projection_width_fraction",
    "E10_courtyard_min_area": "courtyard_min_area",
    "E11_courtyard_min_width": "courtyard_min_width",
    "E12_room_min_height": "room_min_height",
    "E13_light_ventilation_ratio": "light_ventilation_ratio",
    "E14_floor_min_height": "floor_min_height",
    "E15_area_relation": "area_relation",
    "E16_staircase_min_width": "staircase_min_width",
    "E17_roof_projection_recede": "roof_projection_recede",
}


def flat(findings: DataFrame, keys=("model_id",)) -> DataFrame:
    """Scalar columns of a findings table."""
    return findings.select(
        *keys, "finding_seq", "rule_id", "status", "severity", "title", "observed_num", "required_num",
        "compoundable", "ambiguity_class", F.size("remedies").alias("n_remedies"),
        F.col("geometry_ref").isNotNull().alias("has_geometry"),
    )


def all_findings(spark, sf_dir, *fields: str) -> DataFrame:
    """Every finding; with ``fields`` only these of the check's own columns are filled (see ``checks.only``)."""
    with c.only(*fields) if fields else contextlib.nullcontext():
        # tables dealt by model once: facts that are written would lose that, and be shuffled again by each check
        return evaluate(d.model_tables(spark, sf_dir, by_model=True), read_packs(spark))


for _name, _kind in CHECKS.items():

    @query(_name, findings_sql([_kind]))
    def _run(spark, sf_dir, kind=_kind):
        facts = c.build_facts(d.model_tables(spark, sf_dir), kinds=[kind])
        return flat(c.check(facts, read_packs(spark), kind))


@query("E18_evaluate", with_findings("SELECT * FROM findings"))
def e18(spark, sf_dir):
    return flat(all_findings(spark, sf_dir))


def tables(spark, sf_dir):
    return d.model_tables(spark, sf_dir)


_PAIRS = "SELECT p.model_id, r.* FROM plots p JOIN rules r ON r.rule_pack = p.rule_pack"
_AP = with_model("SELECT model_id, rule_id FROM ap")


@query("A02_validate", """
WITH m AS (SELECT o_orderkey AS model_id, o_orderkey % 4 = 3 AS s, o_orderkey % 17 = 0 AS a, o_orderkey % 13 = 0 AS u FROM orders)
SELECT model_id, concat_ws(',', CASE WHEN s THEN 'source' END, CASE WHEN a THEN 'jurisdiction.authority' END, CASE WHEN u THEN 'rooms.use' END) AS reasons FROM m""")
def a02(spark, sf_dir):
    ok, bad = n.validate(d.nested_models(spark, sf_dir))
    return bad.selectExpr("model_id", "concat_ws(',', reasons) as reasons").unionByName(ok.selectExpr("model_id", "'' as reasons"))


@query("A02_validate_rows", """
SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderpriority NOT IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN 'o_orderpriority' END, CASE WHEN o_orderstatus NOT IN ('O','F') THEN 'o_orderstatus' END) AS reasons FROM orders""")
def a02_rows(spark, sf_dir):
    o = d.load(spark, sf_dir, "orders")
    v = n.validate_rows(o, {"o_orderpriority": ("1-URGENT", "2-HIGH", "3-MEDIUM"), "o_orderstatus": ("O", "F")}, ("o_orderkey",))
    return v.selectExpr("o_orderkey", "concat_ws(',', reasons) as reasons")


@query("A03_normalise", with_model("""
SELECT 'plots' AS tbl, model_id, 0 AS pos, coalesce(plot_area_sqm, -1) AS measure, authority AS label FROM (SELECT * REPLACE (CASE WHEN model_id % 17 = 0 THEN 'NOWHERE' ELSE authority END AS authority) FROM plots)
UNION ALL SELECT 'edges', model_id, 0, 9.0, 'front' FROM plots
UNION ALL SELECT 'floors', model_id, k, (w - 2) * (l - 4), CAST(CASE WHEN k = 0 THEN 3.0::DOUBLE END AS VARCHAR) FROM plots, range(2) t(k)
UNION ALL SELECT 'rooms', model_id, k, 1.5, CASE WHEN model_id % 13 = 0 THEN 'attic' ELSE (['bedroom','living','kitchen','bath','wc','store','stair','garage','other'])[1 + seed % 9] END FROM plots, range(2) t(k)
UNION ALL SELECT 'projections', model_id, 0, 3.0, 'balcony' FROM plots WHERE model_id % 3 = 0
UNION ALL SELECT 'courtyards', model_id, 0, 6.0, NULL FROM plots WHERE model_id % 5 = 0"""))
def a03(spark, sf_dir):
    t = n.normalise(d.nested_models(spark, sf_dir))
    parts = [
        t["plots"].selectExpr("'plots' as tbl", "model_id", "0 as pos", "coalesce(plot_area_sqm, -1) as measure", "authority as label"),
        t["edges"].selectExpr("'edges' as tbl", "model_id", "edge_pos as pos", "road_width_m as measure", "role as label"),
        t["floors"].selectExpr("'floors' as tbl", "model_id", "floor_pos as pos", g.area("footprint") + " as measure", "cast(height_m as string) as label"),
        t["rooms"].selectExpr("'rooms' as tbl", "model_id", "floor_pos as pos", "openings_area_sqm as measure", "use as label"),
        t["projections"].selectExpr("'projections' as tbl", "model_id", "pos", g.area("polygon") + " as measure", "type as label"),
        t["courtyards"].selectExpr("'courtyards' as tbl", "model_id", "pos", g.area("ring") + " as measure", "cast(null as string) as label"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("A05_resolve_pack", with_model("""
SELECT model_id, CASE WHEN model_id % 9 = 0 THEN NULL ELSE rule_pack END AS pack FROM plots"""))
def a05(spark, sf_dir):
    p = d.plots(spark, sf_dir).withColumn("rule_pack", F.expr("case when model_id % 9 = 0 then 'no_such_pack' else rule_pack end"))
    good, missing = n.resolve_pack(p, read_packs(spark))
    return good.select("model_id", "pack").unionByName(missing.select("model_id", "pack"))


@query(
    "A05_unresolved_findings",
    with_findings("""SELECT p.model_id, CASE WHEN p.model_id % 9 = 0 THEN 1 ELSE count(f.model_id) END AS n_findings, CASE WHEN p.model_id % 9 = 0 THEN 1 ELSE 0 END AS n_unresolved
FROM plots p LEFT JOIN findings f USING (model_id) GROUP BY 1 HAVING p.model_id % 9 = 0 OR count(f.model_id) > 0"""),
)
def a05_unresolved(spark, sf_dir):
    t = d.model_tables(spark, sf_dir)
    t["plots"] = t["plots"].withColumn("rule_pack", F.expr("case when model_id % 9 = 0 then 'no_such_pack' else rule_pack end"))
    found = evaluate(t, read_packs(spark))
    return found.groupBy("model_id").agg(F.count("*").alias("n_findings"), F.count_if(F.col("rule_id") == c.UNRESOLVED).alias("n_unresolved"))


@query("B01_enforced", with_model("SELECT p.model_id, count(*) AS n_enforced FROM plots p JOIN rules r USING (rule_pack) WHERE r.enforced GROUP BY 1"))
def b01(spark, sf_dir):
    r = c.enforced(read_packs(spark))
    return d.plots(spark, sf_dir).join(r.select("rule_pack", "rule_id"), "rule_pack").groupBy("model_id").agg(F.count("*").alias("n_enforced"))


def _conflicted(spark):
    return read_packs(spark).withColumn("rule_status", F.expr("case when rule_pos % 7 = 0 then 'conflict' else rule_status end"))


@query("B02_conflict_findings", with_model("""
SELECT p.model_id, r.rule_pos::BIGINT * 70368744177664 AS finding_seq, rule_id, 'unknown' AS status, severity, title, NULL::DOUBLE AS observed_num, NULL::DOUBLE AS required_num,
  false AS compoundable, 'instrument_conflict' AS ambiguity_class, 0 AS n_remedies, false AS has_geometry
FROM plots p JOIN rules r USING (rule_pack) WHERE r.enforced AND r.rule_pos % 7 = 0 AND p.authority <> 'UNKNOWN'"""))
def b02(spark, sf_dir):
    return flat(c.conflict_findings(d.plots(spark, sf_dir), _conflicted(spark)))


@query("B03_unknown_authority", with_model(UNKNOWN_AUTHORITY))
def b03(spark, sf_dir):
    return flat(c.unknown_authority(d.plots(spark, sf_dir), read_packs(spark)))


@query("B04_citation", with_model("SELECT model_id, rule_id, doc, clause, version, rule_status AS cite_status FROM ap"))
def b04(spark, sf_dir):
    p = c._known(d.plots(spark, sf_dir))
    x = c.citation(c.applicable(p, c.enforced(read_packs(spark))))
    return x.select("model_id", "rule_id", "citation.doc", "citation.clause", "citation.version", F.col("citation.status").alias("cite_status"))


@query("B05_remedies", with_model("""
SELECT model_id, rule_id, k AS kind, 'Possible remedy for ' || rule_id || '; not re-checked.' AS description, false AS verified FROM (SELECT model_id, rule_id, unnest(rem_kinds) AS k FROM ap)"""))
def b05(spark, sf_dir):
    x = c.applicable(c._known(d.plots(spark, sf_dir)), c.enforced(read_packs(spark)))
    return x.select("model_id", "rule_id", F.expr(f"inline({c.rule_remedies()})")).drop("area_lost_sqm")


@query("B06_footprint_dependent", with_model("""
SELECT model_id, count(*) FILTER (WHERE regexp_matches(lower(rule_id), 'containment|coverage|far|setback')) AS n_dependent, count(*) AS n_rules FROM ap GROUP BY 1"""))
def b06(spark, sf_dir):
    x = c.applicable(c._known(d.plots(spark, sf_dir)), c.enforced(read_packs(spark)))
    return x.groupBy("model_id").agg(F.count_if(c.is_footprint_dependent(F.col("rule_id"))).alias("n_dependent"), F.count("*").alias("n_rules"))


@query("B07_soften", with_model(f"""
SELECT a.model_id, a.rule_id, CASE WHEN u.any_upper AND regexp_matches(a.rule_id, 'containment|coverage|far|setback') THEN 'ambiguity' ELSE 'violation' END AS status,
  CASE WHEN u.any_upper AND regexp_matches(a.rule_id, 'containment|coverage|far|setback') THEN 'extraction' END AS ambiguity_class,
  a.title || CASE WHEN u.any_upper AND regexp_matches(a.rule_id, 'containment|coverage|far|setback') THEN ' - confirm against the drawing' ELSE '' END AS title
FROM ap a LEFT JOIN ff u USING (model_id)"""))
def b07(spark, sf_dir):
    x = c.applicable(c._known(d.plots(spark, sf_dir)), c.enforced(read_packs(spark)))
    f = x.selectExpr("model_id", "rule_id", "'violation' as status", "cast(null as string) as ambiguity_class", "r.title as title")
    return c.soften(f, d.floors(spark, sf_dir))


@query("C01_applicable", _AP)
def c01(spark, sf_dir):
    return c.applicable(c._known(d.plots(spark, sf_dir)), c.enforced(read_packs(spark))).select("model_id", "rule_id")


@query("C02_edge_by_role", with_model("SELECT model_id, w AS front_length, CASE WHEN model_id % 23 <> 0 THEN CAST(6 + seed % 10 AS DOUBLE) END AS front_road, l AS rear_y FROM plots"))
def c02(spark, sf_dir):
    e = c.edge_by_role(d.edges(d.plots(spark, sf_dir)))
    return e.selectExpr("model_id", "edge_front.line[1].x - edge_front.line[0].x as front_length", "edge_front.road_width_m as front_road", "edge_rear.line[0].y as rear_y")


@query("C03_ground_basement", with_model("""
SELECT model_id, 'ground' AS pick, floor_pos, area FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY floor_pos) k FROM floors WHERE level = 0) WHERE k = 1
UNION ALL SELECT model_id, 'basement', floor_pos, area FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY floor_pos) k FROM floors WHERE level < 0) WHERE k = 1"""))
def c03(spark, sf_dir):
    fl = n.measure_floors(d.floors(spark, sf_dir))
    a = c.ground(fl).selectExpr("model_id", "'ground' as pick", "ground.floor_pos", "ground.area")
    return a.unionByName(c.basement(fl).selectExpr("model_id", "'basement' as pick", "basement.floor_pos", "basement.area"))


@query("E19_unenforced", with_model("SELECT authority, rule_id, kind, count(*) AS n_plots FROM plots p JOIN rules r USING (rule_pack) WHERE NOT r.enforced GROUP BY ALL"))
def e19(spark, sf_dir):
    r = c.unenforced(read_packs(spark)).select("rule_pack", "rule_id", "kind")
    return d.plots(spark, sf_dir).groupBy("rule_pack", "authority").agg(F.count("*").alias("n_plots")).join(r, "rule_pack").select("authority", "rule_id", "kind", "n_plots")


def _fx(select, rule, sev, title, status, obs, req, comp, amb, rem, geom, src):
    return with_model(f"""SELECT model_id, 0::BIGINT AS finding_seq, 'FIXTURE.{rule}' AS rule_id, {status} AS status, '{sev}' AS severity, '{title}' AS title,
  {obs}::DOUBLE AS observed_num, {req}::DOUBLE AS required_num, {comp} AS compoundable, {amb} AS ambiguity_class, {rem} AS n_remedies, {geom} AS has_geometry FROM {src}""")


@query("E20_fx_coverage", _fx("", "ground_coverage", "major", "Ground coverage (placeholder limit)", "CASE WHEN pct >= 60.005::DOUBLE THEN 'violation' ELSE 'pass' END", "pct", "60", "true",
       "NULL::VARCHAR", "CASE WHEN pct >= 60.005::DOUBLE THEN 1 ELSE 0 END", "true",
       "(SELECT model_id, sum(area) / any_value(plot_area_sqm) * 100::DOUBLE AS pct FROM floors JOIN plots USING (model_id) WHERE level = 0 AND plot_area_sqm <> 0 GROUP BY 1)"))
def e20(spark, sf_dir):
    t = tables(spark, sf_dir)
    return flat(sec.fx_coverage(t["plots"], t["floors"]))


@query("E21_fx_rwh", _fx("", "rainwater_harvesting", "minor", "Rainwater harvesting on larger plots", "CASE WHEN has_rwh THEN 'pass' ELSE 'violation' END", "CAST(has_rwh AS INT)", "1", "true", "NULL::VARCHAR", "0", "false", "plots WHERE plot_area_sqm > 100"))
def e21(spark, sf_dir):
    return flat(sec.fx_rwh(d.plots(spark, sf_dir)))


@query("E22_fx_trees", _fx("", "tree_planting", "minor", "Trees per plot area (advice)", "'advisory'", "tree_count", "greatest(1, floor(plot_area_sqm / 80.0))", "false", "NULL::VARCHAR", "0", "false", "plots WHERE plot_area_sqm > 100"))
def e22(spark, sf_dir):
    return flat(sec.fx_trees(d.plots(spark, sf_dir)))


@query("E23_fx_height_unknown", _fx("", "total_height", "major", "Total height cannot be established", "'unknown'", "NULL", "NULL", "false", "NULL::VARCHAR", "0", "false", "plots WHERE model_id IN (SELECT model_id FROM floors WHERE height_m IS NULL)"))
def e23(spark, sf_dir):
    t = tables(spark, sf_dir)
    return flat(sec.fx_height_unknown(t["plots"], t["floors"]))


@query("E24_fx_containment", with_model("""
SELECT model_id, 0::BIGINT AS finding_seq, 'FIXTURE.zoned_area_containment' AS rule_id, CASE WHEN NOT has_zone THEN 'unknown' WHEN n_out > 0 THEN 'violation' ELSE 'pass' END AS status, 'blocking' AS severity,
  'Zoned-area containment' AS title, NULL::DOUBLE AS observed_num, NULL::DOUBLE AS required_num, false AS compoundable, NULL::VARCHAR AS ambiguity_class, CASE WHEN has_zone AND n_out > 0 THEN 1 ELSE 0 END AS n_remedies, true AS has_geometry
FROM (SELECT p.model_id, has_zone, (SELECT count(*) FROM floors f WHERE f.model_id = p.model_id AND NOT (f.x0 >= 1.5 AND f.y0 >= 3 AND f.x1 <= p.w - 1.5 AND f.y1 <= p.l - 3)) AS n_out FROM plots p)
UNION ALL SELECT model_id, 0, 'FIXTURE.stilt_far_treatment', 'ambiguity', 'major', 'Stilt storey in the floor area ratio is contested', NULL, NULL, false, 'definitional', 0, true FROM facts WHERE has_stilt"""))
def e24(spark, sf_dir):
    t = tables(spark, sf_dir)
    return flat(sec.fx_containment(t["plots"], t["floors"]))


@query("E25_estimate_envelope", with_model("""
, a AS (SELECT model_id, sum(height_m) FILTER (WHERE NOT is_stilt) AS height, arg_min(x1 - x0, level * 100 + floor_pos) AS gw, arg_min(y1 - y0, level * 100 + floor_pos) AS gd, max(x1 - x0) AS mw, max(y1 - y0) AS md FROM floors GROUP BY 1),
x AS (SELECT p.model_id, a.*EXCLUDE (model_id), w + CASE WHEN p.model_id % 5 = 0 THEN 1 ELSE 0 END AS pw, l + CASE WHEN p.model_id % 5 = 0 THEN 1 ELSE 0 END AS pl,
  CASE WHEN p.model_id % 13 <> 0 THEN CAST(4 + seed % 12 AS DOUBLE) END AS ew, rule_pack LIKE 'puda%' AS has_formula FROM plots p LEFT JOIN a USING (model_id)),
y AS (SELECT *, abs(ew - gw) <= abs(ew - gd) AS byw FROM x),
z AS (SELECT *, abs(pw - CASE WHEN byw THEN gw ELSE gd END) <= abs(pl - CASE WHEN byw THEN gw ELSE gd END) AS fw, CASE WHEN has_formula AND height IS NOT NULL THEN greatest(height * 0.25::DOUBLE, 2.0::DOUBLE) END AS fr, CASE WHEN has_formula AND height IS NOT NULL THEN greatest(height * 0.2::DOUBLE, 1.5::DOUBLE) END AS sd FROM y),
e AS (SELECT *, CASE WHEN fw THEN pw ELSE pl END - 2 * sd AS ef, CASE WHEN fw THEN pl ELSE pw END - 2 * fr AS ed FROM z),
o AS (SELECT *, CASE WHEN height IS NULL THEN 'no_height' WHEN gw IS NULL THEN 'no_footprint' WHEN ew IS NULL THEN 'no_elevation_width' WHEN NOT has_formula THEN 'no_setback_formula' WHEN ef <= 0 OR ed <= 0 THEN 'no_area_left' END AS reason FROM e)
SELECT model_id, reason IS NULL AS available, reason, CASE WHEN reason IS NULL THEN height END AS height_m_used, CASE WHEN reason IS NULL THEN fr END AS front_rear_setback_m, CASE WHEN reason IS NULL THEN sd END AS side_setback_m,
  CASE WHEN reason IS NULL THEN CASE WHEN fw THEN 'width' ELSE 'length' END END AS frontage_source, CASE WHEN reason IS NULL THEN ef END AS env_frontage_m, CASE WHEN reason IS NULL THEN ed END AS env_depth_m, CASE WHEN reason IS NULL THEN ef * ed END AS env_area_sqm,
  CASE WHEN reason IS NULL THEN CASE WHEN CASE WHEN byw THEN mw ELSE md END <= ef + 1e-6::DOUBLE AND CASE WHEN byw THEN md ELSE mw END <= ed + 1e-6::DOUBLE THEN 'plausible_fit' ELSE 'likely_exceeds' END END AS fit_status FROM o""".lstrip()))
def e25(spark, sf_dir):
    t = tables(spark, sf_dir)
    p = t["plots"]
    return sec.estimate_envelope(p, t["floors"], read_packs(spark), d.elevation_widths(p), d.entered_plot_sizes(p))


@query("F07_building_height", with_model("SELECT model_id, sum(CASE WHEN NOT is_stilt THEN height_m END) AS height FROM floors GROUP BY 1"))
def f07(spark, sf_dir):
    return d.floors(spark, sf_dir).groupBy("model_id").agg(F.sum(F.expr("case when not is_stilt then height_m end")).alias("height"))


@query("G06_first_room_per_level", with_model("SELECT model_id, level, floor_pos, room_index, use FROM (SELECT *, row_number() OVER (PARTITION BY model_id, level ORDER BY floor_pos, room_index) k FROM rooms WHERE use IN ('bedroom','living','kitchen')) WHERE k = 1"))
def g06(spark, sf_dir):
    x = c.first_room_per_level(d.rooms(spark, sf_dir), uses=("bedroom", "living", "kitchen"))
    return x.select("model_id", "level", "floor_pos", "room_index", "use")


@query("I01_union_checks", with_findings("SELECT rule_id, status, count(*) AS n FROM findings GROUP BY ALL"))
def i01(spark, sf_dir):
    return all_findings(spark, sf_dir, "status").groupBy("rule_id", "status").agg(F.count("*").alias("n"))


@query("J14_slab_cap", with_model("SELECT model_id, least(a, 210.0::DOUBLE) * 0.65::DOUBLE + least(greatest(a - 210.0::DOUBLE, 0.0), 210.0::DOUBLE) * 0.5::DOUBLE + greatest(a - 420.0::DOUBLE, 0.0) * 0.4::DOUBLE AS cap FROM (SELECT model_id, w * l AS a FROM plots)"))
def j14(spark, sf_dir):
    table = "array(named_struct('band_sqm', 210D, 'pct', 65D), named_struct('band_sqm', 210D, 'pct', 50D), named_struct('band_sqm', cast(null as double), 'pct', 40D))"
    return d.plots(spark, sf_dir).selectExpr("model_id", c.slab_cap("w * l", table) + " as cap")


@query("J23_rule_family", with_model("SELECT split_part(rule_id, '.', 2) AS family, count(*) AS n FROM ap GROUP BY 1"))
def j23(spark, sf_dir):
    x = c.applicable(c._known(d.plots(spark, sf_dir)), c.enforced(read_packs(spark)))
    return x.groupBy(c.rule_family(F.col("rule_id")).alias("family")).agg(F.count("*").alias("n"))
