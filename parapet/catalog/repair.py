"""Queries for the repair search."""

from __future__ import annotations

from pyspark.sql import functions as F

from parapet.catalog.base import findings_sql, query, with_findings, with_model
from parapet.catalog.checks import all_findings
from parapet.functions import geometry as g
from parapet.operators import checks as c
from parapet.operators import redo
from parapet.operators import repair as r
from parapet.plans import repair as plan
from parapet.session import cut_lineage, spread
from parapet.sources import derived as d
from parapet.sources.packs import read_packs

_T = """t AS (SELECT model_id, rule_id, arg_max(title, finding_seq) AS title FROM findings WHERE status = 'violation' GROUP BY 1, 2),
t2 AS (SELECT *, lower(rule_id || ' ' || title) AS text FROM t),
nf AS (SELECT model_id, count(*) AS n, min(least(x1 - x0, y1 - y0)) FILTER (WHERE level = -1) AS span FROM floors GROUP BY 1)"""
_ROUTE = {k: "regexp_matches(text, '" + "|".join(v) + "')" for k, v in r.ROUTES.items()}
_HITS = "CASE WHEN contains(text, 'front') OR contains(text, 'rear') OR contains(text, 'side_a') OR contains(text, 'side_b') THEN CAST(contains(text, 'front') AS INT) + CAST(contains(text, 'rear') AS INT) + CAST(contains(text, 'side_a') AS INT) + CAST(contains(text, 'side_b') AS INT) ELSE 4 END"


def _tables(spark, sf_dir):
    return d.model_tables(spark, sf_dir)


@query("J24_route_edit", with_findings(f", {_T} SELECT rule_id, " + ", ".join(f"bool_or({e}) AS to_{k}" for k, e in _ROUTE.items()) + ", count(*) AS n FROM t2 GROUP BY 1"))
def j24(spark, sf_dir):
    t = r.targets(all_findings(spark, sf_dir, "title"))
    return t.groupBy("rule_id").agg(*[F.bool_or(f"to_{k}").alias(f"to_{k}") for k in r.ROUTES], F.count("*").alias("n"))


@query("M01_edit_grid", with_findings(f""", {_T}
SELECT rule_id, op, CAST(sum(n) AS BIGINT) AS n_candidates FROM (
  SELECT rule_id, 'shrink_wall' AS op, {_HITS} * nf.n * 30 AS n FROM t2 JOIN nf USING (model_id) WHERE {_ROUTE['wall']}
  UNION ALL SELECT rule_id, 'shrink_wall_all_floors', 120 FROM t2 WHERE {_ROUTE['all_walls']}
  UNION ALL SELECT rule_id, 'trim_projection', 30 FROM t2 JOIN projections USING (model_id) WHERE {_ROUTE['projection']}
  UNION ALL SELECT rule_id, 'reduce_basement_footprint', 1 FROM t2 JOIN nf USING (model_id), range(1, 31) k(k) WHERE {_ROUTE['basement']} AND 2 * (k / 10::DOUBLE) < nf.span
  UNION ALL SELECT rule_id, 'reclassify_room', CASE WHEN use IN ('bedroom','living','store','other') THEN 3 ELSE 4 END FROM t2 JOIN rooms USING (model_id) WHERE {_ROUTE['room']}
  UNION ALL SELECT rule_id, 'shift_stair', 1 FROM t2 JOIN rooms r USING (model_id) JOIN plots p USING (model_id), (VALUES (-0.3::DOUBLE), (-0.1), (0.1), (0.3)) a(dx), (VALUES (-0.3::DOUBLE), (-0.1), (0.1), (0.3)) b(dy)
    WHERE {_ROUTE['room']} AND use = 'stair' AND r.x0 + dx >= 0 AND r.y0 + dy >= 0 AND r.x1 + dx <= w AND r.y1 + dy <= l) GROUP BY ALL"""))
def m01(spark, sf_dir):
    x = r.edit_grid(all_findings(spark, sf_dir, "title"), _tables(spark, sf_dir))
    return x.groupBy("rule_id", "op").agg(F.count("*").alias("n_candidates"))


_B = "CASE role WHEN 'side_a' THEN x0 + {0} ELSE x0 END AS xmin, CASE role WHEN 'front' THEN y0 + {0} ELSE y0 END AS ymin, CASE role WHEN 'side_b' THEN x1 - {0} ELSE x1 END AS xmax, CASE role WHEN 'rear' THEN y1 - {0} ELSE y1 END AS ymax"
_ROLES = "(VALUES ('front'), ('rear'), ('side_a'), ('side_b')) e(role)"


@query("M02_shrink_wall", with_model(f"SELECT * FROM (SELECT model_id, floor_pos, role, {_B.format('5.5')} FROM floors, {_ROLES}) WHERE xmin < xmax AND ymin < ymax"))
def m02(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return r.shrink_wall(t["floors"], t["edges"], t["plots"], "5.5D").select("model_id", "floor_pos", "role", "nb.*")


@query("M03_shrink_all", with_model(f"SELECT model_id, role, sum((xmax - xmin) * (ymax - ymin)) AS area_after FROM (SELECT model_id, floor_pos, role, {_B.format('5.5')} FROM floors, {_ROLES}) GROUP BY 1, 2 HAVING bool_and(xmin < xmax AND ymin < ymax)"))
def m03(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return r.shrink_all(t["floors"], t["edges"], t["plots"], "5.5D")


@query("M04_trim_projection", with_model("SELECT model_id, pos, CASE WHEN d > 1 AND pw > 1 THEN (d - 1) * (pw - 1) END AS area_after FROM projections"))
def m04(spark, sf_dir):
    x = r.trim_projection(d.projections(spark, sf_dir), "0.5D")
    return x.selectExpr("model_id", "cast(pos as bigint) as pos", g.area("trimmed") + " as area_after")


@query("M05_reclassify_room", with_model("SELECT model_id, floor_pos, room_index, new_use FROM rooms, (VALUES ('bedroom'), ('living'), ('store'), ('other')) u(new_use) WHERE new_use <> use"))
def m05(spark, sf_dir):
    return r.reclassify(d.rooms(spark, sf_dir)).select("model_id", "floor_pos", "room_index", "new_use")


@query("M06_shift_stair", with_model("SELECT model_id, floor_pos, room_index, dx, dy FROM rooms r JOIN plots p USING (model_id), (VALUES (-0.3::DOUBLE), (-0.1), (0.1), (0.3)) a(dx), (VALUES (-0.3::DOUBLE), (-0.1), (0.1), (0.3)) b(dy) WHERE use = 'stair' AND r.x0 + dx >= 0 AND r.y0 + dy >= 0 AND r.x1 + dx <= w AND r.y1 + dy <= l"))
def m06(spark, sf_dir):
    return r.shift_stair(d.rooms(spark, sf_dir), d.plots(spark, sf_dir)).select("model_id", "floor_pos", "room_index", "dx", "dy")


@query("M07_reduce_basement", with_model("SELECT model_id, (x1 - x0 - 6) * (y1 - y0 - 6) AS area_after FROM floors WHERE level = -1 AND x1 - x0 > 6 AND y1 - y0 > 6"))
def m07(spark, sf_dir):
    return r.reduce_basement(d.floors(spark, sf_dir), "3D").selectExpr("model_id", g.area("reduced") + " as area_after")


def _projection_case(spark, sf_dir):
    """Violations of the depth rules, the base findings of the kinds that a trim can change, and the tables."""
    t, rules = _tables(spark, sf_dir), read_packs(spark)
    kinds = ("projection_max", "projection_width_fraction")
    facts = c.build_facts(t, kinds=kinds)
    base = c.model_level(facts, rules, kinds).unionByName(c.projection_level(facts, rules, kinds))
    base = cut_lineage(base)
    depth = rules.filter("kind = 'projection_max'").select("rule_id").distinct()
    return t, rules, base, base.filter("status = 'violation'").join(depth, "rule_id", "left_semi")


#: the operator's own limit, given here explicitly; the search has none
_H04_CAP = 2000


@query("H04_cap_candidates", f"WITH f AS ({findings_sql(['projection_max'])}), p AS (SELECT l_orderkey AS model_id, count(*) AS n FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1) SELECT model_id, rule_id, least(30 * any_value(p.n), {_H04_CAP}) AS n_kept FROM f JOIN p USING (model_id) WHERE status = 'violation' GROUP BY 1, 2")
def h04(spark, sf_dir):
    t = _tables(spark, sf_dir)
    v = c.check(c.build_facts(t, kinds=["projection_max"]), read_packs(spark), "projection_max")
    x = r.cap_candidates(r.edit_grid(v, t), _H04_CAP)
    return x.groupBy("model_id", "rule_id").agg(F.count("*").alias("n_kept"))


def _all_kinds(spark, sf_dir):
    """Tables, rules, all base findings and the violations among them, of every rule kind."""
    base = cut_lineage(all_findings(spark, sf_dir))
    return _tables(spark, sf_dir), read_packs(spark), base, base.filter("status = 'violation'")


# No SQL twin for M08, M16 and the search over all rule kinds, which re-evaluates millions of edits:
# tests/test_redo.py holds them against the whole rule set run on the edited tables.
@query("M08_evaluate_candidates")
def m08(spark, sf_dir):
    # the depth rules: every step of every projection, also those that the search can rule out unseen
    t, rules, base, v = _projection_case(spark, sf_dir)
    return plan.reevaluated(t, base, v, rules).groupBy("op", "rule_id", "status").agg(F.count("*").alias("n"))


@query("M09_accept_all_kinds")
def m09_all(spark, sf_dir):
    t, rules, base, v = _all_kinds(spark, sf_dir)
    x = plan.search(t, base, v, rules)
    return x.select("model_id", "rule_id", *redo.EDIT, "n_cleared", "area_lost_sqm")


_TRIM = """, pv AS (SELECT DISTINCT f.model_id, f.rule_id, r.max_m FROM findings f JOIN rules r USING (rule_id) WHERE r.kind = 'projection_max' AND f.status = 'violation'),
cand AS (SELECT pv.*, p.pos, p.d, p.pw, CAST(k AS INT) AS k, k / 10::DOUBLE AS dm FROM pv JOIN projections p USING (model_id), range(1, 31) t(k)),
after_ AS (SELECT c.*, q.pos AS qpos, CASE WHEN q.pos <> c.pos THEN q.d WHEN 2 + dm < (2 + q.pw) - dm AND 0 + dm < q.d - dm THEN (q.d - dm) - (0 + dm) END AS qd, CASE WHEN q.pos <> c.pos THEN q.pw WHEN 2 + dm < (2 + q.pw) - dm AND 0 + dm < q.d - dm THEN (2 + q.pw - dm) - (2 + dm) END AS qw
  FROM cand c JOIN projections q ON q.model_id = c.model_id),
viol AS (SELECT a.model_id, a.rule_id, a.pos, a.k, bool_or(coalesce(least(qd, qw) > a.max_m + 1e-9::DOUBLE, false)) AS still FROM after_ a GROUP BY 1, 2, 3, 4)"""


@query("M09_accept", with_findings(_TRIM + " SELECT model_id, rule_id, pos, k / 10::DOUBLE AS delta_m FROM viol WHERE NOT still"))
def m09(spark, sf_dir):
    # Cutting a projection back can only shrink it, so no other rule regresses and the SQL twin needs
    # the projection rules alone.
    t, rules, base, v = _projection_case(spark, sf_dir)
    x = plan.search(t, base, v, rules)
    return x.selectExpr("model_id", "rule_id", "cast(pos as bigint) as pos", "delta_m")


@query("H03_top_candidates", with_findings(_TRIM + " SELECT * FROM (SELECT model_id, rule_id, pos, k / 10::DOUBLE AS delta_m, CAST(row_number() OVER (PARTITION BY model_id, rule_id ORDER BY pos, k) AS INT) AS rank FROM viol WHERE NOT still) WHERE rank <= 3"))
def h03(spark, sf_dir):
    t, rules, base, v = _projection_case(spark, sf_dir)
    x = r.top_candidates(plan.search(t, base, v, rules))
    return x.selectExpr("model_id", "rule_id", "cast(pos as bigint) as pos", "delta_m", "rank")


@query("M16_solve")
def m16(spark, sf_dir):
    t, rules, base, v = _projection_case(spark, sf_dir)
    return plan.solve(t, base, v, rules)


def _projection_findings(spark, sf_dir):
    return c.check(c.build_facts(_tables(spark, sf_dir), kinds=["projection_max"]), read_packs(spark), "projection_max")


_WIDE = "(SELECT DISTINCT model_id, rule_id FROM f WHERE status = 'violation')"


@query("C16_no_regress", "WITH f AS (" + findings_sql(["projection_max", "courtyard_min_area"]) + "), b AS (SELECT DISTINCT model_id FROM f WHERE status = 'violation' AND rule_id LIKE '%courtyard%'), n AS (SELECT DISTINCT model_id FROM f WHERE status = 'violation' AND rule_id LIKE '%projection%') SELECT o_orderkey AS model_id, o_orderkey::VARCHAR AS cand_seq FROM orders WHERE o_orderkey NOT IN (SELECT model_id FROM n)")
def c16(spark, sf_dir):
    # Candidates whose findings are the projection rules, against a base that violated courtyards only.
    facts, rules = c.build_facts(_tables(spark, sf_dir), kinds=["projection_max", "courtyard_min_area"]), read_packs(spark)
    base = c.check(facts, rules, "courtyard_min_area")
    new = c.check(facts, rules, "projection_max").withColumn("cand_seq", F.col("model_id").cast("string"))
    cand = d.plots(spark, sf_dir).selectExpr("model_id", "cast(model_id as string) as cand_seq")
    return r.no_regress(new, base, cand)


@query("I02_rule_diff", "WITH f AS (" + findings_sql(["projection_max", "courtyard_min_area"]) + "), v AS (SELECT DISTINCT model_id, rule_id FROM f WHERE status = 'violation') SELECT model_id, coalesce(string_agg(rule_id, '|' ORDER BY rule_id) FILTER (WHERE rule_id LIKE '%courtyard%'), '') AS cleared, coalesce(string_agg(rule_id, '|' ORDER BY rule_id) FILTER (WHERE rule_id LIKE '%projection%'), '') AS regressed FROM v GROUP BY 1")
def i02(spark, sf_dir):
    facts, rules = c.build_facts(_tables(spark, sf_dir), kinds=["projection_max", "courtyard_min_area"]), read_packs(spark)
    base = r._violated(c.check(facts, rules, "courtyard_min_area"), ["model_id"])
    new = r._violated(c.check(facts, rules, "projection_max"), ["model_id"])
    return r.rule_diff(base, new).selectExpr("model_id", "array_join(cleared, '|') as cleared", "array_join(regressed, '|') as regressed")


@query("M10_area_lost", with_model(f"SELECT model_id, role || ':' || floor_pos AS cand_seq, area - (xmax - xmin) * (ymax - ymin) AS area_lost_sqm FROM (SELECT model_id, floor_pos, area, role, {_B.format('0.5')} FROM floors, {_ROLES})"))
def m10(spark, sf_dir):
    t = _tables(spark, sf_dir)
    e = r.shrink_wall(t["floors"], t["edges"], t["plots"], "0.5D")
    return e.selectExpr("model_id", "concat(role, ':', floor_pos) as cand_seq", r.area_lost_on_floor("footprint", "nb") + " as area_lost_sqm")


@query("M11_describe_edit", with_model("SELECT model_id, floor_pos, role, 'Move the ' || role || ' wall of floor ' || level || ' in by 0.5 m; 2.00 sqm less.' AS description FROM floors, (VALUES ('front'), ('rear'), ('side_a'), ('side_b')) e(role)"))
def m11(spark, sf_dir):
    t = _tables(spark, sf_dir)
    e = r.shrink_wall(t["floors"], t["edges"], t["plots"], "0.5D")
    e = e.selectExpr("model_id", "floor_pos", "level", "role", "role as edge", "'shrink_wall' as op", "0.5D as delta_m", "2D as area_lost_sqm", "0 as pos", "0 as room_index", "'' as new_use", "0D as dx", "0D as dy")
    return e.selectExpr("model_id", "floor_pos", "role", r.describe_edit() + " as description")


def _far(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return t, c.check(c.build_facts(t, kinds=["far_band"]), read_packs(spark), "far_band").filter("status = 'violation'")


@query("M12_remedy_far", "WITH f AS (" + findings_sql(["far_band"]) + ") SELECT f.model_id, f.rule_id, (observed_num - required_num) * (CAST(8 + o_orderkey % 13 AS DOUBLE) * CAST(15 + o_custkey % 17 AS DOUBLE)) AS excess_sqm FROM f JOIN orders ON o_orderkey = model_id WHERE status = 'violation'")
def m12(spark, sf_dir):
    t, v = _far(spark, sf_dir)
    return r.remedy_far(v, t["plots"]).select("model_id", "rule_id", "excess_sqm")


@query("M13_remedy_compound", with_findings("SELECT f.model_id, f.finding_seq, 'May be regularised for a fee under ' || r.doc || ' clause ' || r.clause || '; the fee is not on file.' AS description FROM findings f JOIN rules r USING (rule_id) WHERE f.status = 'violation' AND f.compoundable"))
def m13(spark, sf_dir):
    return r.remedy_compound(all_findings(spark, sf_dir, "compoundable").filter("status = 'violation'")).select("model_id", "finding_seq", "description")


@query("M14_remedy_noc", "SELECT o_orderkey AS model_id FROM orders WHERE o_orderkey % 6 IN (1, 4)")
def m14(spark, sf_dir):
    f = d.load(spark, sf_dir, "orders").selectExpr("o_orderkey as model_id", "'x.rule' as rule_id", "o_orderkey as finding_seq", "case o_orderkey % 6 when 1 then 'Periphery zone' when 4 then 'Highway setback' else 'Coverage' end as title")
    return r.remedy_noc(f).select("model_id")


@query("M15_remedy_zoning", with_findings("SELECT f.model_id, f.finding_seq, CASE WHEN has_zone THEN 'Ask for a revision if the zoned area on file is out of date.' ELSE 'Obtain or trace the zoning plan first.' END AS description FROM findings f JOIN plots USING (model_id) WHERE regexp_matches(lower(rule_id || ' ' || title), 'zon|containment|envelope')"))
def m15(spark, sf_dir):
    return r.remedy_zoning(all_findings(spark, sf_dir, "title"), d.plots(spark, sf_dir)).select("model_id", "finding_seq", "description")
