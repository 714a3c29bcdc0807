"""Queries for ambiguity triggers and dossiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from parapet.catalog.base import findings_sql, query, rules_values, with_findings, with_model
from parapet.catalog.checks import _conflicted, all_findings
from parapet.catalog.report import _CITE
from parapet.operators import ambiguity as a
from parapet.operators import checks as c
from parapet.sources import derived as d
from parapet.sources.packs import read_packs

_L1 = """SELECT model_id, 'missing_input' AS ambiguity_class, 'zoned_area' AS key FROM plots WHERE NOT has_zone
UNION ALL SELECT model_id, 'missing_input', 'plot_area_sqm' FROM plots WHERE plot_area_sqm IS NULL
UNION ALL SELECT model_id, 'missing_input', 'jurisdiction.allotment_date' FROM plots WHERE allotment_date IS NULL"""
_L2 = """SELECT model_id, 'extraction' AS ambiguity_class, 'low_confidence_label:' || level || ':' || room_index AS key FROM rooms WHERE confidence = 'low'
UNION ALL SELECT model_id, 'extraction', 'missing_section_height:' || level FROM floors WHERE height_m IS NULL"""
_L7 = """SELECT model_id, 'definitional' AS ambiguity_class, '[' || string_agg(DISTINCT level, ',' ORDER BY level) || ']:' || count(*) AS key FROM floors WHERE is_stilt GROUP BY 1"""
_CUT = "(VALUES (DATE '1997-06-30', 'charges under rule 16'), (DATE '1999-01-01', 'later notice')) k(cutoff_date, regime)"
_L5 = f"""SELECT model_id, 'vintage' AS ambiguity_class, regime || ':' || CASE WHEN allotment_date < cutoff_date THEN 'before' ELSE 'on-or-after' END AS key FROM plots, {_CUT} WHERE allotment_date IS NOT NULL"""
_HIST = """hist AS (SELECT (SELECT list(rule_id ORDER BY rule_pack DESC, rule_pos) FROM rules)[1 + p_partkey % 50] AS rule_id, p_size % 2 = 0 AS compliant FROM part)"""
_L8 = """SELECT DISTINCT f.model_id, 'practice_divergence' AS ambiguity_class, f.rule_id || ':' || h.n AS key FROM findings f JOIN (SELECT rule_id, count(*) AS n FROM hist WHERE compliant GROUP BY 1) h USING (rule_id)"""


def key_of(triggers, expr):
    return triggers.selectExpr("model_id", "ambiguity_class", f"{expr} as key")


_KEY = {
    "missing_input": "evidence['field']",
    "extraction": "concat_ws(':', evidence['source'], evidence['floor'], evidence['room_index'])",
    "definitional": "concat(evidence['stilt_levels'], ':', evidence['n_stilt'])",
    "vintage": "concat(evidence['regime'], ':', evidence['side'])",
    "practice_divergence": "concat(evidence['rule_id'], ':', evidence['prior_cases'])",
    "instrument_conflict": "evidence['check']",
    "discretionary": "concat(evidence['doc'], ':', evidence['clause'], ':', evidence['matched_phrase'])",
}
_ANY_KEY = "case ambiguity_class " + " ".join(f"when '{k}' then {v}" for k, v in _KEY.items()) + " end"


def cutoffs(spark):
    return spark.range(1).selectExpr(
        "inline(array(named_struct('cutoff_date', date'1997-06-30', 'regime', 'charges under rule 16', 'doc', 'puda_building_rules_1996', 'clause', '4#2'),"
        " named_struct('cutoff_date', date'1999-01-01', 'regime', 'later notice', 'doc', 'puda_building_rules_1996', 'clause', '4#2')))"
    )


def history(spark, sf_dir):
    """Objection records from the part table: a rule by part key, compliant on even sizes."""
    ids = read_packs(spark).agg(F.expr("transform(array_sort(collect_list(struct(case when jurisdiction = 'GMADA' then 0 else 1 end as o, rule_pos, rule_id))), e -> e.rule_id)").alias("ids"))
    p = d.load(spark, sf_dir, "part").select("p_partkey", "p_size").crossJoin(F.broadcast(ids))
    return p.selectExpr("ids[cast(p_partkey % 50 as int)] as rule_id", "p_size % 2 = 0 as was_compliant_on_paper")


@query("L01_missing_input", with_model(_L1))
def l01(spark, sf_dir):
    return key_of(a.missing_input(d.plots(spark, sf_dir)), _KEY["missing_input"])


@query("L02_extraction", with_model(_L2))
def l02(spark, sf_dir):
    return key_of(a.extraction(d.floors(spark, sf_dir), d.rooms(spark, sf_dir)), _KEY["extraction"])


@query("L03_instrument_conflict", with_findings(f"""
, s AS (SELECT model_id, split_part(rule_id, '.', 2) AS family, doc, clause, min(finding_seq) AS seq, coalesce(CAST(arg_max(coalesce(required_num, -1e9), finding_seq) AS VARCHAR), 'x') AS req, arg_max(rule_id, finding_seq) AS rid FROM ({_CITE}) GROUP BY 1, 2, 3, 4)
SELECT model_id, 'instrument_conflict' AS ambiguity_class, family AS key, count(*) AS n_sources, arg_min(rid, seq) AS rule_id FROM s GROUP BY 1, 3 HAVING count(*) >= 2 AND count(DISTINCT req) >= 2""".lstrip()))
def l03(spark, sf_dir):
    # Rule families instead of titles, so that one check spans several clauses; text requirements
    # are left to the unit tests.
    f = all_findings(spark, sf_dir, "required_num").withColumn("family", c.rule_family(F.col("rule_id"))).withColumn("required_txt", F.lit(None).cast("string"))
    x = a.instrument_conflict(f, "family")
    return x.selectExpr("model_id", "ambiguity_class", "evidence['check'] as key", "cast(evidence['n_sources'] as bigint) as n_sources", "rule_id")


@query("L04_transcription_conflict", with_model("SELECT p.model_id, 'extraction' AS ambiguity_class, 'transcription_conflict:' || doc || ':' || clause AS key, rule_id FROM plots p JOIN rules r USING (rule_pack) WHERE r.enforced AND r.rule_pos % 7 = 0 AND p.authority <> 'UNKNOWN'"))
def l04(spark, sf_dir):
    x = a.transcription_conflict(c.conflict_findings(d.plots(spark, sf_dir), _conflicted(spark)))
    return x.selectExpr("model_id", "ambiguity_class", "concat_ws(':', evidence['source'], evidence['doc'], evidence['clause']) as key", "rule_id")


@query("L05_vintage", with_model(_L5))
def l05(spark, sf_dir):
    return key_of(a.vintage(d.plots(spark, sf_dir), cutoffs(spark)), _KEY["vintage"])


@query("J22_vintage_side", with_model("SELECT model_id, CASE WHEN allotment_date < DATE '1997-06-30' THEN 'before' WHEN allotment_date >= DATE '1997-06-30' THEN 'on-or-after' END AS side FROM plots"))
def j22(spark, sf_dir):
    return d.plots(spark, sf_dir).selectExpr("model_id", a.vintage_side("allotment_date", "date'1997-06-30'") + " as side")


_PH = "CASE " + " ".join(f"WHEN contains(lower(text), '{p}') THEN '{p}'" for p in a.DISCRETIONARY_PHRASES) + " END"
_LINES_TXT = "SELECT doc_id, text || CASE WHEN doc_id % 6 = 0 THEN ' may be permitted' ELSE '' END || CASE WHEN doc_id % 9 = 0 THEN ' At The Discretion Of the office' ELSE '' END AS text FROM documents"


def _phrased(spark, sf_dir):
    return d.load(spark, sf_dir, "documents").selectExpr(
        "cast(doc_id as string) as doc_id", "'1' as number",
        "concat(text, case when doc_id % 6 = 0 then ' may be permitted' else '' end, case when doc_id % 9 = 0 then ' At The Discretion Of the office' else '' end) as text",
    )


@query("L06_discretionary", f"SELECT 'discretionary' AS ambiguity_class, doc_id || ':1:' || ph AS key FROM (SELECT doc_id, {_PH} AS ph FROM ({_LINES_TXT})) WHERE ph IS NOT NULL")
def l06(spark, sf_dir):
    return key_of(a.discretionary(_phrased(spark, sf_dir)), _KEY["discretionary"]).drop("model_id")


@query("J16_discretionary_phrase", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_PH} AS phrase FROM ({_LINES_TXT})")
def j16(spark, sf_dir):
    return _phrased(spark, sf_dir).selectExpr("doc_id", a.discretionary_phrase("text") + " as phrase")


@query("L07_definitional_stilt", with_model(_L7))
def l07(spark, sf_dir):
    return key_of(a.definitional_stilt(d.floors(spark, sf_dir), "ratio of covered area to plot area", "puda_building_rules_1996", "4#2"), _KEY["definitional"])


@query("L08_practice_divergence", with_findings(f", {_HIST} {_L8}"))
def l08(spark, sf_dir):
    return key_of(a.practice(all_findings(spark, sf_dir, "status"), history(spark, sf_dir)), _KEY["practice_divergence"])


@query("C09_practice_join", "WITH f AS (" + findings_sql(["setback_formula"]) + f"), {rules_values()}, {_HIST} SELECT f.rule_id, count(DISTINCT f.model_id) AS n_models, any_value(h.n) AS n_cases FROM f JOIN (SELECT rule_id, count(*) AS n FROM hist WHERE compliant GROUP BY 1) h USING (rule_id) GROUP BY 1")
def c09(spark, sf_dir):
    f = c.check(c.build_facts(d.model_tables(spark, sf_dir), kinds=["setback_formula"]), read_packs(spark), "setback_formula")
    x = a.practice(f, history(spark, sf_dir))
    return x.groupBy("rule_id").agg(F.count("*").alias("n_models"), F.expr("max(cast(evidence['prior_cases'] as bigint))").alias("n_cases"))


def everything(spark, sf_dir):
    return a.classify_all(
        d.model_tables(spark, sf_dir, by_model=True), all_findings(spark, sf_dir, "title", "required_num", "required_txt", "ambiguity_class"), cutoffs=cutoffs(spark),
        far_clause=("ratio of covered area to plot area", "puda_building_rules_1996", "4#2"), history=history(spark, sf_dir),
    )


_ALL = f"{_L1} UNION ALL {_L2} UNION ALL {_L5} UNION ALL {_L7} UNION ALL {_L8}"


@query("L09_classify_all", with_findings("") + f", {_HIST} SELECT ambiguity_class, count(*) AS n, count(DISTINCT model_id) AS n_models FROM ({_ALL}) GROUP BY 1")
def l09(spark, sf_dir):
    return everything(spark, sf_dir).groupBy("ambiguity_class").agg(F.count("*").alias("n"), F.countDistinct("model_id").alias("n_models"))


@query("L10_dossiers", with_model(f"""
SELECT model_id, ambiguity_class, CASE ambiguity_class WHEN 'missing_input' THEN 'Missing input: ' || key WHEN 'extraction' THEN CASE WHEN key LIKE 'low%' THEN 'Room use to confirm' ELSE 'Value not read reliably' END
    WHEN 'definitional' THEN 'Stilt storey in the floor area ratio' ELSE 'Regime by allotment date: ' || split_part(key, ':', 1) END AS title,
  CASE ambiguity_class WHEN 'missing_input' THEN 'Report unknown' WHEN 'extraction' THEN CASE WHEN key LIKE 'low%' THEN 'Confirm on screen' ELSE 'Report unknown' END
    WHEN 'definitional' THEN 'Include stilt' ELSE CASE WHEN key LIKE '%:before' THEN 'Pre-cutoff regime' ELSE 'Post-cutoff regime' END END AS safer_reading,
  CASE WHEN key LIKE 'low%' THEN 1 ELSE 2 END AS n_readings, key LIKE 'low%' AS is_confirmation_flag FROM ({_L1} UNION ALL {_L2} UNION ALL {_L5} UNION ALL {_L7})"""))
def l10(spark, sf_dir):
    t = d.model_tables(spark, sf_dir)
    trig = a.missing_input(t["plots"]).unionByName(a.extraction(t["floors"], t["rooms"])).unionByName(a.vintage(t["plots"], cutoffs(spark)))
    trig = trig.unionByName(a.definitional_stilt(t["floors"], None, "puda_building_rules_1996", "4#2"))
    x = a.dossiers(trig, t["plots"], t["floors"])
    return x.selectExpr("model_id", "ambiguity_class", "title", "safer_reading", "size(readings) as n_readings", "is_confirmation_flag")


@query("L11_paragraph", with_model(f"""
SELECT model_id, 'The input ' || key || ' is not on file; every check that needs it stays undecided.' AS paragraph FROM ({_L1})
UNION ALL SELECT model_id, 'The allotment date ' || allotment_date || ' lies ' || CASE WHEN allotment_date < cutoff_date THEN 'before' ELSE 'on-or-after' END || ' the cutoff ' || cutoff_date || ' of puda_building_rules_1996 clause 4#2.' FROM plots, {_CUT} WHERE allotment_date IS NOT NULL"""))
def l11(spark, sf_dir):
    t = d.model_tables(spark, sf_dir)
    trig = a.missing_input(t["plots"]).unionByName(a.vintage(t["plots"], cutoffs(spark)))
    return a.dossiers(trig, t["plots"], t["floors"]).select("model_id", "paragraph")
