"""Queries for text, unit and colour functions."""

from __future__ import annotations

from parapet.catalog.base import query
from parapet.functions import text as t
from parapet.sources import derived as d

_EV = "SELECT event_id, user_id, user_id % 40 AS ft, event_id % 14 AS inch, event_id % 5 = 4 AS foot_only FROM events"
_TITLES = "(['" + "','".join(d.SHEET_TITLES) + "'])[1 + page_id % 8]"
SHEETS = f"""sheets AS (
  SELECT *, 'first_floor-' || page_id || '.' || kind AS file,
    'S.C.O. 63, Phase-2' || chr(10) || CASE WHEN title IS NULL THEN '' ELSE 'TITLE :- ' || title || chr(10) END || 'DATE :-' || chr(10) || 'DRAWN BY :-  AB ' || chr(10)
    || CASE WHEN page_id % 11 <> 0 THEN 'Plot No.' || page_id || ', ' ELSE '' END || CASE WHEN page_id % 7 <> 0 THEN 'phase -' || (page_id % 9) || ',' ELSE '' END || chr(10)
    || CASE WHEN page_id % 13 = 0 AND page_id % 2 = 0 THEN 'REAR ELEVATION' ELSE 'NOTES' END AS text
  FROM (SELECT page_id, page_id // 5 AS case_id, CAST(page_id % 5 AS INT) AS upload_pos, CASE WHEN page_id % 13 <> 0 THEN {_TITLES} END AS title,
    CASE WHEN page_id % 3 = 2 THEN 'dxf' ELSE 'pdf' END AS kind, CASE WHEN page_id % 6 = 5 THEN 'ELEVATION-FRONT' END AS layout FROM pages))"""
TITLE_ROLE = "CASE title WHEN 'GROUND FLOOR PLAN' THEN 'ground' WHEN 'FIRST FLOOR PLAN' THEN 'first' WHEN 'FRONT ELEVATION' THEN 'elevation_front' WHEN 'SITE PLAN' THEN 'site' WHEN 'BASEMENT PLAN' THEN 'basement' WHEN 'STILT FLOOR' THEN 'stilt' WHEN 'SECTION A-A' THEN 'section' END"
ROLE = f"CASE WHEN kind = 'pdf' THEN coalesce({TITLE_ROLE}, CASE WHEN page_id % 13 = 0 AND page_id % 2 = 0 THEN 'elevation_rear' END) WHEN layout IS NOT NULL THEN 'elevation' ELSE 'first' END"
# A drawing whose own tab reads "ELEVATION FRONT" matches the general keyword only.


def _spans(spark, sf_dir):
    return d.text_spans(spark, sf_dir)


@query("J02_feet_inches_all", f"SELECT event_id, CASE WHEN NOT foot_only AND inch < 12 THEN (ft + inch / 12::DOUBLE) * 0.3048::DOUBLE END AS first_m, CASE WHEN foot_only OR inch >= 12 THEN 0 ELSE 1 END + 1 AS n FROM ({_EV})")
def j02(spark, sf_dir):
    x = _spans(spark, sf_dir).selectExpr("event_id", "concat(text, ' x 10', char(39), '-6', char(34)) as text")
    return x.selectExpr("event_id", t.feet_inches_all("text") + " as m").selectExpr("event_id", "case when size(m) > 1 then m[0] end as first_m", "size(m) as n")


@query("J03_dim_inches", f"SELECT event_id, CAST(CASE WHEN foot_only THEN ft * 12 ELSE ft * 12 + inch END AS DOUBLE) AS inches FROM ({_EV})")
def j03(spark, sf_dir):
    return _spans(spark, sf_dir).selectExpr("event_id", t.dim_inches("text") + " as inches")


@query("J04_feet_only_all", f"SELECT event_id, CASE WHEN foot_only THEN ft * 0.3048::DOUBLE END AS first_m, CASE WHEN foot_only THEN 1 ELSE 0 END AS n FROM ({_EV})")
def j04(spark, sf_dir):
    return _spans(spark, sf_dir).selectExpr("event_id", t.feet_only_all("text") + " as m").selectExpr("event_id", "try_element_at(m, 1) as first_m", "size(m) as n")


@query("J05_unit_to_metres", "SELECT o_orderkey, CASE o_orderkey % 12 WHEN 1 THEN 0.0254 WHEN 2 THEN 0.3048 WHEN 4 THEN 0.001 WHEN 5 THEN 0.01 WHEN 10 THEN 0.9144 ELSE 1.0 END::DOUBLE AS factor, o_orderkey % 12 IN (1,2,4,5,6,10) AS known, CASE o_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.3048 ELSE 0.9144 END::DOUBLE AS ui_factor FROM orders")
def j05(spark, sf_dir):
    o = d.load(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 12 as code", "element_at(array('m', 'ft', 'yd'), cast(o_custkey % 3 + 1 as int)) as unit")
    return o.selectExpr("o_orderkey", t.cad_unit_factor("code") + " as factor", t.cad_unit_known("code") + " as known", t.ui_unit_factor("unit") + " as ui_factor")


_LAYERS = ("WALL", "wall_ext", "A-WALL-EXTR", "BDRM-1", "MBR", "TOIL", "DIMENSIONS", "Hatch", "STAIR_UP", "Store")
_LAYER_SQL = "(['wall','wall','wall','room_bedroom','room_bedroom','room_bath','annotation','unknown','room_stair','room_store'])"


@query("J06_layer_category", f"SELECT l_orderkey, l_linenumber, {_LAYER_SQL}[1 + l_partkey % 10] AS category, count(*) AS n FROM lineitem GROUP BY ALL")
def j06(spark, sf_dir):
    arr = "array(" + ", ".join(f"'{x}'" for x in _LAYERS) + ")"
    x = d.load(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{arr}[cast(l_partkey % 10 as int)] as layer")
    return x.selectExpr("l_orderkey", "l_linenumber", t.layer_category("layer") + " as category").groupBy("l_orderkey", "l_linenumber", "category").count().withColumnRenamed("count", "n")


_ROOMS = ("MASTER BED ROOM", "BED ROOM", "TOILET", "PARKING HALL", "KITCHEN", "DINING", "notes", "BACKYARD", "STAIR CASE", "LIFT")
_ROOM_USE = "(['bedroom','bedroom','wc',NULL,'kitchen','other',NULL,NULL,'stair','other'])"
_ROOM_W = "([4.0,3.5,2.0,NULL,3.0,3.5,NULL,NULL,2.5,1.5]::DOUBLE[])"


@query("J07_room_use", f"SELECT event_id, {_ROOM_USE}[1 + user_id % 10] AS use, {_ROOM_W}[1 + user_id % 10] AS w FROM events")
def j07(spark, sf_dir):
    arr = "array(" + ", ".join(f"'{x}'" for x in _ROOMS) + ")"
    x = d.load(spark, sf_dir, "events").selectExpr("event_id", f"{arr}[cast(user_id % 10 as int)] as label")
    return x.selectExpr("event_id", t.room_use("label") + " as u").selectExpr("event_id", "u.use as use", "u.w as w")


@query("J08_sheet_role", f"WITH {SHEETS} SELECT page_id, {TITLE_ROLE} AS role FROM sheets")
def j08(spark, sf_dir):
    return d.sheets(spark, sf_dir).selectExpr("page_id", t.sheet_role("title") + " as role")


def guessed(spark, sf_dir):
    s = d.sheets(spark, sf_dir)
    return s.selectExpr("*", t.guess_role("kind", t.title_field("text", "sheet_title"), "text", "file", "layout") + " as g")


@query("J09_guess_role", f"WITH {SHEETS} SELECT page_id, {ROLE} AS role, CASE WHEN kind = 'pdf' THEN CASE WHEN {TITLE_ROLE} IS NOT NULL THEN 'title_block' WHEN page_id % 13 = 0 AND page_id % 2 = 0 THEN 'page_text' ELSE 'title_block' END WHEN layout IS NOT NULL THEN 'layout_name' ELSE 'filename' END AS source FROM sheets")
def j09(spark, sf_dir):
    return guessed(spark, sf_dir).selectExpr("page_id", "g.role as role", "g.source as source")


@query("J10_title_block", f"WITH {SHEETS} SELECT page_id, title AS sheet_title, NULL::VARCHAR AS drawn_on, 'AB' AS drawn_by FROM sheets")
def j10(spark, sf_dir):
    return d.sheets(spark, sf_dir).selectExpr("page_id", t.title_field("text", "sheet_title") + " as sheet_title", t.title_field("text", "date") + " as drawn_on", t.title_field("text", "drawn_by") + " as drawn_by")


@query("J11_plot_and_sector", f"WITH {SHEETS} SELECT page_id, CASE WHEN page_id % 11 <> 0 THEN page_id::VARCHAR END AS plot_no, CASE WHEN page_id % 11 <> 0 AND page_id % 7 <> 0 THEN 'Phase-' || (page_id % 9) END AS sector FROM sheets")
def j11(spark, sf_dir):
    return d.sheets(spark, sf_dir).selectExpr("page_id", t.plot_no("text") + " as plot_no", t.sector("text") + " as sector")


@query("J12_role_confirmed", f"WITH {SHEETS} SELECT page_id, coalesce(title LIKE '%ELEVATION%', false) OR (page_id % 13 = 0 AND page_id % 2 = 0) AS confirmed FROM sheets")
def j12(spark, sf_dir):
    return d.sheets(spark, sf_dir).selectExpr("page_id", t.role_confirmed("title", "text", "'elevation'") + " as confirmed")


@query("J13_decode_ref", f"WITH {SHEETS} SELECT page_id, file, layout FROM sheets")
def j13(spark, sf_dir):
    x = d.sheets(spark, sf_dir).selectExpr("page_id", t.encode_ref("file", "layout") + " as ref")
    return x.selectExpr("page_id", t.decode_ref("ref") + " as r").selectExpr("page_id", "r.file as file", "r.layout as layout")


@query("J15_has_numeric", r"SELECT doc_id, regexp_matches(text || CASE WHEN doc_id % 4 = 0 THEN ' 65 per cent' ELSE '' END, '(?i)[0-9]+(\.[0-9]+)?\s*(%|per\s?cent|meter|metre|sq\.?\s?m|sqm|sq\.?\s?yd|storey|storeys)') AS hit FROM documents")
def j15(spark, sf_dir):
    x = d.load(spark, sf_dir, "documents").selectExpr("doc_id", "concat(text, case when doc_id % 4 = 0 then ' 65 per cent' else '' end) as text")
    return x.selectExpr("doc_id", t.has_numeric("text") + " as hit")


@query("J18_norm_key", "SELECT p_partkey, regexp_replace(upper(p_name || ' ' || p_brand), '[^A-Z0-9]', '', 'g') AS k FROM part")
def j18(spark, sf_dir):
    return d.load(spark, sf_dir, "part").selectExpr("p_partkey", t.norm_key("concat(p_name, ' ', p_brand)") + " as k")


@query("J19_ocr_required", "SELECT o_orderkey, length(trim(repeat(' ab', CAST(o_orderkey % 20 AS INT)))) < 40 AS ocr FROM orders")
def j19(spark, sf_dir):
    x = d.load(spark, sf_dir, "orders").selectExpr("o_orderkey", "repeat(' ab', cast(o_orderkey % 20 as int)) as text")
    return x.selectExpr("o_orderkey", t.ocr_required("text") + " as ocr")


_RGB = "SELECT event_id, (user_id * 7919 + event_id * 104729) % 16777216 AS a, (user_id * 15485863 + event_id) % 16777216 AS b FROM events"
_CH = "[a // 65536, a // 256 % 256, a % 256]"


@query("J20_colour", f"SELECT event_id, a // 65536 AS r, greatest(a // 65536, a // 256 % 256, a % 256) - least(a // 65536, a // 256 % 256, a % 256) < 24 AS grey, greatest(abs(a // 65536 - b // 65536), abs(a // 256 % 256 - b // 256 % 256), abs(a % 256 - b % 256)) AS dist FROM ({_RGB})")
def j20(spark, sf_dir):
    x = d.load(spark, sf_dir, "events").selectExpr("event_id", "cast((user_id * 7919 + event_id * 104729) % 16777216 as int) as a", "cast((user_id * 15485863 + event_id) % 16777216 as int) as b")
    return x.selectExpr("event_id", f"cast({t.channel('a', 0)} as bigint) as r", t.achromatic("a") + " as grey", f"cast({t.colour_dist('a', 'b')} as bigint) as dist")


@query("J21_is_vertical", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN coalesce((o_custkey % 3 = 0) AND NOT (o_custkey % 3 = 0 AND o_custkey % 2 = 0), false) ELSE abs((o_custkey % 360) % 180 - 90) <= 5 END AS vertical FROM orders")
def j21(spark, sf_dir):
    x = d.load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "case when o_orderkey % 4 <> 0 then cast(o_custkey % 360 as double) end as angle",
        "cast(o_custkey % 3 as double) as dx", "case when o_custkey % 2 = 0 then 0D else 1D end as dy",
    )
    return x.selectExpr("o_orderkey", t.is_vertical("angle", "dx", "dy") + " as vertical")


@query("J25_role_label", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Ground floor plan' WHEN 1 THEN 'Front elevation (3)' WHEN 2 THEN 'Elevation (' || (o_custkey % 90) || ')' WHEN 3 THEN 'Roof Garden Plan' ELSE 'Combined' END AS label FROM orders")
def j25(spark, sf_dir):
    x = d.load(spark, sf_dir, "orders").selectExpr("o_orderkey", "case o_orderkey % 5 when 0 then 'ground' when 1 then 'elevation_front_3' when 2 then concat('elevation_', o_custkey % 90) when 3 then 'roof_garden_plan' else 'combined' end as role")
    return x.selectExpr("o_orderkey", t.role_label("role") + " as label")
