"""Fixed Spark schemas of the tables and documents this package reads and writes."""

from __future__ import annotations

PAIRS = "array<array<double>>"

# Enumerations of the building-model and finding contracts.
SOURCES = ("dxf", "vector_pdf", "raster")
AUTHORITIES = ("GMADA", "MC_KHARAR", "MC_ZIRAKPUR", "CHANDIGARH", "UNKNOWN")
EDGE_ROLES = ("front", "rear", "side_a", "side_b", "unknown")
ROOM_USES = ("bedroom", "living", "kitchen", "bath", "wc", "store", "stair", "garage", "other")
CONFIDENCES = ("high", "medium", "low")
STATUSES = ("violation", "ambiguity", "advisory", "pass", "unknown")
SEVERITIES = ("blocking", "major", "minor")
HABITABLE_USES = ("bedroom", "living", "kitchen")
STATUS_RANK = {"violation": 0, "ambiguity": 1, "unknown": 2, "advisory": 3, "pass": 4}
SEVERITY_RANK = {"blocking": 0, "major": 1, "minor": 2}

EDGES = f"array<struct<line:{PAIRS},faces_road:boolean,road_width_m:double,role:string>>"
ROOMS = f"array<struct<polygon:{PAIRS},use:string,floor:int,openings_area_sqm:double,confidence:string>>"
FLOORS = (
    f"array<struct<level:int,is_stilt:boolean,footprint:{PAIRS},height_m:double,rooms:{ROOMS},"
    "footprint_is_upper_bound:boolean>>"
)

MODEL_JSON = (f"""
    model_id bigint, source string,
    jurisdiction struct<authority:string,sector:string,plot_no:string,allotment_date:date,rule_pack:string>,
    plot_polygon {PAIRS}, plot_area_sqm double, zoned_area {PAIRS},
    edges {EDGES},
    floors {FLOORS},
    projections array<struct<type:string,polygon:{PAIRS},floor:int>>,
    courtyards array<{PAIRS}>,
    mumty struct<height_m:double,setback_m:double>,
    parking_bays array<struct<polygon:{PAIRS}>>, boundary_wall_height_m double,
    has_rwh boolean, tree_count int, assumptions array<string>
    """)

RULE_JSON = """struct<id:string,title:string,kind:string,
    source:struct<doc:string,clause:string,version:string,url:string>,
    superseded_source:struct<doc:string,clause:string,version:string>,
    status:string,
    applies_when:struct<authority:string,use:string,plot_area_sqm:struct<min:double,max:double>>,
    severity:string,compoundable:boolean,remedies:array<string>,enforced:boolean,
    table:array<struct<band_sqm:double,pct:double>>,max_far:double,superseded_value:double,
    fraction_of_height:double,min_m:double,max_m:double,fraction:double,min_sqm:double,
    room_uses:array<string>,min_ratio:double,height_threshold_m:double,recede_ratio:double,
    max_pct:double,max_storeys:int>"""

PACK_JSON = (f"pack_id string, title string, jurisdiction string, doc_id string, rules array<{RULE_JSON}>")

REMEDY = "struct<kind:string,description:string,area_lost_sqm:double,verified:boolean>"
CITATION = "struct<doc:string,clause:string,version:string,url:string,status:string>"

CLAUSE = ("clause_id string, doc_id string, number string, heading string, text string, page int, "
    "has_table boolean, table_ref string, ocr boolean, parent string, part string")
MANIFEST_JSON = ("documents array<struct<doc_id:string,title:string,doc_type:string,raw_path:string,sha256:string,"
    "version:string,effective_from:string,effective_to:string,jurisdiction_scope:string>>")
PROPOSED = ("clause_id string, proposed_rule_key string, description string, value double, unit string, "
    "applies_to string, status string, quoted_fragment string")
VERDICT = ("clause_id string, proposed_rule_key string, verdict string, note string")
LAYER_JSON = ("features array<struct<properties:map<string,string>,"
    "geometry:struct<type:string,coordinates:array<array<array<double>>>>>>")
PRIMITIVES = {
    "dxf_entities": "case_id string, sheet string, layer string, kind string, closed boolean, "
    "points array<struct<x:double,y:double>>, text string",
    "dxf_dimensions": "case_id string, sheet string, pos int, measurement double, angle double, "
    "dx double, dy double, y double",
    "text_spans": "case_id string, sheet string, pos int, text string, x0 double, y0 double, x1 double, "
    "y1 double, color int",
    "strokes": "case_id string, sheet string, color int, axis string, pos double, lo double, hi double",
}
CORRECTION = ("model_id bigint, seq bigint, floor_level int, room_index int, use string, confidence string")
