"""Building-model tables derived from the star-schema parquet files.

Every column is a deterministic formula over a source row. All lengths are multiples of 1/8 m, so
areas and their sums are exact whatever the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parapet.functions import geometry as g
from parapet.schemas import ROOM_USES


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plots(spark: SparkSession, sf_dir: str, by_model: bool = False) -> DataFrame:
    """With ``by_model`` the rows are dealt by model before rings are built: joins by model shuffle no rings."""
    orders = load(spark, sf_dir, "orders")
    return (
        (orders.repartition("o_orderkey") if by_model else orders)
        .selectExpr(
            "o_orderkey as model_id",
            "o_custkey as seed",
            "case when o_orderpriority like '3-%' then 'CHANDIGARH' when o_orderpriority like '4-%' then 'UNKNOWN' else 'GMADA' end as authority",
            "case when o_orderkey % 19 <> 0 then to_date(o_orderdate) end as allotment_date",
            "cast(8 + o_orderkey % 13 as double) as w",
            "cast(15 + o_custkey % 17 as double) as l",
        )
        .selectExpr(
            "model_id",
            "authority",
            "case when authority = 'CHANDIGARH' then 'chandigarh_building_rules_urban_2017' else 'puda_building_rules_1996' end as rule_pack",
            "allotment_date",
            "w",
            "l",
            g.rect_ring(0, 0, "w", "l") + " as plot_polygon",
            "case when model_id % 11 <> 0 then w * l end as plot_area_sqm",
            f"case when model_id % 7 <> 0 then {g.rect_ring(1.5, 3, 'w - 1.5D', 'l - 3D')} end as zoned_area",
            "case when model_id % 4 = 0 then named_struct('height_m', 1.5D + 0.125D * cast(seed % 12 as double),"
            " 'setback_m', 0.125D * cast(model_id % 24 as double)) end as mumty",
            "model_id % 3 = 0 as has_rwh",
            "cast(seed % 5 as int) as tree_count",
            "seed",
        )
    )


def edges(plots_df: DataFrame) -> DataFrame:
    def edge(pos, role, x0, y0, x1, y1, road="cast(null as double)"):
        return (
            f"named_struct('edge_pos', {pos}, 'role', '{role}', 'line', {g.line(x0, y0, x1, y1)},"
            f" 'faces_road', {str(role == 'front').lower()}, 'road_width_m', {road})"
        )

    road = "case when model_id % 23 <> 0 then cast(6 + seed % 10 as double) end"
    sides = [
        edge(0, "front", 0, 0, "w", 0, road),
        edge(1, "rear", "w", "l", 0, "l"),
        edge(2, "side_a", 0, "l", 0, 0),
        edge(3, "side_b", "w", 0, "w", "l"),
    ]
    return plots_df.selectExpr("model_id", f"inline(array({', '.join(sides)}))")


def _ranked_lines(spark: SparkSession, sf_dir: str, by_model: bool = False) -> DataFrame:
    """Lineitem with its rank inside the order; the sort key is unique inside an order.

    With ``by_model`` all tables made of it are dealt by one and the same shuffle: the last two columns do not
    change the rank, and rows are always ranked, so that each plan shuffles the same columns."""
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag"
    )
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *(["l_quantity", "l_returnflag"] if by_model else []))
    ranked = li.withColumn("rn", F.row_number().over(w))
    return ranked.filter("rn > 0") if by_model else ranked


def _floor_rows(spark: SparkSession, sf_dir: str, by_model: bool = False) -> DataFrame:
    return (
        _ranked_lines(spark, sf_dir, by_model)
        .selectExpr(
            "l_orderkey as model_id",
            "rn - 1 as floor_pos",
            "cast(rn - 1 - (case when l_orderkey % 5 = 0 then 1 else 0 end) as int) as level",
            "0.25D * cast(4 + l_partkey % 8 as double) as x0",
            "0.25D * cast(8 + l_suppkey % 12 as double) as y0",
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag",
        )
        .selectExpr(
            "*",
            "x0 + 5D + 0.25D * cast(l_partkey % 24 as double) as x1",
            "y0 + 6D + 0.25D * cast(l_suppkey % 40 as double) as y1",
        )
    )


def floors(spark: SparkSession, sf_dir: str, by_model: bool = False) -> DataFrame:
    return _floor_rows(spark, sf_dir, by_model).selectExpr(
        "model_id",
        "floor_pos",
        "level",
        "level = 0 and model_id % 6 = 0 as is_stilt",
        g.rect_ring("x0", "y0", "x1", "y1") + " as footprint",
        "case when l_suppkey % 9 <> 0 then 2.25D + 0.125D * cast(l_partkey % 8 as double) end as height_m",
        "model_id % 17 = 0 as footprint_is_upper_bound",
    )


def rooms(spark: SparkSession, sf_dir: str, by_model: bool = False) -> DataFrame:
    uses = "array(" + ", ".join(f"'{u}'" for u in ROOM_USES) + ")"
    mid = "((x0 + x1) / 2D)"

    def half(pos, x0, x1, pick):
        return (
            f"named_struct('room_index', {pos}, 'use', {uses}[cast({pick} % 9 as int)],"
            f" 'polygon', {g.rect_ring(x0, 'y0', x1, 'y1')})"
        )

    return _floor_rows(spark, sf_dir, by_model).selectExpr(
        "model_id",
        "floor_pos",
        "level",
        "greatest(0D, 0.125D * (cast(l_quantity as double) - 10D)) as openings_area_sqm",
        "case l_returnflag when 'A' then 'high' when 'N' then 'medium' else 'low' end as confidence",
        f"inline(array({half(0, 'x0', mid, 'l_linenumber')}, {half(1, mid, 'x1', 'l_partkey')}))",
    )


def projections(spark: SparkSession, sf_dir: str, by_model: bool = False) -> DataFrame:
    d, w = "0.25D * cast(1 + l_partkey % 12 as double)", "0.5D * cast(1 + l_suppkey % 10 as double)"
    return (
        _ranked_lines(spark, sf_dir, by_model)
        .filter("l_partkey % 2 = 0")
        .selectExpr(
            "l_orderkey as model_id", "rn as pos", "'balcony' as type", "1 as floor",
            g.rect_ring(2, 0, f"2D + {w}", d) + " as polygon",
        )
    )


def courtyards(spark: SparkSession, sf_dir: str, by_model: bool = False) -> DataFrame:
    w, d = "1.5D + 0.25D * cast(l_partkey % 10 as double)", "2D + 0.25D * cast(l_suppkey % 12 as double)"
    return (
        _ranked_lines(spark, sf_dir, by_model)
        .filter("l_partkey % 2 = 1")
        .selectExpr(
            "l_orderkey as model_id", "rn as pos", g.rect_ring(3, 3, f"3D + {w}", f"3D + {d}") + " as ring"
        )
    )


def model_tables(spark: SparkSession, sf_dir: str, by_model: bool = False) -> dict[str, DataFrame]:
    """With ``by_model`` all tables are dealt by model once; for plans that join several of them."""
    p = plots(spark, sf_dir, by_model)
    return {
        "plots": p,
        "edges": edges(p),
        "floors": floors(spark, sf_dir, by_model),
        "rooms": rooms(spark, sf_dir, by_model),
        "projections": projections(spark, sf_dir, by_model),
        "courtyards": courtyards(spark, sf_dir, by_model),
    }


def nested_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested building documents, one per order; some break the contract on purpose."""

    def pairs(x0, y0, x1, y1):
        return f"array(array({x0}, {y0}), array({x1}, {y0}), array({x1}, {y1}), array({x0}, {y1}), array({x0}, {y0}))"

    uses = "array(" + ", ".join(f"'{u}'" for u in ROOM_USES) + ")"
    room = (
        f"named_struct('polygon', {pairs('1D', '2D', '4D', '6D')}, 'use', case when model_id % 13 = 0 then 'attic' else"
        f" {uses}[cast(seed % 9 as int)] end, 'floor', {{lv}}, 'openings_area_sqm', 1.5D, 'confidence', 'low')"
    )

    def floor(lv, h):
        return (
            f"named_struct('level', {lv}, 'is_stilt', model_id % 6 = 0 and {lv} = 0, 'footprint', {pairs('1D', '2D', 'w - 1', 'l - 2')},"
            f" 'height_m', {h}, 'rooms', array({room.format(lv=lv)}), 'footprint_is_upper_bound', false)"
        )

    edge = "named_struct('line', array(array(0D, 0D), array(w, 0D)), 'faces_road', true, 'road_width_m', 9D, 'role', 'front')"
    return plots(spark, sf_dir).selectExpr(
        "model_id",
        "element_at(array('dxf', 'vector_pdf', 'raster', 'sketch'), cast(model_id % 4 + 1 as int)) as source",
        "named_struct('authority', case when model_id % 17 = 0 then 'NOWHERE' else authority end, 'sector', cast(null as string),"
        " 'plot_no', cast(seed as string), 'allotment_date', allotment_date, 'rule_pack', rule_pack) as jurisdiction",
        pairs("0D", "0D", "w", "l") + " as plot_polygon",
        "plot_area_sqm",
        "cast(null as array<array<double>>) as zoned_area",
        f"array({edge}) as edges",
        f"array({floor(0, '3.0D')}, {floor(1, 'cast(null as double)')}) as floors",
        f"case when model_id % 3 = 0 then array(named_struct('type', 'balcony', 'polygon', {pairs('2D', '0D', '4D', '1.5D')}, 'floor', 1)) end as projections",
        f"case when model_id % 5 = 0 then array({pairs('3D', '3D', '5D', '6D')}) end as courtyards",
        "mumty",
        "has_rwh",
        "tree_count",
        "array('derived') as assumptions",
    )


def entered_plot_sizes(plots_df: DataFrame) -> DataFrame:
    """Sizes typed in by users; every fifth is off by one metre."""
    off = "(case when model_id % 5 = 0 then 1D else 0D end)"
    return plots_df.selectExpr("model_id", f"w + {off} as width_m", f"l + {off} as length_m")


def elevation_widths(plots_df: DataFrame) -> DataFrame:
    return plots_df.selectExpr("model_id", "case when model_id % 13 <> 0 then cast(4 + seed % 12 as double) end as elevation_width_m")


# ---------------------------------------------------------------- drawing sheets

# Sheet titles used by the derived tables, by page number.
SHEET_TITLES = (
    "GROUND FLOOR PLAN", "FIRST FLOOR PLAN", "FRONT ELEVATION", "SITE PLAN",
    "BASEMENT PLAN", "STILT FLOOR", "SECTION A-A", "JOINERY DETAIL",
)


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One uploaded sheet per page: ``case_id, upload_pos, file, kind, layout, title, text``."""
    titles = "array(" + ", ".join(f"'{t}'" for t in SHEET_TITLES) + ")"
    text = (
        "concat('S.C.O. 63, Phase-2\\n', case when title is null then '' else concat('TITLE :- ', title, '\\n') end,"
        " 'DATE :-\\nDRAWN BY :-  AB \\n', case when page_id % 11 <> 0 then concat('Plot No.', page_id, ', ') else '' end,"
        " case when page_id % 7 <> 0 then concat('phase -', page_id % 9, ',') else '' end, '\\n',"
        " case when page_id % 13 = 0 and page_id % 2 = 0 then 'REAR ELEVATION' else 'NOTES' end)"
    )
    return (
        load(spark, sf_dir, "pages")
        .selectExpr(
            "page_id",
            "page_id div 5 as case_id",
            "cast(page_id % 5 as int) as upload_pos",
            f"case when page_id % 13 <> 0 then {titles}[cast(page_id % 8 as int)] end as title",
            "case when page_id % 3 = 2 then 'dxf' else 'pdf' end as kind",
            "case when page_id % 6 = 5 then 'ELEVATION-FRONT' end as layout",
        )
        .withColumn("file", F.expr("concat('first_floor-', page_id, '.', kind)"))
        .withColumn("text", F.expr(text))
    )


def text_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension text on sheets, fifty events per sheet."""
    foot, inch = "char(39)", "char(34)"
    return load(spark, sf_dir, "events").selectExpr(
        "event_id div 50 as sheet",
        "event_id as pos",
        f"case when event_id % 5 = 4 then concat(user_id % 40, {foot}) else concat(user_id % 40, {foot}, '-', event_id % 14, {inch}) end as text",
        "floor(value) as x",
        "cast(event_id % 50 as double) as y",
        "user_id",
        "event_id",
    )


# Stroke colours of the derived sheets: two near-red, one near-blue, one grey.
STROKE_COLOURS = (0xE01020, 0xD01830, 0x2030E0, 0x707478)
LABEL_COLOURS = (0xE41424, 0x303030, 0xE41424, 0x2434E4)


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    colours = "array(" + ", ".join(map(str, STROKE_COLOURS)) + ")"
    return load(spark, sf_dir, "events").selectExpr(
        "event_id div 50 as sheet",
        f"{colours}[cast(user_id % 4 as int)] as color",
        "case when event_id % 2 = 0 then 'h' else 'v' end as axis",
        "floor(value) + 0.25D * cast(event_id % 4 as double) as pos",
        "cast(event_id % 20 as double) as lo",
        "cast(event_id % 20 + 1 + user_id % 30 as double) as hi",
        "event_id",
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions that name the plot and zoning lines."""
    colours = "array(" + ", ".join(map(str, LABEL_COLOURS)) + ")"
    return load(spark, sf_dir, "events").selectExpr(
        "event_id div 50 as sheet",
        "case event_id % 7 when 0 then 'PLOT LINE' when 1 then 'Zoning line' else 'ROOM' end as text",
        f"{colours}[cast(user_id % 4 as int)] as color",
        "event_id",
    )


def dxf_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_lines(spark, sf_dir).selectExpr(
        "l_orderkey as sheet",
        "0.125D * cast(l_quantity as double) as measurement",
        "case when l_linenumber % 2 = 1 then 90D else 0D end as angle",
        "0D as dx",
        "0D as dy",
        "cast(rn as double) as y",
    )


def clause_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one-page bylaw texts with clause numbers, bare numbers and PART lines put in."""
    n = "(1 + (i div 3) % 4) * (case when doc_id % 5 = 0 then 2 else 1 end)"
    line = (
        "case when i % 10 = 9 then concat('PART ', repeat('I', cast(1 + (i div 10) % 3 as int)), ' ', ln)"
        f" when i % 12 = 6 then concat({n}, '.') when i % 3 = 0 then concat({n}, '. ', ln) else ln end"
    )
    return load(spark, sf_dir, "documents").selectExpr(
        "cast(doc_id as string) as doc_id",
        "0 as page",
        f"concat(array_join(transform(split(text, '\\n'), (ln, i) -> {line}), '\\n'), case when doc_id % 4 = 0 then ' 65 per cent' else '' end,"
        " case when doc_id % 6 = 0 then ' may be permitted' else '' end) as text",
    )


TOP_HEADINGS = [("1", "TITLE AND SCOPE"), ("2", "DEFINITIONS"), ("annexure-1", "ANNEXURE 1")]


def sectioned_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as short documents with letter-spaced headings, sub-clauses and stray numbers."""
    lines = (
        "array('contents', '1 T I T L E   AND SCOPE', p_name, '2. D E F I N I T I O N S', '2.1 First item:', p_type, '2.2', 'Second -',"
        " '2.55 table row', '9.1 stray', '2.1 again', 'ANNEXURE - 1', p_brand)"
    )
    return load(spark, sf_dir, "part").selectExpr("cast(p_partkey as string) as doc_id", f"{lines} as lines")
