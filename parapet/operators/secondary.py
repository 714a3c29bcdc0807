"""Low-trust secondary rule set (E20-E24) and the buildable-envelope estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.functions import geometry as g
from parapet.operators.checks import NO_REMEDIES, one_remedy
from parapet.operators.normalise import measure_floors
from parapet.session import spread

# Limits of the secondary rule set.
COVERAGE_PCT = 60.0
MIN_PLOT_SQM = 100.0
SQM_PER_TREE = 80.0
# round(x, 2) > 60 holds from this double on
COVERAGE_BREACH = "60.005D"


def _rows(df: DataFrame, rule_id: str, severity: str, title: str, status: str, clause: str, cite: str, obs="null", obs_txt="null", req="null", geom="null", comp="false", amb="null", rem=NO_REMEDIES) -> DataFrame:
    return df.selectExpr(
        "model_id",
        "cast(0 as bigint) as finding_seq",
        f"'FIXTURE.{rule_id}' as rule_id",
        f"{status} as status",
        f"'{severity}' as severity",
        f"'{title}' as title",
        f"named_struct('doc', coalesce(rule_pack, 'FIXTURE'), 'clause', '{clause}', 'version', 'fixture', 'url', cast(null as string), 'status', '{cite}') as citation",
        f"cast({obs} as double) as observed_num",
        f"cast({obs_txt} as string) as observed_txt",
        f"cast({req} as double) as required_num",
        "cast(null as string) as required_txt",
        f"cast({geom} as {g.RING}) as geometry_ref",
        f"{comp} as compoundable",
        f"cast({amb} as string) as ambiguity_class",
        f"{rem} as remedies",
        "rule_pack",
    )


def fx_coverage(plots: DataFrame, floors: DataFrame) -> DataFrame:
    """Every level-0 floor counts; silent without a plot area or a level-0 floor."""
    agg = (
        measure_floors(floors.filter("level = 0"))
        .groupBy("model_id")
        .agg(F.sum(F.coalesce("area", F.lit(0.0))).alias("area0"), F.min_by("footprint", "floor_pos").alias("first_fp"))
    )
    x = plots.filter("plot_area_sqm <> 0").join(spread(agg), "model_id").withColumn("pct", F.expr("area0 / plot_area_sqm * 100D"))
    breach = f"pct >= {COVERAGE_BREACH}"
    return _rows(
        x, "ground_coverage", "major", "Ground coverage (placeholder limit)", f"case when {breach} then 'violation' else 'pass' end",
        "15", "seed_unverified", "pct", req=f"{COVERAGE_PCT}D", geom="first_fp", comp="true",
        rem=f"case when {breach} then {one_remedy('geometric_edit', 'Reduce the ground floor outline to the limit shown.')} else {NO_REMEDIES} end",
    )


def fx_rwh(plots: DataFrame) -> DataFrame:
    """E21."""
    return _rows(
        plots.filter(f"plot_area_sqm > {MIN_PLOT_SQM}D"), "rainwater_harvesting", "minor", "Rainwater harvesting on larger plots",
        "case when has_rwh then 'pass' else 'violation' end", "rwh", "not_stated", obs="cast(has_rwh as int)", req="1", comp="true",
    )


def fx_trees(plots: DataFrame) -> DataFrame:
    """The only source of ``advisory``."""
    return _rows(
        plots.filter(f"plot_area_sqm > {MIN_PLOT_SQM}D"), "tree_planting", "minor", "Trees per plot area (advice)", "'advisory'",
        "tree_planting", "not_stated", obs="tree_count", req=f"greatest(1, floor(plot_area_sqm / {SQM_PER_TREE}D))",
    )


def fx_height_unknown(plots: DataFrame, floors: DataFrame) -> DataFrame:
    """E23."""
    gap = floors.groupBy("model_id").agg(F.bool_or(F.col("height_m").isNull()).alias("gap")).filter("gap")
    return _rows(plots.join(spread(gap), "model_id"), "total_height", "major", "Total height cannot be established", "'unknown'", "17", "not_stated")


def fx_containment(plots: DataFrame, floors: DataFrame) -> DataFrame:
    """At most one containment row per model, for the first failing floor, plus the stilt notice."""
    p = plots.select("model_id", "rule_pack", "plot_polygon", "zoned_area")
    fl = measure_floors(floors).join(spread(p.select("model_id", "zoned_area")), "model_id")
    agg = (
        fl.withColumn("inside", F.expr(g.within("footprint", "zoned_area", "b")))
        .groupBy("model_id")
        .agg(
            F.expr("min_by(footprint, floor_pos) filter (where not inside)").alias("out_fp"),
            F.expr("min_by(footprint, floor_pos) filter (where is_stilt)").alias("stilt_fp"),
            F.bool_or("is_stilt").alias("has_stilt"),
        )
    )
    x = p.join(spread(agg), "model_id", "left")
    status = "case when zoned_area is null then 'unknown' when out_fp is null then 'pass' else 'violation' end"
    main = _rows(
        x, "zoned_area_containment", "blocking", "Zoned-area containment", status, "zoning.containment", "not_stated",
        obs_txt="case when zoned_area is null then null when out_fp is null then 'all outlines inside' else 'an outline is outside' end",
        geom="case when zoned_area is null then plot_polygon when out_fp is null then zoned_area else out_fp end",
        rem=f"case when zoned_area is not null and out_fp is not null then {one_remedy('zoning_revision_request', 'Bring the outline back inside the zoned area.')} else {NO_REMEDIES} end",
    )
    stilt = _rows(
        x.filter("has_stilt"), "stilt_far_treatment", "major", "Stilt storey in the floor area ratio is contested", "'ambiguity'", "16",
        "seed_unverified", obs_txt="'stilt floor present'", geom="stilt_fp", amb="'definitional'",
    )
    return main.unionByName(stilt)


def setback_constants(rules: DataFrame) -> DataFrame:
    """Setback formula constants of each pack that has both formulas, one row per pack."""
    f = rules.filter("kind = 'setback_formula'")
    pick = lambda end, field: f"min_by(r.{field}, rule_pos) filter (where endswith(rule_id, '{end}'))"
    return (
        f.groupBy("rule_pack")
        .agg(
            F.expr(pick(".front_rear_formula", "fraction_of_height")).alias("fr_fraction"),
            F.expr(pick(".front_rear_formula", "min_m")).alias("fr_min"),
            F.expr(pick(".side_formula", "fraction_of_height")).alias("side_fraction"),
            F.expr(pick(".side_formula", "min_m")).alias("side_min"),
        )
        .filter("fr_min is not null and side_min is not null")
    )


def estimate_envelope(plots: DataFrame, floors: DataFrame, rules: DataFrame, elev_width: DataFrame, plot_size: DataFrame) -> DataFrame:
    """Size-only estimate of the buildable envelope; one row per model, with a reason whenever
    it is unavailable. ``elev_width(model_id, elevation_width_m)``, ``plot_size(model_id,
    width_m, length_m)``. "Every floor fits" is decided on per-model maxima, so floors are read once.
    """
    fl = measure_floors(floors).withColumn("ok", F.expr("area > 0"))
    agg = fl.groupBy("model_id").agg(
        F.expr("sum(height_m) filter (where not is_stilt)").alias("height"),
        F.expr("min_by(named_struct('w', case when ok then b.xmax - b.xmin end, 'd', case when ok then b.ymax - b.ymin end), struct(level, floor_pos))").alias("lowest"),
        F.expr("max(b.xmax - b.xmin) filter (where ok)").alias("max_w"),
        F.expr("max(b.ymax - b.ymin) filter (where ok)").alias("max_d"),
    )
    x = (
        plot_size.join(spread(plots.select("model_id", "rule_pack")), "model_id")
        .join(spread(agg), "model_id", "left")
        .join(spread(elev_width), "model_id", "left")
        .join(setback_constants(rules), "rule_pack", "left")
    )
    x = x.withColumn(
        "by_width", F.expr("abs(elevation_width_m - lowest.w) <= abs(elevation_width_m - lowest.d)")
    ).withColumn("road_dim", F.expr("case when by_width then lowest.w else lowest.d end"))
    x = (
        x.withColumn("front_is_width", F.expr("abs(width_m - road_dim) <= abs(length_m - road_dim)"))
        .withColumn("front_rear_setback_m", F.expr("case when height is not null then greatest(height * fr_fraction, fr_min) end"))
        .withColumn("side_setback_m", F.expr("case when height is not null then greatest(height * side_fraction, side_min) end"))
        .withColumn("env_frontage_m", F.expr("(case when front_is_width then width_m else length_m end) - 2 * side_setback_m"))
        .withColumn("env_depth_m", F.expr("(case when front_is_width then length_m else width_m end) - 2 * front_rear_setback_m"))
        .withColumn(
            "reason",
            F.expr(
                "case when height is null then 'no_height' when lowest.w is null then 'no_footprint'"
                " when elevation_width_m is null then 'no_elevation_width' when fr_min is null then 'no_setback_formula'"
                " when env_frontage_m <= 0 or env_depth_m <= 0 then 'no_area_left' end"
            ),
        )
    )
    fits = (
        "(case when by_width then max_w else max_d end) <= env_frontage_m + 1e-6D"
        " and (case when by_width then max_d else max_w end) <= env_depth_m + 1e-6D"
    )
    out = lambda e, name: F.expr(f"case when reason is null then {e} end").alias(name)
    return x.select(
        "model_id",
        F.expr("reason is null").alias("available"),
        "reason",
        out("height", "height_m_used"),
        out("front_rear_setback_m", "front_rear_setback_m"),
        out("side_setback_m", "side_setback_m"),
        out("case when front_is_width then 'width' else 'length' end", "frontage_source"),
        out("env_frontage_m", "env_frontage_m"),
        out("env_depth_m", "env_depth_m"),
        out("env_frontage_m * env_depth_m", "env_area_sqm"),
        out(f"case when max_w is null then 'inconclusive' when {fits} then 'plausible_fit' else 'likely_exceeds' end", "fit_status"),
    )
