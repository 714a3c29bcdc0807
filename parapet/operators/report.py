"""Aggregates behind a report.

All of them are hash aggregates keyed by model and rule; arrays are collected only where the number
of entries is bounded by the rule table, never by the number of findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapet.functions import geometry as g
from parapet.schemas import SEVERITY_RANK, STATUS_RANK
from parapet.session import spread

# Unit factor and status colours.
SQYD_PER_SQM = 1.196
STATUS_COLOR = {
    "violation": "#d92d20",
    "ambiguity": "#f79009",
    "advisory": "#2970ff",
    "pass": "#12b76a",
    "unknown": "#667085",
}


def _lookup(mapping: dict, col: str, default) -> str:
    arms = " ".join(f"when '{k}' then {v!r}" for k, v in mapping.items())
    return f"(case {col} {arms} else {default!r} end)"


def severity_rank(col: str = "severity") -> str:
    return _lookup(SEVERITY_RANK, col, 9)


def status_rank(col: str = "status") -> str:
    return _lookup(STATUS_RANK, col, 9)


def sqm_to_sqyd(col: str) -> Column:
    """Display only."""
    return F.expr(f"bround({col} * {SQYD_PER_SQM}D, 2)")


def issue_counts(findings: DataFrame, keys=("model_id",)) -> DataFrame:
    """F1."""
    return (
        findings.groupBy(*keys)
        .agg(F.count_if(F.col("status") != "pass").alias("n_issues"))
        .withColumn("summary", F.expr("concat('pre-submission check: ', n_issues, ' issues found')"))
    )


def pfr_counts(findings: DataFrame, keys=("model_id",)) -> DataFrame:
    """F2."""
    return findings.groupBy(*keys).agg(
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status") == "violation").alias("flagged"),
        F.count_if(~F.col("status").isin("pass", "violation")).alias("review"),
        F.count("*").alias("total"),
    )


def status_histogram(findings: DataFrame, keys=("model_id",)) -> DataFrame:
    """one column per status."""
    return findings.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUS_RANK])


def status_rollup(findings: DataFrame, plots: DataFrame) -> DataFrame:
    """Portfolio view of F3: authority, pack and status totals."""
    # Counting per model first keeps the join one row per (model, status).
    per_model = findings.groupBy("model_id", "rule_pack", "status").agg(F.count("*").alias("n"))
    j = per_model.join(spread(plots.select("model_id", "authority")), "model_id")
    return j.rollup("authority", "rule_pack", "status").agg(F.sum("n").alias("n"))


def with_titles(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """C4: document title next to each finding, the id where the manifest lacks it."""
    d = docs.select(F.col("doc_id").alias("_doc"), F.col("title").alias("_title"))
    return (
        findings.join(d, F.col("citation.doc") == F.col("_doc"), "left")
        .withColumn("doc_title", F.coalesce("_title", "citation.doc"))
        .drop("_doc", "_title")
    )


def bylaws_checked(findings: DataFrame, docs: DataFrame, keys=("model_id",)) -> DataFrame:
    """one row per model and cited document."""
    statuses = ("conflict", "not_stated", "seed_unverified", "verified")
    agg = findings.groupBy(*keys, F.col("citation.doc").alias("doc_id")).agg(
        F.array_sort(F.collect_set("citation.clause")).alias("clauses"),
        F.count("*").alias("n_findings"),
        F.min_by("citation.version", "finding_seq").alias("version"),
        *[F.count_if(F.col("citation.status") == s).alias(f"_{s}") for s in statuses],
    )
    entries = ", ".join(f"named_struct('key', '{s}', 'value', _{s})" for s in statuses)
    agg = agg.withColumn("verification", F.expr(f"map_from_entries(filter(array({entries}), e -> e.value > 0))"))
    d = docs.select("doc_id", F.col("title").alias("_title"))
    return (
        agg.drop(*[f"_{s}" for s in statuses])
        .join(d, "doc_id", "left")
        .withColumn("doc_title", F.coalesce("_title", "doc_id"))
        .drop("_title")
    )


def group_heading(title: str, n_titles: str) -> str:
    """Drop a trailing ``(...)`` only where the group's titles differ."""
    return rf"case when {n_titles} > 1 then rtrim(regexp_replace({title}, '\\s*\\([^()]*\\)\\s*$', '')) else {title} end"


#: what tells the instances of a rule apart
INSTANCE = ("title", "observed_num", "observed_txt", "required_num", "required_txt")


def issue_groups(findings: DataFrame, keys=("model_id",), issues_only: bool = True) -> DataFrame:
    """findings grouped by rule; ``first_seq`` keeps first-seen order."""
    f = findings.filter("status <> 'pass'") if issues_only else findings
    # Distinct instances first: the second level then counts rows, with no distinct expansion.
    d = f.groupBy(*keys, "rule_id", *INSTANCE).agg(
        F.count("*").alias("c"),
        F.min("finding_seq").alias("seq"),
        F.min_by(F.struct("severity", "status", "title"), "finding_seq").alias("f0"),
    )
    t = d.groupBy(*keys, "rule_id", "title").agg(
        F.sum("c").alias("c"), F.count("*").alias("k"), F.min("seq").alias("seq"), F.min_by("f0", "seq").alias("f0")
    )
    return (
        t.groupBy(*keys, "rule_id")
        .agg(
            F.min("seq").alias("first_seq"),
            F.sum("c").alias("n_findings"),
            F.sum("k").alias("n_instances"),
            F.count("*").alias("n_titles"),
            F.min_by("f0", "seq").alias("f0"),
        )
        .withColumn("heading", F.expr(group_heading("f0.title", "n_titles")))
        .select(*keys, "rule_id", "first_seq", "n_findings", "n_instances", "heading", "f0.severity", "f0.status")
    )


def order_groups(groups: DataFrame, keys=("model_id",)) -> DataFrame:
    """H1: position of each issue group inside its model (one row per rule, so the sort is small)."""
    w = Window.partitionBy(*keys).orderBy(F.expr(severity_rank()), F.expr(status_rank()), "first_seq")
    return groups.withColumn("position", F.row_number().over(w))


def order_findings(findings: DataFrame, keys=("model_id",)) -> DataFrame:
    """H2: findings by status rank, stable."""
    return findings.withColumn("status_rank", F.expr(status_rank())).orderBy(*keys, "status_rank", "finding_seq")


def severity_summary(findings: DataFrame, keys=("model_id",)) -> DataFrame:
    """issue groups per severity with their headings in report order."""
    gr = issue_groups(findings, keys)
    entry = F.expr(f"struct({status_rank()} as r, first_seq, heading)")
    return gr.groupBy(*keys, "severity").agg(
        F.count("*").alias("n_groups"),
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["heading"]).alias("headings"),
    )


def distinct_remedies(findings: DataFrame, keys=("model_id",)) -> DataFrame:
    """First appearance of each remedy text per rule."""
    ex = findings.filter("status <> 'pass'").select(*keys, "rule_id", "finding_seq", F.posexplode("remedies").alias("k", "m"))
    return (
        ex.groupBy(*keys, "rule_id", F.col("m.description").alias("description"))
        .agg(F.min_by("m.kind", F.struct("finding_seq", "k")).alias("kind"), F.min("finding_seq").alias("first_seq"))
    )


def pack_registry(rules: DataFrame) -> DataFrame:
    """F18."""
    return rules.groupBy("rule_pack", "jurisdiction").agg(
        F.count("*").alias("n_rules"), F.count_if("enforced").alias("n_enforced")
    )


def far_readings(plots: DataFrame, floors: DataFrame, cap: str = "1.0D") -> DataFrame:
    """ratio without and with the stilt levels, and the area over a cap under each reading."""
    from parapet.operators.normalise import measure_floors

    fl = measure_floors(floors)
    lv = fl.filter("is_stilt").select("model_id", "level").distinct().withColumn("stilt_level", F.lit(True))
    agg = (
        fl.join(spread(lv), ["model_id", "level"], "left")
        .groupBy("model_id")
        .agg(
            F.expr("coalesce(sum(area) filter (where stilt_level is null), 0D)").alias("covered_excl"),
            F.expr("sum(area)").alias("covered_incl"),
            F.expr("count_if(stilt_level is null)").alias("n_upper"),
        )
    )
    x = plots.select("model_id", F.expr("coalesce(plot_area_sqm, 0D)").alias("plot")).join(spread(agg), "model_id")
    return x.selectExpr(
        "model_id", "plot", "covered_excl", "covered_incl", "n_upper",
        "case when plot <> 0 then covered_excl / plot else 0D end as far_excl",
        "case when plot <> 0 then covered_incl / plot else 0D end as far_incl",
    ).selectExpr(
        "*",
        f"greatest(0D, far_excl - {cap}) * plot as excess_excl",
        f"greatest(0D, far_incl - {cap}) * plot as excess_incl",
    )


def overlay_features(plots: DataFrame, floors: DataFrame, findings: DataFrame) -> DataFrame:
    """GeoJSON features, one row each: plot, zone, floors, then one per finding (its geometry may
    be ``null``). ``feature_seq`` is the order inside the model. Rows stay rows, so a model with very
    many findings is never gathered into one task; the sink writes them as GeoJSON text sequences. ``color``
    and ``remedy_count`` of a finding are columns too, so that counts need not parse the text.
    """

    def feature(geom, props):
        return f"""concat('{{"type":"Feature","geometry":', {geom}, ',"properties":', to_json({props}), '}}')"""

    def context(df, ring, seq, props, label):
        return df.filter(f"size({ring}) > 0").selectExpr(
            "model_id", f"cast({seq} as bigint) as feature_seq", f"'{label}' as kind", f"{g.geom_type(ring)} as geometry_type",
            f"{feature(g.geometry_json(ring), props)} as feature", "cast(null as string) as color", "cast(null as int) as remedy_count",
        )

    color = _lookup(STATUS_COLOR, "status", STATUS_COLOR["unknown"])
    props = (
        f"named_struct('kind', 'finding', 'rule_id', rule_id, 'status', status, 'severity', severity, 'title', title, 'color', {color},"
        " 'observed', coalesce(cast(observed_num as string), observed_txt), 'required', coalesce(cast(required_num as string), required_txt),"
        " 'compoundable', compoundable, 'ambiguity_class', ambiguity_class, 'citation', citation, 'remedy_count', size(remedies))"
    )
    found = findings.selectExpr(
        "model_id", "finding_seq + cast(1 as bigint) * 1099511627776 as feature_seq", "'finding' as kind",
        f"{g.geom_type('geometry_ref')} as geometry_type", f"{feature(g.geometry_json('geometry_ref'), props)} as feature",
        f"{color} as color", "size(remedies) as remedy_count",
    )
    return (
        context(plots, "plot_polygon", "0", "named_struct('kind', 'plot_outline')", "plot_outline")
        .unionByName(context(plots, "zoned_area", "1", "named_struct('kind', 'zoned_area')", "zoned_area"))
        .unionByName(
            context(floors, "footprint", "2 + floor_pos", "named_struct('kind', 'floor_footprint', 'level', level, 'is_stilt', is_stilt)", "floor_footprint")
        )
        .unionByName(found)
    )
