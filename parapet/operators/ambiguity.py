"""Ambiguity triggers (L1-L9, C9, J16, J22) and dossiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.operators.report import far_readings
from parapet.session import spread

# Phrases that leave a decision to the authority, in matching order.
DISCRETIONARY_PHRASES = (
    "may be permitted",
    "may be relaxed",
    "at the discretion of",
    "in the discretion of",
    "competent authority may",
    "as may be approved by",
    "subject to the satisfaction of",
)
EVIDENCE = "map<string,string>"


def _triggers(df: DataFrame, cls: str, reason: str, evidence: dict[str, str], rule_id: str = "cast(null as string)", key: str = "model_id") -> DataFrame:
    ev = ", ".join(f"'{k}', cast({v} as string)" for k, v in evidence.items())
    return df.selectExpr(
        f"{key} as model_id",
        f"'{cls}' as ambiguity_class",
        f"{reason} as reason",
        f"map({ev}) as evidence",
        f"{rule_id} as rule_id",
    )


def missing_input(plots: DataFrame) -> DataFrame:
    """L1: up to three triggers per plot."""
    gaps = plots.selectExpr(
        "model_id",
        "explode(array_compact(array(case when zoned_area is null then 'zoned_area' end,"
        " case when plot_area_sqm is null or plot_polygon is null then 'plot_area_sqm' end,"
        " case when allotment_date is null then 'jurisdiction.allotment_date' end))) as field",
    )
    return _triggers(gaps, "missing_input", "concat('input not on file: ', field)", {"field": "field"})


def extraction(floors: DataFrame, rooms: DataFrame) -> DataFrame:
    """L2."""
    low = _triggers(
        rooms.filter("confidence = 'low'"), "extraction", "concat('room use on floor ', level, ', room ', room_index, ' is uncertain')",
        {"source": "'low_confidence_label'", "floor": "level", "room_index": "room_index", "confidence": "confidence"},
    )
    high = _triggers(
        floors.filter("height_m is null"), "extraction", "concat('floor ', level, ' has no height')",
        {"source": "'missing_section_height'", "floor": "level"},
    )
    return low.unionByName(high)


def instrument_conflict(findings: DataFrame, group_key: str = "title", keys=("model_id",)) -> DataFrame:
    """L3: instruments that ask different values of the same check.

    Per (doc, clause) the last finding wins, at the place of the first; a missing requirement counts
    as its own value. The number of sources is bounded by the clauses of the rule table.
    """
    required = F.expr("coalesce(cast(required_num as string), required_txt, 'None')")
    src = (
        findings.groupBy(*keys, F.col(group_key).alias("check"), F.col("citation.doc").alias("doc"), F.col("citation.clause").alias("clause"))
        .agg(F.max_by(F.struct(required.alias("required"), "rule_id"), "finding_seq").alias("f"), F.min("finding_seq").alias("seq"))
        .select(*keys, "check", "doc", "clause", "seq", "f.*")
    )
    agg = src.groupBy(*keys, "check").agg(
        F.count("*").alias("n_sources"),
        F.size(F.collect_set("required")).alias("n_values"),
        F.min_by("rule_id", "seq").alias("rule_id"),
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("seq", "doc", "clause", "required"))), lambda e: e.dropFields("seq"))).alias("sources"),
    )
    hit = agg.filter("n_sources >= 2 and n_values >= 2")
    return _triggers(
        hit, "instrument_conflict", "concat(n_sources, ' instruments differ on ', check)",
        {"check": "check", "n_sources": "n_sources", "sources": "sources"}, "rule_id",
    )


def transcription_conflict(findings: DataFrame) -> DataFrame:
    """L4."""
    f = findings.filter("citation.status = 'conflict'")
    return _triggers(
        f, "extraction", "concat('transcription passes disagree on ', citation.doc, ':', citation.clause)",
        {"source": "'transcription_conflict'", "doc": "citation.doc", "clause": "citation.clause"}, "rule_id",
    )


def vintage_side(date: str, cutoff: str) -> str:
    """J22."""
    return f"case when {date} < {cutoff} then 'before' when {date} >= {cutoff} then 'on-or-after' end"


def vintage(plots: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``cutoffs(cutoff_date date, regime, doc, clause)``. Every plot meets every cutoff; they reach
    the plots as one aggregated row, so a plot's row is never moved."""
    every = cutoffs.agg(F.collect_list(F.struct("cutoff_date", "regime", "doc", "clause")).alias("_cuts"))
    x = plots.filter("allotment_date is not null").crossJoin(every).select(*plots.columns, F.inline("_cuts"))
    x = x.withColumn("side", F.expr(vintage_side("allotment_date", "cutoff_date")))
    return _triggers(
        x, "vintage", "concat('allotted ', side, ' ', cutoff_date, ' for ', regime)",
        {"allotment_date": "allotment_date", "cutoff_date": "cutoff_date", "side": "side", "regime": "regime", "doc": "doc", "clause": "clause"},
    )


def discretionary_phrase(text: str) -> str:
    """First phrase in list order."""
    arr = "array(" + ", ".join(f"'{p}'" for p in DISCRETIONARY_PHRASES) + ")"
    return f"try_element_at(filter({arr}, dp -> contains(lower({text}), dp)), 1)"


def discretionary(clauses: DataFrame) -> DataFrame:
    """Keyed by document, as clauses belong to no model."""
    x = clauses.withColumn("phrase", F.expr(discretionary_phrase("text"))).filter("phrase is not null")
    return _triggers(
        x, "discretionary", "concat('discretionary wording: ', phrase)", {"matched_phrase": "phrase", "doc": "doc_id", "clause": "number"},
        key="cast(null as bigint)",
    )


def definitional_stilt(floors: DataFrame, clause_text: str | None, doc: str, clause: str) -> DataFrame:
    """Silent where the governing clause already speaks of stilts."""
    stilts = floors.filter("is_stilt").filter(F.lit("stilt" not in (clause_text or "").lower()))
    agg = stilts.groupBy("model_id").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("level")).alias("levels")
    )
    return _triggers(
        agg, "definitional", "concat(n, ' stilt floor(s); the clause names none')",
        {"stilt_levels": "to_json(levels)", "n_stilt": "n", "doc": f"'{doc}'", "clause": f"'{clause}'"},
    )


def practice(findings: DataFrame, history: DataFrame) -> DataFrame:
    """Rules this office has objected to although the design complied on paper.

    The history is counted per rule before the join, so its volume never multiplies the findings.
    """
    past = history.filter("was_compliant_on_paper").groupBy(F.col("rule_id").alias("_rule")).agg(F.count("*").alias("n_cases"))
    x = findings.select("model_id", "rule_id").distinct().join(past, F.col("rule_id") == F.col("_rule"))
    return _triggers(
        x, "practice_divergence", "concat(n_cases, ' earlier objection(s) to ', rule_id)",
        {"rule_id": "rule_id", "prior_cases": "n_cases"}, "rule_id",
    )


def classify_all(tables: dict, findings: DataFrame, cutoffs=None, clauses=None, far_clause=None, history=None) -> DataFrame:
    """Every trigger that fires; an omitted context produces nothing."""
    parts = [
        missing_input(tables["plots"]),
        extraction(tables["floors"], tables["rooms"]),
        instrument_conflict(findings),
        transcription_conflict(findings),
    ]
    if history is not None:
        parts.append(practice(findings, history))
    if cutoffs is not None:
        parts.append(vintage(tables["plots"], cutoffs))
    if clauses is not None:
        parts.append(discretionary(clauses))
    if far_clause is not None:
        parts.append(definitional_stilt(tables["floors"], *far_clause))
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---------------------------------------------------------------- dossiers

_R = "array<struct<label:string,description:string,outcome:string>>"


def _readings(*rows) -> str:
    return "array(" + ", ".join(f"named_struct('label', {a}, 'description', {b}, 'outcome', cast({c} as string))" for a, b, c in rows) + ")"


_E = "evidence['{}']".format
_TEMPLATES = {
    # class: (title, readings, safer reading, paragraph)
    "confirm": (
        "'Room use to confirm'",
        _readings(("'Confirm on screen'", "'One question to the user settles it.'", "null")),
        "'Confirm on screen'",
        f"concat('The use of room ', {_E('room_index')}, ' on floor ', {_E('floor')}, ' was read with low confidence; confirm it before relying on checks that depend on it.')",
    ),
    "extraction": (
        "'Value not read reliably'",
        _readings(("'Report unknown'", "'The affected check stays undecided.'", "'unknown'"), ("'Assume a usual value'", "'A guess from convention.'", "'rejected'")),
        "'Report unknown'",
        "reason",
    ),
    "missing_input": (
        f"concat('Missing input: ', {_E('field')})",
        _readings(("'Assume no problem'", "'Read the gap as harmless.'", "'rejected'"), ("'Report unknown'", "'Hold the dependent checks until it is supplied.'", "'unknown'")),
        "'Report unknown'",
        f"concat('The input ', {_E('field')}, ' is not on file; every check that needs it stays undecided.')",
    ),
    "definitional": (
        "'Stilt storey in the floor area ratio'",
        _readings(
            ("'Exclude stilt'", "concat('Covered area ', format_number(covered_excl, 1), ' sqm, ratio ', format_number(far_excl, 3))", "null"),
            ("'Include stilt'", "concat('Covered area ', format_number(covered_incl, 1), ' sqm, ratio ', format_number(far_incl, 3))", "null"),
        ),
        "'Include stilt'",
        "concat('Without the stilt storey the ratio is ', format_number(far_excl, 3), ' (', format_number(excess_excl, 1), ' sqm over the cap); with it ',"
        f" format_number(far_incl, 3), ' (', format_number(excess_incl, 1), ' sqm over). ', {_E('doc')}, ' clause ', {_E('clause')}, ' names no stilt.')",
    ),
    "vintage": (
        f"concat('Regime by allotment date: ', {_E('regime')})",
        _readings(
            ("'Pre-cutoff regime'", f"concat('Allotted before ', {_E('cutoff_date')})", "null"),
            ("'Post-cutoff regime'", f"concat('Allotted on or after ', {_E('cutoff_date')})", "null"),
        ),
        f"case when {_E('side')} = 'before' then 'Pre-cutoff regime' else 'Post-cutoff regime' end",
        f"concat('The allotment date ', {_E('allotment_date')}, ' lies ', {_E('side')}, ' the cutoff ', {_E('cutoff_date')}, ' of ', {_E('doc')}, ' clause ', {_E('clause')}, '.')",
    ),
    "discretionary": (
        "'Discretionary wording'",
        _readings(("'Relief granted'", "'Proceed as if relaxed already.'", "'rejected'"), ("'Relief not granted'", "'Binding until relaxed in writing.'", "'conservative'")),
        "'Relief not granted'",
        f"concat({_E('doc')}, ' clause ', {_E('clause')}, ' says \"', {_E('matched_phrase')}, '\"; ask for the relaxation in writing.')",
    ),
    "instrument_conflict": (
        f"concat('Instruments differ on ', {_E('check')})",
        f"transform(from_json({_E('sources')}, 'array<struct<doc:string,clause:string,required:string>>'), s -> named_struct('label',"
        " concat(s.doc, ' clause ', s.clause), 'description', concat('Requires ', s.required), 'outcome', cast(null as string)))",
        "cast(null as string)",
        f"concat({_E('n_sources')}, ' instruments give different values for ', {_E('check')}, '; all are kept on record.')",
    ),
    "practice_divergence": (
        f"concat('Office practice differs for ', {_E('rule_id')})",
        _readings(("'Written rule'", "'Met as drawn.'", "'pass'"), ("'Office practice'", "'Objections were raised before.'", "'risk'")),
        "'Office practice'",
        f"concat({_E('rule_id')}, ' is met on paper, yet ', {_E('prior_cases')}, ' earlier case(s) drew an objection.')",
    ),
}


def dossiers(triggers: DataFrame, plots: DataFrame, floors: DataFrame, cap: str = "1.0D", narrate=None) -> DataFrame:
    """Title, readings, safer reading and a paragraph that uses only ``evidence`` and
    the computed ratios. ``narrate`` may replace the wording: a UDF over the facts struct.
    """
    far = far_readings(plots, floors, cap).drop("plot", "n_upper")
    x = triggers.join(spread(far), "model_id", "left").withColumn(
        "_t", F.expr("case when evidence['source'] = 'low_confidence_label' then 'confirm' else ambiguity_class end")
    )

    def pick(i: int) -> Column:
        arms = " ".join(f"when '{k}' then {t[i]}" for k, t in _TEMPLATES.items())
        return F.expr(f"case _t {arms} end")

    text = pick(3) if narrate is None else narrate(F.struct("evidence", "far_excl", "far_incl", "excess_excl", "excess_incl"))
    return x.select(
        "model_id", "ambiguity_class", "rule_id", pick(0).alias("title"), pick(1).alias("readings"), pick(2).alias("safer_reading"),
        text.alias("paragraph"), (F.col("_t") == "confirm").alias("is_confirmation_flag"), "evidence",
    )
