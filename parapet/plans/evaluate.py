"""Every rule for every model in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.operators import checks as c
from parapet.operators.normalise import resolve_pack
from parapet.session import cut_lineage


def union_checks(*findings: DataFrame) -> DataFrame:
    """Union of heterogeneous check outputs by column name."""
    return reduce(lambda a, b: a.unionByName(b), findings)


def evaluate(tables: dict[str, DataFrame], rules: DataFrame, keys=("model_id",), materialise: bool = False) -> DataFrame:
    """All findings of all models. A plot whose pack is unknown gets one blocking finding.

    With ``keys=("model_id", "cand_seq")`` the same plan re-checks repair candidates. With
    ``materialise`` the per-model facts are written once to the checkpoint folder instead of being
    recomputed by the branches that read them; worth it on large inputs.
    """
    keys = list(keys)
    plots, lost = resolve_pack(tables["plots"], rules)
    tables = tables | {"plots": plots.withColumn("rule_pack", F.col("pack")).drop("pack")}
    facts = c.build_facts(tables, keys)
    if materialise:
        facts.header = cut_lineage(facts.header)
        facts.light = facts.header
    return union_checks(
        c.model_level(facts, rules),
        c.floor_level(facts, rules),
        c.projection_level(facts, rules),
        c.courtyard_level(facts, rules),
        c.room_height_level(facts, rules),
        c.room_level(facts, rules),
        c.conflict_findings(tables["plots"], rules, keys),
        c.unknown_authority(tables["plots"], rules, keys),
        c.unresolved_pack(lost, keys),
    )
