"""Batch twins of the streaming jobs (O2, O3); stream = batch is a unit test."""

from __future__ import annotations

from parapet.catalog.base import query
from parapet.catalog.sheets import _CORR, corrections
from parapet.sources import derived as d
from parapet.streaming import jobs

_STATUS = "CASE event_type WHEN 'click' THEN 'pass' WHEN 'error' THEN 'violation' ELSE 'unknown' END"


@query("O02_latest_corrections", f"WITH {_CORR} SELECT model_id, floor_level, room_index, max(seq) AS seq, arg_max(use, seq) FILTER (WHERE use IS NOT NULL) AS use, 'high' AS confidence FROM corr GROUP BY 1, 2, 3")
def o02(spark, sf_dir):
    return jobs.latest_corrections(corrections(spark, sf_dir))


def findings_events(df):
    return df.selectExpr("ts", "case user_id % 3 when 0 then 'GMADA' when 1 then 'CHANDIGARH' else 'UNKNOWN' end as authority", "case event_type when 'click' then 'pass' when 'error' then 'violation' else 'unknown' end as status")


@query("O03_issue_counts", f"SELECT date_trunc('hour', ts) AS hour, CASE user_id % 3 WHEN 0 THEN 'GMADA' WHEN 1 THEN 'CHANDIGARH' ELSE 'UNKNOWN' END AS authority, count(*) FILTER (WHERE {_STATUS} <> 'pass') AS n_issues, count(*) AS n_findings FROM events GROUP BY 1, 2")
def o03(spark, sf_dir):
    return jobs.issue_counts_per_hour(findings_events(d.load(spark, sf_dir, "events")))
