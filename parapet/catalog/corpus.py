"""Queries for the clause corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from parapet.catalog.base import query
from parapet.operators import corpus as c
from parapet.sources import derived as d

_N = "(1 + (i // 3) % 4) * (CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END)"
LINES = rf"""raw AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS ln, len(a) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
tagged AS (SELECT doc_id, i, CASE WHEN i % 10 = 9 THEN 'PART ' || repeat('I', CAST(1 + (i // 10) % 3 AS INT)) || ' ' || ln WHEN i % 12 = 6 THEN {_N} || '.' WHEN i % 3 = 0 THEN {_N} || '. ' || ln ELSE ln END
  || CASE WHEN i = k - 1 AND doc_id % 4 = 0 THEN ' 65 per cent' ELSE '' END || CASE WHEN i = k - 1 AND doc_id % 6 = 0 THEN ' may be permitted' ELSE '' END AS ln FROM raw),
lines0 AS (SELECT doc_id, i, regexp_replace(ln, '{c.STRIP}', '', 'g') AS line FROM tagged),
lines1 AS (SELECT doc_id, row_number() OVER w AS seq, line, lead(line) OVER w AS nx, lag(line) OVER w AS pv FROM lines0 WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
lines2 AS (SELECT *, coalesce(regexp_matches(pv, '{c.NUMBER_LINE}'), false) AND NOT regexp_matches(line, '{c.NUMBER_LINE}') AS taken, regexp_matches(line, '{c.NUMBER_LINE}') AND nx IS NOT NULL AND NOT regexp_matches(nx, '{c.NUMBER_LINE}') AS bare FROM lines1),
lines3 AS (SELECT *, NOT taken AND regexp_matches(line, '{c.PART_LINE}') AS part FROM lines2),
lines4 AS (SELECT *, NOT taken AND NOT part AND regexp_matches(line, '{c.CLAUSE_LINE}') AS full_ FROM lines3),
lines5 AS (SELECT *, sum(CASE WHEN full_ OR bare THEN 1 ELSE 0 END) OVER w AS cs, last_value(CASE WHEN part THEN 'PART ' || regexp_extract(line, '{c.PART_LINE}', 1) END IGNORE NULLS) OVER w AS cur FROM lines4
  WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
clauses0 AS (SELECT doc_id, CAST(cs AS BIGINT) AS clause_seq, arg_min(regexp_extract(line, '^[0-9]+'), seq) AS base_number, arg_min(CASE WHEN full_ THEN regexp_extract(line, '{c.CLAUSE_LINE}', 2) ELSE nx END, seq) AS rest, arg_max(coalesce(cur, ''), seq) AS part,
  regexp_replace(string_agg(CASE WHEN full_ THEN regexp_extract(line, '{c.CLAUSE_LINE}', 2) WHEN bare THEN NULL ELSE line END, ' ' ORDER BY seq), '{c.STRIP}', '', 'g') AS text FROM lines5 WHERE cs > 0 GROUP BY 1, 2),
clauses AS (SELECT *, doc_id || ':' || base_number || CASE WHEN occ > 1 THEN '#' || occ ELSE '' END AS clause_id, base_number || CASE WHEN occ > 1 THEN '#' || occ ELSE '' END AS number
  FROM (SELECT *, rtrim(regexp_replace(string_split_regex(rest, '[–—-]')[1], '{c.STRIP}', '', 'g'), '.:') AS heading, row_number() OVER (PARTITION BY doc_id, base_number ORDER BY clause_seq) AS occ FROM clauses0))"""


def _pages(spark, sf_dir):
    return d.clause_pages(spark, sf_dir)


def _chunks(spark, sf_dir):
    return c.chunk_clauses(c.split_lines(_pages(spark, sf_dir)))


def clauses(spark, sf_dir):
    return c.number_repeats(_chunks(spark, sf_dir))


def refs(cl):
    return cl.filter("cast(doc_id as bigint) % 3 = 0").select("clause_id")


@query("G01_chunk_clauses", f"WITH {LINES} SELECT CAST(doc_id AS VARCHAR) AS doc_id, clause_seq, base_number AS number, heading, text, nullif(part, '') AS part FROM clauses")
def g01(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "clause_seq", "number", "heading", "text", "part")


@query("G02_number_repeats", f"WITH {LINES} SELECT clause_id, number, CAST(occ AS BIGINT) AS occurrence FROM clauses")
def g02(spark, sf_dir):
    return clauses(spark, sf_dir).select("clause_id", "number", F.col("occurrence").cast("bigint"))


@query("G03_numbering_gaps", f"WITH {LINES}, f AS (SELECT doc_id, CAST(base_number AS INT) AS n, min(clause_seq) AS s FROM clauses GROUP BY 1, 2), g AS (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY s) AS a FROM f) SELECT CAST(doc_id AS VARCHAR) AS doc_id, a AS clause_before, n AS clause_after, a + 1 AS expected FROM g WHERE n <> a + 1 AND n >= a")
def g03(spark, sf_dir):
    return c.numbering_gaps(_chunks(spark, sf_dir))


@query("G04_chunk_two_level", """
SELECT p_partkey::VARCHAR AS doc_id, unnest(['1', '2', '2.1', '2.2', '2.1#2', 'annexure-1']) AS number, unnest(['TITLE AND SCOPE', 'DEFINITIONS', 'First item', 'Second', 'again', 'ANNEXURE 1']) AS heading,
  unnest(['1 T I T L E   AND SCOPE ' || p_name, '2. D E F I N I T I O N S', '2.1 First item: ' || p_type, '2.2 Second - 2.55 table row 9.1 stray', '2.1 again', 'ANNEXURE - 1 ' || p_brand]) AS text FROM part""")
def g04(spark, sf_dir):
    return c.chunk_two_level(d.sectioned_docs(spark, sf_dir), d.TOP_HEADINGS)[0].select("doc_id", "number", "heading", "text")


@query("G04_rejected", "SELECT p_partkey::VARCHAR AS doc_id, '2.55' AS number FROM part")
def g04r(spark, sf_dir):
    return c.chunk_two_level(d.sectioned_docs(spark, sf_dir), d.TOP_HEADINGS)[1].select("doc_id", "number")


_NUM = "regexp_matches(text, '(?i)[0-9]+(\\.[0-9]+)?\\s*(%|per\\s?cent|meter|metre|sq\\.?\\s?m|sqm|sq\\.?\\s?yd|storey|storeys)')"


@query("C05_orphans", f"WITH {LINES} SELECT clause_id FROM clauses WHERE {_NUM} AND doc_id % 3 <> 0")
def c05(spark, sf_dir):
    cl = clauses(spark, sf_dir)
    return c.orphans(cl, refs(cl)).select("clause_id")


@query("I03_cited_existing", f"WITH {LINES} SELECT clause_id FROM clauses WHERE doc_id % 3 = 0")
def i03(spark, sf_dir):
    cl = clauses(spark, sf_dir)
    return c.cited_existing(cl, refs(cl))


@query("F09_rule_coverage", f"WITH {LINES} SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) FILTER (WHERE doc_id % 3 = 0) AS n_referenced, count(*) FILTER (WHERE {_NUM}) AS n_numeric, count(*) FILTER (WHERE {_NUM} AND doc_id % 3 <> 0) AS n_orphans FROM clauses GROUP BY 1")
def f09(spark, sf_dir):
    cl = clauses(spark, sf_dir)
    return c.rule_coverage(cl, refs(cl))


@query("F08_extraction_health", f"WITH {LINES}, full_text AS (SELECT doc_id, string_agg(ln, chr(10) ORDER BY i) AS text FROM tagged GROUP BY 1) SELECT CAST(f.doc_id AS VARCHAR) AS doc_id, 1::BIGINT AS page_count, CASE WHEN length(trim(f.text)) < 40 THEN 1 ELSE 0 END AS n_ocr_pages, coalesce(k, 0) AS clause_count, coalesce(r, 0) AS anomaly_count FROM full_text f LEFT JOIN (SELECT doc_id, count(*) AS k, count(*) FILTER (WHERE occ > 1) AS r FROM clauses GROUP BY 1) c USING (doc_id)")
def f08(spark, sf_dir):
    cl = clauses(spark, sf_dir)
    h = c.extraction_health(_pages(spark, sf_dir), cl, cl.filter("occurrence > 1"))
    return h.selectExpr("doc_id", "page_count", "size(ocr_pages) as n_ocr_pages", "clause_count", "anomaly_count")


_VERDICT = "CASE WHEN quality = 1 THEN 'match' WHEN toxic = 1 THEN 'mismatch' ELSE 'not_stated' END"
_STATUS = f"CASE {_VERDICT} WHEN 'match' THEN 'verified' WHEN 'mismatch' THEN 'conflict' ELSE 'seed_unverified' END"


def _verdicts(spark, sf_dir):
    return d.load(spark, sf_dir, "labels").selectExpr(
        "cast(doc_id as string) as clause_id", "concat('k', doc_id % 3) as proposed_rule_key",
        "case when quality = 1 then 'match' when toxic = 1 then 'mismatch' else 'not_stated' end as verdict",
    )


def _proposed(spark, sf_dir):
    return d.load(spark, sf_dir, "documents").selectExpr(
        "cast(doc_id as string) as clause_id", "concat('k', doc_id % 3) as proposed_rule_key", "cast(n_chars as double) as value",
        "case when doc_id % 2 = 0 then 'verified' else 'seed_unverified' end as rule_status",
    )


@query("C06_audit_verified", f"SELECT doc_id::VARCHAR AS clause_id FROM documents d WHERE doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND {_VERDICT} = 'match')")
def c06(spark, sf_dir):
    return c.audit_verified(_proposed(spark, sf_dir), _verdicts(spark, sf_dir)).select("clause_id")


@query("C07_status_of", f"SELECT d.doc_id::VARCHAR AS clause_id, 'k' || (d.doc_id % 3) AS proposed_rule_key, n_chars::DOUBLE AS value, {_STATUS} AS rule_status FROM documents d JOIN labels l USING (doc_id)")
def c07(spark, sf_dir):
    return c.status_of(_proposed(spark, sf_dir).drop("rule_status"), _verdicts(spark, sf_dir))


@query("F10_verdict_status", f"SELECT {_STATUS} AS rule_status, count(*) AS n FROM labels GROUP BY 1")
def f10(spark, sf_dir):
    return c.verdict_status(_verdicts(spark, sf_dir))


@query("C08_missing_clauses", f"WITH {LINES} SELECT d.doc_id::VARCHAR AS doc_id, '4' AS number FROM documents d WHERE NOT EXISTS (SELECT 1 FROM clauses c WHERE c.doc_id = d.doc_id AND c.number = '4')")
def c08(spark, sf_dir):
    want = d.load(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) as doc_id", "'4' as number")
    return c.missing_clauses(want, clauses(spark, sf_dir))
