"""Queries for the sources: the parse steps over text columns derived from the parquet tables
and drawing-primitive tables (A11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parapet.catalog.base import query
from parapet.catalog.corpus import LINES, clauses
from parapet.sources import derived as d
from parapet.sources import readers as r


@query("A01_parse_models", "SELECT o_orderkey::VARCHAR AS file, o_orderkey % 11 <> 0 AS parsed, CASE WHEN o_orderkey % 11 <> 0 THEN 2::BIGINT END AS n_floors, CASE WHEN o_orderkey % 11 <> 0 THEN 1::BIGINT END AS n_edges FROM orders")
def a01(spark, sf_dir):
    """Every eleventh document is cut short."""
    m = d.nested_models(spark, sf_dir)
    whole = F.to_json(F.struct(*m.columns))
    body = F.when(F.col("model_id") % 11 == 0, F.expr("left(body, length(body) - 1)")).otherwise(F.col("body"))
    models, rejected = r.parse_models(m.select(F.col("model_id").cast("string").alias("file"), "model_id", whole.alias("body")).select("file", body.alias("body")))
    good = models.select("file", F.lit(True).alias("parsed"), F.size("floors").cast("bigint").alias("n_floors"), F.size("edges").cast("bigint").alias("n_edges"))
    none = F.lit(None).cast("bigint")
    return good.union(rejected.select("file", F.lit(False), none, none))


@query("A06_parse_clauses", f"WITH {LINES} SELECT clause_id, number, heading, text FROM clauses")
def a06(spark, sf_dir):
    c = clauses(spark, sf_dir).select("clause_id", "number", "heading", "text")
    return r.parse_clauses(c.select(F.to_json(F.struct(*c.columns)).alias("value"))).select(*c.columns)


def _manifest(spark, sf_dir):
    docs = d.load(spark, sf_dir, "documents")
    name = F.col("doc_id").cast("string")
    changed = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    entry = F.struct(
        name.alias("doc_id"),
        F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("title"),
        F.concat(F.lit("raw/"), name, F.lit(".txt")).alias("raw_path"),
        F.sha2(F.coalesce(changed, F.lit("")).cast("binary"), 256).alias("sha256"),
    )
    return r.parse_manifest(docs.select(F.to_json(F.struct(F.array(entry).alias("documents"))).alias("body")))


@query("A07_digest_mismatch", """
SELECT * FROM (SELECT doc_id::VARCHAR AS doc_id, sha256(coalesce(CASE WHEN doc_id % 10 = 3 THEN text || 'x' ELSE text END, '')) AS sha256,
  CASE WHEN doc_id % 25 <> 7 AND text IS NOT NULL THEN sha256(text) END AS actual_sha256 FROM documents) WHERE actual_sha256 IS NULL OR actual_sha256 <> sha256""")
def a07(spark, sf_dir):
    """One text in ten has changed since it was recorded, one in 25 is absent."""
    docs = d.load(spark, sf_dir, "documents").filter("doc_id % 25 <> 7 and text is not null")
    files = docs.select(F.concat(F.lit("raw/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    return r.mismatches(_manifest(spark, sf_dir), files)


@query("A08_manifest_titles", "SELECT doc_id::VARCHAR AS doc_id, coalesce(CASE WHEN doc_id % 4 <> 0 THEN source END, doc_id::VARCHAR) AS title FROM documents")
def a08(spark, sf_dir):
    return _manifest(spark, sf_dir).select("doc_id", "title")


@query("A09_recorded_pass", """
SELECT l_orderkey || ':' || l_linenumber AS clause_id, l_returnflag || l_linestatus AS proposed_rule_key, CASE WHEN l_quantity > 25 THEN 'match' ELSE 'mismatch' END AS verdict, CASE WHEN l_linenumber = 1 THEN l_returnflag END AS note FROM lineitem""")
def a09(spark, sf_dir):
    """A pass of one record for each line, an array a record."""
    rec = F.expr("""named_struct('clause_id', concat(l_orderkey, ':', l_linenumber), 'proposed_rule_key', concat(l_returnflag, l_linestatus),
      'verdict', if(l_quantity > 25, 'match', 'mismatch'), 'note', if(l_linenumber = 1, l_returnflag, null))""")
    return r.parse_pass(d.load(spark, sf_dir, "lineitem").select(F.to_json(F.array(rec)).alias("body")))


@query("A10_parse_layer", """
SELECT 'zone' || c_custkey AS layer, unnest([0, 1]) AS pos, unnest([c_name, c_name || 'b']) AS name, unnest([4, 5])::BIGINT AS n_points FROM customer""")
def a10(spark, sf_dir):
    """A layer of a triangle and a square for each customer."""
    ring = lambda *p: "[[" + ",".join(f"[{x},{y}]" for x, y in p) + "]]"
    shapes = ("", ring((0, 0), (1, 0), (1, 1), (0, 0))), ("b", ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))
    feature = [F.concat(F.lit('{"properties":{"name":"'), F.col("c_name"), F.lit(f'{end}"}},"geometry":{{"type":"Polygon","coordinates":{x}}}}}')) for end, x in shapes]
    raw = d.load(spark, sf_dir, "customer").select(F.concat(F.lit("layers/zone"), "c_custkey", F.lit(".geojson")).alias("file"), F.concat(F.lit('{"features":['), feature[0], F.lit(","), feature[1], F.lit("]}")).alias("body"))
    return r.parse_layer(raw).select("layer", "pos", F.col("props")["name"].alias("name"), F.size("ring").cast("bigint").alias("n_points"))


@query("A11_primitives", "SELECT sheet, count(*) AS n_dims, max(0.125::DOUBLE * l_quantity) AS longest FROM (SELECT l_orderkey AS sheet, l_quantity FROM lineitem) GROUP BY 1")
def a11(spark, sf_dir):
    return d.dxf_dimensions(spark, sf_dir).groupBy("sheet").agg(F.count("*").alias("n_dims"), F.max("measurement").alias("longest"))
