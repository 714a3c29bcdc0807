import hashlib
import json

from pyspark.sql import functions as F

from parapet.functions import text as t
from parapet.operators import cases, running
from parapet.sources import readers
from parapet.streaming import jobs


def test_manifest_digest(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.pdf").write_bytes(b"alpha")
    docs = [{"doc_id": "a", "raw_path": "raw/a.pdf", "sha256": hashlib.sha256(b"alpha").hexdigest()}, {"doc_id": "b", "title": "B", "raw_path": "raw/b.pdf", "sha256": "0"}]
    (tmp_path / "m.json").write_text(json.dumps({"documents": docs}))
    m = readers.read_manifest(spark, str(tmp_path / "m.json"))
    assert {r.doc_id: r.title for r in m.collect()} == {"a": "a", "b": "B"}
    assert [r.doc_id for r in readers.verify_manifest(m, str(tmp_path / "raw")).collect()] == ["b"]


def test_layer_and_clauses(spark, tmp_path):
    f = {"features": [{"properties": {"n": "x"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}
    (tmp_path / "zone.geojson").write_text(json.dumps(f))
    r = readers.read_layer(spark, str(tmp_path / "zone.geojson")).first()
    assert (r.layer, r.pos, r.props, len(r.ring)) == ("zone", 0, {"n": "x"}, 4)
    (tmp_path / "c.jsonl").write_text('{"clause_id":"d:1","number":"1","page":3}\n')
    assert readers.read_clauses(spark, str(tmp_path / "c.jsonl")).first().page == 3


def test_running_equals_plain_window(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id as pos", "case when id % 17 = 0 then id end as v")
    got = {(r.k, r.pos): (r.s, r.last) for r in running.running(df, ["k"], "pos", sums={"s": "pos"}, lasts={"last": "v"}, block=37).collect()}
    for k in range(3):
        s, last = 0, None
        for p in range(k, 1000, 3):
            s, last = s + p, p if p % 17 == 0 else last
            assert got[(k, p)] == (s, last)


def test_dimension_tokens(spark):
    text = "38'-6\" x 19'-6\" and 3'-101\" x 8'-6\""
    m = spark.createDataFrame([(text,)], "s string").select(F.expr(t.feet_inches_all("s"))).first()[0]
    assert [round(x, 4) for x in m] == [11.7348, 5.9436, 2.5908]


def test_mutation_goldens(spark):
    from parapet.functions import geometry as g

    base = spark.range(1).selectExpr("'m1' as case_id", g.rect_ring(0, 0, 10, 8) + " as points")
    r = cases.mutation_truth(base, "offset_edge", "north", 1.2).first()
    assert (r.area_before, round(r.area_after, 9)) == (80.0, 92.0)


def test_issue_counts_stream_equals_batch(spark, tmp_path):
    src = spark.range(400).selectExpr("timestamp_seconds(1700000000 + id * 60) as ts", "case when id % 2 = 0 then 'GMADA' else 'UNKNOWN' end as authority", "case when id % 3 = 0 then 'pass' else 'violation' end as status")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = jobs.issue_counts_per_hour(stream).writeStream.format("memory").queryName("issues").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.hour, r.authority)
    assert sorted(spark.table("issues").collect(), key=key) == sorted(jobs.issue_counts_per_hour(src).collect(), key=key)


def test_submission_stream_checks(spark, tmp_path):
    from conftest import golden

    from parapet.sources.packs import read_packs

    (tmp_path / "in").mkdir()
    rows = [{"submission_id": f"s{i}", "ts": "2024-01-01T00:00:00Z", **m} for i, m in enumerate(golden()[:2])]
    rows.append(rows[0])
    rows.append({"submission_id": "bad", "ts": "2024-01-01T00:00:00Z", **golden()[0], "model_id": 99, "source": "fax"})
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    seen = {}

    def sink(df, batch_id):
        seen[batch_id] = df.groupBy("model_id").count().collect()

    refused = []

    def rejects(df, batch_id):
        refused.extend(r.model_id for r in df.select("model_id").distinct().collect())

    q = jobs.stream_checks(jobs.read_submissions(spark, str(tmp_path / "in")), read_packs(spark), sink, rejects, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert {r.model_id: r["count"] for b in seen.values() for r in b} == {2: 21, 4: 24}
    assert refused == [99]


def test_parse_steps_on_broken_bodies(spark):
    raw = spark.createDataFrame([("a", '{"model_id": 1, "source": "dxf"}'), ("b", '{"model_id": 2'), ("c", None), ("d", "")], "file string, body string")
    models, rejected = readers.parse_models(raw)
    assert [(r.file, r.model_id) for r in models.collect()] == [("a", 1)] and {r.file for r in rejected.collect()} == {"b", "c", "d"}
    one = '[{"clause_id": "x:1", "verdict": "match"}, {"clause_id": "x:2", "verdict": "mismatch"}]'
    passes = spark.createDataFrame([(one,), (None,), ('{"clause_id": "y:1"}',), ("[]",)], "body string")
    assert [(r.clause_id, r.verdict) for r in readers.parse_pass(passes).orderBy("clause_id").collect()] == [("x:1", "match"), ("x:2", "mismatch"), ("y:1", None)]
    lines = spark.createDataFrame([('{"clause_id": "d:1", "page": 3}',), ("",), (None,)], "value string")
    assert [(r.clause_id, r.page) for r in readers.parse_clauses(lines).collect()] == [("d:1", 3)]
    gone = readers.mismatches(readers.parse_manifest(spark.createDataFrame([('{"documents": [{"doc_id": "a", "raw_path": "raw/a", "sha256": "0"}]}',), (None,)], "body string")), spark.createDataFrame([], "path string, content binary"))
    assert [(r.doc_id, r.actual_sha256) for r in gone.collect()] == [("a", None)]
