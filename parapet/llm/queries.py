"""Registered queries of this subpackage, and the DuckDB SQL that must agree where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parapet.llm import bpe, decontaminate, language, licenses, merkle, mixing, neardup, pages, passages, phrases, secrets, topk, toxicity
from parapet.llm import merkle_sql
from parapet.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


@query("op1_decontaminate")
def op1(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_secrets")
def op2(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op3_mixing")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mixed(docs, table(spark, sf_dir, "labels")).drop("text")


@query("op4_toxicity")
def op4(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_licenses")
def op5(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op6_neardup")
def op6(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


@query("op7_language")
def op7(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query("op8_passages")
def op8(spark, sf_dir):
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query(
    "op9_topk",
    """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, c -> CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, c -> c IS NULL OR isnan(c) OR isinf(c))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
)
def op9(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


@query("op10_main_text")
def op10(spark, sf_dir):
    return pages.main_text(table(spark, sf_dir, "pages"))


@query(
    "op11_phrases",
    f"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\\x0A-\\x0D]')) AS p
  FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM piece),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
place AS (SELECT lang, w, unnest(range(len(w))) AS i FROM words),
f AS (
  {" UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(w[i + 1 : i + {k}], ' ') AS g, count(*) AS f FROM place WHERE i + {k} <= len(w) GROUP BY ALL HAVING count(*) >= 100" for k in range(1, 6))}),
cand AS (SELECT *, string_split(g, ' ') AS w FROM f WHERE k > 1),
inner_ AS (
  SELECT lang, array_to_string(w[s.i + 1 : s.i + s.m], ' ') AS g, max(f) AS f
  FROM cand, (SELECT m.range AS m, i.range AS i FROM range(2, 5) m, range(4) i) s
  WHERE s.m < k AND s.i + s.m <= k GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN inner_ i USING (lang, g) WHERE i.f IS NULL OR i.f < c.f),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, x.range AS cut, l.f AS l, r.f AS r, t.n,
         CAST((1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM kept c, range(1, 5) x, total t, f l, f r
  WHERE x.range < c.k AND t.lang = c.lang AND l.lang = c.lang AND r.lang = c.lang
    AND l.g = array_to_string(c.w[1 : x.range], ' ') AND r.g = array_to_string(c.w[x.range + 1 :], ' ')),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1)
SELECT lang, CAST(row_number() OVER w AS INTEGER) AS rank, g AS phrase, a, l, r, n, score FROM low
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, g) QUALIFY rank <= 2000
""",
)
def op11(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op12_bpe")
def op12(spark, sf_dir):
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op13_merkle", merkle_sql.proofs())
def op13(spark, sf_dir):
    return merkle.proofs(table(spark, sf_dir, "documents")).drop("siblings")
