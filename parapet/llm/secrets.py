"""Secret scan with multipart credential linking.

One pass over the documents, without a shuffle: each text is scanned for strong secrets by pattern,
and for the parts of a split credential - an access identifier, a secret value, an endpoint. Parts of
one scope are joined by interval: a weak part is reported only when the complementary parts it needs
stand in the same scope (a run of lines without a blank line), with a gap under ``reach`` characters
between the two if it is given.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from parapet.llm.common import map_batches

#: The base patterns and their least lengths, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "identifier", "value", "endpoint")
RANK = {k: i for i, k in enumerate(KINDS)}

#: Weak parts: each alone is ordinary text, only a combination is a credential.
IDENTIFIER = re.compile(r"""\b(?:client_?id|access_?key_?id|user(?:name)?|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.IGNORECASE | re.ASCII)
VALUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}", re.ASCII)
ENDPOINT = re.compile(r"(?:(?:https?|jdbc:\w+|amqps?|postgres(?:ql)?|mysql|redis|mongodb|s3)://[^\s\"'<>]+|\bhost(?:name)?[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{3,})", re.IGNORECASE | re.ASCII)
_BLANK = re.compile(r"\n[ \t\r]*\n")

#: widest gap between linked parts; by default the scope alone bounds a link
REACH = None

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Strong secrets: leftmost, non-overlapping per kind."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], RANK[s[0]]))


def linked_parts(text: str, base: list[Span], reach: int | None = REACH) -> list[Span]:
    """Weak parts whose complements lie in the same scope, less than ``reach`` characters apart.

    An identifier needs a secret near it; a value needs an identifier near it; an endpoint needs an
    identifier and a secret. Strong secrets count as secrets, strong access ids as identifiers.
    """
    low = text.lower()
    ids = [("identifier", m.start(), m.end()) for m in IDENTIFIER.finditer(text)] if (":" in text or "=" in text) and any(w in low for w in ("id", "user", "login", "account")) else []
    ids_all = sorted([s for s in base if s[0] == "access"] + ids, key=lambda s: s[1])
    if not ids_all:
        return []
    taken = sorted((s, e) for _, s, e in base)
    furthest = list(accumulate((e for _, e in taken), max))
    free = lambda s, e: not ((k := bisect_left(taken, (e,))) and furthest[k - 1] > s)
    values = [("value", m.start(), m.end()) for m in VALUE.finditer(text) if free(m.start(), m.end())]
    secrets = sorted([s for s in base if s[0] != "access"] + values, key=lambda s: s[1])
    if not secrets:
        return []
    cuts = [m.start() for m in _BLANK.finditer(text)]
    near_id, near_secret = _index(ids_all, cuts), _index(secrets, cuts)
    found = [s for s in ids if near_secret(s, reach)] + [s for s in values if near_id(s, reach)]
    found += [s for m in ENDPOINT.finditer(text) if near_id(s := ("endpoint", m.start(), m.end()), reach) and near_secret(s, reach)]
    return found


def _index(parts: list[Span], cuts: list[int]):
    """A test for a part within reach in the scope of a span, other than the span itself."""
    starts = [s for _, s, _ in parts]
    furthest = list(accumulate((e for _, _, e in parts), max))

    def near(span: Span, reach: int | None) -> bool:
        _, s, e = span
        k = bisect_right(cuts, s)
        lo, hi = cuts[k - 1] if k else -1, cuts[k] if k < len(cuts) else 1 << 62
        if reach is not None:
            lo, hi = max(s - reach, lo), min(e + reach, hi)
        i, j = bisect_left(starts, s), bisect_left(starts, hi)
        # a part before it in its scope ends beyond lo, or one starts from s on
        return (i > 0 and furthest[i - 1] > lo) or any(parts[x] != span for x in range(i, min(j, i + 2)))

    return near


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_text(text: str | None, reach: int | None = REACH) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by start and kind."""
    if not text:
        return [], []
    base = base_spans(text)
    parts = linked_parts(text, base, reach)
    return base, sorted(base + parts, key=lambda s: (s[1], RANK[s[0]], s[2])) if parts else base


SCAN_SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_linked bigint"


def scan(docs: DataFrame, reach: int | None = REACH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text has no span, counts of 0 and the digest of the empty string; a null doc_id
    stays null; repeated rows give repeated results; no rows give no rows. Offsets are code points,
    end exclusive.
    """

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(6)]
        for t in b.column("text"):
            base, full = scan_text(t.as_py(), reach)
            kinds = [k for k, _, _ in base]
            row = (kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(written(base).encode()).hexdigest(), written(full), len(full) - len(base))
            for o, v in zip(out, row, strict=True):
                o.append(v)
        i64 = pa.int64()
        kinds_of = (i64, i64, i64, pa.string(), pa.string(), i64)
        return pa.RecordBatch.from_arrays([b.column("doc_id").cast(i64), *[pa.array(o, t) for o, t in zip(out, kinds_of, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    return map_batches(docs.select("doc_id", "text"), fn, SCAN_SCHEMA)


MASK = {k: f"<{k}>" for k in KINDS}


def redact_text(text: str | None, reach: int | None = REACH) -> str | None:
    """Replace every span by a mask of its kind; overlapping spans become one mask of the first."""
    if not text:
        return text
    _, spans = scan_text(text, reach)
    out, at = [], 0
    for k, s, e in spans:
        if s >= at:
            out += [text[at:s], MASK[k]]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, reach: int | None = REACH) -> DataFrame:
    """``docs`` with the spans of its texts masked; every row and column stays."""
    schema = docs.schema

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        i = b.schema.get_field_index("text")
        texts = pa.array([redact_text(t.as_py(), reach) for t in b.column(i)], pa.string())
        return pa.RecordBatch.from_arrays([texts if k == i else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return map_batches(docs, fn, schema)
