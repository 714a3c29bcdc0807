"""Clause corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parapet.functions import text as t
from parapet.operators.running import running
from parapet.session import spread

# White space as the clause patterns mean it, and the patterns themselves.
WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STRIP = rf"^[{WS}]+|[{WS}]+$"
CLAUSE_LINE = rf"^([0-9]{{1,3}})\.[{WS}]+([^{WS}][^\n]*)$"
NUMBER_LINE = rf"^([0-9]{{1,3}})\.[{WS}]*$"
PART_LINE = rf"(?i)^PART[{WS}]+([IVX]+)\b"
SUB_LINE = rf"^([0-9]{{1,2}}\.[0-9]{{1,2}}(\.[0-9]{{1,2}})?)[{WS}]+([^{WS}][^\n]*)$"
SUB_NUMBER = rf"^([0-9]{{1,2}}\.[0-9]{{1,2}}(\.[0-9]{{1,2}})?)[{WS}]*$"
MAX_SUB_SEGMENT = 20
VERDICT_TO_STATUS = {"match": "verified", "mismatch": "conflict", "not_stated": "seed_unverified"}


def strip(e: str) -> str:
    return f"regexp_replace({e}, r'{STRIP}', '')"


def split_lines(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, page, text)`` -> non-blank lines with a position that is dense inside the page.

    ``pos`` = page * 2**32 + index keeps reading order without a window; an index is below 2**31.
    """
    lines = f"filter(transform(split(text, '\\n'), sl -> {strip('sl')}), sl -> sl <> '')"
    return pages.select(
        "doc_id", "page", F.expr(t.ocr_required("text")).alias("ocr"), F.posexplode(F.expr(lines)).alias("_i", "line")
    ).selectExpr("doc_id", "cast(page as bigint) * 4294967296 + _i as pos", "page", "ocr", "line")


def _neighbours(lines: DataFrame) -> DataFrame:
    """Previous and next line of each line, by window inside blocks of positions.

    The line order is (doc_id, pos); ``seq`` numbers the lines of a document densely first.
    """
    seq = running(lines, ["doc_id"], "pos", sums={"seq": "1"})
    near = seq.select("doc_id", F.col("seq").alias("_n"), F.col("line").alias("_line"))
    nxt = near.select("doc_id", (F.col("_n") - 1).alias("seq"), F.col("_line").alias("next_line"))
    prv = near.select("doc_id", (F.col("_n") + 1).alias("seq"), F.col("_line").alias("prev_line"))
    return seq.join(spread(nxt), ["doc_id", "seq"], "left").join(spread(prv), ["doc_id", "seq"], "left")


def chunk_clauses(lines: DataFrame) -> DataFrame:
    """G1: lines -> clauses. A marker is ``N. text``, or a bare ``N.`` whose heading is the next line.

    A clause carries the last PART heading seen before the next marker. Repeats are numbered by
    :func:`number_repeats`.
    """
    num = lambda c: f"coalesce({c} rlike r'{NUMBER_LINE}', false)"
    x = _neighbours(lines).withColumn("_taken", F.expr(f"{num('prev_line')} and not {num('line')}"))
    x = x.withColumn("_part", F.expr(f"not _taken and line rlike r'{PART_LINE}'"))
    x = x.withColumn("_full", F.expr(f"not _taken and not _part and line rlike r'{CLAUSE_LINE}'"))
    x = x.withColumn("_bare", F.expr(f"{num('line')} and next_line is not null and not {num('next_line')}"))
    x = x.withColumn("_mark", F.expr("_full or _bare")).withColumn(
        "_rest", F.expr(f"case when _full then regexp_extract(line, r'{CLAUSE_LINE}', 2) when _bare then next_line end")
    )
    part = f"case when _part then concat('PART ', regexp_extract(line, r'{PART_LINE}', 1)) end"
    x = running(x, ["doc_id"], "seq", sums={"clause_seq": "cast(_mark as int)"}, lasts={"part": part})
    x = x.filter("clause_seq > 0").withColumn("_piece", F.expr("case when _full then _rest when _bare then null else line end"))
    c = x.groupBy("doc_id", "clause_seq").agg(
        F.expr(f"max(case when _mark then regexp_extract(line, r'^([0-9]+)', 1) end)").alias("number"),
        F.expr("max(case when _mark then _rest end)").alias("_rest"),
        F.expr("max(case when _mark then page end)").alias("page"),
        F.bool_or("ocr").alias("ocr"),
        F.max_by("part", "seq").alias("part"),
        F.expr("array_join(transform(array_sort(collect_list(case when _piece is not null then struct(seq, _piece) end)), p -> p._piece), ' ')").alias("text"),
    )
    heading = f"rtrim('.:', {strip('split(_rest, r' + chr(39) + '[–—-]' + chr(39) + ', 2)[0]')})"
    return c.selectExpr("doc_id", "clause_seq", "number", f"{heading} as heading", f"{strip('text')} as text", "page", "ocr", "part")


def number_repeats(clauses: DataFrame) -> DataFrame:
    """Second and later uses of a number become ``N#2``, ``N#3`` ... and are anomalies."""
    x = running(clauses, ["doc_id", "number"], "clause_seq", sums={"occurrence": "1"})
    tag = "case when occurrence = 1 then number else concat(number, '#', occurrence) end"
    return x.withColumnRenamed("number", "base_number").withColumn("number", F.expr(tag.replace("number", "base_number"))).withColumn(
        "clause_id", F.expr("concat(doc_id, ':', number)")
    )


def numbering_gaps(clauses: DataFrame, number: str = "number") -> DataFrame:
    """Skips forward over distinct numbers in first-seen order; at most 999 numbers per document."""
    first = clauses.groupBy("doc_id", F.col(number).cast("int").alias("n")).agg(F.min("clause_seq").alias("seq"))
    w = Window.partitionBy("doc_id").orderBy("seq")
    x = first.withColumn("after", F.lag("n").over(w))
    return x.filter("n <> after + 1 and n >= after").selectExpr("doc_id", "after as clause_before", "n as clause_after", "after + 1 as expected")


def locate_headings(docs: DataFrame, headings: list[tuple[str, str]]) -> DataFrame:
    """Start line of each known top heading, found in order by a spacing-insensitive search.

    ``docs(doc_id, lines array<string>)``; ``headings`` is a fixed list of (number, title).
    """
    hs = ", ".join(
        f"named_struct('num', '{n}', 'title', '{h}', 'key', {t.norm_key(repr((h if not n[0].isdigit() else n + h)))})" for n, h in headings
    )
    x = docs.select(
        "doc_id",
        F.expr(f"transform(lines, hl -> {t.norm_key('hl')})").alias("_norm"),
    ).selectExpr("doc_id", "array_join(_norm, '') as _joined",
                 "transform(sequence(0, size(_norm)), hc -> length(array_join(slice(_norm, 1, hc), ''))) as _cum")
    step = (
        "(ha, hh) -> transform(array(locate(hh.key, _joined, ha.at)), hp -> case when hp = 0 then ha else named_struct('at', hp + 1,"
        " 'found', concat(ha.found, array(named_struct('num', hh.num, 'title', hh.title, 'off', hp - 1)))) end)[0]"
    )
    zero = "named_struct('at', 1, 'found', cast(array() as array<struct<num:string,title:string,off:int>>))"
    x = x.selectExpr("doc_id", "_cum", f"aggregate(array({hs}), {zero}, {step}).found as _found")
    return x.selectExpr("doc_id", "_cum", "inline(_found)").selectExpr(
        "doc_id", "num", "title", "size(filter(_cum, hk -> hk <= off)) - 1 as start"
    )


def chunk_two_level(docs: DataFrame, headings: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Top sections by known heading, dotted sub-clauses inside their own section.

    ``docs(doc_id, lines)`` holds the stripped non-blank lines of the body, one row per document.
    Returns (clauses, rejected). A sub-number of another section, or with a segment over 20 (a table
    value), is no clause; the latter is reported.
    """
    lines = docs.select("doc_id", F.posexplode("lines").alias("pos", "line"))
    nxt = lines.selectExpr("doc_id", "pos - 1 as pos", "line as next_line")
    tops = locate_headings(docs, headings).groupBy("doc_id", F.col("start").alias("pos")).agg(
        F.max_by(F.struct("num", "title"), F.length("title")).alias("top")
    )
    x = lines.join(spread(nxt), ["doc_id", "pos"], "left").join(spread(tops), ["doc_id", "pos"], "left")
    x = running(x, ["doc_id"], "pos", lasts={"section": "top.num"})
    # The heading of a bare sub-number must lie in the same section: a following top heading is not it.
    nxt_top = tops.selectExpr("doc_id", "pos - 1 as pos", "true as next_is_top")
    x = x.join(spread(nxt_top), ["doc_id", "pos"], "left")
    sub = (
        f"case when line rlike r'{SUB_LINE}' then named_struct('num', regexp_extract(line, r'{SUB_LINE}', 1), 'title', regexp_extract(line, r'{SUB_LINE}', 3))"
        f" when line rlike r'{SUB_NUMBER}' and next_line is not null and next_is_top is null and not next_line rlike r'{SUB_NUMBER}'"
        f" and not next_line rlike r'{SUB_LINE}' then named_struct('num', regexp_extract(line, r'{SUB_NUMBER}', 1), 'title', next_line) end"
    )
    x = x.withColumn("sub", F.expr(sub)).withColumn("own", F.expr("split(sub.num, '\\\\.')[0] = section and not startswith(section, 'annexure')"))
    x = x.withColumn("sane", F.expr(f"forall(slice(split(sub.num, '\\\\.'), 2, 3), s -> cast(s as int) <= {MAX_SUB_SEGMENT})"))
    rejected = x.filter("sub is not null and own and not sane").selectExpr("doc_id", "pos", "sub.num as number")
    x = x.withColumn("start", F.expr("case when sub is not null and own and sane then sub else top end"))
    x = running(x, ["doc_id"], "pos", sums={"clause_seq": "cast(start is not null as int)"}).filter("clause_seq > 0")
    c = x.groupBy("doc_id", "clause_seq").agg(
        F.expr("max_by(start, pos) filter (where start is not null)").alias("s"),
        F.expr("min_by(top is not null and start.num = top.num, pos)").alias("is_top"),
        F.expr("array_join(transform(array_sort(collect_list(struct(pos, line))), p -> p.line), ' ')").alias("text"),
    )
    tidy = strip("rtrim(':-.', " + strip("s.title") + ")")
    c = c.selectExpr("doc_id", "clause_seq", "s.num as number", f"case when is_top then s.title else {tidy} end as heading", "text")
    return number_repeats(c), rejected


def rule_refs(rules: DataFrame) -> DataFrame:
    """Clause ids cited by rules, from ``source`` and ``superseded_source``."""
    ids = "array_compact(array(concat(r.source.doc, ':', r.source.clause), concat(r.superseded_source.doc, ':', r.superseded_source.clause)))"
    return rules.select(F.explode(F.expr(ids)).alias("clause_id")).distinct()


def orphans(clauses: DataFrame, refs: DataFrame) -> DataFrame:
    """Clauses with a measurement that no rule cites."""
    return clauses.filter(t.has_numeric("text")).join(spread(refs.select("clause_id").distinct()), "clause_id", "left_anti")


def cited_existing(clauses: DataFrame, refs: DataFrame) -> DataFrame:
    """I3."""
    return clauses.select("clause_id").intersect(refs.select("clause_id"))


def rule_coverage(clauses: DataFrame, refs: DataFrame) -> DataFrame:
    """per document cited, numeric and orphan clause counts, in one pass."""
    r = refs.select("clause_id").distinct().withColumn("cited", F.lit(True))
    x = clauses.select("doc_id", "clause_id", F.expr(t.has_numeric("text")).alias("num")).join(spread(r), "clause_id", "left")
    return x.groupBy("doc_id").agg(
        F.count_if("cited").alias("n_referenced"),
        F.count_if("num").alias("n_numeric"),
        F.count_if(F.expr("num and cited is null")).alias("n_orphans"),
    )


def extraction_health(pages: DataFrame, clauses: DataFrame, anomalies: DataFrame) -> DataFrame:
    """F8: one row per document."""
    p = pages.groupBy("doc_id").agg(
        F.count("*").alias("page_count"),
        F.expr(f"array_sort(collect_set(case when {t.ocr_required('text')} then page end))").alias("ocr_pages"),
    )
    c = clauses.groupBy("doc_id").agg(F.count("*").alias("clause_count"))
    a = anomalies.groupBy("doc_id").agg(F.count("*").alias("anomaly_count"))
    return (
        p.join(spread(c), "doc_id", "left")
        .join(spread(a), "doc_id", "left")
        .withColumn("clause_count", F.coalesce("clause_count", F.lit(0)))
        .withColumn("anomaly_count", F.coalesce("anomaly_count", F.lit(0)))
    )


def verdict_to_status(verdict: str = "verdict") -> str:
    return f"(case {verdict} " + " ".join(f"when '{k}' then '{v}'" for k, v in VERDICT_TO_STATUS.items()) + " end)"


_PAIR = ["clause_id", "proposed_rule_key"]


def status_of(proposed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Proposed facts with the status their verdict gives."""
    v = verdicts.select(*_PAIR, F.expr(verdict_to_status()).alias("rule_status"))
    return proposed.join(v, _PAIR)


def verdict_status(verdicts: DataFrame) -> DataFrame:
    """F10."""
    return verdicts.groupBy(F.expr(verdict_to_status()).alias("rule_status")).agg(F.count("*").alias("n"))


def audit_verified(rules: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rules marked verified whose clause has no ``match`` verdict; must be empty."""
    ok = verdicts.filter("verdict = 'match'").select("clause_id").distinct()
    return rules.filter("rule_status = 'verified'").join(ok, "clause_id", "left_anti")


def missing_clauses(requested: DataFrame, clauses: DataFrame) -> DataFrame:
    """Requested (doc_id, number) pairs that do not exist; must be empty."""
    return requested.join(spread(clauses.select("doc_id", "number").distinct()), ["doc_id", "number"], "left_anti")
