"""Bounded samples of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(keyed: DataFrame, docs: DataFrame, per_class: int, most_chars: int) -> list[tuple[str, str]]:
    """(class, text) of at most ``per_class`` documents of each class, in an order that depends on
    ids only.

    ``keyed`` has (doc_id, class). Ids are dealt to ``per_class`` slots by hash and the least hash of
    each slot is taken, so the choice is one partial aggregate however uneven the classes are.
    Documents of more than ``most_chars`` characters are not used for fitting.
    """
    h = F.xxhash64("doc_id")
    picks = keyed.groupBy("class", F.pmod(h, F.lit(per_class)).alias("slot")).agg(F.min(F.struct(h.alias("h"), "doc_id")).alias("p")).select("class", "p.h", "p.doc_id").collect()
    if not picks:
        return []
    ids = {r["doc_id"]: (r["class"], r["h"]) for r in picks}
    wanted = docs.filter(F.col("doc_id").isin(list(ids)) & (F.length("text") <= most_chars) & (F.length("text") > 0))
    rows = wanted.groupBy("doc_id").agg(F.max("text").alias("text")).collect()
    got = sorted((ids[r["doc_id"]][1], r["doc_id"], r["text"]) for r in rows)
    return [(ids[i][0], t) for _, i, t in got]
