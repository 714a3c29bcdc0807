"""Language of code-switched text: a linear-chain conditional random field labels every word.

The field is fitted on the driver from a bounded sample of labelled documents (``PER_LANGUAGE`` each,
of at most ``MOST_CHARS`` characters); its sequences splice runs of different languages, so that the
transitions learn how rarely a text switches. Documents are then read whole, in one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm import crf
from parapet.llm.common import HELD_OUT_FOLD, fold, map_batches
from parapet.llm.sample import labelled_sample
from parapet.llm.words import ALNUM, text_buffers, word_slices

PER_LANGUAGE = 256
MOST_CHARS = 8_000
#: words taken from each sampled document, and the longest run of one language in a sequence
WORDS_PER_DOC = 96
RUN = 24
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], crf.Model] | None:
    """Languages and field, from text and lang of rows outside the held-out fold. None without any."""
    known = docs.select("doc_id", "text", F.col("lang").alias("class")).filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold() != HELD_OUT_FOLD))
    rows = labelled_sample(known.select("doc_id", "class"), known.select("doc_id", "text"), per_language, MOST_CHARS)
    if not rows:
        return None
    langs = sorted({c for c, _ in rows})
    rng = np.random.default_rng(3)
    col = pa.array([t for _, t in rows], pa.string())
    raw, _ = text_buffers(col)
    runs: list[tuple[int, np.ndarray, np.ndarray]] = []
    for s in word_slices(col, ALNUM):
        for d in range(s.last - s.first):
            a, b = int(s.doc_off[d]), int(s.doc_off[d + 1])
            if a == b:
                continue
            a += int(rng.integers(0, max(1, b - a - WORDS_PER_DOC + 1)))
            b, at = min(b, a + WORDS_PER_DOC), a
            while at < b:
                n = int(rng.integers(2, RUN + 1))
                runs.append((langs.index(rows[s.first + d][0]), s.starts[at : min(b, at + n)], s.ends[at : min(b, at + n)]))
                at += n
    order = rng.permutation(len(runs))
    off, labels, n = [0], [], 0
    for k, i in enumerate(order):
        label, st, _ = runs[i]
        labels.append(np.full(len(st), label))
        n += len(st)
        if k % 3 == 2 or k == len(order) - 1:  # three runs of any language make a sequence
            off.append(n)
    starts, ends = (np.concatenate([runs[i][j] for i in order]) for j in (1, 2))
    return langs, crf.train(crf.word_chars(raw, starts, ends), np.array(off), np.concatenate(labels), len(langs))


def _predict(col: pa.Array, langs: list[str], model: crf.Model) -> tuple[list[str], list[float], list[float]]:
    """Best language, its share of the text, and the mean of each word's largest marginal."""
    names, scores, sure = [], [], []
    for t in crf.tag(col, model):
        n = t.last - t.first
        weight = (t.ends - t.starts).astype(np.float32)  # long words say more than short ones
        mass, certain = np.zeros((n, len(langs))), np.zeros(n)
        full = np.flatnonzero(np.diff(t.doc_off))
        if len(full):
            mass[full] = np.add.reduceat(t.marginals * weight[:, None], t.doc_off[:-1][full], axis=0)
            certain[full] = np.add.reduceat(t.marginals.max(axis=1).astype(np.float64), t.doc_off[:-1][full]) / np.diff(t.doc_off)[full]
        total = mass.sum(axis=1)
        best = mass.argmax(axis=1)
        for i in range(n):
            text = col[t.first + i].as_py()
            if total[i] > 0 and _LETTER.search(text):
                names.append(langs[best[i]])
                scores.append(float(min(1.0, mass[i, best[i]] / total[i])))
            else:
                names.append(UNKNOWN)
                scores.append(0.0)
            sure.append(float(certain[i]))
    return names, scores, sure


def _columns(col: pa.Array, fitted: tuple[list[str], crf.Model] | None) -> tuple[pa.Array, pa.Array]:
    names, scores, _ = _predict(col, *fitted) if fitted else ([UNKNOWN] * len(col), [0.0] * len(col), None)
    return pa.array(names, pa.string()), pa.array(scores, pa.float64())


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each row of ``docs`` (doc_id, text, lang).

    ``score`` is the share of the text's letters, by marginal, in the language predicted. A text that
    is null or without a letter is ``und`` with score 0, as is every text if no row is labelled. A
    null doc_id counts as held out; repeated rows give repeated results; other columns are ignored;
    no rows give no rows.
    """
    fitted = fit(docs, per_language)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("held_out"), *_columns(b.column("text"), fitted)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce(fold() == HELD_OUT_FOLD, F.lit(True)).alias("held_out"), "text")
    return map_batches(rows, fn, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """``docs`` without rows whose language is unknown or whose words have less than ``least_confidence``
    as the mean of their largest marginals; a text of several known languages stays. Without a labelled
    row no language can be told and no row stays. The columns stay as they are."""
    fitted = fit(docs)
    if fitted is None:
        return docs.limit(0)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        names, _, sure = _predict(b.column("text"), *fitted)
        return b.filter(pa.array([x != UNKNOWN and c >= least_confidence for x, c in zip(names, sure, strict=True)], pa.bool_()))

    return map_batches(docs, fn, docs.schema)
