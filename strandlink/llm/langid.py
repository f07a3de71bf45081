"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities, languages by hash buckets, of a fixed size for a given number of
languages; it is broadcast, and batches of whole texts are scored in numpy from the n-grams they hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlink.llm.common import crc_mod, map_arrow, steps
from strandlink.llm.features import bounded_ids, char_ngrams, characters, lowered

BITS = 16
SIZES = (1, 2, 3)
#: Bounds of the training sample, shared evenly by the languages.
SAMPLE_ROWS = 12_000
SAMPLE_BYTES = 24_000_000
SMOOTHING = 0.5


@dataclass(frozen=True)
class NaiveBayes:
    languages: list[str]
    prior: np.ndarray
    logp: np.ndarray  # sizes x languages x buckets


def _grams(data, offsets):
    cp, at = characters(data, offsets)
    return [char_ngrams(cp, at, n, BITS) for n in SIZES]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> NaiveBayes:
    """Learn from rows with a text and a language, at most SAMPLE_ROWS and SAMPLE_BYTES in all."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.filter("text is not null and lang is not null")
    counts: dict[str, np.ndarray] = {}
    seen: dict[str, int] = {}
    for r in bounded_ids(rows, "id", F.octet_length("text"), "lang", SAMPLE_ROWS, SAMPLE_BYTES).select("lang", "text").collect():
        c = counts.setdefault(r["lang"], np.zeros((len(SIZES), 1 << BITS)))
        seen[r["lang"]] = seen.get(r["lang"], 0) + 1
        for k, (b, _) in enumerate(_grams(*lowered(pa.array([r["text"]])))):
            c[k] += np.bincount(b, minlength=1 << BITS)
    names = sorted(counts)
    total = sum(seen.values())
    logp = np.empty((len(SIZES), len(names), 1 << BITS))
    for j, name in enumerate(names):
        c = counts[name] + SMOOTHING
        logp[:, j] = np.log(c / c.sum(axis=1, keepdims=True))
    return NaiveBayes(names, np.log(np.array([seen[n] / total for n in names])), logp)


def predict(docs: DataFrame, model: NaiveBayes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row; ``score`` is the posterior of the prediction.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing was learned.
    Ties go to the first language in alphabetical order.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        data, off = lowered(b.column(1))
        pred, score = [], []
        for i, j in steps(off, 1 << 20):
            n = j - i
            part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
            total = np.tile(m.prior, (n, 1)) if m.languages else np.zeros((n, 1))
            if m.languages:
                for k, (bucket, rows) in enumerate(_grams(part, at)):
                    for lang in range(len(m.languages)):
                        total[:, lang] += np.bincount(rows, m.logp[k, lang][bucket], n)
            best = total.argmax(1)
            p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            ascii_letter = (part >= 97) & (part <= 122)
            sums = np.concatenate(([0], np.cumsum(ascii_letter)))
            letters = sums[at[1:]] > sums[at[:-1]]
            for r in np.flatnonzero(~letters):
                letters[r] = any(c.isalpha() for c in (b.column(1)[i + int(r)].as_py() or ""))
            ok = letters & bool(m.languages)
            pred += [m.languages[x] if o else "und" for x, o in zip(best, ok)]
            score += np.where(ok, p, 0.0).tolist()
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(pred), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return map_arrow(src, fn, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, then predict every row."""
    model = fit(docs.filter(F.coalesce(crc_mod("doc_id"), F.lit(0)) != 2))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id") == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
