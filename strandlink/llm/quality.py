"""Quality classifier: supervised subword embeddings.

Every word and every character n-gram of a text hashes to a bucket with a learned vector; a text is the mean of
its vectors, and a softmax layer on top gives class probabilities.  Stochastic gradient descent in numpy fits
vectors and layer on the driver, on a bounded sample of labelled rows.  For scoring, the layer is applied to each
bucket's vector once, which leaves one number a bucket to broadcast (the logit difference): the mean of these
numbers over a text is the text's own logit difference, since both maps are linear.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlink.llm.common import crc_mod, map_arrow, release, steps
from strandlink.plans.stages import drop, materialize
from strandlink.llm.features import bounded_ids, char_ngrams, characters, lowered, utf8, word_buckets

BITS = 17
CHAR_SIZES = (2, 3)
DIM = 8
EPOCHS = 6
BATCH = 32
RATE = 0.4
#: The mean spreads a text's gradient thinly over its features; vectors learn faster than the layer by this factor.
SCALE = 8
#: The bucket of a repeated word.
ECHO = 0
#: Bounds of the training sample for each label.
SAMPLE_ROWS = 3_000
SAMPLE_BYTES = 10_000_000
#: Bytes of text that are scored at once; the n-grams of each take some hundred times as much.
STEP = 1 << 18
THRESHOLD = 0.7


@dataclass(frozen=True)
class Embeddings:
    """The fitted model as it is broadcast: a logit difference for each bucket, and the bias."""

    weight: np.ndarray
    bias: float


def buckets(data: np.ndarray, offsets: np.ndarray):
    """Bucket and row of each feature: words in the first half of the table, character n-grams in the second.

    Case is kept: it carries quality.  A word that repeats the word before it adds a feature of its own, the same
    for all words: a word bigram with both words' identity hashed away.
    """
    b, r = word_buckets(data, offsets, BITS - 1)
    again = np.flatnonzero((b[1:] == b[:-1]) & (r[1:] == r[:-1])) + 1
    b, r = np.concatenate((b, np.full(len(again), ECHO))), np.concatenate((r, r[again]))
    cp, at = characters(data, offsets)
    all_b, all_r = [b], [r]
    for n in CHAR_SIZES:
        b, r = char_ngrams(cp, at, n, BITS - 1)
        all_b.append(b + (1 << (BITS - 1)))
        all_r.append(r)
    return np.concatenate(all_b), np.concatenate(all_r)


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Embeddings:
    """Fit on whole texts with labels 0 and 1; classes weigh the same whatever their counts."""
    n_buckets = 1 << BITS
    if not len(texts) or labels.min() == labels.max():
        only = 0.0 if not len(texts) else (4.0 if labels[0] == 1 else -4.0)
        return Embeddings(np.zeros(n_buckets, np.float32), only)
    feats = []
    for t in texts:
        b, _ = buckets(*utf8(pa.array([t])))
        u, c = np.unique(b, return_counts=True)
        feats.append((u.astype(np.int32), (c / max(1, c.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (n_buckets, DIM)).astype(np.float32)
    layer = np.zeros((DIM, 2), np.float32)
    layer[:, 1] = rng.uniform(-0.1, 0.1, DIM)
    layer[:, 0] = -layer[:, 1]
    bias = np.zeros(2, np.float32)
    share = np.array([(labels == k).mean() for k in (0, 1)])
    weight = (0.5 / share)[labels].astype(np.float32)
    n_steps, step = EPOCHS * -(-len(texts) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            rate = RATE * (1 - step / n_steps)
            step += 1
            pick = order[k : k + BATCH]
            u = np.concatenate([feats[i][0] for i in pick])
            c = np.concatenate([feats[i][1] for i in pick])
            row = np.repeat(np.arange(len(pick)), [len(feats[i][0]) for i in pick])
            contrib = vectors[u] * c[:, None]
            mean = np.zeros((len(pick), DIM), np.float32)
            for d in range(DIM):
                mean[:, d] = np.bincount(row, contrib[:, d], len(pick))
            z = mean @ layer + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            g = p
            g[np.arange(len(pick)), labels[pick]] -= 1
            g *= weight[pick][:, None]
            back = g @ layer.T
            layer -= rate * mean.T @ g
            bias -= rate * 0.05 * g.sum(0)
            delta = (back[row] * (c * np.float32(rate * SCALE))[:, None]).astype(np.float32)
            for d in range(DIM):
                vectors[:, d] -= np.bincount(u, delta[:, d], n_buckets).astype(np.float32)
    diff = layer[:, 1] - layer[:, 0]
    return Embeddings((vectors @ diff).astype(np.float32), float(bias[1] - bias[0]))


def _within(sizes: pd.DataFrame) -> list[int]:
    """Ids of rows ``(id, y, size)`` that fit into SAMPLE_BYTES a label, in the order given.

    A text that does not fit is passed over, those after it are not; where none fits, the least one is taken.
    """
    out = []
    for _, rows in sizes.groupby("y"):
        left, taken = SAMPLE_BYTES, []
        for i, size in zip(rows["id"].tolist(), rows["size"].tolist()):
            if size <= left:
                left -= size
                taken.append(i)
        out += taken or [int(rows["id"].iloc[int(rows["size"].to_numpy().argmin())])]
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Embeddings:
    """Learn from labelled rows that are not held out: SAMPLE_ROWS and SAMPLE_BYTES a label at most, but one row of
    each label in any case.  Ids are taken in the order of their hash.

    Rows with a null id or label teach nothing; the larger of several labels for one id holds.
    """
    import pandas as pd  # the driver's alone: workers that score do without it

    known = (
        labels.select(labels["doc_id"].cast("long").alias("id"), labels["quality"].cast("int").alias("y"))
        .filter("id is not null and y in (0, 1)")
        .filter(crc_mod("id") != 2)
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    chosen = bounded_ids(known, "id", F.lit(0), "y", 2 * SAMPLE_ROWS, 1)
    ids = chosen.toPandas()
    spark = docs.sparkSession
    # at most 2 * SAMPLE_ROWS ids (and one hash bin): small enough to broadcast by construction
    small = F.broadcast(spark.createDataFrame(ids if len(ids) else pd.DataFrame({"id": pd.Series(dtype="int64"), "y": pd.Series(dtype="int32")}), "id long, y int"))
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).join(small, "id")
    sample = materialize(rows, "labelled")
    # repeated rows of an id go together
    sizes = sample.groupBy("id", "y").agg(F.sum(F.octet_length("text").cast("long")).alias("size")).withColumn("h", F.xxhash64("id")).toPandas()
    within = _within(sizes.sort_values(["h", "id"]))
    got = sorted((r["id"], r["text"], r["y"]) for r in sample.filter(F.col("id").isin(within)).collect()) if within else []
    drop(sample)
    texts, ys = [t for _, t, _ in got], np.array([y for _, _, y in got], np.int64)
    del got
    model = train(texts, ys)
    del texts
    release()  # the driver goes on with the model alone
    return model


def _scores(m: Embeddings, texts: pa.Array) -> np.ndarray:
    data, off = utf8(texts)
    out = [np.zeros(0)]
    for i, j in steps(off, STEP):
        n = j - i
        u, row = buckets(data[off[i] : off[j]], off[i : j + 1] - off[i])
        count = np.maximum(np.bincount(row, minlength=n), 1)
        out.append(1 / (1 + np.exp(-(np.bincount(row, m.weight[u], n) / count + m.bias))))
    return np.concatenate(out)


def score(docs: DataFrame, model: Embeddings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row: the probability of label 1.  An empty or null text gets the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(shared.value, b.column(1)))], names=["doc_id", "score"])

    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return map_arrow(src, fn, "doc_id long, score double")


def accepted(docs: DataFrame, model: Embeddings, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, in one narrow pass: all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        scores = _scores(shared.value, b.column(at))
        return b.take(pa.array(np.flatnonzero(scores >= threshold)))

    return map_arrow(docs, fn, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, fit(docs, labels))
    return out.select(
        "doc_id",
        F.coalesce(crc_mod("doc_id") == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
