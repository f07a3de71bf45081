"""Hashed n-gram features of whole texts, and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlink.llm.common import U, hash_bins, mix64, utf8, word_hashes

_N = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5), U(0x94D049BB133111EB), U(0xBF58476D1CE4E5B9)]


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of the lower-cased texts; nulls are empty."""
    return utf8(pc.utf8_lower(pc.fill_null(column, "")))


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A distinct number for each character (its UTF-8 bytes) and the row offsets counted in characters."""
    starts = (data & 0xC0) != 0x80
    at = np.flatnonzero(starts)
    cp = data[at].astype(np.uint32)
    lens = np.diff(np.append(at, len(data)))
    for k in range(1, 4):
        has = lens > k
        if not has.any():
            break
        cp[has] = (cp[has] << np.uint32(8)) | data[at[has] + k]
    return cp, np.concatenate(([0], np.cumsum(starts)))[offsets]


def char_ngrams(cp: np.ndarray, offsets: np.ndarray, n: int, bits: int):
    """Bucket and row of every run of ``n`` characters within a row."""
    m = len(cp) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(m, U(n), np.uint64)
    for k in range(n):
        h += cp[k : k + m].astype(np.uint64) * _N[k]
        h ^= h >> U(29)
    h *= _N[5]
    size = np.diff(offsets)
    grams = np.maximum(size - n + 1, 0)
    rows = np.repeat(np.arange(len(size)), grams)
    first = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(grams)))[:-1], grams)
    return (h[first + np.arange(len(rows))] >> U(64 - bits)).astype(np.int64), rows


def word_buckets(data: np.ndarray, offsets: np.ndarray, bits: int):
    h, rows, _, _ = word_hashes(data, offsets)
    return (mix64(h ^ U(0x5851F42D4C957F2D)) >> U(64 - bits)).astype(np.int64), rows


def bounded_ids(rows: DataFrame, id_col: str, size: Column, label: str, max_rows: int, max_bytes: int) -> DataFrame:
    """Rows of each label with the smallest id hashes: ``max_rows`` and ``max_bytes`` at most, shared evenly by
    the labels (one hash bin of a label is always kept).

    Only counts for each label and hash bin reach the driver.  The choice depends on the rows alone, not on
    their order or partitioning.
    """
    n_bins = 4096
    binned = rows.withColumn("_bin", hash_bins(id_col, n_bins))
    counts = binned.groupBy(label, "_bin").agg(F.count("*").alias("n"), F.sum(size).alias("b")).toPandas()
    cut, share = {}, max(1, counts[label].nunique())
    for value, g in counts.groupby(label):
        g = g.sort_values("_bin")
        fit = (g["n"].cumsum() <= max_rows / share) & (g["b"].fillna(0).cumsum() <= max_bytes / share)
        cut[value] = int(g["_bin"][fit].max()) if fit.any() else int(g["_bin"].min())
        if fit.all():
            cut[value] = n_bins
    if not cut:
        return binned.filter(F.lit(False)).drop("_bin")
    keep = F.lit(False)
    for value, last in cut.items():
        keep = keep | ((F.col(label) == F.lit(value)) & (F.col("_bin") <= F.lit(last)))
    return binned.filter(keep).drop("_bin")
