"""Exact inner-product top-k: elimination by a pivot table.

Components become integers, so scores are exact.  For a query q, a candidate x and a pivot p, |d(q, p) - d(x, p)| bounds
the distance of q and x from below, and q.x = (q.q + x.x - d(q, x)^2) / 2 bounds the score from above.  The table
holds every row's distances to many pivots and is ordered by the nearest one.  A chunk of candidates whose bound is
below a query's k-th score so far is passed over whole; within the others, candidates are evaluated in the order of
their bounds until the next bound is below the k-th score.

Queries are taken in blocks of a checked size: a block is broadcast and held against the whole table where it lies, so
candidates are not shuffled, and each task returns at most k rows for a query.  The first threshold of a query is its
k-th score within the sample that pivots come from.  Pivots, sample and thresholds only save work.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlink.llm.common import arrow_map
from strandlink.plans.ranks import ranked
from strandlink.plans.stages import drop, materialize

#: Pivots for each vector length, and the rows at most from which they are chosen (least hashed ids).
PIVOTS = 32
SAMPLE = 4096
#: Bytes of query vectors that are broadcast at once, about.
BLOCK_BYTES = 8_000_000
#: Candidates that share one bound, and those that are evaluated at once.
CHUNK = 2048
STEP = 256
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer inner products ``(queries, candidates)``, at the ends of a long where they lie beyond it."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    if top < 2**53:  # every partial sum is an integer that a double holds
        return (queries @ candidates.T).astype(np.int64)
    whole = [np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (queries, candidates)]
    out = whole[0] @ whole[1].T
    return np.array([[min(max(int(v), _LEAST), _MOST) for v in row] for row in out], np.int64).reshape(len(queries), len(candidates))


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Pivots: each the vector farthest from those before it."""
    picked = [0]
    near = np.linalg.norm(x - x[0], axis=1)
    while len(picked) < n and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(x - x[picked[-1]], axis=1))
    return x[picked]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in pivots], 1)) if len(pivots) else np.zeros((len(x), 0))


def _body(column: pa.Array, at: list[int]) -> np.ndarray:
    return np.stack([np.frombuffer(column[i].as_py(), np.float64) for i in at])


def _by_length(column: pa.Array) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, v in enumerate(column.to_pylist()):
        out.setdefault(v, []).append(i)
    return out


class Block:
    """The queries of one block and one length, with their best candidates so far."""

    def __init__(self, rows: list, k: int):
        self.k = k
        self.number = np.array([r["number"] for r in rows], np.int64)
        self.ids = np.array([r["id"] for r in rows], np.int64)
        self.x = np.stack([np.frombuffer(r["body"], np.float64) for r in rows])
        self.table = np.stack([np.frombuffer(r["table"], np.float32) for r in rows]).astype(np.float64)
        self.square = (self.x**2).sum(1)
        self.least = np.array([r["seed"] for r in rows], np.int64)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(rows)

    def _bound(self, square, other, gap, far):
        """Scores are at most this, rounding of the table (single precision) and of the bound included."""
        gap = np.maximum(gap - 1e-6 * far, 0)
        both = square + other
        return np.minimum((both - gap**2) / 2, np.sqrt(square * other)) + 1e-9 * both + 1

    def meet(self, ids: np.ndarray, x: np.ndarray, table: np.ndarray) -> None:
        other = (x**2).sum(1)
        far = max(table.max(initial=0), self.table.max(initial=0))
        if table.shape[1]:
            gap = np.maximum(self.table - table.max(0), table.min(0) - self.table).max(1)
        else:
            gap = np.zeros(len(self.ids))
        # the bound of the whole chunk: its largest norm and the interval of its distances to each pivot
        for q in np.flatnonzero(self._bound(self.square, other.max(), gap, far) >= self.least).tolist():
            own = np.abs(table - self.table[q]).max(1, initial=0)
            bound = self._bound(self.square[q], other, own, far)
            left = np.flatnonzero((bound >= self.least[q]) & (ids != self.ids[q]))
            left = left[np.argsort(-bound[left], kind="stable")]
            for s in range(0, len(left), STEP):
                part = left[s : s + STEP]
                if bound[part[0]] < self.least[q]:
                    break
                got = scores(self.x[q : q + 1], x[part])[0]
                fit = got >= self.least[q]
                if fit.any():
                    self._merge(q, got[fit], ids[part[fit]])

    def _merge(self, q: int, got: np.ndarray, ids: np.ndarray) -> None:
        value, name = np.concatenate((self.best[q][0], got)), np.concatenate((self.best[q][1], ids))
        # the least long has no negative
        order = np.lexsort((name, ~value))[: self.k]
        self.best[q] = value[order], name[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], value[order[-1]])


def search(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, sample: int = SAMPLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every`` the ``k`` rows with the
    highest inner products of ``floor(scale * x)``, ties to smaller ids; all rows if there are fewer.

    Rows with a null id or a vector that is null, empty or holds null or non-finite components take no part, nor do
    those whose scaled components leave the range of a double.  Vectors of different lengths never meet.  A row is no
    candidate of a query with the same id.  Rows that repeat an id are queries and candidates of their own.  Scores beyond
    the range of a long are returned, and compared, as its ends.
    """
    spark = vectors.sparkSession
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    src = vectors.select(vectors[id_col].cast("long").alias("id"), F.transform(vectors[vector_col].cast("array<double>"), lambda e: e * F.lit(float(scale))).alias("v"))
    src = src.filter(F.col("id").isNotNull() & (F.size("v") > 0) & F.coalesce(F.forall("v", finite), F.lit(False)))

    def whole(batches):
        for b in batches:
            flat, off = b.column(1).flatten().to_numpy(zero_copy_only=False), np.asarray(b.column(1).offsets) - b.column(1).offsets[0].as_py()
            body = np.floor(flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off).astype(np.int32)), pa.array([body[i:j].tobytes() for i, j in zip(off[:-1], off[1:])], pa.binary())], names=["id", "len", "body"])

    rows = materialize(arrow_map(src, whole, "id long, len int, body binary"), "integers")
    known: dict[int, list[np.ndarray]] = {}
    names: dict[int, list[int]] = {}
    # bounded by ``sample`` rows at any size
    for r in rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("body")).limit(sample).collect():
        known.setdefault(r["len"], []).append(np.frombuffer(r["body"], np.float64))
        names.setdefault(r["len"], []).append(r["id"])
    bases = {n: farthest_first(np.stack(x), pivots) for n, x in known.items()}
    shared = spark.sparkContext.broadcast((bases, {n: (np.array(names[n]), np.stack(x)) for n, x in known.items()}))

    def measure(batches):
        for b in batches:
            for n, at in _by_length(b.column(1)).items():
                base = shared.value[0].get(n, np.zeros((0, n)))
                d = distances(_body(b.column(2), at), base)
                near = d.argmin(1) if len(base) else np.zeros(len(at), np.int64)
                least = d[np.arange(len(at)), near] if len(base) else np.zeros(len(at))
                part = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(least), pa.array([r.tobytes() for r in d.astype(np.float32)], pa.binary())], names=["id", "len", "body", "near", "least", "table"])

    keys = ["len", "near", "least", "id"]
    measured = arrow_map(rows, measure, "id long, len int, body binary, near int, least double, table binary")
    table = materialize(measured.repartitionByRange(*keys).sortWithinPartitions(*keys), "pivot-table")
    drop(rows)

    def seeded(batches):
        for b in batches:
            seed = np.full(b.num_rows, _LEAST)
            for n, at in _by_length(b.column(1)).items():
                ids, x = shared.value[1].get(n, (np.zeros(0, np.int64), np.zeros((0, n))))
                got = scores(_body(b.column(2), at), x)
                own = b.column(0).take(pa.array(at)).to_numpy()
                got[own[:, None] == ids] = _LEAST
                if len(ids) >= k:
                    seed[at] = np.partition(got, len(ids) - k, axis=1)[:, len(ids) - k]
            yield b.append_column("seed", pa.array(seed))

    asked = table.filter(F.col("id") % every == 0)
    largest = asked.agg(F.max(F.octet_length("body") + F.octet_length("table"))).first()[0] or 1
    # neighbours are numbered one after the other, and so many share a block that it has ``block_bytes`` at most
    seeds = arrow_map(asked, seeded, "id long, len int, body binary, near int, least double, table binary, seed long")
    numbered = ranked(seeds.withColumn("all", F.lit("")), "all", keys, "queries")
    queries = materialize(numbered.select("id", "len", "body", "table", "seed", F.col("idx").alias("number"), F.floor(F.col("idx") / F.lit(max(1, block_bytes // largest))).alias("block")), "queries")
    found = []
    n_blocks = (queries.agg(F.max("block")).first()[0] or 0) + 1
    for block in range(n_blocks):
        held = queries.filter(F.col("block") == block).collect()
        lengths: dict[int, list] = {}
        for r in held:
            lengths.setdefault(r["len"], []).append(r)
        sent = spark.sparkContext.broadcast(lengths)

        def against(batches, sent=sent):
            blocks = {n: Block(x, k) for n, x in sent.value.items()}
            for b in batches:
                for s in range(0, b.num_rows, CHUNK):
                    part = b.slice(s, CHUNK)
                    for n, at in _by_length(part.column(1)).items():
                        if n in blocks:
                            d = np.stack([np.frombuffer(part.column(3)[i].as_py(), np.float32) for i in at]).astype(np.float64)
                            blocks[n].meet(part.column(0).take(pa.array(at)).to_numpy(), _body(part.column(2), at), d)
            for x in blocks.values():
                for number, own, (value, name) in zip(x.number.tolist(), x.ids.tolist(), x.best):
                    if len(name):
                        yield pa.RecordBatch.from_arrays([pa.array([number] * len(name)), pa.array([own] * len(name)), pa.array(name), pa.array(value)], names=["number", "query_id", "vec_id", "score"])

        found.append(materialize(arrow_map(table.select("id", "len", "body", "table"), against, "number long, query_id long, vec_id long, score long"), "found"))
        sent.unpersist()
    if not found:
        found = [spark.createDataFrame([], "number long, query_id long, vec_id long, score long")]
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    best = functools.reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
