"""Near duplicates among embeddings: cross-polytope hashing after fast Hadamard rotations.

Vectors with equal labels link if their cosine is at least a threshold.  Exact copies are first collapsed to one
representative each.  A table hashes a vector by ``k`` pseudo-random rotations (three rounds of random signs and
a Walsh-Hadamard transform); each gives the nearest vertex of the cross-polytope, i.e. the largest coordinate
and its sign.  A vector is filed under its own bucket and probes the next likely ones, so a pair meets in a
table if either's own bucket is among the other's probes.

Buckets are cut into chunks and each pair of chunks is one block, so a bucket of any size is spread over tasks and
no task holds more than two chunks.  A block computes all its cosines in double precision and returns, for each
vector, how many others it links with, and a spanning forest of the links: pairs never leave a block.  A pair may
meet in several buckets; it counts in the first of them alone, which both vectors' codes tell.

Nothing caps a bucket's or a vector's partners.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlink.llm.common import U, mix64
from strandlink.operators.components import connected_components
from strandlink.plans.stages import materialize

TABLES = 10
PROBES = 8
CHUNK = 512
#: Own buckets that a rotation's alternatives are drawn from.
ALTERNATIVES = 4


def _width(dim: int) -> int:
    return 1 << max(1, math.ceil(math.log2(max(dim, 2))))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rounds of random signs and a fast Walsh-Hadamard transform along the last axis (a power of two)."""
    n, d = x.shape
    for s in signs:
        x = x * s
        h = 1
        while h < d:
            y = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
            h *= 2
        x = x / math.sqrt(d)
    return x


def codes(x: np.ndarray, k: int, tables: int = TABLES, probes: int = PROBES, seed: int = 11) -> np.ndarray:
    """Bucket codes ``(rows, tables, probes)`` as uint64; the first of each table is the vector's own bucket."""
    n, dim = x.shape
    d = _width(dim)
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    rng = np.random.default_rng(seed)
    alt = min(ALTERNATIVES, d)
    combos = np.array(list(itertools.product(range(alt), repeat=k)))
    probes = min(probes, len(combos))
    out = np.empty((n, tables, probes), np.uint64)
    for t in range(tables):
        vertex = np.empty((n, k, alt), np.int64)
        loss = np.empty((n, k, alt))
        for r in range(k):
            y = rotate(padded, rng.choice([-1.0, 1.0], (3, d)))
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, :alt]
            value = np.take_along_axis(size, top, 1)
            vertex[:, r] = 2 * top + (np.take_along_axis(y, top, 1) < 0)
            loss[:, r] = (value[:, :1] - value) ** 2
        total = sum(loss[:, r][:, combos[:, r]] for r in range(k))
        best = np.argsort(total, axis=1, kind="stable")[:, :probes]
        code = np.zeros((n, probes), np.uint64)
        for r in range(k):
            code = code * U(2 * d) + np.take_along_axis(vertex[:, r], combos[best][:, :, r], 1).astype(np.uint64)
        out[:, t] = code
    return out


def rotations_for(n: int, dim: int) -> int:
    """Rotations a table: as many as keep an average bucket below one vector, two at least."""
    return max(2, math.ceil(math.log(max(n, 2)) / math.log(2 * _width(dim))))


def _forest(n: int, a: np.ndarray, b: np.ndarray):
    """Links that join new components, by union-find over local numbers."""
    parent = list(range(n))

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        u, v = find(x), find(y)
        if u != v:
            parent[max(u, v)] = min(u, v)
            out.append((x, y))
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """One row for each row of ``vectors``: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Rows link only within equal labels.  A row links with nothing if its label is null, or its vector is null,
    empty, zero, or holds a null, NaN or infinite component.  Vectors of different lengths never link.  Rows that
    repeat an id with the same vector and label count as copies that link with each other; with other vectors they are
    rows like any others, under one name.  A row with a null id has no name to link by: it links with nothing, its
    ``component_id`` is null, and it is kept.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType
    wide = isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.FloatType)
    item = "double" if wide else "float"
    src = vectors.select(
        vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast(f"array<{item}>").alias("v")
    )
    # -0.0 equals 0.0 as a grouping key; NaN and infinity are dropped here
    fine = (
        F.col("id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("v").isNotNull()
        & F.coalesce(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))), F.lit(False))
        & F.exists("v", lambda e: e != 0)
    )
    rows = materialize(src.withColumn("fine", F.coalesce(fine, F.lit(False))), "vectors")
    # classes have numbers of their own: two classes can hold the same least id
    classes = rows.filter("fine").groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    n, dim = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    k = rotations_for(n, dim)
    dtype = np.float64 if wide else np.float32

    def hash_rows(batches):
        for batch in batches:
            for b in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                vs = b.column(1).to_pylist()
                own = [np.asarray(v, dtype) for v in vs]
                for size in sorted({len(v) for v in own}):
                    at = [i for i, v in enumerate(own) if len(v) == size]
                    x = np.stack([own[i] for i in at]).astype(np.float64)
                    x /= np.abs(x).max(1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    c = codes(x, k, tables, probes)
                    label = np.array([hash_text(b.column(2)[i].as_py()) for i in at], np.uint64)
                    salt = mix64(label[:, None] + np.arange(tables, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(size))
                    c = mix64(c + salt[:, :, None])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b.column(0)[i].as_py() for i in at]), pa.array([b.column(3)[i].as_py() for i in at]), pa.array([own[i].tobytes() for i in at]), pa.array([r.tobytes() for r in c]), b.column(2).take(pa.array(at))],
                        names=["rep", "copies", "body", "codes", "label"],
                    )

    hashed = materialize(classes.select("rep", "v", "label", "copies").mapInArrow(hash_rows, "rep long, copies long, body binary, codes binary, label string"), "hashed")

    def spread(batches):
        for b in batches:
            c = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            if not c:
                continue
            per = len(c[0]) // tables
            flat = np.concatenate(c)
            own = np.tile(np.arange(per) == 0, tables * len(c))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), tables * per)), pa.array(flat), pa.array(own)], names=["rep", "key", "own"])

    filed = hashed.select("rep", "codes").mapInArrow(spread, "rep long, key long, own boolean")
    met = materialize(filed.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).filter("n > 1 and any_own").select("key", "n"), "buckets")
    chunks = F.ceil(F.col("n") / F.lit(CHUNK)).cast("int")
    mine = F.pmod(F.xxhash64("rep", F.lit(5)), chunks).cast("int")
    blocks = (
        filed.join(met, "key")
        .withColumn("c", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select("key", F.least("c", "other").alias("ci"), F.greatest("c", "other").alias("cj"), "c", "rep", "own")
    )
    payload = blocks.join(hashed, "rep").select("key", "ci", "cj", "c", "own", "rep", "copies", "body", "codes", "label")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = payload.repartition(parts, "key", "ci", "cj").sortWithinPartitions("key", "ci", "cj")

    def block_links(key, rows):
        c = np.array([r[3] for r in rows])
        ids = np.array([r[5] for r in rows])
        x = np.stack([np.frombuffer(r[7], dtype) for r in rows]).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= threshold
        near &= c[:, None] != c[None] if key[1] != key[2] else True
        a, b = np.nonzero(np.triu(near, 1))
        if not len(a):
            return None
        all_codes = np.stack([np.frombuffer(r[8], np.int64) for r in rows]).reshape(len(rows), tables, -1)
        # the buckets where a pair meets: own bucket of one among the codes of the other; the first table counts,
        # and within it the smaller bucket
        first = np.zeros(len(a), bool)
        for s in range(0, len(a), 20_000):
            p, q = all_codes[a[s : s + 20_000]], all_codes[b[s : s + 20_000]]
            in_q, in_p = (q == p[:, :, :1]).any(2), (p == q[:, :, :1]).any(2)
            top = np.int64(2**63 - 1)
            least = np.minimum(np.where(in_q, p[:, :, 0], top), np.where(in_p, q[:, :, 0], top))
            t = (in_q | in_p).argmax(1)
            first[s : s + 20_000] = (in_q | in_p).any(1) & (least[np.arange(len(t)), t] == key[0])
        a, b = a[first], b[first]
        if not len(a):
            return None
        copies = np.array([r[6] for r in rows])
        links = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
        return ids, links.astype(np.int64), [(ids[i], ids[j]) for i, j in _forest(len(rows), a, b)]

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def verify(batches):
        key, rows, out = None, [], []

        def flush():
            # a key is a hash: labels and lengths themselves decide who may link
            alike: dict[tuple, list] = {}
            for r in rows:
                alike.setdefault((r[9], len(r[7])), []).append(r)
            for held in alike.values():
                if len(held) > 1 and any(r[4] for r in held):
                    got = block_links(key, held)
                    if got:
                        ids, links, forest = got
                        out.extend((int(i), None, int(m)) for i, m in zip(ids, links) if m)
                        out.extend((int(i), int(j), 0) for i, j in forest)

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(10)]
            for r in zip(*cols):
                if r[:3] != key:
                    flush()
                    key, rows = r[:3], []
                rows.append(r)
            if len(out) > 10_000:
                yield _table(out, schema)
                out.clear()
        flush()
        if out:
            yield _table(out, schema)

    found = materialize(ordered.mapInArrow(verify, "a long, b long, n long"), "links")
    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    labels = materialize(connected_components(found.filter("b is not null"), "a", "b").withColumnRenamed("id", "rep"), "labels")
    names = labels.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("name"))
    named = labels.join(names, "component").select("rep", "name")
    reps = classes.join(counts, "rep", "left").join(named, "rep", "left").select(
        "label", "v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("name", "least").alias("component_id")
    )
    linked = rows.filter("fine").join(reps, ["label", "v"])
    out = linked.select("id", "n_links", "component_id").union(rows.filter("not fine").select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _table(out, schema):
    a, b, n = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], schema=schema)


def hash_text(s: str) -> int:
    import zlib

    return zlib.crc32(s.encode()) | zlib.adler32(s.encode()) << 32
