"""Shared pieces of the training-data operators: Arrow batches to numpy, word and shingle hashes, id bitmaps."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step works on; a longer single text makes a step of its own.
STEP_BYTES = 1 << 21

U = np.uint64
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_FOLD = _BYTE[_LOWER]
_ALNUM_BREAK = np.array([not (chr(b).isalnum() or b >= 0x80) for b in range(256)])


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = x ^ (x >> U(30))
    x = x * _MIX[0]
    x ^= x >> U(27)
    x *= _MIX[1]
    x ^= x >> U(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary array; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes each; at least one row a range."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, alnum: bool = False):
    """Hash, row, start and end of every word.

    A word is a run of bytes outside space and tab to carriage return with A-Z lowered; with ``alnum``, a run
    of letters and digits (every byte from 0x80 on counts as a letter) as given.
    """
    none = np.zeros(0, np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), none, none, none
    inside = ~(_ALNUM_BREAK if alnum else _SPACE)[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[: len(data)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), none, none, none
    picked = data[inside]
    rank = np.cumsum(inside, dtype=np.int64)
    w0 = rank[starts] - 1
    lens = np.diff(np.append(w0, len(picked)))
    pos = np.arange(len(picked), dtype=np.int64) - np.repeat(w0, lens)
    table = (_BYTE if alnum else _FOLD)[picked]
    table *= powers(_BASE, int(lens.max()))[pos]
    h = mix64(np.add.reduceat(table, w0) + lens.astype(np.uint64))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return h, rows, starts, starts + lens


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int = 5):
    """Hash, row and first word index of every run of ``k`` words; a row of fewer words (but some) has one
    shingle of all its words."""
    counts = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    q = powers(U(0xD6E8FEB86659FD93), k)
    n = len(words)
    if n >= k:
        full = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            full += words[i : n - k + 1 + i] * q[i]
        at = np.flatnonzero(rows[: n - k + 1] == rows[k - 1 :])
        h, r = mix64(full[at]), rows[at]
    else:
        at, h, r = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(counts)))[short]
        s = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = counts[short] > i
            s[has] += words[begin[has] + i] * q[i]
        s = mix64(s + counts[short].astype(np.uint64) * U(0xA0761D6478BD642F))
        h, r, at = np.concatenate((h, s)), np.concatenate((r, short)), np.concatenate((at, begin))
        order = np.argsort(r, kind="stable")
        h, r, at = h[order], r[order], at[order]
    return h, r, at


def distinct_sets(h: np.ndarray, rows: np.ndarray):
    """Distinct (row, hash) pairs, ordered by row and hash."""
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return h[keep], rows[keep]


def as_binary(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array whose i-th value holds the next ``counts[i]`` items of ``flat``."""
    ends = np.concatenate(([0], np.cumsum(counts * flat.itemsize)))
    kind, off = (pa.binary(), np.int32) if ends[-1] < 2**31 else (pa.large_binary(), np.int64)
    arr = pa.Array.from_buffers(kind, len(counts), [None, pa.py_buffer(ends.astype(off).tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])
    return arr


def zip_arrays(*arrays: np.ndarray) -> bytes:
    """Several arrays in one compressed blob: shuffled columns rather than rows."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def zip_parts(sizes: list[int], parts: Iterable[np.ndarray]) -> bytes:
    """What :func:`zip_arrays` gives for arrays of these bytes, which come in parts one after the other: no copy of all."""
    head = np.array([len(sizes), *sizes], "<i8")
    z = zstandard.ZstdCompressor(level=1).compressobj(size=head.nbytes + sum(sizes))
    return b"".join([*(z.compress(np.ascontiguousarray(a).data) for a in chain([head], parts) if a.nbytes), z.flush()])


def unzip_arrays(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, "<i8", 1 + len(kinds))[1:]
    out, at = [], 8 * (1 + len(kinds))
    for kind, size in zip(kinds, sizes.tolist()):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def by_part(part: np.ndarray):
    """Stable order by partition, the partitions, and where each begins and ends."""
    order = np.argsort(part, kind="stable")
    names, begin = np.unique(part[order], return_index=True)
    return order, names, begin, np.append(begin[1:], len(part))


def release() -> None:
    """Give freed memory back to the system: idle Python workers keep what their last task left."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` whose worker gives its memory back when a partition is done."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if out is not None and out.num_rows:
                    yield out

    return arrow_map(df, run, schema)


def by_key(fn: Callable, *names: str) -> Callable:
    """Call ``fn(key, blobs)`` for each run of rows ``(key, blob)`` of one key; it returns a batch or None, or, where
    the name of the new key is given, a list of ``(key, blob)``."""

    def made(key, held):
        out = fn(key, held)
        if names and out is not None:
            keys, blobs = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=[*names, "blob"])
        return out

    def run(batches):
        key, held = None, []
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != key and held:
                    out = made(key, held)
                    if out is not None and out.num_rows:
                        yield out
                    held = []
                key = k
                held.append(blob)
        if held:
            out = made(key, held)
            if out is not None and out.num_rows:
                yield out

    return run


def crc_mod(column: str | Column, m: int = 4) -> Column:
    """crc32 of the id as text, modulo ``m``."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % F.lit(m)


def crc_of(ids) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) for i in ids], np.int64)


#: Bits of an id bitmap, at least and at most: eight for each id between these bounds (8 KB and 16 MB).
BITMAP_BITS = (1 << 16, 1 << 27)


def id_slot(column: str) -> Column:
    """The bit of an id in a bitmap of the greatest size; a smaller one has it at the remainder by its size."""
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(BITMAP_BITS[1]))


def id_bitmap(ids: DataFrame, column: str) -> bytes:
    """A bitmap of hashed ids, sized to their count, for dropping rows before a shuffle; see :func:`passes`.

    It lets every id of ``ids`` pass and an eighth of the others, more beyond the greatest size; an exact join must
    follow.
    """
    bits = min(max(1 << (8 * ids.count()).bit_length(), BITMAP_BITS[0]), BITMAP_BITS[1])
    slot = F.pmod(id_slot(column), F.lit(bits))
    words = (
        ids.select((slot / 64).cast("long").alias("w"), F.pmod(slot, F.lit(64)).cast("int").alias("b"))
        .groupBy("w")
        .agg(F.expr("bit_or(shiftleft(1L, b))").alias("m"))
        .toPandas()
    )
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy()] = words["m"].to_numpy()
    return out.tobytes()


def passes(bitmap: bytes, slots: np.ndarray) -> np.ndarray:
    """Which of the ids with these slots may be among the bitmap's."""
    m = np.frombuffer(bitmap, np.int64)
    s = slots & (64 * len(m) - 1)
    return ((m[s >> 6] >> (s & 63)) & 1).astype(bool)


def may_be_among(ids: DataFrame, column: str) -> Column:
    """Whether ``column`` may hold one of ``ids``: true for all that do and for some others, false for null.

    Only the column goes to Python; a bitmap of bounded size is broadcast.
    """
    shared = ids.sparkSession.sparkContext.broadcast(id_bitmap(ids, column))

    @F.arrow_udf("boolean")
    def among(slots: pa.Array) -> pa.Array:
        return pa.array(passes(shared.value, slots.to_numpy(zero_copy_only=False)))

    return F.col(column).isNotNull() & among(F.coalesce(id_slot(column), F.lit(0)))


def hash_bins(column: str, n: int = 4096) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("long"), F.lit(17)), F.lit(n))
