"""Benchmark decontamination by SimHash over item-sized windows.

A window has as many words as the benchmark item it is held against.  Words are runs of letters and digits in lower
case, features are 5-word shingles.  A shingle that occurs c times is c features, its first to its c-th occurrence, so
that the weighted Jaccard similarity of shingle counts (sum of minima over sum of maxima) is that of two plain sets, and
the angle between similar windows has a bound however often shingles repeat.  Only windows that hold a shingle of an item can
resemble it at all, so fingerprints are taken there: the sign of the sum of the features' +-1 bit vectors, by cumulative
sums of what enters and leaves.  A multi-index finds all items whose fingerprint is within the radius: 64 bits make 8
blocks of 8, and a distance of at most 23 leaves some block within 2 bits (floor(23 / 8)), so looking up the 2-bit
neighbourhood of each block misses nothing.  The candidates' weighted Jaccard similarity is then computed exactly.

Fingerprints of two sets of similarity 0.8 differ in 9.7 bits on average and in more than 23 once in about 10^5 to 10^6.

The benchmark is broadcast in blocks of a checked size, each held against all documents.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlink.llm.common import U, map_arrow, mix64, shingles, steps, utf8, word_hashes

RADIUS = 23
BLOCKS = 8
K = 5
#: Bytes of item text that are broadcast at once.
BLOCK_BYTES = 4_000_000
#: Window starts that are fingerprinted at once.
SEGMENT = 20_000
_SLOTS = 20


def _words(column: pa.Array):
    data, off = utf8(pc.utf8_lower(pc.fill_null(column, "")))
    return data, off


def bit_signs(h: np.ndarray) -> np.ndarray:
    """+1 and -1 for each bit of each hash."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def sign_hash(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from sums of signs; a zero sum sets the bit."""
    return np.packbits(sums >= 0, axis=1, bitorder="little").view("<u8").ravel()


def window_sums(h: np.ndarray, span: int) -> np.ndarray:
    """Sums of the features' signs for each window of ``span`` consecutive shingles ``h``.

    The c-th occurrence of a shingle within a window is a feature of its own.  A window gains the feature of the number
    of occurrences that it then has, and loses that of the number that it had.
    """
    n = len(h)
    _, x = np.unique(h, return_inverse=True)
    at = np.arange(n)
    order = np.argsort(x, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = at
    key = x.astype(np.int64) * (2 * n)
    known = (key + at)[order]
    gained = place - np.searchsorted(known, key + np.maximum(at - span + 1, 0)) + 1
    lost = np.searchsorted(known, key + np.minimum(at + span, 2 * n - 1)) - place

    def signs(count: np.ndarray) -> np.ndarray:
        return bit_signs(np.where(count == 1, h, mix64(h + count.astype(np.uint64) * U(0x9FB21C651E98DF25))))

    enter, leave = signs(gained), signs(lost)
    return np.cumsum(np.concatenate((enter[:span].sum(0, keepdims=True), enter[span:] - leave[: n - span])), axis=0, dtype=np.int32)


class Index:
    """Items of one block: shingles, fingerprints, and the multi-index for each length."""

    def __init__(self, ids: list[int], texts: list[str], radius: int = RADIUS):
        self.radius = radius
        data, off = _words(pa.array(texts, pa.string()))
        words, rows, _, _ = word_hashes(data, off, alnum=True)
        begin = np.searchsorted(rows, np.arange(len(texts) + 1))
        self.items: list[tuple[int, int, int, Counter]] = []
        by_length: dict[int, list[int]] = defaultdict(list)
        found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        prints = []
        for i, item in enumerate(ids):
            w = words[begin[i] : begin[i + 1]]
            n = len(w)
            if not n:
                continue
            k = min(K, n)
            h, _, _ = shingles(w, np.zeros(n, np.int64), 1, k)
            counts = Counter(h.tolist())
            for x in counts:
                found[k][x].append(len(self.items))
            by_length[n].append(len(self.items))
            self.items.append((item, n, k, counts))
            prints.append(int(sign_hash(window_sums(h, len(h)))[0]))
        self.by_length = {n: np.array(x) for n, x in by_length.items()}
        self.prints = np.array(prints, np.uint64)
        # for each shingle size: its sorted shingles, a bitmap over them, and the items that hold each
        self.known = {}
        for k, table in found.items():
            h = np.array(sorted(table), np.uint64)
            slots = np.zeros(1 << _SLOTS, bool)
            slots[(h >> U(64 - _SLOTS)).astype(np.int64)] = True
            self.known[k] = (h, slots, [table[x] for x in h.tolist()])
        pop = np.array([bin(v).count("1") for v in range(256)])
        near = pop[np.arange(256)[:, None] ^ np.arange(256)] <= radius // BLOCKS
        self.tables = {}
        for n, members in self.by_length.items():
            blocks = self.prints[members].view(np.uint8).reshape(-1, 8)
            self.tables[n] = [near[:, blocks[:, b]] for b in range(BLOCKS)]

    def candidates(self, n: int, prints: np.ndarray):
        """Window and item numbers, of items of ``n`` words, with fingerprints within the radius: all of them."""
        members = self.by_length[n]
        blocks = prints.astype("<u8").view(np.uint8).reshape(-1, 8)
        mask = self.tables[n][0][blocks[:, 0]]
        for b in range(1, BLOCKS):
            mask = mask | self.tables[n][b][blocks[:, b]]
        w, m = np.nonzero(mask)
        dist = np.bitwise_count(prints[w] ^ self.prints[members[m]])
        ok = dist <= self.radius
        return w[ok], members[m[ok]], dist[ok]


def similarity(a: Counter, b: Counter) -> tuple[int, int]:
    """Weighted intersection and union of shingle counts."""
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both, sum(a.values()) + sum(b.values()) - both


def scan_text(index: Index, k: int, h: np.ndarray, hits: np.ndarray, n_words: int, percent: int):
    """Best window of each item in one text: ``{item number: (both, union, start, words, distance)}``.

    ``h`` are the hashes of the text's k-word shingles by position, ``hits`` positions that hold known ones.
    """
    known, _, holders = index.known[k]
    by_length: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for p, at in zip(hits.tolist(), np.searchsorted(known, h[hits]).tolist()):
        for item in holders[at]:
            by_length[index.items[item][1]][item].append(p)
    best: dict[int, tuple] = {}

    def verify(item: int, at: int, width: int, span: int, distance: int) -> None:
        both, union = similarity(Counter(h[at : at + span].tolist()), index.items[item][3])
        if 100 * both >= percent * union:
            old = best.get(item)
            if old is None or both * old[1] > old[0] * union or (both * old[1] == old[0] * union and at < old[2]):
                best[item] = (both, union, at, width, distance)

    for n, places in by_length.items():
        width = min(n, n_words)  # a text shorter than the item is one window
        span = width - k + 1  # shingles in a window
        p = np.array(sorted({x for ps in places.values() for x in ps}))
        lo, hi = np.maximum(p - span + 1, 0), np.minimum(p, n_words - width)
        starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)]))
        for s in range(0, len(starts), SEGMENT):
            part = starts[s : s + SEGMENT]
            # runs of neighbouring starts share one cumulative sum
            for run in np.split(part, np.flatnonzero(np.diff(part) > span) + 1):
                first = run[0]
                sums = window_sums(h[first : run[-1] + span], span)
                w, items, dist = index.candidates(n, sign_hash(sums[run - first]))
                for x, item, d in zip(w.tolist(), items.tolist(), dist.tolist()):
                    verify(item, int(run[x]), width, span, d)
    return best


def scan_batch(index: Index, column: pa.Array, percent: int):
    """``(row, item number, best window)`` for each text of a batch and each item that it holds."""
    data, off = _words(column)
    for i, j in steps(off):
        n = j - i
        words, rows_, _, _ = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i], alnum=True)
        begin = np.searchsorted(rows_, np.arange(n + 1))
        for k, (known, slots, _) in index.known.items():
            h, r, _ = shingles(words, rows_, n, k)
            hit = np.flatnonzero(slots[(h >> U(64 - _SLOTS)).astype(np.int64)])
            hit = hit[np.isin(h[hit], known)]
            for row in np.unique(r[hit]).tolist():
                s, e = np.searchsorted(r, [row, row + 1])
                count = int(begin[row + 1] - begin[row])
                if count >= k:
                    mine = hit[(hit >= s) & (hit < e)] - s
                    for item, window in scan_text(index, k, h[s:e], mine, count, percent).items():
                        yield i + row, item, window


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str):
    """Broadcast indexes of the benchmark's distinct items, of about BLOCK_BYTES of text each."""
    spark = benchmark.sparkSession
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text_col].cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_BYTES))
    for number in range(n_blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == number).distinct().collect()
        rows = sorted((r["item_id"] is None, r["item_id"] or 0, r["text"]) for r in rows)
        yield spark.sparkContext.broadcast(Index([None if a else i for a, i, _ in rows], [t for _, _, t in rows]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item it holds:
    ``(doc_id, item_id, start_word, n_words, hamming, similarity)`` of the most similar window (the first of
    equals).

    Null and empty texts hold nothing, items without words match nothing, and equal items each get their row.  Repeated
    rows are reported as often as they come, and a document with a null id under null.
    """
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = "doc_id long, item_id long, start_word long, n_words int, hamming int, similarity double"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())

    def held_against(shared) -> DataFrame:
        def scan(b: pa.RecordBatch) -> pa.RecordBatch | None:
            index = shared.value
            out = [(b.column(0)[row].as_py(), index.items[item][0], start, width, d, both / union) for row, item, (both, union, start, width, d) in scan_batch(index, b.column(1), percent)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "item_id", "start_word", "n_words", "hamming", "similarity"]) if out else None

        return map_arrow(src, scan, schema)

    return reduce(DataFrame.union, [held_against(x) for x in _blocks(benchmark, item_col, item_text_col)])


def without_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no benchmark item.

    A row is judged by its own text alone, so null ids and repeated rows need no care; a null text holds nothing.
    """
    at = docs.columns.index(text_col)

    def filtered(rows: DataFrame, shared) -> DataFrame:
        def keep(b: pa.RecordBatch) -> pa.RecordBatch:
            gone = np.zeros(b.num_rows, bool)
            for row, _, _ in scan_batch(shared.value, b.column(at), percent):
                gone[row] = True
            return b.take(pa.array(np.flatnonzero(~gone)))

        return map_arrow(rows, keep, docs.schema)

    return reduce(filtered, _blocks(benchmark, item_col, item_text_col), docs)
