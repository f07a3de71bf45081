"""Removal of byte strings that repeat across documents, by sparse suffix arrays sorted deep-shallow.

A string of ``width`` bytes is removed where it also starts in a document with a smaller id.  Every window of
``width`` bytes holds an anchor, the least k-gram by hash (the leftmost of equals); equal windows hold equal
anchors at equal places, so comparing the suffixes that start at anchors finds every match.

1. Exact copies: a text's hash and the least id that has it.  Later copies repeat it whole.
2. Anchor hashes of the other texts are packed by hash partition; those of two or more documents are flagged back
   to their documents.  An anchor that a map task meets often is flagged there and sent on as a mere count, so no
   partition holds all rows of a frequent anchor.
3. Flagged anchors bring the stretch of text that their windows cover.  A task sorts its suffixes: multikey
   quicksort on machine words to the depth of the anchor, then a blind trie for each group that is still equal.
   Windows with an equal right part are runs of the suffix array above an LCP; an equal left part is a hash; the
   least document id of a run decides.
4. The stretches of a hot anchor are cut, by the place of the anchor in the window, into shorter ones that lie in
   partitions of their own; equal ones are collapsed by each map task before they are sent to the same sort.
5. Intervals are merged for each document.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlink.llm.common import U, arrow_map, as_binary, by_key, by_part, id_bitmap, id_slot, map_arrow, mix64, passes, steps, unzip_arrays, utf8, zip_arrays
from strandlink.plans.stages import drop, materialize

WIDTH = 50
GRAM = 16
#: Anchors that one partition of step 2, and one of step 3, holds on average.
PER_PART = 400_000
PER_SORT = 40_000
#: Rows of one anchor from which it is hot: this many, or this share of all anchors, which bounds the hot ones.
HOT = 20_000
HOT_SHARE = 1 << 20
#: Rows of one anchor among those that a map task packs at once from which it sends a count.
OFTEN = 64
#: Window places of a hot anchor's shorter stretches.
PLACES = 5
#: Anchors that a map task packs at once.
FLUSH = 1_500_000

_A, _B = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def anchors(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """Row, anchor position, first and last window start (all positions in ``data``) and anchor hash."""
    span = width - gram + 1
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none, np.zeros(0, np.uint64)
    words = np.ndarray((n - 7,), "<u8", buffer=np.ascontiguousarray(data).tobytes(), strides=(1,))
    m = n - gram + 1
    h = words[:m] * _A
    for at in range(8, gram, 8):
        at = min(at, gram - 8)
        h ^= h >> U(31)
        h += words[at : at + m] * _B
    h = mix64(h)
    bits = max(1, int(n).bit_length())
    key = (h >> U(bits) << U(bits)) | np.arange(m, dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < span:
        key = np.minimum(key[: -(span - size)], key[span - size :])
    at = (key & U((1 << bits) - 1)).astype(np.int64)  # anchor of the window at each position
    rows = np.flatnonzero(np.diff(offsets) >= width)
    if not len(rows):
        return none, none, none, none, np.zeros(0, np.uint64)
    count = np.diff(offsets)[rows] - width + 1
    row = np.repeat(rows, count)
    start = np.arange(len(row)) + np.repeat(offsets[rows] - (np.cumsum(count) - count), count)
    p = at[start]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    return row[first], p[first], start[first], start[last], h[p[first]]


# ---------------------------------------------------------------- sorting


def shallow_sort(words: np.ndarray, index: np.ndarray, depth: int = 0):
    """Multikey quicksort by whole machine words: groups of rows equal in all of ``words``' columns, in order."""
    out, stack = [], [(index, depth)]
    while stack:
        rows, d = stack.pop()
        if len(rows) < 2 or d == words.shape[1]:
            out.append(rows)
            continue
        w = words[rows, d]
        pivot = w[len(w) // 2]
        if len(rows) < 4096:  # small parts: sort the word at once
            order = np.argsort(w, kind="stable")
            rows, w = rows[order], w[order]
            cut = np.flatnonzero(w[1:] != w[:-1]) + 1
            stack += [(r, d + 1) for r in np.split(rows, cut)[::-1]]
            continue
        less, same = w < pivot, w == pivot
        for part, deeper in ((rows[~less & ~same], d), (rows[same], d + 1), (rows[less], d)):
            if len(part):
                stack.append((part, deeper))
    return out


def blind_trie(keys: list[int], bits: int):
    """Order of distinct integers of ``bits`` bits and the first differing bit between neighbours.

    The trie stores only branching bits.  An insertion goes down blindly to some leaf, compares once to find the
    first differing bit, and goes down again to the place of that bit.
    """
    # node: [bit, zero, one]; leaf: the number of its key
    root: object = 0
    for n in range(1, len(keys)):
        key = keys[n]
        node = root
        while type(node) is list:
            node = node[1 + (key >> (bits - 1 - node[0]) & 1)]
        bit = bits - (key ^ keys[node]).bit_length()
        parent, side, node = None, 0, root
        while type(node) is list and node[0] < bit:
            parent, side = node, 1 + (key >> (bits - 1 - node[0]) & 1)
            node = node[side]
        made = [bit, node, n] if key >> (bits - 1 - bit) & 1 else [bit, n, node]
        if parent is None:
            root = made
        else:
            parent[side] = made
    order, splits, stack = [], [], [root]
    while stack:
        node = stack.pop()
        if type(node) is list:
            stack += [node[2], (node[0],), node[1]]
        elif type(node) is tuple:
            splits.append(node[0])
        else:
            order.append(node)
    return order, splits


def deep_shallow(suffixes: np.ndarray, shallow: int = GRAM):
    """Order of the rows of a byte matrix and the LCP of each row with the one before (0 for the first)."""
    n, width = suffixes.shape
    words = np.ascontiguousarray(suffixes[:, :shallow]).view(">u8").astype(np.uint64).reshape(n, -1)
    order = np.empty(n, np.int64)
    lcp = np.zeros(n, np.int64)
    at = 0
    rest = np.ascontiguousarray(suffixes[:, shallow:])
    raw, step, bits = rest.tobytes(), width - shallow, 8 * (width - shallow)
    for group in shallow_sort(words, np.arange(n)):
        m = len(group)
        if m == 1:
            order[at] = group[0]
            at += 1
            continue
        keys: dict[int, list[int]] = {}
        for g in group.tolist():
            keys.setdefault(int.from_bytes(raw[g * step : (g + 1) * step], "big"), []).append(g)
        names = list(keys)
        ranked, splits = blind_trie(names, bits)
        for k, r in enumerate(ranked):
            same = keys[names[r]]
            order[at : at + len(same)] = same
            lcp[at] = 0 if k == 0 else shallow + splits[k - 1] // 8
            lcp[at + 1 : at + len(same)] = width
            at += len(same)
    return order, lcp  # groups of different shallow keys never share a window: an LCP of 0 parts them


def matched_windows(text: np.ndarray, left: np.ndarray, size: np.ndarray, doc: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """Intervals ``(row, begin, end)`` relative to each stretch that smaller documents repeat.

    ``text`` holds stretches one after the other, ``size`` their lengths, ``left`` the bytes before their anchor.
    """
    reach = width - gram
    n = len(size)
    begin = np.cumsum(size) - size
    cells = np.zeros((n, reach + width + 4), np.uint8)  # a multiple of eight
    row = np.repeat(np.arange(n), size)
    cells[row, np.arange(len(text)) - np.repeat(begin - (reach - left), size)] = text
    words = cells.view("<u8")
    h1 = (left * 256 + size).astype(np.uint64)
    h2 = h1 * _B
    for k in range(words.shape[1]):
        h1 = mix64(h1 * _A + words[:, k])
        h2 = mix64(h2 ^ words[:, k]) * _B
    order = np.lexsort((doc, h2, h1))
    new = np.ones(n, bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    cls = np.empty(n, np.int64)
    cls[order] = np.cumsum(new) - 1
    head = order[new]  # of each class its least document
    least = doc[head]
    later = doc > least[cls]
    out = [(np.flatnonzero(later), np.zeros(int(later.sum()), np.int64), size[later])]
    # between classes
    suffix_order, lcp = deep_shallow(cells[head][:, reach : reach + width], gram)
    rank = np.empty(len(head), np.int64)
    rank[suffix_order] = np.arange(len(head))
    hi, lo = left[head], width - (size[head] - left[head])
    hit = np.zeros((len(head), reach + 1), bool)
    lefts = np.zeros(len(head), np.uint64)
    for o in range(reach + 1):
        if o:
            lefts = mix64(lefts * _A + cells[head, reach - o].astype(np.uint64) + U(1))
        who = np.flatnonzero((lo <= o) & (o <= hi))
        if len(who) < 2:
            continue
        run = np.cumsum(lcp < width - o)[rank[who]]
        by = np.lexsort((least[who], lefts[who], run))
        r, l_, d = run[by], lefts[who][by], least[who][by]
        new = np.ones(len(by), bool)
        new[1:] = (r[1:] != r[:-1]) | (l_[1:] != l_[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        hit[who[by], o] = d > d[first]
    at = np.flatnonzero(hit.any(1))
    if len(at):
        firsts = np.flatnonzero(~later)
        firsts = firsts[hit[cls[firsts]].any(1)]
        mask = np.zeros((len(firsts), reach + 2), bool)
        mask[:, 1:] = hit[cls[firsts]][:, ::-1]  # window starts ascend as o falls
        edge = np.diff(np.concatenate((mask, np.zeros((len(firsts), 1), bool)), axis=1).astype(np.int8), axis=1)
        r1, s1 = np.nonzero(edge == 1)
        _, e1 = np.nonzero(edge == -1)
        shift = left[firsts[r1]] - reach  # window start reach - o within cells; the stretch begins at reach - left
        out.append((firsts[r1], s1 + shift, e1 - 1 + width + shift))
    return tuple(np.concatenate(x) for x in zip(*out))


# ---------------------------------------------------------------- stages


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, sha)`` of each text as UTF-8; a null text is empty."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.unhex(F.sha2(body, 256)).alias("sha"))


def _filter_pack(docs: DataFrame, bitmap, id_col: str, text_col: str, width: int):
    """Ids and compressed texts of documents that pass the bitmap and are long enough."""

    def pack(b: pa.RecordBatch) -> pa.RecordBatch:
        at = pa.array(np.flatnonzero(passes(bitmap.value, b.column(2).to_numpy())))
        z = zstandard.ZstdCompressor(level=3)
        return pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([z.compress(t.encode()) for t in b.column(1).take(at).to_pylist()], pa.binary())], names=["doc_id", "z"])

    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).filter(f"doc_id is not null and octet_length(text) >= {width}")
    return map_arrow(src.withColumn("slot", id_slot("doc_id")), pack, "doc_id long, z binary")


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM):
    """``(spans, base)``: merged removed intervals ``(doc_id, spans binary)`` as int64 pairs, for documents that are
    the first with their text; and ``(doc_id, n_bytes, sha, first)`` of every row, ``first`` being the least id with
    the same text."""
    spark = docs.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(profile(docs, id_col, text_col), "profile")
    firsts = rows.filter("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first"))
    base = materialize(rows.join(firsts, "sha", "left"), "base")
    unique = base.filter(f"doc_id = first and n_bytes >= {width}")
    total = unique.agg(F.sum("n_bytes")).first()[0] or 0
    q_parts = max(shuffle, -(-total * 2 // ((width - gram + 2) * PER_PART)))
    g_parts = max(shuffle, -(-total // (64 << 20)))
    hot_rows = max(HOT, total * 2 // ((width - gram + 2) * HOT_SHARE))
    bitmap = spark.sparkContext.broadcast(id_bitmap(unique, "doc_id"))
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).filter(f"doc_id is not null and octet_length(text) >= {width}")
    src = src.withColumn("slot", id_slot("doc_id"))

    def list_anchors(batches):
        held: list = []
        n = 0

        def flush():
            h, ids, ordinal = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(h, kind="stable")
            h, ids, ordinal = h[order], ids[order], ordinal[order]
            begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            lens = np.diff(np.append(begin, len(h)))
            often = (lens >= OFTEN) & (np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin))
            here = np.repeat(often, lens)
            known, counts = h[begin[often]], lens[often]
            names, out = [], []
            if here.any():  # flagged already
                for g, blob in _mark_blobs(ids[here], ordinal[here], g_parts):
                    names.append(q_parts + g)
                    out.append(blob)
                h, ids, ordinal = h[~here], ids[~here], ordinal[~here]
            part, where = (h % U(q_parts)).astype(np.int64), (known % U(q_parts)).astype(np.int64)
            order, first, begin, end = by_part(part)
            spans = dict(zip(first.tolist(), zip(begin, end)))
            for q in sorted({*spans, *where.tolist()}):
                x, y = spans.get(q, (0, 0))
                pick, own = order[x:y], where == q
                docs_, which = np.unique(ids[pick], return_inverse=True)
                by = np.lexsort((ordinal[pick], which))
                names.append(q)
                out.append(zip_arrays((h[pick][by] >> U(32)).astype("<u4"), which[by].astype("<u4"), ordinal[pick][by].astype("<u4"), docs_.astype("<i8"), (known[own] >> U(32)).astype("<u4"), counts[own].astype("<i8")))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(out, pa.binary())], names=["q", "blob"])

        for b in batches:
            b = b.take(pa.array(np.flatnonzero(passes(bitmap.value, b.column(2).to_numpy()))))
            data, off = utf8(b.column(1))
            ids = b.column(0).to_numpy()
            for i, j in steps(off):
                row, _, _, _, h = anchors(data[off[i] : off[j]], off[i : j + 1] - off[i], width, gram)
                if len(row):
                    first = np.maximum.accumulate(np.where(np.append(True, row[1:] != row[:-1]), np.arange(len(row)), 0))
                    held.append((h, ids[i + row], np.arange(len(row)) - first))
                    n += len(row)
            if n >= FLUSH:
                yield flush()
                n = 0
        if held:
            yield flush()

    blobs = arrow_map(src, list_anchors, "q int, blob binary")

    def flag(q: int, held: list[bytes]):
        if q >= q_parts:
            return [(q - q_parts, x) for x in held]
        cols = [unzip_arrays(x, "<u4", "<u4", "<u4", "<i8", "<u4", "<i8") for x in held]
        often, count = (np.concatenate([c[k] for c in cols]) for k in (4, 5))
        h = np.concatenate([c[0] for c in cols])
        ids = np.concatenate([c[3][c[1]] for c in cols])
        ordinal = np.concatenate([c[2] for c in cols])
        known, at = np.unique(np.concatenate((h, often)), return_inverse=True)
        rows = np.bincount(at, np.concatenate((np.ones(len(h), np.int64), count)), len(known))
        shared = np.zeros(len(known), bool)
        shared[at[len(h) :]] = True  # in two documents of one map task
        at = at[: len(h)]
        least, most = np.full(len(known), 2**63 - 1), np.full(len(known), -(2**63))
        np.minimum.at(least, at, ids)
        np.maximum.at(most, at, ids)
        keep = (shared | (least < most))[at]
        out = list(_mark_blobs(ids[keep], ordinal[keep], g_parts)) if keep.any() else []
        hot = known[rows >= hot_rows].astype(np.int64) * q_parts + q
        if len(hot):
            out.append((-1, zip_arrays(np.zeros(1, "<i8"), np.ones(1, "<i8"), hot.astype("<i8"))))
        return out

    def regroup(g: int, held: list[bytes]):
        if g < 0:
            hot = np.concatenate([unzip_arrays(x, "<i8", "<i8", "<i8")[2] for x in held])
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([hot.tobytes()], pa.binary())], names=["doc_id", "marks"])
        cols = [unzip_arrays(x, "<i8", "<i8", "<u4") for x in held]
        ids = np.concatenate([np.repeat(c[0], c[1]) for c in cols])
        known, count, mark = _grouped(ids, np.concatenate([c[2] for c in cols]))
        return pa.RecordBatch.from_arrays([pa.array(known), as_binary(mark, count)], names=["doc_id", "marks"])

    marks = arrow_map(blobs.repartition(q_parts, "q").sortWithinPartitions("q"), by_key(flag, "g"), "g int, blob binary")
    flags = materialize(arrow_map(marks.repartition(g_parts, "g").sortWithinPartitions("g"), by_key(regroup), "doc_id long, marks binary"), "flags", release=True)
    hot = np.unique(np.concatenate([np.zeros(0, "<i8"), *(np.frombuffer(r["marks"], "<i8") for r in flags.filter("doc_id is null").toLocalIterator())]))
    hot_keys = spark.sparkContext.broadcast(hot.tobytes())  # HOT_SHARE of them at most
    n_marks = flags.filter("doc_id is not null").agg(F.sum(F.length("marks") / 4)).first()[0] or 0
    r_parts = max(shuffle, int(-(-n_marks // PER_SORT)))
    marked = spark.sparkContext.broadcast(id_bitmap(flags.filter("doc_id is not null").select("doc_id"), "doc_id"))
    texts = _filter_pack(docs, marked, id_col, text_col, width)
    joined = flags.join(texts, "doc_id")

    def stretches(batches):
        held: list = []
        n = 0
        hot_known = np.frombuffer(hot_keys.value, "<i8")

        def flush():
            ids, start, left, size, part = (np.concatenate([x[k] for x in held]) for k in range(5))
            text = np.concatenate([x[5] for x in held])
            held.clear()
            at = np.cumsum(size) - size
            order, names, begin, end = by_part(part)
            names_out, out = [], []
            for name, a, b in zip(names.tolist(), begin, end):
                pick = order[a:b]
                where = np.arange(int(size[pick].sum())) + np.repeat(at[pick] - (np.cumsum(size[pick]) - size[pick]), size[pick])
                known, which = np.unique(ids[pick], return_inverse=True)
                names_out.append(name)
                out.append(zip_arrays(which.astype("<u4"), start[pick].astype("<u4"), left[pick].astype("u1"), size[pick].astype("u1"), known.astype("<i8"), text[where]))
            return names_out, out

        def both():
            """Stretches to sort, and the intervals of hot ones that repeat an equal one of the same batch of rows."""
            hot_rows_ = [k for k, x in enumerate(held) if x[6]]
            repeated = []
            if hot_rows_:
                ids, start, left, size, part = (np.concatenate([held[k][c] for k in hot_rows_]) for c in range(5))
                text = np.concatenate([held[k][5] for k in hot_rows_])
                for k in hot_rows_[::-1]:
                    del held[k]
                keep, later = _collapse(text, left, size, part, ids)
                at = np.cumsum(size) - size
                sz = size[keep]
                held.append((ids[keep], start[keep], left[keep], sz, part[keep], _gathered(text, at[keep], sz), False))
                if len(later):
                    repeated.append(zip_arrays(ids[later].astype("<i8"), start[later].astype("<i8"), (start + size)[later].astype("<i8")))
            names, out = flush()
            return pa.RecordBatch.from_arrays([pa.array(names + [-1] * len(repeated), pa.int32()), pa.array(out + repeated, pa.binary())], names=["r", "blob"])

        for whole in batches:
            for s in range(0, whole.num_rows, 200):
                b = whole.slice(s, 200)
                z = zstandard.ZstdDecompressor()
                bodies = [z.decompress(x) for x in b.column(2).to_pylist()]
                off = np.concatenate(([0], np.cumsum([len(x) for x in bodies])))
                data = np.frombuffer(b"".join(bodies), np.uint8)
                ids = b.column(0).to_numpy()
                marks = [np.frombuffer(x, "<u4").astype(np.int64) for x in b.column(1).to_pylist()]
                row, p, s0, s1, h = anchors(data, off, width, gram)
                begin = np.searchsorted(row, np.arange(len(bodies)))
                pick = np.concatenate([begin[k] + m for k, m in enumerate(marks)])
                row, p, s0, end, h = row[pick], p[pick], s0[pick], s1[pick] + width, h[pick]
                key = (h >> U(32)).astype(np.int64) * q_parts + (h % U(q_parts)).astype(np.int64)
                is_hot = np.isin(key, hot_known)
                for hot_part in (False, True):
                    of = np.flatnonzero(is_hot == hot_part)
                    if not len(of):
                        continue
                    at, s_, e_, place = p[of], s0[of], end[of], np.zeros(len(of), np.int64)
                    if hot_part:
                        src_, s_, e_, place = _cut_places(at, s_, e_, width)
                        of, at = of[src_], at[src_]
                    size = e_ - s_
                    part = (mix64(h[of] ^ _B + place.astype(np.uint64)) % U(r_parts)).astype(np.int64)
                    held.append((ids[row[of]], s_ - off[row[of]], at - s_, size, part, _gathered(data, s_, size), hot_part))
                    n += len(of)
                if n >= FLUSH // 4:
                    yield both()
                    n = 0
        if held:
            yield both()

    packed = materialize(arrow_map(joined.select("doc_id", "marks", "z"), stretches, "r int, blob binary"), "stretches", release=True)
    drop(flags)
    cut = "doc_id long, s int, e int"

    def sort(r: int, held: list[bytes]):
        cols = [unzip_arrays(x, "<u4", "<u4", "u1", "u1", "<i8", "u1") for x in held]
        ids = np.concatenate([c[4][c[0]] for c in cols])
        start, left, size = (np.concatenate([c[k] for c in cols]).astype(np.int64) for k in (1, 2, 3))
        row, a, b = matched_windows(np.concatenate([c[5] for c in cols]), left, size, ids, width, gram)
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array((start[row] + a).astype(np.int32)), pa.array((start[row] + b).astype(np.int32))], names=["doc_id", "s", "e"])

    def unpack(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, s, e = (np.concatenate(c) for c in zip(*(unzip_arrays(x, "<i8", "<i8", "<i8") for x in b.column(0).to_pylist())))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["doc_id", "s", "e"])

    sorted_ = arrow_map(packed.filter("r >= 0").repartition(r_parts, "r").sortWithinPartitions("r"), by_key(sort), cut)
    repeated = map_arrow(packed.filter("r = -1").select("blob"), unpack, cut)

    def merge(batches):
        held = None
        for b in batches:
            ids, s, e = (b.column(i).to_numpy() for i in range(3))
            if held is not None:
                ids, s, e = (np.concatenate(x) for x in zip(held, (ids, s, e)))
            if not len(ids):
                continue
            last = int(np.searchsorted(ids, ids[-1]))
            held = (ids[last:], s[last:], e[last:])
            if last:
                yield _merged(ids[:last], s[:last], e[:last])
        if held is not None and len(held[0]):
            yield _merged(*held)

    spans = arrow_map(sorted_.union(repeated).repartition(shuffle, "doc_id").sortWithinPartitions("doc_id", "s"), merge, "doc_id long, spans binary")
    spans = materialize(spans, "spans", release=True)
    drop(packed)
    return spans, base


def _mark_blobs(ids: np.ndarray, ordinal: np.ndarray, parts: int):
    """Partition and blob of the flagged anchors of each partition of documents."""
    order, names, begin, end = by_part((mix64(ids.astype(np.uint64)) % U(parts)).astype(np.int64))
    for g, a, b in zip(names.tolist(), begin, end):
        yield g, zip_arrays(*_grouped(ids[order[a:b]], ordinal[order[a:b]]))


def _cut_places(at: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int):
    """Stretches ``(row, begin, end, place)`` around the anchors ``at``, each for the windows that hold the anchor at
    one of PLACES neighbouring places."""
    lo, hi = width - (end - at), at - begin  # places of the anchor in the stretch's windows
    count = hi // PLACES - lo // PLACES + 1
    row = np.repeat(np.arange(len(at)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo // PLACES, count)
    low, high = np.maximum(lo[row], place * PLACES), np.minimum(hi[row], place * PLACES + PLACES - 1)
    return row, at[row] - high, at[row] + width - low, place + 1


def _collapse(text: np.ndarray, left: np.ndarray, size: np.ndarray, part: np.ndarray, doc: np.ndarray):
    """Of equal stretches of one partition, the rows of the least document, and those of later documents."""
    at = np.cumsum(size) - size
    raw = text.tobytes()
    codes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a : a + n]) for a, n in zip(at.tolist(), size.tolist())), "<u8").reshape(-1, 2)
    keys = (left, size, part, codes[:, 0], codes[:, 1])
    order = np.lexsort((doc, *keys))
    same = np.ones(len(order) - 1, bool)
    for c in keys:
        same &= c[order][1:] == c[order][:-1]
    new = np.append(True, ~same)
    least = doc[order[new]][np.cumsum(new) - 1]
    return order[doc[order] == least], order[doc[order] > least]


def _grouped(ids: np.ndarray, marks: np.ndarray):
    """Distinct ids, how many marks each has, and the marks in that order."""
    by = np.argsort(ids, kind="stable")
    known, count = np.unique(ids[by], return_counts=True)
    return known.astype("<i8"), count.astype("<i8"), marks[by].astype("<u4")


def _merged(ids: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    """Union of intervals for each document; rows are ordered by document and begin."""
    s, e = s.astype(np.int64), e.astype(np.int64)
    doc = np.cumsum(np.append(0, ids[1:] != ids[:-1]))
    lift = doc * (int(e.max()) + 2)
    top = np.maximum.accumulate(e + lift)
    new = np.ones(len(ids), bool)
    new[1:] = (s + lift)[1:] > top[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids)) - 1
    pairs = np.stack((s[first], top[last] - lift[last]), axis=1)
    known, count = np.unique(ids[first], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(known), as_binary(pairs.reshape(-1).astype("<i8"), 2 * count)], names=["doc_id", "spans"])


def cut_spans(raw: bytes, spans: np.ndarray) -> bytes:
    keep, at = [], 0
    for s, e in spans.reshape(-1, 2).tolist():
        keep.append(raw[at:s])
        at = e
    keep.append(raw[at:])
    return b"".join(keep)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row and, with ``with_text``, ``kept binary``
    where something but not all was removed (null elsewhere).

    A null text is empty.  Ids must be unique but for repeated rows, which stay as many as they are and remove nothing
    from each other; a row with a null id is left as it is and removes nothing.
    """
    spark = docs.sparkSession
    spans, base = duplicate_spans(docs, id_col, text_col, width)
    marked = spark.sparkContext.broadcast(id_bitmap(spans.select("doc_id"), "doc_id"))
    joined = _filter_pack(docs, marked, id_col, text_col, width).join(spans, "doc_id")

    def digest(b: pa.RecordBatch) -> pa.RecordBatch:
        z = zstandard.ZstdDecompressor()
        removed, count, sha, kept = [], [], [], []
        for blob, sp in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            raw = z.decompress(blob)
            pairs = np.frombuffer(sp, "<i8")
            left = cut_spans(raw, pairs)
            removed.append(len(raw) - len(left))
            count.append(len(pairs) // 2)
            sha.append(hashlib.sha256(left).digest())
            kept.append(left if with_text else None)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.binary()), pa.array(kept, pa.binary())], names=["doc_id", "removed", "spans", "kept_sha", "kept"])

    results = map_arrow(joined.select("doc_id", "z", "spans").dropDuplicates(["doc_id"]), digest, "doc_id long, removed long, spans long, kept_sha binary, kept binary")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)) & (F.col("n_bytes") >= width)
    empty = hashlib.sha256(b"").hexdigest()
    out = base.join(results, "doc_id", "left").select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.lower(F.hex(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
        *([F.when(copy, F.lit(None)).otherwise(F.col("kept")).alias("kept")] if with_text else []),
    )
    return out


def _gathered(data: np.ndarray, at: np.ndarray, size: np.ndarray, step: int = 1 << 21) -> np.ndarray:
    """``data[at : at + size]`` of each, one after the other, by parts of about ``step`` bytes."""
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, data.dtype)
    i = 0
    while i < len(size):
        lo = int(ends[i] - size[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + step, side="right")))
        where = np.arange(int(ends[j - 1]) - lo) + np.repeat(at[i:j] - (ends[i:j] - size[i:j] - lo), size[i:j])
        out[lo : int(ends[j - 1])] = data[where]
        i = j
    return out


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with the removed bytes cut from their texts, and all other columns as they are.

    Characters of which a part was removed go whole.  Repeated rows of one id are treated alike.  A null text stays null; later copies of a whole text become
    empty.  A column ``n_chars``, where there is one, counts the new text.
    """
    spans, base = duplicate_spans(docs, id_col, text_col, width)
    copies = base.filter(f"doc_id > first and n_bytes >= {width}").select("doc_id", F.lit(None).cast("binary").alias("spans")).distinct()
    cut = spans.union(copies).withColumnRenamed("doc_id", "_id").withColumn("_cut", F.lit(True))
    joined = docs.join(cut, docs[id_col].cast("long") == F.col("_id"), "left").drop("_id")
    names, at = docs.columns, docs.columns.index(text_col)
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType, True) for f in docs.schema])

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        spans_of, cut_of = b.column(len(names)), b.column(len(names) + 1)
        texts = b.column(at).to_pylist()
        for i in np.flatnonzero(cut_of.fill_null(False).to_numpy(zero_copy_only=False)).tolist():
            if texts[i] is not None:
                sp = spans_of[i].as_py()
                raw = texts[i].encode()
                texts[i] = "" if sp is None else cut_spans(raw, np.frombuffer(sp, "<i8")).decode("utf-8", "ignore")
        cols = [b.column(k) for k in range(len(names))]
        cols[at] = pa.array(texts, pa.string())
        if "n_chars" in names:
            k = names.index("n_chars")
            cols[k] = pa.array([None if t is None else len(t) for t in texts], cols[k].type)
        return pa.RecordBatch.from_arrays(cols, names=names)

    return map_arrow(joined, fn, schema)


assert sys.byteorder == "little", "machine words are read as little-endian"
