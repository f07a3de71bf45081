"""Near-duplicate documents by a grouped prefix join over word n-grams (exact Jaccard).

1. A fixed-size sketch counts shingles over the whole corpus; shingles are ordered by the logarithm of their
   count in excess of the usual counter, then by hash.  Any total order makes prefix filtering lossless; this one
   keeps frequent shingles out of the prefixes.
2. Each document becomes a set size, a 64-bit set hash (its class), its prefix and a parity bitmap.  Documents with
   the same prefix and size are one group; a group, whatever it holds, goes once into the list of each shingle of
   its prefix.  Shingles that the sketch calls frequent have lists in several salted parts.  Lists of the same groups
   are one list.
3. Group pairs are filtered: in a list, a group stays if another group of it has a size that fits.  Then groups are
   expanded to their classes, and a group of several classes is a list of its own besides.
4. Instead of all pairs of a list, rounds verify star pairs: every member with one leader of its list, the class that
   is in the most lists.  The leader then leaves the list, since its pairs are settled.  Verified links are contracted
   by one step towards their components, and members that have met in one do not meet again.
5. What lists still hold after the rounds, or after the first if it is little, is compared in blocks:
   members outside of a list's largest component with each other and with that component's.  A pair that several lists
   hold leaves the first of them only, and waves verify each member's likeliest pairs first: what these link need not
   be looked at again, what a wave has left out meets in the next, and the last leaves out nothing.  No cap applies
   anywhere, so nothing is lost.  Components are settled once, at the end.
6. Sizes and parity bitmaps bound the overlap of a pair; pairs that can reach the similarity are verified by joining
   their compressed texts and intersecting their full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlink.llm.common import U, arrow_map, as_binary, by_key, by_part, distinct_sets, id_bitmap, id_slot, map_arrow, mix64, passes, release, shingles, steps, unzip_arrays, utf8, word_hashes, zip_arrays
from strandlink.operators.components import connected_components, contract
from strandlink.plans.stages import drop, materialize

SKETCH_BITS = 21
SKETCH_PART = 4096
#: A list's usual length; more frequent shingles are salted.
LIST = 2048
#: Rows of a chunk where a list is compared in blocks.
CHUNK = 512
#: Postings that one partition holds on average.
PER_PART = 500_000
STAR_ROUNDS = 3
#: After the first, rounds end once what :func:`_across` would compare is no more than this for each document.
FEW_MEETINGS = 64
#: Pairs that each member of a block may send in the waves of the last round, which end once no block keeps any back.
WAVES = (16, None)
#: First lists of a class that its members carry, to tell which list a pair leaves.
FIRST = 16


def _sets(data, offsets, n, k):
    """Distinct shingles of each row as (hash, row), ordered by row and hash."""
    w, rows, _, _ = word_hashes(data, offsets)
    h, r, _ = shingles(w, rows, n, k)
    return distinct_sets(h, r)


def sketch(docs: DataFrame, k: int = 5, text_col: str = "text") -> np.ndarray:
    """Document frequencies of hashed shingles in 2^SKETCH_BITS counters (16 MB on the driver at any size)."""
    size = 1 << SKETCH_BITS

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            data, off = utf8(b.column(0))
            for i, j in steps(off):
                h, _ = _sets(data[off[i] : off[j]], off[i : j + 1] - off[i], j - i, k)
                total += np.bincount((h >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        parts = total.reshape(-1, SKETCH_PART)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([_narrow(p) for p in parts])], names=["part", "c"])

    def add(batches):
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            for part, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = _widen(c)
                acc[part] = acc[part] + x if part in acc else x
        if acc:
            yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int32()), pa.array([_narrow(x) for x in acc.values()])], names=["part", "c"])

    schema = "part int, c binary"
    rows = arrow_map(arrow_map(docs.select(docs[text_col].cast("string").alias("text")), count, schema).repartition("part"), add, schema)
    out = np.zeros(size, np.int64)
    for r in rows.collect():
        out[r["part"] * SKETCH_PART : (r["part"] + 1) * SKETCH_PART] = _widen(r["c"])
    return out


def _narrow(counts: np.ndarray) -> bytes:
    """Counters in the fewest bytes that hold them, compressed; the first byte is that width."""
    top = int(counts.max())
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(counts.astype(f"<u{width}").tobytes())


def _widen(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), f"<u{blob[0]}").astype(np.int64)


def prefix_length(n, percent: int):
    """Shingles of a set of ``n`` that any set with Jaccard of ``percent`` or more must share one of."""
    return n - (n * percent + 99) // 100 + 1


def parity(h: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps of sets: bytes, one bitmap after the other, and the length of each.

    A bitmap has a power of two of bits, twice the set's size or more, and a bit is the parity of the elements that
    fall on it.  Halves XORed together make the bitmap of half the length.
    """
    bits = np.where(sizes > 0, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 64))).astype(np.int64), 0)
    begin = np.cumsum(bits) - bits
    at = begin[rows] + (h & (bits[rows] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(bits.sum())) & 1
    return np.packbits(odd.astype(bool), bitorder="little"), bits // 8


def fold(bitmaps: np.ndarray, width: int) -> np.ndarray:
    """Rows of parity bitmaps, as 64-bit words, at a shorter length."""
    while bitmaps.shape[1] > width:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] ^ bitmaps[:, half:]
    return bitmaps


def slack(sa, sb, percent: int):
    """Elements that two sets of these sizes may differ in at the similarity; negative where sizes alone forbid it."""
    need = (percent * (sa + sb) + 99 + percent) // (100 + percent)
    return np.where(100 * np.minimum(sa, sb) >= percent * np.maximum(sa, sb), sa + sb - 2 * need, -1)


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Logarithms of the counts in excess of the usual counter; one copy of the counters at a time."""
    # a counter holds many rare shingles besides a frequent one: what exceeds the usual counter tells
    usual = float(np.median(counts))
    excess = counts - usual
    excess -= 3 * np.sqrt(usual)
    np.maximum(excess, 1, out=excess)
    np.log2(excess, out=excess)
    np.floor(excess, out=excess)
    return excess.astype(np.uint8)


def signatures(docs: DataFrame, counts: np.ndarray, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, cls, grp, num, prefix, ranks, bits)``: set size, set hash, hash of prefix and size, a
    number of the row, the rarest shingles (48 bits of each) and the ranks of their counts, and the parity bitmap."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks_of(counts))
    names = ["doc_id", "n_shingles", "cls", "grp", "num", "prefix", "ranks", "bits"]

    def run(batches):
        rank = shared.value
        task, n_rows = TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            data, off = utf8(b.column(1))
            cols: list[list] = [[] for _ in range(6)]
            for i, j in steps(off):
                n = j - i
                h, r = _sets(data[off[i] : off[j]], off[i : j + 1] - off[i], n, k)
                sizes = np.bincount(r, minlength=n)
                begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
                c = rank[(h >> U(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((h, c, r))
                got = np.where(sizes > 0, prefix_length(sizes, percent), 0)
                pick = order[np.arange(len(h)) - np.repeat(begin, sizes) < np.repeat(got, sizes)]
                cols[0].append(sizes)
                cols[1].append(_set_hash(mix64(h ^ U(0x1234567)), begin, sizes, sizes))
                cols[2].append(_set_hash(mix64(h[pick] ^ U(0x7654321)), np.cumsum(got) - got, got, sizes))
                cols[3].append(as_binary((h[pick] >> U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].ravel(), 6 * got))
                cols[4].append(as_binary(c[pick], got))
                cols[5].append(as_binary(*parity(h, r, sizes)))
            num = (np.int64(task) << np.int64(33)) + n_rows + np.arange(b.num_rows)
            n_rows += b.num_rows
            flat = [pa.array(np.concatenate(x)) for x in cols[:3]]
            yield pa.RecordBatch.from_arrays([b.column(0), *flat, pa.array(num), *map(pa.concat_arrays, cols[3:])], names=names)

    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return arrow_map(src, run, "doc_id long, n_shingles long, cls long, grp long, num long, prefix binary, ranks binary, bits binary")


def _set_hash(h: np.ndarray, begin: np.ndarray, lens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.append(U(0), np.cumsum(h, dtype=np.uint64))
    return mix64(ends[begin + lens] - ends[begin] + sizes.astype(np.uint64)).view(np.int64)


def _postings(named: DataFrame, parts: int) -> DataFrame:
    """Prefix shingles of rows ``(grp, num, prefix, ranks)``, packed by hash partition; a group counts once a batch.

    A blob holds 32 bits of each shingle (its partition knows more of it; a collision only adds a candidate) and the
    numbers of rows as differences, so a posting takes some six bytes however many partitions there are.  A
    shingle that is frequent by its rank goes to several partitions, by row.
    """

    def pack(batches):
        for b in batches:
            if not b.num_rows:
                continue
            b = b.take(pa.array(np.sort(np.unique(b.column(0).to_numpy(), return_index=True)[1])))
            nums = b.column(1).to_numpy()
            data, off = utf8(b.column(2))
            lens = np.diff(off) // 6
            tokens = np.zeros((int(lens.sum()), 8), np.uint8)
            tokens[:, :6] = data.reshape(-1, 6)
            tokens = tokens.view("<u8").ravel()
            ranks = utf8(b.column(3))[0].astype(np.int64)
            which = np.repeat(np.arange(len(nums)), lens)
            lg = np.maximum(ranks + 1 - int(np.log2(LIST)), 0).astype(np.uint8)
            part = (mix64(tokens) + _salt(nums[which], lg)) % U(parts)
            order, names, first, end = by_part(part.astype(np.int64))
            out = []
            for x, y in zip(first, end):
                pick = order[x:y]
                known, local = np.unique(which[pick], return_inverse=True)
                out.append(zip_arrays((tokens[pick] >> U(16)).astype("<u4"), _steps(local), lg[pick], _steps(nums[known])))
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(out, pa.binary())], names=["q", "blob"])

    return arrow_map(named.select("grp", "num", "prefix", "ranks"), pack, "q int, blob binary")


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of an ascending array, its first value at the front, as byte planes."""
    return np.diff(ascending.astype("<i8"), prepend=0).view(np.uint8).reshape(-1, 8).T.copy()


def _unsteps(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel())


def _salt(ids: np.ndarray, lg: np.ndarray) -> np.ndarray:
    return mix64(ids.astype(np.uint64)) & ((U(1) << lg.astype(np.uint64)) - U(1))


def _part_name(name: np.ndarray, ids: np.ndarray, lg: np.ndarray) -> np.ndarray:
    """Names of the parts of salted lists; other lists keep theirs."""
    return np.where(lg > 0, mix64(name + U(1) + _salt(ids, lg)), name)


def _shared_lists(postings: DataFrame, parts: int) -> DataFrame:
    """``(token, part, num)``: lists of two or more rows, a row for each member.

    Shingles with the same members make one list, named (``token``) by a hash of its members: near duplicates share
    most of their prefixes, so this leaves few lists.  Lists of frequent shingles keep their own name whatever their
    length, since other parts of them lie elsewhere: ``part`` names each part with its salt, in its own partition.
    """

    def close(q: int, held: list[bytes]) -> pa.RecordBatch | None:
        cols = [unzip_arrays(x, "<u4", "u1", "u1", "u1") for x in held]
        h, lg = (np.concatenate([c[k] for c in cols]) for k in (0, 2))
        num = np.concatenate([_unsteps(c[3])[_unsteps(c[1])] for c in cols])
        home = (U(q) + U(parts) * (U(1) + _salt(num, lg) // U(parts)) - _salt(num, lg)) % U(parts)
        token = mix64((h.astype(np.uint64) << U(32)) + home)
        order = np.lexsort((num, token))
        token, num, lg = token[order], num[order], lg[order]
        once = np.append(True, (token[1:] != token[:-1]) | (num[1:] != num[:-1]))
        token, num, lg = token[once], num[once], lg[once]
        begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        lens = np.diff(np.append(begin, len(token)))
        salted = lg > 0
        name = np.repeat(mix64(np.add.reduceat(mix64(num.astype(np.uint64)), begin) + lens.astype(np.uint64)), lens)
        name = np.where(salted, token, name)
        keep = np.repeat(lens > 1, lens) | salted
        if not keep.any():
            return None
        name, num, lg = _once(name[keep], num[keep], lg[keep])
        order, names, first, end = by_part((_part_name(name, num, lg) % U(parts)).astype(np.int64))
        blobs = [zip_arrays(name[order[x:y]], num[order[x:y]], lg[order[x:y]]) for x, y in zip(first, end)]
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(blobs, pa.binary())], names=["p", "blob"])

    def join(p: int, held: list[bytes]) -> pa.RecordBatch:
        name, num, lg = _once(*(np.concatenate(c) for c in zip(*(unzip_arrays(x, "<u8", "<i8", "u1") for x in held))))
        return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(_part_name(name, num, lg).view(np.int64)), pa.array(num)], names=["token", "part", "num"])

    lists = arrow_map(postings.repartition(parts, "q").sortWithinPartitions("q"), by_key(close), "p int, blob binary")
    return arrow_map(lists.repartition(parts, "p").sortWithinPartitions("p"), by_key(join), "token long, part long, num long")


def _once(name, num, lg):
    """Distinct members of each list, ordered by list and number."""
    order = np.lexsort((num, name))
    name, num, lg = name[order], num[order], lg[order]
    once = np.append(True, (name[1:] != name[:-1]) | (num[1:] != num[:-1]))
    return name[once], num[once], lg[once]


def _filtered(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct rows ``(token, part, grp, size)`` of lists without the groups whose size fits no other group of the list.

    Of all sizes, the next ones on either side are those that fit if any does.  A list of one part, which is named as
    the list, is ordered as a whole, which its usual length bounds; parts of a salted list stay as they are.  All of it
    happens where one shuffle by part has put the rows.
    """
    by_size = W.partitionBy("part").orderBy("size", "grp")
    fits = (F.lag("size").over(by_size) * 100 >= percent * F.col("size")) | (F.lead("size").over(by_size) * percent <= 100 * F.col("size"))
    once = lists.repartition("part").distinct()
    return once.withColumn("fits", (F.col("token") != F.col("part")) | F.coalesce(fits, F.lit(False))).filter("fits").drop("fits")


def _expanded(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """``(token, part, cid, size)``: the lists with all classes of each group, and a list of each group's own."""
    several = groups.groupBy("grp").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo < hi").select("grp")
    own = groups.join(several, "grp").select(F.col("grp").alias("token"), F.col("grp").alias("part"), F.col("cls").alias("cid"), "size")
    return lists.drop("size").join(groups, "grp").select("token", "part", F.col("cls").alias("cid"), "size").unionByName(own)


def _lists(df: DataFrame, keys: list[str], columns: list[str], fn, schema: str) -> DataFrame:
    """Apply ``fn`` to the rows of each key, as numpy columns, many keys a batch; a key's rows are carried over
    from batch to batch until it is complete."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select(*keys, *columns).repartition(parts, *keys).sortWithinPartitions(*keys, *columns[:2])
    width = len(keys) + len(columns)

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
            if held is not None:
                now = [np.concatenate((x, y)) for x, y in zip(held, now)]
            n = len(now[0])
            change = np.zeros(n, bool)
            for c in now[: len(keys)]:
                change[1:] |= c[1:] != c[:-1]
            cut = np.flatnonzero(change)
            if not len(cut):
                held = now
                continue
            held = [c[cut[-1] :] for c in now]
            yield from fn([c[: cut[-1]] for c in now], np.concatenate(([0], cut[:-1])))
        if held is not None:
            n = len(held[0])
            change = np.zeros(n, bool)
            for c in held[: len(keys)]:
                change[1:] |= c[1:] != c[:-1]
            yield from fn(held, np.concatenate(([0], np.flatnonzero(change))))

    return arrow_map(ordered, run, schema)


def possible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sizes and parity bitmaps allow the similarity; ``bits`` is ``(cid, size, bits)``."""

    def test(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 8192):
                b = batch.slice(s, 8192)
                sa, sb = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy().astype(np.int64)
                room = slack(sa, sb, percent)
                (da, oa), (db, ob) = utf8(b.column(4)), utf8(b.column(5))
                wa, wb = np.diff(oa) // 8, np.diff(ob) // 8
                good = np.zeros(b.num_rows, bool)
                for x, y in {(int(x), int(y)) for x, y in zip(wa[room >= 0], wb[room >= 0])}:
                    at = np.flatnonzero((wa == x) & (wb == y) & (room >= 0))
                    left = fold(_words(da, oa, at, x), min(x, y))
                    right = fold(_words(db, ob, at, y), min(x, y))
                    good[at] = np.bitwise_count(left ^ right).sum(1, dtype=np.int64) <= room[at]
                yield b.take(pa.array(np.flatnonzero(good))).select([0, 1])

    near = pairs.join(bits.select(F.col("cid").alias("a"), F.col("size").alias("sa"), F.col("bits").alias("ba")), "a").join(bits.select(F.col("cid").alias("b"), F.col("size").alias("sb"), F.col("bits").alias("bb")), "b")
    return arrow_map(near.select("a", "b", "sa", "sb", "ba", "bb"), test, "a long, b long")


def _words(data: np.ndarray, off: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The bitmaps of some rows, all of ``width`` words."""
    return data[off[at][:, None] + np.arange(8 * width)].view("<u8")


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pairs ``(a, b)`` of classes whose shingle sets have a Jaccard of ``percent`` or more; ``classes`` names a
    document ``(cls, cid)`` of each."""
    spark = docs.sparkSession
    ids = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(classes, "cls").select("cls", F.col("cid").alias("id"))
    ids = materialize(ids, "wanted")
    bitmap = spark.sparkContext.broadcast(id_bitmap(ids, "id"))
    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).filter("id is not null and text is not null")

    def pack(b: pa.RecordBatch) -> pa.RecordBatch:
        z = zstandard.ZstdCompressor(level=3)
        b = b.take(pa.array(np.flatnonzero(passes(bitmap.value, b.column(2).to_numpy()))))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress(t.encode()) for t in b.column(1).to_pylist()], pa.binary())], names=["id", "z"])

    slotted = src.select("id", "text", id_slot("id").alias("slot"))
    texts = map_arrow(slotted, pack, "id long, z binary").join(ids, "id").dropDuplicates(["id"]).select(F.col("cls").alias("id"), "z")
    texts = materialize(texts, "texts", release=True)

    def compare(batches):
        for whole in batches:
            z = zstandard.ZstdDecompressor()
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                bodies, index, where = [], {}, []
                for ids_, zs in ((b.column(0).to_pylist(), b.column(2).to_pylist()), (b.column(1).to_pylist(), b.column(3).to_pylist())):
                    for i, x in zip(ids_, zs):
                        if i not in index:
                            index[i] = len(bodies)
                            bodies.append(z.decompress(x))
                        where.append(index[i])
                off = np.concatenate(([0], np.cumsum([len(x) for x in bodies])))
                h, r = _sets(np.frombuffer(b"".join(bodies), np.uint8), off, len(bodies), k)
                size = np.bincount(r, minlength=len(bodies))
                begin = np.concatenate(([0], np.cumsum(size)))
                n = b.num_rows
                good = np.zeros(n, bool)
                for p in range(n):
                    x, y = where[p], where[n + p]
                    if not 100 * min(size[x], size[y]) >= percent * max(size[x], size[y]):
                        continue
                    u, v = h[begin[x] : begin[x + 1]], h[begin[y] : begin[y + 1]]
                    at = np.searchsorted(u, v)
                    at[at == len(u)] = 0
                    both = int((u[at] == v).sum()) if len(u) else 0
                    good[p] = 100 * both >= percent * (size[x] + size[y] - both)
                yield b.take(pa.array(np.flatnonzero(good))).select([0, 1])

    near = pairs.join(texts.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b").join(texts.select(F.col("id").alias("a"), F.col("z").alias("za")), "a")
    out = materialize(arrow_map(near.select("a", "b", "za", "zb"), compare, "a long, b long"), "near", release=True)
    drop(texts)
    drop(ids)
    return out


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    Two documents link if the Jaccard similarity of their sets of ``k``-word shingles is ``percent`` / 100 or more;
    a text of fewer words has one shingle of them all.  A null text, or one without words, has size 0 and links
    with nothing.  Ids must be unique but for repeated rows; a row with a null id is its own component, null.
    """
    sig = materialize(signatures(docs, sketch(docs, k, text_col), percent, k, id_col, text_col), "signatures")
    release()  # of the driver: the sketch
    named = sig.filter("n_shingles > 0 and doc_id is not null")
    slim = materialize(sig.select("doc_id", "n_shingles", "cls", "grp", "num"), "documents")
    known = slim.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(known.groupBy("cls").agg(F.min("doc_id").alias("cid"), F.min("grp").alias("grp"), F.min("n_shingles").alias("size")), "classes")
    total, n_docs = named.agg(F.sum(F.length("ranks")), F.count("*")).first()
    parts = int(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // PER_PART)))

    members = _shared_lists(_postings(named, parts), parts)
    members = members.join(known.select("num", "grp", F.col("n_shingles").alias("size")), "num").select("token", "part", "grp", "size")
    lists = materialize(_filtered(members, percent), "lists", release=True)
    rest = materialize(_expanded(lists, classes.select("grp", "cls", "size")), "members")
    drop(lists)
    wanted = rest.select(F.col("cid").alias("cls")).distinct()
    of = named.select("cls", F.col("n_shingles").alias("size"), "bits").join(wanted, "cls").dropDuplicates(["cls"])
    bits = materialize(of.select(F.col("cls").alias("cid"), "size", "bits"), "bitmaps", release=True)
    drop(sig)

    def as_pairs(df, a, b):
        return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

    def verified(pairs):
        return verify(pairs, docs, classes, percent, k, id_col, text_col).select(F.col("b").alias("a"), F.col("a").alias("b"))

    # links (a > b) of the rounds so far, contracted by one step each: what a class is linked to is in its component
    forest = checked = last = None
    for step in range(STAR_ROUNDS + 1):
        state = rest.groupBy("cid").agg(F.count("*").alias("degree"))
        if forest is None:
            state = state.withColumn("comp", F.col("cid"))
        else:
            state = _labelled(state, forest)
        seen = materialize(rest.select("token", "part", "cid", "size").join(state, "cid"), "state")
        mixed = seen.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("degree", "cid", "size", "comp")).alias("top"), F.count("*").alias("n")).filter("lo < hi")
        # the leader goes to each part of its list, so that the join's key is as salted as the list is
        leaders = seen.select("token", "part").distinct().join(mixed.select("token", "top", "n"), "token")
        led = materialize(seen.join(leaders, ["token", "part"]).select("token", "part", "cid", "size", "comp", F.col("top.cid").alias("leader"), F.col("top.size").alias("leader_size"), F.col("top.comp").alias("leader_comp"), "n"), "led")
        drop(rest)
        drop(seen)
        drop(last)
        # members outside of the leader's component meet all of their list
        meetings = led.filter("comp <> leader_comp").agg(F.sum("n")).first()[0]
        if not meetings:
            break
        if step == STAR_ROUNDS or (step > 0 and meetings <= FEW_MEETINGS * n_docs):
            forest = _waves(led, bits, forest, checked, verified, percent)
            break
        fits = (F.col("comp") != F.col("leader_comp")) & (100 * F.least("size", "leader_size") >= percent * F.greatest("size", "leader_size"))
        found = possible(as_pairs(led.filter(fits), "cid", "leader").distinct(), bits, percent)
        fresh = materialize(found if checked is None else found.join(checked, ["a", "b"], "left_anti"), "pairs")
        if not fresh.isEmpty():
            more = verified(fresh)
            contracted = materialize(contract(more if forest is None else forest.union(more)), "forest")
            drop(forest)
            forest = contracted
            checked = fresh if checked is None else checked.union(fresh)
        rest, last = led.filter("cid <> leader"), led

    if forest is None:
        component = classes.select("cls", "cid", F.col("cls").alias("component"))
    else:
        labels = connected_components(forest, "a", "b").withColumnRenamed("id", "cls")
        component = classes.join(labels, "cls", "left").select("cls", "cid", F.coalesce("component", "cls").alias("component"))
    # components are named by their least document
    component = materialize(component, "of-class")
    least = component.groupBy("component").agg(F.min("cid").alias("component_id"))
    named_by = component.join(least, "component").select("cls", "component_id")
    slim = slim.select("doc_id", "n_shingles", "cls")
    joined = slim.filter("n_shingles > 0 and doc_id is not null").join(named_by, "cls").select("doc_id", "n_shingles", "component_id")
    return joined.union(slim.filter("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", "doc_id"))


def _labelled(rows: DataFrame, forest: DataFrame) -> DataFrame:
    """Rows with a class ``cid`` and, as ``comp``, the least class that contracted links lead it to."""
    labels = forest.groupBy(F.col("a").alias("cid")).agg(F.min("b").alias("component"))
    return rows.join(labels, "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")


def _waves(led: DataFrame, bits: DataFrame, forest: DataFrame | None, checked: DataFrame | None, verified, percent: int) -> DataFrame | None:
    """The links ``forest`` with those that settle what ``led`` still holds; ``verified`` keeps the links of some pairs.

    Two components whose members all resemble each other need one link, not all of theirs: each wave verifies a few pairs of
    each member and contracts what links.  Lists that have left pairs out meet again, with the new components.
    """
    left = led
    for quota in WAVES:
        met = materialize(_across(left, bits, percent, quota), "met")
        found = met.filter("a is not null").select("a", "b").distinct()
        fresh = materialize(found if checked is None else found.join(checked, ["a", "b"], "left_anti"), "pairs")
        again = met.filter("a is null").select("token").distinct()
        done = quota is None or again.isEmpty()
        if not fresh.isEmpty():
            more = verified(fresh)
            forest = more if forest is None else forest.union(more)
            for _ in range(0 if done else 2):  # the likeliest pairs make long paths
                forest = materialize(contract(forest), "forest")
            checked = fresh if checked is None else checked.union(fresh)
        if done:
            return forest
        left = left.select("token", "part", "cid", "size").join(again, "token", "left_semi")
        left = materialize(left.withColumn("comp", F.col("cid")) if forest is None else _labelled(left, forest), "left")
    return forest


def _firsts(led: DataFrame) -> DataFrame:
    """``(cid, firsts)``: the least names, ascending, of the lists that hold a class."""
    by_name = W.partitionBy("cid").orderBy("token")
    least = led.select("cid", "token").withColumn("at", F.row_number().over(by_name)).filter(F.col("at") <= FIRST)
    return least.groupBy("cid").agg(F.sort_array(F.collect_list("token")).alias("firsts"))


def _across(led: DataFrame, bits: DataFrame, percent: int, quota: int | None = None) -> DataFrame:
    """``(a, b, token)``: pairs of different components within lists that sizes and parity bitmaps allow, by blocks of two
    chunks, without ``token``; and without a pair the lists that left pairs out, as each row of a block sends but
    ``quota`` pairs, those whose bitmaps leave the most room.

    A list's largest component needs no comparison with itself: its chunks meet only those of the others, so a list
    that one component fills costs what its few others cost.  Pairs that fail never leave their block, and neither do
    pairs that another list of a lesser name sends.  A row knows the first ``FIRST`` of its lists: if two rows share
    one of these, the least they share is the least of all lists they share, so the pair leaves just there.
    """
    counts = led.groupBy("token", "comp").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("token").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("all")).filter("most.n < all")
    sizes = sizes.select("token", F.col("most.comp").alias("major"), F.ceil(F.col("most.n") / F.lit(CHUNK)).cast("int").alias("majors"), F.ceil((F.col("all") - F.col("most.n")) / F.lit(CHUNK)).cast("int").alias("minors"))
    homes = led.select("token", "part").distinct().join(sizes, "token")
    # chunks of the largest component are numbered down from -1, those of the others up from 0
    inner = F.col("comp") == F.col("major")
    chunk = F.when(inner, -1 - F.pmod(F.xxhash64("cid"), F.col("majors"))).otherwise(F.pmod(F.xxhash64("cid"), F.col("minors"))).cast("int")
    others = F.when(inner, F.sequence(F.lit(0), F.col("minors") - 1)).otherwise(F.sequence(-F.col("majors"), F.col("minors") - 1))
    blocks = (
        led.join(homes, ["token", "part"])
        .join(bits.select("cid", "bits").join(_firsts(led), "cid"), "cid")
        .select("token", "comp", "cid", "size", "bits", "firsts", chunk.alias("c"), F.explode(others).alias("o"))
        .select("token", F.least("c", "o").alias("ci"), F.greatest("c", "o").alias("cj"), "size", "cid", "comp", "c", "bits", "firsts")
    )

    def cross(cols, begin):
        token, ci, cj, size, cid, comp, c, blobs, firsts = cols
        ends = np.append(begin[1:], len(cid))
        out_a, out_b, cut = [], [], []
        for s, e in zip(begin.tolist(), ends.tolist()):
            if e - s < 2 or (comp[s:e] == comp[s]).all():
                continue
            sz, cm, cc, ids = size[s:e].astype(np.int64), comp[s:e], c[s:e], cid[s:e]
            widths = np.array([len(x) // 8 for x in blobs[s:e]])
            # names of earlier lists, no list's name where there are fewer
            earlier = np.full((e - s, FIRST), token[s])
            for k, x in enumerate(firsts[s:e]):
                earlier[k, : len(x)] = np.minimum(x, token[s])
            of_i, of_j, spare = [], [], []
            # rows ascend by size, so bitmaps ascend by length; those that fit are as long or twice as long
            for w in np.unique(widths):
                own = np.flatnonzero(widths == w)
                reach = np.flatnonzero((widths == w) | (widths == 2 * w))
                maps = np.concatenate([fold(np.frombuffer(b"".join(blobs[s + k] for k in reach if widths[k] == x), "<u8").reshape(-1, x), w) for x in (w, 2 * w) if (widths == x).any()])
                for i in own.tolist():
                    at = i - own[0]
                    room = slack(sz[i], sz[reach[at + 1 :]], percent)
                    j = reach[at + 1 :]
                    ok = (room >= 0) & (cm[j] != cm[i])
                    if ci[s] != cj[s]:
                        ok &= cc[j] != cc[i]
                    where = np.flatnonzero(ok)
                    if len(where):
                        left = room[where] - np.bitwise_count(maps[at + 1 + where] ^ maps[at]).sum(1, dtype=np.int64)
                        j, left = j[where[left >= 0]], left[left >= 0]
                        mine = earlier[i][earlier[i] < token[s]]
                        if len(j) and len(mine):
                            once = ~np.isin(earlier[j], mine).any(1)
                            j, left = j[once], left[once]
                        of_i.append(np.full(len(j), i))
                        of_j.append(j)
                        spare.append(left)
            if not of_i:
                continue
            i, j, left = map(np.concatenate, (of_i, of_j, spare))
            if quota is not None:
                sent = _likeliest(i, j, left, quota) | _likeliest(j, i, left, quota)
                if not sent.all():
                    cut.append(token[s])
                i, j = i[sent], j[sent]
            out_a.append(ids[i])
            out_b.append(ids[j])
        if out_a:
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            a, b = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
            cut = np.unique(np.array(cut, np.int64))
            none = pa.nulls(len(cut), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(a), none]), pa.concat_arrays([pa.array(b), none]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(cut)])], names=["a", "b", "token"])

    return _lists(blocks, ["token", "ci", "cj"], ["size", "cid", "comp", "c", "bits", "firsts"], cross, "a long, b long, token long")


def _likeliest(of: np.ndarray, other: np.ndarray, spare: np.ndarray, quota: int) -> np.ndarray:
    """Which pairs are among the ``quota`` of their ``of`` that spare the most."""
    order = np.lexsort((other, -spare, of))
    begin = np.flatnonzero(np.append(True, np.diff(of[order]) != 0)) if len(of) else np.zeros(0, np.int64)
    out = np.zeros(len(of), bool)
    out[order] = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of)))) < quota
    return out
