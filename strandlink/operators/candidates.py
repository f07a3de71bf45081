"""Lossless candidate joins over distinct sequences."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlink.functions import qgram
from strandlink.plans.stages import materialize

#: Rows of one key and side that meet in one task; a key with more is cut into chunks, and pairs of chunks are dealt.
CHUNK = 2000
#: The most rows of a tile of profiles, which are compared as they meet; the fewest, and the tiles of a smaller table.
WIDE_CHUNK, LEAST, TILES = 1 << 17, 2000, 24
#: What a row counts for in its tile if it has at most as many odd 5-mers as profiles may differ in.
SMALL = 4
#: Pairs of profiles of one numpy step, rows of equal profiles that stay together, and rows of pairs that are made at once.
BLOCK, COPIES, ROWS = 1 << 17, 256, 1 << 18
#: Bits of the map of filed keys that probes are held against: 16 MB.
PROBE_BITS = 1 << 27
#: Profiles with more odd codes than this are joined on ranges of codes, the others on their rarest codes.
DENSE = 128
#: Pivot profiles of :func:`pivot_join`, those whose rings are part of the key, and the sample they come from.
PIVOTS, RINGS, SAMPLE = 8, 3, 2000


def nested_loop(sequences: DataFrame) -> DataFrame:
    """All pairs ``a.seq_no < b.seq_no``: the definition that the other joins are tested against, for small inputs."""
    a = sequences.select(F.col("seq_no").alias("src"), F.col("seq").alias("query"))
    b = sequences.select(F.col("seq_no").alias("dst"), F.col("seq").alias("target"))
    return a.join(b, F.col("src") < F.col("dst"))


def segment_keys(reps: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
    """Keys of both sides of a segment join.

    A sequence of length L > d is cut into d + 1 segments.  A sequence within d edits that is not shorter holds one
    segment unchanged, and at a shift that the edits before and after it allow, so only these substrings are
    looked up.  Sequences of at most d symbols are keyed by length alone: there are few that differ.  A probe may repeat: pieces are not shuffled to tell, as
    only their hashes leave the task, and few of those are of use.
    """
    n = d + 1
    length = F.length("seq")

    def begin(size, k):  # first position (from 0) of segment k
        return k * F.floor(size / F.lit(n)) + F.greatest(F.lit(0), k - (n - size % n))

    def width(size, k):
        return F.floor(size / F.lit(n)) + F.when(k >= n - size % n, 1).otherwise(0)

    ks = F.sequence(F.lit(0), F.lit(d))
    filed = (
        reps.filter(length > d)
        .select("rep", "seq", length.alias("len"), F.explode(ks).alias("k"))
        .select("rep", "len", F.col("k"), F.expr(_substr("len", n)).alias("piece"))
    )
    # pieces of probes are cut from bytes: a place in a string is found by walking to it, for each of hundreds of pieces
    probes = (
        reps.filter(length > d)
        .select("rep", F.col("seq").cast("binary").alias("seq"), length.alias("mine"), F.explode(F.sequence(F.greatest(length - d, F.lit(d + 1)), length)).alias("len"))
        .select("*", F.explode(ks).alias("k"))
        .withColumn("delta", F.col("mine") - F.col("len"))
        .withColumn("p", begin(F.col("len"), F.col("k")))
        .withColumn("w", width(F.col("len"), F.col("k")))
    )
    lo = F.greatest(F.lit(0), F.col("p") - F.col("k"), F.col("p") + F.col("delta") - (d - F.col("k")))
    hi = F.least(F.col("mine") - F.col("w"), F.col("p") + F.col("k"), F.col("p") + F.col("delta") + (d - F.col("k")))
    probes = (
        probes.withColumn("lo", lo)
        .withColumn("hi", hi)
        .filter("lo <= hi")
        .withColumn("at", F.explode(F.sequence("lo", "hi")))
        .select("rep", "len", "k", F.expr("substring(seq, cast(at + 1 as int), cast(w as int))").alias("piece"))
    )
    return filed, probes


def _substr(size: str, n: int) -> str:
    p = f"(k * floor({size} / {n}) + greatest(0, k - ({n} - {size} % {n})))"
    w = f"(floor({size} / {n}) + if(k >= {n} - {size} % {n}, 1, 0))"
    return f"substring(seq, cast({p} + 1 as int), cast({w} as int))"


def segment_index(reps: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the segment join with one key: ``filed(rep, key)`` and ``probes(rep, key)``.

    Any two sequences within ``d`` edits meet under a key, one as filed and one as probe.  Sequences of at most ``d``
    symbols probe the lengths that they can reach, under which those of at most ``2 d`` symbols are filed.
    """
    filed, probes = segment_keys(reps, d)
    key = F.xxhash64("len", "k", "piece").alias("key")
    size = F.length("seq")
    by_length = F.xxhash64(F.col("len").cast("int"), F.lit(-1)).alias("key")
    near = reps.filter(size <= 2 * d).select("rep", size.alias("len"))
    short = reps.filter(size <= d).select("rep", F.explode(F.sequence(size, size + d)).alias("len"))
    wide = lambda df: df.withColumn("len", F.col("len").cast("long"))  # noqa: E731  equal values hash alike only in one type
    return (
        wide(filed).withColumn("k", F.col("k").cast("int")).select("rep", key).union(near.select("rep", by_length)),
        wide(probes).withColumn("k", F.col("k").cast("int")).select("rep", key).union(short.select("rep", by_length)),
    )


def useful_probes(filed: DataFrame, probes: DataFrame, bits: int = PROBE_BITS) -> DataFrame:
    """Distinct ``(rep, key)`` of ``probes`` whose key is filed.

    Most probes are of no use, and at many edits there are hundreds for each sequence.  A bitmap of the filed keys, of fixed
    size, drops them where they are made; the fuller it is, the more of them go on to the join that decides.
    """
    slot = F.shiftrightunsigned("key", 6).bitwiseAND(F.lit(bits // 64 - 1)).cast("int").alias("slot")
    one = F.expr("shiftleft(1L, cast(key & 63 as int))")
    words = np.zeros(bits // 64, np.int64)
    for b in filed.groupBy(slot).agg(F.bit_or(one).alias("held")).toArrow().to_batches():
        words[b.column(0).to_numpy()] = b.column(1).to_numpy()
    sent = filed.sparkSession.sparkContext.broadcast(words.view(np.uint8))

    def run(batches):
        held = sent.value
        for b in batches:
            at = b.column(1).to_numpy().astype(np.uint64) & np.uint64(8 * len(held) - 1)
            keep = held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
            yield b.filter(pa.array(keep.astype(bool)))

    passed = probes.select("rep", "key").mapInArrow(run, "rep bigint, key bigint")
    return passed.join(filed.select("key").distinct(), "key", "left_semi").select("rep", "key").distinct()


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """Inner equi-join of ``left(*keys, a, ...)`` and ``right(*keys, b, ...)`` for keys of any size.

    See :func:`spread_sides`."""
    left, right, parts = spread_sides(left, right, keys, chunk)
    return left.join(right, parts).drop("_i", "_j")


def spread_sides(left: DataFrame, right: DataFrame, keys: list[str], chunk: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and the columns by which they meet.

    Keys are counted first.  A key with more than ``chunk`` rows on a side is cut there by a hash of the row's ``a`` or
    ``b``, and every chunk of one side meets every chunk of the other in a task of its own; other keys are as they are.
    """

    def many(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias(name)).filter(F.col(name) > 1)

    hot = many(left, "_x").join(many(right, "_y"), keys, "full").select(*keys, F.coalesce("_x", F.lit(1)).alias("_x"), F.coalesce("_y", F.lit(1)).alias("_y"))
    hot = materialize(hot, "hot-keys")  # one row for each ``chunk`` rows of the input at most
    if hot.isEmpty():
        return left, right, keys

    def dealt(side: DataFrame, row: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        out = side.join(hot, keys, "left")
        part = F.pmod(F.xxhash64(row), F.coalesce(own, F.lit(1))).cast("int")
        return out.withColumn(mine, part).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("_x", "_y")

    return dealt(left, "a", "_x", "_y", "_i", "_j"), dealt(right, "b", "_y", "_x", "_j", "_i"), [*keys, "_i", "_j"]


def segment_join(reps: DataFrame, d: int, chunk: int = CHUNK) -> DataFrame:
    """Distinct pairs ``(a, b)``, a < b, of rows ``(rep, seq)`` that share a segment key: every pair within ``d`` edits
    is among them."""
    filed, probes = segment_index(reps, d)
    met = spread_join(filed.select("key", F.col("rep").alias("a")), probes.select("key", F.col("rep").alias("b")), ["key"], chunk)
    return met.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def profile_classes(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(seq_no, codes)`` of every row, and ``(rep, codes, size)`` with equal profiles once; both written."""
    rows = materialize(qgram.profiles(sequences), "profiles")
    return rows, materialize(rows.groupBy("codes").agg(F.min("seq_no").alias("rep")).withColumn("size", F.size("codes")), "classes")


def _code_ranks(classes: DataFrame) -> Column:
    """The place of each 5-mer code among all 1024 by how many profiles hold it, rare ones first."""
    held = {r["code"]: r["n"] for r in classes.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect()}
    order = sorted(range(4**qgram.Q), key=lambda c: (held.get(c, 0), c))
    place = [0] * len(order)
    for i, c in enumerate(order):
        place[c] = i
    return F.lit(place)


def rare_code_pairs(classes: DataFrame, most: int, dense: int = DENSE) -> DataFrame:
    """Distinct pairs ``(a, b)`` of classes whose profiles may differ in ``most`` codes or fewer, where the smaller one
    has at most ``dense``: all of them.

    Codes are ordered rare first.  If sets A and B, A not the larger, differ in ``most`` codes, then at most half
    of these are A's, so the first ``most / 2 + 1`` of A and the first ``most + 1`` of B have a code in common, unless
    the sets have no more than ``most`` codes in all: then any pair differs in few enough, and they meet by size.
    At the first common code, what stands before it on either side differs, and so does any surplus behind it.
    """
    rank = _code_ranks(classes)
    ordered = classes.select("rep", "size", F.array_sort(F.transform("codes", lambda c: F.get(rank, c))).alias("ranks"))

    def prefix(side: DataFrame, n: int, names: list[str]) -> DataFrame:
        return side.select("rep", "size", F.posexplode(F.slice("ranks", 1, n)).alias("at", "key")).toDF(*names)

    smaller = prefix(ordered.filter(F.col("size") <= dense), most // 2 + 1, ["a", "na", "i", "key"])
    larger = prefix(ordered.filter(F.col("size") <= dense + most), most + 1, ["b", "nb", "j", "key"])
    met = spread_join(smaller, larger, ["key"]).filter((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    met = met.filter(F.col("i") + F.col("j") + F.abs((F.col("na") - F.col("i")) - (F.col("nb") - F.col("j"))) <= most)
    few = classes.filter(F.col("size") <= most)
    by_size = spread_join(
        few.filter(F.col("size") <= most // 2).select(F.col("rep").alias("a"), F.col("size").alias("na"), F.explode(F.sequence("size", most - F.col("size"))).alias("key")),
        few.select(F.col("rep").alias("b"), F.col("size").alias("key")),
        ["key"],
    ).filter((F.col("na") < F.col("key")) | ((F.col("na") == F.col("key")) & (F.col("a") < F.col("b"))))
    return met.select("a", "b").union(by_size.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def range_pairs(classes: DataFrame, most: int, dense: int = DENSE) -> DataFrame:
    """Distinct pairs ``(a, b)`` of classes with more than ``dense`` codes each whose profiles may differ in ``most``
    codes or fewer: of ``most + 1`` ranges of codes they agree in one."""
    n = most + 1
    ranges = classes.filter(F.col("size") > dense).select("rep", "size", "codes", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("range"))
    keyed = ranges.select("rep", "size", F.xxhash64("range", F.filter("codes", lambda c: F.floor(c * n / F.lit(1024)) == F.col("range"))).alias("key"))
    met = spread_join(keyed.select("key", F.col("rep").alias("a"), F.col("size").alias("na")), keyed.select("key", F.col("rep").alias("b"), F.col("size").alias("nb")), ["key"])
    return met.filter((F.col("a") < F.col("b")) & (F.abs(F.col("na") - F.col("nb")) <= most)).select("a", "b").distinct()


def word_classes(sequences: DataFrame) -> DataFrame:
    """``(rep, copies, size, w0, ...)``: equal profiles once, with the number of their rows; written."""
    return materialize(qgram.word_profiles(sequences).groupBy("size", *qgram.WORDS).agg(F.min("seq_no").alias("rep"), F.count("seq_no").alias("copies")), "classes")


def word_pieces(sequences: DataFrame) -> DataFrame:
    """``(rep, members, size, w0, ...)``: rows of equal profiles together, in pieces of some ``COPIES`` rows where there are
    more; written."""
    # classes with equal hashes are cut more often than they need be, and nothing else
    rows = materialize(qgram.word_profiles(sequences).withColumn("class", F.xxhash64("size", *qgram.WORDS)), "profiles")
    many = rows.groupBy("class").agg(F.ceil(F.count("*") / F.lit(COPIES)).alias("parts")).filter("parts > 1")
    dealt = rows.join(many, "class", "left").withColumn("part", F.pmod(F.xxhash64("seq_no"), F.coalesce("parts", F.lit(1))))
    pieces = dealt.groupBy("part", "size", *qgram.WORDS).agg(F.collect_list("seq_no").alias("members"))
    return materialize(pieces.select(F.array_min("members").alias("rep"), "members", "size", *qgram.WORDS), "classes")


def _rank_order(classes: DataFrame) -> list[int]:
    """All 1024 codes, those that few profiles hold first."""

    def run(batches):
        for b in batches:
            n = qgram.from_words([b.column(i) for i in range(b.num_columns)]).sum(axis=0, dtype=np.int64)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["code", "n"])

    held = {r["code"]: r["n"] for r in classes.select(*qgram.WORDS).mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()}
    return sorted(range(4**qgram.Q), key=lambda c: (held.get(c, 0), c))


def _placed(classes: DataFrame, pivot: list[int] | None, carried: str) -> DataFrame:
    """``(rep, carried, size, at, w0, ...)``: the distance ``at`` of each profile to the ``pivot`` (none: to the empty profile, which is
    the size), and the profile with rank ``r`` in the place of the code that has it; written."""
    order = np.array(_rank_order(classes))
    at = F.col("size")
    if pivot is not None:
        at = reduce(lambda x, y: x + y, (F.bit_count(F.col(w).bitwiseXOR(F.lit(v).cast("bigint"))) for w, v in zip(qgram.WORDS, pivot))).cast("int")

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, qgram.STEP):
                part = b.slice(lo, qgram.STEP)
                odd = qgram.from_words([part.column(i) for i in range(4, part.num_columns)])[:, order]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *qgram.to_words(odd)], names=["rep", carried, "size", "at", *qgram.WORDS])

    kind = dict(classes.dtypes)[carried]
    return materialize(classes.select("rep", carried, "size", at.alias("at"), *qgram.WORDS).mapInArrow(run, f"rep bigint, {carried} {kind}, size int, at int, {qgram.WORD_FIELDS}"), "placed")


def _tiles(held: dict[int, int], most: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Rows, given as numbers by ``at``, cut into tiles in this order: the first tile of each ``at``, in how many tiles its rows
    are, and of each tile the first and the last one whose rows may be within ``most`` of its own.

    A tile has some ``sum / TILES`` rows, but ``LEAST`` at least and ``WIDE_CHUNK`` at most.
    """
    room = min(WIDE_CHUNK, max(LEAST, -(-sum(held.values()) // TILES)))
    first, parts, spans, free = [0] * (4**qgram.Q + 1), [1] * (4**qgram.Q + 1), [], 0
    for at in sorted(held):
        n = -(-held[at] // room)
        if held[at] <= free:
            spans[-1][1], first[at] = at, len(spans) - 1
            free -= held[at]
        else:
            first[at], parts[at] = len(spans), n
            spans += [[at, at] for _ in range(n)]
            free = room - held[at] if n == 1 else 0
    near = lambda t, u: spans[u][0] - spans[t][1] <= most
    lowest = [next(t for t in range(u + 1) if near(t, u)) for u in range(len(spans))]
    highest = [next(u for u in range(len(spans) - 1, t - 1, -1) if near(t, u)) for t in range(len(spans))]
    return first, parts, lowest, highest


def _kernel(x: np.ndarray, y: np.ndarray, wx: np.ndarray, wy: np.ndarray, most: int, same: bool, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, distance)`` of the rows of two tiles that differ in ``most`` codes or fewer, i < j if they are the ``same``.

    ``x`` and ``y`` are the rows' ascending ``at``: rows further apart in it than ``most`` need not meet.  Of others the fullest
    word and the sizes of the rest bound the distance from below, which leaves few.
    """
    step = min(64, block)
    wide = max(1, block // step)
    room = [np.empty(step * wide, t) for t in (np.uint64, np.uint8, np.uint8, np.uint8, bool)]
    top = [np.ascontiguousarray(w[:, -1]) for w in (wx, wy)]
    next_top = [np.ascontiguousarray(w[:, -2]) for w in (wx, wy)]
    rest = [np.minimum(np.bitwise_count(w[:, :-1]).sum(axis=1, dtype=np.int32), 180).astype(np.uint8) for w in (wx, wy)]
    starts, ends = np.searchsorted(y, x - most, "left"), np.searchsorted(y, x + most, "right")
    few = min(most, 255)
    for lo in range(0, len(x), step):
        hi = min(lo + step, len(x))
        for begin in range(lo if same else starts[lo], ends[hi - 1], wide):
            end = min(begin + wide, ends[hi - 1])
            shape = (hi - lo, end - begin)
            bits, apart, more, less, keep = (r[: shape[0] * shape[1]].reshape(shape) for r in room)
            np.bitwise_count(np.bitwise_xor(top[0][lo:hi, None], top[1][None, begin:end], out=bits), out=apart)
            rx, ry = rest[0][lo:hi, None], rest[1][None, begin:end]
            np.add(apart, np.subtract(np.maximum(rx, ry, out=more), np.minimum(rx, ry, out=less), out=more), out=apart)
            found = np.flatnonzero(np.less_equal(apart, few, out=keep))
            i, j = np.divmod(found, shape[1])
            i, j = i + lo, j + begin
            keep = np.bitwise_count(next_top[0].take(i) ^ next_top[1].take(j)) + np.bitwise_count(top[0].take(i) ^ top[1].take(j)) <= few
            if same:
                keep &= i < j
            i, j = i[keep], j[keep]
            far = qgram.distances(wx.take(i, axis=0), wy.take(j, axis=0))
            keep = far <= most
            if keep.any():
                yield i[keep], j[keep], far[keep]


def _counted(n: tuple[np.ndarray, np.ndarray], met: Iterator, same: bool) -> Iterator[pa.RecordBatch]:
    """``(qgram_diff, pairs)`` of what two tiles hold, from the numbers of rows of each profile."""
    pairs = np.zeros(4**qgram.Q // qgram.PER_EDIT + 2, np.int64)
    for i, j, far in met:
        np.add.at(pairs, (far + qgram.PER_EDIT - 1) // qgram.PER_EDIT, n[0].take(i) * n[1].take(j))
    if same:
        pairs[0] += (n[0] * (n[0] - 1) // 2).sum()
    at = np.flatnonzero(pairs)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(pairs[at])], names=["qgram_diff", "pairs"])


def _listed(members: tuple[pa.ListArray, pa.ListArray], met: Iterator, same: bool, most_rows: int) -> Iterator[pa.RecordBatch]:
    """``(src, dst, qgram_diff)`` of what two tiles hold, from the rows of each profile, in batches of bounded size."""
    n = [m.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for m in members]
    rows = [m.flatten().to_numpy(zero_copy_only=False) for m in members]
    begin = [np.cumsum(k) - k for k in n]
    own = np.flatnonzero(n[0] > 1) if same else np.zeros(0, np.int64)
    held, size = [], 0
    for i, j, far in itertools.chain(met, [(own, own, np.zeros(len(own), np.int64))]):
        diff = ((far + qgram.PER_EDIT - 1) // qgram.PER_EDIT).astype(np.int32)
        many = n[0].take(i) * n[1].take(j)
        ends = np.cumsum(many)
        cuts = np.searchsorted(ends, np.arange(most_rows, ends[-1], most_rows)) if len(ends) else []
        for i, j, diff, many in zip(*(np.split(c, cuts) for c in (i, j, diff, many))):
            if len(many) and many.max() > 1:  # every row of one with every row of the other
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                i, j, diff = (np.repeat(c, many) for c in (i, j, diff))
                over, under = np.divmod(place, n[1].take(j))
            else:
                over = under = 0
            a, b = rows[0].take(begin[0].take(i) + over), rows[1].take(begin[1].take(j) + under)
            keep = (a < b) | ((a > b) & (i != j)) if same else a != b
            held.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], diff[keep]))
            size += len(held[-1][0])
            if size >= most_rows // 4:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["src", "dst", "qgram_diff"])
                held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["src", "dst", "qgram_diff"])


def _met(classes: DataFrame, most: int, carried: str, pivot: list[int] | None = None) -> DataFrame:
    """What :func:`_listed` (``carried`` members) or :func:`_counted` (copies) makes of all pairs of profiles that differ in
    ``most`` codes or fewer.

    Distances to a pivot differ by no more than the profiles do, so tiles of that order meet those around them alone, each
    pair of tiles in one task.  A row is sent once for each tile that its own one meets: a number that does not depend on
    the input until tiles are full.  Nothing that is found is written or shuffled.
    """
    placed = _placed(classes, pivot, carried)
    # pairs of small profiles are mostly within the bound, which takes longer to tell: their tiles are smaller
    weight = F.sum(F.when(F.col("size") <= most, SMALL).otherwise(1)).alias("n")
    first, parts, lowest, highest = _tiles({r["at"]: r["n"] for r in placed.groupBy("at").agg(weight).collect()}, most)
    tiles = len(lowest)
    if not tiles:
        lowest = highest = [0]
    tile = F.get(F.lit(first), F.col("at")) + F.pmod(F.xxhash64("rep"), F.get(F.lit(parts), F.col("at"))).cast("int")
    around = F.explode(F.sequence(F.get(F.lit(lowest), F.col("tile")), F.get(F.lit(highest), F.col("tile"))))
    sent = placed.withColumn("tile", tile).withColumn("other", around)
    pair = F.least("tile", "other").cast("bigint") * tiles + F.greatest("tile", "other")
    sent = sent.select(pair.alias("pair"), (F.col("other") < F.col("tile")).cast("int").alias("side"), carried, "at", *qgram.WORDS)
    counted, block, most_rows = carried == "copies", BLOCK, ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the pair of tiles that may go on in the next batch
        for b in batches:
            pairs = b.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(pairs[1:] != pairs[:-1]) + 1), b.num_rows]
            for lo, hi in itertools.pairwise(cuts):
                if held and hi > lo and held[0].column(0)[0].as_py() != pairs[lo]:
                    yield from compare(held)
                    held = []
                if hi > lo:
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield from compare(held)

    def compare(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        one, other = divmod(table.column(0)[0].as_py(), tiles)
        side, at = (table.column(k).to_numpy(zero_copy_only=False) for k in (1, 3))
        order = [np.flatnonzero(side == k) for k in ((0, 0) if one == other else (0, 1))]
        order = [o[np.argsort(at[o], kind="stable")] for o in order]
        words = np.stack([table.column(k).to_numpy(zero_copy_only=False) for k in range(4, table.num_columns)], axis=1).view(np.uint64)
        met = _kernel(*(at[o] for o in order), *(words[o] for o in order), most, one == other, block)
        own = [table.column(2).take(pa.array(o)) for o in order]
        if counted:
            return _counted(tuple(c.to_numpy(zero_copy_only=False) for c in own), met, one == other)
        return _listed(tuple(own), met, one == other, most_rows)

    tasks = sum(h - t + 1 for t, h in enumerate(highest))
    fields = "qgram_diff int, pairs bigint" if counted else "src bigint, dst bigint, qgram_diff int"
    return sent.repartition(tasks, "pair").sortWithinPartitions("pair", "side").mapInArrow(run, fields)


def pairs_by_bound(sequences: DataFrame, limit: int) -> DataFrame:
    """``(qgram_diff, pairs)``: how many pairs of rows :func:`profile_join` has at each bound, without making them."""
    counts = _met(word_classes(sequences), qgram.PER_EDIT * limit, "copies")
    return counts.groupBy("qgram_diff").agg(F.sum("pairs").alias("pairs"))


def profile_join(sequences: DataFrame, limit: int) -> DataFrame:
    """Pairs ``(src, dst, qgram_diff)`` of rows with a q-gram lower bound of at most ``limit``: all of them.

    Profiles within the bound differ in at most ``10 * limit`` of 1024 codes, and so do their sizes; :func:`_met` finds
    them.  Rows of equal profiles are compared together.
    """
    return _met(word_pieces(sequences), qgram.PER_EDIT * limit, "members")


def _pivots(classes: DataFrame, n: int, sample: int) -> list[list[int]]:
    """Profiles far from each other, from a sample of the least hashed ids (``sample`` rows at any size)."""
    held = [set(r["codes"]) for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("codes").collect()]
    if not held:
        return []
    picked = [held[0]]
    near = [len(x ^ picked[0]) for x in held]
    while len(picked) < n and max(near) > 0:
        picked.append(held[near.index(max(near))])
        near = [min(d, len(x ^ picked[-1])) for d, x in zip(near, held)]
    return [sorted(x) for x in picked]


def pivot_pairs(classes: DataFrame, most: int, pivots: int = PIVOTS, rings: int = RINGS, sample: int = SAMPLE) -> DataFrame:
    """Distinct pairs ``(a, b)``, a < b, of classes that no pivot tells apart: all whose profiles differ in ``most``
    codes or fewer.

    The number of differing codes is a metric, so the distances of such a pair to any pivot differ by ``most`` at most.
    Around each pivot lie rings of that width: the pair's rings are equal or neighbours.  The rings around the first few
    pivots are the key of an equi-join in which one side looks up the neighbours as well; the distances to all pivots
    decide before profiles are compared.
    """
    chosen = _pivots(classes, pivots, sample)
    if not chosen:
        return classes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    distance = [F.col("size") + len(p) - 2 * F.size(F.array_intersect("codes", F.lit(p))) if p else F.col("size") for p in chosen]
    table = materialize(classes.select("rep", F.array(*distance).cast("array<int>").alias("to")), "pivots")
    width = most + 1
    rings = min(rings, len(chosen))
    ring = [F.floor(F.get("to", F.lit(i)) / F.lit(width)) for i in range(rings)]
    filed = table.select(F.col("rep").alias("a"), F.col("to").alias("ta"), F.xxhash64(*ring).alias("key"))
    around = F.array(*(F.xxhash64(*(r + s for r, s in zip(ring, shift))) for shift in itertools.product((-1, 0, 1), repeat=rings)))
    probes = table.select(F.col("rep").alias("b"), F.col("to").alias("tb"), F.explode(around).alias("key"))
    apart = F.exists(F.zip_with("ta", "tb", lambda x, y: F.abs(x - y)), lambda x: x > most)
    return spread_join(filed, probes, ["key"]).filter((F.col("a") < F.col("b")) & ~apart).select("a", "b").distinct()


def pivot_join(sequences: DataFrame, limit: int, pivots: int = PIVOTS) -> DataFrame:
    """The rows of :func:`profile_join`, by rings around a pivot profile: of ``pivots`` profiles far from each other the
    one that tells most pairs of a sample apart.

    Profiles meet where their distances to it differ by what the profiles may differ in, and are compared there.
    """
    most = qgram.PER_EDIT * limit
    pieces = word_pieces(sequences)
    return _met(pieces, most, "members", _word_pivot(pieces, most, pivots, SAMPLE))


def _word_pivot(classes: DataFrame, most: int, n: int, sample: int) -> list[int] | None:
    """The pivot of :func:`pivot_join` as words, from a sample of the least hashed ids (``sample`` rows at any size)."""
    held = np.array([list(r) for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select(*qgram.WORDS).collect()], np.int64)
    if not len(held):
        return None
    apart = lambda p: np.bitwise_count((held ^ p).view(np.uint64)).sum(axis=1, dtype=np.int64)
    picked = [held[0]]
    near = apart(held[0])
    while len(picked) < n and near.max() > 0:
        picked.append(held[near.argmax()])
        near = np.minimum(near, apart(picked[-1]))

    def together(p: np.ndarray) -> int:
        at = np.sort(apart(p))
        return int((np.searchsorted(at, at + most, "right")).sum())

    return [int(w) for w in min(picked, key=together)]
