"""Phrase collocations by hierarchical pair naming.

The corpus is cut into blocks of one language each, which keep their words as numbers by position.  Level k names
phrases of k words: where the phrases of k - 1 words at a position and at the next one are both frequent, the pair of
their ids is counted.  A block sends each distinct pair once with its count and place; a window over all blocks sums the counts,
keeps the frequent pairs and names each by the first place that holds it; the names go back to the blocks that hold
the pair and replace it there.  Every part of a frequent phrase is frequent, so nothing is lost.

A name's pair points at its two parents, the phrase without its last and without its first word.  Following these
pointers level by level gives the counts of all first and last parts, hence every cut, and tells which phrases are
contained in longer ones.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlink.llm.common import STEP_BYTES, arrow_map, release, steps, unzip_arrays, zip_parts
from strandlink.plans.ranks import ranked
from strandlink.plans.stages import drop, materialize

#: Bytes of text a block, about; a piece without a break that is longer makes a block of its own.
BLOCK_BYTES = 24 << 20
#: Words or pairs that one numpy step works on, about; pairs of one first phrase stay together.
STEP_WORDS = 1 << 19
#: A phrase's id: partition, block in it, and place in the block's list.
_PLACE, _BLOCK = 27, 15
_ROWS = 1 << 16

# Bytes that end a piece, and those that end a word.
_BREAKS = re.compile(rb"[.,;:!?\x0A-\x0D]")
_ENDS = re.compile(rb"[ \t.,;:!?\x0A-\x0D]")
_KIND = np.zeros(256, np.uint8)
_KIND[[*b" \t"]] = 1
_KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(text: bytes) -> tuple[np.ndarray, pa.Array]:
    """Whether a piece ends before each word and after the last one, and the words."""
    data = np.frombuffer(text, np.uint8)
    kind = _KIND[data]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = np.flatnonzero(begins)
    ends = np.cumsum(kind == 2, dtype=np.int32)
    apart = np.diff(np.append(ends[starts], ends[-1:]), prepend=np.int32(0)) > 0
    if not len(starts):
        return apart, pa.array([], pa.large_string())
    body = _LOWER[data[inside]]
    rank = np.cumsum(inside, dtype=np.int32)
    off = np.append(rank[starts] - 1, len(body)).astype(np.int64)
    return apart, pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(body)])


def cut(text: bytes, size: int = BLOCK_BYTES, ends: re.Pattern = _BREAKS):
    """The text in parts of about ``size`` bytes that end where a piece ends, or at another of ``ends``."""
    at = 0
    while at < len(text):
        m = ends.search(text, at + size)
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


def _counts(code: np.ndarray, size: int) -> np.ndarray:
    """How often each code comes, without a wide copy of all codes."""
    n = np.zeros(size, np.int64)
    step = max(STEP_WORDS, size)
    for s in range(0, len(code), step):
        n += np.bincount(code[s : s + step], minlength=size)
    return n


def _packed(pos: np.ndarray, code: np.ndarray, *more: np.ndarray) -> bytes:
    """Positions as steps and codes by bytes of equal weight, which compresses better than whole numbers do."""
    n = len(pos)

    def parts():
        for s in range(0, n, STEP_WORDS):
            yield np.diff(pos[s : s + STEP_WORDS], prepend=pos[s - 1] if s else np.int32(0))
        planes = code.astype("<i4", copy=False).view(np.uint8).reshape(-1, 4)
        for k in range(4):
            yield planes[:, k]
        yield from more

    return zip_parts([4 * n, 4 * n, *(a.nbytes for a in more)], parts())


def _unpacked(blob: bytes, *more: str) -> list[np.ndarray]:
    step, planes, *rest = unzip_arrays(blob, "<i4", "u1", *more)
    code = np.empty(len(step), "<u4")
    code.view(np.uint8).reshape(-1, 4)[:] = planes.reshape(4, -1).T
    # copies, as views would keep everything that was unpacked
    return [np.cumsum(step, dtype=np.int32), code.view("<i4"), *(x.copy() for x in rest)]


def _by_count(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers the codes anew in place, frequent ones first; the old numbers in the new order, and their counts."""
    n = _counts(code, size)
    order = np.argsort(-n, kind="stable")
    new = np.empty(size, np.int32)
    new[order] = np.arange(size, dtype=np.int32)
    for s in range(0, len(code), STEP_WORDS):
        code[s : s + STEP_WORDS] = new[code[s : s + STEP_WORDS]]
    return order, n[order]


class _Words:
    """The words of texts of one language as numbers, coded in parts so that no step works on a whole block."""

    def __init__(self, step: int):
        self.step = step
        self.waiting: list[bytes] = []
        self.waits = self.size = 0
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def add(self, text: bytes) -> None:
        """Takes a text, or a part of one that ends where a piece ends."""
        self.waiting.append(text)
        self.waits += len(text) + 1
        self.size += len(text) + 1
        if self.waits >= self.step:
            self.code()

    def code(self) -> None:
        text, self.waiting, self.waits = b"\n".join(self.waiting), [], 0
        ended = True
        for part in cut(text, self.step, _ENDS):
            apart, words = words_of(part)
            apart[0] |= ended
            ended = apart[-1]
            if len(words):
                coded = words.dictionary_encode()
                narrow = np.uint16 if len(coded.dictionary) <= 1 << 16 else np.int32
                self.parts.append((apart[:-1], coded.indices.to_numpy().astype(narrow), coded.dictionary))

    def block(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        """Positions of the words, their numbers, and the words; positions of neighbours differ by 1 within a piece, by 2
        across pieces."""
        self.code()
        if not self.parts:
            return None
        known = pa.concat_arrays([words for *_, words in self.parts]).dictionary_encode()
        number, first = known.indices.to_numpy(), 0
        pos, code = (np.empty(sum(len(x) for _, x, _ in self.parts), np.int32) for _ in range(2))
        at = 0
        for i, (apart, own, words) in enumerate(self.parts):
            self.parts[i] = None
            code[at : at + len(own)] = number[first : first + len(words)][own]
            pos[at : at + len(own)] = 1 + apart
            at, first = at + len(own), first + len(words)
        np.cumsum(pos, out=pos)
        return pos, code, known.dictionary


def _blocks(size: int, step: int = STEP_BYTES):
    """Texts ``(lang, text)`` to block rows ``(block, lang, words, state, word, n)``."""
    step = min(step, size)

    def run(batches):
        first, count = TaskContext.get().partitionId() << _BLOCK, 0
        held: dict[str, _Words] = {}
        total = 0

        def flush(lang):
            nonlocal count, total
            words = held.pop(lang)
            total -= words.size
            found = words.block()
            if found is None:
                return
            pos, code, known = found
            order, n = _by_count(code, len(known))
            if count >> _BLOCK or len(n) >> _PLACE:
                raise OverflowError("a partition holds too many blocks or a block too many phrases")
            known = known.take(pa.array(order)).cast(pa.string())
            one = pa.array([0, len(n)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + count]), pa.array([lang]), pa.array([len(pos)]), pa.array([_packed(pos, code)]), pa.ListArray.from_arrays(one, known), pa.ListArray.from_arrays(one, pa.array(n))],
                names=["block", "lang", "words", "state", "word", "n"],
            )
            count += 1

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                for part in cut(text.as_buffer().to_pybytes(), size):
                    held.setdefault(lang, _Words(step)).add(part)
                    total += len(part) + 1
                    if held[lang].size >= size:
                        yield from flush(lang)
                    elif total >= 2 * size:
                        yield from flush(max(held, key=lambda x: held[x].size))
        for lang in sorted(held):
            yield from flush(lang)

    return run


def neighbours(pos: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a phrase has a next one, and the codes of both."""
    near = np.diff(pos) == 1
    return pos[:-1][near], code[:-1][near], code[1:][near]


def pairs_of(left: np.ndarray, right: np.ndarray, width: int, size: int = STEP_WORDS):
    """The distinct pairs of codes below ``width``, ascending, a range of left codes at a time: which occurrences are in the
    range, their numbers among its pairs, and the left codes, right codes and counts of these.

    A range has about ``size`` occurrences; where one code has more, its right codes are counted and not sorted.
    """
    for a, b in steps(np.append(0, np.cumsum(_counts(left, width))), size):
        inside = (left >= a) & (left < b)
        r = right[inside]
        if b - a == 1:
            n = _counts(r, width)
            rights = np.flatnonzero(n)
            number = np.empty(width, np.int32)
            number[rights] = np.arange(len(rights), dtype=np.int32)
            yield inside, number[r], np.full(len(rights), a), rights, n[rights]
        elif len(r):
            pair, number, n = np.unique(left[inside].astype(np.int64) * width + r, return_inverse=True, return_counts=True)
            yield inside, number, pair // width, pair % width, n


def numbered(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    """The number of each occurrence's pair among all distinct ones."""
    out, first = np.empty(len(left), np.int32), 0
    for inside, number, *_, n in pairs_of(left, right, width):
        out[inside] = number + first
        first += len(n)
    return out


def renamed(pos: np.ndarray, code: np.ndarray, place: np.ndarray, names: np.ndarray) -> bytes:
    """The occurrences of frequent phrases: ``place`` are the numbers in ``code`` that are frequent, ``names`` their ids.
    ``code`` is written over."""
    known = np.full(int(code.max(initial=-1)) + 1, -1, np.int32)
    known[place] = np.arange(len(place), dtype=np.int32)
    for s in range(0, len(code), STEP_WORDS):
        code[s : s + STEP_WORDS] = known[code[s : s + STEP_WORDS]]
    keep = code >= 0
    pos, code = pos[keep], code[keep]
    order, _ = _by_count(code, len(place))
    return _packed(pos, code, names[order])


_STATE = pa.schema([("block", pa.int64()), ("state", pa.binary())])


def _named_level(level: int):
    """Blocks and the names for level ``level`` to the block's occurrences of frequent phrases of that length."""

    def occurrences(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        if level == 1:
            return _unpacked(blob)
        pos, code, names = _unpacked(blob, "<i8")
        pos, l, r = neighbours(pos, code)
        del code
        return pos, numbered(l, r, len(names))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _STATE.empty_table()
        try:
            blob = renamed(*occurrences(left.column("state")[0].as_py()), right.column("place").to_numpy(), right.column("id").to_numpy())
            return pa.table([left.column("block"), pa.array([blob])], schema=_STATE)
        finally:
            release()

    return run


def _count_pairs(batches):
    """Blocks to rows ``(l, r, here, n)``, one for each distinct pair; ``here`` is its place in the corpus."""
    for b in batches:
        for block, blob in zip(b.column(0).to_pylist(), b.column(1)):
            pos, code, names = _unpacked(blob.as_py(), "<i8")
            _, left, right = neighbours(pos, code)
            del pos, code, _
            first = 0
            for *_, l, r, n in pairs_of(left, right, len(names)):
                if first + len(n) >> _PLACE:
                    raise OverflowError("a block holds too many phrases")
                here = (block << _PLACE) + first + np.arange(len(n))
                for s in range(0, len(n), _ROWS):
                    rows = slice(s, s + _ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names[l[rows]], names[r[rows]], here[rows], n[rows])], names=["l", "r", "here", "n"])
                first += len(n)


def _named(items: DataFrame, keys: list[str], least: int, label: str) -> DataFrame:
    """Frequent ``keys`` of ``items(*keys, here, n)``: a row for each block that holds one, with ``id``, the first place
    of all, and ``a``, the count over all blocks."""
    over = Window.partitionBy(*keys)
    rows = items.select(*keys, "here", F.sum("n").over(over).alias("a"), F.min("here").over(over).alias("id"))
    first = F.col("here") == F.col("id")  # one row of each carries what it stands for
    place = F.col("here").bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int").alias("place")
    return materialize(rows.filter(F.col("a") >= least).select(F.shiftright("here", _PLACE).alias("block"), place, "id", "a", *(F.when(first, F.col(c)).alias(c) for c in keys), first.alias("first")), label, release=True)


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases of 1 to ``longest`` words, a frame for each length, and the words of each language.

    Phrases: ``(id, l, r, a, lang, phrase, last, firsts, lasts)`` with the parents' ids, the count, the last word, and
    the counts of the first 1, 2, ... and last 1, 2, ... words.
    """
    src = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("string").alias("text")).filter("text is not null")
    state = materialize(arrow_map(src, _blocks(block_bytes), "block long, lang string, words long, state binary, word array<string>, n array<long>"), "level-1")
    sizes = materialize(state.groupBy("lang").agg(F.sum("words").alias("n")), "words")
    each = state.select("lang", "block", F.posexplode(F.arrays_zip("word", "n")).alias("place", "x"))
    named = _named(each.select("lang", F.col("x.word").alias("word"), (F.shiftleft("block", _PLACE) + F.col("place")).alias("here"), F.col("x.n").alias("n")), ["lang", "word"], least, "names-1")
    one = named.filter("first").select("id", F.lit(None).cast("long").alias("l"), F.lit(None).cast("long").alias("r"), "a", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("a").alias("firsts"), F.array("a").alias("lasts"))
    levels = [materialize(one, "phrases-1")]
    for k in range(2, longest + 1):
        # what a level leaves behind goes before the next one shuffles
        following = materialize(
            state.select("block", "state").groupBy("block").cogroup(named.select("block", "place", "id").groupBy("block")).applyInArrow(_named_level(k - 1), "block long, state binary"), f"level-{k}", release=True
        )
        drop(state)
        drop(named)
        state = following
        named = _named(arrow_map(state, _count_pairs, "l long, r long, here long, n long"), ["l", "r"], least, f"names-{k}")
        before = levels[-1]
        left = before.select(F.col("id").alias("l"), "lang", F.col("phrase").alias("head"), F.col("firsts").alias("before"))
        right = before.select(F.col("id").alias("r"), "last", F.col("lasts").alias("after"))
        own = named.filter("first").select("id", "l", "r", "a").join(left, "l").join(right, "r")
        levels.append(materialize(own.select("id", "l", "r", "a", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", F.concat("before", F.array("a")).alias("firsts"), F.concat("after", F.array("a")).alias("lasts")), f"phrases-{k}"))
    drop(state)
    drop(named)
    return levels, sizes


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, covered: int = 100, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases of 2 to ``longest`` words.

    Words are lower-cased (A-Z) runs without space and tab inside pieces that end at ``. , ; : ! ?`` and line breaks;
    ``a`` counts a phrase's occurrences, overlaps included, and is at least ``least``; ``n`` are all words of the language.
    A cut into first and last words with counts ``l`` and ``r`` scores floor(1000 * a * n / (l * r)), exactly; the lowest
    counts, the earliest of equals.  A phrase inside a longer one that has ``covered`` per cent of its count is left out.
    Order: score and count descending, phrase by its bytes.

    A null language is ``und``, together with rows that say so; null and empty texts hold no words; repeated rows count as
    often as they come; ids do not matter.  Without a frequent phrase there are no rows.
    """
    levels, sizes = phrases(docs, least, longest, text_col, lang_col, block_bytes)
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products of three need more than 64 bits
    found = []
    for k in range(2, longest + 1):
        rows = levels[k - 1].join(sizes, "lang")
        if k < longest:
            # counts fall along extensions, so one more word on either side decides
            longer = levels[k].select(F.col("l").alias("id"), "a").union(levels[k].select(F.col("r").alias("id"), "a"))
            rows = rows.join(longer.groupBy("id").agg(F.max("a").alias("most")), "id", "left").filter(F.col("most").isNull() | (100 * wide(F.col("most")) < covered * wide(F.col("a"))))
        rows = rows.withColumns({"da": wide(F.col("a")), "dn": wide(F.col("n"))})
        cuts = []
        for j in range(1, k):
            l, r = F.element_at("firsts", j), F.element_at("lasts", k - j)
            rows = rows.withColumns({f"l{j}": l, f"r{j}": r, f"dl{j}": wide(l), f"dr{j}": wide(r)})
            cuts.append(F.struct(F.expr(f"(1000BD * da * dn) div (dl{j} * dr{j})").alias("score"), F.lit(j).alias("at"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")))
        lowest = F.array_min(F.array(*cuts))
        found.append(rows.withColumn("cut", lowest).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")))
    out = ranked(reduce(DataFrame.union, found), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], "collocations")
    return out.filter(F.col("idx") < top).select("lang", (F.col("idx") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
