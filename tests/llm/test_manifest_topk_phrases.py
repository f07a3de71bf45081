"""Merkle manifest, exact top-k and collocations against brute force, with odd rows, ties and small limits."""

import gc
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlink.llm import collocations, exact_topk, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, idx int, node string, grp string, total int, bucket int, block int, n int, word string"


def frame(spark, rows):
    extra = (1, "k", 2, "n", "g", 3, 4, 5, 6, "w")
    return spark.createDataFrame([r + extra for r in rows], DOCS).repartition(3)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, text, lang, source, n = row
    fields = (doc_id, source, lang, n if n is None else n + more, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def climb(nodes, fanout):
    """The root and each node's path of (left, right)."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for at, i in enumerate(own):
            b = i - i % fanout
            paths[at].append(("".join(nodes[b:i]), "".join(nodes[i + 1 : b + fanout])))
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        own = [i // fanout for i in own]
    return nodes[0], paths


def manifest_by_hand(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        held = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append((held, *climb([leaf_of(r) for r in held], fanout)))
    root, upper = climb([t[1] for t in trees], fanout)
    out = []
    for (held, sub, lower), up in zip(trees, upper):
        for r, low in zip(held, lower):
            path = low + up
            node = leaf_of(r, 1 if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else 0)
            for a, b in path:
                node = sha(a + node + b)
            out.append((r[0], leaf_of(r), sub, root, sha("".join(a + b for a, b in path)), node, node == root))
    return out


def some_docs(n, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "", "é" * 9, f"text {i % 5}"]), rng.choice([None, "", "de", "en", "en", "en", "ö"]), rng.choice([None, "a:1", "web"]), rng.choice([None, 0, 7, 2**63 - 1])) for i in range(n)]
    rows += [rows[-1]] * 3 + [(None, "x", "en", "s", 1), (None, "y", "en", "s", 1), (None, "x", "en", "s", 1), (-7, "z", "fr", None, None), (3, "other text", "en", "s", 9)]
    return rows


@pytest.mark.parametrize("fanout, height, n", [(2, 10, 60), (2, 2, 90), (3, 1, 40), (2, 1, 0)])
def test_manifest(spark, fanout, height, n):
    rows = some_docs(n, n) if n else [(5, "t" * 3_000_000, None, "s", 3)]
    got = merkle.verify(frame(spark, rows), fanout=fanout, height=height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(str(v) for v in r)
    got = sorted(map(tuple, got.collect()), key=key)
    assert got == sorted(manifest_by_hand(rows, fanout), key=key)
    assert n == 0 or not all(r[-1] for r in got) and sum(r[-1] for r in got) > len(got) / 2


def test_manifest_of_nothing(spark):
    assert merkle.verify(frame(spark, []).limit(0)).collect() == []


def test_manifest_finds_each_change(spark):
    rows = some_docs(30, 4)
    base = merkle.manifest(frame(spark, rows))
    proofs = base.select("id", "leaf", "left", "right", "root").withColumn("wrong", F.sha2("leaf", 256))
    sums = proofs.select((merkle.fold(F.col("leaf"), F.col("left"), F.col("right")) == F.col("root")).alias("a"), (merkle.fold(F.col("wrong"), F.col("left"), F.col("right")) == F.col("root")).alias("b")).collect()
    assert all(r.a and not r.b for r in sums)


def topk_by_hand(rows, k, every):
    whole = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda s: max(min(s, 2**63 - 1), -(2**63))
    out = []
    for q, v in whole:
        if q % every == 0:
            best = sorted((-clip(sum(a * b for a, b in zip(v, w))), i) for i, w in whole if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("sample, block", [(4096, 8_000_000), (20, 900), (1, 1)])
def test_exact_topk(spark, sample, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 9))
    rows = [(i, (centres[i % 4] + 0.2 * rng.normal(size=9)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(60)]  # copies: ties to smaller ids
    rows += [(500, [0.0] * 9), (505, None), (506, []), (507, [None] * 9), (508, [float("nan")] * 9), (509, [float("inf")] * 9), (None, [1.0] * 9), (510, [1.0] * 4), (515, [2.0] * 4), (520, [3.0] * 2), (-5, [0.5] * 9), (0, rows[1][1]), (7, rows[7][1])]
    rows += [(525, [3e30] * 9), (530, [-3e30] + [0.0] * 8)]  # scores beyond a long
    df = spark.createDataFrame([(i, v, 1, 2, "t", 3) for i, v in rows], "vec_id long, embedding array<float>, id int, number int, body string, block int").repartition(3)
    got = exact_topk.search(df, k=6, every=5, sample=sample, block_bytes=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == topk_by_hand(rows, 6, 5)


def test_exact_topk_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0]), (None, [2.0]), (3, None)], "vec_id long, embedding array<double>")
    assert exact_topk.search(df).collect() == []
    assert exact_topk.search(df.limit(0)).collect() == []
    few = spark.createDataFrame([(100, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert list(map(tuple, exact_topk.search(few).collect())) == [(100, 1, 1, 2 << 20)]


def test_elimination_spares_most_candidates():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 24)) * 3
    x = np.floor(1024 * (np.repeat(centres, 128, 0) + 0.05 * rng.normal(size=(2048, 24))))
    pivots = exact_topk.farthest_first(x[::8], 16)
    table = exact_topk.distances(x, pivots).astype(np.float32)
    done = [0]
    plain = exact_topk.scores

    def counted(q, c):
        done[0] += len(c)
        return plain(q, c)

    rows = [{"number": i, "id": i, "body": x[i].tobytes(), "table": table[i].tobytes(), "seed": -(2**63)} for i in range(0, 2048, 256)]
    block = exact_topk.Block(rows, 5)
    exact_topk.scores = counted
    try:
        for s in range(0, 2048, 128):
            block.meet(np.arange(s, s + 128), x[s : s + 128], table[s : s + 128].astype(float))
    finally:
        exact_topk.scores = plain
    assert done[0] < len(rows) * 2048 / 3
    for q, (value, name) in zip(range(0, 2048, 256), block.best):
        all_scores = (x @ x[q]).astype(np.int64)
        want = sorted((-s, i) for i, s in enumerate(all_scores.tolist()) if i != q)[:5]
        assert list(zip((-value).tolist(), name.tolist())) == want


def phrases_by_hand(rows, least, longest, top, covered):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang, *_ in rows:
        lang = lang if lang is not None else "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        known = {p: a for p, a in counts.items() if a >= least}
        rows = []
        for p, a in known.items():
            if len(p) < 2 or any(len(x) > len(p) and 100 * b >= covered * a and any(x[i : i + len(p)] == p for i in range(len(x))) for x, b in known.items()):
                continue
            s, _, l, r = min((1000 * a * n[lang] // (counts[p[:j]] * counts[p[j:]]), j, counts[p[:j]], counts[p[j:]]) for j in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("block, least, top, covered", [(12 << 20, 3, 2000, 100), (300, 3, 7, 100), (64, 5, 2000, 60)])
def test_collocations(spark, block, least, top, covered):
    rng = random.Random(block)
    words = ["la", "LA", "de", "mar", "é", "Ö", "x-y", "the", "of", "night", "\x00", " "]
    rows = []
    for i in range(120):
        w = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if i % 3 == 0:
            w += "it was a dark night".split() * rng.randint(1, 2)
        if i % 5 == 0:
            w += "out of the blue".split()
        text = "".join(x + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  ", "\x0b", "!"]) for x in w)
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und", ""]), None, None))
    rows += [rows[0]] * 4 + [(None, None, "en", None, None), (None, "", "xx", None, None), (7, ".,;", "en", None, None), (8, "go " * 3000, "go", None, None)]
    got = collocations.collocations(frame(spark, rows), least=least, top=top, covered=covered, block_bytes=block)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, least, 5, top, covered)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, []).limit(0)).collect() == []
    assert collocations.collocations(frame(spark, [(1, "few words only", "en", None, None)])).collect() == []


def test_scores_of_collocations_pass_64_bits(spark):
    """Counts whose product needs more than 64 bits, through the expression that scores cuts."""
    a, n, l, r = 4 * 10**9, 9 * 10**12, 5 * 10**9, 7 * 10**9
    row = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").select(*(F.col(c).cast("decimal(19,0)").alias(c) for c in "anlr")).select(F.expr("(1000BD * a * n) div (l * r)").alias("s")).first()
    assert row.s == 1000 * a * n // (l * r)


def test_text_is_cut_where_pieces_end():
    text = b"a b c, d e f. " * 50 + b"x" * 500 + b" y\nz"
    parts = list(collocations.cut(text, 40))
    assert b"".join(parts) == text and all(re.search(rb"[.,;:!?\n]$", p) for p in parts[:-1])


class _Task:
    """Stands for the task that blocks take their numbers from."""

    def get(self):
        return self

    def partitionId(self):
        return 3


def texts_batch(lang, *texts):
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(texts)), pa.array(texts)], names=["lang", "text"])


@pytest.mark.parametrize("size, step", [(10**6, 1), (10**6, 23), (400, 50), (90, 90)])
def test_blocks_coded_in_steps_hold_all_words(monkeypatch, size, step):
    monkeypatch.setattr(collocations, "TaskContext", _Task())
    rng = random.Random(step)
    texts = ["".join(rng.choice(["one", "Two", "é", "x-y", "n" * 60]) + rng.choice([" ", " ", "\t ", ", ", " .", "\n", ";; "]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += ["", " ", "...", ", a b", "a b", "b c ,"]
    want = Counter()
    for text in texts:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            if w := re.findall("[^ \t]+", piece):
                want[tuple(x.lower() for x in w)] += 1
    got, blocks = Counter(), list(collocations._blocks(size, step)(texts_batch("en", t) for t in texts))
    for b in blocks:
        row = b.to_pylist()[0]
        pos, code = collocations._unpacked(row["state"])
        words = [row["word"][c] for c in code]
        assert row["words"] == len(words) and row["n"] == np.bincount(code).tolist() == sorted(row["n"], reverse=True) and len(set(row["word"])) == len(row["word"])
        for piece in np.split(np.arange(len(pos)), np.flatnonzero(np.diff(pos) != 1) + 1):
            got[tuple(words[i] for i in piece)] += 1
    assert got == want and (len(blocks) == 1) == (size == 10**6) and blocks[0].column("block")[0].as_py() == 3 << 15


@pytest.mark.parametrize("size", [1, 40, 10**6])
def test_pairs_by_ranges_are_those_of_one_sort(size):
    rng = np.random.default_rng(size)
    left, right = (np.minimum(rng.geometric(0.15, 3000) - 1, 29).astype(np.int32) for _ in range(2))
    pair, number, n = np.unique(left.astype(np.int64) * 50 + right, return_inverse=True, return_counts=True)
    got, counts, first, own = [], [], 0, np.full(3000, -1)
    for inside, at, l, r, c in collocations.pairs_of(left, right, 50, size):
        own[inside] = at + first
        first += len(c)
        got += (l * 50 + r).tolist()
        counts += c.tolist()
    assert got == pair.tolist() and counts == n.tolist() and own.tolist() == number.tolist()
    assert collocations.numbered(left, right, 50).tolist() == number.tolist()
    assert list(collocations.pairs_of(left[:0], right[:0], 0)) == []


def test_memory_of_blocks_of_phrases(monkeypatch):
    """A block of 24 MB takes a small multiple of its words as numbers, not of its bytes as wide ones."""
    monkeypatch.setattr(collocations, "TaskContext", _Task())
    rng = np.random.default_rng(3)
    words = np.array([f"w{i:x}" for i in range(60_000)])
    texts = [" ".join(words[(rng.zipf(1.3, 110_000) % len(words))]) + "." for _ in range(44)]
    texts = [texts_batch("en", t) for t in texts]

    def most(make):
        gc.collect()
        tracemalloc.start()
        try:
            return make(), tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    (block, *_), coding = most(lambda: list(collocations._blocks(collocations.BLOCK_BYTES)(iter(texts))))
    size = block.column("words")[0].as_py()
    left = pa.table({"block": block.column("block"), "state": block.column("state")})
    names = np.arange(len(block.column("word")[0]))
    right = pa.table({"place": pa.array(names, pa.int32()), "id": names})
    named, naming = most(lambda: collocations._named_level(1)(left, right))
    rows, counting = most(lambda: sum(b.num_rows for b in collocations._count_pairs(iter(named.to_batches()))))
    assert size > 4_000_000 and rows > 500_000
    places = pa.table({"place": pa.array(range(rows), pa.int32()), "id": pa.array(range(rows), pa.int64())})
    again, renaming = most(lambda: collocations._named_level(2)(named, places))
    assert again.num_rows == 1
    assert max(coding, naming, counting, renaming) < 180, (coding, naming, counting, renaming)
