"""Operators on small frames against brute force, with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import random
import weakref
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlink.llm import bpe, decontaminate, embedding_dedup, html_extract, langid, ngram_join, quality, quote_threads, suffix_dedup, token_store
from strandlink.operators import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, cid long, token int, slot string, rep int"


def docs_frame(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", 0 if t is None else len(t), 1, 2, 3, "x", 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = [None, "", "   \n", "one", "one", "A b c d", "a B c d", "x" * 60, "x" * 200, "é" * 80, "é" * 81]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 and len(out) > 15:
            w = (rng.choice(out[11:]) or "a").split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
        elif kind < 0.5:
            out.append(" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) + "\n" + passage)
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 150))))
    return out + [out[-1], " ".join(words * 60)]


def cut_by_brute_force(texts):
    seen, want = {}, {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], i) < i:
                cover[p : p + 50] = True
        runs = int(np.sum(np.diff(np.concatenate(([0], cover.astype(int)))) == 1))
        want[i] = (len(b), int(cover.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest())
    return want


@pytest.mark.parametrize("hot", [None, 3, 12])
def test_suffix_dedup(spark, monkeypatch, hot):
    texts = corpus(2 if hot is None else hot, 40 if hot is None else 90)
    if hot:  # nearly all repeated anchors are hot, or some; many are counted by map tasks alone
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        monkeypatch.setattr(suffix_dedup, "OFTEN", 2 if hot == 3 else 4)
        monkeypatch.setattr(suffix_dedup, "FLUSH", 600)
    want = cut_by_brute_force(texts)
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.deduplicate(docs_frame(spark, texts)).collect()}
    assert got == want
    if hot:
        return
    cut = {r["doc_id"]: r["text"] for r in suffix_dedup.cut_documents(docs_frame(spark, texts)).collect()}
    assert cut[0] is None and cut[4] == "one" and cut[len(texts) - 2] == ""
    assert len(cut[3 + 5].encode()) == want[8][0] - want[8][1]
    assert suffix_dedup.deduplicate(docs_frame(spark, ["a"]).limit(0)).count() == 0


def test_suffix_dedup_rows(spark):
    a, b = "y" * 70, "".join(chr(97 + k * k % 23) for k in range(90))
    rows = [(None, a), (5, a), (6, a), (6, a), (7, b), (8, b + "z"), (8, b + "z"), (8, b + "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"] or -1, r["n_removed"], r["n_spans"]) for r in suffix_dedup.deduplicate(df).collect())
    assert got == [(-1, 0, 0), (5, 0, 0), (6, 70, 1), (6, 70, 1), (7, 0, 0), (8, 90, 1), (8, 90, 1), (8, 90, 1)]
    got = sorted((r["doc_id"] or -1, r["text"]) for r in suffix_dedup.cut_documents(df).collect())
    assert got == [(-1, a), (5, a), (6, ""), (6, ""), (7, b), (8, "z"), (8, "z"), (8, "z")]


def test_suffix_dedup_splits_hot_anchors(spark, monkeypatch):
    """Stretches of an anchor that all documents hold lie in several partitions, and equal ones are sent once a task."""
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    monkeypatch.setattr(suffix_dedup, "PER_SORT", 8)
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(130))
    texts = ["".join(rng.choice("klmnop ") for _ in range(40)) + passage + "".join(rng.choice("qrstu ") for _ in range(40)) for _ in range(60)]
    sent = []
    sort = suffix_dedup.materialize

    def keep(df, label, **more):
        out = sort(df, label, **more)
        if label == "stretches":
            sent.extend((r["r"], suffix_dedup.unzip_arrays(r["blob"], "<u4", "<u4", "u1", "u1", "<i8", "u1")) for r in out.filter("r >= 0").collect())
        return out

    monkeypatch.setattr(suffix_dedup, "materialize", keep)
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.deduplicate(docs_frame(spark, texts)).collect()}
    assert got == cut_by_brute_force(texts)
    inside = [(part, size) for part, (_, _, _, sizes, _, _) in sent for size in sizes]
    assert len({p for p, _ in inside}) > 10 and len(inside) < 60 * 35


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def roots(n, edges):
    parent = list(range(n))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(v) for v in range(n)]


@pytest.mark.parametrize("short_lists", [False, True])
def test_ngram_join(spark, monkeypatch, short_lists):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = corpus(4)
    for _ in range(30):  # a large group whose members are near one origin
        w = list(base)
        w[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    if short_lists:
        monkeypatch.setattr(ngram_join, "LIST", 4)
        monkeypatch.setattr(ngram_join, "PER_PART", 200)
    sets = [shingle_set(t) for t in texts]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = roots(len(sets), edges)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs_frame(spark, texts)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(sets))}
    assert ngram_join.near_duplicates(docs_frame(spark, ["a"]).limit(0)).count() == 0


def grouped_texts():
    """Copies of a text that differ in their last word, so in one shingle; by hash, most have the same prefix and size."""
    words = [f"g{k}" for k in range(60)]
    return [" ".join([*words, f"end{k}"]) for k in range(40)] + [" ".join(words[:40] + [f"x{k}" for k in range(30)]) for _ in range(2)]


def test_token_dictionary_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(token_store.zstandard, "train_dictionary", lambda size, samples: seen.append([len(x) for x in samples]) or token_store.zstandard.ZstdCompressionDict(b"x"))
    docs = docs_frame(spark, [f"word{k} " * 2000 for k in range(20)])
    for limit in (1000, 1 << 17):
        monkeypatch.setattr(token_store, "SAMPLE_BODY", limit)
        token_store.train_dictionary(docs, public_tokenizers.path("word_bpe_49k.json"), None, 2)
    assert set(seen[0]) == {1000} and min(seen[1]) > 1000


def test_ngram_join_groups_equal_prefixes(spark, monkeypatch):
    texts = grouped_texts()
    listed = []
    flat = np.zeros(1 << ngram_join.SKETCH_BITS, np.int64)  # order by hash alone
    monkeypatch.setattr(ngram_join, "sketch", lambda *a: flat)
    expanded = ngram_join._expanded
    monkeypatch.setattr(ngram_join, "_expanded", lambda lists, groups: listed.append((lists.select("grp").distinct().count(), groups.count())) or expanded(lists, groups))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs_frame(spark, texts)).collect()}
    assert got == {**{k: 0 for k in range(40)}, 40: 40, 41: 40}
    assert listed[0][0] < 30 and listed[0][1] == 41  # groups in the lists, classes in all
    # a group alone, whose shingles no other group holds
    groups = ngram_join.signatures(docs_frame(spark, texts[:40]), flat).groupBy("grp").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").first()
    pair = [texts[groups["a"]], texts[groups["b"]]]
    assert {r["component_id"] for r in ngram_join.near_duplicates(docs_frame(spark, pair)).collect()} == {0}
    assert listed[1] == (0, 2)


def test_ngram_join_salted_lists_have_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST", 4)
    rng = random.Random(9)
    texts = ["common words of every text " + " ".join(f"s{rng.randrange(10**6)}" for _ in range(3)) for _ in range(64)]
    docs = docs_frame(spark, texts)
    named = ngram_join.signatures(docs, ngram_join.sketch(docs), percent=10)
    lists = ngram_join._shared_lists(ngram_join._postings(named, 16), 16).withColumn("task", F.spark_partition_id()).collect()
    token = max({r["token"] for r in lists}, key=lambda t: sum(r["token"] == t for r in lists))
    hot = [r for r in lists if r["token"] == token]
    assert len({r["num"] for r in hot}) == len(hot) == 64
    assert len({r["part"] for r in hot}) > 4 and len({r["task"] for r in hot}) > 4


def test_ngram_join_blocks_of_components(spark, monkeypatch):
    """Members that no leader reaches meet in blocks, whatever their chunks and component."""
    monkeypatch.setattr(ngram_join, "CHUNK", 3)
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 0)
    rng = random.Random(12)
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(base[:k] + [f"n{j}"] + base[k + 1 :]) for j in range(40) for k in [rng.randrange(100)]] + [" ".join(base[::-1] + [f"m{k}"]) for k in range(7)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs_frame(spark, texts)).collect()}
    sets = [shingle_set(t) for t in texts]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert got == dict(enumerate(roots(len(sets), edges)))


def test_ngram_join_sends_pairs_in_proportion(spark, monkeypatch):
    """Near copies that no leader has linked, in many lists: twice as many send some twice as many pairs, not four times."""
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "WAVES", (1, None), raising=False)
    across, sent = ngram_join._across, []
    monkeypatch.setattr(ngram_join, "_across", lambda *a: sent.append(across(*a)) or sent[-1])
    rng = random.Random(21)
    base = [f"w{k}" for k in range(200)]
    rows = {}
    for n in (40, 80):
        texts = [" ".join(base[:k] + [f"n{n}x{j}"] + base[k + 1 :]) for j in range(n) for k in [rng.randrange(200)]]
        sent.clear()
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs_frame(spark, texts)).collect()}
        assert set(got.values()) == {0} and len(got) == n
        rows[n] = sum(x.filter("a is not null").count() for x in sent)
    assert rows[80] < 3 * rows[40] and rows[80] < 80 * 79 / 2, rows


@pytest.mark.parametrize("first", [1, 16])
def test_ngram_join_waves_lose_no_link(spark, monkeypatch, first):
    """The likeliest pairs fail, and the one link that counts is in no first wave; clusters hold many that nearly link."""
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "WAVES", (1, None))
    monkeypatch.setattr(ngram_join, "FIRST", first)
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    rng = random.Random(22)
    texts = []
    for g in range(3):  # each text differs from the others of its group by 17 % to 25 % of their shingles, some by less
        base = [f"b{g}w{k}" for k in range(150)]
        for j in range(25):
            w = list(base)
            for k in rng.sample(range(0, 150, 5), rng.choice((1, 2, 3, 3, 3, 4))):
                w[k] = f"d{g}x{j}x{k}"
            texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs_frame(spark, texts)).collect()}
    assert got == dict(enumerate(roots(len(sets), edges)))
    assert 0 < len(edges) < 3 * 25 * 24 / 2


def test_ngram_join_writes_few_tables(spark, monkeypatch):
    """Links of several rounds are contracted by one step each, and little that is left meets at once after the first."""
    texts, tables, settled = [], [], []
    for g in range(4):  # chains: each text resembles its neighbours only, so no leader reaches all of a list
        words = [f"c{g}w{k}" for k in range(200)]
        texts += [" ".join(words[5 * j : 5 * j + 90]) for j in range(20)]
    for module in (ngram_join, components):
        monkeypatch.setattr(module, "materialize", lambda df, label, *a, f=module.materialize, **b: tables.append(label) or f(df, label, *a, **b))
    monkeypatch.setattr(ngram_join, "connected_components", lambda *a, f=ngram_join.connected_components: settled.append(1) or f(*a))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs_frame(spark, texts)).collect()}
    sets = [shingle_set(t) for t in texts]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert got == dict(enumerate(roots(len(sets), edges))) and len(set(got.values())) == 4
    assert len(settled) == 1 and tables.count("led") == 2, (len(settled), tables)


def test_ngram_join_ranks_of_counts(spark):
    """Ranks are those of the plain formula, and the counters stay as they are."""
    counts = np.random.default_rng(5).poisson(30, 1 << ngram_join.SKETCH_BITS)
    counts[::1000] += 5000
    before = counts.copy()
    usual = float(np.median(counts))
    want = np.floor(np.log2(np.maximum(counts - usual - 3 * np.sqrt(usual), 1))).astype(np.uint8)
    assert (ngram_join.ranks_of(counts) == want).all() and (counts == before).all() and want.max() == 12


def test_quality_fit_gives_memory_back(spark, monkeypatch):
    """The driver keeps the model alone: the sample's texts and features are freed before it goes on."""
    alive, seen = [], []

    class Texts(list):
        pass

    def train(texts, labels):
        held = Texts(texts)
        alive.append(weakref.ref(held))
        return quality.Embeddings(np.zeros(1 << quality.BITS, np.float32), 0.0)

    monkeypatch.setattr(quality, "train", train)
    monkeypatch.setattr(quality, "release", lambda: seen.append([x() for x in alive]))
    docs = docs_frame(spark, [f"text {k}" for k in range(40)])
    quality.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int"))
    assert seen == [[None]]


def test_parity_bound_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 7, 40, 300, 3000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate((a[: n - n // 5], rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)))
        maps, sizes = ngram_join.parity(np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)]))
        x, y = (m.view("<u8")[None] for m in np.split(maps, [sizes[0]]))
        width = min(x.shape[1], y.shape[1])
        odd = int(np.bitwise_count(ngram_join.fold(x, width) ^ ngram_join.fold(y, width)).sum())
        differ = len(np.setxor1d(a, b))
        assert odd <= differ and odd >= differ * 0.6


def test_ngram_join_rows(spark):
    same = "one two three four five six seven"
    rows = [(None, same, 1), (None, None, 1), (3, same, 1), (3, same, 2), (4, same + " ", 1), (5, "", 1), (6, None, 1), (7, "\t \n", 1)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, cls int")).collect()
    assert sorted(((r[0] or -1, r[1], r[2] or -1) for r in got)) == [(-1, 0, -1), (-1, 3, -1), (3, 3, 3), (3, 3, 3), (4, 3, 3), (5, 0, 5), (6, 0, 6), (7, 0, 7)]


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    rows = [(k, [float(x) for x in np.float32(centre + rng.normal(size=64) * 0.2)], k % 2, "v") for k in range(120)]
    rows += [(k, [float(x) for x in np.float32(rng.normal(size=64))], k % 2, "v") for k in range(120, 200)]
    rows += [(200, rows[0][1], 0, "v"), (201, rows[0][1], 0, "v"), (202, rows[0][1], None, "v"), (203, None, 0, "v"), (204, [0.0] * 64, 0, "v")]
    rows += [(205, [float("nan")] + [1.0] * 63, 0, "v"), (206, [None] + [1.0] * 63, 0, "v"), (207, [], 0, "v"), (208, [float("inf")] * 64, 0, "v"), (209, [1.0] * 3, 0, "v"), (210, [2.0] * 3, 0, "v")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")
    ok = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])}
    label = {r[0]: r[2] for r in rows}
    edges = [(a, b) for a in ok for b in ok if b < a and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.93]
    want, links = roots(211, edges), [0] * 211
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {k: (links[k], want[k], want[k] == k) for k in range(211)}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_with_null_and_repeated_ids(spark):
    v, w = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    rows = [(None, v, 1), (None, v, 1), (5, v, 1), (3, v, 1), (3, w, 1), (4, w, 1), (9, [1.0, 0.01, 0.1], 1), (9, [0.0, 1.0, 0.01], 1), (None, None, None), (8, w, 2)]
    df = spark.createDataFrame([(i, x, k, 1, "c") for i, x, k in rows], "vec_id long, embedding array<float>, label int, rep int, first string").repartition(3)
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    # classes: v of 3 and 5, w of 3 and 4, both of 9; null ids link with nothing
    assert got == sorted([(None, 0, None, True)] * 3 + [(5, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False), (9, 2, 3, False), (9, 2, 3, False), (8, 0, 8, True)], key=str)


def test_embedding_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 7)
    rng = np.random.default_rng(6)
    c = rng.normal(size=16)
    df = spark.createDataFrame([(k, [float(x) for x in c + rng.normal(size=16) * 0.01], 1) for k in range(60)], "vec_id long, embedding array<double>, label int")
    assert {(r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()} == {(59, 0)}


def test_leaks(spark):
    rng = random.Random(7)
    words = [f"v{k}" for k in range(400)]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (30, 12, 5, 3, 1, 40)]
    items[5] = items[0]
    bench = spark.createDataFrame([(k, t, "z") for k, t in enumerate(items)] + [(90, None, "z"), (91, " ... ", "z")], "item_id long, text string, doc_id string")
    filler = " ".join(rng.choice(words) + "x" for _ in range(50))
    changed = items[0].split()
    changed[-1] = "other"
    broken = items[0].split()
    broken[15] = "other"
    texts = [None, "", filler, f"{filler} {items[0].upper()} {filler}", f"{filler}. {items[1]}!", items[2], f"a {items[3]} b", f"{filler} {' '.join(changed)} {filler}", f"{filler} {' '.join(broken)} {filler}", items[0].rsplit(" ", 2)[0]]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs_frame(spark, texts), bench).collect()}
    assert got == set(leaks_by_brute_force(texts, items)) and {(3, 0), (3, 5), (4, 1), (5, 2), (6, 3), (7, 0)} <= got and (8, 0) not in got
    assert decontaminate.find_leaks(docs_frame(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs_frame(spark, texts).limit(0), bench).count() == 0
    clean = decontaminate.without_leaks(docs_frame(spark, texts), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(set(range(len(texts))) - {d for d, _ in got})
    assert decontaminate.without_leaks(docs_frame(spark, texts), bench.limit(0)).count() == len(texts)
    twice = f"{filler} {items[1]} {filler} {items[1]}"
    rows = spark.createDataFrame([(1, twice), (1, twice), (None, twice), (2, None)], "doc_id long, text string")
    found = decontaminate.find_leaks(rows, bench).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"], r["start_word"], r["similarity"]) for r in found) == [(-1, 1, 50, 1.0), (1, 1, 50, 1.0), (1, 1, 50, 1.0)]
    assert [r["doc_id"] for r in decontaminate.without_leaks(rows, bench).collect()] == [2]


def leaks_by_brute_force(texts, items, percent=80):
    """``{(text, item): (similarity, start)}`` of the best window, the first of equals."""
    from collections import Counter

    def grams(w, k):
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    out = {}
    for d, t in enumerate(texts):
        w = re.findall(r"\w+", (t or "").lower())
        for i, item in enumerate(items):
            v = re.findall(r"\w+", item.lower())
            k, n = min(5, len(v)), min(len(v), len(w))
            for s in range(len(w) - n + 1 if n >= k else 0):
                a, b = grams(w[s : s + n], k), grams(v, k)
                both, union = sum((a & b).values()), sum((a | b).values())
                if 100 * both >= percent * union and both / union > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (both / union, s)
    return out


@pytest.mark.parametrize("length", [9, 40, 90])
def test_leaks_with_repeated_shingles(length):
    """Windows at the limit whose shingles repeat: the index finds all, and nothing else does."""
    rng = random.Random(length)
    items, texts = [], []
    for k in range(12):
        loop = [f"i{k}w{j}" for j in range(rng.choice([2, 3, 7, length]))]
        item = [loop[j % len(loop)] for j in range(length)]
        items.append(" ".join(item))
        for _ in range(6):
            w = list(item)
            spam = f"s{rng.randrange(9)}"
            cut = rng.randrange(max(1, length // 9) + 2)
            at = rng.choice([0, length - cut, rng.randrange(length)])
            w[at : at + cut] = [spam] * len(w[at : at + cut])
            texts.append(" ".join(["f"] * rng.randrange(4) + w + ["g"] * rng.randrange(4)))
    want = leaks_by_brute_force(texts, items)
    for radius in (decontaminate.RADIUS, 0):
        index = decontaminate.Index(list(range(len(items))), items, radius)
        got = {(row, item): (w[0] / w[1], w[2]) for row, item, w in decontaminate.scan_batch(index, pa.array(texts), 80)}
        if radius:
            assert got == want and len(want) > 12
        else:
            assert got.items() <= want.items() and (length == 9 or len(got) < len(want))
    index.candidates = lambda n, prints: (np.zeros(0, int),) * 3
    assert not list(decontaminate.scan_batch(index, pa.array(texts), 80))


@pytest.mark.parametrize("span", [1, 4, 9])
def test_window_sums_are_those_of_each_window(span):
    rng = np.random.default_rng(span)
    h = rng.integers(1, 6, 40).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = decontaminate.window_sums(h, span)
    for a in range(len(h) - span + 1):
        assert (got[a] == decontaminate.window_sums(h[a : a + span], span)[0]).all()
        assert (got[a] == decontaminate.window_sums(np.sort(h[a : a + span]), span)[0]).all()


def test_token_store(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = corpus(8) + ["<|endoftext|> a", "a\n\nb  c \n"]
    for frame in (docs_frame(spark, texts), docs_frame(spark, texts[:3])):
        shards = token_store.write_store(frame, path, 2, shards=3)
        got = {r["doc_id"]: tuple(r)[1:] for r in token_store.read_store(shards, shards._store).collect()}
        at = 0
        for i in sorted(got):
            ids = lib.encode(texts[i] or "", add_special_tokens=False).ids + [2]
            assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
    one = shards.orderBy("shard").first()["path"]
    assert token_store.read_document(shards._store, one, 0)[0].tolist() == [2]
    empty = token_store.write_store(docs_frame(spark, texts).limit(0), path, 2)
    assert token_store.read_store(empty, empty._store).count() == 0
    null = token_store.write_store(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string"), path, 2)
    assert sorted(r["start"] for r in token_store.read_store(null, null._store).collect()) == [0, 2, 4]


def test_token_shards_have_tasks_of_their_own(spark):
    n = 37
    slots = spark.createDataFrame([(x,) for x in token_store._slots(spark, n)], "slot int").repartition(n, "slot")
    assert {r["c"] for r in slots.groupBy(F.spark_partition_id()).agg(F.count("*").alias("c")).collect()} == {1}


def test_token_pieces_are_the_library_s():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(31)
    signs = [chr(c) for c in range(0x21, 0x250) if not 0x7F <= c <= 0xA0 and c != 0xAD] + list("'´’ \t\n\r\u00a0\u2028中あ🙂́")
    letters = "abcdefghijklmnopqrstuvwxyzABCéüñßøŁ"
    texts = ["".join(rng.choice(signs if k % 2 else letters + "  ..,'\n") for _ in range(rng.randint(1, 60))) for k in range(3000)]
    texts += ["word " * 40_000, "x" * 200_000, "it's we'll I'd", " lead", "trail ", "\n", "a\nb", "<|endoftext|>", "a<|endoftext|> b"]
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert token_store.pieces(path).encode_batch(texts) == want


def test_bpe_digest(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = corpus(9)
    for r in bpe.digest(docs_frame(spark, texts), path).collect():
        ids = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_language(spark):
    say = {"en": "the house and the garden of her brother", "de": "das haus und der garten von ihrem bruder", "fr": "la maison et le jardin de son frère"}
    rows = [(k, f"{say[x]} {k}", x, 1) for k, x in enumerate(list(say) * 40)] + [(900, None, "en", 1), (901, "123 !", "en", 1), (902, "", None, 1), (903, "und der garten", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert all(got[k]["lang_pred"] == x for k, _, x, _ in rows[:120]) and got[903]["lang_pred"] == "de"
    assert [got[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= got[k]["score"] <= 1 for k in got)
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_quality(spark):
    docs = spark.createDataFrame([(k, f"calm text {k} about things" if k % 2 else f"*** {k} $$$ now!!", 7) for k in range(120)] + [(500, None, 7), (501, "", 7)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(120)] + [(None, 1, 0), (3, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 122 and all(got[k]["predicted"] == k % 2 for k in range(120))
    kept = quality.accepted(docs, quality.fit(docs, labels))
    assert {k for k in range(1, 120, 2)} <= {r["doc_id"] for r in kept.collect()} and kept.columns == docs.columns
    assert quality.classify(docs.limit(0), labels.limit(0)).count() == 0


def test_quality_sample_passes_over_long_texts(spark, monkeypatch):
    long = {0: "***! " * 300, 1: "calm " * 300}
    docs = spark.createDataFrame([(k, long.get(k) or (f"calm text {k} about things" if k % 2 else f"*** {k} $$$ now!!")) for k in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, quality int")
    seen = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda texts, ys: seen.append((texts, ys.tolist())) or train(texts, ys))
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 600)
    got = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, labels).collect()}
    assert all(got[k] == k % 2 for k in range(2, 120))
    texts, ys = seen.pop()
    for y in (0, 1):
        of = [t for t, x in zip(texts, ys) if x == y]
        assert 500 < sum(map(len, of)) <= 600 and long[y] not in of
        # by hash: not the smallest ids alone
        assert max(int(t.split()[2 if y else 1]) for t in of) > 90
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 10)
    quality.fit(docs, labels)
    assert sorted(seen.pop()[1]) == [0, 1]


def test_pages(spark):
    body = '<html><body><div class="x"><p>Site words that recur</p></div><div><p>Own text {0}</p><p>Shared line</p></div></body></html>'
    rows = [(k, "http://Host.example/a", body.format(k), "n") for k in range(8)] + [(20, "http://host.example/b", body.format(3), "n"), (21, None, "<p>alone</p>", "n"), (22, "http://x", None, "n"), (23, "http://x", "", "n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(df).collect()}
    assert got[2] == ("Own text 2\nShared line", 22) and got[20][0] == "Own text 3\nShared line"
    assert got[21] == ("alone", 5) and got[22] == got[23] == ("", 0)
    assert html_extract.extract(df.limit(0)).count() == 0


def html_texts(spark, pages, **bounds):
    df = spark.createDataFrame([(k, "http://h.example/a", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_extract.extract(df, **bounds).collect()}


def test_html_text_blocks_are_template(spark):
    body = "<html><body><p>We use <b>recurring</b> notices</p><h3>Partner offers</h3><address>Main road 1</address><h1>Title {0}</h1><ul><li><a>Home</a></li><li>Page {0}</li></ul><a>Top</a><p>Own <i>the</i> text {0}</p><div><h2>Part {0}</h2><p>Shared <b>passage</b></p></div></body></html>"
    got = html_texts(spark, [body.format(k) for k in range(8)])
    assert got == {k: f"Title {k}\nPage {k}\nOwn the text {k}\nPart {k}\nShared passage" for k in range(8)}


def test_html_article_content_is_exempt(spark):
    inner = "<div><p>Copied <i>body</i></p><ul><li>one</li></ul><section><table><tr><td>cell</td></tr></table></section><dl><dt>t</dt><dd>d</dd></dl></div>"
    for tag in ("article", "main"):
        page = f"<body><p>Site notice</p><div><{tag}>{inner}</{tag}></div><section><article>teaser</article></section><div class='ad'>{{0}}</div></body>"
        got = html_texts(spark, [page.format(k) for k in range(8)])
        assert set(got.values()) == {"Copied body\none\ncell\nt\nd"}
        got = html_texts(spark, [f"<body><{tag}><h1>Title {k}</h1>{inner}</{tag}></body>" for k in range(8)])
        assert got == {k: f"Title {k}\nCopied body\none\ncell\nt\nd" for k in range(8)}
    got = html_texts(spark, [f"<head><title>{k}</title></head><body><div><p>All copied</p></div></body>" for k in range(5)])
    assert set(got.values()) == {"All copied"}


def test_html_template_bar_does_not_rise_with_the_host(spark):
    some = {0: "first sidebar", 1: "second sidebar"}
    pages = [f"<body><div><p>{some.get(k // 5, f'aside {k}')}</p></div><div>{'<p>rare</p>' if k > 36 else k}</div><p>Own {k}</p></body>" for k in range(40)]
    got = html_texts(spark, pages)
    assert got[2] == "2\nOwn 2" and got[7] == "7\nOwn 7" and got[20] == "aside 20\n20\nOwn 20"
    assert got[38] == "aside 38\nrare\nOwn 38"
    assert html_texts(spark, pages, min_pages=6)[2] == "first sidebar\n2\nOwn 2"
    small = html_texts(spark, [f"<body><div>Site words</div><p>Own {k}</p></body>" for k in range(3)])
    assert small == {k: f"Own {k}" for k in range(3)}


def test_html_template_counts_decide(spark):
    """Sites of unmarked boilerplate and own passages in random order: the recurring subtrees go, and without the counts
    they would stay.  The expected text is built along with the pages."""
    rng = random.Random(21)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + "."
    rows, want, plain = [], {}, {}
    for host in range(6):
        parts = [f"<div class='x{k}'><p>{say(6)}</p><ul><li>{say(2)}</li><li>{say(2)}</li></ul></div>" for k in range(4)]
        texts = {x: "\n".join(re.findall(r"<(?:p|li)>([^<]*)", x)) for x in parts}
        for n in range(12):
            own = [say(rng.randint(3, 20)) for _ in range(rng.randint(1, 4))]
            body = [f"<div><p>{x}</p></div>" for x in own]
            used = rng.sample(parts, 3)
            at = sorted(rng.randrange(len(body) + 1) for _ in used)
            pieces, k = [], 0
            for i in range(len(body) + 1):
                while k < len(used) and at[k] == i:
                    pieces.append((used[k], texts[used[k]]))
                    k += 1
                if i < len(body):
                    pieces.append((body[i], own[i]))
            page_id = len(rows)
            rows.append((page_id, f"https://h{host}.example/{n}", "<html><body>" + "".join(x for x, _ in pieces) + "</body></html>"))
            want[page_id], plain[page_id] = "\n".join(own), "\n".join(t for _, t in pieces)
    rows += [(None, rows[0][1], rows[0][2]), (900, rows[0][1], None), (901, rows[0][1], ""), (902, rows[0][1], rows[0][2]), (902, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = [(r["page_id"], r["text"]) for r in html_extract.extract(df).collect()]
    assert sorted(((k is None, k or 0, t) for k, t in got)) == sorted([(False, k, t) for k, t in want.items()] + [(True, 0, want[0]), (False, 900, ""), (False, 901, ""), (False, 902, want[0]), (False, 902, want[0])])
    off = {r["page_id"]: r["text"] for r in html_extract.extract(df, share=2.0, min_pages=10**6).collect()}
    assert all(off[k] == plain[k] != want[k] for k in want)


@pytest.mark.parametrize(
    "page",
    [
        "<a " + " ".join(f'x{k}="v{k}"' for k in range(100)) + " unclosed",
        "<a " + "\"'" * 5000,
        "<p>" + "<a href='x\" " * 20000,
        "<script>" + "</script " * 50000,
        "<!-- " * 50000,
        "<b>" * 20000 + "<body>" * 20000 + "<li>" * 20000,
        "<div " * 50000 + "<p>end</p>",
        "<table>" * 5000 + "<td>" * 20000 + "x",
        "<a" * 200_000 + " <",
        "<a " * 200_000 + "\"",
        "<a x='" * 100_000 + "<",
        "</a " * 200_000,
    ],
)
def test_html_hostile_pages_end(page):
    begin = time.monotonic()
    html_extract.main_text(page)
    assert time.monotonic() - begin < 4
    html_extract.main_text(page, {1})
    html_extract.regions(page)
    assert time.monotonic() - begin < 10


@pytest.mark.parametrize(
    "page",
    [
        '<div class="page with-sidebar"><article>{}</article></div>',
        '<div class="content no-sidebar"><p>Kept</p><p>too</p></div>',
        '<div class="header"><article>{}</article></div>',
        '<div id="sidebar" class="menu"><main>{}</main></div><div class="sidebar">gone</div>',
        '<form class="notice"><article>{}</article></form><form>gone</form>',
        '<article><h2 class="section-header">Kept</h2><p class="notice">too</p><div class="cookie-notice">gone</div></article>',
        '<div class="comments"><article class="comment-body">A far longer remark of a reader, which goes</article></div><article>{}</article>',
        '<div class="navigation notice"><p>Kept</p><p>too</p></div><div class="notice">gone</div>',
        '<p>Kept</p><p>too</p><div class="comments">Remarks that are longer than the article itself, all of them gone</div>',
    ],
)
def test_html_containers_of_the_text_stay(page):
    page = f"<html><body>{page.format('<p>Kept</p><p>too</p>')}</body></html>"
    assert html_extract.main_text(page) == "Kept\ntoo"


def test_html_inline_marks_are_text():
    page = "<article><p>Code: <span class='comment'># note</span> and <em class='header'>more</em> <span class='ad'>buy</span></p><div class='related'>Kept</div><div class='comments'>gone</div></article>"
    assert html_extract.main_text(page) == "Code: # note and more\nKept"


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there.\nHow are  you?"),
        (1, 1, "b", "On Monday X wrote:\n> Hello there.\n> how are you?\n\nFine thanks."),
        (1, 2, "u", "> On Tue Y wrote:\n>> Hello there.\n>> How are you?\n> Fine thanks.\nGood.\n"),
        (1, 3, "b", "> nothing known\nnew thread"),
        (1, 4, "u", "> Good.\n> > Fine thanks.\nbye"),
        (1, 4, "u", "> Good.\n> > Fine thanks.\nbye"),
        (None, 1, "u", "> Good."),
        (2, 0, "u", None),
        (2, 1, "u", ""),
        (2, 2, "u", "> new thread\nx"),
    ]
    df = spark.createDataFrame([(*r, "q") for r in rows], "conv_id long, turn long, role string, text string, hash string")
    got = [tuple(r) for r in quote_threads.link_quotes(df).collect()]
    assert got[1:7] == [
        (1, 0, "u", "Hello there.\nHow are  you?", 0, None, 0, 0),
        (1, 1, "b", "Fine thanks.", 1, 0, 0, 1),
        (1, 2, "u", "Good.", 3, 1, 0, 2),
        (1, 4, "u", "bye", 2, 2, 0, 3),
        (1, 4, "u", "bye", 2, 2, 0, 3),
        (1, 3, "b", "new thread", 1, None, 3, 0),
    ]
    assert got[0][:4] == (None, 1, "u", "") and got[7:] == [(2, 0, "u", None, 0, None, 0, 0), (2, 1, "u", "", 0, None, 1, 0), (2, 2, "u", "x", 1, None, 2, 0)]
    chain = spark.createDataFrame([(5, k, "u", f"> m{k - 1}\nm{k}") for k in range(40)], "conv_id long, turn long, role string, text string")
    assert [r["depth"] for r in quote_threads.link_quotes(chain).collect()] == list(range(40))
    assert quote_threads.link_quotes(df.limit(0)).count() == 0
