"""Numpy kernels against plain Python."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandlink.llm import bpe, decontaminate, embedding_dedup, html_extract, quality, suffix_dedup, token_store
from strandlink.llm.common import shingles, unzip_arrays, utf8, word_hashes, zip_arrays

ALPHABET = list("abcΣσςİIéß'stdmre 0１²½\n\t\r\x1c\x85 　​­漢😀ﬁ") + ["<|endoftext|>", "<|startoftext|>", "'ll", "  ", "aaaa", "</w>"]
TEXTS = st.lists(st.sampled_from(ALPHABET), max_size=20).map("".join)


@pytest.fixture(scope="module")
def word_coder():
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.TrieBpe(path), Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_trie_bpe_is_the_library(word_coder, text):
    own, lib = word_coder
    ids = lib.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(own.encode_batch([text])[0], "<u4")
    assert got.tolist() == ids
    assert own.decode(got) == lib.decode(ids, skip_special_tokens=False).encode()


def test_trie_bpe_forgets_without_changing(word_coder, monkeypatch):
    own, lib = word_coder
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 5)
    for text in ("one two three four five six seven", "two nine", "one two"):
        assert np.frombuffer(own.encode_batch([text])[0], "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def byte_coder():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_store._Pieces(path), Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_pieces_are_the_library(byte_coder, text):
    own, lib = byte_coder
    assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_words_and_shingles():
    texts = ["The cat  sat on\tthe MAT", "", "a b", None, "é É x" + "y" * 5000, "the cat sat on the mat"]
    data, off = utf8(pa.array(texts))
    h, rows, start, end = word_hashes(data, off)
    words = [(int(r), bytes(data[a:b]).lower().decode("utf-8", "replace")) for r, a, b in zip(rows, start, end)]
    assert [w for r, w in words if r == 0] == ["the", "cat", "sat", "on", "the", "mat"]
    assert h[0] == h[4] and len(set(h[[0, 1, 2, 3, 5]].tolist())) == 5
    s, r, at = shingles(h, rows, len(texts), 5)
    assert Counter(r.tolist()) == {0: 2, 2: 1, 4: 1, 5: 2}
    assert s[r == 0].tolist() == s[r == 5].tolist()


def test_blobs():
    parts = [np.arange(3, dtype="<u4"), np.zeros(0, "u1"), np.array([-1], "<i8")]
    assert all((a == b).all() for a, b in zip(parts, unzip_arrays(zip_arrays(*parts), "<u4", "u1", "<i8")))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=24, max_size=24), min_size=1, max_size=60), st.integers(0, 3))
def test_deep_shallow(rows, share):
    rows = [(b"x" * 8 * share + r)[:24] for r in rows] * (1 + share % 2)
    m = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 24)
    order, lcp = suffix_dedup.deep_shallow(m, 16)
    got = [rows[k] for k in order]
    assert got == sorted(rows)
    for a, b, n in zip(got, got[1:], lcp[1:]):
        true = next((k for k in range(24) if a[k] != b[k]), 24)
        assert n == true or (true < 16 and n == 0)


def test_anchors_cover_every_window():
    rng = random.Random(0)
    texts = [bytes(rng.choice(b"ab \n") for _ in range(n)) for n in (0, 49, 50, 51, 400, 3000)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.cumsum([0] + [len(t) for t in texts])
    row, p, first, last, _ = suffix_dedup.anchors(data, off)
    seen = Counter()
    for r, q, a, b in zip(row, p, first, last):
        for w in range(a, b + 1):
            assert off[r] <= w <= q <= w + 34 and w + 50 <= off[r + 1]
            seen[w] += 1
    assert set(seen.values()) <= {1} and len(seen) == sum(max(0, len(t) - 49) for t in texts)


def test_hash_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z
    for k in (2, 3, 4):
        a, b = embedding_dedup.codes(x, k), embedding_dedup.codes(y, k)
        met = ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1)
        assert met.mean() >= 0.98


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = embedding_dedup.rotate(x, np.random.default_rng(2).choice([-1.0, 1.0], (3, 16)))
    assert np.allclose((x**2).sum(1), (y**2).sum(1))


def test_multi_index_finds_all_within_the_radius():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(60)]
    index = decontaminate.Index(list(range(60)), texts)
    prints = np.array([rng.getrandbits(64) for _ in range(200)], np.uint64)
    prints[:60] = index.prints ^ np.uint64(0x0101010101010101 * 3)
    w, items, dist = index.candidates(20, prints)
    want = {(i, j) for i in range(200) for j in range(60) if bin(int(prints[i]) ^ int(index.prints[j])).count("1") <= 23}
    assert set(zip(w.tolist(), items.tolist())) == want


def test_classifier_learns_and_is_bounded():
    good = [f"plain words of text number {k} go on here" for k in range(60)]
    bad = [f"win*** $$$ now!!! {k} %%%" for k in range(60)]
    m = quality.train(good + bad, np.array([1] * 60 + [0] * 60))
    s = quality._scores(m, pa.array(["plain words go on", "$$$ now!!! %%%", "", None]))
    assert s[0] > 0.7 > s[1] and s[2] == s[3] and 0 <= s.min() <= s.max() <= 1
    assert quality._scores(quality.train([], np.zeros(0, int)), pa.array(["x"]))[0] == 0.5
    assert quality._scores(quality.train(["a"], np.array([1])), pa.array(["x"]))[0] > 0.7


PAGE = """<html><head><title>T</title></head><body><nav><a>menu</a></nav><div class="ad">buy</div>
<article><h1>Head &amp; line</h1><p><b>one<br><p>two <i>three</i>
 four</p><div class="comments"><p>me first</p></div><aside>side</aside><form>x</form><script>var a="</p>";</script>
<ul><li>a<li>b</ul></article><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Head & line\none\ntwo three four\na\nb"
    assert html_extract.main_text(PAGE[: PAGE.index("<div class=\"comments")]) == "Head & line\none\ntwo three four"
    assert html_extract.main_text("") == "" and html_extract.main_text("<p>") == ""
    assert html_extract.main_text("just text &lt;b&gt;") == "just text <b>"
    assert html_extract.main_text("<div>a<div>b</div>c</div></p></b>d") == "a\nb\nc\nd"
    assert html_extract.main_text("<script>x") == "" and html_extract.main_text("<!-- <p>no</p> --><p>yes") == "yes"
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert html_extract.main_text(deep) == "x"
