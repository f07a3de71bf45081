"""BPE encoding and decoding by a depth-first walk over a prefix-sharing trie of distinct words.

The encoding of a prefix is determined by its last token alone: peeling that token off leaves the encoding of
a shorter prefix.  So each trie node keeps one last token, computed from the nodes above it, and words that
share a prefix share its work.  The walk visits the distinct words in byte order and keeps only the path to
the current word, which is the depth-first order of the trie without its nodes in memory.

A token ``t`` ends the encoding of a prefix exactly if ``t`` is a suffix of the prefix, and the pair of the
last token before it and ``t`` is stable: merging the symbols of both again gives these two tokens.

Words come from the vocabulary file's own normaliser (NFC, white space to a space, lower case) and its split
pattern; special tokens in the raw text are found first and are words of their own.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strandlink.llm.common import map_arrow, steps, utf8

#: Words that a worker remembers before it starts a new generation; those in use move along.
MEMORY_WORDS = 100_000

# The word pattern of the vocabulary file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where Latin-1 prints it, else the
    next free code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _sizes(table: dict[bytes, int]) -> dict[bytes, tuple[int, ...]]:
    """For each ending of three bytes (or whole shorter token), the sizes of tokens that may end there, longest
    first."""
    long: dict[bytes, set[int]] = {}
    for raw in table:
        if len(raw) > 2:
            long.setdefault(raw[-3:], set()).add(len(raw))
    return {k: tuple(sorted(v, reverse=True)) + (2, 1) for k, v in long.items()}


class TrieBpe:
    """Encoder and decoder over a ``tokenizers`` BPE file with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        alphabet = byte_alphabet()
        self.letter = {c: b for b, c in enumerate(alphabet)}
        self.first = [vocab.get(c) for c in alphabet]
        self.last = [vocab.get(c + self.suffix) for c in alphabet]
        if None in self.first or None in self.last:
            raise ValueError("the vocabulary must hold every byte, with and without the end of a word")
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.symbols: dict[int, tuple[int, ...]] = {}
        made = {i for _, i in self.merges.values()} | set(self.first) | set(self.last)
        for t, i in vocab.items():
            ends = bool(self.suffix) and t.endswith(self.suffix) and i not in self.first
            body = t[: -len(self.suffix)] if ends else t
            if i not in made or any(c not in self.letter for c in body):
                continue
            raw = bytes(self.letter[c] for c in body)
            own = tuple(self.first[b] for b in raw[:-1]) + ((self.last if ends else self.first)[raw[-1]],)
            if self._merge(own) != [i]:
                continue  # never produced whole
            self.symbols[i] = own
            (self.final if ends else self.inner)[raw] = i
        self.inner_sizes, self.final_sizes = _sizes(self.inner), _sizes(self.final)
        self.size = {i: len(s) for i, s in self.symbols.items()}
        self.stable: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pattern = regex.compile(WORD_PATTERN)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        top = max(self.text) + 1
        shown = [(self.text.get(i, "") + " ").encode() for i in range(top)]
        self.shown_len = np.array([len(s) for s in shown], np.int64)
        self.shown_at = np.concatenate(([0], np.cumsum(self.shown_len)))[:-1]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)

    def _merge(self, symbols: tuple[int, ...]) -> list[int]:
        """Merge by rank, leftmost first."""
        out, merges = list(symbols), self.merges
        while len(out) > 1:
            best = min(((merges[p][0], k) for k, p in enumerate(zip(out, out[1:])) if p in merges), default=None)
            if best is None:
                break
            k = best[1]
            out[k : k + 2] = [merges[out[k], out[k + 1]][1]]
        return out

    def _fits(self, a: int, b: int) -> bool:
        if len(self.stable) > 2_000_000:
            self.stable.clear()
        ok = self.stable[a << 20 | b] = self._merge(self.symbols[a] + self.symbols[b]) == [a, b]
        return ok

    def _walk(self, word: bytes, begin: int, stop: int, tokens: list[int], table: dict[bytes, int], sizes: dict[bytes, tuple[int, ...]]) -> None:
        """Append the last tokens of ``word[:end]`` for each ``end`` from ``begin`` to ``stop``; ``tokens[k]`` is
        the last token of the first k bytes."""
        get, known, stable = table.get, sizes.get, self.stable.get
        for end in range(begin, stop + 1):
            for size in known(word[end - 3 if end > 3 else 0 : end], (2, 1)):
                if size <= end:
                    t = get(word[end - size : end])
                    if t is not None:
                        if size == end:
                            break
                        a = tokens[end - size]
                        ok = stable(a << 20 | t)
                        if ok or ok is None and self._fits(a, t):
                            break
            else:
                raise AssertionError("no last token")
            tokens.append(t)

    def learn(self, words: set[str]) -> None:
        """Encode distinct words by a depth-first walk over the trie of their bytes."""
        raw = sorted((w.encode(), w) for w in words)
        tokens: list[int] = [-1]  # state of each node on the path
        before = b""
        size, known = self.size, self.known
        for b, w in raw:
            n = len(b) - 1
            most = min(n, len(tokens) - 1)
            keep = most
            if before[:most] != b[:most]:
                keep = 0
                for x, y in zip(before, b):
                    if x != y:
                        break
                    keep += 1
            del tokens[keep + 1 :]
            self._walk(b, keep + 1, n, tokens, self.inner, self.inner_sizes)
            before = b[:n]
            self._walk(b, n + 1, n + 1, tokens, self.final, self.final_sizes)
            t = tokens.pop()
            out = [t]
            at = n + 1 - size[t]
            while at > 0:
                t = tokens[at]
                out.append(t)
                at -= size[t]
            known[w] = struct.pack(f"<{len(out)}I", *out[::-1])

    def _words(self, text: str) -> list[str]:
        norm = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.pattern.findall(norm)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > MEMORY_WORDS:
            self.known, self.older = {}, self.known
        docs, fresh, known, older = [], set(), self.known, self.older
        for t in texts:
            if self.cut is not None and "<|" in t:
                ws: list = []
                for k, piece in enumerate(self.cut.split(t)):
                    if k % 2:
                        ws.append(self.special[piece])
                    elif piece:
                        ws.extend(self._words(piece))
            else:
                ws = self._words(t)
            docs.append(ws)
            fresh.update(ws)
        new = {w for w in fresh if isinstance(w, str) and w not in known}
        known.update((w, older[w]) for w in new if w in older)
        self.learn({w for w in new if w not in older})
        for i in self.special.values():
            known[i] = np.array([i], "<u4").tobytes()
        get = known.__getitem__
        return [b"".join(map(get, ws)) for ws in docs]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens joined by a space, as the library decodes a file that names no decoder."""
        if not len(ids):
            return b""
        lens = self.shown_len[ids]
        ends = np.cumsum(lens)
        src = np.arange(ends[-1], dtype=np.int64) + np.repeat(self.shown_at[ids] - (ends - lens), lens)
        return self.shown[src[:-1]].tobytes()


_coders: dict[str, TrieBpe] = {}


def coder(path: str) -> TrieBpe:
    if path not in _coders:
        _coders[path] = TrieBpe(path)
    return _coders[path]


def encode_column(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids binary)``: the ids of each whole text as little-endian unsigned 32-bit integers.

    A null or empty text has no ids; a null id and repeated rows are kept as they are.  ``tokenizer_path`` is
    read on the executors.
    """

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(tokenizer_path)
        texts, out = b.column(1), []
        _, off = utf8(texts)
        for i, j in steps(off):
            out += c.encode_batch([x or "" for x in texts.slice(i, j - i).to_pylist()])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "ids"])

    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return map_arrow(src, fn, "id long, ids binary")


def digest(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text, decode its ids again, and return counts and digests of both.

    Columns: ``doc_id``, ``n_tokens`` long, ``ids_sha256``, ``decoded_sha256`` (lowercase hex).  A null text
    counts as empty: no ids, and digests of nothing.
    """

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(tokenizer_path)
        n, a, d = [], [], []
        texts = b.column(1)
        _, off = utf8(texts)
        for i, j in steps(off):
            for ids in c.encode_batch([x or "" for x in texts.slice(i, j - i).to_pylist()]):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                d.append(hashlib.sha256(c.decode(np.frombuffer(ids, "<u4"))).hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return map_arrow(src, fn, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
