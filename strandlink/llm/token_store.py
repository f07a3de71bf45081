"""Token ids in files of separately compressed documents under one shared zstandard dictionary.

A store is a folder of shard files, each holding documents in ascending id order, and one dictionary trained on
a bounded sample of serialised id arrays.  Layout of a shard, all integers little-endian:

    8 bytes   magic
    32 bytes  SHA-256 of the dictionary
    ...       one zstandard frame for each document: its ids as unsigned 16-bit integers where the vocabulary
              fits, else 32-bit
    ...       index: for each document id (8), first token within the shard (8), frame offset (8), ids (8)
    footer    index offset (8), number of documents (8), bytes per id (8), null ids (8)

A reader seeks to the footer, checks the dictionary hash, and can then decompress any single document.  A task
writes its shard under a name of its own and moves it into place when it is complete, so a task that runs twice
leaves the same file.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlink.llm.bpe import byte_alphabet
from strandlink.llm.common import hash_bins, map_arrow, steps, utf8
from strandlink.plans.stages import new_path

MAGIC = b"tokens01"
#: Documents of the dictionary's sample, at most, and their ids in all.
SAMPLE_DOCS = 2_000
SAMPLE_IDS = 2_000_000
#: Bytes of ids of a document that the dictionary learns from: its beginning.
SAMPLE_BODY = 1 << 17
DICT_BYTES = 64 << 10
#: Of the quick levels the one that makes the smallest frames under a dictionary.
LEVEL = 2
#: Documents that a shard holds at most, where their number is not given.
SHARD_DOCS = 500_000
#: Pieces of text that a worker remembers before it starts a new generation; those in use move along.
MEMORY_PIECES = 400_000

#: Signs that may follow a word; each is neither a letter, a digit nor white space.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"

_tokenizers: dict[str, _Pieces] = {}


#: What a byte-level model is shown for each byte.
_SHOWN = dict(enumerate(byte_alphabet()))


def _shown(text: str) -> str:
    if text.isascii() and text.isalpha():
        return text
    return text.encode().decode("latin-1").translate(_SHOWN)


class _Cache(dict):
    """Ids of words after a given lead, as little-endian unsigned 32-bit integers; asks the library for others."""

    def __init__(self, tok: Tokenizer, lead: str, older: dict):
        super().__init__()
        self.tok, self.lead, self.older = tok, lead, older
        self.model, self.shown = tok.model, _shown(lead)
        self.ends: dict[str, bytes] = {}

    def signs(self, end: str) -> bytes:
        """Ids of signs after a letter."""
        out = self.ends.get(end)
        if out is None:
            if len(self.ends) > 10_000:
                self.ends.clear()
            out = self.ends[end] = array("I", self.tok.encode(end, add_special_tokens=False).ids).tobytes()
        return out

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            base = word.rstrip(SIGNS)
            if word.isalpha():  # letters after the lead are one pre-token: the library's model alone is enough
                out = array("I", [t.id for t in self.model.tokenize(self.shown + _shown(word))]).tobytes()
            elif base and base != word and base[-1].isalpha():  # letters end a pre-token, and so does the word
                out = self[base] + self.signs(word[len(base) :])
            else:
                out = array("I", self.tok.encode(self.lead + word, add_special_tokens=False).ids).tobytes()
        self[word] = out
        return out


class _Pieces:
    """The library's encoder, asked once for each distinct piece of text.

    A space before a printable ASCII or Latin letter, digit or sign always starts a new pre-token of the byte-level
    pattern, and a single line feed between two such characters is one, so a text may be cut there and its pieces
    encoded alone.  Texts with a special token go to the library whole.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        safe = r"[\x21-\x7e\u00a1-\u00ac\u00ae-\u024f]"
        self.unsafe = re.compile("[^ \\n" + safe[1:])
        self.cut = re.compile(rf" (?={safe})")
        self.feed = array("I", self.tok.encode("\n", add_special_tokens=False).ids).tobytes()
        self.known, self.heads = _Cache(self.tok, " ", {}), _Cache(self.tok, "", {})

    def _odd(self, text: str) -> bool:
        """Whether white space is anything but single spaces and line feeds between other safe characters."""
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] == "\n" or text[-1] in " \n":
            return True
        return not text.replace("\n", " ").isprintable() if text.isascii() else self.unsafe.search(text) is not None

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        known, heads = self.known.__getitem__, self.heads
        if self._odd(text):
            first, *rest = self.cut.split(text)
            return (heads[first] if first else b"") + b"".join(map(known, rest))
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append((heads[first] if first else b"") + b"".join(map(known, rest)))
        return self.feed.join(lines)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > MEMORY_PIECES:
            self.known = _Cache(self.tok, " ", dict(self.known))
        if len(self.heads) > MEMORY_PIECES // 8:
            self.heads = _Cache(self.tok, "", dict(self.heads))
        return [self.encode(t) for t in texts]


def pieces(path: str) -> _Pieces:
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _tokenizers[path] = _Pieces(path)
    return _tokenizers[path]


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids binary)``: the library's ids of each whole text (null: empty) and then ``end_id``."""
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = b.column(1), []
        p = pieces(tokenizer_path)
        _, off = utf8(texts)
        for i, j in steps(off):
            out += [x + tail for x in p.encode_batch([t or "" for t in texts.slice(i, j - i).to_pylist()])]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return map_arrow(src, fn, "doc_id long, ids binary")


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int | None, width: int, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A dictionary from the documents with the smallest id hashes: SAMPLE_DOCS and SAMPLE_IDS at most,
    whatever the size of the table, and the first SAMPLE_BODY bytes of ids of each (stored documents are whole).

    The same rows make the same dictionary in any partitioning.  Returns b"" where there is too little to learn.
    """
    bins = 1 << 16
    n = docs.count()
    cut = bins if n <= SAMPLE_DOCS else max(1, int(bins * SAMPLE_DOCS / n))
    some = docs.filter(hash_bins(id_col, bins) < cut)
    rows = tokenize(some, tokenizer_path, end_id, id_col, text_col)
    limit = SAMPLE_BODY
    narrow = map_arrow(rows, lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array([_pack(np.frombuffer(x, "<u4"), width)[:limit] for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "body"]), "doc_id long, body binary")
    kept, total = [], 0
    for r in narrow.orderBy(F.xxhash64("doc_id"), "doc_id", "body").limit(SAMPLE_DOCS).toLocalIterator():
        kept.append(bytes(r["body"]))
        total += len(kept[-1]) // width
        if total >= SAMPLE_IDS:
            break
    if len(kept) < 16 or total * width < 1 << 14:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, total * width // 8), kept).as_bytes()
    except zstandard.ZstdError:
        return b""


def _pack(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def _unpack(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype(np.uint32)


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


_compressors: dict[bytes, zstandard.ZstdCompressor] = {}


def _compressor(zdict: bytes) -> zstandard.ZstdCompressor:
    """One compressor a worker, with the dictionary digested once for all documents."""
    if zdict not in _compressors:
        d = _dictionary(zdict)
        if d is not None:
            d.precompute_compress(level=LEVEL)
        _compressors.clear()
        _compressors[zdict] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True, write_checksum=False)
    return _compressors[zdict]


def _slots(spark: SparkSession, n: int) -> list[int]:
    """Numbers that Spark's hash partitioning deals to the partitions 0, 1 and so on of ``n``, so that no two shards
    share a task."""
    found: dict[int, int] = {}
    begin = 0
    while len(found) < n:
        number = F.col("id").cast("int")
        rows = spark.range(begin, begin + 16 * n + 64).groupBy(F.pmod(F.hash(number), F.lit(n)).alias("part")).agg(F.min(number).alias("number"))
        for r in rows.collect():
            found.setdefault(r["part"], r["number"])
        begin += 16 * n + 64
    return [found[k] for k in range(n)]


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, shards: int | None = None) -> DataFrame:
    """Encode documents and write them in ascending id order; returns one row for each shard:
    ``(shard, path, n_docs, n_tokens, first)`` with ``first`` the number of ids in all shards before it.

    The id ranges of shards come from percentiles of the id column alone, so texts are encoded once.  Rows with
    a null id come first and rows with equal ids are ordered by their ids' content.  An empty table makes a store
    without shards.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    vocab = Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)
    width = 2 if max(vocab, end_id or 0) < 1 << 16 else 4
    zdict = train_dictionary(docs, tokenizer_path, end_id, width, id_col, text_col)
    digest = hashlib.sha256(zdict).digest()
    filesystem, root = fs.FileSystem.from_uri(path)
    filesystem.create_dir(root, recursive=True)
    with filesystem.open_output_stream(f"{root}/dictionary.zdict") as f:
        f.write(zdict)
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // SHARD_DOCS))
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / shards for i in range(1, shards)] or [0.5], 10_000)).first()[0] or []
    cuts = np.array(sorted(set(cuts)), np.int64)

    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def compress(b: pa.RecordBatch) -> pa.RecordBatch:
        c, p, texts = _compressor(zdict), pieces(tokenizer_path), b.column(1)
        out, n = [], []
        _, off = utf8(texts)
        for i, j in steps(off):
            for x in p.encode_batch([t or "" for t in texts.slice(i, j - i).to_pylist()]):
                a = np.frombuffer(x + tail, "<u4")
                n.append(len(a))
                out.append(c.compress(_pack(a, width)))
        ids, null = b.column(0).fill_null(-(2**63)).to_numpy(), b.column(0).is_null()
        at = np.searchsorted(cuts, ids, side="right")
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(ids), null, pa.array(n, pa.int64()), pa.array(out, pa.binary())], names=["shard", "id", "no_id", "n", "frame"])

    schema = "shard int, id long, no_id boolean, n long, frame binary"
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    frames = map_arrow(src, compress, schema)
    slots = _slots(spark, len(cuts) + 1)
    slot = F.get(F.array(*map(F.lit, slots)), F.col("shard"))
    ordered = frames.withColumn("slot", slot).repartition(len(cuts) + 1, "slot").drop("slot").sortWithinPartitions("shard", F.col("no_id").desc(), "id", "n", "frame")

    def write(batches):
        filesystem, root = fs.FileSystem.from_uri(path)
        state: dict = {}

        def close():
            f, index = state["f"], state["index"]
            n = len(index) // 4
            f.write(np.frombuffer(index, np.int64).astype("<i8").tobytes())
            f.write(struct.pack("<4q", state["at"], n, width, state["null"]))
            f.close()
            final = f"{root}/shard-{state['shard']:08d}.tok"
            filesystem.move(state["tmp"], final)
            return {"shard": state["shard"], "path": final, "n_docs": n, "n_tokens": state["tokens"]}

        done = []
        for b in batches:
            for shard, i, no_id, n, frame in zip(*(b.column(k).to_pylist() for k in range(5))):
                if state.get("shard") != shard:
                    if state:
                        done.append(close())
                    tmp = f"{root}/.{uuid.uuid4().hex}.part"
                    f = filesystem.open_output_stream(tmp)
                    f.write(MAGIC + digest)
                    state = {"shard": shard, "tmp": tmp, "f": f, "index": array("q"), "at": len(MAGIC) + 32, "tokens": 0, "null": 0}
                state["index"].extend((i, state["tokens"], state["at"], n))
                state["f"].write(frame)
                state["at"] += len(frame)
                state["tokens"] += n
                state["null"] += no_id
        if state:
            done.append(close())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = sorted(ordered.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long").collect())
    first, out = 0, []
    for r in rows:
        out.append((r["shard"], r["path"], r["n_docs"], r["n_tokens"], first))
        first += r["n_tokens"]
    schema = "shard int, path string, n_docs long, n_tokens long, first long"
    table = spark.createDataFrame(pd.DataFrame(out, columns=["shard", "path", "n_docs", "n_tokens", "first"]), schema) if out else spark.createDataFrame([], schema)
    table._store = path
    return table


def read_document(path: str, shard: str, doc_id: int) -> list[np.ndarray]:
    """The id arrays of one document id in a shard, by its index; only its own frames are read."""
    filesystem, root = fs.FileSystem.from_uri(path)
    with filesystem.open_input_file(f"{root}/dictionary.zdict") as f:
        zdict = f.read()
    with filesystem.open_input_file(shard) as f:
        index, width, end, _ = _index(f, zdict)
        hits = np.flatnonzero(index[:, 0] == doc_id)
        return [_frame(f, zdict, index, k, width, end) for k in hits]


def _index(f, zdict: bytes):
    size = f.size()
    f.seek(0)
    if f.read(len(MAGIC)) != MAGIC or f.read(32) != hashlib.sha256(zdict).digest():
        raise ValueError("not a token shard of this dictionary")
    f.seek(size - 32)
    at, n, width, null = struct.unpack("<4q", f.read(32))
    f.seek(at)
    return np.frombuffer(f.read(n * 32), "<i8").reshape(n, 4), width, at, null


def _frame(f, zdict: bytes, index: np.ndarray, k: int, width: int, end: int) -> np.ndarray:
    a = index[k, 2]
    b = index[k + 1, 2] if k + 1 < len(index) else end
    f.seek(int(a))
    return _unpack(zstandard.ZstdDecompressor(dict_data=_dictionary(zdict)).decompress(f.read(int(b - a))), width)


def read_store(shards: DataFrame, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files."""

    def read(batches):
        filesystem, root = fs.FileSystem.from_uri(path)
        with filesystem.open_input_file(f"{root}/dictionary.zdict") as f:
            zdict = f.read()
        z = zstandard.ZstdDecompressor(dict_data=_dictionary(zdict))
        for b in batches:
            for shard, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with filesystem.open_input_file(shard) as f:
                    index, width, end, null = _index(f, zdict)
                    ends = np.append(index[1:, 2], end)
                    f.seek(len(MAGIC) + 32)
                    crc = np.empty(len(index), np.int64)
                    for k in range(len(index)):
                        ids = _unpack(z.decompress(f.read(int(ends[k] - index[k, 2]))), width)
                        if len(ids) != index[k, 3]:
                            raise ValueError("the index does not fit the frames")
                        crc[k] = zlib.crc32(ids.astype("<u4").tobytes())
                for i in range(0, len(index), 50_000):
                    x = index[i : i + 50_000]
                    mask = np.arange(i, i + len(x)) < null
                    yield pa.RecordBatch.from_arrays([pa.array(x[:, 0], mask=mask), pa.array(x[:, 1] + first), pa.array(x[:, 3].copy()), pa.array(crc[i : i + len(x)])], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, shards.count())
    return shards.select("path", "first").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
