"""FASTA as a Spark data source: ``spark.read.format("fasta")`` and ``df.write.format("fasta")``."""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from strandlink.plans.ranks import ranked
from strandlink.sources.fasta import InvalidInput

SCHEMA = "path string, offset bigint, header string, abundance bigint, seq string, seq_len int"
#: Bytes of a file that one task reads, unless the option ``splitBytes`` says otherwise, and bytes read at once.
SPLIT, READ = 64 << 20, 1 << 20
#: Records in an Arrow batch, and about the bytes that it holds at most.
BATCH, BATCH_BYTES = 4096, 16 << 20

_BAD = re.compile(rb"[^acgtuACGTU]")
_ABUNDANCE = re.compile(rb"_([0-9]+)\Z")
_NORMAL = bytes.maketrans(b"ACGTUu", b"acgttt")


def records(f, begin: int, end: int, size: int = READ) -> Iterator[tuple[int, bytes]]:
    """Records whose ">" lies in ``[begin, end)`` of an open file, with its offset: their text after it.

    A record starts at the file's begin or after a line feed, and goes on over the range's end.
    """
    at = max(begin - 1, 0)
    f.seek(at)
    held, start, look = b"", 0 if begin == 0 else None, 0
    while True:
        more = f.read(size)
        held += more
        while (i := held.find(b"\n>", look)) >= 0 or (not more and start is not None):
            if start is not None:
                yield start, held[start - at + 1 : i if i >= 0 else len(held)]
            if i < 0 or at + i + 1 >= end:
                return
            start, look = at + i + 1, i + 1
        if not more or start is None and at + len(held) > end:
            return
        # what is done goes; a sign that was cut in half is looked at again
        done = (start - at) if start is not None else max(len(held) - 1, 0)
        held, at = held[done:], at + done
        look = max(len(held) - 1, 0)


def parse(path: str, offset: int, record: bytes, line_of) -> tuple:
    """One row of :data:`SCHEMA`; ``line_of`` tells the line of an offset, for errors."""
    line, _, body = record.partition(b"\n")
    header = line.split(b" ", 1)[0]
    raw = body.replace(b"\n", b"")
    if _BAD.search(raw):
        at = _BAD.search(body.replace(b"\n", b"a")).start()
        where = line_of(offset) + 1 + body[:at].count(b"\n")
        raise InvalidInput(f"{path}, line {where}: {body[at : at + 1].decode('latin-1')!r} in the sequence of '{header.decode('utf-8', 'replace')}' is not one of acgtu")
    found = _ABUNDANCE.search(header)
    count = int(found[1]) if found else 0
    return path, offset, header.decode("utf-8", "replace"), count if count < 1 << 63 else 0, raw.translate(_NORMAL).decode(), len(raw)


@dataclass
class Split(InputPartition):
    path: str
    begin: int
    end: int


class FastaReader(DataSourceReader):
    """Files of a path in byte ranges; hidden files and folders of writers are passed over."""

    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT))

    def partitions(self) -> list[Split]:
        store, path = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((x.path, x.size) for x in files if x.is_file and not any(p[0] in "_." for p in posixpath.relpath(x.path, path).split("/") if p != "."))
        return [Split(name, at, min(at + self.split, size)) for name, size in files for at in range(0, size, self.split)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("header", pa.string()), ("abundance", pa.int64()), ("seq", pa.string()), ("seq_len", pa.int32())])

        def line_of(offset: int) -> int:
            with store.open_input_stream(split.path) as g:
                lines, left = 1, offset
                while left and (part := g.read(min(left, READ))):
                    lines, left = lines + part.count(b"\n"), left - len(part)
            return lines

        with store.open_input_file(split.path) as f:
            if split.begin == 0 and f.read(1) != b">":
                raise InvalidInput(f"{split.path} does not begin with a record: its first line has no '>'")
            rows, held = [], 0
            for offset, record in records(f, split.begin, split.end):
                rows.append(parse(split.path, offset, record, line_of))
                held += len(record)
                if len(rows) == BATCH or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    part: int
    path: str
    rows: int


class FastaWriter(DataSourceArrowWriter):
    """Tasks write files of their own beside the target; committing moves those of successful tasks into it, by partition."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex

    def _store(self):
        store, path = fs.FileSystem.from_uri(self.path)
        return store, path.rstrip("/"), f"{path.rstrip('/')}/_{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _, room = self._store()
        task = TaskContext.get()
        store.create_dir(room, recursive=True)
        name, n = f"{room}/{task.partitionId():06d}-{task.taskAttemptId()}", 0
        with store.open_output_stream(name) as out:
            for b in iterator:
                header, seq = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("header", "seq"))
                out.write("".join(f">{h or ''}\n{s or ''}\n" for h, s in zip(header, seq)).encode())
                n += b.num_rows
        return Written(task.partitionId(), name, n)

    def commit(self, messages: list[Written]) -> None:
        store, path, room = self._store()
        store.create_dir(path, recursive=True)
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(path)):
                if x.is_file:
                    store.delete_file(x.path)
        for m in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.part):
            store.move(m.path, f"{path}/part-{m.part:06d}-{self.run[:8]}.fasta")
        self._sweep(store, room)

    def abort(self, messages: list[Written]) -> None:
        store, _, room = self._store()
        self._sweep(store, room)

    @staticmethod
    def _sweep(store, room: str) -> None:
        if store.get_file_info(room).type == fs.FileType.Directory:
            store.delete_dir(room)


class FastaDataSource(DataSource):
    """``format("fasta")``: reads :data:`SCHEMA`, writes any frame with ``header`` and ``seq``.

    ``path`` is a file or folder in a store that Arrow reaches; ``splitBytes`` is the most that a task reads.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)

    def writer(self, schema, overwrite: bool) -> FastaWriter:
        missing = {"header", "seq"} - set(schema.names)
        if missing:
            raise ValueError(f"columns {sorted(missing)} are missing")
        return FastaWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaDataSource)


def numbered(rows: DataFrame) -> DataFrame:
    """``(seq_no, header, abundance, seq, seq_len)`` of rows that the data source read, in the order of files and offsets."""
    return ranked(rows.withColumn("all", F.lit("")), "all", ["path", "offset"], "numbered").select(F.col("idx").alias("seq_no"), "header", "abundance", "seq", "seq_len")
