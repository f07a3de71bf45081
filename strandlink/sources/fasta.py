"""FASTA records as a DataFrame ``sequences(seq_no, header, abundance, seq, seq_len)``, and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlink.config import ClusterConfig
from strandlink.plans.stages import materialize

SCHEMA = T.StructType(
    [
        T.StructField("seq_no", T.LongType()),
        T.StructField("header", T.StringType()),
        T.StructField("abundance", T.LongType()),
        T.StructField("seq", T.StringType()),
        T.StructField("seq_len", T.IntegerType()),
    ]
)


class InvalidInput(ValueError):
    """Input that breaks a rule of the format."""


def abundance(header: Column) -> Column:
    """The number after the last underscore at the very end of a header; 0 where there is none."""
    digits = F.regexp_extract(header, r"_([0-9]+)\z", 1)
    return F.coalesce(F.when(digits != "", digits.try_cast("bigint")), F.lit(0)).cast("bigint")


def normalise(seq: Column) -> Column:
    """Lower case with u as t."""
    return F.translate(F.lower(seq), "u", "t")


def encode(seq: Column) -> Column:
    """Symbols as digits: a 1, c 2, g 3, t and u 4, in any case."""
    return F.translate(F.lower(seq), "acgtu", "12344")


def decode(codes: Column) -> Column:
    """The inverse of :func:`encode`; u comes back as t."""
    return F.translate(codes, "1234", "acgt")


def _numbered_records(spark: SparkSession, path: str) -> DataFrame:
    """``(seq_no, first, value)``: records in file order (files by path), ``first`` marking the first of a file.

    Spark reads a block of a file in order, within one partition.  Blocks are counted, and each block's offset (a row
    for each block) is joined back, so that no task holds more than a block.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    tagged = materialize(
        raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")), "records"
    )
    blocks, total = [], 0
    for r in sorted(tagged.groupBy("file", "block").agg(F.min("at").alias("begin"), F.count("*").alias("n")).collect()):
        blocks.append((r["file"], r["block"], r["begin"], total))
        total += r["n"]
    table = spark.createDataFrame(blocks, "file string, block long, begin long, before long")
    return tagged.join(table, ["file", "block"]).select(
        (F.col("before") + F.col("at") - F.col("begin")).alias("seq_no"), ((F.col("block") == 0) & (F.col("at") == F.col("begin"))).alias("first"), "value"
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of a FASTA file or folder, numbered in file order from 0.

    A record is a line that starts with ">" and the lines up to the next such line.  The header ends at the first
    space or line feed.  Symbols are a, c, g, t and u in either case; line feeds inside a sequence are skipped and
    anything else, a carriage return included, raises :class:`InvalidInput` with the character and its line, as does
    a file whose first line has no ">".  Sequences may be empty, and so may the file.
    """
    records = _numbered_records(spark, path)
    if not records.filter("first and not startswith(value, '>')").isEmpty():
        raise InvalidInput("the file does not begin with a record: its first line has no '>'")
    return parse_records(records.select("seq_no", F.when(F.col("first"), F.expr("substring(value, 2)")).otherwise(F.col("value")).alias("record")))


def write_fasta(sequences: DataFrame, path: str, ordered: bool = True) -> None:
    """Write records in ``seq_no`` order; part files in name order are the file."""
    rows = sequences.orderBy("seq_no") if ordered else sequences
    rows.select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("seq"))).write.text(path)


def parse_records(records: DataFrame) -> DataFrame:
    """Sequences from ``(seq_no, record)``, records being text after their ">"; checks the alphabet."""
    header_line = F.regexp_extract("record", r"\A([^\n]*)", 1)
    body = F.expr("substring(record, length(regexp_extract(record, '\\\\A([^\\n]*)', 1)) + 1)")
    seq = F.regexp_replace(body, "\n", "")
    out = records.select("seq_no", F.regexp_extract(header_line, r"\A([^ ]*)", 1).alias("header"), seq.alias("raw"), body.alias("body"))
    bad = out.filter(F.col("raw").rlike("[^acgtuACGTU]")).select("seq_no", "header", "body").orderBy("seq_no").limit(1).collect()
    if bad:
        # only now: the lines of the records before it, of all files by path
        before = records.filter(F.col("seq_no") < bad[0]["seq_no"]).agg(F.sum(F.length("record") - F.length(F.replace("record", F.lit("\n"))) + 1)).first()[0] or 0
        row, found = next((i, c) for i, x in enumerate(bad[0]["body"].split("\n")) for c in x if c not in "acgtuACGTU")
        raise InvalidInput(f"line {before + row + 1}: {found!r} in the sequence of '{bad[0]['header']}' is not one of acgtu")
    return out.select("seq_no", "header", abundance(F.col("header")).alias("abundance"), normalise(F.col("raw")).alias("seq"), F.length("raw").alias("seq_len"))


def from_table(df: DataFrame, id_col: str, seq_col: str, header_col: str | None = None) -> DataFrame:
    """Sequences from a table that has a numeric key and a sequence column (null: empty)."""
    header = F.col(header_col) if header_col else F.concat(F.col(id_col).cast("string"), F.lit("_1"))
    seq = normalise(F.coalesce(F.col(seq_col), F.lit("")))
    return df.select(F.col(id_col).cast("bigint").alias("seq_no"), header.alias("header"), abundance(header).alias("abundance"), seq.alias("seq"), F.length(seq).alias("seq_len"))


def missing_abundance(sequences: DataFrame) -> DataFrame:
    """One row: the number of sequences without an abundance of 1 or more."""
    return sequences.agg(F.count_if(F.col("abundance") < 1).alias("missing"))


def out_of_order(sequences: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows whose abundance exceeds that of the row before them (by ``seq_no``); a row before with an abundance
    below 1 is not compared.

    The neighbour is found by an equi-join on ``seq_no``, so no task sorts the whole table.
    """
    before = sequences.select((F.col("seq_no") + 1).alias("seq_no"), F.col("abundance").alias("previous"))
    return sequences.join(before, "seq_no").filter("previous >= 1 and abundance > previous").select("seq_no", "header", "previous", "abundance")


def duplicate_headers(sequences: DataFrame) -> DataFrame:
    return sequences.groupBy("header").agg(F.count("*").alias("n")).filter("n > 1")


def db_info(sequences: DataFrame) -> DataFrame:
    """One row: number of sequences, of nucleotides, and the longest sequence (0 where there are none)."""
    return sequences.agg(F.count("*").alias("sequences"), F.coalesce(F.sum("seq_len"), F.lit(0)).alias("nucleotides"), F.coalesce(F.max("seq_len"), F.lit(0)).alias("longest"))


def validation_counts(sequences: DataFrame) -> DataFrame:
    """One row with what :func:`validate` decides by: ``sequences``, ``missing`` (without an abundance), ``disordered``
    (more abundant than the row before), ``repeated`` (headers of more than one row), and the least repeated header with its
    rows.

    One pass and one shuffle: each row sends its abundance under its own number and, as the one before, under the next, and
    a count under its header; keys of both kinds are aggregated together, before the shuffle where they can be.
    """
    sent = sequences.selectExpr("stack(3, cast(null as string), seq_no, abundance, cast(null as bigint), null, seq_no + 1, null, abundance, header, null, null, null) as (header, row, own, previous)")
    keys = sent.groupBy("header", "row").agg(F.max("own").alias("own"), F.max("previous").alias("previous"), F.count("*").alias("n"))
    twice = F.col("header").isNotNull() & (F.col("n") > 1)
    first = F.min(F.when(twice, F.struct("header", "n")))
    return keys.agg(
        F.count("own").alias("sequences"),
        F.count_if(F.col("own") < 1).alias("missing"),
        F.count_if((F.col("previous") >= 1) & (F.col("own") > F.col("previous"))).alias("disordered"),
        F.count_if(twice).alias("repeated"),
        first.alias("first"),
    ).select("sequences", "missing", "disordered", "repeated", F.col("first.header").alias("header"), F.col("first.n").alias("times"))


def validate(sequences: DataFrame, config: ClusterConfig | None = None) -> DataFrame:
    """Check abundance, order and headers, in this order, by one job; returns the frame or raises
    :class:`InvalidInput`."""
    found = validation_counts(sequences).first()
    if found["missing"]:
        raise InvalidInput(f"{found['missing']} sequences have no abundance of 1 or more at the end of their header")
    if found["disordered"]:
        raise InvalidInput("a sequence is more abundant than the one before it")
    if found["repeated"] and (config or ClusterConfig()).on_duplicate == "error":
        raise InvalidInput(f"the header '{found['header']}' names {found['times']} sequences")
    return sequences


def sort_by_abundance(sequences: DataFrame) -> DataFrame:
    """Decreasing abundance, then input position."""
    return sequences.orderBy(F.desc("abundance"), "seq_no")


