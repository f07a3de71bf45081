"""A corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read again as the next stage's
``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandlink.llm import bpe, decontaminate, ngram_join, quality, suffix_dedup
from strandlink.llm.common import may_be_among, read_table
from strandlink.plans.shipping import ship
from strandlink.plans.stages import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.7 or more).

    Every row is judged by its own text: repeated rows go or stay together, a null or empty text has the score of the
    bias alone, and a null id teaches nothing.  Columns besides those of documents are dropped, here and below.
    """
    ship(spark)
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model).select(COLUMNS)


def keep_first_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of each group of near duplicates (Jaccard of 0.8 or more on 5-word shingles).

    Documents without words and rows with a null id stay; repeated rows of the id that stays stay as they are.
    """
    ship(spark)
    groups = ngram_join.near_duplicates(docs, percent=80, k=5)
    gone = materialize(groups.filter("component_id <> doc_id").select("doc_id").distinct(), "gone")
    # texts whose id is in no way among those that go stay where they are; the others are shuffled for the exact join
    may = may_be_among(gone, "doc_id")
    stay, asked = docs.filter(~may), docs.filter(may)
    return stay.union(asked.join(gone, "doc_id", "left_anti").select(docs.columns)).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document's 50-byte strings cover; characters cut in half go whole.

    A text of which nothing is left stays as an empty document, a null text stays null.  Rows with a null id keep their
    text; repeated rows of one id are cut alike, and not because of each other.
    """
    ship(spark)
    return suffix_dedup.cut_documents(docs, width=50).select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that resembles a benchmark item (0.8 or more).

    Every row is judged by its own text, whatever its id; null and empty texts stay, and so does everything where the
    benchmark is empty.
    """
    ship(spark)
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"), percent=80).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each text; a null text counts as empty, and every row has its own."""
    ship(spark)
    return bpe.digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_first_near),
    ("repeats", cut_repeats),
    ("decontamination", drop_leaks),
    ("tokens", tokens),
]

#: The stages are not expressible in SQL.  Tests hold the kept ids and texts of near_duplicates, repeats and
#: decontamination against brute force, tokens against the library, and quality against planted classes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


__all__ = ["STAGES", "ORACLE_SQL", "run"]
