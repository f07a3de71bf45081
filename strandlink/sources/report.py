"""The text report of a clustering, as files that Spark writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlink.operators.cluster import totals


def report_lines(clustered: DataFrame, sequences: DataFrame, total: bool = True, ordered: bool = True) -> DataFrame:
    """``value``: the lines of the report: for each cluster an empty line and its members' headers, then two empty
    lines and the totals.

    Clusters are ordered by their first member, members by position.  With ``ordered`` off, only each cluster's lines
    stand together (no range shuffle of all rows), clusters come in any order, and the totals are in the last file.
    """
    rows = clustered.join(sequences.select("seq_no", "header"), "seq_no").select("cluster_id", "seq_no", F.col("header").alias("value"))
    gaps = clustered.select("cluster_id").distinct().select("cluster_id", F.lit(-1).cast("bigint").alias("seq_no"), F.lit("").alias("value"))
    out = rows.union(gaps)
    if not ordered:
        out = out.repartition("cluster_id").sortWithinPartitions("cluster_id", "seq_no").select("value")
        tail = totals(clustered).select(F.explode(F.array(F.lit(""), F.lit(""), _total())).alias("value"))
        return out.union(tail) if total else out
    if total:
        count = totals(clustered)
        tail = count.select(F.posexplode(F.array(F.lit(""), F.lit(""), _total())).alias("seq_no", "value"))
        out = out.union(tail.select(F.lit(2**63 - 1).alias("cluster_id"), F.col("seq_no").cast("bigint"), "value"))
    return out.orderBy("cluster_id", "seq_no").select("value")


def _total() -> F.Column:
    return F.format_string("Total: %d clusters of %d sequences", "clusters", "sequences")


def write_report(clustered: DataFrame, sequences: DataFrame, path: str, total: bool = True, ordered: bool = True) -> None:
    """Write the report below ``path``; its part files in name order are the text."""
    report_lines(clustered, sequences, total, ordered).write.mode("overwrite").text(path)


def write_statistics(statistics: DataFrame, path: str) -> None:
    """Write the work counters of a run as JSON lines below ``path``."""
    statistics.write.mode("overwrite").json(path)
