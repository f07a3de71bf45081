"""The engine's functions under names that SQL can use."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from strandlink.config import ClusterConfig
from strandlink.operators.align import align_diff_udf


def segment_bounds(size: int, n: int) -> list[tuple[int, int]]:
    """Begin and end of ``n`` segments of a sequence of ``size`` symbols, the longer ones last."""
    out, at = [], 0
    for k in range(n):
        end = at + size // n + (k >= n - size % n)
        out.append((at, end))
        at = end
    return out


def lookup_keys(seq: str, d: int) -> tuple[set[str], set[str]]:
    """Keys that a sequence is filed under, and keys under which others within ``d`` edits are filed."""
    size = len(seq)
    filed, asked = set(), set()
    if size > d:
        filed |= {f"{size}:{k}:{seq[a:b]}" for k, (a, b) in enumerate(segment_bounds(size, d + 1))}
        for other in range(max(size - d, d + 1), size + 1):
            delta = size - other
            for k, (a, b) in enumerate(segment_bounds(other, d + 1)):
                first, last = max(0, a - k, a + delta - (d - k)), min(size - (b - a), a + k, a + delta + (d - k))
                asked |= {f"{other}:{k}:{seq[at : at + b - a]}" for at in range(first, last + 1)}
    else:
        asked |= {str(other) for other in range(size, size + d + 1)}
    if size <= 2 * d:
        filed.add(str(size))
    return filed, asked


@udtf(returnType="key string, filed boolean")
class Neighbours:
    """``neighbours(seq, d)``: rows ``(key, filed)``.  Two sequences within ``d`` edits have a key in common that one of them is
    filed under (``filed``) and the other asks for (``not filed``).  Rows are short and few; Spark allows no Arrow table
    function in a lateral join, which is where this one stands."""

    def eval(self, seq: str, d: int) -> Iterator[tuple[str, bool]]:
        filed, asked = lookup_keys(seq or "", d)
        for key in sorted(filed):
            yield key, True
        for key in sorted(asked):
            yield key, False


def register(spark: SparkSession, config: ClusterConfig | None = None) -> None:
    """Make ``align_diff(query, target)`` and the table function ``neighbours(seq, d)`` known to ``spark.sql``, and
    ``align_within(query, target)`` for pairs known to be within the resolution's number of edits, which takes a band."""
    spark.udf.register("align_diff", align_diff_udf(config))
    spark.udf.register("align_within", align_diff_udf(config, within=True))
    spark.udtf.register("neighbours", Neighbours)
