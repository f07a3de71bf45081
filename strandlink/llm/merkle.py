"""Merkle manifest of a dataset: a tree over the rows of each group and one over the groups.

A leaf is a hash of a row's columns.  Leaves of a group are numbered in order, ``fanout ** height`` consecutive ones
make a bucket, and one pass (``applyInPandas``) collapses the ``height`` levels of every bucket to its root, noting for
each node the siblings on its way up.  The bucket roots are the nodes of the next pass, so a tree over n rows takes
log(n) / (height * log(fanout)) passes, each over so many times fewer rows.  A proof is the concatenation of the
siblings below a bucket root and those above it.  The roots of the groups, in order, go through the same passes.

No task holds more than a bucket, whatever a group's size: rows are numbered by ranges, not by a window of the group.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlink.plans.ranks import ranked
from strandlink.plans.stages import materialize

FANOUT = 2
#: Levels that one pass collapses: 1024 leaves a bucket at fanout 2.
HEIGHT = 10


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """A value with its length in UTF-8 bytes, or ``-`` for null: no two lists of values give the same string."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _levels(total: int, fanout: int) -> int:
    n = 0
    while total > 1:
        total, n = -(-total // fanout), n + 1
    return n


def collapse(nodes: list[str], levels: int, fanout: int) -> tuple[str, list[list[str]], list[list[str]]]:
    """The root of consecutive ``nodes`` after ``levels`` levels, and for each node what stands left and right of its
    ancestor in the ancestor's run, level by level."""
    left: list[list[str]] = [[] for _ in nodes]
    right: list[list[str]] = [[] for _ in nodes]
    width, row = 1, nodes
    for _ in range(levels):
        for at in range(len(nodes)):
            i = at // width
            begin = i - i % fanout
            left[at].append("".join(row[begin:i]))
            right[at].append("".join(row[i + 1 : begin + fanout]))
        row = [hashlib.sha256("".join(row[i : i + fanout]).encode()).hexdigest() for i in range(0, len(row), fanout)]
        width *= fanout
    return row[0], left, right


def _climb(nodes: DataFrame, most: int, fanout: int, height: int, carried: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """One pass over ``nodes(key, idx, total, node, *carried)`` and, recursively, those over its bucket roots.

    The first frame has for each node its bucket and the siblings up to the bucket's root, the second for each bucket
    the siblings from there on and the top of its key.
    """
    span = fanout**height

    def reduce(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("idx", ignore_index=True)
        parent, left, right = collapse(held["node"].tolist(), min(height, _levels(int(held["total"][0]), fanout)), fanout)
        return held.assign(parent=parent, lower_left=left, lower_right=right)

    keyed = nodes.select("key", "idx", "total", "node", *carried, F.floor(F.col("idx") / F.lit(span)).alias("bucket"))
    schema = ", ".join(["key string, idx long, total long, node string", *(f"{c} string" for c in carried), "bucket long, parent string, lower_left array<string>, lower_right array<string>"])
    low = materialize(keyed.groupBy("key", "bucket").applyInPandas(reduce, schema), label)
    roots = low.filter(F.col("idx") % span == 0).select("key", F.col("bucket").alias("idx"), F.ceil(F.col("total") / F.lit(span)).alias("total"), F.col("parent").alias("node"))
    none = F.array().cast("array<string>")
    if most <= span:
        return low, roots.select("key", F.col("idx").alias("bucket"), none.alias("left"), none.alias("right"), F.col("node").alias("top"))
    above, beyond = _climb(roots, -(-most // span), fanout, height, [], label)
    return low, _joined(above, beyond).select("key", F.col("idx").alias("bucket"), "left", "right", "top")


def _joined(low: DataFrame, above: DataFrame) -> DataFrame:
    """Lower and upper siblings of each node, one after the other."""
    both = low.join(above, ["key", "bucket"])
    return both.withColumn("left", F.concat("lower_left", "left")).withColumn("right", F.concat("lower_right", "right")).drop("lower_left", "lower_right", "bucket", "parent")


def _most(nodes: DataFrame) -> int:
    return nodes.agg(F.max("total")).first()[0] or 0


def build(rows: DataFrame, fanout: int = FANOUT, height: int = HEIGHT, carried: tuple[str, ...] = ()) -> DataFrame:
    """Trees over ``rows(grp, id, leaf, *carried)``: those columns, ``left``, ``right``, ``subroot`` and ``root``.

    Leaves of a group (``grp`` a string or null) ascend by id, null ids first, equal ids by leaf.  ``left`` and
    ``right`` hold, for each level from the leaf to the root, the hashes beside the leaf's ancestor: a lone node has
    none and is hashed by itself while others remain on its level.  The groups' roots ascend bytewise, null first, and
    make ``root`` likewise; the root of one group alone is its ``subroot``.
    """
    # a string that is never null and sorts like the group
    keyed = rows.select(F.coalesce(F.concat(F.lit("="), F.col("grp")), F.lit("")).alias("key"), "id", F.col("leaf").alias("node"), *carried)
    placed = ranked(keyed, "key", ["id", "node"], "leaves")
    most = _most(placed)
    # ids travel as text: pandas has no null integers
    low, above = _climb(placed.withColumn("id", F.col("id").cast("string")), most, fanout, height, ["id", *carried], "merkle")
    tops = above.filter("bucket = 0").select("key", F.col("top").alias("node"))
    order = ranked(tops.withColumn("all", F.lit("")), "all", ["key"], "groups")
    # groups are the nodes of one tree, and their keys go with them
    last, beyond = _climb(order.select(F.col("all").alias("key"), "idx", "total", "node", F.col("key").alias("grp")), _most(order), fanout, height, ["grp"], "merkle")
    upper = _joined(last, beyond).select(F.col("grp").alias("key"), F.col("left").alias("group_left"), F.col("right").alias("group_right"), F.col("top").alias("root"))
    above = above.join(upper, "key").select("key", "bucket", F.concat("left", "group_left").alias("left"), F.concat("right", "group_right").alias("right"), F.col("top").alias("subroot"), "root")
    return _joined(low, above).select(F.expr("if(key = '', null, substring(key, 2))").alias("grp"), F.col("id").cast("long").alias("id"), F.col("node").alias("leaf"), *carried, "left", "right", "subroot", "root")


def fold(leaf: Column, left: Column, right: Column) -> Column:
    """The root that a leaf and the hashes beside its ancestors give."""
    return F.aggregate(F.arrays_zip(left.alias("l"), right.alias("r")), leaf, lambda node, s: digest(s["l"], node, s["r"]))


def proof_digest(left: Column, right: Column) -> Column:
    """Digest of the siblings' hashes, from the leaf up, on each level left to right."""
    return F.sha2(F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), ""), 256)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), other_leaf: Column | None = None, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """``(id, grp, leaf, other, left, right, subroot, root)`` of every row of ``docs``.

    A leaf covers ``columns`` in their order; nulls differ from empty texts.  Repeated rows are leaves of their own, and
    rows with a null id or group count like others.  Columns that are not named do not matter, and a table without
    rows has a manifest without rows.  ``other`` is a second hash of the row, by default null, that takes no part.
    """
    leaf = digest(*(field(docs[c]) for c in columns))
    other = F.lit(None).cast("string") if other_leaf is None else other_leaf
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[group_col].cast("string").alias("grp"), leaf.alias("leaf"), other.alias("other"))
    return build(rows, fanout, height, ("other",))


def verify(docs: DataFrame, every: int = 7, count_col: str = "n_chars", id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """The manifest of ``docs`` held against rows in which ``every`` divides the crc32 of the id and 1 was added to
    ``count_col``: ``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``.

    A null count stays null, so such a row is as it was; rows with a null id are not tampered with.
    """
    more = (docs[count_col].cast("decimal(38,0)") + 1).cast("string")
    tampered = digest(*(field(more if c == count_col else docs[c]) for c in columns))
    hit = F.crc32(docs[id_col].cast("long").cast("string").cast("binary")) % every == 0
    out = manifest(docs, id_col, group_col, columns, F.when(hit, tampered), fanout, height)
    out = out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("left"), F.col("right")).alias("proof_sha256"), fold(F.coalesce("other", "leaf"), F.col("left"), F.col("right")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
