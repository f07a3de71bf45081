"""Conversations from quoting messages, in reply order and without quotes; DataFrame operations only.

A line's quote level is its number of leading ">" marks.  Neighbouring lines of one level form a passage.  Passages
are normalised (lower case, white space to single spaces) and hashed.  A message's own lines, each alone and all
together, are what others can quote; for each conversation and hash the earliest turn is kept, so that a passage
that many messages repeat stays one row and quotes join it many to one.

A message replies to the earlier message that its quotes point to: the least quote level counts first, then a whole
passage before a single line, then the longest, then the earliest turn.  A message without such a quote starts a
thread.  Threads come from pointer jumping, so neither a long chain nor a large conversation meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlink.plans.stages import drop, materialize

#: A line that announces a quote; fixed values of mail programs' phrases.
ATTRIBUTION = r"(?i)^\s*(on\b.*\bwrote|le\b.*\ba écrit|am\b.*\bschrieb.*|el\b.*\bescribió|.*\bwrites)\s*:\s*$"
_QUOTE = r"^[ \t]*((?:>[ \t]?)+)"


def _norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def quote_passages(text: Column) -> Column:
    """Array of ``(level, body)``: runs of lines with one quote level; level 0 is the message's own text."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r", -1)
    parsed = F.transform(
        lines,
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, _QUOTE, 1), "[^>]", "")).alias("level"),
            F.regexp_replace(x, _QUOTE, "").alias("body"),
        ),
    )
    return parsed


def _split(messages: DataFrame) -> DataFrame:
    """Adds ``lines``: parsed lines without those that announce a quote, and ``starts``: where passages begin."""
    parsed = messages.withColumn("_all", quote_passages(F.col("text")))
    quiet = F.filter(
        "_all",
        lambda x, i: ~(
            (x["level"] == 0) & x["body"].rlike(ATTRIBUTION) & (F.coalesce(F.try_element_at("_all", i + 2)["level"], F.lit(0)) > 0)
        ),
    )
    out = parsed.withColumn("lines", quiet).drop("_all")
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size("lines") - 1, F.lit(0))),
        lambda i: (i == 0) | (F.get("lines", i)["level"] != F.get("lines", i - 1)["level"]),
    )
    return out.withColumn("starts", starts)


def _passages() -> Column:
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array(F.size("lines")))
    pairs = F.arrays_zip(F.col("starts").alias("s"), ends.alias("e"))
    return F.transform(
        pairs,
        lambda p: F.struct(
            F.get("lines", p["s"])["level"].alias("level"),
            F.slice("lines", p["s"] + 1, F.greatest(p["e"] - p["s"], F.lit(0))).alias("lines"),
        ),
    )


def _keys(lines: Column) -> Column:
    """``(kind, n, hash)`` of the lines together (kind 0) and of each line (kind 1), without empty ones."""
    bodies = F.transform(lines, lambda x: _norm(x["body"]))
    whole = _norm(F.array_join(bodies, " "))
    each = F.transform(bodies, lambda t: F.struct(F.lit(1).alias("kind"), F.length(t).alias("n"), F.sha2(t, 256).alias("hash")))
    both = F.concat(F.array(F.struct(F.lit(0).alias("kind"), F.length(whole).alias("n"), F.sha2(whole, 256).alias("hash"))), each)
    return F.filter(both, lambda x: x["n"] > 0)


def link_quotes(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, n_quotes, parent_turn, root_turn, depth)`` for every row, in reply order:
    ordered by conversation, thread (its first turn) and turn, so that a reply follows what it answers.

    ``text`` is the message without quotes and the lines that announce them; null stays null.  ``n_quotes`` counts
    quoted passages.  ``parent_turn`` is null where no earlier message of the conversation is quoted.  Rows that
    repeat a turn share its links; rows with a null conversation or turn link with nothing and are their own
    thread (``root_turn`` = turn, depth 0).
    """
    src = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    cut = _split(src).withColumn("passages", _passages())
    own = F.filter("lines", lambda x: x["level"] == 0)
    rows = materialize(
        cut.select(
            "conv_id",
            "turn",
            "role",
            F.when(F.col("text").isNotNull(), F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^\n+|\n+$", "")).alias("text"),
            F.size(F.filter("passages", lambda p: p["level"] > 0)).alias("n_quotes"),
            _keys(own).alias("own_keys"),
            F.transform(F.filter("passages", lambda p: p["level"] > 0), lambda p: F.struct(p["level"].alias("level"), _keys(p["lines"]).alias("keys"))).alias("quotes"),
        ),
        "messages",
    )
    placed = rows.filter("conv_id is not null and turn is not null")
    quotes = (
        placed.filter("n_quotes > 0")
        .select("conv_id", "turn", F.explode("quotes").alias("q"))
        .select("conv_id", "turn", F.col("q.level").alias("level"), F.explode("q.keys").alias("k"))
        .select("conv_id", "turn", "level", F.col("k.kind").alias("kind"), F.col("k.n").alias("n"), F.col("k.hash").alias("hash"))
        .distinct()
    )
    # a whole passage can also be a single line of the original, so kinds are not part of the key
    originals = (
        placed.select("conv_id", "turn", F.explode("own_keys").alias("k"))
        .groupBy("conv_id", F.col("k.hash").alias("hash"))
        .agg(F.min("turn").alias("origin"))
    )
    best = (
        quotes.join(originals, ["conv_id", "hash"])
        .filter("origin < turn")
        .groupBy("conv_id", "turn")
        .agg(F.min(F.struct("level", "kind", (-F.col("n")).alias("n"), "origin")).alias("best"))
    )
    links = materialize(best.select("conv_id", "turn", F.col("best.origin").alias("parent")), "links")
    # pointer jumping: up is an ancestor at distance dist, and a thread's start once nothing points on
    state = materialize(links.select("conv_id", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("dist")), "threads")
    while True:
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("dist").alias("more"))
        nxt = materialize(
            state.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("next").isNotNull().alias("moved")),
            "threads",
        )
        moved = not nxt.filter("moved").isEmpty()
        drop(state)
        state = nxt.drop("moved")
        state._stage_path = nxt._stage_path
        if not moved:
            break
    out = (
        rows.join(links, ["conv_id", "turn"], "left")
        .join(state.select("conv_id", "turn", F.col("up").alias("root"), "dist"), ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            "role",
            "text",
            F.col("n_quotes").cast("long").alias("n_quotes"),
            F.col("parent").alias("parent_turn"),
            F.coalesce("root", "turn").alias("root_turn"),
            F.coalesce("dist", F.lit(0)).cast("long").alias("depth"),
        )
    )
    return out.orderBy("conv_id", "root_turn", "turn", "role", "text")
