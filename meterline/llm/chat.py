"""Chat formatting of logged conversations, in SQL functions only.

Logs often hold a conversation again and again as it grows.  A turn's hash is
salted with its place; the xor of the first i hashes identifies the first i
turns (two independent 64-bit hashes).  A conversation whose full hash is a
proper prefix hash of another is a snapshot of it and is left out by an
anti-join; of equal conversations the one with the smallest id stays.  What
remains is rendered.

The turns are dealt in ranges of their order over all conversations, equal
rows by a row id; a turn's place is counted within its range and offset by the
conversation's sizes in earlier ranges.  So a conversation that holds a third
of all rows is many window groups, not one, also if its turn numbers repeat or
are null.  It is rendered in parts of ``CHUNK`` turn numbers, or of ``CHUNK``
places when more than ``CHUNK`` turns share one such part.

Defined cases: turns are ordered by number, then role and text, nulls first; a
null role or text counts as empty text; rows without conv_id form the one
conversation with null id; repeated rows are turns of their own; an empty
table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterline.llm.common import stored

CHUNK = 1024


def _places(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, h, g, ...) with chunk and place, which counts a
    conversation's turns from 1; a chunk is a range of all rows."""
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "turns")
    dealt = stored(rows.repartitionByRange(F.col("conv"), F.col("turn"), F.col("h"), F.col("g"), F.col("row"))
                   .withColumn("chunk", F.spark_partition_id().cast("long")), "turn-ranges")
    order = Window.partitionBy("conv", "chunk").orderBy(F.col("turn").asc_nulls_first(), "h", "g", "row")
    local = dealt.withColumn("at", F.row_number().over(order))
    ahead = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))
    sizes = dealt.groupBy("conv", "chunk").agg(F.count("*").alias("n"))
    offsets = sizes.select(F.col("conv").alias("c"), F.col("chunk").alias("k"),
                           F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long")).alias("offset"))
    return local.join(offsets, same).withColumn("place", F.col("at") + F.col("offset")).drop("c", "k", "at", "offset", "row")


def turn_prefixes(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv, chunk, place, p, q): place counts from 1; p and q identify the first
    ``place`` turns.  Texts are hashed at the scan and not shuffled."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(
        F.col(f"`{id_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.xxhash64(role, F.lit("\1"), text).alias("h"), F.xxhash64(F.lit("\2"), text, role).alias("g"))
    ahead = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))
    placed = _places(rows).select("conv", "chunk", "place", F.xxhash64("h", "place").alias("h"), F.xxhash64("g", "place").alias("g"))
    placed = stored(placed, "turn-places")
    totals = placed.groupBy("conv", "chunk").agg(F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"))
    zero = F.lit(0).cast("long")
    carry = totals.select(F.col("conv").alias("c"), F.col("chunk").alias("k"),
                          F.coalesce(F.bit_xor("h").over(ahead), zero).alias("ch"),
                          F.coalesce(F.bit_xor("g").over(ahead), zero).alias("cg"))
    upto = Window.partitionBy("conv", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.select("conv", "chunk", "place", F.bit_xor("h").over(upto).alias("h"), F.bit_xor("g").over(upto).alias("g"))
    return run.join(carry, same).select(
        "conv", "chunk", "place", F.col("h").bitwiseXOR(F.col("ch")).alias("p"), F.col("g").bitwiseXOR(F.col("cg")).alias("q"))


def snapshots(conversations: DataFrame, **columns) -> DataFrame:
    """One row per conversation: conv, n_turns, p, q, ``kept_by`` (itself when it is
    maximal and the smallest of its equals; the smallest equal when it repeats
    one; null when it is a proper prefix of a longer one)."""
    pre = stored(turn_prefixes(conversations, **columns), "turn-prefixes")
    last = pre.groupBy("conv").agg(F.max(F.struct("place", "p", "q")).alias("l")) \
        .select("conv", F.col("l.place").alias("n_turns"), "l.p", "l.q")
    whole = stored(last, "conversations")
    # a hash of i turns that occurs in a conversation of more turns
    inner = pre.join(whole.select(F.col("conv").alias("c"), "n_turns"), F.col("conv").eqNullSafe(F.col("c"))) \
        .where(F.col("place") < F.col("n_turns")).select(F.col("place").alias("n_turns"), "p", "q").distinct()
    distinct = whole.groupBy("n_turns", "p", "q").agg(F.min("conv").alias("first"))
    maximal = distinct.join(inner, ["n_turns", "p", "q"], "left_anti").withColumn("top", F.lit(True))
    maximal = stored(maximal, "conversations-maximal")
    return whole.join(maximal, ["n_turns", "p", "q"], "left").select(
        "conv", "n_turns", "p", "q", F.coalesce("top", F.lit(False)).alias("maximal"), "first")


def render_turn(role: Column, text: Column) -> Column:
    """Marked-up form of a turn; marks inside a text are split so that they
    cannot end it."""
    clean = F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), clean, F.lit("<|im_end|>\n"))


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv_id, part, n_turns, text) of the maximal conversations; the parts of a
    conversation, in order, make its whole text."""
    snap = snapshots(conversations, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    keep = stored(snap.where(F.col("maximal") & F.col("conv").eqNullSafe(F.col("first"))).select("conv"), "conversations-kept")
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    number = F.coalesce(F.floor(F.col(f"`{turn_col}`") / CHUNK), F.lit(-1)).cast("long")
    crowded = conversations.groupBy(F.col(f"`{id_col}`").alias("conv"), number.alias("part")).agg(F.count("*").alias("n")) \
        .where(F.col("n") > CHUNK).select("conv").distinct()
    crowded = stored(keep.alias("k").join(crowded.alias("c"), F.col("k.conv").eqNullSafe(F.col("c.conv")), "left_semi"),
                     "conversations-crowded")
    usual = stored(keep.alias("k").join(crowded.alias("c"), F.col("k.conv").eqNullSafe(F.col("c.conv")), "left_anti"),
                   "conversations-usual")
    turns = conversations.select(
        F.col(f"`{id_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), number.alias("part"),
        F.xxhash64(role, F.lit("\1"), text).alias("h"), F.xxhash64(F.lit("\2"), text, role).alias("g"),
        render_turn(F.col(f"`{role_col}`"), F.col(f"`{text_col}`")).alias("out")).alias("t")
    of = lambda ids: turns.join(ids.alias("k"), F.col("t.conv").eqNullSafe(F.col("k.conv")), "left_semi")
    ranked = _places(of(crowded)).withColumn("part", F.floor((F.col("place") - 1) / CHUNK).cast("long"))
    kept = of(usual).unionByName(ranked.select("conv", "turn", "part", "h", "g", "out"))
    # nulls sort first in structs too
    return kept.groupBy("conv", "part").agg(
        F.sort_array(F.collect_list(F.struct("turn", "h", "g", "out"))).alias("o")) \
        .select(F.col("conv").alias(id_col), "part", F.size("o").alias("n_turns"), F.array_join("o.out", "").alias("text"))
