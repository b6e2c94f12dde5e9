"""Merkle manifest of a dataset with a witness for every row.

Rows of a group (a source) are the leaves of a tree in key order; while several
nodes remain, every ``arity`` consecutive ones become their hash.  The groups'
roots are, in turn, the leaves of the top tree.

A leaf's witness is built by appending: a task takes one aligned block of
leaves in order and keeps the open subtree of each height.  When a sibling
completes a subtree, its children's witnesses are extended by the siblings'
digests, once a child and not once a leaf.  Blocks are ``arity ** HEIGHT`` leaves,
so a finished block is one node of the whole tree, and the roots of blocks are
appended, block by block, in the next round, until a group is one node.  Rounds
are few (the logarithm of the largest group to the block's size); no task holds
more than a block, whatever the size of a group.

Places of rows come from a range sort with offsets per part, so a group or a
repeated key may hold any share of the rows.

Defined cases: a null field hashes as ``-``; a null group is a group of its own
and comes first; null keys come first in their group; rows with equal keys are
ordered by leaf; a lone leaf is its group's root, a lone group's root the root;
an empty table gives an empty one; fields may be of any length; other columns
of the leaves are carried, those named as an output column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from meterline.llm.common import fresh, stored

ARITY = 3
#: Height of a block: 729 leaves.
HEIGHT = 6
STEP = T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))


def field(col: Column) -> Column:
    """The bytes of a value that go into a leaf."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*cols: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in cols]), 256)


def folded(leaf_col: Column, witness: Column) -> Column:
    """The root that a leaf and a witness give."""
    return F.aggregate(witness, leaf_col, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof_digest(witness: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(witness, lambda s: F.concat(s["before"], s["after"])), ""), 256)


class Appender:
    """A tree that grows by one digest at a time.  ``open[h]`` holds the
    finished subtrees of height h that wait for siblings, ``steps[h]`` the
    siblings (before, after) of the subtrees of height h, in order, as far as
    their parents are finished."""

    def __init__(self, arity: int):
        self.arity, self.open, self.steps, self.count = arity, [[]], [[]], 0

    def _close(self, h: int) -> None:
        nodes = self.open[h]
        for i in range(len(nodes)):
            self.steps[h].append(("".join(nodes[:i]), "".join(nodes[i + 1:])))
        if h + 1 == len(self.open):
            self.open.append([])
            self.steps.append([])
        self.open[h + 1].append(hashlib.sha256("".join(nodes).encode()).hexdigest())
        self.open[h] = []

    def append(self, digest: str) -> None:
        self.count += 1
        self.open[0].append(digest)
        h = 0
        while len(self.open[h]) == self.arity:
            self._close(h)
            h += 1

    def finish(self, height: int | None = None) -> str:
        """The root after the last append: at ``height``, or where one node is left."""
        if height is None:
            height = 0
            while self.arity ** height < self.count:
                height += 1
        for h in range(height):
            if self.open[h]:
                self._close(h)
        return self.open[height][0]

    def witnesses(self):
        """The steps of every leaf, from its own siblings upward."""
        for i in range(self.count):
            yield [steps[i // self.arity ** h] for h, steps in enumerate(self.steps) if steps]


def positions(rows: DataFrame, group: str, order: list[str], names: tuple[str, str]) -> DataFrame:
    """``rows`` with the place of a row in its group (from 0, by ``order``) and
    the group's size."""
    place, size = names
    tie, part, first, base = fresh(rows, "__tie", "__part", "__first", "__base")
    keys = [F.col(f"`{c}`") for c in (group, *order)]
    rows = rows.withColumn(tie, F.monotonically_increasing_id())  # equal rows may fall into several parts
    at = stored(rows.repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie).drop(tie)
                .withColumn(place, F.monotonically_increasing_id()), "leaves")
    at = at.withColumn(part, F.shiftright(place, 33))
    parts = at.groupBy(group, part).agg(F.min(place).alias(first), F.count("*").alias(size))
    own = Window.partitionBy(group)
    parts = parts.select(group, part, (F.coalesce(F.sum(size).over(own.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                                       - F.col(first)).alias(base), F.sum(size).over(own).alias(size))
    return at.join(parts, [group, part]).withColumn(place, F.col(place) + F.col(base)).drop(part, base)


def _grow(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """``nodes`` (g, pos, n, digest and others) with the witness inside their
    block and the block's root."""
    span = arity ** height
    schema = T.StructType([*nodes.schema.fields, T.StructField("witness", STEP),
                           T.StructField("root", T.StringType())])
    target = to_arrow_schema(schema)
    step = target.field("witness").type

    def block(table: pa.Table) -> pa.Table:
        table = table.drop_columns("block").sort_by("pos")
        tree = Appender(arity)
        for digest in table.column("digest").to_pylist():
            tree.append(digest)
        root = tree.finish(height if table.column("n")[0].as_py() > span else None)
        before, after, ends = [], [], [0]
        for steps in tree.witnesses():
            before += [s[0] for s in steps]
            after += [s[1] for s in steps]
            ends.append(len(before))
        pairs = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], names=["before", "after"])
        witness = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs.cast(step.value_type))
        return table.append_column("witness", witness.cast(step)) \
            .append_column("root", pa.array([root] * len(table), pa.string())).cast(target)

    number = F.expr(f"pos div {span}")
    return nodes.withColumn("block", number).groupBy("g", "block").applyInArrow(block, schema)


def tree(nodes: DataFrame, arity: int = ARITY, height: int = HEIGHT, above: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``nodes`` (g, pos, n, digest and others) with ``witness`` and ``root`` of
    the whole tree of their group.  ``above`` may extend the one row left of
    each group, (g, witness, root), before the witnesses are put together."""
    span = arity ** height
    largest = nodes.agg(F.max("n")).first()[0] or 0
    rounds = [stored(_grow(nodes, arity, height), "witnesses")]
    while largest > span:
        largest = -(-largest // span)
        up = rounds[-1].groupBy("g", F.expr(f"pos div {span}").alias("pos")).agg(
            F.first("root").alias("digest"), F.expr(f"first((n + {span - 1}) div {span})").alias("n"))
        rounds.append(stored(_grow(up.select("g", "pos", "n", "digest"), arity, height), "witnesses"))
    top = rounds[-1].select("g", "root").distinct()
    extra = []
    if above is not None:
        top = above(top)
        extra = [c for c in top.columns if c not in ("g", "root", "witness")]
    else:
        top = top.withColumn("witness", F.array().cast(STEP))
    up = top.select("g", F.lit(0).cast("long").alias("up"), F.col("witness").alias("w"), F.col("root").alias("r"), *extra)
    for level in reversed(rounds):
        joined = level.drop("root").withColumn("up", F.expr(f"pos div {span}")).join(up, ["g", "up"])
        whole = joined.withColumn("witness", F.concat("witness", "w")).withColumn("root", F.col("r")).drop("up", "w", "r")
        up = whole.select("g", F.col("pos").alias("up"), F.col("witness").alias("w"), F.col("root").alias("r"), *extra)
    return whole


def manifest(leaves: DataFrame, group: str = "source", key: str = "doc_id", digest: str = "leaf",
             arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """``leaves`` with ``pos`` in the group, ``witness`` (siblings from the leaf
    to the root of the dataset), ``subroot`` and ``root``."""
    kept = [c for c in leaves.columns if c not in ("pos", "witness", "subroot", "root")]
    rows = leaves.select(F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0")).alias("g"),
                         F.col(f"`{key}`").alias("key"), F.col(f"`{digest}`").alias("digest"),
                         F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    rows = positions(rows, "g", ["key", "digest"], ("pos", "n"))

    def datasets(roots: DataFrame) -> DataFrame:
        one = roots.select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("root").alias("digest"))
        up = tree(positions(one, "g", ["of"], ("pos", "n")), arity, height)
        return up.select(F.col("of").alias("g"), "witness", F.col("digest").alias("subroot"), "root")

    return tree(rows, arity, height, datasets).select("row.*", "pos", "witness", "subroot", "root")
