"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a tuple of k byte sums.  The two partial partitions
with the largest spread (largest minus smallest sum) are combined again and
again, the sums of one in rising order laid on those of the other in falling
order, until one partition is left.

Groups of equal texts are the items.  Differencing is sequential, so it runs in
tasks of bounded size that share one set of shards:

1. The heavy groups, of at least a ``HEAVY``-th of a shard's share, are at most
   k * HEAVY whatever the input; they are differenced first.
2. The other groups are dealt to blocks of about ``BLOCK`` by hash.  Each block
   is differenced together with its share of the heavy partition (scaled by
   weight and cut at the level to which the shards can be filled), so a block
   leaves room where a heavy group lies.
3. The last block is differenced with the true sums of all the rest, which
   evens out what the blocks' small spreads add up to.

Only k sums pass through the driver between the steps.  Rows find their
group's shard by a join that AQE splits where one group is very large, and
slots are counted in cells of bounded size.

Defined cases: null and empty texts have size ``OVERHEAD``, and each of the
two is one group; repeated rows count each; an empty table gives an empty one;
extra columns are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from meterline.llm.common import numbered, stored, text_key

OVERHEAD = 16
HEAVY = 64
BLOCK = 4096
CELL = 4096


def difference(sums: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Combine partial partitions of k sums each into one.  Returns its sums,
    rising, and for each input the place its i-th sum went to."""
    k = len(sums[0])
    # node: sums rising, and per place the (input, its place) pairs as a tree
    heap = []
    nodes: list[tuple] = []
    for i, s in enumerate(sums):
        order = sorted(range(k), key=s.__getitem__)
        vals = [s[j] for j in order]
        nodes.append((i, order))
        heap.append((vals[0] - vals[-1], len(nodes) - 1, vals))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        mixed = [x[j] + y[k - 1 - j] for j in range(k)]
        order = sorted(range(k), key=mixed.__getitem__)
        vals = [mixed[j] for j in order]
        nodes.append((a, b, order))
        heapq.heappush(heap, (vals[0] - vals[-1], len(nodes) - 1, vals))
    _, root, vals = heap[0]
    places: list[list[int]] = [[0] * k for _ in sums]
    # where each place of a node ends up in the root
    todo = [(root, list(range(k)))]
    while todo:
        at, dest = todo.pop()
        node = nodes[at]
        order = node[-1]
        before = [0] * k  # unsorted place -> root place
        for rank, j in enumerate(order):
            before[j] = dest[rank]
        if len(node) == 2:
            places[node[0]] = before
        else:
            todo.append((node[0], before))
            todo.append((node[1], before[::-1]))
    return vals, places


def _level(sums: list[int], more: int) -> float:
    """The level to which ``more`` fills the lowest of ``sums``."""
    low = sorted(sums)
    for i in range(1, len(low) + 1):
        level = (sum(low[:i]) + more) / i
        if i == len(low) or level <= low[i]:
            return level
    return 0.0


def _place(sizes: list[int], start: list[int]) -> list[int]:
    """A slot for each size, on top of the sums ``start``."""
    k = len(start)
    _, places = difference([list(start), *([0] * (k - 1) + [s] for s in sizes)])
    slot = [0] * k
    for j, p in enumerate(places[0]):
        slot[p] = j
    return [slot[p[k - 1]] for p in places[1:]]


def assign(groups: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(grp, shard) for ``groups`` (grp, size), sizes near equal over k shards."""
    spark = groups.sparkSession
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    is_heavy = (F.col("size") > 0) & (F.col("size") >= total / (k * HEAVY))
    heavy = groups.where(is_heavy).orderBy(F.col("size").desc(), "grp").collect()  # at most k * HEAVY
    start, slots = [0] * k, _place([r.size for r in heavy], [0] * k)
    for r, j in zip(heavy, slots):
        start[j] += r.size
    light, rest = n - len(heavy), total - sum(start)
    blocks = max(1, -(-light // block))
    level = _level(start, rest)
    share = [min(s, level) / rest if rest else 0.0 for s in start]

    def differ(pdf: pd.DataFrame, base) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "grp"], ascending=[False, True])
        sizes = pdf["size"].astype(int).tolist()
        return pd.DataFrame({"grp": pdf["grp"].to_numpy(), "shard": _place(sizes, base(sum(sizes))), "size": sizes})

    kind = groups.schema["grp"].dataType.simpleString()
    schema = f"grp {kind}, shard int, size long"
    dealt = groups.where(~is_heavy).withColumn("part", F.pmod(F.xxhash64("grp"), F.lit(blocks)))
    first = stored(dealt.where("part > 0").groupBy("part").applyInPandas(
        lambda pdf: differ(pdf, lambda w: [int(s * w) for s in share]), schema), "shard-blocks")
    sums = list(start)
    for r in first.groupBy("shard").agg(F.sum("size").alias("size")).collect():  # k rows
        sums[r.shard] += r.size
    last = dealt.where("part = 0").groupBy("part").applyInPandas(lambda pdf: differ(pdf, lambda w: sums), schema)
    fixed = spark.createDataFrame([(r.grp, j, r.size) for r, j in zip(heavy, slots)], schema)
    return first.unionByName(last).unionByName(fixed).select("grp", "shard")


def shard(docs: DataFrame, k: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD,
          block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``size`` (UTF-8 bytes plus
    ``overhead``), ``text_crc32``, ``shard`` (0 to k - 1) and ``slot``, gapless
    from 0 within the shard.  Rows with equal texts share a shard."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = stored(numbered(docs.select(
        F.col(f"`{id_col}`").alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"), text_key(text).alias("grp"))), "shard-rows")
    groups = rows.groupBy("grp").agg(F.sum("size").alias("size"))
    placed = stored(assign(stored(groups, "shard-groups"), k, block), "shard-groups-placed")
    n = rows.count()
    cells = max(1, -(-n // (k * cell)))
    spread = F.pmod(F.xxhash64("row", "id", "grp"), F.lit(cells))
    full = stored(rows.join(placed, "grp").withColumn("cell", spread), "shard-cells")
    ahead = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offset = full.groupBy("shard", "cell").agg(F.count("*").alias("n")).select(
        "shard", "cell", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long")).alias("base"))
    here = Window.partitionBy("shard", "cell").orderBy("id", "grp", "row")
    local = full.withColumn("at", F.row_number().over(here) - 1)
    return local.join(offset, ["shard", "cell"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("at")).alias("slot"))
