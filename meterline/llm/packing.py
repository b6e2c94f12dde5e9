"""Conflict-constrained best-fit packing of documents into sequences.

Texts longer than a bin are cut in pieces; a piece that fills a bin is alone
in it.  The other pieces are packed by best-fit decreasing.  A bin carries
bitmaps of the sources (one per occurrence level, at most ``per_source``
pieces of a source) and of the duplicate clusters it holds (never two pieces
of one).  Bins are kept by residual; the search starts at the smallest
residual that fits and goes on to the successor until a compatible bin is
found, which is thereby the tightest one; else a bin is opened.

Packing is sequential, so the pieces are dealt to groups of about ``GROUP``
by a hash of row and content: the number of groups follows the input, their
size does not, and the copies of a cluster or the rows of a source, however
many, are spread over all groups.  Only sizes and keys are shuffled.

Defined cases: null and empty texts are pieces of size 0, packed like others;
a null source is a source; null ids and repeated rows are packed as rows of
their own (equal texts never share a bin); an empty table gives an empty one;
extra columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from meterline.llm.common import numbered, plain_words, stored, text_key

CAPACITY = 2048
PER_SOURCE = 2
GROUP = 4096


def pack(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int):
    """(bin, offset) of each piece, taken in the given order, and the bins' free
    space.  Clusters are numbers below len(sizes), -1 for one without conflict."""
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = 0  # bit r: some bin has residual r
    free: list[int] = []
    level: list[list[int]] = []  # per bin: bit s of word l: more than l pieces of source s
    held: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        s_bit, c_bit = 1 << source, (1 << cluster if cluster >= 0 else 0)
        found, rest = -1, present >> size
        r = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            r += step
            for at, b in enumerate(by_residual[r]):
                if not (level[b][-1] & s_bit or held[b] & c_bit):
                    found = b
                    by_residual[r].pop(at)
                    if not by_residual[r]:
                        present &= ~(1 << r)
                    break
            if found >= 0:
                break
            rest >>= step + 1
            r += 1
        if found < 0:
            found = len(free)
            free.append(capacity)
            level.append([0] * per_source)
            held.append(0)
        out.append((found, capacity - free[found]))
        free[found] -= size
        words = level[found]
        for i in range(per_source):
            if not words[i] & s_bit:
                words[i] |= s_bit
                break
        held[found] |= c_bit
        by_residual[free[found]].append(found)
        present |= 1 << free[found]
    return out, free


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                   capacity: int = CAPACITY, per_source: int = PER_SOURCE, group: int = GROUP) -> DataFrame:
    """One row per piece: ``id_col``, ``piece``, ``start_word``, ``n_words``,
    ``bin``, ``bin_offset`` and ``bin_free`` (words left in the bin)."""
    n = F.size(plain_words(F.col(f"`{text_col}`")))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"),
                       text_key(F.col(f"`{text_col}`")).alias("cluster"), n.alias("n"))
    rows = stored(numbered(rows), "pack-rows")
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1)
    pieces = rows.select("id", "source", "cluster", "row", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece")) \
        .withColumn("size", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity))
    total = rows.agg(F.sum(last + 1)).first()[0] or 0
    groups = max(1, -(-total // group))
    # by content alone: the same rows give the same bins whatever files they are in
    dealt = pieces.withColumn("tie", F.xxhash64("row", "piece", "cluster", "id", "source")) \
        .withColumn("grp", F.pmod("tie", F.lit(groups)))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "cluster", "piece", "tie"], ascending=[False, True, True, True], kind="stable")
        source = pd.factorize(pdf["source"], use_na_sentinel=False)[0].tolist()
        number, _ = pd.factorize(pdf["cluster"])
        counts = pd.Series(number).value_counts()
        shared = {c: i for i, c in enumerate(counts.index[counts > 1])}  # only these can conflict
        cluster = [shared.get(c, -1) for c in number]
        placed, free = pack(pdf["size"].tolist(), source, cluster, capacity, per_source)
        first = int(key[0]) << 32
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "piece": pdf["piece"].to_numpy(),
                             "start_word": pdf["piece"].to_numpy(dtype="int64") * capacity,
                             "n_words": pdf["size"].to_numpy(dtype="int64"),
                             "bin": [first + b for b, _ in placed], "bin_offset": [o for _, o in placed],
                             "bin_free": [free[b] for b, _ in placed]})

    kind = rows.schema["id"].dataType.simpleString()
    out = dealt.groupBy("grp").applyInPandas(
        run, f"id {kind}, piece int, start_word long, n_words long, bin long, bin_offset int, bin_free int")
    return out.withColumnRenamed("id", id_col)
