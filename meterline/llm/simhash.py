"""SimHash near-duplicates by the generalised pigeonhole principle.

1. *Fingerprints.*  Words, shingles and 64-bit hashes per text in Arrow
   batches; long texts are read in pieces, so memory does not follow length.
2. *Partitions.*  Bits that are correlated over the distinct fingerprints are
   grouped together (one 64 x 64 matrix of counts, summed by Spark).
3. *Thresholds.*  With m partitions and maximum distance t, any thresholds
   t_i >= -1 that sum to t - m + 1 lose no pair.  Dynamic programming picks
   the vector with the fewest estimated candidates plus probes.
4. *Probe and verify.*  A fingerprint is indexed under its partition value
   with t_i bits masked, for every choice of bits; fingerprints sharing a key
   are candidates and their whole distance is checked.
5. *Large buckets.*  A bucket over ``BUCKET`` fingerprints is not expanded
   into pairs.  Its members are indexed under midpoints instead: with r = t // 2
   two fingerprints are within t bits exactly when some value is within r bits
   of one and t - r of the other.  Joining all fingerprints within t - r bits
   of a value to one of those within r bits gives the same components, in 65
   rows a fingerprint for t = 1 and 2, 2,081 for 3 and 4, 43,745 for 5 and 6.
   This is exact and linear at every size.
6. *Components* of the links by star contraction (``components.py``).

Equal fingerprints are collapsed before step 2, so copies cost one row each.
"""

from __future__ import annotations

import re
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from meterline.llm.common import stored
from meterline.llm.components import components

BITS = 64
SEED = 42
#: Buckets up to this size are compared in pairs, larger ones through midpoints.
BUCKET = 16
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BREAK = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 20


def _words(text: bytes):
    """Lists of words, a piece of the text at a time."""
    start = 0
    while start < len(text):
        cut = _BREAK.search(text, min(len(text), start + _PIECE))
        end = cut.start() if cut else len(text)
        yield text[start:end].translate(_LOWER).split()
        start = end


def _hashes(text: bytes, width: int):
    """Arrays of shingle hashes of a text."""
    carry: list[bytes] = []
    seen = False
    for words in _words(text):
        words = carry + words
        n = len(words) - width + 1
        if n > 0:
            seen = True
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
            yield np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
            words = words[n:]
        carry = words
    if carry and not seen:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The 64-bit fingerprint as a signed long; 0 for a text without words."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in _hashes(text or b"", width):
        for part in np.array_split(h, len(h) // 65536 + 1):
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int32)
            n += len(part)
    out = 0
    for b in np.flatnonzero(2 * ones > n) if n else ():
        out |= 1 << int(b)
    return out - (1 << BITS) if out >> (BITS - 1) else out


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = 3, keep: tuple[str, ...] = ("doc_id",),
                 name: str = "fp") -> DataFrame:
    """Columns ``keep`` plus the signed fingerprint ``name``.  Null and empty
    texts have fingerprint 0."""
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__fp_text"))
    schema = T.StructType([*[f for f in src.schema.fields[:-1]], T.StructField(name, T.LongType(), False)])
    n = len(keep)

    def run(batches):
        for batch in batches:
            texts = batch.column(n).cast(pa.binary())
            fp = pa.array([fingerprint(t.as_py(), width) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], fp], names=[*keep, name])

    return src.mapInArrow(run, schema)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for bits i and j, how many set both; summed
    by Spark, 64 x 64 numbers whatever the corpus."""
    def run(batches):
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for part in np.array_split(v, len(v) // 65536 + 1):
                m = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += (m.T @ m).astype(np.int64)
                n += len(part)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BITS + 1), pa.int32()), pa.array([*both.tolist(), [n] * BITS], pa.list_(pa.int64()))],
                names=["i", "c"])

    rows = fps.select("fp").mapInArrow(run, "i int, c array<bigint>").select("i", F.posexplode("c").alias("j", "c")) \
        .groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    table = np.zeros((BITS + 1, BITS), np.int64)
    for r in rows:
        table[r.i, r.j] = r.c
    return int(table[BITS, 0]), table[:BITS]


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal width, correlated bits together: each is
    grown from the free bit with the strongest links to other free bits."""
    p = np.diag(both) / max(1, n)
    sd = np.sqrt(p * (1 - p))
    with np.errstate(divide="ignore", invalid="ignore"):
        phi = np.nan_to_num(np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(sd, sd)))
    np.fill_diagonal(phi, 0)
    free, out = set(range(BITS)), []
    for k in range(m):
        want = (BITS - sum(map(len, out))) // (m - k)
        pool = sorted(free)
        part = [max(pool, key=lambda b: (phi[b, pool].sum(), -b))]
        while len(part) < want:
            pool = sorted(free - set(part))
            part.append(max(pool, key=lambda b: (phi[b, part].sum(), -b)))
        free -= set(part)
        out.append(sorted(part))
    return out


def allocate(n: int, equal_pairs: list[int], parts: list[list[int]], p: np.ndarray, t: int) -> list[int]:
    """Thresholds per partition summing to t - m + 1 with the least estimated
    cost.  Candidates at threshold e: pairs equal in the partition (counted),
    scaled by the odds that up to e of its bits differ; plus the index rows."""
    def cost(i: int, e: int) -> float:
        if e < 0:
            return 0.0
        differ = np.clip(2 * p[parts[i]] * (1 - p[parts[i]]), 0, 0.499)
        odds = differ / (1 - differ)
        e1 = odds.sum()
        scale = [1.0, e1, (e1 * e1 - (odds ** 2).sum()) / 2]
        while len(scale) <= e:
            scale.append(scale[-1] * e1 / len(scale))
        base = max(equal_pairs[i], n * (n - 1) / 2 * float(np.prod(1 - differ)))
        return base * sum(scale[:e + 1]) + n * comb(len(parts[i]), e)

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(parts)):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for total, (c, ts) in best.items():
            for e in range(-1, t + 1):
                cand = (c + cost(i, e), [*ts, e])
                if total + e not in nxt or cand < nxt[total + e]:
                    nxt[total + e] = cand
        best = nxt
    return best[t - len(parts) + 1][1]


def _mask(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << BITS) if m >> (BITS - 1) else m


def links(fps: DataFrame, t: int = 2, m: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) whose
    components are those of "differ in at most ``t`` bits".

    Every edge from an ordinary bucket is a verified pair; large buckets add
    star edges through midpoints."""
    m = m or t + 1
    n, both = bit_counts(fps)
    parts = group_bits(n, both, m)
    masks = [_mask(part) for part in parts]
    counts = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(k)).alias("v"))
                       for i, k in enumerate(masks)])
    equal = fps.select(F.explode(counts).alias("k")).groupBy("k").count() \
        .groupBy("k.i").agg(F.sum(F.expr("cast(count as double) * (count - 1) / 2")).alias("pairs")).collect()
    pairs0 = [next((r.pairs for r in equal if r.i == i), 0) for i in range(m)]
    ts = allocate(n, pairs0, parts, np.diag(both) / max(1, n), t)
    probes = [_mask(set(part) - set(off)) for part, e in zip(parts, ts) if e >= 0
              for off in combinations(part, min(e, len(part)))]
    keys = fps.select("fp", F.posexplode(F.array(*[F.lit(k).bitwiseAND(F.col("fp")) for k in probes])).alias("i", "v"))
    # the largest size up to which a bucket is expanded
    size = keys.groupBy("i", "v").agg(F.count("*").alias("n")).where("n > 1")
    member = stored(keys.join(size, ["i", "v"]), "gph-buckets")
    small = member.where(F.col("n") <= BUCKET)
    a, b = small.select("i", "v", F.col("fp").alias("a")), small.select("i", "v", F.col("fp").alias("b"))
    found = a.join(b, ["i", "v"]).where(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= t)).select("a", "b")
    if t < 1:
        return found.distinct()  # distinct fingerprints share no whole key
    large = member.where(F.col("n") > BUCKET).select("fp").distinct()
    ball = midpoints(large, t - t // 2)
    low = ball.groupBy("point").agg(F.min(F.when(F.col("flips") <= t // 2, F.col("fp"))).alias("a"), F.count("*").alias("n")) \
        .where("n > 1 and a is not null").select("point", "a")
    # merged: the planner cannot know how many points a fingerprint has
    star = ball.join(low.hint("merge"), "point").where("a != fp").select("a", F.col("fp").alias("b"))
    return found.unionByName(star).distinct()


def midpoints(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, point, flips): every value within ``radius`` bits of a fingerprint."""
    ball = layer = fps.select("fp", F.col("fp").alias("point"), F.lit(0).alias("flips"), F.lit(-1).alias("last"))
    for k in range(1, radius + 1):
        layer = layer.where(F.col("last") < BITS - 1).withColumn(
            "last", F.explode(F.sequence(F.col("last") + 1, F.lit(BITS - 1))))
        layer = layer.select("fp", F.col("point").bitwiseXOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.col("last"))).alias("point"), F.lit(k).alias("flips"), "last")
        ball = ball.unionByName(layer)
    return ball.select("fp", "point", "flips")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, t: int = 2,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, columns ``keep``, ``fp``, ``root``
    (a fingerprint naming the component) and ``component_id``, the smallest id
    reachable over links of at most ``t`` differing bits.  Repeated rows and
    ids are allowed; a null id is the smallest only where there is no other."""
    rows = stored(fingerprints(docs, text_col, width, (id_col, *keep)), "simhash")
    distinct = stored(rows.groupBy("fp").agg(F.min(F.col(f"`{id_col}`")).alias("low")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), t)).withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    comp = stored(placed.join(low, "root").select("fp", "root", "component_id"), "simhash-components")
    return rows.join(comp, "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, t: int = 2) -> DataFrame:
    """The row with the smallest id of each near-duplicate group, all columns
    kept; among rows with that id the one with the smallest text key, once."""
    key = lambda c: F.coalesce(F.xxhash64(c), F.lit(0).cast("long"))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                      key(F.col(f"`{text_col}`")).alias("k"))
    rows = near_duplicates(src, "id", "text", width, t, ("k",))
    first = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "k"))
    win = stored(rows.groupBy("root").agg(first.alias("w")).select("w.id", "w.k"), "simhash-kept").alias("w")
    repeated = stored(rows.groupBy("id", "k").count().where("count > 1").select("id", "k"), "simhash-repeated").alias("r")

    def same(side: str) -> Column:
        return F.col(f"`{id_col}`").eqNullSafe(F.col(f"{side}.id")) & (key(F.col(f"`{text_col}`")) == F.col(f"{side}.k"))

    single = docs.join(repeated, same("r"), "left_anti")
    several = docs.join(repeated, same("r"), "left_semi").dropDuplicates([id_col, text_col])
    return single.unionByName(several).join(win, same("w"), "left_semi")
