"""Collocations by marginalising the longest windows.

A text falls into pieces at punctuation and line ends, a piece into words.
Each word starts one window: itself and the words that follow it in its piece,
padded to the longest order.  Only these windows are counted (per Arrow block,
then by partial aggregation), and a ROLLUP over their columns sums the counts
of every shorter phrase, since an occurrence of a phrase is the prefix of just
one window.

It runs twice.  Windows of two words give the totals of each language, the
words and the pairs that are frequent enough.  Windows of full length are then
counted from frequent pairs only and padded from the first infrequent pair on:
a phrase with an infrequent pair is itself infrequent.  The frequent pairs go
to the tasks as a bitmap of 16 bits a pair and at most ``MAX_BITS`` bits; false
hits of a full bitmap count more windows and change no result.

Counts and scores are exact: decimals where products may pass 64 bits.

Defined cases: a null or empty text has no words; a null language is ``und``;
repeated rows count each time; an empty table gives an empty result; texts of
any length are read in slices; only the two named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from meterline.llm.common import stored
from meterline.session import session_conf

SLICE = 1 << 21
BATCH_ROWS = 1000
MAX_BITS = 1 << 27
_BREAK = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _BREAK, b"abcdefghijklmnopqrstuvwxyz " + b"\xff" * len(_BREAK))


def _words(data: bytes):
    """(words, whether the next word is in the same piece, start of each)."""
    a = np.frombuffer(data, np.uint8)
    gap = a == 255
    word = ~gap & (a != 32)
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(a[word])])
    piece = np.cumsum(gap, dtype=np.int32)[starts]
    joined = np.zeros(len(starts), bool)
    joined[:-1] = piece[1:] == piece[:-1]
    return words, joined, starts


def _slices(texts, order: int):
    """(words, joined, number of words whose windows count here) of texts read
    together; a text longer than a slice is cut at a word and read on from
    ``order - 1`` words before the cut."""
    pending, size = [], 0
    for text in texts:
        data = text.translate(_TABLE)
        pending.append(data)
        size += len(data) + 1
        if size >= SLICE:
            yield from _cut(b"\xff".join(pending), order)
            pending, size = [], 0
    if pending:
        yield from _cut(b"\xff".join(pending), order)


def _cut(data: bytes, order: int):
    at, room = 0, SLICE
    while True:
        end = len(data)
        if end - at > 2 * room:
            end = max(data.rfind(b" ", at, at + room), data.rfind(b"\xff", at, at + room))
            if end <= at:
                room *= 2
                continue
        words, joined, starts = _words(data[at:end])
        if end == len(data):
            yield words, joined, len(words)
            return
        n = len(words) - order + 1
        if n <= 0:
            room *= 2
            continue
        yield words, joined, n
        at, room = at + int(starts[n]), SLICE


def _by_lang(batch):
    """(language, texts) of an Arrow batch."""
    langs = batch.column(0).dictionary_encode()
    texts = batch.column(1)
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, texts.filter(pc.equal(langs.indices, i)).to_pylist()


def _counted(lang: str, dictionary: pa.Array, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct rows of id columns with their number, as words; id -1 is padding."""
    base = len(dictionary) + 1
    key, parts = None, []
    for col in columns:  # two id columns fit a 64-bit key; more are numbered again first
        if key is None:
            key = col + 1
        else:
            distinct, key = np.unique(key, return_inverse=True) if len(parts) > 0 else (None, key)
            parts.append(distinct)
            key = key * base + col + 1
    distinct, count = np.unique(key, return_counts=True)
    out = []
    for numbered in reversed(parts):
        out.append(distinct % base)
        distinct = distinct // base
        distinct = distinct if numbered is None else numbered[distinct]
    out.append(distinct)
    names = pa.concat_arrays([pa.array([""]), dictionary.cast(pa.string())])
    words = [names.take(pa.array(ids)) for ids in reversed(out)]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(count), pa.string()), *words, pa.array(count, pa.int64())],
                                      names=["lang", *[f"w{i + 1}" for i in range(len(columns))], "c"])


def _pairs(batches):
    for batch in batches:
        for lang, texts in _by_lang(batch):
            for words, joined, n in _slices(texts, 2):
                coded = words.dictionary_encode()
                ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                after = np.where(joined, np.append(ids[1:], -1), -1)
                yield _counted(lang, coded.dictionary, [ids[:n], after[:n]])


def _hashes(lang: str, words: list[str]) -> np.ndarray:
    import xxhash
    salt = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, salt) for w in words), np.uint64, len(words))


def _bit(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Place of a pair of word hashes in a bitmap of ``bits``, a power of two."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def pair_bitmap(pairs: DataFrame) -> tuple[np.ndarray, int]:
    """Bitmap of the rows (lang, w1, w2) of ``pairs``: 16 bits a pair, at most
    ``MAX_BITS``; only its words that are not zero reach the driver."""
    bits = 1 << 16
    n = pairs.count()
    while bits < min(16 * n, MAX_BITS):
        bits *= 2

    def places(batches):
        for batch in batches:
            lang, a, b = (batch.column(i).to_pylist() for i in range(3))
            first = np.fromiter((_hashes(x, [w])[0] for x, w in zip(lang, a)), np.uint64, len(a))
            second = np.fromiter((_hashes(x, [w])[0] for x, w in zip(lang, b)), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([pa.array(_bit(first, second, bits))], names=["bit"])

    at = pairs.select("lang", "w1", "w2").mapInArrow(places, "bit long")
    words = at.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return bitmap.view(np.uint64), bits


def _windows(order: int, bitmap, bits: int):
    def count(batches):
        seen = bitmap.value
        for batch in batches:
            for lang, texts in _by_lang(batch):
                for words, joined, n in _slices(texts, order):
                    coded = words.dictionary_encode()
                    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                    h = _hashes(lang, coded.dictionary.to_pylist())
                    bit = _bit(h[ids], h[np.append(ids[1:], 0)] if len(ids) else h[ids], bits)
                    run = joined & ((seen[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
                    at = np.flatnonzero(run[:n])
                    if not len(at):
                        continue
                    columns, alive = [ids[at], ids[at + 1]], np.ones(len(at), bool)
                    for k in range(2, order):
                        alive = alive & run[np.minimum(at + k - 1, len(ids) - 1)]
                        columns.append(np.where(alive, ids[np.minimum(at + k, len(ids) - 1)], -1))
                    yield _counted(lang, coded.dictionary, columns)
    return count


def phrase_counts(docs: DataFrame, min_count: int, order: int = 4, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang``, ``phrase`` (its words joined by a space), ``size`` and ``f`` of
    every phrase of 1 to ``order`` words with f >= ``min_count``, and for each
    language the number of its words as a row of size 0."""
    # small Arrow batches: a task holds a few megabytes of text at a time
    with session_conf(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_ROWS)):
        return _phrase_counts(docs, min_count, order, lang, text)


def _phrase_counts(docs: DataFrame, min_count: int, order: int, lang: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    two = rows.mapInArrow(_pairs, "lang string, w1 string, w2 string, c long")
    short = stored(spark.sql(
        "SELECT lang, w1, w2, sum(c) AS f FROM {t} GROUP BY lang, ROLLUP (w1, w2) "
        "HAVING grouping_id() = 3 OR (f >= {n} AND (grouping(w2) = 1 OR w2 != ''))", t=two, n=min_count), "short-phrases")
    words = short.select("lang", F.coalesce("w1", F.lit("")).alias("phrase"),
                         F.when(F.col("w1").isNull(), 0).otherwise(1).alias("size"), "f").where(F.col("w2").isNull())
    bitmap, bits = pair_bitmap(short.where(F.col("w2").isNotNull()))
    cols = [f"w{i + 1}" for i in range(order)]
    long = rows.mapInArrow(_windows(order, spark.sparkContext.broadcast(bitmap), bits),
                           "lang string, " + ", ".join(f"{c} string" for c in cols) + ", c long")
    summed = spark.sql(f"SELECT {', '.join(cols)}, lang, sum(c) AS f FROM {{t}} GROUP BY lang, w1, w2, "
                       f"ROLLUP ({', '.join(cols[2:])}) HAVING f >= {{n}}", t=long, n=min_count)
    # a padded column is empty: the shorter phrase is counted by its own prefix
    phrases = summed.where(" AND ".join(f"({c} IS NULL OR {c} != '')" for c in cols))
    size = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return stored(words.unionByName(phrases.select("lang", F.concat_ws(" ", *cols).alias("phrase"), size.alias("size"), "f")),
                  "phrase-counts")


def collocations(docs: DataFrame, min_count: int = 30, top: int = 2000, order: int = 4, scale: int = 2_000_000,
                 absorb_percent: int = 80, lang: str = "lang", text: str = "text") -> DataFrame:
    """The ``top`` phrases of each language by score descending, count
    descending, phrase: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase of 2 to ``order`` words with count a is cut after its first k
    words, whose count is l, that of the rest r; its score is the lowest
    floor(scale * a / (l + r)) over the cuts, at the smallest such k.  Phrases
    inside a longer one with ``absorb_percent`` of their count are dropped."""
    counts = phrase_counts(docs, min_count, order, lang, text)
    cands = counts.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))
    words = F.split("phrase", " ", -1)
    part = lambda i, n: F.array_join(F.slice("ws", i, n), " ")
    cuts = cands.withColumn("ws", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))) \
        .select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"),
                part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.join(counts.where("size >= 1").select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]) \
        .join(counts.where("size >= 1").select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"(cast({scale} AS decimal(12,0)) * cast(a AS decimal(19,0))) div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))

    inner = cands.where("size >= 3").withColumn("ws", words) \
        .withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1))) \
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1))) \
        .groupBy("lang", part(F.col("i"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer"))
    absorbed = F.expr(f"cast(longer AS decimal(19,0)) * 100 >= cast(a AS decimal(19,0)) * {absorb_percent}")
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~absorbed)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase"))
    best = left.withColumn("rank", rank).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"),
        F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
