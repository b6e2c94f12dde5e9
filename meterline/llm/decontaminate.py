"""Benchmark decontamination by winnowing.

Of every window of 13 words (an item of fewer words is one window of its own
length L) the smallest hash of a k-gram, k = min(5, L), is kept: the minimum
over w = L - k + 1 consecutive k-grams.  Two equal windows keep the same
k-gram at the same place, so every shared span of at least L words shares a
fingerprint.

1. Fingerprints of the test windows are folded into a bitmap of fixed size
   (``FILTER_BITS``), the only thing broadcast by hand; its size does not
   depend on the benchmark.  A fuller bitmap only passes more candidates.
2. A pass over the training texts (numpy over Arrow batches) computes the same
   fingerprints and extends each that the bitmap knows to its windows.
3. Windows are joined on their words: exact, one test row per distinct window,
   so no product of equal keys arises on the test side.
4. Overlapping windows of a text are merged to count its words once.

Texts are judged once per distinct text, so copies share one result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from meterline.llm.common import stored, text_key

WINDOW = 13
KGRAM = 5
FILTER_BITS = 1 << 23
_FOLD = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F
              else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_BLOCK = 1 << 20


def _powers(base: int, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006  grows once per worker
    have = cache.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 2 * _BLOCK), base, np.uint64)
        step[0] = 1
        have = cache[base] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def _hash_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a folded buffer."""
    word = np.concatenate(([False], buf != 32, [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64),
                            np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(buf)), dtype=np.uint64)))
    return starts, ends, _mix((total[ends] - total[starts]) * _powers(_P_INV, len(buf) + 1)[starts])


class Texts:
    """The words of some texts, one after the other."""

    def __init__(self, texts: list[bytes]):
        folded = b" ".join(t.translate(_FOLD) for t in texts)
        self.buf = folded
        raw = np.frombuffer(folded, np.uint8)
        s, e, h, at = [], [], [], 0
        while at < len(raw):  # blocks end at a separator
            end = min(len(raw), at + _BLOCK)
            while end < len(raw) and raw[end] != 32:
                cut = folded.find(b" ", end)
                end = cut if cut >= 0 else len(raw)
            bs, be, bh = _hash_words(raw[at:end])
            s.append(bs + at), e.append(be + at), h.append(bh)
            at = end
        none = np.zeros(0, np.int64)
        self.starts = np.concatenate([none, *s])
        self.ends = np.concatenate([none, *e])
        self.hashes = np.concatenate([none.astype(np.uint64), *h])
        first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]) if texts else none
        self.first = np.searchsorted(self.starts, first)  # word number each text begins with
        self.counts = np.diff(np.append(self.first, len(self.starts)))
        self.owner = np.repeat(np.arange(len(texts)), self.counts)

    def windows(self, length: int, known: np.ndarray | None):
        """(window starts, their fingerprints) for windows of ``length`` words
        inside one text; only those the bitmap ``known`` has, or all."""
        k = min(KGRAM, length)
        w = length - k + 1
        n = len(self.hashes)
        for lo in range(0, max(0, n - length + 1), _BLOCK):
            h = self.hashes[lo:lo + _BLOCK + length - 1]
            own = self.owner[lo:lo + _BLOCK + length - 1]
            grams = len(h) - k + 1
            g = np.zeros(grams, np.uint64)
            for j in range(k):
                g = g * np.uint64(0xD6E8FEB86659FD93) + h[j:j + grams]
            g = _mix(g + np.uint64(length))
            count = len(h) - length + 1
            ok = own[:count] == own[length - 1:length - 1 + count]
            if known is not None:
                slot = (g >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)
                hit = np.concatenate(([0], np.cumsum((known[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1, dtype=np.int64)))
                ok &= hit[w:w + count] > hit[:count]
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            near = g[at[:, None] + np.arange(w - 1, -1, -1)]  # the rightmost of equal minima
            fp = near[np.arange(len(at)), near.argmin(axis=1)]
            if known is not None:
                slot = (fp >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)
                yes = ((known[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)
                at, fp = at[yes], fp[yes]
            yield at + lo, fp

    def text_of(self, at: int, length: int) -> bytes:
        return b" ".join(self.buf[self.starts[i]:self.ends[i]] for i in range(at, at + length))


def _groups(texts: list[bytes | None]):
    """Slices of ``texts`` of about a block each; a long text stands alone."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= _BLOCK:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def test_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, len, window, fp): every window of every item, with the
    fingerprint that winnowing keeps of it.  Items without words have none."""
    src = benchmark.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([src.schema["item"], *T.StructType.fromDDL("len int, window string, fp long").fields])

    def run(batches):
        for batch in batches:
            for i, t in enumerate(batch.column(1).cast(pa.binary())):
                words = Texts([t.as_py() or b""])
                length = min(WINDOW, len(words.hashes))
                if not length:
                    continue
                for at, fp in words.windows(length, None):
                    text = [words.text_of(int(a), length).decode("utf-8", "replace") for a in at]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([i] * len(at))), pa.array([length] * len(at), pa.int32()),
                         pa.array(text), pa.array(fp.astype(np.int64))], names=["item", "len", "window", "fp"])

    return src.mapInArrow(run, schema)


def fingerprint_filter(windows: DataFrame) -> np.ndarray:
    """Bitmap of FILTER_BITS bits over the leading bits of the fingerprints,
    folded to words by Spark: at most FILTER_BITS / 64 rows."""
    slot = F.shiftrightunsigned("fp", 64 - FILTER_BITS.bit_length() + 1)
    rows = windows.select(slot.alias("s")).groupBy(F.shiftright("s", 6).cast("int").alias("word")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 64, "<i8")
    for r in rows:
        out[r.word] = r.bits
    return out.view(np.uint8)


def train_windows(docs: DataFrame, lengths: list[int], known: np.ndarray, text_col: str = "text",
                  keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``key`` (of the text), ``n_words`` and the windows
    ``wins`` (at, len, window) whose fingerprint the bitmap knows."""
    src = docs.select(*[F.col(f"`{c}`") for c in keep], text_key(F.col(f"`{text_col}`")).alias("__key"),
                      F.col(f"`{text_col}`").cast("string").alias("__text"))
    extra = "__key string, __n_words long, __wins array<struct<at: int, len: int, window: string>>"
    schema = T.StructType([*src.schema.fields[:-2], *T.StructType.fromDDL(extra).fields])
    shared = docs.sparkSession.sparkContext.broadcast(known)
    n = len(keep)
    win = pa.list_(pa.struct([("at", pa.int32()), ("len", pa.int32()), ("window", pa.string())]))

    def run(batches):
        bitmap = shared.value
        for batch in batches:
            texts = batch.column(n + 1).cast(pa.binary()).to_pylist()
            counts, found = [], []
            for lo, hi in _groups(texts):
                words = Texts([t or b"" for t in texts[lo:hi]])
                counts.extend(words.counts.tolist())
                out: list[list] = [[] for _ in range(hi - lo)]
                for length in lengths:
                    for at, _ in words.windows(length, bitmap):
                        for a in at.tolist():
                            o = words.owner[a]
                            out[o].append((a - int(words.first[o]), length,
                                           words.text_of(a, length).decode("utf-8", "replace")))
                found.extend([{"at": a, "len": m, "window": s} for a, m, s in x] for x in out)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(n + 1)], pa.array(counts, pa.int64()), pa.array(found, win)],
                names=[*keep, "__key", "__n_words", "__wins"])

    return src.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``keep``, ``n_words``, ``n_hit``
    (words inside any occurrence of a test window), ``items`` (sorted strings),
    ``n_items`` and ``contaminated`` (n_hit > 0 and 20 * n_hit >= n_words).

    Null and empty texts have no words and no hits; null, empty and repeated
    items are allowed (equal item ids count once, a null id is not listed)."""
    tests = stored(test_windows(benchmark, item_col, item_text), "test-windows")
    lengths = sorted(r.len for r in tests.select("len").distinct().collect())  # 1 to 13
    train = stored(train_windows(docs, lengths, fingerprint_filter(tests), text_col, (id_col, *keep)), "train-windows")
    found = train.where(F.size("__wins") > 0).select("__key", F.explode("__wins").alias("w")).distinct()
    known = stored(tests.select("window").distinct(), "test-distinct")
    hits = stored(found.select("__key", "w.at", "w.len", "w.window").join(known, "window"), "window-hits")
    spans = F.sort_array(F.collect_list(F.struct("at", (F.col("at") + F.col("len")).alias("end"))))
    merged = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["at"], acc["reach"]))).alias("n"),
                                F.greatest(acc["reach"], x["end"]).alias("reach")))
    per_text = hits.groupBy("__key").agg(merged["n"].alias("__n_hit"))
    items = hits.select("__key", "window").distinct().join(tests.select("window", "item").distinct(), "window") \
        .select("__key", F.col("item").cast("string").alias("item")).distinct() \
        .groupBy("__key").agg(F.sort_array(F.collect_list("item")).alias("__items"))
    judged = stored(per_text.join(items, "__key"), "text-hits")
    out = train.join(judged, "__key", "left")
    n_hit = F.coalesce("__n_hit", F.lit(0).cast("long"))
    return out.select(id_col, *keep, F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"),
                      F.coalesce("__items", F.array().cast("array<string>")).alias("items"),
                      F.size(F.coalesce("__items", F.array().cast("array<string>"))).cast("long").alias("n_items"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("__n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated, all columns kept."""
    key = "text_key"
    src = docs.select(text_key(F.col(f"`{text_col}`")).alias(key), F.col(f"`{text_col}`").alias("text"))
    bad = stored(contamination(src, benchmark, key, "text", **options).where("contaminated").select(key).distinct(),
                 "contaminated")
    return docs.join(bad, text_key(F.col(f"`{text_col}`")) == bad[key], "left_anti")
