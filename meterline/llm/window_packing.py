"""Packing of tokenized documents into windows of equal length by multiway
differencing (Karmarkar-Karp).

``pieces`` tokenizes every document, ends it with an end id and cuts it at the
window length; the rest of a document is cut at ``piece`` tokens, and that of
one document in ``fine_every`` at ``fine`` tokens, which gives the differencing
small change.  ``pack`` deals the pieces into blocks of about ``WINDOWS``
windows and, within a block, starts from one partial partition a piece and
merges the two of largest spread, oppositely ordered, until one is left: its
sums are near equal.  If the largest sum exceeds the capacity, the number of
windows rises and the block is differenced again.  A piece of full length is a
window of its own.  ``sequences`` builds the windows themselves.

Tokenizing: units between ASCII white space, also cut between an ASCII letter
or digit and the ASCII punctuation after it, are encoded once and kept in a
bounded table of the Python worker.  That equals encoding the whole text for
tokenizers that split words there, as ``word_bpe_49k`` does (tested);
``whole=True`` encodes whole texts for any other.  Strings of special tokens
are ordinary text.

Blocks depend on the rows alone, not on their files: equal rows are counted,
and the copy's number and the row's values give its block.  A group of
copies thus spreads over all blocks.

Defined cases: a null or empty text is one piece, the end id; repeated rows
are separate pieces with equal columns; an empty table gives an empty one;
texts of any length are encoded in slices.  ``pieces`` passes every column but
the text on; an input column named as an output column is replaced.
"""

from __future__ import annotations

import heapq
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from meterline.llm.common import fresh, stored

CAPACITY = 2048
END_ID = 1
PIECE, FINE, FINE_EVERY = 1024, 64, 16
#: Windows of a block: the memory of a differencing is some 20 pieces a window.
WINDOWS = 256
SLICE = 1 << 23
KNOWN = 1 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_PUNCT = np.array([33 <= b < 127 for b in range(256)]) & ~_ALNUM


class Encoder:
    """Ids of texts; one per Python worker and tokenizer file."""

    _kept: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[bytes, bytes] = {}
        # a word of ASCII letters that the tokenizer neither changes nor splits goes to its model alone
        probe = ["abcdefghijklmnopqrstuvwxyz", "the", "q"]
        self.plain = all(self._model(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe)

    def _model(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        done = self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in done]

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, number of ids of each)."""
        coded = units.dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > KNOWN:
            known.clear()
            new = words
        model, odd = self.tokenizer.model, []
        for w in new:
            if self.plain and w.isalpha():  # bytes: ASCII letters only, already lower case
                known[w] = np.array([t.id for t in model.tokenize(w.decode())], "<u4").tobytes()
            else:
                odd.append(w)
        for w, e in zip(odd, self.tokenizer.encode_batch([w.decode() for w in odd], add_special_tokens=False)):
            known[w] = np.array(e.ids, "<u4").tobytes()
        found = [known[w] for w in words]
        ids = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        which = coded.indices.to_numpy(zero_copy_only=False)
        n = size[which]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return ids[np.repeat(first[which] - (ends - n), n) + np.arange(total)], n

    def _block(self, texts: list[bytes]) -> list[np.ndarray]:
        data = b" ".join(texts).translate(_LOWER)
        a = np.frombuffer(data, np.uint8)
        word = a != 32
        cut = np.zeros(len(a) + 1, bool)
        cut[1:] = True
        cut[1:-1] = ~word[:-1] | (_ALNUM[a[:-1]] & _PUNCT[a[1:]])
        starts = np.flatnonzero(word & np.concatenate([[True], cut[1:-1]]) if len(a) else word)
        length = np.diff(np.append(np.cumsum(word)[starts] - 1, word.sum())) if len(starts) else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(a[word])])
        ids, n = self._units(units)
        ends = np.cumsum([len(t) + 1 for t in texts])
        tokens = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, ends)]
        return np.split(ids, tokens[:-1])

    def encode(self, texts: list[bytes], whole: bool = False):
        """The ids of each text in turn; memory is bounded by a slice and one text's ids."""
        if whole:
            for t in texts:
                yield self.whole([t])[0]
            return
        block, size = [], 0
        for t in texts:
            if size and size + len(t) > SLICE:
                yield from self._block(block)
                block, size = [], 0
            if len(t) <= SLICE:
                block.append(t)
                size += len(t) + 1
                continue
            parts, at = [], 0
            while at < len(t):
                end = len(t) if len(t) - at <= SLICE else t.rfind(b" ", at + 1, at + SLICE)
                if end < 0:
                    end = t.find(b" ", at + SLICE)
                    end = len(t) if end < 0 else end
                parts += self._block([t[at:end]])
                at = end
            yield np.concatenate(parts)
        if block:
            yield from self._block(block)


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
           piece: int = PIECE, fine: int = FINE, fine_every: int = FINE_EVERY, whole: bool = False) -> DataFrame:
    """One row per piece: the columns of ``docs`` but the text, ``start`` and
    ``length`` in ids, ``doc_tokens`` and ``ids`` (binary, unsigned 32-bit
    little-endian).  ``tokenizer`` is a file of the ``tokenizers`` library that
    every executor can read."""
    own = ("start", "length", "doc_tokens", "ids")
    kept = [c for c in docs.columns if c != text and c not in own]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("start", T.LongType()), T.StructField(
        "length", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    (body,) = fresh(docs, "__text")

    def bounds(n: int, tail: int) -> list[int]:
        full = n // capacity * capacity
        step = fine if tail % fine_every == 0 else piece
        return [*range(0, full, capacity), *range(full, n, step), n] if n > full else [*range(0, n, capacity), n]

    def cut(batches):
        import zlib
        enc = Encoder.of(tokenizer)
        for batch in batches:
            texts = batch.column(body).to_pylist()
            rows, out, size = [], [], 0
            # rows are handed on in parts, so that long texts do not pile up
            def part():
                cols = [batch.column(c).take(pa.array(rows, pa.int64())) for c in kept]
                starts, lengths, totals, data = zip(*out)
                return pa.RecordBatch.from_arrays(
                    cols + [pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()),
                            pa.array(data, pa.binary())], names=schema.names)
            for row, ids in enumerate(enc.encode(texts, whole)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                at = bounds(len(ids), zlib.crc32(ids.tobytes()))
                for a, b in zip(at, at[1:]):
                    rows.append(row)
                    out.append((a, b - a, len(ids), ids[a:b].tobytes()))
                size += len(ids)
                if size > SLICE:
                    yield part()
                    rows, out, size = [], [], 0
            if out:
                yield part()

    src = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias(body))
    return src.mapInArrow(cut, schema)


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part, 0 to k - 1, of each of ``sizes`` by multiway differencing;
    equal spreads are taken in order."""
    n = len(sizes)
    parent = np.arange(n)
    heap = []
    for i in range(n):
        sums, item = np.zeros(k, np.int64), np.full(k, -1)
        sums[0], item[0] = sizes[i], i
        heap.append((-int(sizes[i]) if k > 1 else 0, i, sums, item))
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, s, p = heapq.heappop(heap)
        _, _, t, q = heapq.heappop(heap)
        s, q = s + t[::-1], q[::-1]
        both = (p >= 0) & (q >= 0)
        parent[q[both]] = p[both]
        p = np.where(p >= 0, p, q)
        order = np.argsort(-s, kind="stable")
        s, p = s[order], p[order]
        heapq.heappush(heap, (-int(s[0] - s[-1]), made, s, p))
        made += 1
    while (parent[parent] != parent).any():
        parent = parent[parent]
    slot = np.full(n, -1)
    if n:
        held = heap[0][3]
        slot[held[held >= 0]] = np.flatnonzero(held >= 0)
    return slot[parent]


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size: as few near-equal windows as the differencing
    fills without passing ``capacity``.  Sizes are at most ``capacity``."""
    total = int(sizes.sum())
    k = max(-(-total // capacity), 1)
    while True:
        slot = difference(sizes, k)
        over = int(np.bincount(slot, sizes, k).max()) - capacity if len(sizes) else 0
        if over <= 0 or k >= len(sizes):
            return slot
        # windows enough that the mean leaves room for the spread seen
        k = min(max(k + 1, -(-total // max(capacity - over, capacity // 2))), len(sizes))


def pack(rows: DataFrame, capacity: int = CAPACITY, length: str = "length",
         names: tuple[str, str] = ("sequence_id", "offset"), per_block: int = WINDOWS) -> DataFrame:
    """``rows`` with the sequence and the offset in it.  Every length is 1 to
    ``capacity``; other rows raise an error.  Equal rows are interchangeable."""
    rows = rows.drop(*names)
    count, copy, block, size, many = fresh(rows, "__count", "__copy", "__block", "__size", "__many")
    cols = [F.col(f"`{c}`") for c in rows.columns]
    counted = stored(rows.groupBy(*cols).agg(F.count("*").alias(count)), "pieces")
    ok = F.col(f"`{length}`").between(1, capacity)
    total, bad = counted.agg(F.sum(F.when(ok, F.col(f"`{length}`") * F.col(count))),
                             F.count_if(~F.coalesce(ok, F.lit(False)))).first()
    if bad:
        raise ValueError(f"{bad} rows have a length outside 1 to {capacity}")
    blocks = max(int(total or 0) // (per_block * capacity), 1)
    step = 4096  # copies are counted out in two steps, so that a large group is not one task
    dealt = counted.withColumn(many, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{count}` - 1) div {step}"))))
    single = dealt.where(F.col(count) <= step)
    large = dealt.where(F.col(count) > step).repartition(F.col(many), *cols)
    dealt = single.unionByName(large).withColumn(copy, F.explode(F.sequence(
        F.col(many) * step, F.least(F.col(many) * step + step, F.col(count)) - 1)))
    dealt = dealt.select(*cols, F.col(copy), F.col(f"`{length}`").cast("long").alias(size),
                         F.pmod(F.xxhash64(*cols, F.col(copy)), F.lit(blocks)).alias(block))
    schema = T.StructType([*rows.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType())])
    target, plain = to_arrow_schema(schema), rows.columns

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([(size, "descending"), *[(c, "ascending") for c in [*plain, copy]]])
        sizes = table.column(size).to_numpy()
        number = table.column(block)[0].as_py()
        full = int((sizes == capacity).sum())  # these come first
        slot = np.arange(len(sizes))
        slot[full:] = full + windows(sizes[full:], capacity)
        by = np.argsort(slot, kind="stable")
        ends = np.cumsum(sizes[by])
        first = np.searchsorted(slot[by], slot[by])  # place of the window's first piece
        offset = np.empty(len(sizes), np.int64)
        offset[by] = ends - sizes[by] - (ends - sizes[by])[first]
        return table.select(plain).append_column(names[0], pa.array((number << 32) + slot, pa.int64())) \
            .append_column(names[1], pa.array(offset, pa.int64())).cast(target)

    return dealt.groupBy(block).applyInArrow(fill, schema)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """``sequence_id``, ``used`` and ``ids`` of every window from packed pieces
    with ids.  A window is padded to ``capacity`` unless its used length is a
    power of two."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), parts.alias("__parts"))
    body = F.aggregate("__parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    exact = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(capacity) - F.col("used")).cast("int")))
    return rows.select("sequence_id", "used", F.when(exact, body).otherwise(F.concat(body, pad)).alias("ids"))
