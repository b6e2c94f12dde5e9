"""Window packing: exact ids, gapless windows, little padding, plain differencing."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterline.llm import window_packing as W

FILE = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


def texts(n=60):
    rnd = random.Random(2)
    pool = list("aAbBzZ09'.,;!?<>=\"()[]|-_ \t\n\r\x0b\x0c\x1c\x85\xa0 　ßÄäΣσςİıéẞ̸̈́̇Kﬁ①٣日本​\xad😀\x00") + ["'s", "'ll", "'re", "the "]
    out = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(200))) for _ in range(n)]
    return out + ["", None, " \n", "word " * 5000, "<|endoftext|>", "it's o'clock, they'll", "x" * 9000]


def brute(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids + [1]


def test_encoder_equals_the_tokenizer(tok, monkeypatch):
    rows = [(t or "").encode() for t in texts(400)]
    want = [brute(tok, t.decode())[:-1] for t in rows]
    for size, known in ((1 << 23, 1 << 20), (64, 50)):
        monkeypatch.setattr(W, "SLICE", size)
        monkeypatch.setattr(W, "KNOWN", known)
        assert [ids.tolist() for ids in W.Encoder(FILE).encode(rows)] == want
    assert [ids.tolist() for ids in W.Encoder(FILE).encode(rows[:40], whole=True)] == want[:40]


def test_round_trip(frame, tok):
    docs = list(enumerate(texts())) + [(3, texts()[3])] * 3 + [(None, "null id")]
    cut = W.pieces(frame([(i, t, "kept", 9) for i, t in docs], "doc_id long, text string, extra string, offset long"), FILE)
    assert cut.columns == ["doc_id", "extra", "offset", "start", "length", "doc_tokens", "ids"]
    rows = W.pack(cut).collect()
    # every document is whole
    pieces = {}
    for r in rows:
        assert r.length == len(r.ids) // 4 <= 2048
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for i, t in docs:
        want = brute(tok, t)
        parts = sorted(pieces[i, len(want)])
        copies = sum(d == (i, t) for d in docs)
        assert sum((p[1] for p in parts[::copies]), []) == want and len(parts) == copies * len(set(p[0] for p in parts))
    # windows are gapless and within capacity
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    packed = W.pack(cut)
    made = {s.sequence_id: s for s in W.sequences(packed).collect()}
    assert set(made) == set(seqs)
    for r in rows:
        s = made[r.sequence_id]
        assert s.ids[4 * r.offset:4 * (r.offset + r.length)] == r.ids
        assert len(s.ids) == 4 * (s.used if s.used & (s.used - 1) == 0 else 2048)


def test_layout_does_not_matter(frame):
    rows = [(i % 700, 1 + (i * 7919) % 2048) for i in range(3000)] + [(5, 100)] * 6000
    a = W.pack(frame(rows, "id long, length long", 2), per_block=64)
    b = W.pack(frame(rows[::-1], "id long, length long", 7), per_block=64)
    a, b = sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))
    assert a == b and len(a) == len(rows)
    by = {}
    for r in a:
        by[r[2] >> 32] = by.get(r[2] >> 32, 0) + r[1]
    assert len(by) > 10 and max(by.values()) < 3 * min(by.values())  # the copies fill no block of their own
    used = {}
    for r in a:
        used[r[2]] = used.get(r[2], 0) + r[1]
    assert max(used.values()) <= 2048 and sum(used.values()) / (2048 * len(used)) > 0.9


def test_wrong_lengths_and_empty_tables(frame, spark):
    with pytest.raises(ValueError):
        W.pack(frame([(1, 0)], "id long, length long"))
    with pytest.raises(ValueError):
        W.pack(frame([(1, 4000)], "id long, length long"))
    with pytest.raises(ValueError):
        W.pack(frame([(1, None)], "id long, length long"))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert W.pack(W.pieces(empty, FILE)).collect() == []


def plain_difference(sizes, k):
    """Karmarkar-Karp over lists of item sets."""
    parts = [(i, [(s, [i])] + [(0, [])] * (k - 1)) for i, s in enumerate(sizes)]
    n = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[1][0][0] - p[1][-1][0]), p[0]))
        a, b = parts[0][1], parts[1][1]
        merged = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b[::-1])]
        merged.sort(key=lambda x: -x[0])
        parts = parts[2:] + [(n, merged)]
        n += 1
    slot = [None] * len(sizes)
    for w, (_, items) in enumerate(parts[0][1]):
        for i in items:
            slot[i] = w
    return slot


def test_difference_equals_the_plain_form():
    rnd = random.Random(4)
    for n, k in ((1, 1), (1, 4), (7, 3), (40, 6), (60, 2), (30, 40)):
        sizes = sorted((rnd.randrange(1, 300) for _ in range(n)), reverse=True)
        assert W.difference(np.array(sizes), k).tolist() == plain_difference(sizes, k)


def test_windows_rise_and_stay_within_capacity():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 900):
        sizes = np.sort(rnd.integers(1, 2049, n))[::-1]
        slot = W.windows(sizes, 2048)
        used = np.bincount(slot, sizes)
        assert used.max() <= 2048 and len(used) >= -(-sizes.sum() // 2048)
    mixed = np.sort(np.concatenate([rnd.integers(100, 1025, 900), np.full(1500, 32)]))[::-1]
    used = np.bincount(W.windows(mixed, 2048), mixed)
    assert mixed.sum() / (2048 * len(used)) > 0.985


def test_query_digest(spark, tok):
    from meterline.llm.queries import op12_window_packing
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: brute(tok, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op12_window_packing(spark, folder).collect()
    assert sum(r.length for r in rows) == sum(map(len, docs.values()))
    for r in rows:
        part = docs[r.doc_id][r.start:r.start + r.length]
        assert (r.doc_tokens, r.ids_crc32) == (len(docs[r.doc_id]), zlib.crc32(np.array(part, "<u4").tobytes()))
    used = spark.createDataFrame(rows).groupBy("sequence_id").agg(F.sum("length").alias("u")).collect()
    assert sum(r.u for r in used) / (2048 * len(used)) > 0.95
