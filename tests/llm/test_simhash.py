import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from meterline.llm import simhash as S
from meterline.llm.components import components


def brute_fp(text, width=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    sh = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    out = 0
    for b in range(64):
        if 2 * sum(h >> b & 1 for h in hs) > len(hs):
            out |= 1 << b
    return out


def brute_components(fps, t=2):
    keys = sorted(set(fps))
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if bin((a ^ b) % 2 ** 64).count("1") <= t:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "a b", "a b c", "A b\nc  d\x0be\x0cf", "é É a A \x00b c\x1cd",
                                  "x y z " * 70000])
def test_fingerprint(text):
    assert S.fingerprint(None if text is None else text.encode()) % 2 ** 64 == brute_fp(text)


def test_fingerprint_pieces(monkeypatch):
    monkeypatch.setattr(S, "_PIECE", 7)
    rnd = random.Random(1)
    for n in (1, 2, 3, 4, 50):
        text = " ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12))) for _ in range(n))
        assert S.fingerprint(text.encode()) % 2 ** 64 == brute_fp(text)


def signed(x):
    return x - 2 ** 64 if x >> 63 else x


def clustered(rnd, n, spread):
    """Fingerprints around a few centres, many of them within 2 bits."""
    out = set()
    centres = [rnd.getrandbits(64) for _ in range(4)]
    while len(out) < n:
        x = rnd.choice(centres)
        for _ in range(rnd.randint(0, spread)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("bucket", [2, 16, 10 ** 6])
def test_links_have_the_brute_force_components(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)  # midpoints for nearly all, some, none
    fps = clustered(random.Random(bucket), 400, 6)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.node: r.root for r in components(S.links(df)).collect()}
    want = brute_components([signed(x) for x in fps])
    for x in map(signed, fps):
        assert got.get(x, x) == want[x] or {k for k, v in got.items() if v == got[x]} == {k for k, v in want.items() if v == want[x]}


def test_distance_three_expands_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 10 ** 6)  # no bucket is large
    fps = clustered(random.Random(9), 120, 5)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {(r.a, r.b) for r in S.links(df, t=3).collect()}
    s = [signed(x) for x in fps]
    want = {(a, b) for a in s for b in s if a < b and bin((a ^ b) % 2 ** 64).count("1") <= 3}
    assert got == want


@pytest.mark.parametrize("t", [0, 1, 3, 4, 5])
def test_every_distance_through_midpoints(spark, monkeypatch, t):
    """Crowded buckets: a cluster whose neighbours are t bits apart, and noise."""
    monkeypatch.setattr(S, "BUCKET", 2)
    rnd = random.Random(t)
    fps, x = set(), rnd.getrandbits(64)
    for _ in range(25):
        fps.add(x)
        for b in rnd.sample(range(64), max(t, 1) if rnd.random() < 0.7 else t + 1):
            x ^= 1 << b
    fps |= {rnd.getrandbits(64) for _ in range(5)}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3)
    roots = {r.node: r.root for r in components(S.links(df, t=t)).collect()}
    want = {f: f for f in map(signed, fps)}
    changed = True
    while changed:
        changed = False
        for a in want:
            for b in want:
                if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= t and want[b] < want[a]:
                    want[a], changed = want[b], True
    assert {f: roots.get(f, f) for f in want} == want


def test_a_large_bucket_gives_linear_rows(spark):
    """A bucket of many members at t = 3 expands into midpoints, not pairs."""
    base = spark.range(1000).select((F.col("id") * 2 ** 40).alias("fp"))
    edges = S.links(base, t=3)
    assert edges.count() < 100 * 1000


def test_thresholds_lose_no_pair():
    parts = [list(range(0, 10)), list(range(10, 40)), list(range(40, 64))]
    p = np.full(64, 0.5)
    ts = S.allocate(1000, [10 ** 6, 0, 3], parts, p, 2)
    assert sum(ts) == 2 - 3 + 1 and min(ts) >= -1
    assert ts[0] == -1  # the partition with most candidates is skipped
    groups = S.group_bits(50, np.diag(np.full(64, 25)), 3)
    assert sorted(b for g in groups for b in g) == list(range(64))


def test_near_duplicates_cases(frame):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(5, base, "x"), (3, base, "y"), (9, base.upper(), "z"), (None, base, "n"), (7, None, "a"), (8, "", "b"),
            (1, "quite another text", "c"), (1, "quite another text", "c")]
    docs = frame(rows, "doc_id long, text string, fp string")  # a clashing extra column
    got = sorted((str(r.doc_id), r.component_id) for r in S.near_duplicates(docs.drop("fp")).collect())
    assert got == sorted([("5", 3), ("3", 3), ("9", 3), ("None", 3), ("7", 7), ("8", 7), ("1", 1), ("1", 1)])
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.fp) for r in kept.collect()) == [(1, "c"), (3, "y"), (7, "a")]


def test_keep_one_without_ids(frame):
    docs = frame([(None, "a b c d"), (None, "a b c d"), (None, "something else here now")], "doc_id long, text string")
    assert sorted(r.text for r in S.keep_one(docs).collect()) == ["a b c d", "something else here now"]


def test_empty(frame):
    docs = frame([], "doc_id long, text string")
    assert S.near_duplicates(docs).collect() == [] and S.keep_one(docs).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}}


def test_hex(spark):
    row = spark.createDataFrame([(-1,), (5,)], "fp long").select(S.hex_fingerprint(F.col("fp")).alias("h")).collect()
    assert sorted(r.h for r in row) == ["0000000000000005", "f" * 16]
