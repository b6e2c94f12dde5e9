"""Collocations against plain counting in Python."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from meterline.llm import collocations as C


def brute(rows, min_count, top=2000, order=4):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, order + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i:i + m])] += 1
    out = []
    for lang in n:
        cands = {p: c for (g, p), c in f.items() if g == lang and len(p) > 1 and c >= min_count}
        kept = []
        for p, a in cands.items():
            s, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            inside = any(100 * b >= 80 * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                         for q, b in cands.items())
            if not inside:
                kept.append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def corpus(seed=5):
    rnd = random.Random(seed)
    words = ["a", "Bé", "c", "dd", "ÉE", "f\x00", "g-h", "ﬁ", "日本", "k"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "!", "\x1c"]
    text = lambda n: "".join(rnd.choices(words, [9, 8, 5, 4, 3, 2, 1, 1, 1, 1])[0] + rnd.choice(marks) for _ in range(n))
    rows = [(rnd.choice(["en", "en", "fr", None, "und"]), text(rnd.randrange(0, 90))) for _ in range(60)]
    return rows + [("en", None), (None, None), ("en", ""), ("de", " \t"), ("fr", "a a a a a " * 200)] + rows[:5]


def result(df, **kw):
    return sorted(map(tuple, C.collocations(df, **kw).collect()))


def test_equals_brute_force(frame):
    rows = corpus()
    for min_count, top in ((3, 2000), (8, 7)):
        got = result(frame(rows, "lang string, text string", 4), min_count=min_count, top=top)
        assert got == brute(rows, min_count, top) and got


def test_ties_cut_at_the_smallest_place_and_rank_by_bytes(frame):
    rows = [("x", "é z. z é. a b")] * 5
    got = result(frame(rows, "lang string, text string"), min_count=5)
    assert got == brute(rows, 5) and [r[2] for r in got] == ["a b", "z é", "é z"]


def test_empty_table_other_columns_and_names(frame, spark):
    assert result(frame([], "lang string, text string", 1)) == []
    rows = [(1, "en", "p q", "no", 7) for _ in range(40)]
    df = frame(rows, "f long, w1 string, text string, phrase string, c long").withColumnRenamed("w1", "lang")
    assert result(df) == [("en", 1, "p q", 40, 40, 40, 80, 1000000)]


@pytest.mark.parametrize("size", [16, 40, 100])
def test_slices_count_each_window_once(monkeypatch, size):
    """A text far longer than a slice, with words longer than one, too."""
    monkeypatch.setattr(C, "SLICE", size)
    rnd = random.Random(size)
    for text in ["ab c, d e f g h. " * 30, "x" * 300 + " y z " + "w" * 200 + " v u t s " * 9, " ".join("w%d" % rnd.randrange(5) for _ in range(400))]:
        want, got = Counter(), Counter()
        for piece in re.split("[.,]", text):
            words = piece.split()
            for i in range(len(words)):
                want[tuple((words[i:i + 4] + [""] * 3)[:4])] += 1
        for words, joined, n in C._slices([text.encode()], 4):
            words = words.to_pylist()
            for i in range(n):
                w = [words[i]]
                while len(w) < 4 and joined[i + len(w) - 1]:
                    w.append(words[i + len(w)])
                got[tuple((w + [""] * 3)[:4])] += 1
        assert got == want


def test_full_bitmap_changes_no_result(frame, monkeypatch):
    rows = corpus(9)
    monkeypatch.setattr(C, "MAX_BITS", 64)
    want = brute(rows, 3)
    real = C.pair_bitmap
    monkeypatch.setattr(C, "pair_bitmap", lambda p: ((lambda m, b: (m * 0 + (2 ** 64 - 1), b))(*real(p))))
    assert result(frame(rows, "lang string, text string"), min_count=3) == want


def test_counted_rows():
    import numpy as np
    d = pa.array(["p", "q", "r"])
    got = C._counted("x", d, [np.array([0, 0, 1, 0]), np.array([1, 1, -1, 2]), np.array([2, 2, -1, -1]), np.array([-1, -1, -1, -1])])
    assert sorted(tuple(r.values()) for r in got.to_pylist()) == [("x", "p", "q", "r", "", 2), ("x", "p", "r", "", "", 1), ("x", "q", "", "", "", 1)]
