"""The Merkle manifest against a plain tree in Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from meterline.llm import manifest as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(digests, arity):
    """(root, siblings before and after of each leaf)."""
    proofs = [[] for _ in digests]
    nodes = [(d, [i]) for i, d in enumerate(digests)]
    while len(nodes) > 1:
        up = []
        for a in range(0, len(nodes), arity):
            run = nodes[a:a + arity]
            for j, (_, leaves) in enumerate(run):
                for i in leaves:
                    proofs[i].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1:])))
            up.append((h(*[d for d, _ in run]), sum((x for _, x in run), [])))
        nodes = up
    return nodes[0][0], proofs


def plain_manifest(rows, arity=3):
    """rows of (source, doc_id, leaf) -> sorted (doc_id, leaf, subroot, root, proof)."""
    groups = {}
    for s, i, d in rows:
        groups.setdefault(s, []).append((i is not None, i if i is not None else 0, d, i))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in names:
        leaves = sorted(groups[s])
        subs[s] = (leaves, *plain_tree([x[2] for x in leaves], arity))
    root, tops = plain_tree([subs[s][1] for s in names], arity)
    return sorted(((i, d, subs[s][1], root, tuple(p + t)) for s, t in zip(names, tops)
                   for (_, _, d, i), p in zip(subs[s][0], subs[s][2])), key=repr)


def got_manifest(df, **kw):
    out = M.manifest(df, **kw).select("doc_id", "leaf", "subroot", "root", "witness").collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.witness)) for r in out), key=repr)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 1, "b": 1}, {"a": 9}, {"a": 10, "b": 27, "": 28}, {"hot": 300, None: 4, "é": 82, "z": 3},
                                   {f"s{i}": 1 + i % 4 for i in range(30)}])
def test_equals_plain_tree(frame, sizes):
    """Blocks of 9 leaves, so large groups take several rounds."""
    rnd = random.Random(1)
    rows = [(s, rnd.randrange(10 ** 6) - 500, h(f"{s}{i}")) for s, n in sizes.items() for i in range(n)]
    df = frame(rows, "source string, doc_id long, leaf string", 5)
    for height in (2, 6):
        assert got_manifest(df, height=height) == plain_manifest(rows)


def test_ties_nulls_other_columns_and_arity(frame):
    rows = [("s", 7, h("x"))] * 40 + [("s", None, h("n")), ("s", None, h("m")), (None, 7, h("x")), ("s", 8, h("y"))]
    df = frame([(*r, 5, 6) for r in rows], "source string, doc_id long, leaf string, part long, block string", 4)
    assert got_manifest(df, arity=2, height=2) == plain_manifest(rows, 2)
    assert set(M.manifest(df).columns) == {"source", "doc_id", "leaf", "part", "block", "pos", "witness", "subroot", "root"}


def test_empty_table(spark):
    assert got_manifest(spark.createDataFrame([], "source string, doc_id long, leaf string")) == []


def test_witness_verifies_only_the_leaf(frame):
    rows = [("s%d" % (i % 4), i, h(str(i))) for i in range(100)]
    out = M.manifest(frame(rows, "source string, doc_id long, leaf string"), height=2)
    seen = out.select((M.folded(F.col("leaf"), F.col("witness")) == F.col("root")).alias("ok"),
                      (M.folded(F.sha2(F.col("leaf"), 256), F.col("witness")) == F.col("root")).alias("forged")).collect()
    assert len(seen) == 100 and all(r.ok and not r.forged for r in seen)


def test_leaf_of_every_type(frame):
    rows = [(1, "s", None, 3, "é\nx"), (-2, None, "en", None, ""), (3, "", "", 0, None), (4, "q", "de", 9, "long " * 200_000)]
    df = frame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = df.select("doc_id", M.leaf(*[F.col(c) for c in df.columns]).alias("leaf")).collect()
    assert {r.doc_id: r.leaf for r in got} == {r[0]: plain_leaf(*r) for r in rows}


def test_query_tampering(spark):
    from meterline.llm.queries import op13_manifest
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in op13_manifest(spark, folder).collect():
        d = docs[r.doc_id]
        hit = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and d.text is not None and "\n" in d.text
        assert r.verified == (not hit) and r.leaf == plain_leaf(d.doc_id, d.source, d.lang, d.n_chars, d.text)
