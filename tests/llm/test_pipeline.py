"""The pipeline against brute force, stage by stage, on a small folder."""

import os
import random

import corpus_pipeline as C
from meterline.llm import quality_rules as Q
from tests.llm.test_rules_and_licenses import brute_measures
from tests.llm.test_simhash import brute_components, brute_fp, signed
from tests.llm.test_text_joins import brute_hits

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def corpus(folder, spark):
    rnd = random.Random(11)
    words = ["w%03d" % i for i in range(400)]
    item = " ".join(rnd.choice(words) for _ in range(20))
    text = lambda n=80: " ".join(rnd.choice(words) for _ in range(n))
    texts = [text() for _ in range(30)]
    texts += [texts[0]] * 5 + [texts[1] + " tail", None, "", "too short", ("again and " * 60), text(30) + " " + item + " " + text(30)]
    texts += [text() + f" write to ab.{i:02d}@mail8.example.com" for i in range(4)] + [text(5000)]
    rows = [(i, t, "en", rnd.choice(["hot", "hot", "b"]), len(t or ""), f"e{i}") for i, t in enumerate(texts)]
    rows.append(rows[2])
    os.makedirs(folder, exist_ok=True)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, [(1, item)]


def test_stages(spark, tmp_path):
    folder = str(tmp_path / "tables")
    rows, items = corpus(folder, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    results = []
    for name, stage in C.STAGES:
        out = stage(spark, docs, folder)
        if name != C.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        results.append(docs.collect())

    def passes(text):
        n, chars, symbols, upper, lines, dup, rep = brute_measures(text)
        return not (n < 50 or 100 * rep > 50 * n or 10 * symbols > 3 * n or (lines >= 4 and 100 * dup > 60 * lines)
                    or chars < 2 * n or chars > 20 * n or 2 * upper > chars)
    want = [r for r in rows if passes(r[1])]
    assert sorted(map(tuple, results[0])) == sorted(want)

    fps = {r[0]: signed(brute_fp(r[1])) for r in want}
    root = brute_components(fps.values())
    first = {}
    for i in sorted(fps):
        first.setdefault(root[fps[i]], i)
    want = sorted({r for r in want if r[0] in first.values()})
    assert sorted(map(tuple, results[1])) == want

    hits = {r[0]: brute_hits(r[1], items) for r in want}
    want = [r for r in want if not (hits[r[0]][1] > 0 and 20 * hits[r[0]][1] >= hits[r[0]][0])]
    assert sorted(map(tuple, results[2])) == want and len(want) < len(results[1])

    by = {r.doc_id: r for r in results[3]}
    assert set(by) == {r[0] for r in want}
    for i, t, _, source, _, extra in want:
        r = by[i]
        assert (r.source, r.extra, r.n_chars) == (source, extra, len(r.text))
        assert r.text == t if "@" not in t else (r.text != t and "mail8" not in r.text and r.text[:300] == t[:300])

    packed = {}
    for r in results[4]:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_words
    assert packed == {i: len(r.text.split()) for i, r in by.items()}


def test_policy_mask_covers_every_rule():
    assert Q.DEFAULT_POLICY.mask == (1 << len(Q.RULES)) - 1


def test_run_on_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert C.run(spark, folder).collect() == []
