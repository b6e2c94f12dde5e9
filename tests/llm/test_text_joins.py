import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from meterline.llm import chat, decontaminate as D, warc

# decontamination -------------------------------------------------------------


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(text, items):
    w, hit, found = words_of(text), set(), set()
    for i, t in items:
        b = words_of(t)
        n = min(13, len(b))
        wins = {tuple(b[j:j + n]) for j in range(len(b) - n + 1)} if n else set()
        for j in range(len(w) - n + 1) if n else ():
            if tuple(w[j:j + n]) in wins:
                hit |= set(range(j, j + n))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_contamination(frame, monkeypatch):
    rnd = random.Random(6)
    word = lambda: rnd.choice(["the", "of", "a", "é", "x1", "Zü", "q"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([13, 13, 14, 20, 40, 12, 7, 5, 3])]
    items += [(20, None), (21, " .. "), (22, items[0][1]), (22, items[0][1]), (23, "One")]
    texts = [None, "", "one", "one two", " ".join(["the"] * 200), "x" * 3000]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 30)))]
        for _ in range(rnd.randint(0, 3)):
            b = words_of(rnd.choice(items)[1])
            lo = rnd.randint(0, max(0, len(b) - 5))
            parts += [rnd.choice([", ", "\n", " - "]).join(b[lo:lo + rnd.randint(3, 25)]), " ".join(word() for _ in range(rnd.randint(0, 9)))]
        texts.append(" ".join(parts))
    texts.append("pad " * 30000 + items[3][1].upper() + " pad" * 30000)
    rows = [(i, t, "e") for i, t in enumerate(texts)] + [(None, items[4][1], "n"), (0, None, "e")]
    docs = frame(rows, "doc_id long, text string, n_hit string")
    got = D.contamination(docs, frame(items, "item_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, found = brute_hits(items[4][1] if r.doc_id is None else texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.items, r.n_items) == (n, hit, found, len(found))
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    kept = D.clean(docs, frame(items, "item_id long, text string"))
    assert kept.columns == docs.columns
    bad = {r.doc_id for r in got if r.contaminated}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.doc_id not in bad)
    nothing = frame([], "item_id long, text string")
    assert {r.n_hit for r in D.contamination(docs, nothing).collect()} == {0} and D.clean(docs, nothing).count() == len(rows)
    assert D.contamination(docs.where("false"), nothing).collect() == []


def test_blocks_do_not_matter(monkeypatch):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["aa", "b", "ccc"]) for _ in range(rnd.randint(0, 60))).encode() for _ in range(8)]
    whole = D.Texts(texts)
    want = [(a, f) for at, fp in whole.windows(9, None) for a, f in zip(at.tolist(), fp.tolist())]
    monkeypatch.setattr(D, "_BLOCK", 32)
    cut = D.Texts(texts)
    assert (cut.hashes == whole.hashes).all()
    assert [(a, f) for at, fp in cut.windows(9, None) for a, f in zip(at.tolist(), fp.tolist())] == want


# chat ------------------------------------------------------------------------

def test_chat(frame, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 3)
    rnd = random.Random(2)
    convs = {i: [(rnd.choice(["user", "assistant"]), rnd.choice(["a", "b", "<|x|>"])) for _ in range(rnd.randint(1, 9))] for i in range(60)}
    for i in range(60, 100):  # snapshots and copies
        src = convs[rnd.randrange(60)]
        convs[i] = src[:rnd.randint(1, len(src))]
    convs[200] = [("user", None), (None, "x")]
    convs[201] = [("user", "")]
    convs[None] = [("user", "without id")] * 4
    rows = [(c, t, role, text, "x") for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    df = frame(rows, "conv_id long, turn long, role string, text string, part string")
    out = defaultdict(dict)
    for r in chat.format_chats(df).collect():
        out[r.conv_id][r.part] = r.text
    flat = {c: [(r or "", t or "") for r, t in turns] for c, turns in convs.items()}
    keep = {}
    for c, t in flat.items():
        longer = any(len(o) > len(t) and o[:len(t)] == t for o in flat.values())
        same = [k for k, o in flat.items() if o == t and k is not None]
        if not longer and (c is None or c == min(same)):
            keep[c] = "".join(f"<|im_start|>{r}\n{x.replace('<|', '< |')}<|im_end|>\n" for r, x in t)
    assert {c: "".join(p[k] for k in sorted(p)) for c, p in out.items()} == keep
    assert chat.format_chats(frame([], df.schema)).collect() == []


def test_chat_ties(frame):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "b"), (1, None, "system", "s"), (2, None, "system", "s")]
    got = chat.format_chats(frame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id for r in got} == {1} and sum(r.n_turns for r in got) == 3


def test_chat_crowded(frame, spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 3)
    rows = [(None, i % 4 or None, "user", f"t{i % 7}") for i in range(100)] + [(None, 2, "user", "same")] * 100
    rows += [(7, 5000 + i, "user", str(i)) for i in range(5)]
    df = frame(rows, "conv_id long, turn long, role string, text string")
    on = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(on)
    spark.conf.set(on, "false")
    try:
        pre = chat.turn_prefixes(df)
        groups = pre.groupBy("conv", "chunk").count().where("conv is null").collect()
        assert len(groups) > 1 and max(r["count"] for r in groups) < 150
        assert sorted(r.place for r in pre.where("conv is null").collect()) == list(range(1, 201))
        got = chat.format_chats(df).collect()
    finally:
        spark.conf.set(on, before)
    assert {r.part for r in got if r.conv_id == 7} == {1666, 1667, 1668}
    hot = sorted((r.part, r.n_turns, r.text) for r in got if r.conv_id is None)
    assert [p for p, _, _ in hot] == list(range(67)) and [n for _, n, _ in hot] == [3] * 66 + [2]
    texts = re.findall(r"user\n(.*?)<", "".join(t for _, _, t in hot))
    for want in (None, 1, 2, 3):
        mine = sorted(t for c, n, _, t in rows if c is None and n == want)
        assert sorted(texts[:len(mine)]) == mine
        texts = texts[len(mine):]
    assert texts == []


# WARC ------------------------------------------------------------------------

def b32(data):
    import base64
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_round_trip(frame, spark):
    mark = "WARC/1.1\r\nWARC-Type: response\r\n\r\n"
    html = [None, "", "<p>é𝔘</p>", "same", "same", "ends with break\r\n", mark + "x", mark, "WARC/1.1", "a WARC/1.1\r\n", "WARC/\r\n5\r\n1.1\r\n" + mark,
            "\r\n\r\n", "line\nline\r\n\r\nHTTP/1.1", "x" * 200000, mark * 50]
    rows = [(i, f"http://h.org/{i}?q=WARC/1.1", h, "e") for i, h in enumerate(html)]
    rows += [(90, None, "same", "e"), (91, "http://h.org/a\r\nX: y", "u", "e"), (None, "http://n.org", "same", "e"), (3, "http://h.org/3?q=WARC/1.1", "same", "e")]
    pages = frame(rows, "page_id long, url string, html string, type string")
    for compression in ("gzip", "none"):
        path = warc.scratch_archive(spark)
        warc.write(warc.records(warc.captures(pages)), path, compression)
        recs = warc.read(spark, path)
        assert recs.where("not complete").count() == 0 and recs.count() == 3 * len(rows)
        caps = warc.assemble(recs).withColumn("body", warc.payload_of(F.col("response.block"))).collect()
        assert len(caps) == len(rows)
        by = defaultdict(list)
        for c in caps:
            assert len(c.requests) == len(c.metadata) == 1
            by[bytes(c.metadata[0].block).decode()].append(c)
        first = {}
        for i, _, h, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
            first.setdefault(h or "", i)
        for i, url, h, _ in rows:
            c = by[f"capture: {'' if i is None else i}\r\n"][0]
            data = (h or "").encode()
            assert c.response.digest == "sha1:" + b32(data)
            assert c.uri == (url and url.replace("\r", "%0D").replace("\n", "%0A"))
            if first[h or ""] == i:
                assert c.response.type == "response" and bytes(c.body) == data and c.response.refers_to is None
            else:
                assert c.response.type == "revisit" and c.response.refers_to == next(x.capture_id for x in by[f"capture: {first[h or '']}\r\n"])


def test_warc_chains_and_short_blocks(frame, spark):
    recs = frame([("response", "r", None, "R"), ("request", "q", "r", "Q"), ("metadata", "m", "q", "M"), ("metadata", "lost", "gone", "L")],
                 "type string, id string, concurrent_to string, block string")
    recs = recs.withColumns({c: F.lit(None).cast("string") for c in ("uri", "refers_to", "digest")}).withColumn("complete", F.lit(True))
    rows = warc.assemble(recs).collect()
    (cap,) = [r for r in rows if r.capture_id]
    assert [x.block for x in cap.requests] == ["Q"] and [x.block for x in cap.metadata] == ["M"]
    (orphan,) = [r for r in rows if not r.capture_id]
    assert orphan.response is None and [x.block for x in orphan.metadata] == ["L"]
    path = warc.scratch_archive(spark)
    bad = spark.createDataFrame([("WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nshort",)], "value string")
    warc.write(bad, path, "none")
    assert [r.complete for r in warc.read(spark, path).collect()] == [False]
    path = warc.scratch_archive(spark)
    warc.write(warc.records(warc.captures(frame([], "page_id long, url string, html string"))), path)
    assert warc.assemble(warc.read(spark, path)).collect() == []


RECS = "type string, id string, concurrent_to array<string>, block string"


def assembled(frame, rows):
    recs = frame(rows, RECS).withColumns({c: F.lit(None).cast("string") for c in ("uri", "refers_to", "digest")})
    out = warc.assemble(recs.withColumn("complete", F.lit(True))).collect()
    return sorted(((r.capture_id or "", r.response.id if r.response else None, tuple(x.oid for x in r.requests), tuple(x.oid for x in r.metadata))
                   for r in out), key=repr)


def test_warc_links_of_any_length_and_number(frame):
    chain = [("metadata", f"m{i:02d}", [f"m{i - 1:02d}"] if i else ["q"], "x") for i in range(20)]
    rows = [("response", "r", [], "R"), ("request", "q", ["other", "r"], "Q"), *chain,
            ("response", "s", ["t"], "S"), ("request", "t", [], "T"), ("metadata", "u", ["t"], "U"),  # named by the answer
            ("resource", "v", None, "V"), ("metadata", "w", ["r", "v"], "W"), ("revisit", "y", [], "Y")]
    assert assembled(frame, rows) == [("r", "r", ("q",), (*[f"m{i:02d}" for i in range(20)], "w")), ("s", "s", ("t",), ("u",)),
                                      ("v", "v", (), ("w",)), ("y", "y", (), ())]


def test_warc_loses_no_record(frame):
    """Orphans, a ring, a hot missing id, other types and records without id are rows of their own."""
    rows = [("request", "a", ["gone"], ""), ("metadata", "b", ["c"], ""), ("metadata", "c", ["b"], ""), ("request", None, ["r"], ""),
            ("response", "r", [], ""), ("response", None, [], ""), ("warcinfo", "i", [], ""), (None, None, None, "")]
    rows += [("metadata", f"d{i}", ["dead"], "") for i in range(50)]
    got = assembled(frame, rows)
    assert len(got) == len(rows) and ("r", "r", (), ()) in got and ("", "i", (), ()) in got and ("", None, ("a",), ()) in got
    assert all(len(r[2]) + len(r[3]) <= 1 for r in got)


def test_warc_versions_binary_payloads_and_strays(spark):
    from pyspark.sql import Row
    body = bytes(range(256)) * 3 + b"\nWARC/1.1\r\nx\xff" + b"\r\n"
    pages = spark.createDataFrame([Row(page_id=i, url="http://h/" + str(i), html=b) for i, b in enumerate([body, b"", b"\xff\xfe", b"WARC/1.0"])])
    path = warc.scratch_archive(spark)
    warc.write(warc.records(warc.captures(pages)), path, "none")
    recs = warc.read(spark, path)
    assert recs.count() == 12 and recs.where("not complete").count() == 0
    caps = warc.assemble(recs).select(warc.payload_of(F.col("response.block")).alias("body")).collect()
    assert sorted(bytes(c.body) for c in caps) == sorted([body, b"", b"\xff\xfe", b"WARC/1.0"])
    old = ("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <u:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
           "WARC/1.1\r\nwarc-type: request\r\nWARC-Record-ID: <u:2>\r\nWARC-Concurrent-To: <u:9>\r\nwarc-concurrent-to:<u:1>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
           "WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <u:3>\r\nContent-Length: 99\r\n\r\nshort\nWARC/1.stray\r\n\r\n")
    path = warc.scratch_archive(spark)
    spark.createDataFrame([(old,)], "value string").write.option("lineSep", "\n").text(path)
    got = {r.id: r for r in warc.read(spark, path).collect()}
    assert got["u:1"].complete and bytes(got["u:1"].block) == b"abc" and got["u:2"].complete and got["u:2"].concurrent_to == ["u:9", "u:1"]
    assert not got["u:3"].complete and not got[None].complete and len(got) == 4
    caps = warc.assemble(warc.read(spark, path)).collect()
    assert {r.capture_id for r in caps} == {"u:1", None} and [x.oid for r in caps if r.capture_id for x in r.requests] == ["u:2"]
