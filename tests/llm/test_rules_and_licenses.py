import random
import re
from collections import Counter
from math import ceil

from pyspark.sql import functions as F

from meterline.llm import license_scan as L
from meterline.llm import quality_rules as Q
from meterline.llm import url_filter as U


# quality rules ---------------------------------------------------------------

def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    rep = {i + j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(re.findall("[A-Z]", text)), len(lines),
            len(lines) - len(set(lines)), len(rep))


def test_ledger(frame):
    rnd = random.Random(0)
    texts = [None, "", " \n\x0b", "a", "a b", "a b c", "a a a a", "a b c a b c", "x é 𝔘 #|<>\n\nx é\nx é", "𝔘𝔘 Ñ", "ab c a bc ab c"]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 80))) for _ in range(40)]
    texts += ["\n".join(rnd.choice(["One line", "two", " ", ""]) for _ in range(9)) for _ in range(20)] + ["w " * 50000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b c", "y"), (0, None, "x")]
    docs = frame(rows, "doc_id long, text string, n_words string")
    got = Q.ledger(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "a b c" if r.doc_id is None else texts[r.doc_id]
        assert tuple(r[m] for m in Q.MEASURES) == brute_measures(text), text
        assert bool(r.fail_bits & 1) == (r.n_words < 50)
    kept = Q.apply_policy(docs, Q.Policy("any", 1, 0))
    assert kept.columns == docs.columns and kept.count() == len(rows)
    few = Q.apply_policy(docs, Q.Policy("few", 1, 1)).collect()
    assert sorted(r.doc_id for r in few) == [i for i, t in enumerate(texts) if brute_measures(t)[0] >= 50]
    assert Q.ledger(frame([], docs.schema)).collect() == [] and Q.apply_policy(frame([], docs.schema)).collect() == []


def test_repeats_are_exact_when_hashes_collide(frame, monkeypatch):
    monkeypatch.setattr(Q, "_hash", lambda a, b, d: Q.F.lit(0).cast("long"))  # every window a candidate of every other
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("abcd") for _ in range(n)) for n in (2, 3, 4, 9, 30, 60, 90)] + ["a b c d e f g h i", "ab c a bc ab c", None]
    got = Q.ledger(frame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {i: brute_measures(t)[-1] for i, t in enumerate(texts)}


def test_policies_and_ablation(frame):
    led = frame([(i, b) for i, b in enumerate([0, 0, 1, 3, 4, 6, 64])], "doc_id long, fail_bits long")
    pols = (Q.Policy("a", 1, 0b11), Q.Policy("a", 2, 0b1000111, 2))
    got = {r.doc_id: (r.kept_a_v1, r.kept_a_v2) for r in Q.verdicts(led, pols).collect()}
    assert got == {0: (True, True), 1: (True, True), 2: (False, True), 3: (False, False), 4: (True, True), 5: (False, False), 6: (True, True)}
    abl = {(r.policy, r.version, r.rule): (r.n_fail, r.n_rejected, r.n_kept_without) for r in Q.ablation(led, pols).collect()}
    assert abl["a", 1, "few_words"] == (2, 3, 1) and abl["a", 1, "repeated_words"] == (2, 3, 1)
    assert abl["a", 2, "symbols"] == (2, 2, 1) and len(abl) == 6


# URL rules -------------------------------------------------------------------

def brute_url(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules
           if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_urls(frame, spark):
    rnd = random.Random(8)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "xa.com", "org", "a.org", "ñ.org", "A.com", "a..com", ".com", "com."]
    paths = ["", "/", "/x", "/x/", "/x/y", "/x/yz", "/xé", "/x\U0010ffff", "/x\U0010ffffy", "//", "/X"]
    rules = {(rnd.choice(hosts).lower(), rnd.choice(paths)): rnd.choice(["allow", "block"]) for _ in range(40)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"http://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?a=/x", "#x", "z")]
    urls += [None, "", "no scheme/x", "://", "a://b://c.com/x", "http://a.com", "x\n://a.com/x\ny?z"] + ["http://a.com/x/y"] * 50
    rows = list(enumerate(urls)) + [(None, "http://b.a.com/x/yz")]
    pages = frame(rows, "page_id long, url string").withColumns({"host": F.lit("h"), "grp": F.lit("g"), "verdict": F.lit(1)})
    df = U.judge(pages, spark.createDataFrame([*rules, (None, "/", "block"), ("a.com", None, "block")], U.RULE_SCHEMA))
    assert df.columns == ["page_id", "url", "grp", "host", "path", "rule", "verdict"]
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_url(r.url, rules), r.url
    assert {r.verdict for r in U.judge(pages, spark.createDataFrame([], U.RULE_SCHEMA), default="block").collect()} == {"block"}
    assert U.judge(pages.where("false"), spark.createDataFrame(rules, U.RULE_SCHEMA)).collect() == []


# licenses --------------------------------------------------------------------

def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_license(text, notices, threshold=0.8):
    w, places, labels = words_of(text), [], set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    base, score = sorted(labels), 0.0
    for line in (text or "").split("\n"):
        block = set(words_of(line))
        for label, t in notices:
            tw = set(words_of(t))
            if tw and len(tw & block) >= ceil(threshold * len(tw) - 1e-9):
                labels.add(label)
                score = max(score, len(tw & block) / len(tw))
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted(labels)), score)


def test_licenses(frame, spark):
    rnd = random.Random(1)
    notices = [*L.TEMPLATES, ("one", "apache"), ("none", " . "), ("one", "apache"), ("two", "Alpha beta gamma delta epsilon")]
    vocab = "alpha beta gamma delta epsilon apache the license cc by all rights reserved general public x é".split()
    texts = [None, "", "...", "CC BY cc-by CC BY", "all rights reserved", "x All Rights\nReserved y", "ccby cc byé İcc by Kcc by",
             "Released under the MIT License.", "license MIT the; released", "GENERAL PUBLIC LICENSE " * 2000]
    texts += [t for _, t in L.TEMPLATES] + [t.upper() + " extra words" for _, t in L.TEMPLATES]
    texts += ["\n".join(" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 9))) for _ in range(4)) for _ in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "apache", 2), (3, texts[3], 1)]
    docs = frame(rows, "doc_id long, text string, label int").withColumns({"bid": F.lit(1), "words": F.lit("w")})
    got = L.scan(docs, spark.createDataFrame(notices, "label string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "apache" if r.doc_id is None else texts[r.doc_id]
        want = brute_license(text, notices)
        assert tuple(r)[1:-1] == want[:-1] and abs(r.score - want[-1]) < 1e-12, text
    empty = spark.createDataFrame([], "label string, text string")
    assert {r.labels for r in L.scan(docs.where("doc_id = 7"), empty).collect()} == {""}
    assert L.scan(docs.where("false"), L.templates(spark)).collect() == []


def brute_windows(text, notices, threshold=0.8):
    w, labels, score = words_of(text), set(), 0.0
    for label, t in notices:
        tw = set(words_of(t))
        run = ceil(len(words_of(t)) / threshold - 1e-9)
        n = max((len(tw & set(w[i:i + run])) for i in range(len(w))), default=0)
        if tw and n >= ceil(threshold * len(tw) - 1e-9):
            labels.add(label)
            score = max(score, n / len(tw))
    return labels, score


def test_licenses_in_windows(frame, spark):
    rnd = random.Random(5)
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    mpl = ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL "
           "was not distributed with this\n * file, You can obtain one")
    album = "The album was released in 1999 under the band's own label after the distributor lost its license"
    notices = [*L.TEMPLATES, ("two", "alpha beta gamma delta epsilon"), ("rep", "x x x é é"), ("none", " . ")]
    vocab = "alpha beta gamma delta epsilon released under the mit license x é".split()
    filler = "some other words of a long line " * 3000
    texts = [None, "", "...", bsd, mpl, album, filler + album, filler + bsd + " " + filler, "\n".join(bsd.split()),
             "license MIT the; released", "released " * 5000 + "under the license"]
    texts += [" ".join(rnd.choice(vocab) for _ in range(n)) for n in range(120)]
    texts += ["a " * n + notices[n % 9][1].replace(" ", "\n") + " b" * 50 for n in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, bsd)]
    docs = frame(rows, "doc_id long, text string")
    got = L.scan(docs, spark.createDataFrame(notices, "label string, text string"), phrases=(), windows=True).collect()
    assert len(got) == len(rows)
    for r in got:
        labels, score = brute_windows(texts[r.doc_id], notices)
        assert (set(filter(None, r.labels.split(","))), round(r.score, 9)) == (labels, round(score, 9)), texts[r.doc_id][-300:]
    by = {r.doc_id: r.labels for r in got}
    assert (by[3], by[4], by[5], by[6], by[7], by[8]) == ("bsd", "mpl-2.0", "", "", "bsd", "bsd")
    empty = spark.createDataFrame([], "label string, text string")
    assert {r.labels for r in L.scan(docs.where("doc_id = 3"), empty, phrases=(), windows=True).collect()} == {""}
