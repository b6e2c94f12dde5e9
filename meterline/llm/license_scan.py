"""License notices by an exact set-similarity join, in SQL functions only.

The blocks are the lines of a text, as sets of words; a template matches a
block that contains at least ``threshold`` of its distinct words.  With
``windows`` they are instead, whatever the line breaks, the runs of
ceil(n / threshold) consecutive words (threshold 0.5 at least), for a template
of n words: a wrapped notice is whole and a long line is not one set.  Texts
are cut in overlapping stretches of twice the longest run, so each run lies in
one, and the join below is on the stretches; the last step tries their runs.

Only words of some template can count, and the join finds every match:

* *order*: template words are ordered by the number of documents that hold
  them, over the whole corpus, rarest first;
* *prefix*: of a template with n words, of which a = ceil(threshold * n) must
  occur, any matching block holds one of the n - a + 1 rarest;
* *length*: a block with fewer than a template words cannot match;
* *position*: a match found at place i of the template's order and place j of
  the block's leaves at most 1 + min(n - i - 1, m - j - 1) words in common;
* what remains is verified by intersecting the two sets.

The join is on single words between the blocks' words and the (small) prefix
index, whichever side the planner broadcasts by its size; blocks without a
prefix word end there.

Phrases (:data:`PHRASES`) are counted apart, as consecutive words anywhere.

Defined cases: null is the empty text, which has no words, no labels and
score 0; repeated rows get equal results; a template without words is
ignored; an empty template table matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterline.llm.common import NON_ALNUM, lower_ascii, stored, text_key

# Phrases and their labels.
PHRASES: tuple[tuple[str, str], ...] = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# Usual notices, one line each.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.8


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "label string, text string")


def normal(text: Column) -> Column:
    """Words separated by single spaces, with one space at both ends; the case
    is kept."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), NON_ALNUM + "+", " ")), F.lit(" "))


def _words(norm: Column) -> Column:
    return F.array_remove(F.split(norm, " "), "")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def scan(docs: DataFrame, notices: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         threshold: float = THRESHOLD, phrases: tuple[tuple[str, str], ...] = PHRASES,
         keep: tuple[str, ...] = (), windows: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``keep``, ``n_words``, ``n_base``
    (places of the phrases), ``first_word`` and ``last_word`` (their smallest
    and largest start, else null), ``base_labels``, ``labels`` (also those of
    matching ``notices`` (label, text); both distinct, sorted, comma-joined) and
    ``score``, the highest containment of a matching template, else 0.  Notices
    match within a line, or with ``windows`` within a run of words."""
    base = _phrases(docs, id_col, text_col, phrases, keep)
    found = stored(_matches(docs.select(F.col(f"`{text_col}`").alias("text")), notices, threshold, windows),
                   "license-matches")
    out = base.join(found, "__key", "left")
    labels = F.array_sort(F.array_distinct(F.concat("__base", F.coalesce("__labels", F.array().cast("array<string>")))))
    return out.select(id_col, *keep, "n_words", "n_base", "first_word", "last_word",
                      F.array_join("__base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
                      F.coalesce("__score", F.lit(0.0)).alias("score"))


def _phrases(docs: DataFrame, id_col: str, text_col: str, phrases, keep) -> DataFrame:
    """Counts and places of the phrases.  The text is cut at the space before
    each place (touching and overlapping places count); the words before the
    first cut and after the last give the places' word numbers."""
    ids = [F.col(f"`{id_col}`").alias("__id"), *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)]]
    out = docs.select(*ids, text_key(F.col(f"`{text_col}`")).alias("__key"), normal(F.col(f"`{text_col}`")).alias("__norm"))
    out = out.withColumns({f"__p{i}": F.split("__norm", f"(?i) (?={phrase} )") for i, (phrase, _) in enumerate(phrases)})
    n_words = F.when(F.trim("__norm") == "", 0).otherwise(_spaces(F.col("__norm")) - 1).cast("long")
    out = out.withColumn("n_words", n_words)
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    count, first, last, labels = zero, [null, null], [null, null], F.array().cast("array<string>")
    for i, (_, label) in enumerate(phrases):
        pieces, size = F.col(f"__p{i}"), F.size(f"__p{i}")
        count = count + size - 1
        first.append(F.when(size > 1, _spaces(pieces[0])).cast("long"))
        last.append(F.when(size > 1, F.col("n_words") - _spaces(F.element_at(pieces, -1))).cast("long"))
        labels = F.concat(labels, F.when(size > 1, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")))
    return out.select(F.col("__id").alias(id_col), *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "__key",
                      "n_words", count.cast("long").alias("n_base"), F.least(*first).alias("first_word"),
                      F.greatest(*last).alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("__base"))


def _matches(docs: DataFrame, notices: DataFrame, threshold: float, windows: bool) -> DataFrame:
    """(__key, __labels, __score) of the texts that hold a matching block."""
    notice = _words(lower_ascii(normal(F.col("text"))))
    run = F.ceil(F.size(notice) / F.lit(max(threshold, 0.5)) - 1e-9).cast("int")
    sets = notices.where("text is not null and label is not null").select(
        "label", F.array_distinct(notice).alias("words"), run.alias("run")).where("size(words) > 0")
    sets = stored(sets.distinct().select(F.xxhash64("label", F.array_join("words", " "), "run").alias("tid"), "label",
                                         "words", "run"), "notices")
    vocabulary = stored(sets.select(F.explode("words").alias("word")).distinct(), "notice-words")

    # order: template words by the number of documents that hold them
    # outer explodes: a test on an array's size would cut the text twice
    seen = docs.select(F.explode_outer(F.array_distinct(_words(lower_ascii(normal(F.col("text")))))).alias("word")) \
        .join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("n"))
    order = stored(vocabulary.join(seen, "word", "left").select(
        "word", F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "word").alias("w")), "notice-order")

    need = F.ceil(F.lit(threshold) * F.size("s") - 1e-9).cast("int")
    ordered = stored(sets.select("tid", "label", "run", F.explode("words").alias("word")).join(order, "word")
                     .groupBy("tid", "label", "run").agg(F.sort_array(F.collect_list("w")).alias("s"))
                     .select("tid", "label", "run", "s", F.size("s").alias("size"), need.alias("need")), "notice-sets")
    prefix = stored(ordered.select("tid", "size", "need", F.posexplode(F.slice("s", F.lit(1), F.col("size") - F.col("need") + 1))
                                   .alias("i", "w")).select("w.word", "tid", "size", "need", "i"), "notice-prefixes")

    # blocks long enough for some template that hold a prefix word of it
    if windows:
        longest = sets.agg(F.max("run")).first()[0] or 1
        word = "[^ ]++ "
        stretch = F.regexp_extract_all(lower_ascii(normal(F.col("text"))),
                                       F.lit(f"(?=((?:{word}){{1,{2 * longest}}}+))(?:{word}){{1,{longest}}}+"), F.lit(1))
        cut = docs.select(text_key(F.col("text")).alias("key"), F.explode_outer(stretch).alias("line"))
        blocks = cut.select("key", _words(F.col("line")).alias("words"))
    else:
        lines = docs.select(text_key(F.col("text")).alias("key"), F.explode_outer(F.split("text", "\n")).alias("line"))
        blocks = lines.select("key", F.array_distinct(_words(lower_ascii(normal(F.col("line"))))).alias("words"))
    short = prefix.groupBy("word").agg(F.min("need").alias("need"))
    hit = blocks.select("key", "words", F.explode_outer("words").alias("word")).join(short, "word") \
        .where(F.size("words") >= F.col("need"))
    told = F.col("words") if windows else F.array_sort("words")
    hit = stored(hit.select("key", F.md5(F.array_join(told, " ")).alias("bid"), "words").distinct(), "blocks")

    # candidate blocks, each once, in the global order
    once = hit.groupBy("bid").agg(F.first("words").alias("words"))
    sorted_blocks = once.select("bid", F.explode(F.array_distinct("words")).alias("word")).join(order, "word") \
        .groupBy("bid").agg(F.sort_array(F.collect_list("w")).alias("b"))
    probe = sorted_blocks.select("bid", "b", F.size("b").alias("m"), F.posexplode("b").alias("j", "w")) \
        .select("bid", "b", "m", "j", "w.word").join(prefix, "word").where(F.col("m") >= F.col("need"))
    first = probe.groupBy("bid", "tid").agg(F.min(F.struct("i", "j")).alias("f"), F.first("b").alias("b"),
                                            F.first("m").alias("m"))
    pairs = first.join(ordered, "tid").where(
        1 + F.least(F.col("size") - F.col("f.i") - 1, F.col("m") - F.col("f.j") - 1) >= F.col("need"))
    common = F.size(F.array_intersect("b.word", "s.word"))
    verified = pairs.select("bid", "label", "size", "need", "run", F.col("s.word").alias("s"), common.alias("c")).where("c >= need")
    if windows:
        best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: F.size(
            F.array_intersect(F.slice("words", i, F.col("run")), F.col("s")))))
        verified = verified.join(once, "bid").select("bid", "label", "size", "need", best.alias("c")).where("c >= need")
    return hit.select("key", "bid").join(verified, "bid").groupBy("key").agg(
        F.collect_set("label").alias("__labels"), F.max(F.col("c") / F.col("size")).alias("__score")) \
        .withColumnRenamed("key", "__key")
