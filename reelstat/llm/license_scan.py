"""License scans by diagonal voting.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in lower
case.  Every k-gram of a text's words is hashed with its position and joined to
the positions of the same k-gram in the templates (a fixed, small table).  A
match votes for its diagonal, text position less template position: the words
of one copy of a template lie on one diagonal, or, where words were added or
dropped, on others.  Votes are combined by (text, template, diagonal).  The
matches of one text and template that follow each other in the text and in the
template are joined, however far their diagonals lie apart, as long as the
template's length and ``MAX_GAP`` words more do not lie between two of them.  The
longest such chains are the spans, and one counts if it has at least
``MIN_SHARE`` of the template's k-grams, each met word by word, not by hash alone.

Phrases must be met exactly: every k-gram of the phrase on one diagonal, which
then is the word where the phrase begins.

Votes are bit sets of template positions, so a position seen twice counts once
and repeated rows change nothing.  Only k-grams that match leave the scan.

Defined results: NULL and empty texts have no words and no labels; repeated
rows each give a row with the same result.  An empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, lower_ascii, row_key, written

K = 3
MAX_GAP = 16
MIN_SHARE = 0.6
MAX_GRAMS = 63  # positions of a template are bits of a long


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    exact: bool

    @classmethod
    def of(cls, label: str, text: str, exact: bool = False) -> Template:
        return cls(label, tuple(text.lower().split()), exact)


# The phrases that name a license.
PHRASES = (
    Template.of("mit", "under the mit license", exact=True),
    Template.of("apache-2", "apache license version 2", exact=True),
    Template.of("cc-by-nc", "cc by nc", exact=True),
)

# Passages of public license texts, in this module's words.
PASSAGES = (
    Template.of("mit", "permission is hereby granted free of charge to any person obtaining a copy "
                       "of this software and associated documentation files the software to deal "
                       "in the software without restriction"),
    Template.of("apache-2", "you may not use this file except in compliance with the license you "
                            "may obtain a copy of the license at http www apache org licenses "
                            "license 2 0"),
    Template.of("bsd", "redistribution and use in source and binary forms with or without "
                       "modification are permitted provided that the following conditions are met"),
    Template.of("gpl", "this program is free software you can redistribute it and or modify it "
                       "under the terms of the gnu general public license as published by the free "
                       "software foundation"),
    Template.of("cc-by-nc", "licensed under a creative commons attribution noncommercial "
                            "international license"),
    Template.of("mit", "the above copyright notice and this permission notice shall be included in "
                       "all copies or substantial portions of the software"),
    Template.of("mit", "the software is provided as is without warranty of any kind express or "
                       "implied including but not limited to the warranties of merchantability "
                       "fitness for a particular purpose and noninfringement"),
    Template.of("apache-2", "unless required by applicable law or agreed to in writing software "
                            "distributed under the license is distributed on an as is basis "
                            "without warranties or conditions of any kind either express or "
                            "implied"),
    Template.of("bsd", "redistributions of source code must retain the above copyright notice this "
                       "list of conditions and the following disclaimer"),
    Template.of("bsd", "this software is provided by the copyright holders and contributors as is "
                       "and any express or implied warranties including but not limited to the "
                       "implied warranties of merchantability and fitness for a particular purpose "
                       "are disclaimed"),
    Template.of("gpl", "this program is distributed in the hope that it will be useful but without "
                       "any warranty without even the implied warranty of merchantability or "
                       "fitness for a particular purpose see the gnu general public license for "
                       "more details"),
    Template.of("gpl", "you should have received a copy of the gnu general public license along "
                       "with this program"),
)


def words(text):
    """Lower-cased words of a text column."""
    return F.filter(F.split(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
                    lambda w: w != "")


def template_grams(spark: SparkSession, templates: tuple[Template, ...], k: int) -> DataFrame:
    """A row for each k-gram of the templates: as many as they have words."""
    rows = []
    for number, t in enumerate(templates):
        n = len(t.words) - k + 1
        if not 0 < n <= MAX_GRAMS:
            raise ValueError(f"a template must have {k} to {MAX_GRAMS + k - 1} words: {t.words}")
        rows += [(number, t.label, t.exact, n, i, list(t.words[i:i + k])) for i in range(n)]
    table = spark.createDataFrame(
        rows, "template int, label string, exact boolean, grams int, at int, gram array<string>")
    return table.withColumn("hash", F.xxhash64(*[F.col("gram")[i] for i in range(k)]))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_text(docs, id_col, text_col).select(
        "doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("key"))


def _votes(keyed: DataFrame, templates: tuple[Template, ...], k: int) -> DataFrame:
    """key, template, label, exact, grams, diagonal, votes (bit set)."""
    grams = template_grams(keyed.sparkSession, templates, k)
    w = F.col("words")
    # a row takes its own k words along, not those of the whole text
    own = F.when(F.size(w) >= k, F.transform(
        F.sequence(F.lit(0), F.size(w) - k),
        lambda i: F.struct(F.xxhash64(*[w[i + j] for j in range(k)]).alias("hash"),
                           *[w[i + j].alias(f"w{j}") for j in range(k)])))
    same = F.lit(True)
    for j in range(k):
        same = same & (F.col("own")[f"w{j}"] == F.col("gram")[j])
    return (keyed.select("key", words(F.col("text")).alias("words"))
                 .select("key", F.posexplode(own).alias("position", "own"))
                 .join(F.broadcast(grams), F.col("own.hash") == F.col("hash"))  # the templates' own k-grams
                 .filter(same)
                 .groupBy("key", "template", "label", "exact", "grams",
                          (F.col("position") - F.col("at")).alias("diagonal"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("votes")))


def chains(matches: list[tuple[int, int]], reach: int, least: float) -> list[tuple[int, int]]:
    """(start, length) of the longest chains of ``least`` matches (place in the
    text, place in the template) or more that ascend in both places, with steps
    of at most ``reach`` words of the text; chains do not overlap."""
    # by template place: (text place, length, start) of chains that end there,
    # the longest first; a later one that is as long replaces it
    ends: dict[int, deque] = {}
    found = []
    for position, group in groupby(sorted(matches), lambda m: m[0]):
        new = []
        for _, at in group:
            length, start = 0, position
            for before, some in ends.items():
                while some and some[0][0] < position - reach:
                    some.popleft()
                if before < at and some and (some[0][1], some[0][2]) > (length, start if length else -1):
                    _, length, start = some[0]
            new.append((at, length + 1, start))
        for at, length, start in new:
            some = ends.setdefault(at, deque())
            while some and some[-1][1] <= length:
                some.pop()
            some.append((position, length, start))
            if length >= least:
                found.append((-length, position - start, start, position))
    taken: list[tuple[int, int]] = []
    out = []
    for length, _, start, end in sorted(found):
        i = bisect_left(taken, (start, end))
        if (i == 0 or taken[i - 1][1] < start) and (i == len(taken) or taken[i][0] > end):
            insort(taken, (start, end))
            out.append((start, -length))
    return sorted(out)


def _joined(min_share: float, max_gap: int):
    """Spans of the texts' matches with one template."""
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                matches = [(d["diagonal"] + at, at) for d in r["diagonals"]
                           for at in range(r["grams"]) if d["votes"] >> at & 1]
                least = min_share * r["grams"] - 1e-9
                rows += [(r["key"], r["label"], start, length / r["grams"])
                         for start, length in chains(matches, r["grams"] + max_gap, least)]
            key, label, start, share = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.string()), pa.array(label, pa.string()),
                 pa.array(start, pa.int32()), pa.array(share, pa.float64())],
                ["key", "label", "start", "share"])
    return run


def spans(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + PASSAGES, k: int = K,
          max_gap: int = MAX_GAP, min_share: float = MIN_SHARE, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Verified spans: key (of id and text), label, exact, start (word), share
    (of the template's k-grams)."""
    votes = written(_votes(_keyed(docs, id_col, text_col), templates, k), "votes")
    exact = votes.filter(F.col("exact") & (F.bit_count("votes") == F.col("grams"))) \
        .select("key", "label", "exact", F.col("diagonal").alias("start"), F.lit(1.0).alias("share"))
    # a text's own diagonals of one template, if all together are enough of it
    gathered = (votes.filter(~F.col("exact")).groupBy("key", "template", "label", "grams")
                     .agg(F.bit_or("votes").alias("all"),
                          F.collect_list(F.struct("diagonal", "votes")).alias("diagonals"))
                     .filter(F.bit_count("all") >= F.col("grams") * min_share - 1e-9))
    joined = gathered.select("key", "label", "grams", "diagonals").mapInArrow(
        _joined(min_share, max_gap), "key string, label string, start int, share double")
    return exact.unionByName(joined.withColumn("exact", F.lit(False)))


def scan(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + PASSAGES, k: int = K,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: doc_id, n_words, n_base, first_word, last_word (places of
    phrases), base_labels, labels, score (the best span's share; 0 without)."""
    found = spans(docs, templates, k, id_col=id_col, text_col=text_col)
    at = F.when(F.col("exact"), F.col("start"))
    per_text = found.groupBy("key").agg(
        F.count(at).alias("n_base"), F.min(at).alias("first_word"), F.max(at).alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))).alias("base"),
        F.array_sort(F.collect_set("label")).alias("all"), F.max("share").alias("score"))
    keyed = _keyed(docs, id_col, text_col).select(
        "doc_id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return keyed.join(written(per_text, "labels"), "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce(F.array_join("base", ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join("all", ","), F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
