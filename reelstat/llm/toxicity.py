"""Toxicity from class-conditional Kneser-Ney models over characters.

Each word, between a begin and an end sign, is a string of characters.  Two
models, one learnt from toxic and one from ordinary texts, give it a
log-likelihood: character n-grams of order ``ORDER`` are counted by class, and
what a class has not seen backs off to lower orders that both classes share
(continuation counts of the pooled n-grams), so a rare or inflected expression
is judged by its parts.  Both models use modified Kneser-Ney discounts.

As the lower orders are shared they cancel in the difference of the two
log-likelihoods unless an n-gram or its context was seen, so what workers need
is one number per n-gram and one per context.  These are written as sorted hash
arrays and memory-mapped (``key_counts``).

A text has three features: the difference of its log-likelihoods per token
(length-normalised, so that long texts are no likelier toxic than short ones)
and those of its two most toxic spans, a span being one word.  A logistic
regression turns them into a score between 0 and 1.  It is fitted on labelled
rows that the n-grams were not counted from.

Learning reads at most ``PER_CLASS`` labelled rows of each class, those with the
smallest hashes of their ids; whole texts, no cap on their length.  Every text
is scored, by its text alone.

Defined results: NULL and empty texts have features zero; a row whose label is
NULL is not learnt from; of several labels for an id the largest holds; where
one class has no rows to learn from every score is the share of toxic rows (0
without labels).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import ascii_words, crc_remainder, id_text, lower_ascii, slices, written
from .key_counts import KEY, SortedArrays, stored
from .ngram_lm import discounts
from .subwords import text_slices

ORDER = 6
PER_CLASS = 4000
THRESHOLD = 0.7
BEGIN, STOP = "\x02", "\x03"
SEED = 42
SLICE_BYTES = 2_000_000
#: N-grams and words whose scores a worker remembers.
KNOWN_GRAMS, KNOWN_WORDS = 200_000, 300_000
RIDGE = 1e-2
FEATURES = "doc_id long, mean double, first double, second double"


def grams(word: str, order: int = ORDER) -> list[str]:
    """The n-gram that ends at each character of the word and at its end."""
    s = BEGIN + word + STOP
    return [s[max(0, i - order):i] for i in range(2, len(s) + 1)]


def _class_counts(words: DataFrame, order: int) -> DataFrame:
    """words (word, toxic, ordinary) to gram, toxic, ordinary."""
    s = F.concat(F.lit(BEGIN), "word", F.lit(STOP))
    ends = F.sequence(F.lit(2), F.length("s"))
    cut = F.transform(ends, lambda i: F.col("s").substr(
        F.greatest(i - order + 1, F.lit(1)), F.least(i, F.lit(order))))
    return (words.withColumn("s", s).select(F.explode(cut).alias("gram"), "toxic", "ordinary")
                 .groupBy("gram").agg(F.sum("toxic").alias("toxic"),
                                      F.sum("ordinary").alias("ordinary")))


def _discounts(table: DataFrame, column: str) -> np.ndarray:
    row = table.agg(*[F.count(F.when(F.col(column) == i, 1)) for i in (1, 2, 3, 4)]).first()
    return discounts(np.array(list(row)))


def _less(column: str, d: np.ndarray):
    """Count less its discount."""
    c = F.col(column)
    off = F.when(c == 1, float(d[1])).when(c == 2, float(d[2])).otherwise(float(d[3]))
    return F.greatest(c - off, F.lit(0.0))


def _context(column: str, d: np.ndarray, name: str) -> list:
    """Total of a context's counts, and the mass that its discounts leave."""
    c = F.col(column)
    left = F.when(c == 0, 0.0).when(c == 1, float(d[1])).when(c == 2, float(d[2])) \
            .otherwise(float(d[3]))
    return [F.sum(c).alias(name + "_total"), F.sum(left).alias(name + "_left")]


def _front():
    return F.col("gram").substr(F.lit(1), F.length("gram") - 1)


def _back():
    return F.col("gram").substr(F.lit(2), F.length("gram"))


def _shared(top: DataFrame, order: int) -> DataFrame:
    """gram, low: the shared probability of every n-gram of order - 1 that the
    seen n-grams continue, from the lowest order up."""
    levels, grams_above = [], top
    for _ in range(order - 1):
        below = written(grams_above.select(_back().alias("gram")).filter(F.length("gram") > 0)
                                   .groupBy("gram").agg(F.count("*").alias("n")), "level")
        levels.append(below)
        grams_above = below
    characters = max(1, levels[-1].count())
    shared = None
    for level in reversed(levels):
        d = _discounts(level, "n")
        context = level.groupBy(_front().alias("front")).agg(*_context("n", d, "all"))
        rows = (level.withColumn("front", _front()).withColumn("back", _back())
                     .join(context, "front"))
        low = F.lit(1.0 / (characters + 1))
        if shared is not None:
            rows = rows.join(shared.select(F.col("gram").alias("back"), F.col("low").alias("l")),
                             "back", "left")
            low = F.coalesce("l", low)
        shared = written(rows.select("gram", (
            (_less("n", d) + F.col("all_left") * low) / F.col("all_total")).alias("low")), "shared")
    return shared


@dataclass
class Model:
    table: SortedArrays | None
    order: int
    weights: np.ndarray | None = None  # of the features and 1, after centring
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    prior: float = 0.0

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary) for each word."""
        scored = self.__dict__.setdefault("_scored", {})
        new = [w for w in words if w not in scored]
        if len(scored) + len(new) > KNOWN_WORDS:
            scored.clear()
            new = words
        if new:
            scored.update(zip(new, self._word_scores(new).tolist()))
        return np.array([scored[w] for w in words])

    def _word_scores(self, words: list[str]) -> np.ndarray:
        known = self.__dict__.setdefault("_known", {})
        if len(known) > KNOWN_GRAMS:
            known.clear()
        cut = [grams(w, self.order) for w in words]
        new = list({g for gs in cut for g in gs if g not in known})
        if new:
            keys = np.array([xxhash.xxh64_intdigest(k.encode(), SEED) for g in new
                             for k in ("g" + g, "c" + g[:-1])], KEY)
            order = np.argsort(keys)
            found, value = np.empty(len(keys), bool), np.empty(len(keys))
            place, values = self.table.find(keys[order])
            found[order], value[order] = place >= 0, values[:, 0]
            best = np.where(found[::2], value[::2], value[1::2])
            known.update(zip(new, best.tolist()))
        at = known.__getitem__
        return np.array([sum(map(at, gs)) for gs in cut])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def features(self, texts: list[str]) -> np.ndarray:
        number: dict[bytes, int] = {}
        per_text = [[number.setdefault(w, len(number)) for w in t.encode().lower().split()]
                    for t in texts]
        if self.table is None:
            return np.zeros((len(texts), 3))
        scores = self.word_scores([w.decode() for w in number])
        out = np.zeros((len(texts), 3))
        for i, ids in enumerate(per_text):
            if ids:
                s = scores[ids]
                out[i, 0] = s.sum() / (len(s) + 1)
                top = np.partition(s, -2)[-2:] if len(s) > 1 else [0.0, s[0]]
                out[i, 1:] = top[1], top[0]
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.prior)
        x = np.column_stack([(features - self.centre) / self.scale, np.ones(len(features))])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -500, 500)))


def _features(docs: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                f = model.features(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], *[pa.array(c) for c in f.T]],
                    ["doc_id", "mean", "first", "second"])
    return docs.select("doc_id", "text").mapInArrow(run, FEATURES)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights by Newton's method; the ridge (not on the constant, per row)
    keeps them finite where the classes are separable."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(y) / 10)
    penalty[-1] = 1e-9
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty + 1e-12),
                               x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1,
          order: int = ORDER, per_class: int = PER_CLASS) -> Model:
    """Learn from labelled rows of ``docs`` (doc_id, text) whose crc32 of the id
    leaves another remainder."""
    spark = docs.sparkSession
    buckets = slices(spark)
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                           F.col("toxic").cast("int").alias("label"))
                   .filter("doc_id is not null and label in (0, 1)")
                   .filter(crc_remainder(F.col("doc_id"), modulus) != held_out)
                   .groupBy("doc_id").agg(F.max("label").alias("label")))
    some = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id")
                 .limit(per_class) for c in (0, 1)]
    # at most 2 * per_class pairs of numbers
    sample = written(docs.join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
                         .withColumn("fit", F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(4)) == 0),
                     "sample")
    n = {(r["label"], r["fit"]): r["n"]
         for r in sample.groupBy("label", "fit").agg(F.count("*").alias("n")).collect()}
    toxic, all_rows = sum(k for (c, _), k in n.items() if c), sum(n.values())
    prior = toxic / all_rows if all_rows else 0.0
    if any((c, f) not in n for c in (0, 1) for f in (False, True)):
        return Model(None, order, prior=prior)

    words = (sample.filter("not fit")
             .select("label", F.explode(ascii_words(lower_ascii(F.col("text")))).alias("word"))
             .groupBy("word").agg(F.sum("label").alias("toxic"),
                                  F.sum(1 - F.col("label")).alias("ordinary")))
    top = written(_class_counts(words, order), "grams")
    shared = _shared(top, order)
    d = {c: _discounts(top, c) for c in ("toxic", "ordinary")}
    context = written(top.groupBy(_front().alias("front")).agg(
        *[x for c in d for x in _context(c, d[c], c)]), "contexts")
    rows = (top.withColumn("front", _front()).withColumn("back", _back())
               .join(context, "front")
               .join(shared.select(F.col("gram").alias("back"), "low"), "back"))

    def p(c):
        seen = (F.when(F.col(c) > 0, _less(c, d[c])).otherwise(0.0)
                + F.col(c + "_left") * F.col("low")) / F.col(c + "_total")
        return F.when(F.col(c + "_total") > 0, seen).otherwise(F.col("low"))

    def backed(c):
        return F.when(F.col(c + "_total") > 0, F.col(c + "_left") / F.col(c + "_total")) \
                .otherwise(1.0)

    values = rows.select(F.xxhash64(F.concat(F.lit("g"), "gram")).alias("key"),
                         F.log(p("toxic") / p("ordinary")).alias("value")) \
        .unionByName(context.select(F.xxhash64(F.concat(F.lit("c"), "front")).alias("key"),
                                    F.log(backed("toxic") / backed("ordinary")).alias("value")))
    folder = scratch_path(spark, "llm", f"toxicity-{uuid.uuid4().hex}")
    model = Model(SortedArrays.of(stored(values, folder, buckets)), order, prior=prior)

    fit = sample.filter("fit").select("doc_id", "text")
    # at most 2 * per_class rows of a few numbers
    rows = _features(fit, model).join(sample.filter("fit").select("doc_id", "label"), "doc_id") \
        .select("mean", "first", "second", "label").collect()
    x, y = np.array([r[:3] for r in rows]), np.array([r[3] for r in rows], float)
    model.centre, model.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    model.weights = fit_logistic(
        np.column_stack([(x - model.centre) / model.scale, np.ones(len(x))]), y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for rows of doc_id, text."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                p = model.probability(model.features(part["text"].to_pylist()))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(p)],
                                                 ["doc_id", "score"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def score_held_out(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1,
                   threshold: float = THRESHOLD, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Every row: doc_id, held_out, score, predicted."""
    base = id_text(docs, id_col, text_col)
    model = learn(base, labels, modulus, held_out)
    return score(base, model).select(
        "doc_id", (crc_remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all columns.

    Rows are scored where they are: nothing but the verdict is added to them,
    and no join brings them back together."""
    model = learn(id_text(docs, id_col, text_col), labels)
    text = F.coalesce(F.col(text_col), F.lit(""))

    @F.pandas_udf("double")
    def toxic(texts):
        parts = [model.probability(model.features(texts.iloc[i:i + 200].tolist()))
                 for i in range(0, len(texts), 200)]
        return type(texts)(np.concatenate(parts) if parts else np.zeros(0))

    return docs.filter(toxic(text) < threshold)
