"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

A text is described by statistics of its whole length (``FEATURES``): how long
words and lines are, which share of the bytes is capital, digit, punctuation or
beyond ASCII, how often a mark is doubled, how often a word or a line repeats
the one before it or any before it, how uneven bytes and words are spread.  They
are standardised by the training rows' exact mean and deviation, clipped to
``CLIP`` deviations, and sent through ``FOURIER`` random cosines, whose inner
products approximate a Gaussian kernel of width ``WIDTH`` (in deviations, times
the root of the number of statistics).

The normal equations of a ridge regression on these cosines are sums over rows:
every partition adds up its own, Spark adds the partitions' rows of the matrix,
and the driver solves one system of ``FOURIER`` + 1 unknowns.  Cosines are
rounded to 1 / ``STEP``, so the sums are sums of integers: the same to the last
bit however the rows are dealt out or a lost task is repeated.

The ridge scores of training rows that the equations did not see (one in
``CALIBRATE``, by a hash of the id) are counted on a grid of 1 / ``GRID``, and
pooled adjacent violators give the isotonic share of label 1; a score is read
off between the blocks' means in a straight line.

At scale: texts are read once, where they are, and leave a short row of
statistics, which is written; labels are joined to that.  All labelled rows are
learnt from.  The driver gets FOURIER + 1 rows of the matrix, the moments of the
statistics, and the occupied cells of the grid, whatever the input.

Defined results: NULL and empty texts have the statistics of no words and are
scored like any other; a label that is NULL or not 0 or 1 is not learnt from,
nor is one without an id; of several labels for an id the largest holds; rows
that repeat an id are all learnt from; without training rows every score is 0.5,
and where the rows of the equations or of the calibration are of one class (or
none) every score is the share of label 1 among all training rows.  An empty
table gives an empty result.  A text of any length is read in pieces of
``PIECE`` characters that end between words.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, id_text, written

FEATURES = (
    "log_words", "word_length", "long_words", "letters", "capitals", "digits", "enders",
    "commas", "shouts", "other_marks", "non_ascii", "spaces", "control", "doubled_marks",
    "byte_entropy", "same_as_before", "distinct_words", "common_word", "bare_marks",
    "capital_words", "marked_words", "line_words", "repeated_lines", "sentence_words")
UNIT = 1_000_000  # statistics are stored as whole millionths
CLIP = 6.0
FOURIER, WIDTH, SEED = 256, 1.0, 11
STEP = 4096
RIDGE = 1e-4  # per training row
CALIBRATE, GRID = 4, 512
THRESHOLD = 0.3
PIECE = 1_000_000

_CLASS = np.zeros(256, np.int64)  # 0: anything else
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                             b"0123456789", b".?;:", b",", b"!", b"\"#$%&'()*+-/<=>@[\\]^_`{|}~",
                             b" \t\n\r\x0b\x0c"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 9
_CLASSES = 10
_MARK = (_CLASS >= 4) & (_CLASS <= 7)
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACE = re.compile(r"\s")


def pieces(text: str, most: int = PIECE):
    """``text`` cut before white space, in pieces of about ``most`` characters."""
    at = 0
    while len(text) - at > most:
        space = _SPACE.search(text, at + most)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


class _Counts:
    """What the statistics of one text are made from, piece by piece."""

    def __init__(self):
        self.bytes = np.zeros(256, np.int64)
        self.doubled = self.same = 0
        self.words: Counter = Counter()
        self.lines: Counter = Counter()
        self.last_byte, self.last_word, self.open_line = 0, None, xxhash.xxh3_64()

    def add(self, piece: str) -> None:
        raw = np.frombuffer(piece.encode("utf-8", "replace"), np.uint8)
        if not len(raw):
            return
        self.bytes += np.bincount(raw, minlength=256)
        seen = np.concatenate([[self.last_byte], raw])
        self.doubled += int(((seen[1:] == seen[:-1]) & _MARK[raw]).sum())
        self.last_byte = raw[-1]
        words = piece.split()
        if words:
            self.same += sum(map(str.__eq__, words, words[1:])) + (words[0] == self.last_word)
            self.last_word = words[-1]
            self.words.update(words)
        first, *rest = piece.split("\n")  # a line may span pieces
        self.open_line.update(first.encode("utf-8", "replace"))
        for line in rest:
            self.lines[self.open_line.intdigest()] += 1
            self.open_line = xxhash.xxh3_64(line.encode("utf-8", "replace"))

    def statistics(self) -> list[float]:
        lines = self.lines.copy()
        lines[self.open_line.intdigest()] += 1
        n = int(self.bytes.sum())
        kinds = np.bincount(_CLASS, weights=self.bytes, minlength=_CLASSES)
        total = sum(self.words.values())
        letters = capital = bare = marked = long_ = 0
        for word, times in self.words.items():
            letters += times * len(word)
            if len(word) > 12:
                long_ += times
            if word.isalpha():
                capital += times * (word[0].isupper() and len(word) > 1 and word.isupper())
            else:
                core = word.strip(_MARKS)
                bare += times * (not core)
                marked += times * (len(word) - len(core) > 1)
                capital += times * (len(core) > 1 and core.isupper())
        share = self.bytes[self.bytes > 0] / max(n, 1)
        some, many = max(n, 1), max(total, 1)
        alphabetic = max(kinds[1] + kinds[2], 1)
        n_lines = sum(lines.values())
        return [
            np.log1p(total), np.log1p(letters / many), long_ / many,
            (kinds[1] + kinds[2] + kinds[9]) / some, kinds[2] / alphabetic, kinds[3] / some,
            kinds[4] / some, kinds[5] / some, kinds[6] / some, kinds[7] / some, kinds[9] / some,
            kinds[8] / some, kinds[0] / some, self.doubled / some,
            float(-(share * np.log2(share)).sum()), self.same / many,
            np.log1p(len(self.words)) / np.log1p(many), max(self.words.values(), default=0) / many,
            bare / many, capital / many, marked / many, np.log1p(total / n_lines),
            1 - len(lines) / n_lines, np.log1p(total / (kinds[4] + 1))]


def statistics(text: str) -> list[int]:
    """The statistics of a text in whole millionths."""
    counts = _Counts()
    for piece in pieces(text):
        counts.add(piece)
    return [round(float(x) * UNIT) for x in counts.statistics()]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x (whole millionths) for rows of doc_id, text."""
    def run(batches):
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<long>")


@dataclass
class Model:
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None
    prior: float = 0.5

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """Whole numbers: the random cosines (and a one) times STEP."""
        rng = np.random.default_rng(SEED)
        slope = rng.normal(0, 1 / (WIDTH * np.sqrt(x.shape[1])), (x.shape[1], FOURIER))
        phase = rng.uniform(0, 2 * np.pi, FOURIER)
        z = np.clip((x - self.centre) / self.scale, -CLIP, CLIP)
        return np.column_stack([np.rint(np.cos(z @ slope + phase) * STEP), np.full(len(x), STEP)])

    def ridge_scores(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.knots is None:
            return np.full(len(x), self.prior)
        return np.interp(self.ridge_scores(x), *self.knots)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(float).reshape(len(column), len(FEATURES))


def isotonic(place: np.ndarray, ones: np.ndarray, rows: np.ndarray):
    """Pooled adjacent violators over ascending places: the blocks' mean places
    and shares of ones."""
    blocks: list[list[float]] = []  # rows, ones, rows * place
    for p, one, n in zip(place.tolist(), ones.tolist(), rows.tolist()):
        blocks.append([n, one, n * p])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    n, one, at = np.array(blocks).T
    return at / n, one / n


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The matrix and right side over ``rows`` (x, label), as exact sums."""
    size = FOURIER + 1

    def run(batches):
        total = np.zeros((size, size + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 16):  # below 2^53: exact as doubles
                part = batch.slice(at, 1 << 16)
                if part.num_rows:
                    z = model.cosines(_matrix(part["x"]))
                    y = part["label"].to_numpy().astype(float) * STEP
                    total += (z.T @ np.column_stack([z, y])).astype(np.int64)
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size, dtype=np.int32)),
                 pa.ListArray.from_arrays(np.arange(size + 1, dtype=np.int32) * (size + 1),
                                          pa.array(total.reshape(-1)))], ["line", "sums"])

    lines = rows.select("x", "label").mapInArrow(run, "line int, sums array<long>")
    # one row of the matrix is a key; its parts are added where it is shuffled to
    summed = lines.groupBy("line").agg(*[
        F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size + 1)])
    total = np.zeros((size, size + 1))
    for r in summed.collect():
        total[r["line"]] = r[1:]
    return total[:, :-1] / STEP ** 2, total[:, -1] / STEP ** 2


def _exact_in_sums(weights: np.ndarray) -> np.ndarray:
    """Weights rounded so that their sums with whole numbers up to STEP are exact:
    a score then does not depend on the batch that a row is scored in."""
    unit = 2.0 ** (np.floor(np.log2(max(np.abs(weights).sum() * STEP, 1e-300))) - 51)
    return np.rint(weights / unit) * unit


def learn(rows: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0,
          label_col: str = "quality") -> Model:
    """Learn from labelled ``rows`` (doc_id, x) whose crc32 of the id leaves
    another remainder."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                           F.col(label_col).cast("int").alias("label"))
                   .filter("doc_id is not null and label in (0, 1)")
                   .groupBy("doc_id").agg(F.max("label").alias("label")))
    train = written(rows.join(known, "doc_id")
                        .filter(crc_remainder(F.col("doc_id"), modulus) != held_out)
                        .withColumn("fit", F.pmod(F.xxhash64(F.lit("fit"), "doc_id"),
                                                  F.lit(CALIBRATE)) != 0), "train")
    # one row for each (fold, label)
    n = {(r["fit"], r["label"]): r["n"]
         for r in train.groupBy("fit", "label").agg(F.count("*").alias("n")).collect()}
    if not n:
        return Model()
    model = Model(prior=sum(v for (_, y), v in n.items() if y) / sum(n.values()))
    if len(n) < 4:
        return model
    fit = train.filter("fit")
    wide = [F.col("x")[i].cast("decimal(19,0)") for i in range(len(FEATURES))]
    moments = fit.agg(F.count("*"), *[F.sum(c) for c in wide], *[F.sum(c * c) for c in wide]).first()
    count, k = moments[0], len(FEATURES)
    model.centre = np.array([float(s) / count for s in moments[1:k + 1]])
    # exact: count * sum of squares - square of the sum
    spread = [count * int(q) - int(s) ** 2 for s, q in zip(moments[1:k + 1], moments[k + 1:])]
    model.scale = np.maximum(np.sqrt(np.array(spread, float)) / count, 1.0)
    matrix, right = _normal_equations(fit, model)
    penalty = np.full(FOURIER + 1, RIDGE * count)
    penalty[-1] = 0
    model.weights = _exact_in_sums(np.linalg.solve(matrix + np.diag(penalty), right) / STEP)

    def ridge(batches):
        for batch in batches:
            if batch.num_rows:
                s = model.ridge_scores(_matrix(batch["x"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.rint(s * GRID).astype(np.int64)), batch["label"]],
                    ["cell", "label"])

    cells = (train.filter("not fit").select("x", "label").mapInArrow(ridge, "cell long, label int")
                  .groupBy("cell").agg(F.sum("label").alias("ones"), F.count("*").alias("n"))
                  .orderBy("cell").collect())  # scores are bounded by the weights: a bounded grid
    place, ones, n = np.array([tuple(r) for r in cells], float).T
    model.knots = isotonic(place / GRID, ones, n)
    return model


def score(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for rows of doc_id, x."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array(model.scores(_matrix(batch["x"])))],
                    ["doc_id", "score"])
    return rows.mapInArrow(run, "doc_id long, score double")


def score_held_out(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0,
                   threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality") -> DataFrame:
    """Every row: doc_id, held_out, score, predicted."""
    rows = written(features(id_text(docs, id_col, text_col)), "statistics")
    model = learn(rows, labels, modulus, held_out, label_col)
    return score(rows, model).select(
        "doc_id", (crc_remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
