"""Spelling variants: words one edit apart, found in k-d trees of letter counts.

Words are counted over the whole corpus.  Two are near if one inserted, deleted
or replaced code point makes one of the other.  Such an edit moves the counts of
at most two letters by one: between words of equal length one count falls and
one rises (or none moves), and the longer of two words of unequal length has one
letter more.  So the near words of a word lie in a small box around its letter
counts, once for each pair of lengths.

The words of a length are held in a k-d tree over their letter counts (code
points modulo 32, which keeps an edit's box).  Its upper part is drawn on the
driver from a sample of at most ``SAMPLE`` words of the length and names the
leaves; every word is sent to the leaves that its boxes reach, for its own length
and the two beside it.  In a task the leaf's words go on into a k-d tree of their
own, and the words sent there run down it together, each node passing on those
whose box it cuts.  What meets in a bucket is compared by its counts, and what is
left has its letters verified in order.  The sample only shapes the leaves: every
word is indexed and the search is exact.

At scale: a word goes to the few leaves of its boxes (some dozen of many
thousand).  A leaf of more words than ``HELD``, which no plane can cut if they
are all anagrams, is dealt into pieces by hash, and so are the words sent to it;
each pair of pieces is a task's work, and no task holds more than a piece.
What a task returns is, for each word sent, how many near words there were and
the best of them, never the pairs; the parts are added up map-side.

Defined results: a NULL text has no words, a NULL id is written as an empty text
in the hash that thins letters, repeated rows count each, an empty table gives an
empty result.  Texts are read in pieces that end between words, and words may
have any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, slices, written

RUN = re.compile(r"[A-Za-z\u00C0-\u00FF]+")
NOT_RUN = re.compile(r"[^A-Za-z\u00C0-\u00FF]")
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: One run in so many (by hash) loses a letter.
THINNED = 199
DIMENSIONS = 32
#: Words of a length that the upper tree is drawn from, words that a leaf should
#: have, and the most that one task holds of a leaf's words and of those sent there.
SAMPLE, LEAF, HELD, SENT = 16384, 2048, 65536, 16384
#: Bytes of words that one task holds or compares; words in a bucket of its tree.
LEAF_BYTES, BUCKET = 8 << 20, 32
PIECE, DISTINCT = 1_000_000, 200_000
PAIRS = 1 << 16


# --- words and their counts ---------------------------------------------------

def pieces(text: str, most: int = PIECE):
    """``text`` in pieces of about ``most`` characters that cut no run."""
    at = 0
    while len(text) - at > most:
        stop = NOT_RUN.search(text, at + most)
        end = stop.start() if stop else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def runs(doc_id: int | None, text: str, least: int = MIN_LENGTH,
         thinned: int = THINNED) -> Counter:
    """The words of one text with their numbers, shorter ones left out."""
    seen: Counter = Counter()
    for piece in pieces(text):
        seen.update(RUN.findall(piece.encode().lower().decode()))
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    out: Counter = Counter()
    for word, n in seen.items():
        if len(word) < least:
            continue
        h = zlib.crc32(word.encode(), start)
        if h % thinned == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
            if len(word) < least:
                continue
        out[word] += n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                least: int = MIN_LENGTH, times: int = MIN_COUNT) -> DataFrame:
    """word, n of the words with enough letters and occurrences."""
    def run(batches):
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if text.is_valid:
                    seen.update(runs(doc_id.as_py(), text.as_py(), least))
                    if len(seen) > DISTINCT:
                        yield flush()
        yield flush()

    ship_package(docs.sparkSession)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.col(text_col).cast("string").alias("text"))
                .mapInArrow(run, "word string, n long")
                .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times))


# --- letters ------------------------------------------------------------------

def letter_matrix(words: list[str]) -> np.ndarray:
    """Words of equal length, a row each: their code points, all below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """For each row how often each code point modulo DIMENSIONS occurs."""
    n, length = letters.shape
    out = np.zeros((n, DIMENSIONS), np.int32)
    step = max(1, (1 << 22) // max(length, 1))
    for at in range(0, n, step):
        part = letters[at:at + step]
        place = np.arange(len(part))[:, None] * DIMENSIONS + part % DIMENSIONS
        out[at:at + step] = np.bincount(
            place.reshape(-1), minlength=len(part) * DIMENSIONS).reshape(-1, DIMENSIONS)
    return out


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of letters whether each of ``a`` is one edit from that of ``b``."""
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    n = a.shape[1]
    if n == b.shape[1]:
        return (a != b).sum(1) == 1
    # the longer one's first letters agree up to some place, its last ones from there
    front = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return front + back >= n


def box(words: int, others: int) -> tuple[int, int]:
    """By how much the other words' counts may fall below and rise above, in all."""
    return (1, 1) if words == others else (0, 1) if others > words else (1, 0)


# --- trees --------------------------------------------------------------------

@dataclass
class Node:
    """A box of letter counts (bounds included), cut in two or a numbered leaf."""
    low: np.ndarray
    high: np.ndarray
    halves: tuple[Node, Node] | None = None
    number: int = 0
    rows: np.ndarray | None = None


def plane(counts: np.ndarray) -> tuple[int, int] | None:
    """(letter, cut) that halves the rows as evenly as any letter allows: counts
    up to ``cut`` on one side.  None if all rows are alike."""
    n, best = len(counts), None
    middle = np.partition(counts, (n - 1) // 2, axis=0)[(n - 1) // 2]
    for cut in (middle, middle - 1):
        uneven = np.abs(2 * (counts <= cut).sum(0) - n)
        letter = int(uneven.argmin())
        if uneven[letter] < n and (best is None or uneven[letter] < best[0]):
            best = int(uneven[letter]), letter, int(cut[letter])
    return best and best[1:]


def build(counts: np.ndarray, most: float, tight: bool) -> Node:
    """A k-d tree whose leaves have at most ``most`` rows where a plane can cut
    them.  ``tight``: boxes are those of the rows; else the planes bound them,
    so that the leaves divide everything there is."""
    leaves = 0

    def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> Node:
        nonlocal leaves
        some = counts[rows]
        if tight:
            low, high = some.min(0), some.max(0)
        cut = plane(some) if len(rows) > most else None
        if cut is None:
            leaves += 1
            return Node(low, high, number=leaves - 1, rows=rows if tight else None)
        letter, at = cut
        under, over = high.copy(), low.copy()
        under[letter], over[letter] = at, at + 1
        below = some[:, letter] <= at
        return Node(low, high, (grow(rows[below], low, under), grow(rows[~below], over, high)))

    return grow(np.arange(len(counts)), np.zeros(DIMENSIONS, np.int32),
                np.full(DIMENSIONS, np.iinfo(np.int32).max, np.int32))


def reached(tree: Node, counts: np.ndarray, fall: int, rise: int):
    """(leaf, rows of ``counts`` whose box meets the leaf's)."""
    todo = [(tree, np.arange(len(counts)))]
    while todo:
        node, rows = todo.pop()
        some = counts[rows]
        rows = rows[(np.maximum(some - node.high, 0).sum(1) <= fall)
                    & (np.maximum(node.low - some, 0).sum(1) <= rise)]
        if not len(rows):
            continue
        if node.halves:
            todo += [(half, rows) for half in node.halves]
        else:
            yield node, rows


class Words:
    """Words of one length, ready to be searched."""

    def __init__(self, words: list[str], n: list[int]):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words = [words[i] for i in order]  # so that numbers are in code-point order
        self.n = np.array([n[i] for i in order], np.int64)
        self.letters = letter_matrix(self.words)
        self.counts = letter_counts(self.letters)
        self.tree = build(self.counts, BUCKET, tight=True)

    def pairs(self, letters: np.ndarray):
        """(row of ``letters``, number of a word one edit from it), in blocks."""
        fall, rise = box(letters.shape[1], self.letters.shape[1])
        counts = letter_counts(letters)
        block = max(1, PAIRS // BUCKET)
        for leaf, rows in reached(self.tree, counts, fall, rise):
            mine = self.counts[leaf.rows]
            alike = (leaf.low == leaf.high).all()
            step = max(1, PAIRS // len(leaf.rows)) if alike else max(
                1, min(block, PAIRS * 8 // (len(leaf.rows) * DIMENSIONS)))
            for at in range(0, len(rows), step):
                some = rows[at:at + step]
                if alike:  # the box was the words' counts
                    close = np.ones((len(some), len(leaf.rows)), bool)
                else:
                    gap = counts[some][:, None] - mine[None]
                    close = ((np.maximum(gap, 0).sum(2) <= fall)
                             & (np.maximum(-gap, 0).sum(2) <= rise))
                a, b = close.nonzero()
                a, b = some[a], leaf.rows[b]
                width = max(1, LEAF_BYTES // (4 * max(letters.shape[1], 1)))
                for i in range(0, len(a), width):
                    x, y = a[i:i + width], b[i:i + width]
                    near = one_edit(letters[x], self.letters[y])
                    if near.any():
                        yield x[near], y[near]

    def best(self, words: list[str]):
        """For those of ``words`` (of one length) that have near words here: their
        rows, how many, and the number of the one with the largest n (the first
        of several)."""
        found = list(self.pairs(letter_matrix(words)))
        if not found:
            return np.zeros((3, 0), np.int64)
        a, b = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((b, -self.n[b], a))
        a, b = a[order], b[order]
        rows, first, times = np.unique(a, return_index=True, return_counts=True)
        return rows, times, b[first]


# --- the search in Spark ------------------------------------------------------

def key_of(length: int, leaf: int) -> int:
    return length << 32 | leaf


@dataclass
class Forest:
    """The lengths that occur, and upper trees of those with many words."""
    lengths: frozenset[int]
    trees: dict[int, Node]

    def leaves(self, counts: np.ndarray, length: int, fall: int = 0, rise: int = 0):
        """(key, rows of ``counts``) of the leaves of a length that are reached."""
        if length not in self.lengths:
            return
        if length not in self.trees:
            yield key_of(length, 0), np.arange(len(counts))
            return
        for leaf, rows in reached(self.trees[length], counts, fall, rise):
            yield key_of(length, leaf.number), rows


def by_length(words: list[str]):
    """(length, row numbers) of the lengths among ``words``."""
    sizes = np.array([len(w) for w in words])
    for length in np.unique(sizes):
        yield int(length), np.flatnonzero(sizes == length)


def forest(words: DataFrame, leaf: int = LEAF, sample: int = SAMPLE) -> Forest:
    """Upper trees for the lengths with more than ``leaf`` words."""
    sizes = words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n"))
    # a row for each length that occurs
    sizes = {r["length"]: r["n"] for r in sizes.collect()}
    many = {length: min(1.0, sample / n) for length, n in sizes.items() if n > leaf}
    if not many:
        return Forest(frozenset(sizes), {})

    def count(batches):
        for batch in batches:
            texts = batch["word"].to_pylist()
            for length, rows in by_length(texts):
                c = letter_counts(letter_matrix([texts[i] for i in rows]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([length] * len(c), pa.int32()),
                     pa.array([r.tobytes() for r in c], pa.binary())], ["length", "counts"])

    spark = words.sparkSession
    shares = spark.createDataFrame([(k, int(v * (1 << 30))) for k, v in many.items()],
                                   "length int, share long")
    some = (words.withColumn("length", F.length("word")).join(F.broadcast(shares), "length")
                 .filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < F.col("share"))
                 .select("word").mapInArrow(count, "length int, counts binary").collect())
    trees = {}
    for length, share in many.items():
        c = [np.frombuffer(r["counts"], np.int32) for r in some if r["length"] == length]
        if c:
            # some rows of the sample in each leaf, or what a full leaf should show
            trees[length] = build(np.stack(c), max(4.0, leaf * share), tight=False)
    return Forest(frozenset(sizes), trees)


def _routed(words: DataFrame, trees: Forest) -> DataFrame:
    """key, sent, word, n: each word where it is held, and where it is sent."""
    def run(batches):
        for batch in batches:
            texts, n = batch["word"].to_pylist(), batch["n"]
            for length, rows in by_length(texts):
                counts = letter_counts(letter_matrix([texts[i] for i in rows]))
                found = [(key, False, part) for key, part in trees.leaves(counts, length)]
                for other in (length - 1, length, length + 1):
                    found += [(key, True, part) for key, part in
                              trees.leaves(counts, other, *box(length, other))]
                for key, sent, part in found:
                    at = pa.array(rows[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), key)), pa.array([sent] * len(part)),
                         batch["word"].take(at), n.take(at)], ["key", "sent", "word", "n"])

    return words.mapInArrow(run, "key long, sent boolean, word string, n long")


def _searched(routed: DataFrame, piece: int, sent: int) -> DataFrame:
    """word, n_near, form_n, form: parts of the answer, from each pair of pieces."""
    length = F.shiftright("key", 32)
    held = F.greatest(F.lit(1), F.least(F.lit(piece), F.floor(F.lit(LEAF_BYTES) / length)))
    sizes = written(
        routed.groupBy("key").agg(F.count(F.when(~F.col("sent"), 1)).alias("held"),
                                  F.count(F.when(F.col("sent"), 1)).alias("sent_n"))
              .filter("held > 0")
              .select("key", F.ceil(F.col("held") / held).cast("int").alias("pieces"),
                      F.ceil(F.col("sent_n") / sent).cast("int").alias("shares")), "leaf-sizes")
    own = F.when(F.col("sent"), F.col("shares")).otherwise(F.col("pieces"))
    other = F.when(F.col("sent"), F.col("pieces")).otherwise(F.col("shares"))
    dealt = (routed.join(sizes, "key")
                   .withColumn("own", F.pmod(F.xxhash64("word"), own).cast("int"))
                   .withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
                   .select("key", F.when(F.col("sent"), F.col("other")).otherwise(F.col("own"))
                           .alias("piece"),
                           F.when(F.col("sent"), F.col("own")).otherwise(F.col("other"))
                           .alias("share"), "sent", "word", "n"))
    group = ["key", "piece", "share"]

    def run(batches):
        now, words, n, index = None, [], [], None
        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in group], axis=1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                if now != (name := tuple(keys[a])):
                    now, words, n, index = name, [], [], None
                part = batch.slice(a, b - a)
                # a group's words come before those sent to them
                first = part.num_rows - int(part["sent"].true_count)
                words += part["word"][:first].to_pylist()
                n += part["n"][:first].to_pylist()
                asked = part["word"][first:].to_pylist()
                if not asked or not words:
                    continue
                index = index or Words(words, n)
                for _, rows in by_length(asked):
                    mine = [asked[i] for i in rows]
                    at, times, best = index.best(mine)
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([mine[i] for i in at], pa.string()), pa.array(times),
                             pa.array(index.n[best]),
                             pa.array([index.words[i] for i in best], pa.string())],
                            ["word", "n_near", "form_n", "form"])

    return (dealt.repartition(slices(routed.sparkSession), *group)
                 .sortWithinPartitions(*group, "sent")
                 .mapInArrow(run, "word string, n_near long, form_n long, form string"))


def near_words(words: DataFrame, leaf: int = LEAF, sample: int = SAMPLE, piece: int = HELD,
               sent: int = SENT) -> DataFrame:
    """word, n_near, form_n, form (the near word of largest n; of several the
    first in code-point order) for the rows of ``words`` (word, n) that have one."""
    routed = written(_routed(words, forest(words, leaf, sample)), "routed")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return (_searched(routed, piece, sent).groupBy("word")
            .agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", (-F.col("best.less")).alias("form_n"),
                    F.col("best.form").alias("form")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of ``forms`` (word, form) lead in the end.

    Each round doubles the steps taken.  Forms have larger n, so there are no
    circles, and n grows by ``RATIO`` a step: a few rounds."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(now.join(step, "root", "left"), "roots")
        if moved.filter("next is not null").isEmpty():
            return now
        now = moved.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(docs: DataFrame, ratio: int = RATIO, least: int = MIN_LENGTH,
                      times: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text",
                      leaf: int = LEAF, sample: int = SAMPLE, piece: int = HELD,
                      sent: int = SENT) -> DataFrame:
    """Every word: word, form, root, n, n_near, form_n."""
    words = written(word_counts(docs, id_col, text_col, least, times), "words")
    near = near_words(words, leaf, sample, piece, sent)
    is_form = F.col("form_n") >= ratio * F.col("n")
    found = written(words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("form")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("form_n")).alias("form_n")), "variants")
    ends = roots(found.filter("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
