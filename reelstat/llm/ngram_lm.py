"""Interpolated modified Kneser-Ney model of any order, counted in Spark.

Tokens: words are runs of characters that are not ASCII white space, with A-Z
in lower case; every text ends with an end token, and its first word's context
is a start token (a context only, never counted as a token).

1. Words are counted by their 64-bit XXH64; the sorted array of these hashes is
   the vocabulary, and a word's place in it is its number.
2. For k = 2 to the order, k-grams are counted by the number of their first
   k - 1 words and that of the last (two times 32 bits, exact), made uniform by
   a bijection; a k-gram's place in the sorted array is its number.
3. From the distinct k-grams, from the highest k down: how many words stand
   before the last k - 1 words (continuations), and how many followers of the
   first k - 1 words were seen once, twice, or more, and their total.

All are written as sorted arrays into the shared folder and memory-mapped by the
workers that score (``key_counts``); the driver only sees the list of files and
the counts of counts.  No count is pruned.  With a the count of an n-gram of the
highest order, or of one that begins a text, and the continuations of any other,
and discounts D1, D2, D3+ of each order from these,

    p(w | h) = (max(a(h w) - D, 0) + (D1 n1(h) + D2 n2(h) + D3 n3(h)) p(w | h')) / a(h .)
    p(w)     = (max(k(w) - D', 0) + (D'1 m1 + D'2 m2 + D'3 m3) / (V + 1)) / K

with h' the context h less its first word, k(w) the number of words that w
follows, K their sum, and V distinct tokens; the one more stands for unknown
words.  Where h was not seen, p(w | h') holds.  Contexts do not reach back over
the start token.

Defined results: NULL and empty texts are the end token alone; repeated rows
count each; without training texts every token has probability 1 / (V + 1) = 1.
"""

from __future__ import annotations

import itertools
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import crc_remainder, id_text, release_memory, ship_package, slices
from .key_counts import (BLOBS, KEY, SortedArrays, ascending, blobs, distinct, file_values,
                         merged, mix, unmix)
from .subwords import text_slices

START, END = b" start", b" end"  # no word contains a space
HALF = np.uint64(32)
LOW = np.uint64((1 << 32) - 1)
SLICE_BYTES = 5_000_000  # a slice's arrays take some thirty times as much memory
LEAST = 0.01


def _parts(batches):
    """The slices of a task's batches."""
    release_memory()
    for batch in batches:
        yield from text_slices(batch, "text", SLICE_BYTES)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words (START and END are the first two); the
    texts as numbers of these, each with its START and END; and where they begin."""
    # both functions change or split at ASCII alone; a text's ends may give empty words
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    words = split.flatten()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    some = pc.not_equal(words, "")
    text, words = text[some.to_numpy(zero_copy_only=False)], words.filter(some).dictionary_encode()
    # the array's own list of them takes several times longer
    known = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, itertools.chain((START, END), known)),
                         KEY, 2 + len(known))
    ends = np.cumsum(np.bincount(text, minlength=len(texts)) + 2)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(texts) else \
        np.zeros(0, np.int64)
    flat = np.empty(int(ends[-1]) if len(texts) else 0, np.int64)
    flat[begins], flat[ends - 1] = 0, 1
    flat[np.arange(len(text)) + 2 * text + 1] = words.indices.to_numpy().astype(np.int64) + 2
    return hashes, flat, begins


def _count_words(buckets: int):
    def run(batches):
        for part in _parts(batches):
            hashes, flat, _ = tokens(part["text"].to_pylist())
            yield blobs(*distinct(hashes, np.bincount(flat, minlength=len(hashes))), buckets)
    return run


def _numbers(vocabulary: SortedArrays, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in the vocabulary (-1: unknown) and count of each hash."""
    order = np.argsort(hashes)
    place, counts = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
    place[order], found = vocabulary.find(hashes[order])
    counts[order] = found[:, 0]
    return place, counts


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first.astype(KEY) << HALF | second.astype(KEY))


def _since(size: int, begins: np.ndarray) -> np.ndarray:
    """How many tokens of its text stand before each token."""
    start = np.zeros(size, np.int64)
    start[begins] = begins
    return np.arange(size) - np.maximum.accumulate(start)


def _grams(words: np.ndarray, since: np.ndarray, lower: np.ndarray, k: int):
    """The tokens that end a k-gram of known words and a known context, and the
    keys of these; ``lower``: numbers of the (k - 1)-grams that end at each token."""
    at = np.flatnonzero((since >= k - 1) & (words >= 0))
    at = at[lower[at - 1] >= 0]
    return at, _pairs(lower[at - 1], words[at])


def _numbered(tables: list[SortedArrays], words: np.ndarray, since: np.ndarray):
    """For the words and each table of k-grams, k = 2 and up: the number of the
    k-gram that ends at each token (-1: none or not seen) and its count."""
    numbers = words
    for k, table in enumerate(tables, 2):
        at, keys = _grams(words, since, numbers, k)
        place, values = table.lookup(keys)
        numbers, counts = np.full(len(words), -1), np.zeros(len(words), np.int64)
        numbers[at], counts[at] = place, values[:, 0]
        yield numbers, counts


def _count_grams(vocabulary: SortedArrays, tables: list[SortedArrays], buckets: int):
    """Counts of the k-grams next above those of ``tables``."""
    def run(batches):
        for part in _parts(batches):
            hashes, flat, begins = tokens(part["text"].to_pylist())
            words, since = _numbers(vocabulary, hashes)[0][flat], _since(len(flat), begins)
            lower = words
            for lower, _ in _numbered(tables, words, since):
                pass
            _, keys = _grams(words, since, lower, len(tables) + 2)
            keys, counts = np.unique(keys, return_counts=True)
            yield blobs(keys, counts, buckets)
    return run


def _tails(tables: list[SortedArrays], keys: np.ndarray) -> np.ndarray:
    """Numbers of the k-grams of the last of ``tables``, named by their keys, less
    their first word."""
    pairs = unmix(keys)
    words = (pairs & LOW).astype(np.int64)
    if len(tables) == 1:
        return words
    heads = _tails(tables[:-1], tables[-2].keys_at((pairs >> HALF).astype(np.int64)))
    return tables[-2].lookup(_pairs(heads, words))[0]


def _first_words(tables: list[SortedArrays], numbers: np.ndarray) -> np.ndarray:
    """Numbers of the first words of the k-grams of the last of ``tables``."""
    for table in reversed(tables):
        numbers = (unmix(table.keys_at(numbers)) >> HALF).astype(np.int64)
    return numbers


def _followers(tables: list[SortedArrays], adjusted: SortedArrays | None, below: int,
               buckets: int):
    """Blobs of (continuations, n1, n2, n3, total) of the (k - 1)-grams, of which
    there are ``below``, in a bucket of k-grams (the last of ``tables``), whose
    own counts are their continuations in ``adjusted``, if given."""
    def run(batches):
        for batch in batches:
            for file in batch.to_pylist():
                release_memory()
                path, n = file["path"], file["n"]
                keys = np.fromfile(path + ".keys", KEY)
                if adjusted is None:
                    counts = file_values(path, n, file["kind"])[:, 0]
                else:
                    counts = adjusted.values_at(tables[-1].offset(path) + np.arange(n))[:, 0]
                tails, before = np.unique(_tails(tables, keys), return_counts=True)
                heads = (unmix(keys) >> HALF).astype(np.int64)
                order = np.argsort(heads)
                heads, counts = heads[order], counts[order]
                first = np.flatnonzero(np.diff(heads, prepend=-1))
                heads = heads[first]
                some = ascending(np.concatenate([tails, heads]))
                rows = np.zeros((len(some), 5), np.int64)
                rows[np.searchsorted(some, tails), 0] = before
                at = np.searchsorted(some, heads)
                for column, values in enumerate(
                        (counts == 1, counts == 2, counts >= 3, counts), 1):
                    rows[at, column] = np.add.reduceat(values.astype(np.int64), first)
                yield blobs(some.astype(KEY), rows, buckets, below)
    return run


def _starts(tables: list[SortedArrays], start: int, buckets: int):
    """Blobs like those of ``_followers``, with the counts of the k-grams that
    begin with the start token, as no word stands before them."""
    def run(batches):
        for batch in batches:
            for file in batch.to_pylist():
                numbers = tables[-1].offset(file["path"]) + np.arange(file["n"])
                counts = file_values(file["path"], file["n"], file["kind"])[:, 0]
                here = _first_words(tables, numbers) == start
                rows = np.zeros((int(here.sum()), 5), np.int64)
                rows[:, 0] = counts[here]
                yield blobs(numbers[here].astype(KEY), rows, buckets, len(tables[-1]))
    return run


def counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5]


def discounts(n: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from the numbers of counts 1 to 4.
    Where a number is missing (tiny data) it counts as one.  D stays between
    ``LEAST`` and the count, so that every context leaves some mass to the rest."""
    n1, n2, n3, n4 = np.maximum(n, 1).tolist()
    y = n1 / (n1 + 2 * n2)
    d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.clip(d, [0, LEAST, LEAST, LEAST], [0, 1, 2, 3])


@dataclass
class Model:
    vocabulary: SortedArrays    # counts: c
    grams: list[SortedArrays]   # of k-grams, k = 2 to the order; counts: c
    stats: list[SortedArrays]   # of k-grams, k = 1 to the order - 1: a row for
    # each number with continuations (or c), n1, n2, n3 and total
    tokens: int                 # N
    distinct: int               # V
    continuations: int          # K
    d: list[np.ndarray]         # of k-grams, k = 2 to the order
    d_low: np.ndarray
    left_over: float            # D'1 m1 + D'2 m2 + D'3 m3

    def score(self, texts: list[str]):
        """For each text: tokens, known tokens, base score, score."""
        hashes, flat, begins = tokens(texts)
        number, c = _numbers(self.vocabulary, hashes)
        k = np.zeros(len(hashes), np.int64)
        k[number >= 0] = self.stats[0].values_at(number[number >= 0])[:, 0]
        uniform = 1 / (self.distinct + 1)
        low = np.full(len(hashes), uniform)
        if self.continuations:
            low = (np.maximum(k - self.d_low[np.minimum(k, 3)], 0)
                   + self.left_over * uniform) / self.continuations
        base = np.log10((c + 1) / (self.tokens + self.distinct + 1))

        words, since = number[flat], _since(len(flat), begins)
        p, lower, top = low[flat], words, len(self.grams) - 1
        for i, (numbers, counts) in enumerate(_numbered(self.grams, words, since)):
            at = np.flatnonzero(since >= i + 1)
            at = at[lower[at - 1] >= 0]
            context = self.stats[i].values_at(lower[at - 1])
            if i < top:
                counts[numbers >= 0] = self.stats[i + 1].values_at(numbers[numbers >= 0])[:, 0]
            seen, total, d = counts[at], context[:, 4], self.d[i]
            p[at] = np.where(total > 0, (np.maximum(seen - d[np.minimum(seen, 3)], 0)
                                         + context[:, 1:4] @ d[1:] * p[at])
                             / np.maximum(total, 1), p[at])
            lower = numbers
        at = np.flatnonzero(since > 0)  # a START is no token
        w = flat[at]
        first = begins - np.arange(len(begins))  # places among these
        per_text = [np.add.reduceat(x, first) for x in (
            np.ones(len(at), np.int64), (c[w] > 0).astype(np.int64), base[w], np.log10(p[at]))]
        return per_text


def train(docs: DataFrame, text_col: str = "text", order: int = 2) -> Model:
    if order < 2:
        raise ValueError("the order is two or more")
    spark = docs.sparkSession
    buckets, folder = slices(spark), scratch_path(spark, "llm", f"ngram-{uuid.uuid4().hex}")
    ship_package(spark)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = merged(texts.mapInArrow(_count_words(buckets), BLOBS), folder + "/words", 1,
                   lambda keys, counts: counts.sum().tobytes())
    vocabulary = SortedArrays.of(words, 1)
    noted = sum(int(np.frombuffer(r["note"], np.int64)[0]) for r in words.select("note").collect())

    def notes(files: DataFrame, n: int) -> np.ndarray:
        rows = [np.frombuffer(r["note"], np.int64) for r in files.select("note").collect()]
        return np.sum([np.zeros(n, np.int64), *rows], axis=0)

    def each_file(files: DataFrame, run) -> DataFrame:
        return files.select("path", "n", "kind").repartition(buckets).mapInArrow(run, BLOBS)

    files, grams = [], []
    for k in range(2, order + 1):
        if max([len(vocabulary), *map(len, grams)]) >= 1 << 32:
            raise ValueError("more than 2**32 distinct n-grams: pairs need more than 64 bits")
        files.append(merged(texts.mapInArrow(_count_grams(vocabulary, grams[:], buckets), BLOBS),
                            f"{folder}/grams{k}", 1,
                            lambda keys, counts: counts_of_counts(counts[:, 0]).tobytes()))
        grams.append(SortedArrays.of(files[-1], 1))
    with_start = 1 if len(vocabulary) else 0
    place, starts = _numbers(vocabulary, np.array([xxhash.xxh64_intdigest(START)], KEY)) \
        if len(vocabulary) else (np.array([-1]), np.array([0]))

    d, stats, adjusted = [discounts(notes(files[-1], 4))], [], None
    for i in reversed(range(order - 1)):  # the (i + 2)-grams
        below = len(grams[i - 1]) if i else len(vocabulary)
        parts = each_file(files[i], _followers(grams[:i + 1], adjusted, below, buckets))
        if i:
            parts = parts.unionByName(each_file(
                files[i - 1], _starts(grams[:i], int(place[0]), buckets)))
        followers = merged(parts, f"{folder}/followers{i + 2}", 5,
                           lambda keys, counts: np.concatenate(
                               [[counts[:, 0].sum()], counts_of_counts(counts[:, 0])]).tobytes(),
                           dense=True)
        adjusted = SortedArrays.of(followers, 5)
        if len(adjusted) != below:
            raise RuntimeError(f"{len(adjusted)} rows for {below} n-grams")
        stats.insert(0, adjusted)
        low = notes(followers, 5)
        if i:
            d.insert(0, discounts(low[1:]))
    d_low = discounts(low[1:])
    many = int(len(vocabulary) - with_start - low[1] - low[2])  # followed three words or more
    return Model(vocabulary, grams, stats, noted - int(starts[0]), len(vocabulary) - with_start,
                 int(low[0]), d, d_low,
                 float(d_low[1] * low[1] + d_low[2] * low[2] + d_low[3] * max(many, 0)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, perplexity."""
    def run(batches):
        for part in _parts(batches):
            n, known, base, total = model.score(part["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(n), pa.array(known), pa.array(base),
                 pa.array(total)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, base_score double, score double") \
        .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def score_held_out(docs: DataFrame, modulus: int = 7, held_out: int = 2, id_col: str = "doc_id",
                   text_col: str = "text", order: int = 2) -> DataFrame:
    """Train on the rows whose crc32 of the id leaves another remainder, and
    score all rows."""
    base = id_text(docs, id_col, text_col)
    remainder = crc_remainder(F.col("doc_id"), modulus)
    model = train(base.filter(remainder != held_out), order=order)
    return (score(base, model)
            .withColumn("held_out", crc_remainder(F.col("doc_id"), modulus) == held_out)
            .withColumn("train_tokens", F.lit(model.tokens).cast("long")))
