import collections
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash

from reelstat.llm import key_counts, ngram_lm, queries
from tests.llm.helpers import empty, frame, rows, text_of


def tokens(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [w for w in re.split(r"[\x20\x09-\x0D]+", folded) if w] + ["</s>"]


class Slow:
    """The same model with dictionaries."""

    def __init__(self, texts):
        self.c = collections.Counter(w for t in texts for w in t)
        self.pairs = collections.Counter(p for t in texts for p in zip(["<s>", *t], t))
        self.follows = collections.Counter(w for _, w in self.pairs)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.d, self.d_low = self.discounts(self.pairs), self.discounts(self.follows)
        self.total, self.kinds = collections.Counter(), collections.defaultdict(collections.Counter)
        for (h, _), k in self.pairs.items():
            self.total[h] += k
            self.kinds[h][min(k, 3)] += 1
        self.left = sum(self.d_low[min(k, 3)] for k in self.follows.values())

    @staticmethod
    def discounts(counts):
        n = collections.Counter(counts.values())
        n1, n2, n3, n4 = (max(1, n[i]) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        return [min(max(x, 0.01 if i else 0), i) for i, x in enumerate(raw)]

    def p(self, h, w):
        k = self.follows[w]
        low = (max(k - self.d_low[min(k, 3)], 0) + self.left / (self.v + 1)) / len(self.pairs) \
            if self.pairs else 1 / (self.v + 1)
        if not self.total[h]:
            return low
        k = self.pairs[h, w]
        held = sum(self.d[i] * n for i, n in self.kinds[h].items())
        return (max(k - self.d[min(k, 3)], 0) + held * low) / self.total[h]


def data():
    more = [(100 + i, f"the cat {i % 7} sat on the mat {i % 3}\nand The dog {i % 5} ran", "", "", 0)
            for i in range(60)]
    return [r for r in rows() if r[0] != 9] + more


def test_scores_are_those_of_the_slow_model(spark):
    out = {(r.doc_id, r.n_tokens): r for r in ngram_lm.score_held_out(frame(spark, data())).collect()}
    held = {r[0]: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in data()}
    slow = Slow([tokens(text_of(r)) for r in data() if not held[r[0]]])
    assert any(held.values())
    for r in data():
        words = tokens(text_of(r))
        got = out[r[0], len(words)]
        assert got.held_out == held[r[0]] and got.train_tokens == slow.n
        assert got.n_known == sum(w in slow.c for w in words)
        base = sum(math.log10((slow.c[w] + 1) / (slow.n + slow.v + 1)) for w in words)
        score = sum(math.log10(slow.p(h, w)) for h, w in zip(["<s>", *words], words))
        assert got.base_score == pytest.approx(base) and got.score == pytest.approx(score)


class SlowOfOrder:
    """Interpolated modified Kneser-Ney of any order, with dictionaries."""

    def __init__(self, texts, order):
        self.order, padded = order, [("<s>", *t) for t in texts]
        raw = [None] + [collections.Counter(
            t[i:i + k] for t in padded for i in range(len(t) - k + 1)) for k in range(1, order + 1)]
        self.v = sum(g != ("<s>",) for g in raw[1])
        self.a = {order: raw[order]}
        for k in range(1, order):
            self.a[k] = collections.Counter(g[1:] for g in raw[k + 1])
            if k > 1:
                self.a[k].update({g: c for g, c in raw[k].items() if g[0] == "<s>"})
        self.d = {k: Slow.discounts(a) for k, a in self.a.items()}
        self.total, self.held = collections.Counter(), collections.Counter()
        for k, a in self.a.items():
            for g, c in a.items():
                self.total[g[:-1]] += c
                self.held[g[:-1]] += self.d[k][min(c, 3)]

    def p(self, h, w):
        low = self.p(h[1:], w) if h else 1 / (self.v + 1)
        if not self.total[h]:
            return low
        c = self.a[len(h) + 1][*h, w]
        return (max(c - self.d[len(h) + 1][min(c, 3)], 0) + self.held[h] * low) / self.total[h]

    def score(self, words):
        t = ("<s>", *words)
        return sum(math.log10(self.p(t[max(0, i - self.order + 1):i], t[i]))
                   for i in range(1, len(t)))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_of_any_order(spark, order):
    train = [r for r in data() if r[0] is None or r[0] % 3]
    model = ngram_lm.train(frame(spark, train), order=order)
    slow = SlowOfOrder([tokens(text_of(r)) for r in train], order)
    got = {(r.doc_id, r.n_tokens): r.score for r in ngram_lm.score(frame(spark, data()), model).collect()}
    for r in data():
        words = tokens(text_of(r))
        assert got[r[0], len(words)] == pytest.approx(slow.score(words))
    for h in ((), ("the",), ("<s>", "the"), ("on", "the"), ("unseen",)):
        if len(h) < order:
            assert sum(slow.p(h, w) for w in [*{w for w, in slow.a[1]}, "unknown"]) == pytest.approx(1)


def test_the_registered_model_looks_two_words_back(spark, monkeypatch):
    docs = frame(spark, data())
    monkeypatch.setattr(queries, "documents", lambda *_: docs)
    held = {r[0]: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in data()}
    slow = SlowOfOrder([tokens(text_of(r)) for r in data() if not held[r[0]]], 3)
    got = {(r.doc_id, r.n_tokens): r.score for r in queries.op2_ngram_lm(spark, "").collect()}
    for r in data():
        words = tokens(text_of(r))
        assert got[r[0], len(words)] == pytest.approx(slow.score(words))


def test_probabilities_sum_to_one():
    slow = Slow([tokens(text_of(r)) for r in data()])
    for h in ("the", "<s>", "cat", "unseen"):
        assert sum(slow.p(h, w) for w in slow.c) + slow.p(h, "unknown") == pytest.approx(1)


def test_nothing_to_learn_from_and_empty_table(spark):
    model = ngram_lm.train(empty(spark))
    assert (model.tokens, model.distinct) == (0, 0)
    assert {r.score for r in ngram_lm.score(frame(spark), model).collect()} == {0.0}
    assert ngram_lm.score_held_out(empty(spark)).count() == 0


def test_only_mounted_folders():
    assert key_counts.mounted("file:///a/b") == "/a/b" and key_counts.mounted("/a/b") == "/a/b"
    with pytest.raises(ValueError):
        key_counts.mounted("hdfs://host/a")


def test_tokens_split_and_fold_at_ascii_alone():
    pick = random.Random(41)
    odd = ["A", "Zb", "É", "ß", "İ", "\x1c", "\x1f", "\x85", " ", " ", "\x00", "🙂",
           " ", " ", "\t", "\n", "\x0b", "\x0c", "\r"]
    made = ["".join(pick.choice(odd) for _ in range(pick.randint(0, 9))) for _ in range(3000)]
    hashes, flat, begins = ngram_lm.tokens(made + [""])
    ends = [xxhash.xxh64_intdigest(w) for w in (ngram_lm.START, ngram_lm.END)]
    want = [[ends[0], *map(xxhash.xxh64_intdigest, t.encode().lower().split()), ends[1]]
            for t in made + [""]]
    assert [x.tolist() for x in np.split(hashes[flat], begins[1:])] == want
    assert len(set(hashes.tolist())) == len(hashes)
    assert [len(x) for x in ngram_lm.tokens([])] == [2, 0, 0]


def test_counts_are_stored_in_bytes_and_large_ones_in_full(spark, tmp_path):
    counts = {i: n for i, n in enumerate([0, 1, 254, 255, 256, 70_000, 2 ** 31, 3, 4, 5])}
    keys = np.array(list(counts), key_counts.KEY)
    rows = np.stack([list(counts.values()), list(reversed(counts.values()))], axis=1)
    parts = spark.createDataFrame([], key_counts.BLOBS)
    for chosen in (keys < 6, keys > 3):  # two blobs that share keys
        batch = key_counts.blobs(keys[chosen], rows[chosen], 3, len(keys))
        parts = parts.unionByName(spark.createDataFrame(
            [(b, bytes(k), bytes(c)) for b, k, c in zip(*(x.to_pylist() for x in batch))],
            key_counts.BLOBS))
    for dense in (False, True):
        table = key_counts.SortedArrays.of(key_counts.merged(
            parts, str(tmp_path / str(dense)), 2, dense=dense), 2)
        shared = np.where((keys > 3) & (keys < 6), 2, 1)[:, None]
        assert (table.values_at(np.arange(len(keys))) == rows * shared).all()
        at = np.array([5, 3, 3, 9, 0])
        assert (table.values_at(at) == (rows * shared)[at]).all()
    held = sum(f.stat().st_size for f in (tmp_path / "True").iterdir() if f.suffix == ".values")
    assert held == 2 * len(keys)  # a byte for each count
    assert sum(f.stat().st_size for f in (tmp_path / "True").iterdir()
               if f.suffix == ".keys") == 3 * 8  # a key for each of three buckets


def test_memory_of_merging_does_not_follow_the_rows():
    keys = np.arange(400_000, dtype=key_counts.KEY)
    runs = [(keys, np.ones((len(keys), 5), key_counts.COUNT)) for _ in range(4)]
    tracemalloc.start()
    try:
        _, counts = key_counts._summed(runs)
        # the rows in full would be 64 MB, and once more in the order of their keys
        assert counts.sum() == 8_000_000 and tracemalloc.get_traced_memory()[1] < 80_000_000
    finally:
        tracemalloc.stop()


def test_ascending():
    assert key_counts.ascending(np.array([3, 1, 3, 2, 1])).tolist() == [1, 2, 3]
    assert key_counts.ascending(np.zeros(0, np.int64)).tolist() == []


def test_blobs_leave_out_bytes_that_no_value_has():
    for values in ([0], [1, 255], [256, 7], [1 << 31], list(range(300))):
        values = np.array(values, key_counts.COUNT)
        raw = key_counts._planes(values)
        assert key_counts._unplanes(raw, key_counts.COUNT).tolist() == values.tolist()
    assert len(key_counts._planes(np.arange(200, dtype=key_counts.KEY))) == 201


def test_runs_are_summed_range_by_range(monkeypatch):
    pick = np.random.default_rng(3)
    runs = [(np.unique(pick.integers(0, 500, 300)).astype(key_counts.KEY),) for _ in range(7)]
    runs = [(k, pick.integers(0, 9, (len(k), 2)).astype(key_counts.COUNT)) for k, in runs]
    want = key_counts.distinct(*(np.concatenate([r[i] for r in runs]) for i in (0, 1)))
    for most in (1, 100, 10_000):
        monkeypatch.setattr(key_counts, "RANGE", most)
        keys, counts = key_counts._summed(runs)
        assert keys.tolist() == want[0].tolist() and counts.tolist() == want[1].tolist()
