import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from reelstat.llm import variants
from tests.llm.helpers import empty, frame, rows

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    """One inserted, deleted or replaced code point, by trying them all."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_counts(data):
    n = Counter()
    for doc_id, text, *_ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 199 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            n[low] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute(data):
    n = brute_counts(data)
    out, form = [], {}
    for w in n:
        found = [v for v in n if near(w, v)]
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
        out.append((w, len(found)))
    def root(w):
        return root(form[w]) if form[w] else w
    return sorted((w, form[w], root(w), n[w], k, n.get(form[w])) for w, k in out)


def corpus(seed=5, docs=60):
    """Words with misspellings of several generations, anagrams, accents."""
    pick = random.Random(seed)
    stems = ["".join(pick.choice("abcdeé") for _ in range(pick.randint(5, 9))) for _ in range(25)]
    anagrams = ["".join(pick.sample("abcdefgh", 8)) for _ in range(40)]

    def edit(w):
        i, kind = pick.randrange(len(w)), pick.randrange(3)
        return (w[:i] + pick.choice("abcéÉ") + w[i + (kind > 0):]) if kind < 2 else w[:i] + w[i + 1:]

    pool = []
    for s in stems:
        weight, layer = 700, [s]
        for _ in range(4):
            pool += [(w, weight) for w in layer]
            layer, weight = [edit(w) for w in layer for _ in range(2)], weight // 6
    pool += [(a, 8) for a in anagrams]
    out = []
    for i in range(docs):
        some = pick.choices([w for w, _ in pool], [k for _, k in pool], k=700)
        out.append((i, " ".join(w.title() if pick.random() < 0.2 else w for w in some), "", "", 0))
    return out + rows()


def result(spark, data, **options):
    out = variants.spelling_variants(frame(spark, data) if data else empty(spark), **options)
    assert out.columns == COLUMNS
    return sorted((tuple(r) for r in out.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("options", [
    {}, {"leaf": 8, "sample": 40}, {"leaf": 4, "sample": 1000, "piece": 3, "sent": 5}])
def test_equals_brute_force(spark, options):
    data = corpus()
    want = brute(data)
    assert sum(f is not None for _, f, *_ in want) > 30
    assert any(r not in (w, f) for w, f, r, *_ in want)  # a chain of two forms
    assert result(spark, data, **options) == want


def test_awkward_rows_and_empty_table(spark):
    data = rows() * 6 + [(70, "straße STRASSE strasse " * 9, "", "", 0)]
    assert result(spark, data) == brute(data)
    assert result(spark, []) == []


def test_very_long_words_and_texts(spark):
    word = "abcdefghij" * 30_000
    text = f"{word} {word[:-1]} {word[1:]}x " + "padding words here; " * 60_000
    data = [(i, text, "", "", 0) for i in range(2, 8)]
    got = result(spark, data)
    assert got == brute(data) and len(got) >= 4
    assert sum(k for _, _, _, _, k, _ in got) >= 2


def test_pieces_cut_no_run():
    text = "abc défgh 12 " + "x" * 50 + " end"
    for most in (1, 3, 7, 20):
        parts = list(variants.pieces(text, most))
        assert "".join(parts) == text
        assert [r for p in parts for r in variants.RUN.findall(p)] == variants.RUN.findall(text)


def test_one_edit_and_trees_equal_brute_force():
    pick = random.Random(2)
    words = sorted({"".join(pick.choice("abcdefgé") for _ in range(7)) for _ in range(900)}
                   | {"".join(pick.sample("abcdefg", 7)) for _ in range(200)})
    held = variants.Words(words, list(range(len(words))))
    leaves = [leaf for leaf, _ in variants.reached(held.tree, held.counts, 10 ** 6, 10 ** 6)]
    assert len(leaves) > 20 and sorted(np.concatenate([x.rows for x in leaves])) == list(range(len(words)))
    for size in (6, 7, 8):
        asked = ["".join(pick.choice("abcdefgé") for _ in range(size)) for _ in range(150)]
        asked += [w[:size] if size < 7 else w + "a" * (size - 7) for w in words[:150]]
        got = {(int(a), int(b)) for x, y in held.pairs(variants.letter_matrix(asked))
               for a, b in zip(x, y)}
        assert got == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if near(a, b)}
