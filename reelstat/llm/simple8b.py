"""Simple-8b: unsigned integers packed into 64-bit words.

The top four bits of a word select how many numbers it holds and how wide they
are; the other 60 bits hold them, the first in the lowest bits.  Selector 0 is
an escape: the next word is one number written out in full, for numbers that
need more than 60 bits.  Numbers are coded in blocks that each begin a word, so
a block can be decoded by itself from its offset.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
WORD = np.dtype("<u8")
ESCAPE = 0
#: Fixed values of the format: numbers per word for selectors 1 to 14.  The
#: width follows: 60 bits shared by that many numbers.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = tuple(60 // c for c in COUNTS)

_PER_WORD = np.array([1, *COUNTS, 0], np.int64)


def _runs(good: np.ndarray, count: int) -> np.ndarray:
    """Where ``count`` trues in a row begin, along the last axis."""
    out, have = good, 1
    while have < count:
        step = min(have, count - have)
        out = out[:, :-step] & out[:, step:]
        have += step
    return out


def _selectors(values: np.ndarray, block: int) -> np.ndarray:
    """For each place the selector of a word that would begin there: the one
    that holds most of the numbers from there to the end of the block."""
    n = len(values)
    rows = -(-n // block)
    # 32 bits hold most ids, and comparing them is half the work
    kind = np.uint32 if values.max() < np.iinfo(np.uint32).max else np.uint64
    padded = np.full((rows, block), np.iinfo(kind).max, kind)
    padded.reshape(-1)[:n] = values
    best = np.full((rows, block), ESCAPE, np.uint8)
    for selector in range(len(COUNTS), 0, -1):  # from wide to narrow numbers
        count, width = COUNTS[selector - 1], WIDTHS[selector - 1]
        if count > block:
            break
        limit = 1 << width
        narrow = padded < kind(limit) if limit <= np.iinfo(kind).max else \
            np.arange(rows * block).reshape(rows, block) < n
        fits = _runs(narrow, count)
        if not fits.any():
            break  # longer runs of narrower numbers there are none either
        np.putmask(best[:, :fits.shape[1]], fits, np.uint8(selector))
    return best.reshape(-1)[:n]


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the word at which each block begins."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if n == 0:
        return np.zeros(0, WORD), np.zeros(0, np.int64)
    starts = np.arange(0, n, block)
    selector = _selectors(values, block)
    step = _PER_WORD.astype(np.uint8)[selector].tobytes()
    at, places = 0, []
    while at < n:
        places.append(at)
        at += step[at]
    places = np.array(places, np.int64)
    selector = selector[places]
    out_at = np.cumsum(1 + (selector == ESCAPE)) - 1 - (selector == ESCAPE)
    words = np.zeros(int(out_at[-1]) + 1 + int(selector[-1] == ESCAPE), WORD)
    for s in np.unique(selector):
        here, to = places[selector == s], out_at[selector == s]
        if s == ESCAPE:
            words[to + 1] = values[here]
            continue
        word = np.full(len(here), np.uint64(int(s) << 60))
        for j in range(COUNTS[s - 1]):
            word |= values[here + j] << np.uint64(j * WIDTHS[s - 1])
        words[to] = word
    return words, out_at[np.searchsorted(places, starts)]


def decode(words: np.ndarray) -> np.ndarray:
    """The numbers of one block or of several that follow each other."""
    words = np.asarray(words, WORD)
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == ESCAPE).any():
        after = -1
        for i in np.flatnonzero(selector == ESCAPE):
            if i != after:  # else it is the number of the escape before it
                after = i + 1
                if after < len(selector):
                    selector[after] = len(_PER_WORD) - 1
    count = _PER_WORD[selector]
    at = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(selector):
        here, to = np.flatnonzero(selector == s), at[selector == s]
        if s == ESCAPE:
            out[to] = words[here + 1]
        elif s <= len(COUNTS):
            k, width = COUNTS[s - 1], WIDTHS[s - 1]
            mask = np.uint64((1 << width) - 1)
            for j in range(k):
                out[to + j] = (words[here] >> np.uint64(j * width)) & mask
    return out
