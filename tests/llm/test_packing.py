import collections
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from reelstat.llm import packing, queries
from tests.llm.helpers import empty, frame, rows, text_of


def placed(histogram, capacity, may_cut):
    """Check a plan; its number of sequences and padding."""
    sequences, parts = collections.defaultdict(list), collections.defaultdict(list)
    for source, first, stop, _, cut, ids, sequence, each, offset in packing.plan(
            histogram, capacity, may_cut):
        for rank in range(first, stop):
            n = rank - first
            sequences[sequence + n // each].append((offset + n % each * ids, ids))
            parts[source, rank].append((cut, ids))
    assert len(parts) == sum(histogram.values())
    for (source, _), some in parts.items():
        at = 0
        for cut, ids in sorted(some):
            assert cut == at
            at += ids
        assert at == source
    padding = 0
    for some in sequences.values():
        at = 0
        for offset, ids in sorted(some):
            assert offset == at
            at += ids
        assert at <= capacity
        padding += capacity - at
    assert sorted(sequences) == list(range(len(sequences)))
    return len(sequences), padding


def test_plans_place_every_piece_once():
    pick = random.Random(2)
    for _ in range(150):
        capacity = pick.choice([1, 2, 7, 30, 100])
        histogram = {pick.randint(1, capacity): pick.choice([1, 2, 3, 17, 100])
                     for _ in range(pick.randint(0, 20))}
        placed(histogram, capacity, True)
        placed(histogram, capacity, False)


def test_filling_is_the_best_subset():
    pick = random.Random(3)
    for _ in range(100):
        room = pick.randint(0, 40)
        counts = {pick.randint(1, 15): pick.randint(1, 3) for _ in range(4)}
        sums = {0}
        for length, n in counts.items():
            sums |= {s + k * length for s in sums for k in range(n + 1)}
        chosen = packing.fill(sorted(counts), counts, room)
        assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= room)
        assert all(k <= counts[n] for n, k in chosen.items())


def test_lengths_that_do_not_fit_together_are_cut():
    assert placed({3000: 1000}, 4096, False)[1] == 1000 * 1096
    assert placed({3000: 1000}, 4096, True)[1] < 4096


def test_documents(spark):
    capacity = 64
    got = packing.pack_documents(frame(spark), queries.WORD_BPE, capacity).collect()
    tokenizer = Tokenizer.from_file(queries.WORD_BPE)
    tokenizer.encode_special_tokens = True
    want = collections.Counter()
    by_ids = {}
    for r in rows():
        ids = tokenizer.encode(text_of(r), add_special_tokens=False).ids + [2]
        want[r[0], len(ids)] += len(ids)
        by_ids.setdefault(r[0], ids)
    have, sequences = collections.Counter(), collections.defaultdict(list)
    for p in got:
        have[p.doc_id, p.doc_tokens] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
        ids = by_ids[p.doc_id][p.start:p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert have == want
    padding = 0
    for some in sequences.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        padding += capacity - at
    assert padding < capacity


def test_empty_table(spark):
    assert packing.pack_documents(empty(spark), queries.WORD_BPE).count() == 0
