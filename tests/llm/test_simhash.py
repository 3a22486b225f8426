import random
import re

import numpy as np
import xxhash

from reelstat.llm import simhash
from reelstat.llm.components import smallest_reachable
from tests.llm.helpers import empty, frame, rows, text_of


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, near):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints(monkeypatch):
    for chunk in (simhash.HASHES, 7):
        monkeypatch.setattr(simhash, "HASHES", chunk)
        for r in rows():
            text = text_of(r)[:4000]
            assert simhash.fingerprint(text) & (1 << 64) - 1 == slow_fingerprint(text)


def test_tree_finds_all_within_the_radius():
    pick = random.Random(1)
    values = [pick.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree(values)
    for v in values[:60]:
        assert sorted(tree.within(v, 3)) == [i for i, w in enumerate(values)
                                             if (v ^ w).bit_count() <= 3]


def test_near_fingerprints_share_a_shard():
    pick = random.Random(2)
    for _ in range(300):
        a = pick.getrandbits(64)
        b = a
        for bit in pick.sample(range(64), 3):
            b ^= 1 << bit
        keys = simhash.shard_keys(np.array([a, b], np.uint64), 3)
        assert (keys[0] == keys[1]).any()


def family(n=120):
    """Signed fingerprints: chains of near ones, both signs, and strangers."""
    pick = random.Random(4)
    values = [pick.getrandbits(64) for _ in range(20)]
    while len(values) < n:
        v = pick.choice(values)
        for bit in pick.sample(range(64), pick.choice([1, 2, 3, 4])):
            v ^= 1 << bit
        values.append(v)
    return [v - (1 << 64) if v >> 63 else v for v in dict.fromkeys(values)]


def test_links_connect_what_all_pairs_connect(spark):
    values = family()
    mask = (1 << 64) - 1
    want = roots(values, lambda a, b: ((a ^ b) & mask).bit_count() <= 3)
    for shard in (simhash.SHARD, 3):  # small: every shard is dealt into pieces
        table = spark.createDataFrame([(v,) for v in values], "fp long")
        found = {tuple(sorted((r.a, r.b))) for r in simhash.links(table, 3, shard).collect()}
        assert all(((a ^ b) & mask).bit_count() >= 1 for a, b in found)
        got = roots(values, lambda a, b: tuple(sorted((a, b))) in found)
        assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    table = spark.createDataFrame([(b, a) if a % 3 else (a, b) for a, b in edges], "a long, b long")
    got = {r.node: r.root for r in smallest_reachable(table).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{100 + i: 100 for i in range(30)}}


def test_documents(spark):
    data = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0))
    values = [slow_fingerprint(text_of(r)[:10 ** 6]) for r in data]
    want = [data[i][0] for i in roots(values, lambda a, b: (a ^ b).bit_count() <= 3)]
    got = simhash.components(frame(spark)).collect()
    key = lambda t: tuple(map(str, t))
    assert sorted(((r.doc_id, r.component_id) for r in got), key=key) == \
        sorted(((r[0], w) for r, w in zip(data, want)), key=key)
    df = frame(spark)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, set(want)))


def test_empty_table(spark):
    assert simhash.components(empty(spark)).count() == 0
    assert simhash.deduplicate(empty(spark)).count() == 0
