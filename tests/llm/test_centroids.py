import hashlib
import math
import random

import numpy as np
import pytest

from reelstat.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, apex string"


def brute(rows, k=8, rounds=10, dim=64):
    """[(vec_id, cluster, distance)] and the centroids, in plain integers."""
    kept = [(i, [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v])
            for i, v in rows if v is not None and len(v) == dim
            and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        members = [[] for _ in centres]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centres = [[sum(col) // len(m) for col in zip(*m)] if m else c
                   for m, c in zip(members, centres)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centres


def expected(rows, **options):
    found, centres = brute(rows, **options)
    fit = lambda n: n if n < 1 << 63 else None
    total = sum(d for _, _, d in found)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    per = {c: sum(d for _, x, d in found if x == c) for _, c, _ in found}
    known = fit(max((d for _, _, d in found), default=0)) is not None
    return sorted(((i, c, fit(d), fit(per[c]) if all(fit(e) is not None for _, x, e in found if x == c)
                    else None, fit(total) if known else None, hashes[c]) for i, c, d in found),
                  key=repr)


def report(spark, rows, kind="float", **options):
    table = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows],
                                  SCHEMA.replace("float", kind)).repartition(3)
    out = centroids.cluster_report(table, **options)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                           "centroid_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


def cloud(n, dim=64, seed=3):
    pick = random.Random(seed)
    centres = [[pick.gauss(0, 0.3) for _ in range(dim)] for _ in range(9)]
    return [(i, [float(np.float32(c + pick.gauss(0, 0.1))) for c in pick.choice(centres)])
            for i in range(n)]


def test_equals_brute_force_with_awkward_rows(spark):
    rows = cloud(150)
    rows += [(200, None), (201, [0.5] * 63), (202, [float("nan")] * 64), (203, []),
             (204, [float("inf")] + [0.0] * 63), (205, [None] + [0.0] * 63),
             (None, [0.25] * 64), rows[3], rows[3], (rows[4][0], rows[5][1])]
    assert report(spark, rows) == expected(rows)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 3 - 1)] + [0.0] * 63) for i in range(40)]
    assert report(spark, rows, k=4, rounds=3) == expected(rows, k=4, rounds=3)


def test_components_of_any_size(spark):
    big = float(np.float32(3e38))
    rows = cloud(30) + [(100, [big] * 64), (101, [-big] * 64), (102, [2.0 ** 40] * 64)]
    assert report(spark, rows) == expected(rows)
    assert report(spark, [(i, [x * 1e150 for x in v]) for i, v in rows[:30]], kind="double") \
        == expected([(i, [x * 1e150 for x in v]) for i, v in rows[:30]])


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = cloud(n)
    assert report(spark, rows) == expected(rows)


def test_bounds_enclose_distances_and_filter():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 300, (9, 64)).round()
    x = (centres[rng.integers(0, 9, 400)] + rng.normal(0, 100, (400, 64))).round()
    s = centroids.Simplex(x[:16])
    assert len(s.pivots) == 16
    a, b = s.apex(s.distances(x)), s.apex(s.distances(centres))
    true = ((x[:, None] - centres[None]) ** 2).sum(2)
    low = ((a[:, None] - b[None]) ** 2).sum(2)
    high = low + 4 * a[:, None, -1] * b[None, :, -1]
    assert (low <= true * (1 + 1e-9)).all() and (true <= high * (1 + 1e-9)).all()
    may = s.may_be_nearest(a, b)
    assert may[np.arange(400), true.argmin(1)].all()
    assert may.mean() < 0.7


def test_equal_and_dependent_pivots_are_left_out():
    p = np.zeros((5, 64))
    p[2, 0], p[3, 0], p[4, 1] = 5, 10, 7
    s = centroids.Simplex(p)
    assert len(s.pivots) == 3  # the origin, one on each axis


def test_digits():
    for n in (0, 5, -5, 1 << 40, -(1 << 40) - 1, 12345 << 100, -(12345 << 100) + 7):
        d = centroids.digits(n)
        assert sum(x << (40 * i) for i, x in enumerate(d)) == n
        assert all(abs(x) <= 1 << 40 for x in d)
